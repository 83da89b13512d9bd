"""Chat formatting: records of many layouts to canonical turns, and turns to text with a loss mask.

The nested field paths of a record, those that some layout knows, are hashed; the hash selects a declarative mapping to
turns. Everything is DataFrame expressions. A formatted text marks turns with control strings; a control string's
beginning inside a text or role gets one backslash more, which reading takes away again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
LEARN = "assistant"


@dataclass(frozen=True)
class Layout:
    """How the fields of one layout become turns.

    many: path of a list whose items are turns, with role and text fields; parts: (role, path) of single fields, where
    parts of the same role are one turn, joined by an empty line; rows: fields of id, order, role and text where each
    row is a turn.
    """

    name: str
    many: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None

    @property
    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        listed = [f"{self.many[0]}[].{x}" for x in self.many[1:]] if self.many else []
        return sorted([*listed, *(p for _, p in self.parts)])


LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", many=("messages", "role", "content")),
    Layout("messages with system", many=("messages", "role", "content"), parts=(("system", "system"),)),
    Layout("from and value", many=("conversations", "from", "value")),
    Layout("from and value with system", many=("conversations", "from", "value"), parts=(("system", "system"),)),
    Layout("prompt and completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt and response", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", parts=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction and output", parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction, input and output", parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(
        "system, instruction, input and output",
        parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
)
# Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}
KNOWN = sorted({p for x in LAYOUTS for p in x.paths if not x.rows})


def schema_paths(kind: DataType, before: str = "") -> list[str]:
    """Nested field paths of a schema; items of a list are written with []."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{before}.{f.name}" if before else f.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{before}[]")
    return [before]


def turns_of_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in which each row is a turn; other columns are left out.

    The layout is chosen by the hash of those of the table's field paths that a layout of rows names.
    """
    paths = set(schema_paths(df.schema))
    for layout in LAYOUTS:
        if layout.rows and BY_FINGERPRINT.get(fingerprint([p for p in paths if p in layout.paths])) is layout:
            return df.select(*(F.col(f"`{a}`").alias(b) for a, b in zip(layout.rows, ("conv_id", "turn", "role", "text"), strict=True)))
    raise ValueError(f"no layout of rows for the fields {sorted(paths)}")


def record_fingerprint(record: Column) -> Column:
    """Hash of the known nested field paths of a record (variant); null for what is no record."""

    def there(path: str) -> Column:
        if "[]" not in path:
            return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()
        items, field = path.split("[].")
        each = F.try_variant_get(record, f"$.{items}", "array<variant>")
        return F.coalesce(F.exists(each, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))

    found = F.filter(F.array(*(F.when(there(p), F.lit(p)) for p in KNOWN)), lambda p: p.isNotNull())
    return F.when(record.isNotNull(), F.sha2(F.array_join(F.array_sort(found), "\n"), 256))


def _turns(layout: Layout, record: Column) -> Column:
    def text(of: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(of, f"$.{path}", "string"), F.lit(""))

    def turn(role: Column, content: Column) -> Column:
        lower = F.lower(role)
        canonical = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[lower], lower)
        return F.struct(canonical.alias("role"), content.alias("text"))

    made = F.array().cast("array<struct<role: string, text: string>>")
    roles = list(dict.fromkeys(r for r, _ in layout.parts))
    for role in roles:
        fields = F.array(*(text(record, p) for r, p in layout.parts if r == role))
        joined = F.array_join(F.filter(fields, lambda x: x != ""), "\n\n")
        # an empty system prompt is no turn
        one = F.array(turn(F.lit(role), joined))
        made = F.concat(made, F.when(joined == "", F.array().cast("array<struct<role: string, text: string>>")).otherwise(one) if role == "system" else one)
    if layout.many:
        items, role, content = layout.many
        each = F.coalesce(F.try_variant_get(record, f"$.{items}", "array<variant>"), F.array().cast("array<variant>"))
        made = F.concat(made, F.transform(each, lambda x: turn(text(x, role), text(x, content))))
    return made


def turns_of_records(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records, one per row; turns: array of (role, text).

    A record that is null, no JSON or of no known layout has a null layout and no turns; fields that no layout knows
    don't matter, null and missing texts are empty. Repeated rows and null ids stay.
    """
    parsed = F.try_parse_json(F.col(record))
    rows = df.select(F.col(conv_id).alias("conv_id"), parsed.alias("r")).withColumn("f", record_fingerprint(F.col("r")))
    layout, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role: string, text: string>>")
    for mark, known in BY_FINGERPRINT.items():
        if not known.rows:
            layout = F.when(F.col("f") == mark, known.name).otherwise(layout)
            turns = F.when(F.col("f") == mark, _turns(known, F.col("r"))).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role is ended by a line break, so its own are written as %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of each conversation in ``turns`` (conv_id, turn, role, text).

    loss: array of (start, end) in code points of formatted, one for each assistant text. Turns are in order of turn
    (null last), then role and text; repeated rows are turns of their own. A null text or role is empty; rows without a
    conv_id are one conversation. No rows give no rows. A conversation is one row of the result, so it has to fit one.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    cut = clean.select(
        "conv_id", "turn", "role", "text", F.concat(head, text, F.lit(END + "\n")).alias("piece"), F.length(head).alias("head"), F.length(text).alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("at", before.cast("bigint"))
    begin = F.col("at") + F.col("head")
    span = F.when(F.col("role") == LEARN, F.struct(begin.alias("start"), (begin + F.col("size")).alias("end")))
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss")
    )
    return grouped.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted text holds."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    each = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - F.lit(len(END) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(each, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, as they were before formatting."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
