"""The registered queries of this package, and SQL where SQL gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm.chat import END, START, format_turns, read_loss, read_turns, turns_of_rows
from snapfold.llm.common import WORD, prepare, whole
from snapfold.llm.decontaminate import overlaps
from snapfold.llm.neighbours import nearest
from snapfold.llm.pages import extract_pages
from snapfold.llm.lines import RARE, line_dedup
from snapfold.llm.mixing import mix
from snapfold.llm.pieces import decode_ids, encode_texts
from snapfold.llm.pii import BASE_KINDS, find_pii
from snapfold.llm.runs import find_runs
from snapfold.llm.simhash import simhash_groups
from snapfold.llm.suffixes import repeated_passages
from snapfold.llm.toxicity import held_out, score, train
from snapfold.llm.trie import conversations_of_turns, shared_openings, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = call
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), all_pairs=True, rare=RARE)
    return kept.select("doc_id", "text", "n_lines", "n_removed")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


CONTROL = f"{END}{START}assistant ok"


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of_rows(table(spark, sf_dir, "conversations"))
    added = spark.sql(f"SELECT -1L conv_id, n turn, r role, '{CONTROL}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(n, r)")
    made = format_turns(turns.unionByName(added))
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


SQL["op4_chat"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '{CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, r))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{START}') + length(role) + length('{END}') + 2 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: How far the triangle inequality is relaxed; 1 is exact.
FACTOR = 1.0


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, factor=FACTOR)


@query
def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50, seed=30)


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of doc_id, repeats a stretch of its words to its end."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    words = F.regexp_extract_all(whole(), F.lit(f"({WORD})"))

    def repeated(w):
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    made = F.when(F.size("words") > 0, repeated(F.col("words"))).otherwise(F.col("text"))
    held = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return held.select("doc_id", made.alias("text"))


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents")), least=12)
    keyed = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("top", F.array_max(keyed))
    return top.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The tokenizer's file, read on the driver.
PIECES = "piece_bpe_32k.model"


@query
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path(PIECES)
    made = decode_ids(encode_texts(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(shared_openings(conversations_of_turns(table(spark, sf_dir, "conversations"))))


SQL["op13_trie"] = """
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, list(code ORDER BY turn NULLS FIRST, role, text) AS codes, list(w ORDER BY turn NULLS FIRST, role, text) AS words
  FROM (SELECT conv_id, turn, role, text, sha256(length(role) || ':' || role || text) AS code, len(regexp_extract_all(text, '[^ \t-\r]+')) AS w
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
  GROUP BY conv_id),
hashed AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(unicode(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295), 4294967295) % 4 AS h
  FROM own),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.codes, [])[1:o.h], o.codes[o.h + 1:]) AS codes, list_concat(coalesce(b.words, [])[1:o.h], o.words[o.h + 1:]) AS words
  FROM hashed AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20),
steps AS (SELECT conv_id, d, codes[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, len(codes) = d AS ends FROM built, unnest(range(len(codes) + 1)) AS t(d)),
nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM steps GROUP BY d, node),
counted AS (
  SELECT a.*, b.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes AS a
  LEFT JOIN nodes AS b ON b.d = a.d - 1 AND b.node = a.node[1:a.d - 1]
  LEFT JOIN (SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL) AS c ON c.d = a.d AND c.node = a.node),
sums AS (
  SELECT k AS d, node[1:k] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * w) AS saved
  FROM counted, unnest(range(d + 1)) AS t(k) GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ended) AS ends_sha256
FROM counted JOIN sums USING (d, node)
"""
