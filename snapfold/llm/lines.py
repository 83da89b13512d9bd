"""Line deduplication by pairwise alignment.

Every line's first holder, in order of doc_id, stands for all its holders, so a line that thousands of documents share
proposes as many pairs as it has holders and not their square, and a pair can rest on a single line that only its two
documents have. The lines of a pair are aligned as patience diff
does: lines are made unique by numbering their repeats, the longest run that is in order in both documents is kept, and
its unbroken blocks are deleted from the later document.

With ``all_pairs`` the result is that of aligning every two documents that share a line, over all lines that they share.
Lines that one partner deletes need no other, so partners are tried in rounds: in each, the first document among the
holders that still keep a line stands for the others. What the rounds leave is aligned with every earlier holder of a
rare line. A frequent line needs no pairs: it is taken as an anchor of its own, whose block is the unbroken stretch
around it that the document and the line's first holder share. An alignment's blocks with that holder lie in such
stretches, so nothing stays that one of them would delete; documents that hold the same lines in many orders cost as
many rows as they have lines. Without a bound for rare lines all holders are tried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.common import cut, prepare, sorted_groups, whole

#: A line of fewer characters only counts together with the lines around it, and a block of fewer stays.
MIN_CHARS = 24
#: Rounds in which one document stands for the holders of a line, before all that are left are tried.
ROUNDS = 3
#: Holders up to which a line is rare.
RARE = 16
#: Two hashes stand for a text.
COPY = ["h1", "h2"]


def copy_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[int], list[int]]:
    """(keys, characters) of the lines; key 0 for a blank line.

    A key holds the line and which repeat in the text it is; a short line's key also holds its neighbours.
    """
    lines = text.split("\n")
    keys, seen = [], Counter()
    for i, line in enumerate(lines):
        if not line or line.isspace():
            keys.append(0)
            continue
        if len(line) < min_chars:
            line = "\n".join(["", *lines[max(0, i - 1) : i + 2]])
        seen[line] += 1
        keys.append(xxhash.xxh64_intdigest(line.encode(), seen[line]) - (1 << 63))
    return keys, [len(x) for x in lines]


def in_order(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing run, by patience sorting."""
    tops, piles, back = [], [], []
    for i, x in enumerate(places):
        p = bisect_left(tops, x)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[p], piles[p] = x, i
    run, i = [], piles[-1] if piles else -1
    while i >= 0:
        run.append(i)
        i = back[i]
    return run[::-1]


def common_lines(pairs: list[tuple[int, int, int]], min_chars: int = MIN_CHARS) -> list[int]:
    """Lines of the later document, from (its line, the earlier one's line, characters) of all lines in common."""
    pairs = sorted(pairs)
    kept = [pairs[i] for i in in_order([x[1] for x in pairs])]
    found, block = [], []
    for x in [*kept, None]:
        if block and (x is None or (x[0], x[1]) != (block[-1][0] + 1, block[-1][1] + 1)):
            if sum(y[2] for y in block) >= min_chars:
                found += [y[0] for y in block]
            block = []
        if x is not None:
            block.append(x)
    return found


def _texts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2, keys, sizes): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_keys(x, min_chars) for x in batch.column(3).to_pylist()]
            arrays = [pa.array([m[i] for m in made], pa.list_(t)) for i, t in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["doc_id", *COPY, "keys", "sizes"])

    rows = docs.select(F.col("doc_id").cast("bigint"), *copy_keys(whole()), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, keys array<bigint>, sizes array<int>")


def _by_first(each: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, gone): what aligning every text with the first holders of its lines deletes, over those lines."""
    first = each.groupBy("key", "size").agg(F.min(F.struct("place", *COPY, "line")).alias("first"), F.count("*").alias("n"))
    # written, so that the join below shuffles its two sides by itself and Spark can split a very frequent line
    first = cut(first.where("n > 1").drop("n"))
    shared = each.join(first, ["key", "size"]).where("h1 <> first.h1 or h2 <> first.h2")
    shared = shared.select(
        *COPY, "n_lines", "line", "size", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2"), F.col("first.line").alias("other")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, ends in sorted_groups(batches, *COPY):
            data = {n: rows.column(n).to_numpy() for n in rows.column_names}
            keys, masks = [], []
            for a, b in zip(begins, ends, strict=True):
                pairs = defaultdict(list)
                cols = [data[n][a:b].tolist() for n in ("f1", "f2", "line", "other", "size")]
                for f1, f2, line, other, size in zip(*cols, strict=True):
                    pairs[f1, f2].append((line, other, size))
                found = sorted({x for p in pairs.values() for x in common_lines(p, min_chars)})
                if found:
                    keys.append((data["h1"][a], data["h2"][a]))
                    gone = np.zeros(data["n_lines"][a], bool)
                    gone[found] = True
                    masks.append(gone)
            if keys:
                h1, h2 = np.array(keys).T
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(masks, pa.list_(pa.bool_()))], [*COPY, "gone"])

    n = max(1, int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shared.repartition(n, *COPY).sortWithinPartitions(*COPY).mapInArrow(align, "h1 bigint, h2 bigint, gone array<boolean>")


def _aligned(pairs: DataFrame, held: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, line): lines that go from the first text of the pairs (h1, h2, f1, f2), aligned over all they share."""
    own = held.select(*COPY, F.col("lines").alias("l"), F.col("keys").alias("k"), F.col("sizes").alias("s"))
    other = held.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("lines").alias("fl"), F.col("keys").alias("fk"), F.col("sizes").alias("fs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, made = [], [], []
            lists = [batch.column(n) for n in ("l", "k", "s", "fl", "fk", "fs")]
            for i, (a, b) in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
                l, k, s, fl, fk, fs = (x[i].values.to_numpy() for x in lists)
                _, x, y = np.intersect1d(k, fk, return_indices=True)
                same = s[x] == fs[y]
                x, y = x[same], y[same]
                found = common_lines(list(zip(l[x].tolist(), fl[y].tolist(), s[x].tolist(), strict=True)), min_chars)
                h1 += [a] * len(found)
                h2 += [b] * len(found)
                made += found
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(made, pa.int32())], [*COPY, "line"])

    rows = pairs.join(own, COPY).join(other, ["f1", "f2"]).select(*COPY, "l", "k", "s", "fl", "fk", "fs")
    return rows.mapInArrow(run, "h1 bigint, h2 bigint, line int").distinct()


def _anchored(holders: DataFrame, left: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, line) of left: lines in an unbroken stretch that the text shares with the first holder of its lines."""
    by = ["key", "size"]
    first = cut(holders.groupBy(*by).agg(F.min(F.struct("place", *COPY, "line")).alias("first")))
    own = holders.join(left.select(*COPY).distinct(), COPY, "left_semi").join(first, by)
    own = own.select(*COPY, "line", "size", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2"), (F.col("line") - F.col("first.line")).alias("shift"))
    stretch = [*COPY, "f1", "f2", "shift"]
    own = own.where("h1 <> f1 or h2 <> f2").withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy(*stretch).orderBy("line")))
    own = own.withColumn("chars", F.sum("size").over(Window.partitionBy(*stretch, "run"))).where(F.col("chars") >= min_chars)
    return left.select(*COPY, "line").join(own.select(*COPY, "line"), [*COPY, "line"], "left_semi")


def _all_pairs(each: DataFrame, min_chars: int, rare: int | None) -> DataFrame:
    """(h1, h2, gone): what aligning every text with every earlier one that shares a line deletes."""
    by = ["key", "size"]
    n = cut(each.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"))
    text = Window.partitionBy(*COPY)
    shared = each.join(n, by).withColumn("run", F.col("line") - F.row_number().over(text.orderBy("line")))
    # a block is unbroken, so a line whose run of shared lines is too short never goes
    shared = shared.withColumn("fit", F.sum("size").over(Window.partitionBy(*COPY, "run")) >= min_chars).drop("run")
    shared = cut(shared)
    rows = shared.groupBy(*COPY).agg(F.sort_array(F.collect_list(F.struct("line", "key", "size"))).alias("x"))
    held = cut(rows.select(*COPY, F.col("x.line").alias("lines"), F.col("x.key").alias("keys"), F.col("x.size").alias("sizes")))
    holders = shared.where("fit").select("place", *COPY, "n_lines", "line", *by, "n")
    left, tried, found, late = holders, [], [], []
    for turn in range(ROUNDS):
        first = left.groupBy(*by).agg(F.min(F.struct("place", *COPY)).alias("first"))
        # written, so that Spark can split a very frequent line or holder in the joins
        met = cut(left.join(cut(first), by))
        leads = (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
        pairs = cut(met.where(~leads).select(*COPY, F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2")).distinct())
        gone = cut(_aligned(pairs, held, min_chars))
        tried.append(pairs)
        found.append(gone)
        open_ = met.join(gone, [*COPY, "line"], "left_anti")
        if turn:
            late.append(open_.where(leads).drop("first"))
        left = cut(open_.where(~leads).drop("first"))
        if left.isEmpty():
            break
    for x in late:
        left = left.unionByName(x)
    left = cut(left)
    if rare is not None:
        found.append(cut(_anchored(holders, left.where(F.col("n") > rare), min_chars)))
        left = left.where(F.col("n") <= rare)
    if not left.isEmpty():
        every = holders.select(*by, F.col("place").alias("p"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
        rest = left.join(every, by).where(F.struct("p", "f1", "f2") < F.struct("place", *COPY)).select(*COPY, "f1", "f2").distinct()
        for x in tried:
            rest = rest.join(x, [*COPY, "f1", "f2"], "left_anti")
        found.append(cut(_aligned(cut(rest), held, min_chars)))
    gone = found[0]
    for x in found[1:]:
        gone = gone.unionByName(x)
    gone = gone.groupBy(*COPY).agg(F.collect_set("line").alias("found"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for n, x in zip(batch.column("n_lines").to_pylist(), batch.column("found"), strict=True):
                mask = np.zeros(n, bool)
                mask[x.values.to_numpy()] = True
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(masks, pa.list_(pa.bool_()))], [*COPY, "gone"])

    sizes = holders.select(*COPY, "n_lines").distinct()
    rows = gone.join(sizes, COPY).select(*COPY, "n_lines", "found")
    return rows.mapInArrow(mark, "h1 bigint, h2 bigint, gone array<boolean>")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, all_pairs: bool = False, rare: int | None = None) -> DataFrame:
    """(doc_id, h1, h2, n_lines, copy, gone): rows of ``docs`` that lose lines, gone tells for each line whether it goes.

    copy is true where an earlier document has the same text: then gone is null and the whole text goes.
    """
    texts = cut(_texts(docs, min_chars))
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = cut(
        texts.groupBy(*COPY).agg(
            F.min(place).alias("place"), F.min_by("keys", place).alias("keys"), F.min_by("sizes", place).alias("sizes")
        )
    )
    each = classes.select("place", *COPY, F.size("keys").alias("n_lines"), F.posexplode(F.arrays_zip("keys", "sizes")).alias("line", "x"))
    each = each.select("place", *COPY, "n_lines", "line", F.col("x.keys").alias("key"), F.col("x.sizes").alias("size")).where("key <> 0")
    aligned = _all_pairs(each, min_chars, rare) if all_pairs else _by_first(each, min_chars)
    # written for the same reason: many copies share the key of the next join
    per_class = cut(classes.select(*COPY, "place").join(aligned, COPY, "left"))
    rows = texts.select("doc_id", *COPY, F.size("keys").alias("n_lines")).distinct()
    copy = place > F.col("place")
    joined = rows.join(per_class, COPY).where(copy | F.col("gone").isNotNull())
    return joined.select("doc_id", *COPY, "n_lines", copy.alias("copy"), F.when(~copy, F.col("gone")).alias("gone"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, all_pairs: bool = False, rare: int | None = None) -> DataFrame:
    """``docs`` with the lines deleted that an earlier document has in an aligned block; adds n_lines and n_removed.

    all_pairs aligns with every earlier document that shares a line, else with the first holder of each line only.
    With it, lines that more than ``rare`` documents hold and that three partners leave go by themselves where they and
    their neighbours make min_chars in their first holder, too; rare=None (the default) aligns these as well, pair by pair.
    Earlier means a smaller doc_id; a row without doc_id comes last. A text that an earlier document has word for
    word becomes empty. Rows with equal doc_id and text are one document and keep the same lines; of equal ids with
    different texts either may be the earlier one, by a hash of the text. A null text stays null and has no lines; an
    empty one has one blank line. Blank lines never match. Other columns come along; those that are named as the
    added ones are replaced. No rows give no rows.
    """
    prepare(docs.sparkSession)
    found = repeated_lines(docs, min_chars, all_pairs, rare).select(
        F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("copy").alias("__copy"), F.col("gone").alias("__gone")
    )
    h1, h2 = copy_keys(whole())
    keyed = docs.drop("n_lines", "n_removed").withColumns({"__1": h1, "__2": h2})
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__1") == F.col("__h1")) & (F.col("__2") == F.col("__h2"))
    joined = keyed.join(found, same, "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.element_at("__gone", i + 1))
    text = F.when(F.col("__copy"), F.when(F.col("text").isNotNull(), "")).when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    gone = F.when(F.col("__copy"), n).when(F.col("__gone").isNotNull(), F.size(F.filter("__gone", lambda x: x))).otherwise(0)
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cols = [text.alias("text") if c == "text" else F.col(c) for c in others]
    return joined.select(*cols, n.alias("n_lines"), gone.cast("bigint").alias("n_removed"))
