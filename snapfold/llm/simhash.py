"""SimHash near-duplicates: fingerprints whose distance is within a few bits, found by deletion variants.

A fingerprint is cut into ``max_bits // 2 + 1`` segments, so that two fingerprints within ``max_bits`` agree in
one of them but for one bit at most. Every segment is indexed as it is and with each of its bits left out; equal
index keys bring candidates together and the whole fingerprints are compared. Fingerprints are made distinct
first, so copies, however many, are one row here, and a bucket gives no more links than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.common import cut, prepare, sorted_groups, whole
from snapfold.llm.components import components

BITS = 64
#: Up to so many fingerprints of a bucket are compared pair by pair, in memory; more are grouped by what
#: remains of them without any ``max_bits`` bits, which finds the same links.
PAIRWISE = 1024
SEED = 42
PART = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, A-Z lower-cased; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, PART):
        rows = hashes[i : i + PART].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, bits) of every row; bits is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made.view(np.int64))], ["doc_id", "bits"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, bits bigint")


def roots(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """Index of the first of those that each distinct fingerprint is linked with, over any number of steps."""
    n = len(prints)
    root = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = root[a], root[b]
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root != root[root]).any():
                root[:] = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]

    if n <= PAIRWISE:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= max_bits) + i + 1
            settle(np.full(len(near), i), near)
        return root
    differ = np.bitwise_or.reduce(prints ^ prints[0])
    free = [b for b in range(BITS) if int(differ) >> b & 1]
    for bits in combinations(free, min(max_bits, len(free))):
        keys = prints & ~np.uint64(sum(1 << b for b in bits))
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        settle(order[same], order[same + 1])
    return root


def index_keys(bits: str, max_bits: int) -> list[tuple[int, int]]:
    """(shift and mask of) the index variants: each segment whole, and without each of its bits.

    Where ``max_bits`` is even, a last segment with one differing bit leaves another one with one at most, so
    the last is indexed whole only.
    """
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    made = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        whole_mask = ((1 << (high - low)) - 1) << low
        made.append(whole_mask)
        if max_bits % 2 or i < n - 1:
            made += [whole_mask & ~(1 << b) for b in range(low, high)]
    return made


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within ``max_bits``; b is the smallest of its bucket's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, ends in sorted_groups(batches, "key"):
            values = rows.column("bits").to_numpy().view(np.uint64)
            a, b = [], []
            for i in np.flatnonzero(ends - begins > 1):
                group = values[begins[i] : ends[i]]
                root = roots(group, max_bits)
                moved = root != np.arange(len(group))
                a.append(group[moved])
                b.append(group[root[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    masks = index_keys("bits", max_bits)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)))
    spread = prints.select("bits").distinct().select("bits", F.explode(keys).alias("key")).select("key", "bits")
    spark = prints.sparkSession
    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = spread.repartition(wide, "key").sortWithinPartitions("key", "bits")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, bits, component_id) of every row of ``docs`` (doc_id, text; other columns are not read).

    Fingerprints of ``shingle``-word shingles link at ``max_bits`` or fewer differing bits; component_id is the
    smallest doc_id that links reach. A null text counts as empty, empty texts have fingerprint 0 and link like
    any other; repeated rows stay and share their component; rows without a doc_id stay, and a component of
    such rows alone has a null component_id. No rows give no rows.
    """
    prints = cut(fingerprints(docs, shingle))
    classes = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    joined = components(links(prints, max_bits))
    named = classes.join(joined.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_bits = named.join(ids, "root").select("bits", "component_id")
    return prints.join(by_bits, "bits").select("doc_id", "bits", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest doc_id.

    Of rows that share that doc_id the one with the smallest text stays. Rows without a doc_id can't be told
    apart in the groups and all stay.
    """
    groups = simhash_groups(docs, shingle, max_bits)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = named.select(*docs.columns, F.row_number().over(order).alias("__n")).where("__n = 1").drop("__n")
    return first.unionByName(docs.where("doc_id is null"))
