"""Redaction by a table of literals of any number.

The alternation of ``functions.text.redact`` names every literal in one pattern on the driver. Here a filter of fixed
size is built from the literals' hashes, texts are scanned with it batch by batch, and what it lets through is joined
with the literals. The scan is the one place of this part that needs Arrow batches: a rolling hash at every character
has no built-in function.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from snapfold.functions.text import MIN_SECRET_LENGTH, REDACTED, utf16_length

# The functions below travel to the executors by value, which therefore need no installation of them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of the filter (2 MB), of which a literal sets two; more literals than it serves well only cost time.
FILTER_BITS = 1 << 24
#: Characters of a literal that are looked for first.
SEED = MIN_SECRET_LENGTH

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hash of any stretch of a text, in code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.n = len(codes)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, _STEP)]), dtype=np.uint64)
        sums = np.cumsum(_mix(codes + np.uint64(1)) * powers[:-1], dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], sums])
        self.undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, _BACK)]), dtype=np.uint64)

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[places + size] - self.sums[places]) * self.undo[places] + np.uint64(size))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FILTER_BITS)).astype(np.int64)


def _literal_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text in batch.column(0).to_pylist():
            first = np.zeros(1, np.int64)
            rolling = Rolling(text)
            made += [_bits(rolling.at(first, size))[0] for size in {min(SEED, rolling.n), rolling.n}]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], ["bit"])


def _resolved(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with its spans replaced, from the left, the longest of those that begin at a place."""
    parts, done = [], 0
    for at, size in sorted(spans, key=lambda s: (s[0], -s[1])):
        if at >= done:
            parts += [text[done:at], REDACTED]
            done = at + size
    return "".join(parts) + text[done:]


def known_literals(literals: DataFrame, column: str = "literal") -> DataFrame:
    """(literal, size) of the distinct literals that are long enough to redact; size in code points."""
    text = F.col(column).cast("string")
    long = literals.select(text.alias("literal")).where(utf16_length(F.col("literal")) >= MIN_SECRET_LENGTH)
    return long.distinct().withColumn("size", F.char_length("literal"))


def redact_by_table(df: DataFrame, column: str, literals: DataFrame, literal: str = "literal") -> DataFrame:
    """``df`` with every literal in ``column`` replaced, as ``functions.text.redact`` does it for a list.

    Leftmost matches win, then the longest; literals that are null or too short don't count, null texts stay null, all
    other columns and repeated rows stay as they are. The driver holds the filter and the distinct lengths of literals,
    neither of which grows with the texts. Where a literal stands is found out once per distinct text.
    """
    spark = df.sparkSession
    known = known_literals(literals, literal)
    bit = known.select("literal").mapInArrow(_literal_bits, "bit bigint")
    words = bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("set")
    )
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        table[r["word"]] = r["set"]
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    shared = spark.sparkContext.broadcast((table, sizes))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = shared.value

        def let_through(hashes: np.ndarray) -> np.ndarray:
            bits = _bits(hashes)
            return (table[bits >> 6] >> (bits & 63)) & 1 != 0

        for batch in batches:
            keys, places, found = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rolling = Rolling(text)
                for seed in {min(SEED, s) for s in sizes}:
                    at = np.arange(max(0, rolling.n - seed + 1))
                    at = at[let_through(rolling.at(at, seed))]
                    for size in sizes:
                        if min(SEED, size) == seed:
                            inside = at[at + size <= rolling.n]
                            for place in inside[let_through(rolling.at(inside, size))].tolist():
                                keys.append(key)
                                places.append(place)
                                found.append(text[place : place + size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.string())], ["key", "place", "literal"]
            )

    text = F.col(f"`{column}`")
    texts = df.where(text.isNotNull()).select(F.sha2(text.cast("string"), 256).alias("key"), text.cast("string").alias("text"))
    seen = texts.mapInArrow(candidates, "key string, place bigint, literal string").distinct()
    sure = seen.join(known, "literal").groupBy("key").agg(F.collect_list(F.struct("place", "size")).alias("__spans"))
    marked = df.withColumn("__key", F.sha2(text.cast("string"), 256)).join(sure.withColumnRenamed("key", "__key"), "__key", "left")
    at = df.columns.index(column)
    fields = [StructField(column, StringType()) if i == at else f for i, f in enumerate(df.schema.fields)]

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, made = batch.column(batch.num_columns - 1).to_pylist(), []
            for text, found in zip(batch.column(at).to_pylist(), spans, strict=True):
                made.append(_resolved(text, [(s["place"], s["size"]) for s in found]) if found else text)
            columns = [pa.array(made, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    whole = [text.cast("string").alias(column) if i == at else F.col(f"`{c}`") for i, c in enumerate(df.columns)]
    return marked.select(*whole, "__spans").mapInArrow(replaced, StructType(fields))
