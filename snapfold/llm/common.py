"""What the operators of this package share: session settings, checkpoints, Arrow texts, token hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.session import scratch_dir

#: Rows that a Python worker holds at once; with texts of 100 KB a batch stays under 30 MB.
BATCH_ROWS = 256
#: Bytes of text whose tokens are hashed at once.
CHUNK_BYTES = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"
#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column one after another, and where each begins (one more: the end)."""
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column) or at is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BY_BYTE, _BY_PLACE = _odd(256, 11), _odd(1 << 12, 23)


class Words:
    """Words of a batch of texts: byte spans, hashes and where each text's words begin.

    plain=True takes runs of anything but ASCII white space, case and all; otherwise words are runs of ASCII
    letters, digits and bytes beyond ASCII, and A-Z count as a-z.
    """

    def __init__(self, column: pa.Array, plain: bool):
        data, self.texts = utf8(column)
        codes = np.arange(256)
        if plain:
            inside = ~np.isin(codes, np.frombuffer(WHITE, np.uint8))
            value = _BY_BYTE.copy()
        else:
            lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
            inside = (codes >= 128) | ((lower >= 97) & (lower <= 122)) | ((codes >= 48) & (codes <= 57))
            value = _BY_BYTE[lower]
        value[~inside] = 0
        held = inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.texts] = True
        before = np.concatenate([[False], held[:-1]]) if len(held) else held
        after = np.concatenate([held[1:], [False]]) if len(held) else held
        self.starts = np.flatnonzero(held & (~before | edge[:-1]))
        self.ends = np.flatnonzero(held & (~after | edge[1:])) + 1
        #: Index of the first word of each text, and one more.
        self.first = np.searchsorted(self.starts, self.texts)
        self.hashes = np.empty(len(self.starts), np.uint64)
        low = 0
        while low < len(self.starts):
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + CHUNK_BYTES, "right")))
            a, b = self.starts[low], self.ends[high - 1]
            begin = self.starts[low:high] - a
            place = np.arange(b - a) - np.repeat(begin, np.diff(np.append(begin, b - a)))
            part = value[data[a:b]] * (_BY_PLACE[place & 4095] + (place >> 12).astype(np.uint64))
            self.hashes[low:high] = _mixed(np.add.reduceat(part, begin))
            low = high

    def of(self, i: int) -> np.ndarray:
        """Hashes of the words of text i."""
        return self.hashes[self.first[i] : self.first[i + 1]]


_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; fewer words give none."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _STEP)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers, dtype=np.uint64)])
    n = len(words) - size + 1
    undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BACK)]), dtype=np.uint64)
    return _mixed((sums[size:] - sums[:-size]) * undo)


def sorted_groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups of rows that come sorted by integer columns: (rows, begins of groups, ends of groups).

    A group that goes over a batch's end is held until it is complete.
    """

    def keys(rows) -> list[np.ndarray]:
        return [rows.column(x).to_numpy() if isinstance(rows, pa.Table) else rows.column(x).to_numpy(zero_copy_only=False) for x in by]

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and all(k[0] == k[-1] == r[-1] for k, r in zip(keys(batch), keys(rest[-1]), strict=True)):
            rest.append(batch)
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        changed = np.zeros(table.num_rows - 1, bool)
        for k in keys(table):
            changed |= k[1:] != k[:-1]
        begins = np.concatenate([[0], np.flatnonzero(changed) + 1])
        last = int(begins[-1])
        if last:
            yield table.slice(0, last), begins[:-1], begins[1:]
        rest = table.slice(last).to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, np.array([0]), np.array([table.num_rows])
