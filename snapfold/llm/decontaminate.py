"""Benchmark decontamination by spaced seeds.

Fixed masks over a run of words hash only some of them, so a substituted word under a gap does no harm. Hashes of the
benchmark meet those of every position of every document; around each hit both sides are compared word by word along
the same diagonal, and an overlap counts where at least four of five words are the same.

Hits are compared in bulk: an overlap of 34 words or more has a half that is one when cut to its first and last equal
word, so every overlap has one of 13 to 33 words in it. All hits are first held against such stretches at once; only
diagonals that have one are looked at one by one, the most promising ones of a document and an item first.

The benchmark is a stated query set: its word hashes are dealt into blocks of a bounded size, and each block is one
pass over the documents, which are neither shuffled nor collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import Words, cut, prepare, whole

#: Places of a mask that count are 1; each mask has six. Together they hit every stretch of 13 words with 2 substituted,
#: of 15 with 3 and of 20 with 4, whichever these are, and those of 12 with 2.
MASKS = ("111111", "101101011", "11101001001", "1010101011", "10110011001")
#: Masks for items of fewer words, by their words: any words that may be substituted leave a place where one of these fits.
SHORT = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("1111",),
    9: ("1111",),
    10: ("1111", "11101"),
    11: ("11101",),
}
#: Words that an overlap must have, and the share of them that must be the same; of an item of no more words all count,
#: from its first to its last, whether these are the same or not.
MIN_WORDS, MIN_SAME = 13, 0.8
#: An item of fewer words is no evidence and matches nothing, unless a caller says otherwise.
LEAST = 5
#: Words of benchmark that a pass holds (in the mean); hits and words that are compared at once.
BLOCK_WORDS, HITS, COMPARED = 1_000_000, 1 << 19, 1 << 21
TABLE_BITS = 22
#: Any overlap holds one of no more words.
LONGEST = 33
#: Width in words of the buckets in which a diagonal's hits are held against dense stretches together.
BUCKET_BITS = 6

_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask, at every position where it fits."""
    n = max(0, len(words) - len(mask) + 1)
    made = np.zeros(n, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            made += words[i : i + n] * _WEIGHTS[i]
    return made


def longest(same: np.ndarray, begin: int, end: int) -> tuple[int, int]:
    """The longest overlap of a diagonal that holds begin to end, which are ends of equal words."""
    worth = np.where(same, 1 - MIN_SAME, -MIN_SAME)  # an overlap's sum is 0 or more
    behind = np.concatenate([[0.0], np.where(same[:begin], np.cumsum(worth[:begin][::-1])[::-1], -np.inf)[::-1]])
    ahead = np.concatenate([[0.0], np.where(same[end:], np.cumsum(worth[end:]), -np.inf)]) + worth[begin:end].sum()
    reach = np.maximum.accumulate(behind[::-1])  # the best sum from so far left on, farthest first
    first = np.minimum(np.searchsorted(reach, -ahead - 1e-9, "left"), len(reach) - 1)
    lengths = begin - first + np.arange(len(ahead))
    y = int(np.argmax(np.where(reach[first] >= -ahead - 1e-9, lengths, -1)))
    return int(first[y]), end + y


def diagonal(doc: np.ndarray, item: np.ndarray, shift: int, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin in doc, end in doc, same words) of the longest overlap around each of the hits on a diagonal.

    An overlap that holds a word of a run of equal ones holds the run, so hits between the same runs are one.
    """
    low, high = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[low:high] == item[low - shift : high - shift]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    first = edges[::2][np.searchsorted(edges[::2], begins - low, "right") - 1]
    last = edges[1::2][np.searchsorted(edges[1::2], ends - low, "left")]
    for a, b in np.unique(np.stack([first, last], 1), axis=0).tolist():
        a, b = longest(same, a, b)
        yield low + a, low + b, int(same[a:b].sum())


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Cut rows into slices whose sizes sum up to about ``most``; a larger row is a slice of its own."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(low, high)
        low = high


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... up to sizes[0] of them, then those of begins[1], and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Index:
    """Items of a block, (item, word hashes), and the hashes of their words under each mask."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int = LEAST):
        items = [x for x in items if len(x[1]) >= max(least, 1)]
        self.ids = np.array([x[0] for x in items], np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *(x[1] for x in items)])
        self.sizes = np.array([len(x[1]) for x in items], np.int64)
        #: Where each item begins among all words, and one more.
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.masks: list[tuple] = []
        fitting = [SHORT.get(n, MASKS) for n in self.sizes.tolist()]
        for mask in dict.fromkeys(m for masks in dict.fromkeys(fitting) for m in masks):
            fits = np.array([mask in x for x in fitting])
            key = seeds(self.words, mask)
            item = np.searchsorted(self.first, np.arange(len(key)), "right") - 1
            where = np.flatnonzero(fits[item] & (np.arange(len(key)) + len(mask) <= self.first[item + 1]))
            if len(where):
                where = where[np.argsort(key[where], kind="stable")]
                table = np.zeros(1 << TABLE_BITS, bool)
                table[self.place(key[where])] = True
                self.masks.append((mask, key[where], where, table))

    @staticmethod
    def place(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, same words): the best overlap of each text with each item."""
        best: dict[tuple[int, int], tuple] = {}
        for mask, keys, where, table in self.masks:
            made = seeds(words.hashes, mask)
            at = np.flatnonzero(table[self.place(made)])
            text = np.searchsorted(words.first, at, "right") - 1
            at = at[at + len(mask) <= words.first[text + 1]]
            low, high = np.searchsorted(keys, made[at], "left"), np.searchsorted(keys, made[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            for part in slices(n, HITS):
                self._compare(words, mask, np.repeat(at[part], n[part]), where[spread(low[part], n[part])], best)
        for (text, item), (same, a, b) in best.items():
            yield text, int(self.ids[item]), -a, -b, same

    def _compare(self, words: Words, mask: str, begin: np.ndarray, where: np.ndarray, best: dict) -> None:
        """Take the overlaps around hits (word of the batch, word of the block) into ``best``."""
        text = np.searchsorted(words.first, begin, "right") - 1
        item = np.searchsorted(self.first, where, "right") - 1
        shift = begin - where
        low = np.maximum(words.first[text], self.first[item] + shift)  # with the shift this names the diagonal
        high = np.minimum(words.first[text + 1], self.first[item + 1] + shift)
        short = self.sizes[item] <= MIN_WORDS
        held = high - low >= np.where(short, self.sizes[item], MIN_WORDS)
        gaps = [i for i, bit in enumerate(mask) if bit == "0"]
        # of a run of equal words the first hit of the mask without gaps stands for all
        again = ~short & (begin > low) if not gaps else ~short
        for i in gaps or [-1]:
            again[again] = words.hashes[begin[again] + i] == self.words[where[again] + i]
        rows = np.stack([text, item, shift, low, high, begin])
        self._whole(words, rows[:, held & short], best)
        rows = rows[:, held & ~again & ~short]
        rows = rows[:, np.lexsort((rows[5] >> BUCKET_BITS, rows[3], rows[2]))]
        named = np.stack([rows[2], rows[3], rows[5] >> BUCKET_BITS])
        new = np.concatenate([[True], np.any(named[:, 1:] != named[:, :-1], axis=0)])[: rows.shape[1]]
        group = np.cumsum(new) - 1
        rows = rows[:, self._dense(words, rows[:, new], len(mask))[group]]
        self._longest(words, rows, len(mask), best)

    def _same(self, words: Words, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether the words are the same, for all places from low to high of each row."""
        at = spread(low, high - low)
        return words.hashes[at] == self.words[at - np.repeat(shift, high - low)]

    def _whole(self, words: Words, rows: np.ndarray, best: dict) -> None:
        """Items that count from their first to their last word."""
        rows = np.unique(rows[:5], axis=1)
        for part in slices(rows[4] - rows[3], COMPARED):
            text, item, shift, low, high = rows[:, part]
            ends = np.cumsum(high - low)
            total = np.concatenate([[0], np.cumsum(self._same(words, low, high, shift))])
            same = total[ends] - total[ends - (high - low)]
            good = np.flatnonzero(same >= MIN_SAME * (high - low) - 1e-9)
            good = good[np.lexsort((low[good], -same[good], item[good], text[good]))]
            one = np.concatenate([[True], (np.diff(text[good]) != 0) | (np.diff(item[good]) != 0)])[: len(good)]
            for t, i, a, b, n in np.stack([text, item, low, high, same])[:, good[one]].T.tolist():
                a, b = a - int(words.first[t]), b - int(words.first[t])
                best[t, i] = max(best.get((t, i), (-1,)), (n, -a, -b))

    def _dense(self, words: Words, rows: np.ndarray, size: int) -> np.ndarray:
        """Which buckets of hits lie by an overlap of up to LONGEST words."""
        found = np.zeros(rows.shape[1], bool)
        begin = rows[5] >> BUCKET_BITS << BUCKET_BITS
        around = LONGEST + MIN_WORDS  # a run's first hit may lie before the overlap
        low, high = np.maximum(rows[3], begin - around), np.minimum(rows[4], begin + (1 << BUCKET_BITS) + size + around)
        for part in slices(high - low, COMPARED):
            sizes = (high - low)[part]
            same = self._same(words, low[part], high[part], rows[2, part])
            total = np.concatenate([[0], np.cumsum(same)])
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
            at, good = np.flatnonzero(same), np.zeros(len(same), bool)
            for n in range(MIN_WORDS, LONGEST + 1):
                at = at[left[at] >= n]
                good[at] |= same[at + n - 1] & (total[at + n] - total[at] >= MIN_SAME * n - 1e-9)
            found[part] = np.add.reduceat(good, np.cumsum(sizes) - sizes) > 0
        return found

    def _longest(self, words: Words, rows: np.ndarray, size: int, best: dict) -> None:
        """The longest overlaps around hits on promising diagonals.

        No overlap has more equal words than its diagonal, so the diagonals of a text and an item are taken by these,
        until none of the rest can be better.
        """
        if not rows.shape[1]:
            return
        begins = np.concatenate([[0], np.flatnonzero(np.any(rows[2:4, 1:] != rows[2:4, :-1], axis=0)) + 1])
        ends = np.append(begins[1:], rows.shape[1])
        text, item, shift, low, high, _ = rows[:, begins]
        bound, start = np.empty(len(begins), np.int64), np.empty(len(begins), np.int64)
        for part in slices(high - low, COMPARED):
            same = self._same(words, low[part], high[part], shift[part])
            edge = np.cumsum(high[part] - low[part]) - (high[part] - low[part])
            bound[part] = np.add.reduceat(same.astype(np.int64), edge)
            start[part] = np.flatnonzero(same)[np.searchsorted(np.flatnonzero(same), edge)] - edge + low[part]
        start -= words.first[text]
        done = None
        for d in np.lexsort((start, -bound, item, text)).tolist():
            pair = int(text[d]), int(item[d])
            if pair == done:
                continue
            same, a, _ = best.get(pair, (-1, 0, 0))
            if (int(bound[d]), -int(start[d])) < (same, a):
                done = pair
                continue
            t, i = pair
            offset = int(words.first[t])
            own = self.words[self.first[i] : self.first[i + 1]]
            hits = rows[5, begins[d] : ends[d]] - offset
            for a, b, same in diagonal(words.of(t), own, int(shift[d] + self.first[i]) - offset, hits, hits + size):
                if b - a >= MIN_WORDS and same >= MIN_SAME * (b - a) - 1e-9:
                    best[pair] = max(best.get(pair, (-1,)), (same, -a, -b))


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """(item_id, n_words, words) of all distinct items, the hashes as bytes; item_id is the smallest of equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1), plain=False)
            size = np.diff(words.first)
            kept = np.flatnonzero(size >= max(least, 1))
            made = pa.array([words.of(i).tobytes() for i in kept.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(size[kept], pa.int64()), made], ["item_id", "n_words", "words"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint"), whole().alias("text"))
    distinct = rows.groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    return distinct.mapInArrow(run, "item_id bigint, n_words bigint, words binary")


def _blocks(benchmark: DataFrame, least: int):
    """Blocks of items, broadcast, that together hold the whole benchmark."""
    spark = benchmark.sparkSession
    items = cut(_items(benchmark, least))
    total = items.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_WORDS)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "words").collect()
        yield spark.sparkContext.broadcast({"items": [(r["item_id"], bytes(r["words"])) for r in own]})


def _index(block: dict, least: int) -> Index:
    """The index of a block; a worker builds it once and keeps it beside the block for its next tasks."""
    if "index" not in block:
        block["index"] = Index([(i, np.frombuffer(x, np.uint64)) for i, x in block["items"]], least)
    return block["index"]


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, same_words): the best overlap of each document with each item.

    Words are runs of ASCII letters, digits and other than ASCII, A-Z as a-z. Items are compared whole, however long.
    Items with equal texts count as the one with the smallest id; rows of ``docs`` with equal ids as one document. Null
    texts are empty and match nothing, nor do items without an id or with fewer than ``least`` words (those of up to four
    have to be found word for word); documents without an id are reported with a null id. Empty tables give no rows;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), whole().alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, same_words bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, least):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block.value, least)
            for batch in batches:
                hits = list(index.find(Words(batch.column(1), plain=False)))
                if hits:
                    text, item, start, end, same = (pa.array(x, pa.int64()) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(text), item, start, end, same], [x.split()[0] for x in schema.split(", ")])

        found = found.unionByName(rows.mapInArrow(run, schema))
    best = F.max_by(F.struct("start_word", "end_word", "same_words"), F.struct("same_words", -F.col("start_word"), -F.col("end_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, with all columns, that no item of the benchmark overlaps; null texts stay.

    What a block leaves is written before the next one, so that a task holds one block's index.
    """
    prepare(docs.sparkSession)
    for b, block in enumerate(_blocks(benchmark, least)):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block.value, least)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in index.find(Words(texts, plain=False))]] = False
                yield batch.filter(pa.array(clean))

        docs = (cut(docs) if b else docs).mapInArrow(run, docs.schema)
    return docs
