"""Periodic runs of words: Lyndon arrays under both orders by Baier's grouping, roots extended to maximal runs.

A run of period q holds words q apart that are equal, and no neighbour goes on with it. The root of a run is the longest
Lyndon word at one of its places, under an order of the words or its reverse. The first phase of Baier's suffix sorter
groups places by that word, so it yields the Lyndon array at once; each root is then extended to both sides by the
length of the common extension, from the names of all stretches of 1, 2, 4, ... words.

Every word of a run stands in a stretch of half the least length that its text repeats, so what is in no such stretch
(found by hashes of whole batches) is cut off first; this loses nothing and leaves little of ordinary text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import Words, prepare, whole, windows

#: Words that a run has at least, besides twice its period.
MIN_WORDS = 12


def lyndon(word: list[int], letters: int) -> np.ndarray:
    """Length of the longest Lyndon word at each place of a word over 0 .. letters - 1; the end counts as smallest.

    Groups hold the places whose Lyndon word is, as far as known, the same, and are listed from the smallest word to the
    largest. The largest group is complete. Each of its places is appended to the nearest place to the left that is in
    a smaller group; places of one group with equally many appended make up a new group right above it. Linear, but for
    sorting a group's new groups.
    """
    n = len(word)
    home = list(word)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, x in enumerate(word):
        members[x].append(i)
    size = [1] * letters
    below, above = list(range(-1, letters - 1)), list(range(1, letters + 1))
    found = [0] * n
    left = list(range(n + 1))  # nearest place, counted from 1, that is in no complete group; 0 is none
    group = letters - 1
    while group >= 0:
        inside = [i for i in members[group] if home[i] == group]
        for i in inside:
            left[i + 1] = i
        copies: dict[int, int] = defaultdict(int)
        for i in inside:
            found[i] = size[group]
            x = i
            while left[x] != x:
                left[x] = left[left[x]]
                x = left[x]
            if x:
                copies[x - 1] += 1
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, k in copies.items():
            parts[k, home[i]].append(i)
        for k, old in sorted(parts, reverse=True):
            new, over = len(members), above[old]
            members.append(parts[k, old])
            size.append(size[old] + k * size[group])
            below.append(old)
            above.append(over)
            above[old] = new
            if over < len(below):
                below[over] = new
            for i in parts[k, old]:
                home[i] = new
        members[group] = []
        group = below[group]
    return np.array(found, np.int64)


class Extensions:
    """How far two places of a word go on alike; exact, by names of its stretches of 1, 2, 4, ... words."""

    def __init__(self, word: np.ndarray):
        self.n, self.names = len(word), [word.astype(np.int32)]
        step = 1
        while 2 * step <= self.n:
            low = self.names[-1]
            pair = low[:-step].astype(np.int64) * (int(low.max()) + 1) + low[step:]
            kinds, named = np.unique(pair, return_inverse=True)
            if len(kinds) == len(pair):
                break
            self.names.append(named.astype(np.int32))
            step *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are equal from a and b on, for a < b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            x, y = a + done, b + done
            inside = y + step <= self.n
            same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])
            done += same * step
        return done

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are equal in front of a and b, for a < b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            x, y = a - done - step, b - done - step
            inside = x >= 0
            same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])
            done += same * step
        return done


def runs_of(words: list, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of least words or more, and twice their period, by start, then period."""
    codes: dict = {}
    word = [codes.setdefault(x, len(codes)) for x in words]
    line = np.array(word, np.int64)
    roots = []
    for order in (word, [len(codes) - 1 - x for x in word]):
        period = lyndon(order, len(codes))
        at = np.arange(len(word))
        inside = at + period < len(word)
        at, period = at[inside], period[inside]
        # a root that goes on neither way is no run
        alike = (line[at] == line[at + period]) | ((at > 0) & (line[at - 1] == line[at + period - 1]))
        roots.append(np.stack([at[alike], period[alike]]))
    at, period = np.concatenate(roots, axis=1)
    if not len(at):
        return []
    extend = Extensions(line)
    start = at - extend.left(at, at + period)
    end = at + period + extend.right(at, at + period)
    kept = end - start >= np.maximum(least, 2 * period)
    made = np.unique(np.stack([start, period, end - start], axis=1)[kept], axis=0)
    return [(s, size, q) for s, q, size in made.tolist()]


def _candidates(found: Words, least: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of stretches that hold all runs of a batch; words are counted over the batch."""
    size = -(-least // 2)
    n = len(found.hashes)
    if n < least:
        return
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    key = windows(found.hashes, size) * np.uint64(0x9E3779B97F4A7C15) + text[: n - size + 1].astype(np.uint64)
    at = np.flatnonzero(text[size - 1 :] == text[: n - size + 1])
    at = at[np.argsort(key[at], kind="stable")]
    again = key[at[1:]] == key[at[:-1]]
    twice = at[np.concatenate([again, [False]]) | np.concatenate([[False], again])]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    held = np.cumsum(edges[:-1]) > 0
    first = np.concatenate([[True], text[1:] != text[:-1]])
    begins = np.flatnonzero(held & (first | ~np.concatenate([[False], held[:-1]])))
    ends = np.flatnonzero(held & np.concatenate([first[1:] | ~held[1:], [True]])) + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a >= least:
            yield int(text[a]), a, b


def find_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; runs: array of (start, length, period) by start, then period.

    Words are runs of anything but ASCII white space, numbered from 0; a run has ``least`` of them or more and twice its
    period, its smallest one. collapsed: the words that no run contains after its first period, joined by one blank.
    A null text is empty; empty and blank texts have no words and no runs. Rows are handled one by one: repeated rows
    and null ids come out as they came in, columns beyond doc_id and text are not read, no rows give none. Time is that
    of sorting a text's words, memory that of one batch and of the names of one repetitive stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Words(batch.column(1), plain=True)
            runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            words: dict[int, list[bytes]] = {}
            for text, a, b in _candidates(found, least):
                if text not in words:
                    words[text] = batch.column(1)[text].as_py().encode().split()
                a, b = a - found.first[text], b - found.first[text]
                runs[text] += [(int(a) + s, size, q) for s, size, q in runs_of(words[text][a:b], least)]
            collapsed = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                kept = words.get(i) or text.encode().split()
                if runs[i]:
                    edges = np.zeros(len(kept) + 1, np.int64)
                    for s, size, q in runs[i]:
                        edges[s + q] += 1
                        edges[s + size] -= 1
                    kept = [kept[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                collapsed.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(found.first).astype(np.int64)),
                    pa.array([[dict(zip(RUN.names, x, strict=True)) for x in runs[i]] for i in range(batch.num_rows)], pa.list_(RUN)),
                    pa.array(collapsed, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    prepare(docs.sparkSession)
    schema = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col("doc_id").cast("bigint"), whole().alias("text")).mapInArrow(run, schema)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
