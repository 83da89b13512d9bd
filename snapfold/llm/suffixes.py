"""Repeated passages by a sparse suffix array.

Only suffixes at minimisers are kept: the position whose run of SEED words has the smallest hash among the runs that a
passage of MIN_WORDS words holds. Equal passages choose the same position, so sorting the kept suffixes by their seed puts
them next to each other. Around a seed both sides are extended to each of the passages that chose it; these are sorted
within the seed, and equal neighbours are the same passage. All passages but the first are reported, joined to the longest
stretches; a match of more words is made of passages that all match, so nothing of it is missed.

A seed that very many suffixes share is no group of one task: its suffixes are dealt out by document, and their passages
become rows, which are aggregated to the first of each before they are shuffled and then joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.common import Words, cut, prepare, sorted_groups, whole, windows

#: Words of the shortest repeat that is reported, and of a seed.
MIN_WORDS, SEED = 50, 30
#: A seed of more suffixes is dealt out by passages; of such seeds the most frequent ones, so many that their list can be sent
#: to every task (8 bytes each). A seed beyond them has less than this part of all suffixes and stays a group.
HOT_SUFFIXES, HOT_SEEDS = 16_384, 500_000
#: Stands for a doc_id that is missing while documents are ordered.
NO_ID = (1 << 63) - 1


def minimisers(seeds: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` seeds the position of the first smallest one."""
    n = len(seeds) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    place, reach = np.arange(len(seeds)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = place[:-step], place[step:]
        place = np.where(seeds[right] < seeds[left], right, left)
        reach += step
    return place


def suffixes(words: np.ndarray, min_words: int = MIN_WORDS, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(position, first passage, past the last passage) of each kept suffix, with all seeds' and passages' hashes."""
    seeds, passages = windows(words, seed), windows(words, min_words)
    chosen = minimisers(seeds, min_words - seed + 1)
    edges = np.flatnonzero(np.diff(chosen)) + 1 if len(chosen) else np.empty(0, np.int64)
    begins = np.concatenate([[0], edges]).astype(np.int64) if len(chosen) else edges
    ends = np.append(edges, len(chosen)) if len(chosen) else edges
    return chosen[begins], begins, ends, seeds, passages


ROWS = "key bigint, salt bigint, doc bigint, shift int, starts array<int>, passages array<int>"
#: A stretch that is not the first, with the first; or, of a hot seed, a passage: its key, side and value, and where it begins.
FOUND = "doc bigint, start bigint, end bigint, first_doc bigint, first_start bigint, key bigint, side int, value int"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def alike(key: np.ndarray, begins: np.ndarray, ends: np.ndarray, shift: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Number of each suffix's kind: the same seed and passages around it. A text that repeats itself has few kinds."""
    place = np.arange(len(passages)) - np.repeat(begins, ends - begins)
    marks = (passages + place.astype(np.uint64) * _MIX[0]) * _MIX[1]
    marks = np.add.reduceat((marks ^ (marks >> np.uint64(29))) * _MIX[2], begins)
    return np.unique(key * _MIX[0] + marks * _MIX[1] + shift.astype(np.uint64), return_inverse=True)[1].ravel()


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), whole().alias("text"))


def _is_hot(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which seeds are in the sorted list."""
    if not len(hot):
        return np.zeros(len(key), bool)
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key


def _hot_seeds(docs: DataFrame, min_words: int, seed: int, least: int, most: int = HOT_SEEDS) -> np.ndarray:
    """Sorted seeds of more than ``least`` suffixes, the ``most`` most frequent ones; counted within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1), plain=True)
            keys = []
            for i in range(batch.num_rows):
                seeds = windows(words.of(i), seed)
                keys.append(seeds[np.unique(minimisers(seeds, min_words - seed + 1))])
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = _numbered(docs).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > least).orderBy(F.desc("n"), "key").limit(most).toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def _kept(docs: DataFrame, min_words: int, seed: int, hot) -> DataFrame:
    """Kept suffixes; salt is 0 but for the seeds of the list ``hot`` (a broadcast of it), whose suffixes it spreads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, docs_of = Words(batch.column(1), plain=True), batch.column(0).to_numpy(zero_copy_only=False)
            parts: list[list[np.ndarray]] = [[] for _ in range(8)]
            for i in range(batch.num_rows):
                at, begins, ends, seeds, passages = suffixes(words.of(i), min_words, seed)
                if not len(at):
                    continue
                key, shift = seeds[at], at - begins
                kind = alike(key, begins, ends, shift, passages)
                # one row for each kind, with all places where it stands
                order = np.argsort(kind, kind="stable")
                counts = np.bincount(kind)
                kept = order[np.cumsum(counts) - counts]
                n = (ends - begins)[kept]
                taken = np.arange(n.sum()) + np.repeat(begins[kept] - (np.cumsum(n) - n), n)
                salt = np.where(_is_hot(key[kept], hot.value), passages[begins[kept]] ^ (docs_of[i : i + 1].view(np.uint64) * _MIX[0]), np.uint64(0))
                row = (key[kept].view(np.int64), salt.view(np.int64), np.full(len(kept), docs_of[i]), shift[kept], counts, begins[order], n, passages[taken])
                for p, x in zip(parts, row, strict=True):
                    p.append(x)
            if not parts[0]:
                continue
            key, salt, doc, shift, counts, starts, n, passages = (np.concatenate(p) for p in parts)
            # the upper half of a passage's hash; the seed's hash comes on top of it
            values = (passages >> np.uint64(32)).astype(np.uint32).view(np.int32)
            cols = [pa.array(key), pa.array(salt), pa.array(doc), pa.array(shift.astype(np.int32)), _lists(counts, starts), _lists(n, values)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ROWS.split(", ")])

    return _numbered(docs).mapInArrow(run, ROWS)


def _spread(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(row, side, value, doc, start) of every passage around every place of the suffixes."""
    rows = rows.combine_chunks()
    starts, lists = rows.column("starts").chunk(0), rows.column("passages").chunk(0)
    places = pc.list_value_length(starts).to_numpy()
    n, begin = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    # one entry for each place of a suffix, then one for each passage around it
    held = np.repeat(np.arange(len(n)), places)
    shift, doc, n, begin = (x[held] for x in (rows.column("shift").to_numpy(), rows.column("doc").to_numpy(), n, begin))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)  # of the passage among its suffix's
    return held[row], shift[row] - place, lists.flatten().to_numpy()[begin[row] + place], doc[row], starts.flatten().to_numpy()[row] + place


def _batch(doc, start, end=None, first_doc=None, first_start=None, key=None, side=None, value=None) -> pa.RecordBatch:
    cols, names = (doc, start, end, first_doc, first_start, key, side, value), [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2
    made = [pa.nulls(len(doc), k) if c is None else pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, names)


def _repeats(min_words: int, hot):
    """From suffixes sorted by key and salt: rows as in FOUND, passages where the key is in ``hot`` and stretches elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, ends in sorted_groups(batches, "key", "salt"):
            key, sizes = rows.column("key").to_numpy(), ends - begins
            spread = _is_hot(key.view(np.uint64), hot.value)
            if spread.any():
                row, side, value, doc, start = _spread(rows.filter(pa.array(spread)))
                yield _batch(doc, start, key=key[spread][row], side=side, value=value)
            places = pc.list_value_length(rows.column("starts").combine_chunks()).to_numpy()
            many = np.repeat(np.add.reduceat(places, begins) > 1, sizes) & ~spread
            if not many.any():
                continue
            row, s, v, d, a = _spread(rows.filter(pa.array(many)))
            g = np.repeat(np.arange(len(begins)), sizes)[many][row]
            order = np.lexsort((a, d, v, s, g))
            g, s, v, d, a = (x[order] for x in (g, s, v, d, a))
            new = np.ones(len(order), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (v[1:] != v[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = (d != d[first]) | (a != a[first])
            if not again.any():
                continue
            d, a, e, b = d[again], a[again], d[first][again], a[first][again]
            by = np.lexsort((b, a, e, d))
            d, a, e, b = d[by], a[by], e[by], b[by]
            step = np.ones(len(d), bool)
            step[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
            lo = np.flatnonzero(step)
            hi = np.append(lo[1:], len(d)) - 1
            yield _batch(d[lo], a[lo], a[hi].astype(np.int64) + min_words, e[lo], b[lo])

    return run


def _against_first(passages: DataFrame, min_words: int) -> DataFrame:
    """Passages of hot seeds that are not the first of their kind, each a stretch of its own."""
    same = ["key", "side", "value"]
    first = passages.groupBy(*same).agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    # written, so that the join shuffles its two sides by itself and Spark can split a very frequent passage
    first = cut(first.where("n > 1").drop("n"))
    again = passages.select("doc", "start", *same).join(first, same).where("doc <> first.doc or start <> first.start")
    return again.select(
        "doc", "start", (F.col("start") + min_words).alias("end"), F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start")
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, hot_suffixes: int = HOT_SUFFIXES) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_ids): stretches of ``docs`` that also occur earlier, in words of the text.

    Words are runs of anything but ASCII white space, compared as they are. A stretch has ``min_words`` words or more, each
    run of that many of which occurs earlier: in a document with a smaller doc_id or further ahead in the same one;
    first_doc_ids lists, in order, the documents where these runs occur first. Null texts are empty and shorter texts have no
    stretch; rows without a doc_id come last and are one document, as rows with equal ids are. Columns beyond doc_id and text
    are not read, and no rows give no rows. Seeds of more than ``hot_suffixes`` suffixes are dealt out by passages, with the
    same result.
    """
    spark = prepare(docs.sparkSession)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = spark.sparkContext.broadcast(_hot_seeds(docs, min_words, seed, hot_suffixes))
    kept = _kept(docs, min_words, seed, hot).repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
    found = cut(kept.mapInArrow(_repeats(min_words, hot), FOUND))
    stretches = found.where("key is null").select("doc", "start", "end", "first_doc", "first_start")
    found = stretches.unionByName(_against_first(found.where("key is not null"), min_words))
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("doc", "island").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.array_sort(F.collect_set("first_doc")).alias("firsts")
    )

    def named(x):
        return F.when(x != NO_ID, x)

    return joined.select(named(F.col("doc")).alias("doc_id"), "start_word", "end_word", F.transform("firsts", named).alias("first_doc_ids"))


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the stretches of words that ``passages`` lists for their doc_id; words left are space-joined there.

    Rows without a stretch keep their text as it is; other columns come along.
    """
    spans = passages.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("__spans"))
    joined = docs.join(spans, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")), "left")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    kept = F.filter(words, lambda x, i: ~F.exists("__spans", lambda s: (s["start_word"] <= i) & (i < s["end_word"])))
    text = F.when(F.col("__spans").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return joined.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))
