"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and 3, the one that stays closest (in entropy) to one copy of everything while the
expected words of each source are its target: rate = 3 / (1 + 2 exp(-l x)), with x the document's size over the mean
of its source and l the source's multiplier in the convex dual. A constraint touches only its own source's documents, so
the dual's Hessian is diagonal: Newton's steps run for all sources at once, each over the distinct sizes of its source.
Rates are rounded to copies so that what one document is given too much, the next ones are given less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapfold.llm.common import WORD, cut, prepare, whole

MOST = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Documents that are rounded together, about.
CHUNK = 4096
STEPS = 200


def source_key(source: str = "source") -> Column:
    """Sorts by code point, null last."""
    return F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(F.col(source).cast("string"), F.lit("")))


def size_of(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(key, source_size, rows, target): all words shared by weight, none above MOST times its source's words.

    The rows are one per source. Sources are capped in order of words per weight; what they can't take raises the level of
    the others, so a source is capped where the level before it is above what it can take.
    """
    each = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    n = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(everything).cast("double"), F.sum("weight").over(everything)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumns({"total": total, "heavy": heavy})
    each = each.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("total") - capped) / (F.col("heavy") - used))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.col("heavy") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest / F.when(free > 0, free))
    return each.select("key", "source_size", "rows", target.alias("target"))


def multiplier(sizes: np.ndarray, counts: np.ndarray, target: float) -> float:
    """Newton's method on the dual of one source, kept inside a shrinking bracket."""
    total = float((sizes * counts).sum())
    if target >= MOST * total:
        return np.inf
    if target <= 0:
        return -np.inf
    x = sizes / (total / counts.sum())
    words, odds = sizes * counts, MOST - 1
    low, high, now = -1.0, 1.0, 0.0

    def off(value: float) -> tuple[float, float]:
        share = 1 / (1 + odds * np.exp(np.clip(-value * x, -700, 700)))
        return float((words * MOST * share).sum() - target), float((words * MOST * x * share * (1 - share)).sum())

    while off(low)[0] > 0 and low > -1e12:
        low *= 2
    while off(high)[0] < 0 and high < 1e12:
        high *= 2
    for _ in range(STEPS):
        gap, slope = off(now)
        if abs(gap) < 1e-3:
            break
        low, high = (low, now) if gap > 0 else (now, high)
        step = now - gap / slope if slope > 0 else np.inf
        now = step if low < step < high else (low + high) / 2
    return now


def copies(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Whole numbers beside the rates; words given too few or too many carry over. Large documents come first."""
    made, owed = np.floor(rates).astype(np.int64), 0.0
    for i, (size, part) in enumerate(zip(sizes.tolist(), (rates - made).tolist(), strict=True)):
        owed += size * part
        if part > 0 and 2 * owed >= size:
            made[i] += 1
            owed -= size
    return made


def _decisions(docs: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, size, copies) of every row, and the targets."""
    prepare(docs.sparkSession)
    sizes = cut(docs.select(F.col("doc_id").cast("bigint"), source_key().alias("key"), size_of().alias("size")))
    goals = cut(targets(sizes, weights))
    counted = sizes.groupBy("key", "size").count().join(goals.select("key", "target"), "key")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        size, n = rows["size"].to_numpy(float), rows["count"].to_numpy(float)
        order = np.argsort(size)
        value = multiplier(size[order], n[order], float(rows["target"].iloc[0] or 0.0))
        mean = (size * n).sum() / n.sum()
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "value": [value], "mean": [mean]})

    solved = counted.groupBy("key").applyInPandas(solve, "key string, value double, mean double")
    n = sizes.count()
    salts = max(1, -(-n // CHUNK))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)))
    here = salted.select("key", "salt").distinct().join(solved.join(goals.select("key", "rows"), "key"), "key")
    joined = salted.join(here, ["key", "salt"])
    chunk = F.pmod("salt", F.greatest(F.lit(1), F.ceil(F.col("rows") / CHUNK)))
    joined = joined.select("doc_id", "key", "size", "value", "mean", chunk.alias("chunk"), F.xxhash64("doc_id").alias("order"))

    def give(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        size, value = rows["size"].to_numpy(float), rows["value"].iloc[0]
        if np.isinf(value):
            rates = np.full(len(rows), float(MOST) if value > 0 else 0.0)
        else:
            x = size / max(rows["mean"].iloc[0], 1e-12)
            rates = MOST / (1 + (MOST - 1) * np.exp(np.clip(-value * x, -700, 700)))
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "key": rows["key"], "size": rows["size"], "copies": copies(size, rates)})

    made = joined.groupBy("key", "chunk").applyInPandas(give, "doc_id bigint, key string, size bigint, copies bigint")
    return made, goals


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, text, source).

    size counts the words of the whole text, none in a null text; taken is copies times size. Sources take the weights in
    order of code points, null last. Rounding follows a hash of the doc_id, so reruns agree, and of rows with equal ids
    and sizes it doesn't matter which is which. A source without words has target 0 and its documents no copies; no rows
    give no rows. Other columns are not read.
    """
    made, goals = _decisions(docs, weights)
    salts = 64  # the few rows of the sources are repeated so that a large source's documents spread
    spread = goals.select("key", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = made.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread, ["key", "salt"])
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its number in ``copy`` (from 1)."""
    made, _ = _decisions(docs, weights)
    keys = ["__id", "__key", "__size", "__n"]
    taken = made.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("size").alias("__size"), "copies")

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys[:3]).orderBy(F.lit(0))))

    others = [c for c in docs.columns if c != "copy"]
    rows = docs.select(*others, F.col("doc_id").cast("bigint").alias("__id"), source_key().alias("__key"), size_of().alias("__size"))
    a, b = numbered(rows).alias("a"), numbered(taken).where("copies > 0").alias("b")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, same).select(*(F.col(f"a.`{c}`").alias(c) for c in others), "b.copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")
