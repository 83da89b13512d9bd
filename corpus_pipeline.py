"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps of docs."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from snapfold.llm.common import prepare  # noqa: E402
from snapfold.llm.decontaminate import decontaminate  # noqa: E402
from snapfold.llm.lines import RARE, line_dedup  # noqa: E402
from snapfold.llm.mixing import mixed  # noqa: E402
from snapfold.llm.simhash import simhash_dedup  # noqa: E402
from snapfold.llm.toxicity import score, train  # noqa: E402
from snapfold.session import scratch_dir  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    docs = docs.select(*COLUMNS)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("score < 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier document has in an aligned block; n_chars follows the text."""
    return line_dedup(docs.select(*COLUMNS), all_pairs=True, rare=RARE).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash_dedup(docs.select(*COLUMNS), shingle=3, max_bits=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered in copy."""
    return mixed(docs.select(*COLUMNS))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("simhash", simhash), ("decontamination", benchmark), ("mixing", mixing)]

# Trained dictionaries, alignments and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
