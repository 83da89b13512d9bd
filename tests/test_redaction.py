"""Redaction by a table of literals, against the pattern and at a size that no pattern takes."""

import random

import numpy as np
from pyspark.sql import functions as F

from snapfold.functions.text import redact
from snapfold.operators import redaction
from snapfold.operators.redaction import Rolling, redact_by_table


def test_equals_the_pattern_on_200_literals(spark):
    rnd = random.Random(1)

    def text(n):
        return "".join(rnd.choice("ab\U0001f600é\n.\\") for _ in range(n))

    literals = [text(rnd.randrange(3, 14)) for _ in range(200)] + ["aaaaaaaa", "aaaaaaaaaa", "\U0001f600" * 4, "\U0001f600" * 3]
    texts = [text(rnd.randrange(0, 200)) for _ in range(120)]
    for _ in range(200):
        old = rnd.choice(texts)
        at = rnd.randrange(len(old) + 1)
        texts.append(old[:at] + "".join(rnd.choice(literals) for _ in range(rnd.randrange(1, 4))) + old[at:])
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[0], texts[0], "", None])], "id int, text string, literal int")
    table = spark.createDataFrame([(x, 0) for x in [*literals, None, literals[0]]], "literal string, size int")
    got = redact_by_table(rows, "text", table)
    assert got.columns == rows.columns
    want = {r.id: r.text for r in rows.withColumn("text", redact(F.col("text"), literals)).collect()}
    assert {r.id: r.text for r in got.collect()} == want
    assert sum("[redacted]" in (t or "") for t in want.values()) > 150


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(redaction, "FILTER_BITS", 64)
    rows = spark.createDataFrame([("my secret-0000001 and secret-00000012",), ("none",)], "text string")
    table = spark.range(500).select(F.format_string("secret-%07d", "id").alias("literal"))
    assert [r.text for r in redact_by_table(rows, "text", table).collect()] == ["my [redacted] and [redacted]2", "none"]


def test_a_million_literals(spark):
    table = spark.range(1_000_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("literal"))
    rows = spark.range(2000).select("id", F.concat(F.lit("key="), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    got = redact_by_table(rows, "text", table)
    assert got.where("text LIKE 'key=[redacted]%'").count() == 2000


def test_no_literals_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a secret text"), (1, "a secret text"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "literal string")
    assert sorted(redact_by_table(rows, "text", none).collect(), key=str) == sorted(rows.collect(), key=str)
    some = spark.createDataFrame([("a secret",), ("short",)], "literal string")
    assert [r.text for r in redact_by_table(rows, "text", some).orderBy("id").collect()] == ["[redacted] text"] * 2 + [None]
    assert redact_by_table(rows.limit(0), "text", some).collect() == []


def test_rolling_hashes_are_those_of_the_stretches():
    text = "abracadabra\U0001f600abra"
    whole = Rolling(text)
    for size in (1, 4, 7):
        places = np.arange(len(text) - size + 1)
        assert whole.at(places, size).tolist() == [Rolling(text[i : i + size]).at(np.zeros(1, int), size)[0] for i in places]
