"""Chat formatting, mixing, the registered queries and the pipeline."""

import hashlib
import json
import os
import random
import re
import uuid
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from compare import connect, difference
from helpers import awkward, empty
from pyspark.sql import functions as F

from snapfold.llm.chat import BY_FINGERPRINT, LAYOUTS, format_turns, read_loss, read_turns, turns_of_records, turns_of_rows
from snapfold.llm.mixing import copies, mix, mixed, multiplier
from snapfold.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_round_trip_of_hostile_turns(spark):
    rnd = random.Random(2)
    parts = ["<", "|", "\\", "<|im_start|>", "<|im_end|>", "\n", "a", "<\\|", "%0A", "%", "\U0001f600", "user", "assistant"]
    rows = []
    for conv in range(150):
        for turn in range(rnd.randrange(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "".join(rnd.choice(parts) for _ in range(3))])
            rows.append((conv, turn, role, "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))))
    made = format_turns(turns_of_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    back = made.select("conv_id", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    want = defaultdict(list)
    for conv, _, role, text in rows:
        want[conv].append((role, text))
    assert {r.conv_id: [tuple(x) for x in r.t] for r in back} == want
    assert {r.conv_id: r.l for r in back} == {c: [t for role, t in x if role == "assistant"] for c, x in want.items()}


def test_turn_rows_with_nulls(spark):
    rows = [(1, 1, "user", None), (1, None, None, "late"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, loss int")
    got = {r.conv_id: [tuple(x) for x in r.t] for r in format_turns(turns).select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("assistant", "b"), ("assistant", "b"), ("user", ""), ("", "late")], None: [("user", "x")]}
    assert format_turns(turns.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 7}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "from and value", [("user", "a"), ("assistant", "")]),
        ({"prompt": "p", "response": "r"}, "prompt and response", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction, input and output", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction, input and output", [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system, prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": "a", "meta": {"k": [1]}}, "question and answer", [("user", "q"), ("assistant", "a")]),
        ({"unknown": 1}, None, []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, None), (91, "{no json"), (92, "[]")]
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in turns_of_records(spark.createDataFrame(rows, "conv_id bigint, record string")).collect()}
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(records)} | {i: (None, []) for i in (90, 91, 92)}
    assert len(BY_FINGERPRINT) == len(LAYOUTS)


def test_chat_runs_no_python(spark):
    plan = QUERIES["op4_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def fair_targets(sizes, weights=(1, 2, 3)):
    """The excess reshared by weight until none is above, as stated."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return done | {s: weight[s] * level for s in free}
        for s in over:
            done[s] = 3.0 * sizes[s]
            left -= done[s]
        free -= over
    return done


def test_mix(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        source = rnd.choice(["a", "b", "b", "b", "b", "b", "é", "Z", None, "rare" if i % 50 == 0 else "a"])
        rows.append((i, " ".join(["w"] * int(rnd.lognormvariate(4, 1.2))), source, 1.0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double")
    got = mix(docs.repartition(5)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    source_of = {r[0]: r[2] for r in rows}
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    want = fair_targets(sizes)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == 900 and all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in sizes)
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    sent = mixed(docs.repartition(3)).groupBy("doc_id").count().collect()
    per = {r.doc_id: r.copies for r in got if r.copies}
    assert {r.doc_id: r["count"] for r in sent} == per


def test_multiplier_meets_its_target():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.lognormal(5, 1.5, 500).astype(int) + 1, return_counts=True)
    total = (sizes * counts).sum()
    for part in (0.01, 0.3, 1.0, 1.7, 2.9, 2.9999):
        x = sizes / (total / counts.sum())
        value = multiplier(sizes.astype(float), counts.astype(float), part * total)
        rates = 3 / (1 + 2 * np.exp(-value * x))
        assert abs((rates * sizes * counts).sum() - part * total) < 1
    made = copies(np.array([5.0, 3.0, 1.0]), np.array([3.0, 0.0, 1.5]))
    assert made.tolist() == [3, 0, 2]


def test_mix_rows(spark):
    got = mix(awkward(spark)).collect()
    assert len(got) == 10 and all(r.taken <= 3 * r.size for r in got)
    assert {r["size"] for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert mix(empty(spark)).count() == 0 == mixed(empty(spark)).count()
    assert set(mixed(awkward(spark)).columns) == set(awkward(spark).columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    diff, rows = difference(spark, connect(SF), SF, QUERIES[name], SQL[name])
    assert diff is None and rows > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    if name in ("op1_pii", "op3_mixing", "op5_toxicity", "op10_simhash"):
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pii_digest(spark):
    row = QUERIES["op1_pii"](spark, SF).where("n_email > 0").first()
    spans = [s for s in row.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
    assert len(spans) >= row.n_email and (len(row.base_sha256) == 64)
    if len(spans) == row.n_email + row.n_ip + row.n_card + row.n_phone:
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == row.base_sha256


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, SF).write.parquet(f"{folder}/{i}-{uuid.uuid4().hex}")
        docs = spark.read.parquet(next(f"{folder}/{x}" for x in os.listdir(folder) if x.startswith(f"{i}-")))
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.select("doc_id").distinct().count() <= before.select("doc_id").distinct().count()
    assert docs.count() > 0 and corpus_pipeline.run(spark, SF).count() == docs.count()
