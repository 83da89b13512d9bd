"""Documents read in splits, against whole documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.functions.zones import zones
from snapfold.operators.decode import decode, decode_blocks
from snapfold.plans.run import Store, run
from snapfold.sources.scan import read_blocks
from snapfold.sources.snapshots import read_snapshots
from test_run import NOW, SHOWS, Harness, answer, ics

LINES = [
    b"BEGIN:VEVENT", b"begin;x=1: VEVENT ", b"BEG\r\n IN:VEV\n\tENT", b"END:VEVENT", b"end:vevent", b"EN\n D:VEVENT", b"UID:u1", b"UID:u\r\n 2", b"UID:",
    b"SUMMARY:caf\xc3\xa9 \xff\xfe", b"SUMMARY:spl\r\n it \xc3\r\n \xa9", b"DTSTART:20260801T210000Z", b"DTSTART:2026\n\t0801", b"DTEND:soon", b"", b" ", b"\t x",
    b"DESCRIPTION:a\\nb BEGIN:VEVENT", b"X:" + b"y" * 70, b"DURATION:PT5M",
]


def land(folder, texts):
    for (feed, seq, part, parts), text in texts.items():
        at = f"{folder}/feed_id={feed}/snapshot_seq={seq}"
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/part-{part}-of-{parts}.ics", "wb") as out:
            out.write(text)


def settings(spark, feeds):
    return spark.createDataFrame([(f, 45, "Europe/Oslo") for f in feeds], "feed_id string, default_duration_minutes bigint, display_tz string")


@pytest.mark.parametrize("split", [37, 200])
def test_splits_equal_whole_documents(spark, folder, split):
    rnd = random.Random(split)
    texts = {}
    for i in range(24):
        lines = [rnd.choice(LINES) for _ in range(rnd.randrange(1, 60))]
        text = b"".join(x + rnd.choice([b"\r\n", b"\n", b"\r"]) for x in lines)
        texts["fg"[i % 2], i // 4, i % 4 // 2, 2] = (b"\xef\xbb\xbf" if i % 3 == 0 else b"") + text + b"BEGIN:VEVENT\nUID:last"
    land(folder + "/in", texts)
    feeds = settings(spark, "f")
    want = decode(read_snapshots(spark, folder + "/in"), feeds, zones(spark)).collect()
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        blocks = read_blocks(spark, folder + "/in")
        assert spark.read.text(folder + "/in").rdd.getNumPartitions() > 20
        got = decode_blocks(blocks, feeds, zones(spark)).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 60 and any(r.bad for r in want) and any(r.kept for r in want)


def test_a_run_over_blocks(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    h.land(ics(*SHOWS[:1]), feed="stranger")
    store = Store(folder + "/blocks", buckets=4)
    rows = run(
        spark, store, 0, NOW, read_snapshots(spark, h.landing), h.feeds, h.targets, answer, max_bytes=1, blocks=read_blocks(spark, h.landing)
    ).collect()
    assert [(r.feed_id, r.created, r.errors, r.aborted) for r in rows] == [("f", 3, 0, None)]
    assert schemas.DOCUMENTS.endswith("content binary") and read_blocks(spark, h.landing).agg(F.max("pos")).first()[0] == 3
