"""Golden values of the feed decoder, on documents of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapfold.functions.zones import zones
from snapfold.operators.decode import decode, normalised
from snapfold.operators.reconcile import FEED_EMPTY, FETCH_FAILED, PARSE_FAILED, gate
from snapfold.sources.snapshots import admit, polls

FEEDS = "feed_id string, default_duration_minutes int, display_tz string"
DOCS = (
    "feed_id string, snapshot_seq bigint, snapshot_ts timestamp, part int, parts int, "
    "length bigint, content binary"
)


def utc(*fields):
    return dt.datetime(*fields)


def event(*lines):
    return "\r\n".join(["BEGIN:VEVENT", *lines, "END:VEVENT"]) + "\r\n"


def calendar(*events):
    return "BEGIN:VCALENDAR\r\nVERSION:2.0\r\n" + "".join(events) + "END:VCALENDAR\r\n"


def docs_of(spark, *docs):
    rows = []
    for feed, text in docs:
        raw = text if isinstance(text, bytes) else text.encode()
        rows.append((feed, 1, utc(2026, 7, 1), 0, 1, len(raw), raw))
    return spark.createDataFrame(rows, DOCS)


def parse(spark, text, minutes=30, zone="Europe/Oslo"):
    feeds = spark.createDataFrame([("f", minutes, zone)], FEEDS)
    rows = normalised(decode(docs_of(spark, ("f", text)), feeds, zones(spark))).orderBy("feed_ord")
    return rows.collect()


# (name, lines of one event, expected values)
DATED = [
    (
        "utc pair",
        ["DTSTART:20260730T210000Z", "DTEND:20260730T214500Z"],
        (utc(2026, 7, 30, 21), utc(2026, 7, 30, 21, 45), False),
    ),
    (
        "default end",
        ["DTSTART:20260731T020000Z"],
        (utc(2026, 7, 31, 2), utc(2026, 7, 31, 2, 30), False),
    ),
    (
        "all day",
        ["DTSTART;VALUE=DATE:20260802", "DTEND;VALUE=DATE:20260803"],
        (utc(2026, 8, 2), utc(2026, 8, 3), True),
    ),
    ("all day without end", ["DTSTART:20260815"], (utc(2026, 8, 15), utc(2026, 8, 16), True)),
    (
        "before spring change",
        ["DTSTART;TZID=Europe/Oslo:20260329T010000", "DTEND;TZID=Europe/Oslo:20260329T014500"],
        (utc(2026, 3, 29, 0), utc(2026, 3, 29, 0, 45), False),
    ),
    (
        "after spring change",
        ["DTSTART;TZID=Europe/Oslo:20260329T040000"],
        (utc(2026, 3, 29, 2), utc(2026, 3, 29, 2, 30), False),
    ),
    (
        "after autumn change, with duration",
        ["DTSTART;TZID=Europe/Oslo:20261025T120000", "DURATION:PT50M"],
        (utc(2026, 10, 25, 11), utc(2026, 10, 25, 11, 50), False),
    ),
    (
        "summer",
        ["DTSTART;TZID=Europe/Oslo:20260901T203000"],
        (utc(2026, 9, 1, 18, 30), utc(2026, 9, 1, 19), False),
    ),
    (
        "floating time",
        ["DTSTART:20260701T120000"],
        (utc(2026, 7, 1, 10), utc(2026, 7, 1, 10, 30), False),
    ),
    (
        "unknown zone",
        ["DTSTART;TZID=Mars/Olympus:20260701T120000"],
        (utc(2026, 7, 1, 10), utc(2026, 7, 1, 10, 30), False),
    ),
    (
        "quoted zone in lower case",
        ['DTSTART;TZID="europe/oslo":20260701T120000'],
        (utc(2026, 7, 1, 10), utc(2026, 7, 1, 10, 30), False),
    ),
    (
        "end before start",
        ["DTSTART:20260701T120000Z", "DTEND:20260701T110000Z"],
        (utc(2026, 7, 1, 12), utc(2026, 7, 1, 12, 30), False),
    ),
    (
        "end equal to start",
        ["DTSTART:20260701T120000Z", "DTEND:20260701T120000Z"],
        (utc(2026, 7, 1, 12), utc(2026, 7, 1, 12), False),
    ),
    (
        "gap west of UTC",
        ["DTSTART;TZID=America/New_York:20260308T023000"],
        (utc(2026, 3, 8, 6, 30), utc(2026, 3, 8, 7), False),
    ),
    (
        "overlap east of UTC",
        ["DTSTART;TZID=Europe/Oslo:20261025T023000"],
        (utc(2026, 10, 25, 1, 30), utc(2026, 10, 25, 2), False),
    ),
    ("30 February", ["DTSTART:20260230"], (utc(2026, 3, 2), utc(2026, 3, 3), True)),
    (
        "all fields overflow",
        ["DTSTART:20260230T256161Z"],
        (utc(2026, 3, 3, 2, 2, 1), utc(2026, 3, 3, 2, 32, 1), False),
    ),
    ("month zero", ["DTSTART:20260015"], (utc(2025, 12, 15), utc(2025, 12, 16), True)),
    (
        "negative duration falls back",
        ["DTSTART:20260701T120000Z", "DURATION:-PT5M"],
        (utc(2026, 7, 1, 12), utc(2026, 7, 1, 12, 30), False),
    ),
    (
        "bare duration is zero",
        ["DTSTART:20260701T120000Z", "DURATION:P"],
        (utc(2026, 7, 1, 12), utc(2026, 7, 1, 12), False),
    ),
    (
        "last valid duration",
        ["DTSTART:20260701T120000Z", "DURATION:P1DT1H", "DURATION:soon"],
        (utc(2026, 7, 1, 12), utc(2026, 7, 2, 13), False),
    ),
    (
        "last date line",
        ["DTSTART:20260701T120000Z", "DTSTART;X=\"a:b;c\":20260702T120000Z"],
        (utc(2026, 7, 2, 12), utc(2026, 7, 2, 12, 30), False),
    ),
    (
        "later duplicate parameter",
        ["DTSTART;VALUE=DATE;VALUE=DATE-TIME;TZID=UTC;tzid=Europe/Oslo:20260701T120000"],
        (utc(2026, 7, 1, 10), utc(2026, 7, 1, 10, 30), False),
    ),
]


def test_dates(spark):
    text = calendar(*(event(f"UID:{i}", *lines) for i, (_, lines, _) in enumerate(DATED)))
    rows = {r.uid: (r.start, r.end, r.is_all_day) for r in parse(spark, text)}
    wrong = {
        name: rows.get(str(i)) for i, (name, _, want) in enumerate(DATED) if rows.get(str(i)) != want
    }
    assert not wrong


def test_default_length_of_feed(spark):
    row = parse(spark, calendar(event("UID:a", "DTSTART:20260731T020000Z")), minutes=45)[0]
    assert row.end == utc(2026, 7, 31, 2, 45)


def test_folding_and_escapes(spark):
    start = "DTSTART:20260701T120000Z"
    text = calendar(
        event("UID:1", start, "SUMMARY:One", "\tTwo"),
        event("UID:2", start, "SUMMARY:A\\, b\\; c\\\\d \\x \\N", "DESCRIPTION:first\\nsecond \\\\n"),
        event("UID:3", start, "SUMMARY:tail\\"),
        event("UID:4", start, "SUMMARY:  　padded﻿ "),
        event("UID:5", start, "SUMMARY:", "DESCRIPTION:  ", "URL:"),
        event("uid;x=\"a:b\": 6 ", start.lower().replace("t1", "T1").replace("z", "Z")),
        event("UID:7", start, "SUMMARY:line BEGIN:VEVENT separator"),
    )
    rows = {r.uid: r for r in parse(spark, text)}
    assert rows["1"].summary == "OneTwo"
    assert rows["2"].summary == "A, b; c\\d x"
    assert rows["2"].description == "first\nsecond \\n"
    assert rows["3"].summary == "tail\\"
    assert rows["4"].summary == "padded"
    assert (rows["5"].summary, rows["5"].description, rows["5"].url) == ("", None, None)
    assert rows["6"].summary == "(untitled)"
    assert rows["7"].summary == "line BEGIN:VEVENT separator"


@pytest.mark.parametrize("brk", ["\n", "\r", "\r\n"])
def test_line_breaks(spark, brk):
    text = calendar(event("UID:a", "DTSTART:20260701", "SUMMARY:x", " y")).replace("\r\n", brk)
    assert [(r.uid, r.summary) for r in parse(spark, text)] == [("a", "xy")]


def test_identity_and_blocks(spark):
    start = "DTSTART:20260701T120000Z"
    text = (
        "DTSTART:19700101T020000\r\nBEGIN:VTIMEZONE\r\nDTSTART:bad\r\nEND:VTIMEZONE\r\n"
        + event("SUMMARY:no uid", start)
        + event("UID:no-start")
        + f"BEGIN:VEVENT\r\nUID:lost\r\n{start}\r\n"
        + event("UID:a", start, "SUMMARY:First", "BEGIN:VALARM", "DESCRIPTION:alarm", "END:VALARM")
        + event("UID:b", start)
        + event("UID:a", "DTSTART:20260702T120000Z", "SUMMARY:Second")
        + event("UID:a", "SUMMARY:not counted")
        + "begin;x=1: vevent \r\nUID:c\r\n" + start + "\r\nend:VEVENT\r\nUID:ignored\r\nEND:VEVENT\r\n"
        + event("UID:constructor", start)
        + f"BEGIN:VEVENT\r\nUID:open\r\n{start}\r\n"
    )
    rows = parse(spark, "﻿" + text)
    assert [r.uid for r in rows] == ["a", "b", "c", "constructor"]
    assert rows[0].summary == "Second" and rows[0].description is None
    assert rows[0].start == utc(2026, 7, 2, 12)


def test_digest_ignores_uid_and_sees_content(spark):
    import hashlib

    start = "DTSTART:20260701T120000Z"
    text = calendar(
        event("UID:a", start, "SUMMARY:Same"),
        event("UID:b", start, "SUMMARY:Same"),
        event("UID:c", start, "SUMMARY:Same", "URL:https://x.invalid/e"),
    )
    a, b, c = parse(spark, text)
    material = "Same|||2026-07-01T12:00:00.000Z|2026-07-01T12:30:00.000Z|false"
    assert a.hash == hashlib.sha256(material.encode()).hexdigest()
    assert a.hash == b.hash != c.hash


def test_invalid_utf8(spark):
    raw = calendar(event("UID:a", "DTSTART:20260701", "SUMMARY:x?y")).encode().replace(b"?", b"\xff")
    assert parse(spark, raw)[0].summary == "x�y"


def test_gate(spark):
    ok = event("UID:a", "DTSTART:20260701")
    bad = {
        "word": event("UID:a", "DTSTART:not-a-date"),
        "declared": event("UID:a", 'DTSTART;X="q";value="date":20260701T000000Z'),
        "overwritten": event("UID:a", "DTSTART:bad", "DTSTART:20260701"),
        "no uid": event("DTEND:2026"),
        "open": "BEGIN:VEVENT\r\nDTSTART:bad\r\n",
    }
    fine = {
        "good": calendar(ok),
        "other property": calendar(event("UID:a", "DTSTART:20260701", "EXDATE;VALUE=DATE:20260701T00Z")),
        "outside": calendar(ok) + "DTSTART:bad\r\n",
        "after end": "BEGIN:VEVENT\r\nUID:a\r\nDTSTART:20260701\r\nEND:VEVENT\r\nDTSTART:bad\r\n",
    }
    empty = {"blank": "   \r\n  ", "no events": calendar(), "nothing": ""}
    texts = [*bad.items(), *fine.items(), *empty.items()]
    texts[:0] = [(f"bad with {k}", calendar(ok, v)) for k, v in bad.items()]
    docs = docs_of(spark, *texts).unionByName(docs_of(spark, ("huge", calendar(ok) + "X" * 500)))
    half = docs_of(spark, ("half", calendar(ok))).withColumn("parts", F.lit(2))
    docs = docs.unionByName(half)
    feeds = spark.createDataFrame([("good", 30, "UTC")], FEEDS)
    read = admit(docs, max_bytes=400)
    got = {r.feed_id: r.aborted for r in gate(polls(docs), read, decode(read, feeds, zones(spark))).collect()}
    want = {name: PARSE_FAILED for name in bad}
    want |= {f"bad with {name}": PARSE_FAILED for name in bad}
    want |= {name: None for name in fine} | {name: FEED_EMPTY for name in empty}
    want |= {"huge": FETCH_FAILED, "half": FETCH_FAILED}
    assert got == want


def test_hostile_lines_do_not_overflow_the_stack(spark):
    params = ";X=1" * 20_000
    quotes = ';Q="a"' * 20_000
    text = calendar(
        event("UID:a", f"DTSTART{params};VALUE=DATE:20260701", f"SUMMARY{quotes}:long"),
        event("UID:b", "DTSTART:20260701", "SUMMARY:" + "\\n" * 50_000 + "x"),
    )
    a, b = parse(spark, text)
    assert a.summary == "long" and a.is_all_day
    assert b.summary == "x"


def test_content_lines(spark):
    from snapfold.functions.dates import param
    from snapfold.operators.decode import content_lines

    lines = [
        "UID:a:b",
        'dtstart;TZID="a:b;c";X=1:20260701',
        " NAME :v",
        "no colon",
        ":no name",
        'BROKEN;X="open:v',
        "",
        "X-A;TZID=1;tzid=2:",
    ]
    df = spark.createDataFrame([("\n".join(lines),)], "block string")
    got = content_lines(df).withColumn("tz", param(F.col("params"), "TZID")).orderBy("line_no")
    assert [tuple(r) for r in got.collect()] == [
        (0, "UID", "", "a:b", None),
        (1, "DTSTART", ';TZID="a:b;c";X=1', "20260701", "a:b;c"),
        (2, " NAME ", "", "v", None),
        (7, "X-A", ";TZID=1;tzid=2", "", "2"),
    ]


def test_random_texts_survive_the_round_trip(spark):
    import random

    from snapfold.schemas import EVENTS
    from snapfold.sources.snapshots import ics_parts

    rng = random.Random(11)
    alphabet = "ab ,;:\\\"\n'|=\u00a0\u2028\u00e9\U0001f4fa" + "BEGIN:VEVENT\n"

    def text():
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))).strip("\u00a0\u2028 \n") or "x"

    rows = [
        ("f", 1, f"u{i}", i, text(), text(), text(), utc(2026, 7, 1), utc(2026, 7, 2), i % 2 == 0, None)
        for i in range(500)
    ]
    events = spark.createDataFrame(rows, EVENTS)
    parts = ics_parts(events, per_part=64)
    content = F.col("text").cast("binary")
    docs = parts.select("feed_id", "snapshot_seq", F.col("part"), content.alias("content"))
    feeds = spark.createDataFrame([("f", 30, "UTC")], FEEDS)
    got = normalised(decode(docs, feeds, zones(spark))).orderBy("feed_ord").collect()
    assert parts.count() == 8 and {r.parts for r in parts.collect()} == {8}
    assert [(r.uid, r.summary, r.description, r.url, r.is_all_day) for r in got] == [
        (u, s, d, w, a) for _, _, u, _, s, d, w, _, _, a, _ in rows
    ]


def test_parts_are_cut_by_bytes(spark):
    from snapfold.schemas import EVENTS
    from snapfold.sources.snapshots import ics_parts

    def row(feed, i, size):
        return (feed, 1, f"u{i:03}", i, "x" * size, None, None, utc(2026, 7, 1), utc(2026, 7, 2), False, None)

    rows = [row("f", i, 900) for i in range(100)] + [row("g", i, 5000 if i == 3 else 10) for i in range(0, 20, 2)]
    rows.append(row("g", 3, 9000))
    parts = ics_parts(spark.createDataFrame(rows, EVENTS), per_part=64, part_bytes=4000).collect()
    for feed, n in (("f", 100), ("g", 11)):
        own = sorted((r.part, r.parts, r.text) for r in parts if r.feed_id == feed)
        assert [p for p, _, _ in own] == list(range(len(own))) and {k for _, k, _ in own} == {len(own)}
        uids = [line for _, _, t in own for line in t.split("\r\n") if line.startswith("UID:")]
        assert len(uids) == n and uids == sorted(uids)
    assert max(len(r.text) for r in parts if r.feed_id == "f") < 5200
    # an event that is larger than a part stands alone, so no part is larger than two of them because of its neighbours
    for r in parts:
        if len(r.text) > 5200:
            assert r.text.count("BEGIN:VEVENT") == 1
