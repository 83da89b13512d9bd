import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from snapfold.functions import text as T
from snapfold.functions.dates import duration_ms, param
from snapfold.functions.jsons import created_id, error_envelope
from snapfold.functions.status import failure_class
from snapfold.functions.zones import format_wall, parse_iso, resolve_zone, wall_to_instant, zones
from snapfold.operators.batching import body_content
from snapfold.sources.snapshots import escape_text


def each(spark, values, *exprs):
    """Rows of expressions (functions of a column) over the values, in input order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
    columns = [e(F.col("x")) for e in exprs]
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, values, expr):
    return [r[0] for r in each(spark, values, expr)]


def test_trim(spark):
    spaces = "".join(map(chr, T.SPACE_POINTS))
    assert one(spark, [f"{spaces}a b{spaces}", spaces, "​a"], lambda x: T.js_trim(x)) == ["a b", "", "​a"]


def test_unescape(spark):
    given = [r"a\,b\;c\\d\ne\Nf\xg", r"\\n", r"\\\n", "tail\\", "", "plain", "a\\\nb"]
    want = ["a,b;c\\d\ne\nfxg", "\\n", "\\\n", "tail\\", "", "plain", "a\nb"]
    assert one(spark, given, lambda x: T.unescape_text(x)) == want
    raw = ["a,b;c\\d\ne", "\\n", ",;\\\n"]
    assert one(spark, raw, lambda x: T.unescape_text(escape_text(x))) == raw


def utf16(text):
    return len(text.encode("utf-16-le")) // 2


def test_truncate_counts_utf16_units(spark):
    tv = chr(0x1F4FA)
    given = ["x" * 9, "x" * 10, "x" * 11, tv * 5, tv * 5 + "x", "xxxxxxxx" + tv + "yy", "xxxxxxxxx" + tv, "é" * 11]
    got = one(spark, given, lambda x: T.truncate(x, 10))
    dots = chr(0x2026)
    assert got == [
        "x" * 9,
        "x" * 10,
        "x" * 9 + dots,
        tv * 5,
        tv * 4 + chr(0xFFFD) + dots,
        "xxxxxxxx" + chr(0xFFFD) + dots,
        "x" * 9 + dots,
        "é" * 9 + dots,
    ]
    assert all(utf16(g) <= 10 for g in got)
    assert utf16(one(spark, ["x" * 400], lambda x: T.truncate(x, 255))[0]) == 255


def test_redact(spark):
    literals = ["secret-prefix", "secret-prefix-and-more", "ab", r"a.b*c\E(d", "secret-prefix"]
    given = ["v=secret-prefix-and-more", "a table of absolutes", r"x a.b*c\E(d y", "aXbbbc", "secret-prefix!"]
    want = ["v=[redacted]", "a table of absolutes", "x [redacted] y", "aXbbbc", "[redacted]!"]
    assert one(spark, given, lambda x: T.redact(x, literals)) == want
    assert T.longest_first(literals) == ["secret-prefix-and-more", "secret-prefix", r"a.b*c\E(d"]


def test_fingerprint(spark):
    got = one(spark, ["client-secret-value"], lambda x: T.fingerprint(x))[0]
    assert got == hashlib.sha256(b"client-secret-value").hexdigest()[:8]


def test_numbers(spark):
    given = ["5", " 5 ", "", "1e2", "0x1E", "0b11", "0o17", "-5", "5d", "Infinity", "1e999", "1_0", ".5", "5.", "NaN"]
    want = [5, 5, 0, 100, 30, 3, 15, -5, None, None, None, None, 0.5, 5, None]
    assert one(spark, given, lambda x: T.js_number(x)) == want


def test_describe_source(spark):
    given = [
        "https://api.x.invalid/ical/followed?token=t",
        "HTTPS://u:p@Api.X.invalid:443",
        "http://x.invalid:8080/a#b",
        "http://x.invalid:80/a",
        "not a url",
        "https://x.invalid:99999/",
    ]
    want = [
        "https://api.x.invalid/ical/followed",
        "https://api.x.invalid/",
        "http://x.invalid:8080/a",
        "http://x.invalid/a",
        T.UNREADABLE_URL,
        T.UNREADABLE_URL,
    ]
    assert one(spark, given, lambda x: T.describe_source(x)) == want


def test_percent_encode(spark):
    assert one(spark, ["me+tv@x.org", "a b/c~!'()*"], lambda x: T.percent_encode(x)) == [
        "me%2Btv%40x.org",
        "a%20b%2Fc~!'()*",
    ]


def test_params(spark):
    given = [
        "",
        ";TZID=Europe/Oslo",
        ';TZID="a;b:c"',
        ";tzid=x;TZID=y",
        ';X=";TZID=q";Y="b"',
        ";TZIDX=1",
        ";TZID",
        ";TZID=",
        ';A=b;TZID="x"',
    ]
    want = [None, "Europe/Oslo", "a;b:c", "y", "", "", "", "", "x"]
    assert one(spark, given, lambda x: param(x, "TZID")) == want


def test_durations(spark):
    minute, hour, day = 60_000, 3_600_000, 86_400_000
    cases = {
        "PT50M": 50 * minute,
        "-PT5M": -5 * minute,
        "+P1W": 7 * day,
        "P1W2DT3H4M5S": 9 * day + 3 * hour + 4 * minute + 5000,
        "P": 0,
        "PT": 0,
        " PT1H ": hour,
        "P1H": None,
        "1D": None,
        "PT1.5H": None,
    }
    assert one(spark, list(cases), lambda x: duration_ms(x)) == list(cases.values())


def test_zone_names(spark):
    df = spark.createDataFrame(
        [(i, z) for i, z in enumerate(["Europe/Oslo", "EUROPE/oslo", "utc", "Mars/Olympus", "", None])],
        "i int, tz string",
    )
    got = resolve_zone(df, zones(spark), "tz", "zone", F.lit("Asia/Kolkata")).orderBy("i").collect()
    oslo, kolkata = "Europe/Oslo", "Asia/Kolkata"
    assert [r.zone for r in got] == [oslo, oslo, "UTC", kolkata, kolkata, kolkata]


@pytest.mark.parametrize(
    "zone, wall, two_pass, java",
    [
        ("America/New_York", "2026-03-08 02:30", "2026-03-08 06:30", "2026-03-08 07:30"),
        ("Europe/Oslo", "2026-10-25 02:30", "2026-10-25 01:30", "2026-10-25 00:30"),
        ("Europe/Oslo", "2026-07-01 12:00", "2026-07-01 10:00", "2026-07-01 10:00"),
    ],
)
def test_gap_and_overlap(spark, zone, wall, two_pass, java):
    naive = F.unix_seconds(F.lit(wall).cast("timestamp"))
    row = spark.range(1).select(
        *[F.date_format(wall_to_instant(naive, F.lit(zone), m), "yyyy-MM-dd HH:mm") for m in ("two_pass", "java")]
    )
    assert tuple(row.first()) == (two_pass, java)


def test_wall_text_and_iso(spark):
    t = F.lit("2026-07-30 19:00:00").cast("timestamp")
    assert spark.range(1).select(format_wall(t, F.lit("Europe/Oslo"))).first()[0] == "2026-07-30T21:00:00"
    given = ["2026-07-27T12:00:00.000Z", "2026-07-27", "2026-07-27T14:00:00+02:00", "nonsense", "12", ""]
    noon = dt.datetime(2026, 7, 27, 12)
    assert one(spark, given, lambda x: parse_iso(x)) == [noon, dt.datetime(2026, 7, 27), noon, None, None, None]


def test_bodies(spark):
    given = [
        '{"error":{"code":"c","message":"m"}}',
        '{"error":{"code":5,"message":"m"},"id":7}',
        '{"error":"x","id":"e"}',
        "not json",
        '{"id":""}',
        "null",
    ]
    got = each(
        spark,
        given,
        lambda x: error_envelope(x).code,
        lambda x: error_envelope(x).message,
        created_id,
    )
    assert got == [
        ("c", "m", None),
        (None, "m", None),
        (None, None, "e"),
        (None, None, None),
        (None, None, None),
        (None, None, None),
    ]


def test_body_content(spark):
    df = spark.createDataFrame(
        [("d", "u"), ("see u here", "u"), (None, "u"), ("d", None), (None, None), ("", "")],
        "d string, u string",
    ).coalesce(1)
    got = [r[0] for r in df.select(body_content(F.col("d"), F.col("u"))).collect()]
    assert got == ["d\n\nu", "see u here", "u", "d", "", ""]


def test_failure_class(spark):
    df = spark.createDataFrame(
        [("create", 404), ("update", 404), ("delete", 403), ("delete", 500), ("update", 204)],
        "kind string, status int",
    ).coalesce(1)
    got = [r[0] for r in df.select(failure_class(F.col("kind"), F.col("status"))).collect()]
    assert got == ["failure", "housekeeping", "configuration", "failure", None]
