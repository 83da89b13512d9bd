"""Text expressions with the string semantics of the feed producers (UTF-16 lengths, Unicode trim)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points a feed reader strips from both ends of a value (Unicode white space, line
# terminators and the byte-order mark).
SPACE_POINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
WHITE_SPACE = "".join(map(chr, SPACE_POINTS))
# The same set as a regular-expression class without the line feed, for use inside one line.
LINE_SPACE = "[" + "".join(rf"\x{{{p:X}}}" for p in SPACE_POINTS if p != 0x0A) + "]"

# What a redacted literal becomes, and the shortest literal that is redacted.
REDACTED = "[redacted]"
MIN_SECRET_LENGTH = 8
# Shown instead of a URL that cannot be read.
UNREADABLE_URL = "(no readable address)"

ELLIPSIS = chr(0x2026)


def js_trim(col: Column) -> Column:
    """Strip all Unicode white space and the byte-order mark from both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    """Trimmed text, with nothing left over counted as absent."""
    return F.nullif(js_trim(col), F.lit(""))


def unescape_text(col: Column) -> Column:
    r"""Undo TEXT escaping, left to right: ``\n`` is a newline, any other escape loses its backslash.

    The first pass walks over whole escape pairs, so ``\\n`` stays a backslash and an ``n``; a lone
    trailing backslash is kept.
    """
    newlines = F.regexp_replace(col, r"\G((?:[^\\]++|\\[^nN])*+)\\[nN]", "$1\n")
    plain = F.regexp_replace(newlines, r"(?s)\\(.)", "$1")
    return F.when(F.contains(col, F.lit("\\")), plain).otherwise(col)


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def truncate(col: Column, limit: int) -> Column:
    """At most ``limit`` UTF-16 units, the last one an ellipsis where text was cut.

    Without characters outside the basic plane units and code points agree. With them the cut is made
    on the encoded form; half a surrogate pair left at the cut becomes U+FFFD.
    """
    units = utf16_length(col)
    keep = limit - 1
    encoded = F.encode(col, "UTF-16BE")
    edge = F.hex(F.substring(encoded, 2 * keep - 1, 1))
    split_pair = edge.between("D8", "DB")
    whole = F.decode(F.substring(encoded, 1, 2 * keep), "UTF-16BE")
    halved = F.concat(F.decode(F.substring(encoded, 1, 2 * (keep - 1)), "UTF-16BE"), F.lit(chr(0xFFFD)))
    by_units = F.when(split_pair, halved).otherwise(whole)
    cut = F.when(F.char_length(col) == units, F.substring(col, 1, keep)).otherwise(by_units)
    # Cheap test first: a text of at most limit/2 code points cannot exceed the limit in units.
    return (
        F.when(F.char_length(col) <= limit // 2, col)
        .when(units <= limit, col)
        .otherwise(F.concat(cut, F.lit(ELLIPSIS)))
    )


def longest_first(literals: Iterable[str]) -> list[str]:
    """Distinct literals long enough to redact, longest first, so that a containing one wins."""
    kept = dict.fromkeys(x for x in literals if len(x.encode("utf-16-be")) // 2 >= MIN_SECRET_LENGTH)
    return sorted(kept, key=lambda x: -(len(x.encode("utf-16-be")) // 2))


def _quote(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def redact(col: Column, literals: Iterable[str]) -> Column:
    """Replace every known literal in the whole text."""
    ordered = longest_first(literals)
    if not ordered:
        return col
    return F.regexp_replace(col, "|".join(map(_quote, ordered)), F.lit(REDACTED))


def fingerprint(col: Column) -> Column:
    """Eight hex digits that identify a secret without showing it."""
    return F.substring(F.sha2(col, 256), 1, 8)


def js_number(col: Column) -> Column:
    """The number a text stands for under the loose numeric rules of the settings; NULL if none.

    Blank text is zero; decimal, exponent, hexadecimal, octal and binary notation are accepted. A number in
    one of the latter three that doesn't fit 63 bits is none.
    """
    text = js_trim(col)
    decimal = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    based = F.lower(F.substring(text, 1, 2))
    digits = F.regexp_replace(F.substr(text, F.lit(3)), "^0+(?=.)", "")

    def in_base(prefix: str, base: int, pattern: str, places: int) -> tuple[Column, Column]:
        fits = F.when(F.length(digits) <= places, digits)
        return (based == prefix) & digits.rlike(pattern), F.conv(fits, base, 10).try_cast("double")

    number = F.when(text == "", F.lit(0.0)).when(text.rlike(decimal), text.try_cast("double"))
    for prefix, base, pattern, places in (
        ("0x", 16, "^[0-9a-fA-F]+$", 15),
        ("0o", 8, "^[0-7]+$", 21),
        ("0b", 2, "^[01]+$", 63),
    ):
        test, value = in_base(prefix, base, pattern, places)
        number = number.when(test, value)
    return F.when(F.abs(number) < F.lit(float("inf")), number)


_URL = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s\[\]]+)"
    r"(?::([0-9]{0,5}))?([/?#].*)?$"
)


def is_web_url(col: Column) -> Column:
    """Whether a text is an absolute URL with a host and a possible port."""
    url = js_trim(col)
    port = F.concat(F.lit("0"), F.regexp_extract(url, _URL, 3)).cast("int")
    return url.rlike(_URL) & (port <= 65535)


def describe_source(col: Column) -> Column:
    """Origin and path only: a feed token lives in the query string and must not be shown."""
    url = js_trim(col)
    origin = F.concat(
        F.lower(F.regexp_extract(url, _URL, 1)), F.lit("://"), F.lower(F.regexp_extract(url, _URL, 2))
    )
    port = F.regexp_replace(F.regexp_extract(url, _URL, 3), "^0+(?=[0-9])", "")
    path = F.regexp_extract(F.regexp_extract(url, _URL, 4), r"^[^?#]*", 0)
    shown = F.concat(
        origin,
        F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path),
    )
    # The port a scheme has anyway is not shown.
    shown = F.regexp_replace(shown, "^(https://[^/]+):443/", "$1/")
    shown = F.regexp_replace(shown, "^(http://[^/]+):80/", "$1/")
    return F.when(is_web_url(col), shown).otherwise(F.lit(UNREADABLE_URL))


def percent_encode(col: Column) -> Column:
    """Percent-encode one path segment; unlike form encoding a space is %20 and ``!'()*~`` stay."""
    out = F.url_encode(col)
    for encoded, kept in (
        ("+", "%20"),
        ("%21", "!"),
        ("%27", "'"),
        ("%28", "("),
        ("%29", ")"),
        ("%7E", "~"),
    ):
        out = F.replace(out, F.lit(encoded), F.lit(kept))
    return out
