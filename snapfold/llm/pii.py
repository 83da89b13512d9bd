"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

The base patterns (email, ip, card, phone) are taken as they match, with the limits on their digits. Beyond
them the operator proposes IBANs, shorter cards, phone numbers without a plus and social security numbers; these
need a checksum (Luhn, mod 97) or the right words in front of them, and none of the other kind, to reach the score.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import prepare, whole

#: Order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Score from which a span beyond the base ones is kept, and how far in front of it words count.
THRESHOLD, NEAR = 0.5, 48

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9]([ ().0-9-]++)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}((?: ?[A-Z0-9]){11,30}))")
_INSIDE = re.compile(r"[A-Za-z0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

# Words that speak for or against a kind when they stand shortly before a span.
CONTEXT = {
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|telephone|mobile|cell|fax|telefon|téléphone|teléfono)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|taxpayer)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
}
AGAINST = re.compile(r"\b(?:order|invoice|isbn|part|version|serial|tracking|ticket|page)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Codes that pass mod 97, each as long as it can be; capitals and digits behind it, after a blank, do no harm."""
    found, done = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        end = m.end(1)
        while end > m.start(1):
            plain = text[m.start() : end].replace(" ", "")
            if len(plain) < 15:
                break
            if not _INSIDE.match(text, end) and mod97(plain):
                found.append((m.start(), end))
                done = end
                break
            end -= 1 + (text[end - 2] == " ")
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Every @ with a domain behind it, as far left as the local part goes; linear in the text."""
    found, done = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            done = m.end()
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Chains of numbers joined by dots, taken four at a time."""
    found = []
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(cards of 16 to 19 digits, shorter ones) that pass Luhn."""
    found: tuple[list, list] = ([], [])
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[len(digits) < 16].append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _PHONE.finditer(text):
        run = m.group().rstrip(" ().-")
        if len(run) >= 3 and 8 <= len(_digits(run)) <= 15:
            found.append((m.start(), m.start() + len(run)))
    return found


def _score(text: str, start: int, kind: str, begin: float) -> float:
    before = text[max(0, start - NEAR) : start]
    return begin + 0.3 * bool(CONTEXT[kind].search(before)) - 0.3 * bool(AGAINST.search(before))


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of all spans by kind, then start; positions in code points."""
    base: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": addresses(text), "phone": phones(text)}
    base["card"], short = cards(text)
    spans = [(k, s, e, 1.0, True) for k in BASE_KINDS for s, e in base[k]]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for s, e in sorted(x[1:3] for x in spans):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))

    def propose(kind: str, start: int, end: int, begin: float) -> None:
        i = bisect.bisect_left(taken, (end,))
        if (not i or taken[i - 1][1] <= start) and (p := _score(text, start, kind, begin)) >= THRESHOLD:
            spans.append((kind, start, end, round(p, 2), False))
            taken.insert(i, (start, end))

    for s, e in ibans(text):
        propose("iban", s, e, 0.8)
    for s, e in short:
        propose("card", s, e, 0.3)
    for m in _SSN.finditer(text):
        propose("ssn", *m.span(), 0.3)
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m.group())) <= 12:
            propose("phone", *m.span(), 0.3)
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (kind, start, end, score, base) by kind as in KINDS, then start.

    Whole texts are searched, each in linear time; a null or empty text has no spans. Rows are handled one by one:
    repeated rows and null ids come out as they came in, and columns beyond doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in SPANS.value_type]
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in find(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, SPANS)], ["doc_id", "spans"])

    prepare(docs.sparkSession)
    schema = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"
    return docs.select(F.col("doc_id").cast("bigint"), whole().alias("text")).mapInArrow(run, schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = batch.schema.get_field_index("text"), []
            for text in batch.column(at).to_pylist():
                parts, done = [], 0
                for kind, s, e, *_ in sorted(find(text or ""), key=lambda x: x[1:3]):
                    if s >= done:
                        parts += [text[done:s], f"<{kind}>"]
                        done = e
                made.append(None if text is None else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
