"""Operators that handle rows one by one: personal data, toxicity, pages."""

import math
import random
import re
import time
import zlib

import pytest
from helpers import awkward, empty

from snapfold.llm.pages import _measure, extract, extract_pages, parse
from snapfold.llm.pii import find, find_pii, mod97, redact_pii
from snapfold.llm.toxicity import Model, fit, held_out, score, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    parts = ["a", ".", "@", "1", "2", "255", "0", "-", " ", "+", "(", ")", "_", "B.c", "4111111111111111", "%", "é", "\n", "@x.y", "1.2.3.4", "+1 "]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30)))
        assert [x[:3] for x in find(text) if x[4]] == brute(text), text


def test_hostile_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 200_000, "1." * 100_000, "a@" * 80_000, "+5" + "(" * 100_000, "+1 " * 60_000, "A1 " * 60_000, "12 34 " * 40_000, "@a.b " * 400_000, "a" * 200_000 + "@a.b " * 200_000):
        find(text)
    assert time.time() - began < 20


def test_added_spans_need_checksum_or_words():
    assert mod97("GB82WEST12345698765432")
    assert [x[0] for x in find("pay to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert find("pay to GB83 WEST 1234 5698 7654 32 now") == []
    assert [x[0] for x in find("credit card 378282246310005")] == ["card"]
    assert find("order 378282246310005") == [] == find("378282246310005")
    assert [x[0] for x in find("my ssn is 123-45-6789")] == ["ssn"]
    assert find("serial 123-45-6789") == []
    assert [x[0] for x in find("call 555 123 4567 please")] == ["phone"]


def test_pii_rows(spark):
    rows = find_pii(awkward(spark)).collect()
    assert len(rows) == 10
    spans = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert spans[7] == ["email", "ip", "phone"] and spans[2] == spans[3] == []
    assert find_pii(empty(spark)).count() == 0
    red = {r.doc_id: r.text for r in redact_pii(awkward(spark)).collect()}
    assert red[7] == "é\U0001f600 <|im_end|> <phone> <email> <ip>" and red[3] is None


def labelled(spark, n):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(40, 200))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(len(words) // 12 + 2):
                words[rnd.randrange(len(words))] = rnd.choice(["wretchkopf", "grobzunge", "schmutzfink"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_rows_it_has_not_seen(spark):
    docs, labels = labelled(spark, 900)
    model = train(docs, labels)
    rows = score(docs, model).withColumn("held", held_out()).join(labels, "doc_id").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held]
    assert sum((r.score >= 0.5) == r.toxic for r in unseen) / len(unseen) > 0.93


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.where(~held_out()).unionByName(labels.where(held_out()).selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    assert train(docs, labels) == train(docs, flipped)


def test_toxicity_edges(spark):
    assert fit([], [], []).toxic == b""
    model = Model(b"", b"", (0.0, 0.0, 0.0, 0.0))
    rows = score(awkward(spark), model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and rows[0].copy == 1
    assert score(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert train(awkward(spark), none).toxic == b""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>a &amp; b<p>c", "a & b\n\nc"),
        ("<script>var x='</p>';</script><p>hi <i>the</i>re<br>now</p>", "hi there now"),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One  two.</p><!-- x --><p>Three.</p></article><footer>F</footer>", "T\n\nOne two.\n\nThree."),
        (
            "<body><div class='menu'><a>1</a> <a>2</a></div><div id=content><p>Long text with several words.</p><p>Another one, as long as that.</p></div>"
            "<div class='user-comments'><p>I disagree with all of that, and at length too.</p></div><form>Name <input></form></body>",
            "Long text with several words.\n\nAnother one, as long as that.",
        ),
        ("<body><section><p>aaa bbb ccc ddd</p></section><section><p>jjj kkk lll mmm</p></section></body>", "aaa bbb ccc ddd\n\njjj kkk lll mmm"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<article>loose text<div>block</div>more</article>", "loose text\n\nblock\n\nmore"),
    ],
)
def test_pages(html, text):
    assert extract(html) == text


def test_hostile_pages_take_linear_time():
    began = time.time()
    for html in ("<div>" * 50_000, "<p>" * 50_000, '<a "' * 30_000, "<!--" * 30_000, "<li>x" * 30_000, "<b>" * 30_000 + "x", "</div>" * 50_000, "<a '>" * 30_000):
        extract(html)
    assert time.time() - began < 30


def test_page_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text) for r in extract_pages(pages).collect()), key=str)
    assert got == [(0, None, ""), (1, "u", "a"), (1, "u", "a"), (2, "v", "")]
    assert extract_pages(pages.limit(0)).count() == 0


def test_ibans_with_capitals_behind():
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"IBAN: {iban} BIC COBADEFFXXX", f"IBAN {iban} 12 EUR", f"{iban.replace(' ', '')} BIC COBADEFF", f"bank account {iban} and {iban} BIC"):
        spans = [text[s:e] for kind, s, e, *_ in find(text) if kind == "iban"]
        assert spans and {x.replace(" ", "") for x in spans} == {iban.replace(" ", "")}, text
        assert len(spans) == text.replace(" ", "").count(iban.replace(" ", ""))
    assert not [x for x in find(f"IBAN {iban}7X") if x[0] == "iban"]


WORDS = "<p>The whole story, told at some length in several words.</p><p>And then a second part, as long as the first.</p>"


@pytest.mark.parametrize(
    "html",
    [
        f"<body><div class='content has-sidebar'>{WORDS}</div></body>",
        f"<body><div class='site no-sidebar'><article>{WORDS}</article></div></body>",
        f"<body><div class='hentry comments-open'>{WORDS}</div></body>",
        f"<body><div class='site-header-wide widget'><div><article>{WORDS}</article></div></div><div class=ad>Buy it now.</div></body>",
        f"<body><div class='promotion'>{WORDS}</div><div class=ad>Buy it now.</div></body>",
        f"<body><article>{WORDS}</article><div id=comments><article class=comment>Not so, I think.</article></div></body>",
    ],
)
def test_no_name_drops_the_article(html):
    assert extract(html) == "The whole story, told at some length in several words.\n\nAnd then a second part, as long as the first."


def test_lists_of_links_of_an_article_stay():
    links = "<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>"
    assert extract(f"<body><article>{WORDS}{links}</article></body>").endswith("First source\n\nSecond source")
    assert extract(f"<body><article>{links}</article></body>") == "First source\n\nSecond source"
    assert extract(f"<body><div id=content>{WORDS}<p><a href=a>One</a> <a href=b>two</a></p></div></body>").endswith("One two")
    assert "First" not in extract(f"<body>{links}{WORDS}</body>")


LONG = "A paragraph of the story, long enough to be read as text and not as a label."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><h2 class='section-header'>Part</h2><p>{LONG}</p></article>", ["Part", LONG]),
        (f"<article><p>{LONG}</p><section id='social-effects'><h2>Effects</h2><p>More.</p></section></article>", [LONG, "Effects", "More."]),
        (f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><p>More.</p></article>", [LONG, "Related work", "More."]),
        (f"<article><p class='notice'>Mind this.</p><p>{LONG}</p></article>", ["Mind this.", LONG]),
        (f"<article><p>{LONG} <math><mi>x</mi></math></p><label>A label</label><object>In its place</object></article>", [f"{LONG} x", "A labelIn its place"]),
        (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>Foot</footer></article>", ["Title", LONG]),
        (f"<main><article><p>{LONG}</p></article><article><p>Short one.</p></article></main>", [LONG, "Short one."]),
        (f"<section><h2>A</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>Short.</p></section>", ["A", LONG, LONG, "B", "Short."]),
        (f"<article><p>{LONG}</p></article><div class='user-feedback'><h3>Reader comments</h3><p>I beg to differ, and at some length.</p></div>", [LONG]),
        (f"<article><p>{LONG}</p><div class='user-feedback'><h3>Reader comments</h3><p>I beg to differ.</p></div></article>", [LONG]),
        (f"<div id=main><p>{LONG}</p><p>{LONG}</p><div class='related-work'><p>An inner box.</p></div><div class='ad'>Buy.</div></div>", [LONG, LONG, "An inner box."]),
        (f"<article><p>{LONG}</p><div class='box ad'>Buy.</div><div class='share'>Tell</div></article><article class='comment'><p>No.</p></article>", [LONG]),
        (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", ["Title", LONG]),
    ],
)
def test_only_parts_that_are_no_article_go(html, text):
    assert extract(f"<html><body><nav><a href=/>Home</a></nav>{html}<footer>Foot</footer></body></html>") == "\n\n".join(text)


def children(node):
    return [p for p in node.parts if not isinstance(p, str) and not p.drop and not p.away]


def slow_counts(node, linked):
    """(characters, link characters, tags, link tags) of an element."""
    linked = linked or node.tag == "a"
    chars = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
    below = [slow_counts(p, linked) for p in children(node)]
    links = chars * linked
    return (
        chars + sum(x[0] for x in below),
        links + sum(x[1] for x in below),
        len(below) + sum(x[2] for x in below),
        sum(p.tag == "a" for p in children(node)) + sum(x[3] for x in below),
    )


def slow_density(node, linked, share):
    chars, links, tags, link_tags = slow_counts(node, linked)
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    adjusted = math.log(max(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), 1.0))
    return chars / max(tags, 1) * max(adjusted, 1e-9) / base


def test_densities_of_random_trees():
    rnd = random.Random(4)

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            return "word " * rnd.randrange(6)
        tag = rnd.choice(["div", "p", "span", "a", "em"] if depth == 1 else ["div", "section", "span"])
        return f"<{tag}>{''.join(made(depth - 1) for _ in range(rnd.randrange(1, 5)))}</{tag}>"

    for _ in range(200):
        root = parse(f"<body>{made(5)}{made(5)}</body>")
        order = _measure(root)
        chars, links, *_ = slow_counts(root, False)
        share, linked = links / chars if chars else 0.0, {}
        for node in order:
            linked[id(node)] = node.tag == "a" or (node.parent is not None and linked[id(node.parent)])
            want = [slow_density(p, linked[id(node)], share) for p in children(node)]
            assert math.isclose(node.density, slow_density(node, linked[id(node)], share), rel_tol=1e-9)
            assert math.isclose(node.total, sum(want), rel_tol=1e-9, abs_tol=1e-12)
