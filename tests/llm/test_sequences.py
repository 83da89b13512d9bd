"""Periodic runs, SentencePiece encoding and the conversation trie."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import awkward, empty

import snapfold.llm.trie as trie_module
from snapfold.llm.common import Words
from snapfold.llm.pieces import Vocabulary, decode_ids, encode_texts
from snapfold.llm.queries import PIECES, QUERIES
from snapfold.llm.runs import _candidates, find_runs, lyndon, runs_of
from snapfold.llm.trie import conversations_of_turns, shared_openings, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def all_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def lyndon_lengths(word):
    def is_lyndon(u):
        return all(u < u[k:] for k in range(1, len(u)))

    return [max(size for size in range(1, len(word) - i + 1) if is_lyndon(word[i : i + size])) for i in range(len(word))]


def repetitive(rnd, size):
    words = []
    while len(words) < size:
        if rnd.random() < 0.5:
            words += [rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))] * rnd.randrange(1, 7)
        else:
            words.append(rnd.choice("abcdefgh"))
    return words


def test_lyndon_array():
    rnd = random.Random(1)
    for _ in range(1500):
        word = [rnd.randrange(rnd.randrange(1, 5)) for _ in range(rnd.randrange(1, 14))]
        assert lyndon(word, max(word) + 1).tolist() == lyndon_lengths(word)


def test_runs_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(1500):
        words = repetitive(rnd, rnd.randrange(1, 90))
        for least in (2, 5, 12):
            assert runs_of(words, least) == all_runs(words, least), words


def test_what_is_cut_off_holds_no_run():
    rnd = random.Random(3)
    texts = [" ".join(repetitive(rnd, rnd.randrange(0, 70))) for _ in range(400)]
    for least in (5, 12):
        found = Words(pa.array(texts), plain=True)
        got = defaultdict(list)
        for i, a, b in _candidates(found, least):
            a, b = a - found.first[i], b - found.first[i]
            got[i] += [(a + s, n, q) for s, n, q in runs_of(texts[i].split()[a:b], least)]
        assert [got[i] for i in range(len(texts))] == [all_runs(t.split(), least) for t in texts]


def test_hostile_words_take_no_square_time():
    for words in (["a"] * 60_000, [str(i) for i in range(60_000)], [str(-i) for i in range(60_000)], [str(i % 317) for i in range(60_000)]):
        assert len(runs_of(words)) <= 1


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_run_rows(spark):
    rows = find_runs(awkward(spark)).collect()
    assert len(rows) == 10 and find_runs(empty(spark)).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].runs == by_id[3].runs == by_id[4].runs == by_id[1].runs == [] and by_id[2].collapsed == by_id[4].collapsed == ""
    assert [tuple(r) for r in by_id[5].runs] == [(0, 60_000, 977)] and by_id[5].collapsed == " ".join(f"w{i}" for i in range(977))
    assert by_id[6].runs == by_id[5].runs and by_id[7].n_words == 7


def test_runs_query_equals_brute_force(spark):
    want = {}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = WORD.findall(doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            runs = runs_of(words)  # compared above; brute force is square
        else:
            runs = all_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        want[doc.doc_id] = (len(runs), *best, milli, digest, hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_runs"](spark, SF).collect()}
    assert got == want and any(w[0] for w in want.values())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


def test_pieces_equal_the_library(library):
    mine, rnd = Vocabulary(public_tokenizers.path(PIECES)), random.Random(4)
    parts = [*mine.scores]
    odd = [" ", "  ", "\n", "\U0001f600", "\x00", "é", "aa", "a", "</s>", "<0x41>", "�"]
    texts = ["", " ", "▁", "a" * 9000, " " * 9000, "ab " * 4000]
    for _ in range(6000):
        size, share = rnd.randrange(1, 12), rnd.random()
        texts.append("".join(rnd.choice(parts) if rnd.random() < share else rnd.choice([*odd, "▁" * rnd.randrange(1, 40)]) for _ in range(size)))
        texts.append("".join(rnd.choice("abcdeinrst"[: rnd.randrange(1, 11)]) for _ in range(rnd.randrange(1, 60))))
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert mine.encode(text).tolist() == ids, text
        assert mine.decode(np.array(ids, int)) == library.decode(ids), text


def test_decoding_of_any_ids(library):
    mine, rnd = Vocabulary(public_tokenizers.path(PIECES)), random.Random(5)
    for _ in range(8000):
        ids = [rnd.randrange(32_000) if rnd.random() < 0.6 else rnd.choice([0, 1, 2, 3, 200, 230, 131, 132, 28705]) for _ in range(rnd.randrange(8))]
        assert mine.decode(np.array(ids, int)) == library.decode(ids), ids


def test_only_reached_pieces_match():
    mine = Vocabulary(public_tokenizers.path(PIECES))
    assert all(mine.merge(p) == [p] for p in mine.reached)
    mine.known.clear()
    mine.encode("one two")
    assert set(mine.known) == {"▁one", "▁two"}


def test_piece_rows(spark, library):
    path = public_tokenizers.path(PIECES)
    rows = decode_ids(encode_texts(awkward(spark), path), path).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_eos=True)) for r in awkward(spark).collect()]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.decoded == library.decode(r.ids) for r in rows)
    assert encode_texts(empty(spark), path).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id bigint, ids array<int>, decoded string")
    assert {r.doc_id: r.decoded for r in decode_ids(odd, path).collect()} == {1: None, 2: ""}


def test_piece_query_equals_the_library(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want[r.doc_id] = (len(ids), *shas)
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_pieces"](spark, SF).collect()} == want


def brute_trie(rows):
    """Nodes of conversations given as {conv_id: [(role, text)]}."""
    built = {}
    for c, own in rows.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(rows.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    got = {}
    for node in sorted(members, key=len, reverse=True):
        below = [got[x] for x in children[node]]
        words = len(WORD.findall(node[-1][1])) if node else 0
        ends = ",".join(map(str, sorted(c for c in members[node] if built[c] == node)))
        got[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
            sum(x[5] for x in below) or 1, sum(x[6] for x in below) + (len(members[node]) - 1) * words, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(got.values(), key=str)


def conversations(n, seed, hot=0.3, turns=6):
    rnd = random.Random(seed)
    said = [("user" if i % 2 else "assistant", " ".join("w" * (1 + i % 3) for _ in range(i % 5))) for i in range(7)]
    rows = {c: [rnd.choice(said) for _ in range(rnd.randrange(1, turns))] for c in rnd.sample(range(3 * n), n)}
    for c in rows:
        if rnd.random() < hot:
            rows[c] = said[:4]
    return rows


def frame(spark, rows):
    made = [(c, i, *t, 5) for c, turns in rows.items() for i, t in enumerate(turns)]
    return spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string, depth int")


@pytest.mark.parametrize(("fan", "shards"), [(64, 4), (2, 13), (3, 40)])
def test_trie_equals_brute_force(spark, monkeypatch, fan, shards):
    monkeypatch.setattr(trie_module, "FAN", fan)
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, hot in ((200, 0.3), (150, 0.95), (1, 0)):
            rows = conversations(n, n, hot)
            got = trie(shared_openings(conversations_of_turns(frame(spark, rows)))).collect()
            assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_deep_conversation(spark):
    rows = {c: [("user", f"t{i}") for i in range(3000)] for c in (0, 20)} | {1: [("user", "x")]}
    got = trie(shared_openings(conversations_of_turns(frame(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(20, 1, "user", "b"), (20, None, None, "a"), (20, 1, "user", "b"), (20, 0, "user", None), (None, 0, "user", "x"), (40, 0, "user", "")]
    got = conversations_of_turns(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id: r.words for r in got} == {20: [1, 0, 1, 1], 40: [0]}
    want = brute_trie({20: [("", "a"), ("user", ""), ("user", "b"), ("user", "b")], 40: [("user", "")]})
    made = trie(shared_openings(conversations_of_turns(spark.createDataFrame(rows, schema))))
    assert sorted(map(tuple, made.collect()), key=str) == want
    assert trie(shared_openings(conversations_of_turns(spark.createDataFrame([], schema)))).count() == 0
    # without a base and with no more turns than are replaced, a conversation has no turns and ends at the root
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    alone = trie(shared_openings(conversations_of_turns(spark.createDataFrame([(short, 0, "user", "x")], schema)))).collect()
    assert [tuple(r) for r in alone] == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
