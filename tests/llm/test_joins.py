"""Operators on pairs, groups and searches against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from helpers import awkward, empty, texts

from snapfold.llm.common import Words
from snapfold.llm.components import components
from snapfold.llm.decontaminate import MASKS, MIN_SAME, MIN_WORDS, Index, decontaminate, overlaps
from snapfold.llm.lines import MIN_CHARS, common_lines, in_order, line_dedup
from snapfold.llm.neighbours import Tree, nearest
from snapfold.llm.simhash import fingerprint, roots, simhash_dedup, simhash_groups
from snapfold.llm.suffixes import cut_passages, repeated_passages


def frame(spark, made, start=0):
    return spark.createDataFrame(list(enumerate(made, start)), "doc_id bigint, text string").repartition(3)


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    want = union_find(600, edges)
    assert got == {i: w for i, w in enumerate(want) if w != i}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_equals_all_pairs(spark):
    made = texts(220, 2, (1, 60)) + ["", " ", "A b", "a B"]
    prints = [slow_fingerprint(x) for x in made]
    assert [fingerprint(x) for x in made] == prints
    links = [(i, j) for i in range(len(made)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = union_find(len(made), links)
    rows = simhash_groups(frame(spark, made)).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))
    assert {r.doc_id: r.bits % (1 << 64) for r in rows} == dict(enumerate(prints))
    assert sorted(r.doc_id for r in simhash_dedup(frame(spark, made)).collect()) == sorted(set(want))


def test_large_buckets_give_the_same_links():
    rnd = np.random.default_rng(1)
    base = np.uint64(0x123456789ABCDEF0)
    prints = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rnd.choice(20, rnd.integers(0, 8), False))) for _ in range(2500)]))
    assert len(prints) > 1024
    links = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 2).tolist()]
    assert roots(prints, 2).tolist() == union_find(len(prints), links)


def test_simhash_rows(spark):
    rows = simhash_groups(awkward(spark)).collect()
    assert len(rows) == 10
    ids = defaultdict(set)
    for r in rows:
        ids[r.doc_id].add(r.component_id)
    assert ids[2] == ids[3] == ids[4] == {2} and ids[5] == ids[6] == {5} and ids[1] == {1}
    kept = simhash_dedup(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 5, 7]
    assert simhash_groups(empty(spark)).count() == 0 == simhash_dedup(empty(spark)).count()


def test_patience():
    rnd = random.Random(4)
    for _ in range(300):
        places = [rnd.randrange(12) for _ in range(rnd.randrange(9))]
        best = 0
        for mask in range(1 << len(places)):
            run = [x for i, x in enumerate(places) if mask >> i & 1]
            best = max(best, len(run) if all(a < b for a, b in zip(run, run[1:])) else 0)
        run = [places[i] for i in in_order(places)]
        assert len(run) == best and run == sorted(set(run))
    assert common_lines([(3, 1, 30), (4, 2, 5), (6, 9, 5), (0, 7, 30)]) == [3, 4]


def slow_lines(docs):
    """Kept lines of each document, in order of doc_id, for texts whose lines are all long."""
    seen, whole, kept = {}, set(), {}
    for doc, text in docs:
        lines, count = text.split("\n"), defaultdict(int)
        keys = []
        for line in lines:
            count[line] += 1
            keys.append((line, count[line]))
        pairs = defaultdict(list)
        for i, key in enumerate(keys):
            if key in seen:
                pairs[seen[key][0]].append((i, seen[key][1], len(key[0])))
        gone = {x for p in pairs.values() for x in common_lines(p)}
        kept[doc] = "" if text in whole else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        whole.add(text)
        for i, key in enumerate(keys):
            seen.setdefault(key, (doc, i))
    return kept


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"line number {i} with enough text to stand on its own" for i in range(120)]
    docs = []
    for i in range(150):
        if docs and rnd.random() < 0.1:
            lines = rnd.choice(docs)[1].split("\n")
        else:
            lines = [f"only here: {i} {j} and nowhere else at all" for j in range(rnd.randrange(4))]
            at = rnd.randrange(len(pool) - 10)
            lines += pool[at : at + rnd.randrange(10)] + rnd.sample(pool, rnd.randrange(3))
            if rnd.random() < 0.3:
                rnd.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == slow_lines(docs)


def test_short_lines_go_with_their_neighbours_only(spark):
    block = "a line that is long enough to count\nyes\nanother line that is long enough"
    docs = [(1, "first\n" + block), (2, "mine is different from the others\nyes\nand so it goes on"), (3, block + "\nlast words of the third")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[2] == (docs[1][1], 3, 0) and len("yes") < MIN_CHARS
    assert got[3][0] in ("yes\nlast words of the third", "last words of the third") and got[1][2] == 0


def test_line_rows(spark):
    rows = line_dedup(awkward(spark))
    assert set(rows.columns) == {*awkward(spark).columns, "n_removed"}
    got = rows.collect()
    text = defaultdict(list)
    for r in got:
        text[r.doc_id].append(r.text)
    assert len(got) == 10 and text[1] == ["one two three four five six seven eight"] * 2
    assert text[6] == [""] and text[3] == [None] and text[2] == [""] and len(text[5][0]) > 100_000 and sorted(map(str, text[None])) == ["", "None"]
    assert line_dedup(empty(spark)).count() == 0


def slow_overlap(doc, item):
    """Whether some stretch of a diagonal has enough equal words, beginning and ending with equal ones."""
    need = min(MIN_WORDS, len(item))
    for d in range(-len(item), len(doc)):
        same = [doc[i] == item[i - d] for i in range(max(0, d), min(len(doc), len(item) + d))]
        for a in range(len(same)):
            for b in range(a + need, len(same) + 1):
                if sum(same[a:b]) >= 0.9 * (b - a):
                    return True
    return False


def test_masks_hit_what_is_to_be_found():
    for size, changed in ((MIN_WORDS, 2), (15, 3), (20, 4)):
        for places in combinations(range(1, size - 1), changed):
            hit = [all(at + i not in places for i, bit in enumerate(m) if bit == "1") for m in MASKS for at in range(size - len(m) + 1)]
            assert any(hit), places


def test_overlaps(spark):
    rnd, made = random.Random(6), texts(60, 9, (40, 80))
    items = [x.split(" ")[:40] for x in texts(8, 21, (30, 50))] + [["only", "five", "words", "to", "match"], ["too", "short"]]
    items = [" ".join(x) for x in items]
    docs = []
    for x in made:
        words = x.split(" ")
        if rnd.random() < 0.5:
            item = rnd.choice(items).split(" ")
            for _ in range(len(item) // 15):
                item[rnd.randrange(len(item))] = "changed"
            at = rnd.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
        docs.append(" ".join(words))
    bench = spark.createDataFrame([*enumerate(items), (50, items[0]), (51, None), (None, items[1]), (52, "")], "item_id bigint, text string")
    got = overlaps(frame(spark, docs), bench).collect()
    split = [re.findall(r"[0-9a-z]+", x.lower()) for x in docs]
    own = [re.findall(r"[0-9a-z]+", x.lower()) for x in items]
    sure = {(i, j) for i, d in enumerate(split) for j, q in enumerate(own) if len(q) >= 5 and slow_overlap(d, q)}
    found = {(r.doc_id, r.item_id) for r in got}
    assert sure <= found
    for r in got:
        assert r.same_words >= MIN_SAME * (r.end_word - r.start_word) and r.end_word - r.start_word >= min(MIN_WORDS, len(own[r.item_id]))
    kept = {r.doc_id for r in decontaminate(frame(spark, docs), bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in found}


def test_overlap_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id bigint, text string")
    assert {r.doc_id for r in overlaps(awkward(spark), bench).collect()} == {1, None}
    left = decontaminate(awkward(spark), bench)
    assert left.columns == awkward(spark).columns and left.count() == 7
    assert overlaps(empty(spark), bench).count() == 0 == overlaps(awkward(spark), bench.limit(0)).count()
    assert decontaminate(awkward(spark), bench.limit(0)).count() == 10


def vectors(spark, n=700, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32) * rng.uniform(0.2, 3, size=(n, 1)).astype(np.float32)
    x[200:260] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (920, [0.0] * dim), (940, [float("nan")] * dim), (960, [1.0] * (dim - 1) + [float("inf")]), (980, [None] * dim), (None, [1.0] * dim)]
    return spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>"), x.astype(float)


def test_exact_search_equals_brute_force(spark):
    table, x = vectors(spark)
    got = defaultdict(list)
    for r in sorted(nearest(table, "vec_id % 20 = 0", k=20).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:20]
        assert [v for v, _ in found] == order
        assert np.allclose([s for _, s in found], score[order], rtol=0, atol=1e-12)
    few = nearest(table.where("vec_id < 3"), "vec_id = 0", k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert nearest(table.limit(0), "vec_id = 0").count() == 0


def test_relaxed_pruning_keeps_most(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(float)
    tree = Tree(np.arange(len(x)), x, float(np.linalg.norm(x, axis=1).max()), 20)
    ids = np.arange(0, 6000, 20)
    exact = tree.search(ids, x[ids], 20, 1.0)
    some = tree.search(ids, x[ids], 20, 1.5)
    pairs = [set(zip(r[0].tolist(), r[1].tolist(), strict=True)) for r in (exact, some)]
    assert len(pairs[0]) == 20 * len(ids) and len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[0])


def slow_passages(docs, least):
    first, covered = {}, defaultdict(set)
    for doc, text in docs:
        words = text.split()
        for i in range(len(words) - least + 1):
            run = tuple(words[i : i + least])
            if run in first:
                covered[doc].update(range(i, i + least))
            else:
                first[run] = doc
    return {d: sorted(c) for d, c in covered.items()}


def test_repeated_passages_equal_brute_force(spark):
    made = texts(150, 12, (20, 200)) + ["a b " * 90, "c " * 70 + "a b " * 60]
    got = defaultdict(set)
    rows = repeated_passages(frame(spark, made)).collect()
    for r in rows:
        assert r.end_word - r.start_word >= 50 and all(f <= r.doc_id for f in r.first_doc_ids)
        assert not got[r.doc_id] & set(range(r.start_word, r.end_word))
        got[r.doc_id].update(range(r.start_word, r.end_word))
    want = slow_passages(list(enumerate(made)), 50)
    assert {d: sorted(c) for d, c in got.items()} == want and want
    left = {r.doc_id: r.text for r in cut_passages(frame(spark, made), repeated_passages(frame(spark, made))).collect()}
    for i, text in enumerate(made):
        gone = set(want.get(i, []))
        assert left[i] == (text if not gone else " ".join(w for j, w in enumerate(text.split()) if j not in gone))


def test_passage_rows(spark):
    rows = repeated_passages(awkward(spark)).collect()
    assert {r.doc_id for r in rows} == {5, 6} and all(r.first_doc_ids == [5] for r in rows)
    assert repeated_passages(empty(spark)).count() == 0


def test_frequent_seeds_dealt_out_by_passages_change_nothing(spark):
    shared = texts(1, 3, (120, 121))[0]
    made = [f"{x} {shared} {y}" for x, y in zip(texts(40, 13), texts(40, 14), strict=True)] + ["a b " * 90]
    docs = frame(spark, made)

    def rows(hot):
        return sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_ids) for r in repeated_passages(docs, hot_suffixes=hot).collect())

    want = rows(1 << 40)
    assert len({d for d, *_ in want}) >= 40
    assert rows(0) == rows(1) == rows(20) == want
    assert sorted(map(str, repeated_passages(awkward(spark), hot_suffixes=0).collect())) == sorted(map(str, repeated_passages(awkward(spark)).collect()))
    assert repeated_passages(empty(spark), hot_suffixes=0).count() == 0


def slow_pairs(docs):
    """Kept lines of each document by aligning it with every earlier one, for texts whose lines are all long."""
    made, whole, kept = [], set(), {}
    for doc, text in docs:
        lines, count, keys = text.split("\n"), defaultdict(int), {}
        for i, line in enumerate(lines):
            count[line] += 1
            keys[line, count[line]] = i
        gone = set()
        for other in made:
            gone.update(common_lines([(i, other[k], len(k[0])) for k, i in keys.items() if k in other]))
        kept[doc] = "" if text in whole else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        whole.add(text)
        made.append(keys)
    return kept


def test_line_dedup_of_all_pairs_equals_brute_force(spark):
    rnd = random.Random(18)
    lines = [f"shared line {i} that the first document has reversed" for i in range(8)]
    docs = [(0, "\n".join(lines[::-1])), (1, "\n".join(lines)), (2, "\n".join([*lines, "and one that only the third document has"]))]
    assert slow_pairs(docs)[2] == "and one that only the third document has" != slow_lines(docs)[2]
    pool = [f"line number {i} with enough text to stand on its own" for i in range(40)]
    for i in range(3, 120):
        at = rnd.randrange(len(pool) - 10)
        mine = pool[at : at + rnd.randrange(10)] + rnd.sample(pool, rnd.randrange(4)) + rnd.sample(lines, rnd.randrange(4))
        if rnd.random() < 0.5:
            rnd.shuffle(mine)
        docs.append((i, "\n".join([*mine, f"only here: {i} and nowhere else at all"])))
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), all_pairs=True).collect()}
    assert got == slow_pairs(docs) != slow_lines(docs)
    few = {r.doc_id: r.n_removed for r in line_dedup(awkward(spark).drop("n_lines"), all_pairs=True).collect()}
    assert few[6] == 1 and line_dedup(empty(spark), all_pairs=True).count() == 0


def equal_words(pattern, text="d"):
    """(document, item) on one diagonal, with the same word where the pattern has a 1."""
    return [f"s{i}" if x == "1" else f"{text}{i}" for i, x in enumerate(pattern)], [f"s{i}" if x == "1" else f"i{i}" for i, x in enumerate(pattern)]


def best_overlaps(doc, item):
    bench = [(0, Words(pa.array([" ".join(item)]), plain=False).of(0))]
    return list(Index(bench).find(Words(pa.array([" ".join(doc)]), plain=False)))


def test_no_hit_hides_an_overlap():
    doc, item = equal_words("1111011110111" + "0" * 7 + "111111" + "0" * 5)
    assert best_overlaps(doc, item) == [(0, 0, 0, 13, 11)]
    rnd = random.Random(31)
    for _ in range(400):
        pattern = "".join("1" if rnd.random() < 0.7 else "0" for _ in range(rnd.randrange(14, 45)))
        least = [(a, b) for a in range(len(pattern)) for b in range(a + MIN_WORDS, len(pattern) + 1) if pattern[a] == pattern[b - 1] == "1"]
        good = [(a, b) for a, b in least if pattern[a:b].count("1") >= MIN_SAME * (b - a)]
        got = best_overlaps(*equal_words(pattern))
        assert bool(got) == bool(good), pattern
        assert all((a, b) in good for _, _, a, b, _ in got)


def test_short_items_are_found_with_every_allowed_substitution():
    for size in range(5, MIN_WORDS + 1):
        for changed in range(4):
            for places in combinations(range(size), changed):
                pattern = "".join("01"[i not in places] for i in range(size))
                doc, item = equal_words(pattern)
                got = best_overlaps(["before", "it", *doc, "behind"], item)
                assert got == ([(0, 0, 2, 2 + size, size - changed)] if size - changed >= MIN_SAME * size else []), pattern
    assert best_overlaps(["only", "four", "of", "them"], ["only", "four", "of", "them"]) == []


def test_ties_of_many_distinct_vectors_go_to_the_smaller_ids():
    rng = np.random.default_rng(9)
    quantised = np.unique(rng.integers(-1, 2, (1500, 9)), axis=0)
    for x in (np.eye(700), quantised[np.abs(quantised).sum(axis=1) > 0].astype(float)):
        x = rng.permutation(x)
        ids = rng.permutation(len(x)) * 3
        asked = np.arange(0, len(x), 17)
        rows, found, scores = Tree(ids, x, float(np.linalg.norm(x, axis=1).max()), 20).search(ids[asked], x[asked], 20, 1.0)
        for i, q in enumerate(asked.tolist()):
            product = x @ x[q]
            order = [j for j in np.lexsort((ids, -product)).tolist() if j != q][:20]
            assert found[rows == i].tolist() == ids[order].tolist()
            assert scores[rows == i].tolist() == product[order].tolist()


def split_hashes(made):
    words = Words(pa.array(made), plain=False)
    return [words.of(i) for i in range(len(made))]


def test_items_that_share_a_phrase_cost_no_step_per_occurrence():
    for phrase, many in ((10, 0), (11, 0), (13, 400)):
        shared = " ".join(f"p{i}" for i in range(phrase))
        index = Index(list(enumerate(split_hashes([f"a{i} b{i} {shared} c{i} d{i}" for i in range(400)]))))
        taken = []
        index._longest, kept = lambda words, rows, size, best: taken.append(rows.shape[1]) or kept(words, rows, size, best), index._longest
        got = list(index.find(Words(pa.array([" ".join(f"{shared} x{j}" for j in range(200))]), plain=False)))
        assert len(got) == many and all(x[2:] == (0, 13, 13) for x in got)
        assert sum(taken) == many * 200


def test_long_items_are_compared_whole():
    rnd = random.Random(8)
    item = [f"w{i}" for i in range(10_000)]
    near = [x if rnd.random() < 0.9 else "changed" for x in item]
    near[0], near[-1] = item[0], item[-1]
    for doc in (item, near):
        ((_, _, a, b, same),) = best_overlaps(["pre", *doc, "post"], item)
        assert (a, b, same) == (1, 10_001, sum(x == y for x, y in zip(doc, item, strict=True)))


def test_overlaps_over_blocks_and_short_items(spark, monkeypatch):
    made = texts(40, 5, (30, 60))
    bench = spark.createDataFrame([*enumerate(x[:200] for x in made[::4]), (70, "Two words"), (71, "no such thing")], "item_id bigint, text string")
    docs = frame(spark, [*made, "here are two words, too", "two other words"])
    one = {tuple(r) for r in overlaps(docs, bench).collect()}
    kept = {r.doc_id for r in decontaminate(docs, bench).collect()}
    monkeypatch.setattr("snapfold.llm.decontaminate.BLOCK_WORDS", 90)
    assert {tuple(r) for r in overlaps(docs, bench).collect()} == one
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == kept == set(range(42)) - {r[0] for r in one}
    short = {tuple(r) for r in overlaps(docs, bench, least=1).collect()} - one
    assert short == {(40, 70, 2, 4, 2)}


def test_lines_in_many_orders_propose_no_pairs(spark, monkeypatch):
    from snapfold.llm import lines

    seen, kept = [], lines._aligned
    monkeypatch.setattr(lines, "_aligned", lambda pairs, *rest: seen.append(pairs.count()) or kept(pairs, *rest))
    rnd, counts = random.Random(12), {}
    own = [f"line {i} of a list that everyone has" for i in range(30)]
    for n in (40, 160):
        seen.clear()
        docs = ["\n".join([*rnd.sample(own, 30), f"a line of document {i}, its own"]) for i in range(n)]
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(frame(spark, docs), all_pairs=True, rare=lines.RARE).collect()}
        counts[n] = sum(seen)
        assert got[0] == (docs[0], 0)
        assert all(got[i] == (f"a line of document {i}, its own", 30) for i in range(1, n))
    # in the later rounds a document may meet as many others as it has lines left, whatever their number
    assert counts[160] < 6 * counts[40] and counts[160] < 160 * 159 / 4
