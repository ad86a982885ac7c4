"""Line dedup and near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from papyrion.llm import common, graph, line_dedup, near_dup

WORDS = [f"w{i}" for i in range(400)]


def words(text, low=True):
    return (text or "").encode().lower().split() if low else (text or "").encode().split()


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def edited(rng, text, rate):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split(" "))


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.choice([3, 20, 60, 200]))) for _ in range(8)]
    lines = lambda: [rng.choice(base) if rng.random() < 0.4 else edited(rng, rng.choice(base), rng.choice([0.01, 0.03, 0.1])) for _ in range(rng.randint(1, 5))]
    texts = ["\n".join(lines()) for _ in range(n)]
    return texts + [None, "", " \n\t", "\n", texts[0], texts[1].upper(), "one", "one", "a\n\na\n"]


def test_hashed_words_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(common, "_BLOCK", 64)
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("aAbBé \n\t\x0b\x1c") for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(rng.randint(0, 12))]
        hashes, at = common.words_by_text(pa.array(texts, pa.string()))
        own = [words(t) for t in texts]
        assert [len(w) for w in own] == np.diff(at).tolist()
        named = {}
        assert all(named.setdefault(w, h) == h for w, h in zip((w for x in own for w in x), hashes.tolist(), strict=True))
        assert len(set(named.values())) == len(named)


def test_long_words_across_block_edges(monkeypatch):
    rng = random.Random(3)
    runs = ["".join(rng.choice("abcé漢字") for _ in range(n)) for n in (12_000, 400_000)]
    texts = [f"one {runs[0]} two", runs[1], f"{runs[1]}x {runs[0]}", f"one {runs[0]} two", runs[1].upper(), f"three {runs[1]}", ""]
    alone = [common.words_by_text(pa.array([t]))[0].tolist() for t in texts]
    assert [len(x) for x in alone] == [len(t.split()) for t in texts]
    for block in (common._BLOCK, 5_000, 2**22):
        monkeypatch.setattr(common, "_BLOCK", block)
        for size in (0, common._BLOCK - 6_000, common._BLOCK - 1, common._BLOCK):
            filler = ("ab " * (size // 3 + 1))[: max(size, 0)]
            hashes, at = common.words_by_text(pa.array([filler, *texts]))
            assert [hashes[at[i] : at[i + 1]].tolist() for i in range(1, len(texts) + 1)] == alone
    assert alone[0] == alone[3] and alone[0][1] == alone[2][1] and alone[1][0] == alone[5][1] != alone[2][0]


def test_near_duplicates_with_a_long_word(spark):
    run, filler = "漢字かな" * 5_000, "some words to fill a block "
    texts = [filler * 9_600, run, run, filler * 9_650, f"{run} a", run]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = brute_components(list(enumerate(texts)), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, 3, 85).collect()} == want


def brute_lines(rows, width=5, percent=80):
    """Removed (doc_id, line) by comparing every line to every earlier one."""
    seen = sorted({(d, i, frozenset(shingles(x, width))) for d, t in rows if t is not None and d is not None for i, x in enumerate(t.split("\n"))}, key=lambda r: r[:2])
    gone = set()
    for k, (d, i, s) in enumerate(seen):
        if s and any(e and 100 * len(s & e) >= percent * len(s | e) for _, _, e in seen[:k]):
            gone.add((d, i))
    return gone


@pytest.mark.parametrize(("seed", "width"), [(1, 1), (2, 1), (3, 5)])
def test_line_dedup(spark, seed, width):
    rows = list(enumerate(corpus(seed))) + [(0, corpus(seed)[0]), (None, corpus(seed)[2])]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    gone = brute_lines(rows, width)
    out = line_dedup.dedup_lines(docs, width).collect()
    assert len(out) == len(rows)
    source = dict(rows)
    for r in out:
        text = source[r["doc_id"]]
        if text is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        kept = [x for i, x in enumerate(text.split("\n")) if (r["doc_id"], i) not in gone]
        assert r["text"] == "\n".join(kept), r["doc_id"]
        assert r["n_removed_lines"] == sum(1 for d, _ in gone if d == r["doc_id"]) and r["n_lines"] == len(text.split("\n"))
    assert gone


def found_lines(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r["doc_id"], i) for r in line_dedup.removed_lines(docs, **settings).collect() for i in r["lines"]}


def word_edits(seed, n=150):
    """Lines of 8 to 20 words out of few, each an edit of a line by a word or two; some texts have two lines, and ids that floats don't tell apart."""
    rng = random.Random(seed)
    base = [rng.choices(WORDS[:60], k=rng.randint(8, 20)) for _ in range(12)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rng.randint(1, 2)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            lines.append(" ".join(line))
        rows.append((2**60 + k if k % 3 else k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"SMALL_LIST": 3, "LARGE_LIST": 10}, {"PART_ENTRIES": 1}, {"SMALL_LIST": 2, "LARGE_LIST": 1, "PART_ENTRIES": 4}])
def test_one_word_edits_in_short_lines(spark, monkeypatch, limits):
    """Short lists, long ones, lists of which only the earliest are looked at, and tokens dealt to many tasks find the same."""
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = word_edits(7)
    gone = brute_lines(rows, 1)
    assert found_lines(spark, rows) == gone and len(gone) > 60


def test_a_hot_prefix_token_and_a_chain_of_edits(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_LIST", 8)
    # numbered lines share all words but their number and aren't similar; each line of the chain is similar to its neighbours only
    rows = [(k, f"item {k} of the list") for k in range(300)]
    rows += [(1000 + k, " ".join(f"c{i}" for i in range(k, k + 20))) for k in range(40)]
    rows += [(2000, "long " * 3 + " ".join(f"l{i}" for i in range(30_000))), (2001, " ".join(f"l{i}" for i in range(29_000)))]
    gone = {(1000 + k, 0) for k in range(1, 40)} | {(2001, 0)}
    assert found_lines(spark, rows) == gone


def test_classes_that_share_a_key_are_told_apart(spark):
    """Sets by key and check: of two classes with one key, only the one that is similar goes."""
    sets = spark.createDataFrame([(1, 10, 0, 0, [1, 2, 3, 4, 5]), (7, 11, 1, 0, [1, 2, 3, 4, 5, 6]), (7, 12, 2, 0, [9, 8])], "key long, check long, doc_id long, line long, tokens array<long>")
    pairs = spark.createDataFrame([(7, 1)], "x long, y long")
    assert [tuple(r) for r in line_dedup._similar_later(pairs, sets, 80).collect()] == [(7, 11)]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_components(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("seed", "width", "percent", "block"), [(1, 3, 85, 2048), (2, 5, 80, 2048), (3, 3, 85, 3)])
def test_near_duplicates(spark, monkeypatch, seed, width, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", block)
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.choice([2, 40, 300]))) for _ in range(5)]
    texts = [edited(rng, rng.choice(base), rng.choice([0, 0.01, 0.02, 0.05])) for _ in range(50)] + [None, "", "  ", "one", "One", "two words"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows] + [(None, texts[0], 0)], "doc_id long, text string, rep int").repartition(3)
    want = brute_components(rows, width, percent)
    out = near_dup.near_duplicates(docs, width, percent).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_links_across_homes(spark, monkeypatch):
    """Chains of edits: neighbours are linked, ends are not even candidates, so links are found beside homes as well; in one block and in many."""
    rng = random.Random(5)
    rows = []
    for c in range(12):
        text = rng.choices(WORDS, k=120)
        for k in range(12):
            rows.append((rng.randrange(10**6) * 200 + len(rows), " ".join(text)))
            text = list(text)
            for _ in range(2):
                text[rng.randrange(len(text))] = f"n{c}_{k}"
    want = brute_components(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (2048, 2):
        monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", block)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, 3, 85).collect()} == want
    assert len({c for _, c in want.values()}) < 100


def test_pairs_are_confirmed_on_full_sets(spark):
    sets = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4, 5], 3: [7, 8], 4: [1, 2, 9, 4]}
    out = near_dup._confirmed(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "x long, y long"), spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>"), 80)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.85, 0.9, 0.95):
        both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        rest = [rng.integers(0, 2**63, int((2000 - len(both)) / 2), dtype=np.uint64) for _ in range(2)]
        a, b = (near_dup.odd_sketch(near_dup.minhash(np.concatenate((both, r)))).view(np.uint64) for r in rest)
        assert np.bitwise_count(a ^ b).sum() <= near_dup.most_differing_bits(share)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, b) for b in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and a != b:
            group = {x for x, r in root.items() if r in (root.get(a, a), root.get(b, b))} | {a, b}
            root |= dict.fromkeys(group, min(group))
    assert got == {n: r for n, r in root.items() if n != r}
