import random
import re
from itertools import combinations

import numpy as np
import pytest

from loomspan.llm import ngram_join as nj
from loomspan.llm.common import Scratch, span_hashes, text_chunks, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed, families=12, copies=25, edits=6):
    """Families of edited copies, chains of drifting copies, texts that share a passage, and short texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(r.randint(6, 150))]
        drift = list(base)
        for _ in range(r.randint(1, copies)):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(len(own))] = r.choice(vocab)
            texts.append(own)
            drift[r.randrange(len(drift))] = r.choice(vocab)
            texts.append(list(drift))
    for _ in range(60):
        own = [r.choice(vocab) for _ in range(r.randint(1, 40))]
        texts.append(own[: len(own) // 2] + passage + own[len(own) // 2 :])
    texts += [["a"], ["a"], ["a", "b"], ["A", "B"], ["b", "a"], ["a"] * 40, ["a"] * 50]
    r.shuffle(texts)
    return [(i, r.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]


def run(spark, docs, schema="doc_id long, text string"):
    return nj.ngram_components(spark.createDataFrame(docs, schema), Scratch(spark, "t"))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, docs).collect()}
    assert got == brute(docs)


def test_heavy_shingles_salted_groups_and_blocks(spark, monkeypatch):
    """Small bounds: every shared shingle is heavy, groups are salted, tries and blocks are many."""
    for name, value in (("HEAVY_LEAST", 2), ("GROUP", 7), ("BLOCK", 5), ("TRIE_TOKENS", 300), ("BUCKET", 500), ("BEST", 1)):
        monkeypatch.setattr(nj, name, value)
    docs = near_copies(3, families=6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, docs).collect()}
    assert got == brute(docs)


def links(docs):
    """Each document's class (smallest id with its set) and the other classes that it links with, by brute force."""
    sets = {d: shingles(t) for d, t in docs}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    count = dict.fromkeys(first, 0)
    for a, b in combinations(first, 2):
        both = len(a & b)
        if both and 100 * both >= 75 * len(a | b):
            count[a] += 1
            count[b] += 1
    return {d: (first[s] if s else d, count[s]) for d, s in sets.items()}


def got_links(spark, docs):
    return {r.doc_id: (r.class_id, r.n_links) for r in run(spark, docs).collect()}


def test_all_links_are_counted(spark):
    docs = near_copies(5)
    want = links(docs)
    assert got_links(spark, docs) == want and max(n for _, n in want.values()) > 5


def test_links_across_blocks_and_in_matrices(spark, monkeypatch):
    for name, value in (("BLOCK", 5), ("TRIE_TOKENS", 2000), ("CELLS", 200), ("FEW", 3)):
        monkeypatch.setattr(nj, name, value)
    docs = near_copies(6, families=5)
    assert got_links(spark, docs) == links(docs)


def test_a_group_of_near_copies_has_all_its_links(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base, f"end{i}"])) for i in range(300)]
    assert set(got_links(spark, docs).values()) == {(i, 299) for i in range(300)}


def test_a_text_without_an_id_links_others(spark):
    word = [f"w{i}" for i in range(90)]
    docs = [(1, " ".join(word[:60])), (None, " ".join(word[6:66])), (2, " ".join(word[12:72])), (None, " ".join(word[6:66])), (3, "x y z")]
    got = sorted((r.doc_id or 0, r.component_id, r.n_links) for r in run(spark, docs).collect())
    assert got == [(0, 1, 2), (0, 1, 2), (1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_trie_join_against_sets():
    r = np.random.default_rng(4)
    for _ in range(40):
        pivot = np.unique(r.integers(0, 400, r.integers(1, 120), dtype=np.uint64))
        sets = []
        for _ in range(60):
            own = pivot[r.random(len(pivot)) < r.uniform(0.7, 1)]
            own = np.unique(np.concatenate((own, r.integers(0, 400, r.integers(0, 20), dtype=np.uint64))))
            if len(own):
                sets.append(own)
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(pivot, s)) >= 75 * len(np.union1d(pivot, s))]
        assert sorted(nj.trie_join(pivot, sets)) == want


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab  cé\td", "", None, "x", " \n ", "e f"]
    (_, data, rows), = text_chunks(pa.array(texts))
    s, e, row = words(data, rows)
    assert [(bytes(data[a:b]).decode(), int(k)) for a, b, k in zip(s, e, row, strict=True)] == [("Ab", 0), ("cé", 0), ("d", 0), ("x", 3), ("e", 5), ("f", 5)]
    assert len(set(span_hashes(data, s, e).tolist())) == 6


def test_texts_that_collide_in_polynomial_hashes(spark):
    """Thue-Morse words have equal polynomials modulo 2**64 for any odd multiplier; they are different words."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word), (2, other), (3, f"{word} x y z u"), (4, f"{other} x y z u"), (5, word[:8]), (6, other[:8])]
    assert {r.doc_id: (r.component_id, r.n_links) for r in run(spark, docs).collect()} == {i: (i, 0) for i in range(1, 7)}


def test_classes_that_share_a_number_are_told_apart(spark):
    """With numbers of eight bits most classes share theirs."""
    docs = near_copies(8, families=8)
    got = nj.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"), class_bits=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == links(docs)


def test_prefix_tree_passes_over_subtrees(monkeypatch):
    """Sets that share a long path without the pivot's shingles cost one step on it, not one each."""
    pivot = np.arange(1000, 1100, dtype=np.uint64)
    poor = [np.concatenate((np.arange(90), pivot[i : i + 10])).astype(np.uint64) for i in range(80)]
    good = [np.sort(np.append(np.delete(pivot, i), 5000 + i)).astype(np.uint64) for i in range(5)]
    asked = []
    monkeypatch.setattr(nj, "required", lambda n, m, f=nj.required: asked.append(1) or f(n, m))
    assert sorted(nj.trie_join(pivot, poor + good)) == [80, 81, 82, 83, 84]
    assert len(asked) < 40


def test_edges(spark):
    long_ = "the same long text again and again " * 4000
    docs = [(1, None), (2, ""), (3, " \n"), (None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, long_), (6, long_ + "x")]
    rows = run(spark, docs).collect()
    got = {(r.doc_id, r.component_id) for r in rows}
    assert len(rows) == 8 and got == {(1, 1), (2, 2), (3, 3), (None, 4), (4, 4), (5, 5), (6, 5)}
    extra = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS n", "2 AS label", "3 AS rank")
    assert nj.ngram_components(extra, Scratch(spark, "t")).count() == 8
    assert run(spark, []).count() == 0 and run(spark, [(1, None)]).count() == 1
