"""Signatures against true similarities, classes against all pairs."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from provenant.llm import nearduplicates as nd
from provenant.llm.common import words


def bag_of(text):
    found = words(text)
    size = min(nd.SHINGLE, len(found))
    return Counter(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if found else Counter()


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute(texts):
    """Class (smallest id) of each id by comparing all pairs that share a shingle."""
    bags = {i: bag_of(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if bags[a] and bags[b] and min(map(sum, (bags[a].values(), bags[b].values()))) >= nd.SIMILARITY * max(map(sum, (bags[a].values(), bags[b].values()))):
            if similarity(bags[a], bags[b]) >= nd.SIMILARITY:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in texts}


def classes_of(df):
    return {r.doc_id: r.class_id for r in nd.classes(df).collect()}


def test_slots_agree_as_often_as_the_bags_are_similar():
    r = np.random.default_rng(5)
    for heavy in (1, 3, 40, 1000):
        keys = r.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = (r.integers(0, heavy + 1, 60) for _ in range(2))
        bags = [(np.sort(keys[w > 0]), w[w > 0][np.argsort(keys[w > 0])]) for w in (a, b)]
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = nd.signatures(bags, 4096)
        assert (s != nd._NEVER).all()
        assert abs((s[0] == s[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / 4096) + 1e-3
        assert abs(nd.overlap(*bags) - want) < 1e-12
        assert (nd.signatures(bags[:1], 4096) == s[:1]).all()  # neighbours in a batch do not matter


@pytest.fixture(scope="module")
def copies():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    texts, n = {}, 0
    for size in (1, 2, 3, 60):
        base = r.choices(vocabulary, k=120)
        for k in range(size):
            w = list(base)
            for _ in range(k % 5):
                w[r.randrange(len(w))] = "x" + str(r.randrange(99))
            texts[n := n + 1] = " ".join(w)
    base = r.choices(vocabulary, k=100)
    for k in range(70):  # most are near few others only
        w = list(base)
        for _ in range(k % 18):
            w[r.randrange(len(w))] = "y" + str(r.randrange(999))
        texts[n := n + 1] = " ".join(w)
    chain = r.choices(vocabulary, k=200)  # each is near the next one only
    for k in range(12):
        texts[n := n + 1] = " ".join(chain[k * 8 : k * 8 + 100])
    passage = " ".join(r.choices(vocabulary, k=30))
    for _ in range(25):
        texts[n := n + 1] = " ".join(r.choices(vocabulary, k=60)) + " " + passage
    for t in ("one two", "One, TWO!", "one", "b b b b b b b b", "b b b b b b b b b", " ".join(["la"] * 500), " ".join(["la"] * 450), " ".join(["la"] * 300), "tail " * 20_000):
        texts[n := n + 1] = t
    return texts


@pytest.mark.parametrize("few,block", [(16, 4096), (3, 8)])
def test_classes_equal_those_of_all_pairs(spark, copies, monkeypatch, few, block):
    for name, value in (("FEW", few), ("CENTRES", block // 2), ("MEMBERS", block)):
        monkeypatch.setattr(nd, name, value)
    df = spark.createDataFrame([(i, t, 0) for i, t in copies.items()], "doc_id long, text string, class_id int")
    assert classes_of(df) == brute(copies)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "  ..."), (None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (9, "A b c d e f"), (9, "q r s t u v"), (10, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.class_size) for r in nd.classes(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, 1), (2, 0, 2, 1), (3, 0, 3, 1), (None, 0, None, 1), (None, 0, None, 1), (4, 2, 4, 5), *[(9, 2, 4, 5)] * 3, (10, 2, 4, 5)], key=str)
    assert nd.classes(df.limit(0)).count() == 0


def test_classes_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert classes_of(docs) == brute({r.doc_id: r.text for r in docs.collect()})
