"""Exact top-k inner products against brute force."""

import numpy as np
import pytest

from provenant.llm import scaled, topk


def brute(rows, every=50, wanted=5):
    """Answers of each query row: (score, id) in order; rows are (id, floats), each different one once."""
    rows = sorted({(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows})
    out = {}
    for i, v in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if (j, w) != (i, v))
            out.setdefault(i, []).append([(k + 1, j, -s) for k, (s, j) in enumerate(scores[:wanted])])
    return {i: sorted(sum(a, [])) for i, a in out.items() if sum(a, [])}


def answer(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: sorted(a) for i, a in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    return [(i, (centres[i % 12] + 0.1 * r.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("make", [clustered, lambda n, d, s: [(i, v) for i, v in enumerate(np.random.default_rng(s).standard_normal((n, d)).tolist())]])
def test_blocks_and_passes_against_brute_force(spark, make, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "GROWTH", 3)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 4)
    rows = make(700, 12, 5)
    rows += [(10_000 + i, rows[7][1]) for i in range(300)]  # many copies of one vector
    assert answer(topk.best(scaled.usable(frame(spark, rows)))) == brute(rows)


def test_ties_repeats_few_rows_and_odd_values(spark):
    rows = [(i, [1.0, 0.5, -1.0]) for i in range(0, 120)] + [(50, [1.0, 0.5, -1.0]), (50, [0.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0]), (100, [-0.0, 0.0, 0.0]), (-50, [0.001, -0.001, 0.3])]
    assert answer(topk.best(scaled.usable(frame(spark, rows)))) == brute(rows)
    assert answer(topk.best(scaled.usable(frame(spark, [(50, [1.0]), (1, [2.0])])))) == {50: [(1, 1, 256 * 512)]}
    assert answer(topk.best(scaled.usable(frame(spark, [(50, [1.0])])))) == {}
    inf, nan = float("inf"), float("nan")
    odd = spark.createDataFrame(
        [(50, [1.0, 2.0], "a"), (1, [1.0, 1.0], "b"), (2, None, "c"), (3, [nan, 1.0], "d"), (4, [inf, 1.0], "e"), (5, [None, 1.0], "f"), (None, [1.0, 1.0], "g"), (6, [], "h"), (8, [1e300, 1.0], "i"), (100, [1.0], None)],
        "vec_id long, embedding array<double>, score string")
    assert answer(topk.best(scaled.usable(odd))) == {50: [(1, 1, 256 * 256 * 3)]}
    assert topk.best(scaled.usable(odd.limit(0))).collect() == []


def test_lists_lose_no_row_and_end_early():
    r = np.random.default_rng(3)
    for v, most in ((np.array([x for _, x in clustered(3000, 24, 9)]), 0.7), (r.standard_normal((3000, 24)), 1.0)):
        v = np.floor(256 * v).astype(np.int64)
        order = np.argsort(v, axis=0, kind="stable").T
        lists = topk.Lists(np.take_along_axis(v.T, order, axis=1), order, (v.astype(float) ** 2).sum(axis=1)[order])
        scores = v[:20] @ v.T
        best = np.sort(scores, axis=1)[:, -6]
        for floors in (np.full(20, -np.inf), best.astype(float), np.where(np.arange(20) % 2, best, -np.inf)):
            found = {i: (inside, depth) for i, inside, depth in lists.left_over(v[:20], 5, floors)}
            assert len(found) == 20
            for i, (inside, depth) in found.items():
                assert set(np.flatnonzero(scores[i] >= best[i])) <= set(inside.tolist())
                assert len(inside) <= topk.LEFT or depth == len(v)
        assert np.mean([depth for _, depth in found.values()]) <= most * len(v)
    ((_, inside, _),) = lists.left_over(np.zeros((1, 24), np.int64), 5, np.array([-np.inf]))
    assert inside.tolist() == list(range(6))


def test_many_equal_scores_and_zero_queries(spark):
    rows = [(i, [0.0, 0.0] if i % 3 == 0 else [0.1 * (i % 5), 0.0]) for i in range(900)] + [(5000 + i, [0.0, 0.001 * i]) for i in range(200)]
    assert answer(topk.best(scaled.usable(frame(spark, rows)))) == brute(rows)
