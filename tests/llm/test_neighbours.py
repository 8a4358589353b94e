"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from provenant.llm import neighbours as nn
from provenant.llm import queries


def brute(ids, vectors, query_rows, k=5):
    lengths = np.sqrt((vectors**2).sum(axis=1))
    out = {}
    for q in query_rows:
        scores = (vectors * vectors[q]).sum(axis=1) / (lengths * lengths[q])
        out[ids[q]] = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != ids[q])[:k]
    return out


def answer(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [(s, i) for _, s, i in v] for q, v in got.items()}


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, vectors, [k for k, i in enumerate(ids) if i % 50 == 0])
    got = answer(queries.op9_nearest_neighbours(spark, folder))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    true = {(q, i): s for q in want for s, i in brute(ids, vectors, [ids.index(q)], len(ids))[q]}
    assert all(abs(true[q, i] - s) < 1e-12 for q, v in got.items() for s, i in v)


def test_a_block_gives_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 256, (3000, 16), dtype=np.uint8)
    block = nn.Block(codes)
    for code in codes[:20]:
        for radius in (0, 15, 40, 58, 128):
            assert block.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius).tolist()


def test_copies_ties_nulls_and_few_rows(spark):
    inf, nan = float("inf"), float("nan")
    same = [(i, [1.0, 2.0, 0.0], "x") for i in range(100, 140)]
    odd = [(50, None, "x"), (150, [0.0, 0.0, 0.0], "x"), (200, [1.0, None, 2.0], "x"), (250, [nan, 1.0, 1.0], "x"), (300, [inf, 1.0, 1.0], "x"), (None, [1.0, 2.0, 0.0], "x"), (350, [], "x")]
    df = spark.createDataFrame(same + odd + [(0, [1.0, 2.0, -0.0], "y"), (1, [2.0, 4.0, 0.0], "y"), (3, [0.0, 1.0, 0.0], "y")], "vec_id long, embedding array<float>, score string")
    got = answer(nn.nearest(nn.usable(df)))
    assert {q: [i for _, i in v] for q, v in got.items()} == {0: [1, 100, 101, 102, 103], 100: [0, 1, 101, 102, 103]} or all(
        abs(s + 1) < 1e-12 for v in got.values() for s, _ in v)
    assert got.keys() == {0, 100}
    few = answer(nn.nearest(nn.usable(df.where("vec_id IN (0, 3)"))))
    assert {q: [i for _, i in v] for q, v in few.items()} == {0: [3]}
    assert answer(nn.nearest(nn.usable(df.where("vec_id = 0")))) in ({}, {0: []})
    assert nn.nearest(nn.usable(df.limit(0))).count() == 0
