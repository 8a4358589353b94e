"""Hard negatives against brute force."""

import itertools

import numpy as np
import pytest

from provenant.llm import hardnegatives as hn
from provenant.llm import scaled


def brute(rows, every=100):
    rows = sorted({(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, label, v in rows})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        for p, j in sorted((-dot(v, w), k) for k, other, w in rows if other == label and k != i)[:5]:
            fit = sorted((-dot(v, w), k) for k, other, w in rows if other != label and k != i and 30 * -p <= 100 * dot(v, w) <= 90 * -p)
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(fit[:10])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, None if v is None else [float(x) for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<double>")


def answer(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(df):
    return hn.mine(scaled.usable(df, keep={"label": df["label"]}))


def test_the_curve_visits_every_cell_one_step_at_a_time():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hn.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    r = np.random.default_rng(1)
    rows, anchors = r.integers(-300, 300, (200, 9)), r.integers(-300, 300, (30, 9))
    low, high = hn.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (low <= scores.min(axis=1, keepdims=True)).all() and (high >= scores.max(axis=1, keepdims=True)).all()


@pytest.mark.parametrize("clusters", [0, 20])
def test_blocks_against_brute_force(spark, clusters, monkeypatch):
    for name, value in (("BLOCK", 25), ("ANCHORS_AT_ONCE", 3), ("ZONES_AT_ONCE", 8), ("BLOCKS_A_FILE", 4)):
        monkeypatch.setattr(hn, name, value)
    r = np.random.default_rng(4)
    centres = r.standard_normal((max(1, clusters), 10)) * 2
    rows = [(i, int(r.integers(0, 4)), ((centres[i % clusters] if clusters else 0) + (0.2 if clusters else 1) * r.standard_normal(10)).tolist()) for i in range(900)]
    rows += [(20_000 + i, i % 4, rows[3][2]) for i in range(300)]  # copies of one vector
    rows += [(30_000, 1, rows[3][2]), (30_100, 9, rows[5][2])]
    assert answer(mined(frame(spark, rows))) == brute(rows)


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 50)
    r = np.random.default_rng(6)
    centres = r.standard_normal((40, 16)) * 3
    rows = frame(spark, [(i, i % 5, (centres[i % 40] + 0.05 * r.standard_normal(16)).tolist()) for i in range(4000)])
    blocks = hn.blocks_of(scaled.usable(rows, keep={"label": rows["label"].cast("long")}).selectExpr("id", "label", "v", "id % 100 = 0 AS asks"))
    anchors = hn._anchors(blocks)
    home = hn._found(blocks, anchors, hn._home(anchors), 5, True)
    need = hn.chosen(blocks, hn._floored(anchors, home, 5), True).count()
    assert need < 0.5 * anchors.count() * blocks.count()


def test_ties_repeats_nulls_and_empty_tables(spark):
    same = [(i, i % 2, [1.0, 1.0]) for i in range(60, 240)] + [(100, 0, [1.0, 1.0]), (100, 1, [0.5, 0.6]), (200, 0, [-1.0, 0.0]), (7, 1, [0.5, 0.5]), (8, 1, [0.6, 0.4])]
    assert answer(mined(frame(spark, same))) == brute(same)
    odd = [(300, None, [1.0, 1.0]), (300, 1, None), (301, 1, [float("nan"), 1.0]), (302, 1, [float("inf"), 1.0]), (303, 1, [])]
    assert answer(mined(frame(spark, same + odd))) == brute(same)
    assert answer(mined(frame(spark, same).where("label = 0"))) == []
    assert answer(mined(frame(spark, same).limit(0))) == []
    zero = [(100, 0, [0.0, 0.0]), (1, 0, [1.0, 1.0]), (2, 1, [1.0, 1.0]), (3, 1, [2.0, 1.0])]
    assert answer(mined(frame(spark, zero))) == brute(zero) and len(brute(zero)) == 2
