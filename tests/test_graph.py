import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import graph


def edges_of(seed, n=40, m=55):
    r = random.Random(seed)
    return sorted({(str(r.randrange(n)), str(r.randrange(n))) for _ in range(m)})


def reach(edges, start):
    depth, layer, seen = 0, {start}, {start: 0}
    while layer:
        depth += 1
        layer = {b for a, b in edges if a in layer} - set(seen)
        seen.update({x: depth for x in layer})
    return seen


@pytest.mark.parametrize("many", [True, False])
def test_walk_with_cycles(spark, many):
    edges = edges_of(1 + many) + ([] if many else [(f"x{i}", f"x{i + 1}") for i in range(300)])
    starts = sorted({a for a, _ in edges}) if many else ["0"]
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(x, x) for x in starts], "root string, node string")
    got = {(r["root"], r["node"]): r["depth"] for r in graph.walk(s, e).collect()}
    assert got == {(x, y): d for x in starts for y, d in reach(edges, x).items()}


def test_walk_where_doubling_would_be_too_large(spark, monkeypatch):
    edges = edges_of(9, 20, 60)
    monkeypatch.setattr(graph, "_doubled", lambda jumps, limit: None)
    e = spark.createDataFrame(edges, "src string, dst string")
    starts = sorted({a for a, _ in edges})
    s = spark.createDataFrame([(x, x) for x in starts], "root string, node string")
    got = {(r["root"], r["node"]): r["depth"] for r in graph.walk(s, e).collect()}
    assert got == {(x, y): d for x in starts for y, d in reach(edges, x).items()}


def test_bounded_walk(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "src string, dst string")
    s = spark.createDataFrame([("0", "0")], "root string, node string")
    assert {r["node"] for r in graph.walk(s, e, max_hops=3).collect()} == {"0", "1", "2", "3"}


def test_chase_finds_roots_gaps_and_cycles(spark):
    nodes = [("s", None, True)] + [(f"c{i}", f"c{i - 1}" if i else "s", False) for i in range(37)]
    nodes += [("g0", "missing", False), ("g1", "g0", False), ("n", None, False), ("n1", "n", False), ("y0", "y1", False), ("y1", "y2", False), ("y2", "y0", False), ("z", "y0", False)]
    got = {r["id"]: (r["state"], r["dist"]) for r in graph.chase(spark.createDataFrame(nodes, "id string, prev string, is_root boolean")).collect()}
    assert len(got) == len(nodes) and got["s"] == ("root", 0)
    assert all(got[f"c{i}"] == ("root", i + 1) for i in range(37))
    assert {got[x][0] for x in ("g0", "g1", "n", "n1")} == {"gap"} and {got[x][0] for x in ("y0", "y1", "y2", "z")} == {"cycle"}


def longest(edges, nodes):
    level = {}
    todo = set(nodes)
    while True:
        ready = {n for n in todo if all(a in level for a, b in edges if b == n and a != b)}
        if not ready:
            return {n: level.get(n) for n in nodes}
        for n in ready:
            level[n] = max([level[a] + 1 for a, b in edges if b == n and a != b], default=0)
        todo -= ready


@pytest.mark.parametrize("doubling", [True, False])
def test_levels_with_a_cycle(spark, monkeypatch, doubling):
    if not doubling:
        monkeypatch.setattr(graph, "_doubled", lambda jumps, limit: None)
    r = random.Random(5)
    edges = sorted({(f"{a:02}", f"{b:02}") for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a < b})
    edges += [(f"{i}", f"{i + 1}") for i in range(30, 48)] + [("p", "q"), ("q", "p"), ("q", "behind")]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    got = graph.levels(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {x["id"]: x["level"] for x in got.collect()} == longest(edges, nodes)


def test_producible_needs_all_inputs_and_no_cycle(spark):
    makes = [("m1", "b"), ("m2", "c"), ("m3", "d"), ("m4", "x"), ("m5", "y"), ("m6", "e")]
    needs = [("m1", "a"), ("m2", "b"), ("m2", "a"), ("m3", "gone"), ("m4", "y"), ("m5", "x")]
    got = graph.producible(spark.createDataFrame([("a",)], "item string"), spark.createDataFrame(makes, "maker string, item string"),
                           spark.createDataFrame(needs, "maker string, item string")).select("item").toPandas()["item"]
    assert sorted(got) == ["a", "b", "c", "e"]


def test_order_of_rows_does_not_matter(spark):
    edges = edges_of(4)
    s = spark.createDataFrame([("0", "0"), ("1", "1")], "root string, node string")
    a = graph.walk(s, spark.createDataFrame(edges, "src string, dst string"))
    b = graph.walk(s, spark.createDataFrame(edges[::-1], "src string, dst string").repartition(7).orderBy(F.rand(3)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
