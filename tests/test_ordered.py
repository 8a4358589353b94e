import random

from pyspark.sql import functions as F

from provenant.operators.ordered import Scan, asof, following, numbered, previous, scan


def rows(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", "b", "c", None]), i if r.random() < 0.8 else i - 1, i, r.choice([None, r.randrange(100)])) for i in range(n)]


def plain(data, reverse):
    out, state = [], {}
    for k, t, i, v in sorted(data, key=lambda x: (x[1], x[2]), reverse=reverse):
        s = state.setdefault(k, {"sum": None, "last": None, "max": None})
        before = (s["sum"], s["last"])
        if v is not None:
            s["sum"], s["last"], s["max"] = (s["sum"] or 0) + v, v, v if s["max"] is None else max(v, s["max"])
        out.append((i, s["sum"], s["last"], s["max"], *before))
    return sorted(out)


def check(spark, reverse):
    data = rows(7 + reverse)
    df = spark.createDataFrame(data, "k string, t bigint, i bigint, v bigint")
    scans = [Scan("s", "sum", F.col("v")), Scan("l", "last", F.col("v")), Scan("m", "max", F.col("v")),
             Scan("s0", "sum", F.col("v"), False), Scan("l0", "last", F.col("v"), False)]
    got = scan(df, ["k"], ["t", "i"], scans, reverse=reverse).select("i", "s", "l", "m", "s0", "l0").collect()
    assert sorted(tuple(r) for r in got) == plain(data, reverse)


def test_running_values(spark):
    check(spark, False)
    check(spark, True)


def test_running_values_of_split_keys(spark, split_keys):
    check(spark, False)
    check(spark, True)


def test_asof_is_the_last_row_before(spark, split_keys):
    r = random.Random(3)
    left = [(r.choice("ab"), r.randrange(200), i) for i in range(150)]
    right = [(r.choice("ab"), r.randrange(200), 1000 + i) for i in range(150)]
    ldf = spark.createDataFrame(left, "k string, t bigint, i bigint")
    rdf = spark.createDataFrame(right, "k string, u bigint, v bigint")
    for equal in (True, False):
        got = {x["i"]: x["got"] for x in asof(ldf, rdf, ["k"], "t", "u", F.col("v"), "got", right_tie=["v"], include_equal=equal).collect()}
        for k, t, i in left:
            cands = [(u, v) for k2, u, v in right if k2 == k and (u <= t if equal else u < t)]
            assert got[i] == (max(cands)[1] if cands else None)


def test_neighbours_and_numbers(spark, split_keys):
    df = spark.createDataFrame([("x", i, i * i) for i in range(30)], "k string, t bigint, v bigint")
    p = {x["t"]: x["p"] for x in previous(df, ["k"], ["t"], "p", F.col("v")).collect()}
    f = {x["t"]: x["f"] for x in following(df, ["k"], ["t"], "f", F.col("v")).collect()}
    n = {x["t"]: x["n"] for x in numbered(df, ["k"], ["t"], "n").collect()}
    assert all(p[i] == (None if i == 0 else (i - 1) ** 2) and f[i] == (None if i == 29 else (i + 1) ** 2) and n[i] == i + 1 for i in range(30))
