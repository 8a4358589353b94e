"""Prefix tables against plain Python."""

import random

from pyspark.sql import functions as F

from provenant.operators import prefixes as P
from provenant.operators import tasks as K
from provenant.sources.tracelog import read_traces

from test_tasks import TASK, log


def under(path, prefix):
    return path == prefix or path.startswith(prefix if prefix.endswith("/") else prefix + "/")


def test_longest_prefix_of_many(spark):
    r = random.Random(4)
    name = lambda n: "/" + "/".join(r.choice(["a", "b", "ab", "c"]) for _ in range(r.randint(1, n)))
    paths = sorted({(r.choice("xyz"), name(7)) for _ in range(400)}) + [("x", "/"), ("x", "a")]
    given = sorted({(r.choice("xy"), name(5) + r.choice(["", "", "/"])) for _ in range(150)}) + [("x", "")]
    got = P.longest(spark.createDataFrame(paths, "s string, path string"), spark.createDataFrame(given, "s string, prefix string"), ["s"]).collect()
    assert len(got) == len(paths)
    for x in got:
        # a folder named with and without a slash holds the folder itself too
        fit = {p.rstrip("/") for s, p in given if s == x.s and p and under(x.path, p)}
        assert (x.prefix or "").rstrip("/") == max(fit, key=len, default=""), x


def test_classes_by_tables(spark):
    files = ["/l/pkg/Meta/package.rds", "/l/pkg/R/x", "/l/pkg", "/l/other/R/x", "/w/p/a", "/e/v/b", "/e/vv", "/proc/1"]
    df = spark.createDataFrame([("s", p) for p in files], "session string, path string")
    roots = P.library_roots(df)
    assert [r.prefix for r in roots.collect()] == ["/l/pkg"]
    named = spark.createDataFrame([("s", "/e/v"), ("t", "/l/other")], "session string, prefix string")
    got = {r.path: r["class"] for r in P.classes(df, "/w/p", named=named, keys=["session"], libraries=roots).collect()}
    assert [got[p] for p in files] == ["env", "env", "outside", "outside", "project", "env", "outside", "system"]
    assert P.classes(df.limit(0), "/w/p", named=named.limit(0), keys=["session"], libraries=roots.limit(0)).count() == 0


def test_missing_files_before_env_are_the_start_s(spark, tmp_path):
    lines = [("openfail", "-", "/p/early", ""), ("open", "r", "/lib1/k/R/f", "sha256=l"), ("ENV", "-", "/e/v", ""), ("openfail", "-", "/p/late", ""), ("open", "r", "/e/v/x", "sha256=e"),
             ("open", "r", "/data/in", "sha256=i"), ("open", "r", "/lib2/k/R/f", "sha256=l"), TASK("1"), ("openfail", "-", "/p/next", ""), TASK("2")]
    (tmp_path / "s.log").write_text(log(lines))
    events = read_traces(spark, str(tmp_path / "s.log")).withColumn("session", F.lit("s"))
    t = K.build(events, "/p", libraries=spark.createDataFrame([("/lib2/k",)], "prefix string"))
    assert sorted((r.task_no, r.path) for r in t.missing.collect()) == [(0, "/p/late"), (1, "/p/next")]
    assert [r.path for r in t.inputs.collect()] == ["/data/in"]
