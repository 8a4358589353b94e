"""What operators leave on disk and how many rows they go through, on small tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from provenant.operators import records as R
from provenant.session import cut, release

# Two makers of a file that two records read; a record that reads its own output; an input nobody made.
PLAIN = [("r1", "out", "a"), ("r2", "in", "a"), ("r2", "in", "raw"), ("r2", "out", "b"), ("r3", "in", "b"), ("r3", "in", "raw"), ("r3", "out", "s"), ("r1", "out", "s"), ("r4", "in", "raw"), ("r4", "out", "s")]


def files(spark, rows):
    return spark.createDataFrame([(r, role, f"/{h}", h) for r, role, h in rows], "record_id string, role string, path string, hash string")


def test_a_cut_leaves_no_shuffle_files_and_goes_when_released(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*")}
    before = shuffles()
    table = cut(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count())
    assert not shuffles() - before
    folder = os.path.dirname(table.inputFiles()[0]).removeprefix("file://")
    assert os.path.isdir(folder) and table.count() == 5_000
    release(table)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("own", [False, True])
def test_steps_between_records_leave_out_what_nobody_made(spark, own):
    rows = PLAIN + ([("r5", "out", "c"), ("r5", "in", "c")] if own else [])
    edges, per = R.record_steps(files(spark, rows), up=False)
    nodes = {x for e in edges.collect() for x in e}
    assert "h:raw" not in nodes and "h:s" not in nodes
    assert per == (2 if own else 1)
    got = {r["record_id"]: r["level"] for r in R.run_levels(files(spark, rows), files(spark, rows).select("record_id").distinct()).collect()}
    assert got == {"r1": 0, "r2": 1, "r3": 2, "r4": 0} | ({"r5": None} if own else {})


def test_many_makers_and_readers_of_a_file_are_no_pairs(spark):
    rows = [(f"m{i}", "out", "x") for i in range(40)] + [(f"u{i}", "in", "x") for i in range(40)]
    edges, per = R.record_steps(files(spark, rows))
    assert per == 2 and edges.count() == 80


def test_lineage_of_all_hashes_together_keeps_no_pairs(spark, monkeypatch):
    work_file, hashes = files(spark, PLAIN), spark.createDataFrame([("s",), ("b",)], "hash string")
    want = {r["record_id"] for r in R.lineage(work_file, hashes).collect()}
    assert {(r["hash"], r["record_id"], r["depth"]) for r in R.lineage(work_file, hashes).collect()} == {
        ("s", "r3", 0), ("s", "r1", 0), ("s", "r4", 0), ("s", "r2", 1), ("b", "r2", 0), ("b", "r1", 1)}
    roots = []
    walk = R.graph.walk
    monkeypatch.setattr(R.graph, "walk", lambda starts, *a, **k: roots.append(starts.select("root").distinct().count()) or walk(starts, *a, **k))
    got = [r["record_id"] for r in R.lineage_records(work_file, hashes).collect()]
    assert sorted(got) == sorted(want) and roots == [1]
    own = files(spark, [("r2", "out", "b")])
    assert {r["record_id"] for r in R.published_upstream(work_file, hashes, own).collect()} == {"r1", "r3", "r4"} and roots == [1, 1]


def test_an_index_for_given_files_holds_no_other(spark):
    index = R.lineage_index(files(spark, PLAIN), spark.createDataFrame([("s",)], "hash string"))
    ids = {r["id"] for r in index.places.collect()}
    assert ids == {"h:s", "r:r1", "r:r2", "r:r3", "r:r4"}


def test_the_lines_of_sessions_come_from_one_reading(spark):
    from provenant.plans import load_all, sessions
    from provenant.sources.testdata import Tables
    load_all()
    plan = sessions.events(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Union" not in plan


def lines(spark, rows):
    return spark.createDataFrame([("s", i, i, pid, ppid, op, mode, path, 0, 0, extra) for i, (pid, ppid, op, mode, path, extra) in enumerate(rows)],
                                 "session string, ord long, ts_ns long, pid long, ppid long, op string, mode string, path string, size long, mtime_ns long, extra string")


def test_only_the_tables_asked_for_are_made(spark):
    from provenant.operators import tasks as K
    traces = K.build(lines(spark, [(1, 0, "VARS", "-", "", "a=num"), (1, 0, "open", "r", "/w/x", "sha256=1"), (1, 0, "TASK", "ok", "t", "e")]), "/w")
    assert [r["name"] for r in traces.variables.collect()] == ["a"] and [r["task"] for r in traces.tasks.collect()] == ["t"]
    assert "_states" not in vars(traces)
    assert [r["path"] for r in traces.inputs.collect()] == ["/w/x"] and "_states" in vars(traces)


def test_a_child_there_before_its_parent_was_tooling_goes_from_its_next_line_on(spark):
    from provenant.operators import tasks as K
    rows = [(7, 6, "open", "r", "/w/kept", ""), (6, 1, "open", "r", "/w/kept", ""), (6, 1, "exec", "-", "/w", "env A=1 /opt/bin/watcher run"), (7, 6, "open", "r", "/w/gone", ""),
            (8, 7, "open", "r", "/w/gone", ""), (6, 1, "TASK", "ok", "nested", ""), (5, 1, "open", "r", "/w/kept", ""), (9, 1, "TASK", "ok", "t", "")]
    got = K.without_tooling(lines(spark, rows), ["watcher"]).collect()
    assert sorted(r["ord"] for r in got) == [0, 1, 5, 6, 7]
    # process 6 was traced before its marker, but its marker is the session's first
    numbered = {r["ord"]: r["task_no"] for r in K.numbered_events(lines(spark, rows), ["watcher"]).collect()}
    assert numbered == {0: 0, 1: 0, 5: 0, 6: 1, 7: 1}


@pytest.mark.parametrize("ring", [False, True])
def test_levels_are_found_once_where_nothing_is_on_a_cycle(spark, monkeypatch, ring):
    from provenant.operators import components as C
    asked, levels = [], C.graph.levels
    monkeypatch.setattr(C.graph, "levels", lambda *a, **k: asked.append(1) or levels(*a, **k))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("unknown", "a")] + ([("c", "b")] if ring else []), "src string, dst string")
    got = {r["id"]: (r["level"], r["in_cycle"], r["place"]) for r in C.order(spark.createDataFrame([(x,) for x in "abcd"], "id string"), edges).collect()}
    assert got == {"a": (0, False, 1), "b": (1, ring, 1), "c": (1 + (not ring), ring, 1 + ring), "d": (0, False, 1)}
    assert ring or len(asked) == 1
