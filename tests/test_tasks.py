import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import links as L
from provenant.operators import tasks as K
from provenant.sources.tracelog import read_traces

HEADER = "#xtrace v2\thash=/p:/q\n"


def log(lines):
    """(op, mode, path, extra[, ts[, pid[, ppid[, mtime]]]]) as text of a log."""
    text = HEADER
    for i, line in enumerate(lines):
        op, mode, path, extra, ts, pid, ppid, mtime = (*line, *(None,) * (8 - len(line)))
        text += "\t".join(map(str, [ts if ts is not None else (i + 1) * 1000, pid or 5, ppid or 1, op, mode, path, 1, mtime or 0, 9, extra or "-"])) + "\n"
    return text


def build(spark, tmp_path, lines, **kw):
    f = tmp_path / "s.log"
    f.write_text(log(lines))
    return K.build(read_traces(spark, str(f)), "/p", **kw)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


TASK = lambda n, mode="ok": ("TASK", mode, n, "expr " + n, None, 1)


def test_smallest_case(spark, tmp_path):
    t = build(spark, tmp_path, [
        ("open", "r", "/p/raw.csv", "sha256=aaa"), ("open", "w", "/p/clean.csv", "new=1"), ("closew", "-", "/p/clean.csv", "sha256=bbb"), TASK("1"),
        ("open", "r", "/p/clean.csv", "sha256=bbb"), TASK("2")])
    assert pairs(t.tasks, "task_no", "task", "status") == [(0, "1", "ok"), (1, "2", "ok")]
    assert pairs(t.inputs, "task_no", "path", "sha") == [(0, "/p/raw.csv", "aaa"), (1, "/p/clean.csv", "bbb")]
    assert pairs(t.outputs, "task_no", "path", "sha") == [(0, "/p/clean.csv", "bbb")]
    linked = L.in_session(t.inputs, t.outputs)
    assert pairs(linked, "task_no", "from_task") == [(0, None), (1, 0)]


def test_new_and_unchanged_files(spark, tmp_path):
    t = build(spark, tmp_path, [
        ("open", "rw", "/p/new.csv", "new=1"), ("closew", "-", "/p/new.csv", "sha256=n"),
        ("open", "rw", "/p/same.csv", "sha256=s"), ("closew", "-", "/p/same.csv", "sha256=s"),
        ("open", "rw", "/p/edit.csv", "sha256=e1"), ("closew", "-", "/p/edit.csv", "sha256=e2"), TASK("1")])
    assert pairs(t.inputs, "path", "sha", "rewritten") == [("/p/edit.csv", "e1", True), ("/p/same.csv", "s", False)]
    assert pairs(t.outputs, "path", "sha") == [("/p/edit.csv", "e2"), ("/p/new.csv", "n")]


def test_renames_carry_the_bytes(spark, tmp_path):
    t = build(spark, tmp_path, [
        ("open", "w", "/p/a.tmp", "new=1"), ("closew", "-", "/p/a.tmp", "sha256=x"), ("rename", "-", "/p/b.tmp", "/p/a.tmp"), ("rename", "-", "/p/c.csv", "/p/b.tmp"), TASK("1"),
        ("rename", "-", "/p/d.csv", "/p/c.csv"), TASK("2"),
        ("open", "w", "/p/gone", "new=1"), ("closew", "-", "/p/gone", "sha256=g"), ("unlink", "-", "/p/gone", ""), TASK("3")])
    assert pairs(t.outputs, "task_no", "path", "sha") == [(0, "/p/c.csv", "x"), (1, "/p/d.csv", "x")]
    assert pairs(t.temporary, "task_no", "path") == [(0, "/p/a.tmp"), (0, "/p/b.tmp"), (2, "/p/gone")]


def test_same_bytes_elsewhere_and_changes_by_hand(spark, tmp_path):
    w = lambda p, h: [("open", "w", p, "new=1"), ("closew", "-", p, "sha256=" + h)]
    t = build(spark, tmp_path, [*w("/p/a", "h"), TASK("1"), *w("/p/b", "h"), TASK("2"), ("open", "r", "/p/c", "sha256=h"), ("open", "r", "/p/a", "sha256=other"), TASK("3")])
    linked = L.in_session(t.inputs, t.outputs)
    assert pairs(linked, "path", "from_task", "status", "same_as") == [("/p/a", None, "changed-outside", 0), ("/p/c", None, "observed", 2)]


def test_markers_paused_and_tail(spark, tmp_path):
    t = build(spark, tmp_path, [
        ("open", "r", "/p/x", "sha256=1"), TASK("1"), ("open", "r", "/p/y", "sha256=2", None, 7), ("TASK", "ok", "inner", "", None, 7),
        ("open", "r", "/p/z", "sha256=3"), TASK("2", "paused"), ("open", "r", "/p/t", "sha256=4"), ("END", "-", "", "", None, 1), ("open", "r", "/p/after", "sha256=5")])
    assert pairs(t.tasks, "task") == [("1",), ("tail",)]
    assert pairs(t.inputs, "path") == [("/p/t",), ("/p/x",)]


def test_spawns_commands_missing_and_classes(spark, tmp_path):
    t = build(spark, tmp_path, [
        ("exec", "q", "/p", "/usr/bin/perl -w /opt/execute run1.mod", None, 8), ("spawn", "-", "/bin/static", "child=11;argv=/bin/static -x", None, 8),
        ("spawn", "-", "/bin/seen", "child=12;argv=seen", None, 8), ("exec", "q", "/p", "/bin/seen", None, 12, 8),
        ("openfail", "r", "/p/absent", ""), ("openfail", "r", "/p/made", ""), ("open", "w", "/p/made", "new=1"), ("closew", "-", "/p/made", "sha256=m"),
        ("open", "r", "/opt/lib.so", "sha256=l"), ("open", "r", "/etc/passwd", "sha256=p"), ("open", "r", "/data/o.csv", "sha256=o"), ("open", "r", "/p/.git/index", "sha256=i"),
        ("VARS", "-", "", "fit=lm;n=int", None, 1), ("SOURCE", "-", "/p/s.R", "", None, 1), TASK("1")], )
    assert pairs(t.unrecorded, "child", "program") == [(11, "/bin/static")]
    assert pairs(K.program_names(t.commands), "name") == [("execute",), ("seen",)]
    assert pairs(t.missing, "path") == [("/p/absent",)]
    assert pairs(t.inputs, "path", "class") == [("/data/o.csv", "outside")]
    assert pairs(t.variables, "name", "desc") == [("fit", "lm"), ("n", "int")]
    assert pairs(t.sources, "path") == [("/p/s.R",)]


def test_tooling_and_what_it_starts_is_left_out(spark, tmp_path):
    lines = [("exec", "q", "/p", "/bin/recorder sync", None, 20), ("exec", "q", "/p", "git fetch", None, 21, 20), ("open", "r", "/p/a", "sha256=a", None, 22, 21), ("open", "r", "/p/b", "sha256=b"), TASK("1")]
    t = build(spark, tmp_path, lines, tooling=["recorder"])
    assert pairs(t.inputs, "path") == [("/p/b",)] and t.commands.count() == 0


def test_a_write_nobody_saw_close(spark, tmp_path):
    now = spark.createDataFrame([("/p/r.html", "late", 3500), ("/p/k.csv", "hand", 10**12)], "path string, sha string, mtime_ns bigint")
    w = lambda p: [("open", "w", p, "new=1"), ("closew", "-", p, "sha256=seen", None, None, None, 100)]
    t = build(spark, tmp_path, [*w("/p/r.html"), *w("/p/k.csv"), TASK("1")], manifest=now)
    assert pairs(t.outputs, "path", "sha", "status") == [("/p/k.csv", "seen", "observed"), ("/p/r.html", "late", "written-unseen")]


def test_background_network(spark, tmp_path):
    s = 10**9
    t = build(spark, tmp_path, [("connect", "-", "inet:1.2.3.4:443", "rc=0", 1 * s), ("open", "w", "/h/.cache/oak/x", "new=1", 3 * s), ("connect", "-", "inet:5.6.7.8:80", "rc=-1;errno=115", 9 * s),
                                ("connect", "-", "inet:127.0.0.1:9", "rc=0", 10 * s), TASK("1")])
    assert pairs(t.network, "address", "class") == [("inet:1.2.3.4:443", "background"), ("inet:127.0.0.1:9", "loopback"), ("inet:5.6.7.8:80", "remote")]


def test_split_sessions_give_the_same_tasks(spark, tmp_path, split_keys):
    test_smallest_case(spark, tmp_path)
    test_renames_carry_the_bytes(spark, tmp_path)


def test_origins_by_file_and_by_time(spark):
    tasks = spark.createDataFrame([("s", 0, 0, 10**10), ("s", 1, 10**10, 2 * 10**10)], "session string, task_no bigint, start bigint, end bigint")
    src = spark.createDataFrame([("s", 1, "/p/a.R")], "session string, task_no bigint, path string")
    o = spark.createDataFrame([("s", 9 * 10**9, "/p/a.R"), ("s", 10**10, ""), ("s", 3 * 10**10, "")], "session string, ts bigint, file string")
    assert pairs(L.attach_origins(o, tasks, src), "ts", "task_no") == [(9 * 10**9, 1), (10**10, 0)]


def test_each_execution_of_a_file_takes_a_step_of_its_own(spark):
    s = 10**9
    tasks = spark.createDataFrame([("s", k, k * s // 2, k * s // 2 + 10) for k in range(4)] + [("s", 9, 50 * s, 51 * s)], "session string, task_no bigint, start bigint, end bigint")
    src = spark.createDataFrame([("s", k, "/p/a.R") for k in range(4)], "session string, task_no bigint, path string")
    o = spark.createDataFrame([("s", s, "/p/a.R")] * 4 + [("s", 50 * s + 5, "/p/b.R")], "session string, ts bigint, file string")
    got = L.attach_origins(o, tasks.withColumn("script", F.when(F.col("task_no") == 9, "/p/b.R").otherwise("")), src)
    assert pairs(got, "file", "task_no") == [("/p/a.R", 0), ("/p/a.R", 1), ("/p/a.R", 2), ("/p/a.R", 3), ("/p/b.R", 9)]


def greedy(executions, spans):
    """Each execution in order of time takes the nearest free step that ran its file, at most two seconds away."""
    free, out = {(s, t, f): (a, b) for s, t, f, a, b in spans}, {}
    for i, (s, ts, f) in sorted(enumerate(executions), key=lambda x: (x[1][1], x[0])):
        near = sorted((max(a - ts, ts - b, 0), a, t) for (s2, t, f2), (a, b) in free.items() if (s2, f2) == (s, f) and a - L.SOURCE_SLACK_NS <= ts <= b + L.SOURCE_SLACK_NS)
        if near:
            out[i] = near[0][2]
            del free[s, near[0][2], f]
    return out


@pytest.mark.parametrize("gap", [1, 8])
def test_executions_are_matched_in_clusters(spark, gap, request):
    if gap == 1:
        request.getfixturevalue("split_keys")
    r, sec = random.Random(gap), 10**9
    tasks, spans, at = [], [], 0
    for k in range(120):
        a, at = at, at + r.randrange(0, gap * sec)
        tasks.append(("s", k, a, at))
        spans += [("s", k, f, a, at) for f in ("/a", "/b") if r.random() < 0.6]
    # times differ, so that the order of executions is known
    executions = [("s", r.randrange(at) * 7 + i, r.choice(["/a", "/a", "/b", "/c"])) for i, at in enumerate([max(1, at // 7)] * 150)]
    o = spark.createDataFrame([(*e, i) for i, e in enumerate(executions)], "session string, ts bigint, file string, i int").withColumn("stamp", F.timestamp_micros(F.col("ts")))
    t = spark.createDataFrame(tasks, "session string, task_no bigint, start bigint, end bigint")
    src = spark.createDataFrame([x[:3] for x in spans], "session string, task_no bigint, path string")
    e, w = L._clusters(o.select("session", "file", F.col("ts").alias("at"), F.col("i").cast("bigint").alias("__row")), src.withColumnRenamed("path", "file").join(t, ["session", "task_no"]).selectExpr(
        "session", "file", "task_no", "start", "end", f"start - {L.SOURCE_SLACK_NS} AS at", f"end + {L.SOURCE_SLACK_NS} AS until"))
    assert {x["__row"]: x["task_no"] for x in L._matched(e, w).collect()} == greedy(executions, spans)
    assert e.select("file", "cluster").distinct().count() > (3 if gap == 1 else 20)
    got = L.attach_origins(o, t, src)
    want = greedy(executions, spans)
    assert {i: n for i, n in ((x["i"], x["task_no"]) for x in got.collect()) if i in want} == want
    assert all(x["stamp"].microsecond == x["ts"] % 10**6 for x in got.collect())


@pytest.mark.parametrize("code,names", [
    ("y <- mean(x)", ["x"]), ("pop <- read.csv('a.csv'); head(pop)", []), ("f(a = b, c == d)", ["b", "c", "d"]), ("x$y <- 1", ["x"]), ("x <- x + 1", ["x"]),
    ("g <- function(u, v = 2) u + w", ["w"]), ("# fit's own\nprint(\"k # z\", k)", ["k"]), ("for (i in 1:n) s[i] <- i", ["n", "s"])])
def test_names_read(code, names):
    from provenant.functions.code import names_read
    assert names_read(code) == names


def test_document_chunks(spark):
    doc = "t\n```{r}\na <- 1\n```\n```{python}\nb\n```\n```{r two, echo=F}\n#| label: real\nc\nd\n```\n"
    got = L.chunks(spark.createDataFrame([("f.qmd", doc)], "file string, text string"))
    assert pairs(got, "label", "start_line", "end_line", "code") == [("#1", 3, 3, "a <- 1"), ("real", 9, 11, "#| label: real\nc\nd")]
    hit = L.resolve_chunks(spark.createDataFrame([("f.qmd", " c\n")], "file string, code string"), got)
    assert pairs(hit, "label") == [("real",)]


def test_later_writes_prefer_changed_bytes(spark):
    out = [("p", "s1", 0, "/f", "a", 10), ("p", "s2", 0, "/f", "a", 20), ("p", "s3", 0, "/f", "b", 30), ("p", "s3", 1, "/g", "x", 5), ("p", "s4", 0, "/g", "y", 40)]
    o = spark.createDataFrame(out, "project string, session string, task_no bigint, path string, sha string, written_at bigint")
    seen = spark.createDataFrame([("p", "s1", 0, "/f", "a", 10), ("p", "s4", 0, "/g", "x", 30), ("p", "s3", 0, "/f", "a", 25), ("p", "s9", 0, "/f", "b", 5)],
                                 "project string, session string, task_no bigint, path string, sha string, at bigint")
    got = L.written_again(seen, o)
    assert pairs(got, "session", "path", "later_session", "later_same") == [("s1", "/f", "s3", False), ("s3", "/f", None, None), ("s4", "/g", None, None), ("s9", "/f", "s1", False)]
    assert F is not None
