import pytest
from pyspark.sql import functions as F

from provenant.operators import tasks as K
from provenant.streaming import feeds, tasks

from test_tasks import TASK, log
from provenant.sources.tracelog import read_traces

LINES = [("open", "r", "/p/raw", "sha256=a"), ("open", "w", "/p/t.tmp", "new=1"), ("closew", "-", "/p/t.tmp", "sha256=b"), ("rename", "-", "/p/out", "/p/t.tmp"), TASK("1"),
         ("open", "r", "/p/out", "sha256=b"), ("open", "w", "/p/x", "new=1"), ("closew", "-", "/p/x", "sha256=x"), ("unlink", "-", "/p/x", ""), TASK("2", "err")]


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def compared(got, t):
    """Rows of a stream beside the batch's, by role."""
    columns = {"task": ["task_no", "task", "status", "start", "end"], "in": ["task_no", "path", "sha", "first_read", "last_read", "pid", "rewritten"],
               "out": ["task_no", "path", "sha", "written_at"], "temporary": ["task_no", "path"]}
    rows = lambda found, role: sorted(tuple([r["session"], *(r[c] for c in columns[role])]) for r in found)
    for role, df in (("task", t.tasks), ("in", t.inputs), ("out", t.outputs), ("temporary", t.temporary)):
        yield role, rows([r for r in got if r["role"] == role], role), rows(df.collect(), role)


MORE = [
    ("inherit", "w", "/p/console.log", ""), ("open", "r", "/opt/lib/x", "sha256=e"), ("open", "r", "/p/raw", "sha256=a"), ("open", "w", "/p/t.tmp", "new=1"), ("closew", "-", "/p/t.tmp", "sha256=b"),
    TASK("1"), ("rename", "-", "/p/out", "/p/t.tmp"), ("open", "r", "/data/in.csv", "sha256=d"), ("open", "r", "/p/out", "sha256=b"), TASK("2"),
    ("open", "w", "/p/console.log", ""), ("open", "r", "/p/raw", "sha256=a"), ("open", "w", "/p/raw", ""), ("closew", "-", "/p/raw", "sha256=a2"), TASK("3", "paused"),
    ("open", "r", "/p/out", "sha256=b"), ("open", "w", "/p/x", "trunc=1"), ("closew", "-", "/p/x", "sha256=x"), ("unlink", "-", "/p/x", ""), ("open", "w", "/p/x", ""), ("closew", "-", "/p/x", "sha256=y"), TASK("4", "err"),
    ("open", "w", "/p/none", ""), ("open", "w", "/p/z", "new=1"), ("closew", "-", "/p/z", "sha256=z"), ("END", "-", "end", ""), ("open", "r", "/p/after", "sha256=q"),
]


@pytest.mark.parametrize("lines,batches", [(LINES, 3), (MORE, 5)])
def test_stream_of_tasks_equals_batch(spark, tmp_path, lines, batches):
    (tmp_path / "s.log").write_text(log(lines))
    batch = read_traces(spark, str(tmp_path / "s.log")).withColumn("session", F.lit("s"))
    got = tasks.replay(batch, "/p", str(tmp_path), batches).collect()
    for role, ours, theirs in compared(got, K.build(batch, "/p")):
        assert ours == theirs, role


def test_sessions_end_when_they_are_idle(spark, tmp_path):
    """The tail of a session comes when no line came in for its time; another line of it begins it anew."""
    (tmp_path / "s.log").write_text(log(LINES[:4]))
    batch = read_traces(spark, str(tmp_path / "s.log")).withColumn("session", F.lit("s"))
    late = batch.withColumn("ord", F.col("ord") + 10_000_000)
    got = tasks.replay(batch.unionByName(late), "/p", str(tmp_path), 3, idle_ms=1).collect()
    assert sorted((r["task_no"], r["task"]) for r in got if r["role"] == "task") == [(0, "tail"), (0, "tail")]


def test_watch_writes_each_change_once(spark, tmp_path):
    schema = "registry string, layer string, seq bigint, record_id string, scope string"
    src = str(tmp_path / "records")
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").json(src)
    run = lambda: feeds.watch(spark.readStream.schema(schema).json(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    put([("own", "work", 1, "w1", None), ("own", "claim", 1, "c1", "s1"), ("partner", "claim", 1, "c9", "s9")])
    run()
    put([("own", "claim", 2, "c2", "s2")])
    run()
    ev = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert sorted((r["event"], r["record_id"] or r["source"]) for r in ev.collect()) == [("published", "w1"), ("pulled", "partner"), ("said", "c1"), ("said", "c2")]
    moved = spark.read.parquet(str(tmp_path / "out" / "moved"))
    assert sorted(r["scope"] or "" for r in moved.collect()) == ["", "s1", "s2"]


def test_feed_pages_follow_each_other(spark):
    held = spark.createDataFrame([("own", 0, "claim", 1, i, f"c{i}") for i in range(1, 6)] + [("b", 1, "claim", 1, 1, "c1")],
                                 "registry string, registry_ord int, layer string, epoch int, seq bigint, record_id string")
    signed = spark.createDataFrame([(f"c{i}", "k") for i in (1, 2, 4, 5)], "record_id string, signers string")
    cursor = held.limit(0).select("registry", "layer", "epoch", "seq")
    seen, untrusted, more = [], 0, True
    while more:
        page, after, more = feeds.feed(held, cursor, signed, 2)
        seen += [r["record_id"] for r in page.orderBy("registry_ord", "seq").collect()]
        untrusted += sum(r["untrusted"] for r in after.collect())
        cursor = spark.createDataFrame(after.select("registry", "layer", "epoch", "seq").collect(), cursor.schema)
    assert seen == ["c1", "c2", "c4", "c5", "c1"] and untrusted == 1
