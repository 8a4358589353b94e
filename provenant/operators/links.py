"""Links between tasks: which output an input came from, later writes, console origins, variables.

All "latest before" and "next after" questions are as-of scans over one key, never range joins.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.code import chunks_of, names_read_by, plain_code
from provenant.functions.paths import base, extension
from provenant.functions.terms import EMPTY_SHA256
from provenant.operators import graph
from provenant.operators.ordered import Scan, asof, following, key_sizes, previous, scan
from provenant.session import cut

SOURCE_SLACK_NS = 2_000_000_000
IDLE_SLACK_NS = 200_000_000


def _linkable(c: str = "sha"):
    return (F.col(c) != "") & (F.col(c) != EMPTY_SHA256)


def in_session(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with ``from_task``, the status changed-outside, and ``same_as``: how many other paths of the
    session had these bytes before (``same_bytes`` gives those paths once per hash, not once per input)."""
    out = outputs.select("session", "path", "task_no", F.struct("task_no", "sha").alias("o"))
    linked = asof(inputs, out, ["session", "path"], "task_no", "task_no", F.col("o"), "before", include_equal=False)
    first = outputs.filter(_linkable()).groupBy("session", "sha", "path").agg(F.min("task_no").alias("task_no"))
    counted = numbered_first(first)
    linked = asof(linked, counted, ["session", "sha"], "task_no", "task_no", F.col("n"), "same_as", right_tie=["n"], include_equal=False)
    ok, same = _linkable(), F.col("before.sha") == F.col("sha")
    return linked.select(
        *[c for c in inputs.columns if c != "status"],
        F.when(ok & F.col("before").isNotNull() & ~same, "changed-outside").otherwise(F.col("status")).alias("status"),
        F.when(ok & same, F.col("before.task_no")).alias("from_task"),
        F.when(ok & F.col("before").isNull(), F.coalesce("same_as", F.lit(0))).otherwise(0).alias("same_as"))


def numbered_first(first: DataFrame) -> DataFrame:
    return scan(first, ["session", "sha"], ["task_no", "path"], [Scan("n", "sum", F.lit(1).cast("bigint"))])


def same_bytes(outputs: DataFrame) -> DataFrame:
    """Paths per session and hash with the task that first wrote them: the other half of ``same_as``."""
    return outputs.filter(_linkable()).groupBy("session", "sha", "path").agg(F.min("task_no").alias("task_no"))


def overwritten(outputs: DataFrame) -> DataFrame:
    """Outputs whose path gets other bytes at its next write in the session."""
    later = following(outputs, ["session", "path"], ["task_no"], "__next", F.col("sha"))
    return later.withColumn("overwritten", F.coalesce(F.col("__next") != F.col("sha"), F.lit(False))).drop("__next")


def across_sessions(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs no own task explains ⋈ outputs of other sessions of the project with the same path and bytes.

    The latest that ended before the command started, else the earliest. Every output row carries the
    latest row of another session before it, so "not my own session" needs no second pass per session.
    ``inputs`` has (project, session, task_no, path, sha, status, start, from_task), ``outputs`` (project,
    session, task_no, path, sha, end).
    """
    key = ["project", "path", "sha"]
    ref = F.struct("session", "task_no")
    outs = outputs.filter(_linkable()).select(*key, "session", "task_no", "end")
    sizes = key_sizes(outs, key)
    outs = previous(outs, key, ["end", "session", "task_no"], "__prev", ref, sizes=sizes)
    turn = F.col("__prev.session").isNotNull() & (F.col("__prev.session") != F.col("session"))
    outs = scan(outs, key, ["end", "session", "task_no"], [Scan("__other", "last", F.when(turn, F.col("__prev")))], sizes=sizes)
    got = asof(inputs, outs, key, "start", "end", F.struct("session", "task_no", F.col("__other").alias("other")), "__b", right_tie=["session", "task_no"],
               sizes=sizes + key_sizes(inputs, key))
    mine = F.col("__b.session") == F.col("session")
    before = F.when(~mine, F.struct(F.col("__b.session").alias("session"), F.col("__b.task_no").alias("task_no"))).otherwise(F.col("__b.other"))
    at = F.struct("end", "session", "task_no")
    first = outs.groupBy(*key).agg(F.min_by(ref, at).alias("__e1"))
    second = outs.join(first, key).filter(F.col("session") != F.col("__e1.session")).groupBy(*key).agg(F.min_by(ref, at).alias("__e2"))
    got = got.join(first, key, "left").join(second, key, "left")
    earliest = F.when(F.col("__e1.session") != F.col("session"), F.col("__e1")).otherwise(F.col("__e2"))
    wrote = outputs.filter(_linkable()).groupBy("project", "path", "session").agg(F.max("end").alias("end"))
    top = wrote.groupBy("project", "path").agg(F.max_by(F.struct("session", "end"), F.struct("end", "session")).alias("__w1"))
    next_ = wrote.join(top, ["project", "path"]).filter(F.col("session") != F.col("__w1.session")).groupBy("project", "path").agg(F.max("end").alias("__w2"))
    got = got.join(top, ["project", "path"], "left").join(next_, ["project", "path"], "left")
    last = F.when(F.col("__w1.session") != F.col("session"), F.col("__w1.end")).otherwise(F.col("__w2"))
    open_ = F.col("from_task").isNull() & _linkable()
    chosen = F.when(open_, F.coalesce(before, earliest))
    changed = open_ & chosen.isNull() & (last <= F.col("start")) & (F.col("status") == "observed")
    status = (F.when(chosen.isNotNull() & (F.col("status") == "changed-outside"), "observed")
              .when(F.coalesce(changed, F.lit(False)), "changed-outside").otherwise(F.col("status")))
    return got.select(*[c for c in inputs.columns if c != "status"], status.alias("status"),
                      chosen.getField("session").alias("from_session"), chosen.getField("task_no").alias("cross_task"))


def written_again(seen: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each file version used or written: the next write of its path by another task, the first that
    changed the bytes if there is one. ``seen`` has (project, session, task_no, path, sha, at), ``outputs``
    (project, session, task_no, path, sha, written_at)."""
    key = ["project", "path"]
    ref = F.struct("session", "task_no", "sha")
    order = ["back", "session", "task_no"]  # time reversed: the row before is the next write
    w = outputs.select(*key, "session", "task_no", "sha", (-F.col("written_at")).alias("back"))
    sizes = key_sizes(w, key)
    w = previous(w, key, order, "nxt", ref, sizes=sizes)
    w = scan(w, key, order, [Scan("alt", "last", F.when(F.col("nxt.sha") != F.col("sha"), F.col("nxt")))], sizes=sizes)
    w = previous(w, key, order, "nxt_alt", F.col("alt"), sizes=sizes)
    w = previous(w, key, order, "n1", F.struct(ref.alias("me"), "nxt", "nxt_alt", "alt"), sizes=sizes)
    w = scan(w, key, order, [Scan("a1", "last", F.when(F.col("n1.me.sha") != F.col("sha"), F.col("n1")))], sizes=sizes)
    got = asof(seen.withColumn("__back", -F.col("at")), w, key, "__back", "back", F.struct(ref.alias("me"), "n1", "a1"), "n",
               right_tie=["session", "task_no"], include_equal=False, sizes=sizes + key_sizes(seen, key))
    # A task writes a path once, so at most one write in the way is its own.
    mine = lambda r: F.coalesce((F.col(f"{r}.session") == F.col("session")) & (F.col(f"{r}.task_no") == F.col("task_no")), F.lit(False))
    other = lambda r: F.col(f"{r}.sha") != F.col("sha")
    own = mine("n.me")
    first = F.when(own, F.col("n.n1.me")).otherwise(F.col("n.me"))
    behind = F.when(other("n.a1.nxt"), F.col("n.a1.nxt")).otherwise(F.col("n.a1.nxt_alt"))
    changed = F.when(own, F.when(other("n.n1.me"), F.col("n.n1.me")).otherwise(F.col("n.n1.alt"))).when(other("n.me"), F.col("n.me")).when(
        mine("n.a1.me"), behind).otherwise(F.col("n.a1.me"))
    pick = F.coalesce(changed, first)
    return got.select(*seen.columns, pick.getField("session").alias("later_session"), pick.getField("task_no").alias("later_task"),
                      (pick.getField("sha") == F.col("sha")).alias("later_same"))


def state_now(versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """same, changed or gone, against the files as they are."""
    now = manifest.select("path", F.col("sha").alias("__now"))
    return versions.join(now, "path", "left").select(*versions.columns, F.when(F.col("__now").isNull(), "gone").when(
        F.col("__now") == F.col("sha"), "same").otherwise("changed").alias("now"))


def origins_in(origins: DataFrame, sessions: DataFrame) -> DataFrame:
    """Console executions of the sessions that are consoles, in the session's language (R unless it says)."""
    consoles = sessions.filter("console").select("session", F.coalesce(F.nullif("language", F.lit("")), F.lit("r")).alias("language"))
    return origins.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("r"))).join(consoles, ["session", "language"], "left_semi")


def attach_origins(origins: DataFrame, tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """The task each console execution belongs to.

    First by the file: in order of time each execution takes the nearest task that sourced the file, at most two seconds
    away, and that has no execution of it yet. The rest by time. ``origins`` has (session, ts, file), ``tasks``
    (session, task_no, start, end and, if known, script: the file a task itself runs), ``sources`` (session, task_no, path).
    Equal rows are executions of their own.
    """
    rows = cut(origins.withColumn("__row", F.monotonically_increasing_id()))
    own = tasks.select("session", "task_no", F.col("script").alias("path")) if "script" in tasks.columns else None
    ran = sources.select("session", "task_no", "path") if own is None else sources.select("session", "task_no", "path").unionByName(own)
    spans = ran.filter("path <> ''").distinct().join(tasks.select("session", "task_no", F.col("start").cast("bigint"), F.col("end").cast("bigint")), ["session", "task_no"])
    windows = spans.select("session", F.col("path").alias("file"), F.col("task_no").cast("bigint").alias("task_no"), "start", "end",
                           (F.col("start") - SOURCE_SLACK_NS).alias("at"), (F.col("end") + SOURCE_SLACK_NS).alias("until"))
    executions = rows.filter("file IS NOT NULL AND file <> ''").select("session", "file", F.col("ts").cast("bigint").alias("at"), "__row")
    taken = cut(_matched(*_clusters(executions, windows)))
    placed = cut(rows.join(taken, "__row", "left"))
    rest = placed.filter("task_no IS NULL").drop("task_no", "__row")
    at = previous(tasks.select("session", "task_no", "start", "end"), ["session"], ["start", "task_no"], "p", F.struct("task_no", "start", "end"))
    timed = asof(rest, at, ["session"], "ts", "start", F.struct("task_no", "start", "end", "p"), "t", right_tie=["task_no"])
    edge = (F.col("ts") == F.col("t.start")) & (F.col("t.p.end") == F.col("ts"))
    timed = timed.withColumn("task_no", F.when(edge, F.col("t.p.task_no")).when(F.col("ts") <= F.col("t.end"), F.col("t.task_no")))
    return placed.filter("task_no IS NOT NULL").drop("__row").unionByName(timed.filter("task_no IS NOT NULL").select(*origins.columns, "task_no"))


def _clusters(executions: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executions and windows with ``cluster``: stretches of time of a file that no window reaches out of.

    Two executions that follow each other are in one cluster if a window holds both; the windows begun by the first reach to the
    second then. A window belongs to the cluster of the first execution in it. Clusters are matched apart from each other.
    """
    key = ["session", "file"]
    none = F.lit(None).cast("bigint")
    both = executions.select(*key, "at", F.lit(1).alias("kind"), "__row", none.alias("until")).unionByName(
        windows.select(*key, "at", F.lit(0).alias("kind"), none.alias("__row"), "until"))
    sizes = key_sizes(both, key)
    seen = scan(both, key, ["at", "kind", "__row"], [Scan("reach", "max", F.col("until"))], sizes=sizes).filter("kind = 1")
    follow = previous(seen.select(*key, "at", "__row", "reach"), key, ["at", "__row"], "before", F.col("reach"), sizes=sizes)
    apart = F.when(F.col("before").isNull() | (F.col("before") < F.col("at")), 1).otherwise(0).cast("bigint")
    numbered_ = cut(scan(follow, key, ["at", "__row"], [Scan("cluster", "sum", apart)], sizes=sizes).select(*key, "at", "__row", "cluster"))
    # the first execution at or after the window's begin: time is turned round, so that it is the row before
    turn = lambda df: df.withColumn("back", -F.col("at"))
    met = asof(turn(windows), turn(numbered_).select(*key, "back", F.struct("at", "cluster").alias("e")), key, "back", "back", F.col("e"), "e", sizes=sizes)
    return numbered_, met.filter("e.at <= until").select(*key, "task_no", "start", "end", "at", F.col("e.cluster").alias("cluster"))


def _matched(executions: DataFrame, windows: DataFrame) -> DataFrame:
    """``(__row, task_no)``: the greedy choice within each cluster; clusters are dealt out, not files."""
    none = F.lit(None).cast("bigint")
    key = ["session", "file", "cluster"]
    both = executions.select(*key, "at", F.lit(1).alias("kind"), "__row", none.alias("task_no"), none.alias("start"), none.alias("end")).unionByName(
        windows.select(*key, "at", F.lit(0).alias("kind"), none.alias("__row"), "task_no", "start", "end"))
    parts = int(executions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, *key).sortWithinPartitions(*key, "at", "kind", "start", "task_no", "__row").mapInArrow(_take_nearest, "__row bigint, task_no bigint")


class _Free:
    """Tasks of a cluster that have no execution yet; the nearest to a time comes from the top of one of three heaps."""

    def __init__(self):
        self.ahead, self.open, self.past = [], [], []

    def add(self, start: int, end: int, task: int) -> None:
        heapq.heappush(self.ahead, (start, task, end))

    def nearest(self, at: int) -> int | None:
        while self.ahead and self.ahead[0][0] <= at:
            heapq.heappush(self.open, heapq.heappop(self.ahead))
        while self.open and self.open[0][2] < at:
            start, task, end = heapq.heappop(self.open)
            heapq.heappush(self.past, (-end, start, task))
        if self.open:
            return heapq.heappop(self.open)[1]
        # no open one is left, so all that ended are here, the last ended on top
        late = at + self.past[0][0] if self.past else None
        if late is not None and late > SOURCE_SLACK_NS:
            self.past, late = [], None
        if self.ahead and (late is None or (self.ahead[0][0] - at, self.ahead[0][0], self.ahead[0][1]) < (late, *self.past[0][1:])):
            return heapq.heappop(self.ahead)[1]
        return heapq.heappop(self.past)[2] if late is not None else None


def _take_nearest(batches):
    """Rows come sorted by cluster and time; held are the free tasks of one cluster."""
    key, free = None, _Free()
    for batch in batches:
        rows, tasks = [], []
        for session, file, cluster, at, kind, row, task, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (session, file, cluster) != key:
                key, free = (session, file, cluster), _Free()
            if kind == 0:
                free.add(start, end, task)
                continue
            best = free.nearest(at)
            if best is not None:
                rows.append(row)
                tasks.append(best)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tasks, pa.int64())], ["__row", "task_no"])


def without_idle_reads(inputs: DataFrame, attached: DataFrame) -> DataFrame:
    """Source-type files last read more than 200 ms before the command was sent were read by the waiting console."""
    sent = attached.groupBy("session", "task_no").agg(F.min("ts").alias("__sent"))
    indexed = extension("path").isin(".r", ".qmd", ".rmd") | (base("path") == ".gitignore") | F.col("path").endswith("/git/ignore")
    idle = F.col("last_read") < F.col("__sent") - IDLE_SLACK_NS
    return inputs.join(sent, ["session", "task_no"], "left").filter(~F.coalesce(idle & indexed, F.lit(False))).drop("__sent")


def chunks(documents: DataFrame) -> DataFrame:
    """R chunks of documents ``(file, text)``: label, lines and code."""
    return documents.select("file", F.posexplode(chunks_of("text")).alias("n", "c")).select("file", "n", "c.*")


def resolve_chunks(executions: DataFrame, chunk: DataFrame) -> DataFrame:
    """The chunk an execution's code is: equal, else contained, after normalising; the first that fits."""
    hit = executions.withColumn("__code", plain_code(F.col("code"))).join(
        chunk.select("file", F.col("n").alias("__n"), "label", "start_line", "end_line", plain_code(F.col("code")).alias("__body")), "file")
    fits = (F.col("__body") == F.col("__code")) | ((F.col("__code") != "") & F.col("__body").contains(F.col("__code")))
    return hit.filter(fits).groupBy(*executions.columns).agg(F.min_by(F.struct("label", "start_line", "end_line"), "__n").alias("c")).select(
        *executions.columns, "c.*")


def names_used(code: DataFrame) -> DataFrame:
    """``(session, task_no, name)`` of the names each task's code reads."""
    return code.select("session", "task_no", F.explode(names_read_by("code")).alias("name")).distinct()


def variable_uses(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """Name used ⋈ the latest earlier task of the session that defined it: ``(session, task_no, name, def_task)``."""
    d = definitions.select("session", "name", F.col("task_no").alias("def_task")).distinct()
    return asof(uses.select("session", "task_no", "name"), d, ["session", "name"], "task_no", "def_task", F.col("def_task"), "def_task",
                include_equal=False).filter("def_task IS NOT NULL")


def via_objects(uses: DataFrame, inputs: DataFrame) -> DataFrame:
    """Files a task reached through variables of earlier tasks: the inputs of those, nearest first."""
    node = lambda c: F.concat_ws("\u0001", "session", c)
    edges = uses.select(node(F.col("task_no")).alias("src"), node(F.col("def_task")).alias("dst"))
    starts = edges.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    far = graph.walk(starts, edges).filter("depth > 0")
    read = inputs.select(node(F.col("task_no")).alias("node"), "path", "sha")
    parts = F.split("root", "\u0001")
    return far.join(read, "node").groupBy("root", "path", "sha").agg(F.min("depth").alias("depth")).select(
        parts[0].alias("session"), parts[1].cast("bigint").alias("task_no"), "path", "sha", "depth")
