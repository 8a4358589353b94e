"""Tasks built while logs are followed: a session's open task is its state, markers close it.

State is kept by Spark per session: one value (the open task), and maps keyed by path (what the task did to it), by path and bytes (what it
read), by path (the bytes it holds, across tasks, for renames), by inherited console log, by process (seen, tooling), and by words of commands that are
paths. A line touches the few entries it is about; a marker reads and clears those of its task. Lines follow their place in the log, not their
clock. A session that brings no line for ``idle`` ends with its tail, told by timers on the time of arrival, which unlike the
lines' own clocks never runs back, so no line is too late.

The rows are those of ``operators.tasks.build`` for tasks, inputs, outputs and temporary files, without a manifest. One thing cannot be the same: prefixes
that ENV names change the classes of the open task and of later ones, not of tasks that are closed already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenant.functions.paths import path_class, words
from provenant.operators.tasks import MARKERS

OUT = ("session string, task_no bigint, role string, task string, status string, start bigint, `end` bigint, path string, sha string, first_read bigint, last_read bigint, "
       "pid bigint, rewritten boolean, written_at bigint")
_COLUMNS = [c.split()[0].strip("`") for c in OUT.split(", ")]
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_OPEN = "task_no bigint, start bigint, last bigint, first bigint, lines bigint, seen boolean, ended boolean, owner bigint, marked boolean, env string"
_PATH = ("written boolean, recreated boolean, moved boolean, deleted boolean, closed boolean, close_sha string, close_mtime bigint, written_at bigint, read boolean, "
         "read_sha string, read_mtime bigint, class string")


def _field(extra: str, key: str) -> str:
    return next((p[len(key) + 1:] for p in extra.split(";") if p.startswith(key + "=")), "")


def _under(path: str, prefix: str) -> bool:
    return bool(prefix) and (path == prefix or path.startswith(prefix if prefix.endswith("/") else prefix + "/"))


class _Cached:
    """A map state of which a batch reads each entry once and writes it back once, at its end."""

    def __init__(self, state):
        self.state, self.known, self.changed, self.emptied = state, {}, set(), False

    def get(self, *key):
        if key not in self.known:
            self.known[key] = tuple(self.state.getValue(key)) if not self.emptied and self.state.containsKey(key) else None
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.known[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple[tuple, tuple]]:
        if not self.emptied:
            for key, value in self.state.iterator():
                self.known.setdefault(tuple(key), tuple(value))
        return [(k, v) for k, v in self.known.items() if v is not None]

    def empty(self) -> None:
        self.known, self.changed, self.emptied = {}, set(), True

    def write(self) -> None:
        if self.emptied:
            self.state.clear()
        for key in self.changed:
            value = self.known[key]
            if value is not None:
                self.state.updateValue(key, value)
            elif not self.emptied:
                self.state.removeKey(key)


class _Path:
    """What the open task did to one path."""

    def __init__(self, row: tuple | None):
        (self.written, self.recreated, self.moved, self.deleted, self.closed, self.close_sha, self.close_mtime, self.written_at,
         self.read, self.read_sha, self.read_mtime, self.cls) = row or (None, False, False, False, False, None, 0, None, False, None, 0, "")

    def row(self) -> tuple:
        return (self.written, self.recreated, self.moved, self.deleted, self.closed, self.close_sha, self.close_mtime, self.written_at,
                self.read, self.read_sha, self.read_mtime, self.cls)

    @property
    def rewrote(self) -> bool:
        return self.closed and self.read and self.close_mtime != 0 and self.read_mtime != 0 and self.close_mtime != self.read_mtime


class TaskBuilder(StatefulProcessor):
    def __init__(self, idle_ms: int, tooling: list[str]):
        self.idle_ms, self.tooling = idle_ms, set(tooling)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.maps = {
            "paths": handle.getMapState("paths", "path string", _PATH),
            "reads": handle.getMapState("reads", "path string, sha string, class string", "first bigint, last bigint, pid bigint"),
            "held": handle.getMapState("held", "path string", "sha string, mtime bigint"),
            "console": handle.getMapState("console", "path string", "pid bigint, sure boolean"),
            "processes": handle.getMapState("processes", "pid bigint", "tooling boolean"),
            "programs": handle.getMapState("programs", "path string", "seen boolean"),
        }

    def _load(self) -> None:
        for name, state in self.maps.items():
            setattr(self, name, _Cached(state))

    def close(self) -> None:
        pass

    # -- one batch -------------------------------------------------------------------------------------

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (session,) = key
        self._load()
        lines = pd.concat(list(rows)).sort_values("ord")  # one session's lines of one batch
        arrived = lines["arrived"].astype("datetime64[ms]").astype("int64")
        out: list[tuple] = []
        for timer in list(self.handle.listTimers()):
            expiry = timer[0] if isinstance(timer, tuple) else timer
            self.handle.deleteTimer(expiry)
            if arrived.min() > expiry:
                # the session was idle for too long, though no batch came in between to tell
                self._end(session, out)
                self._load()
        self.handle.registerTimer(int(arrived.max()) + self.idle_ms)
        task = list(self.open.get()) if self.open.exists() else None
        for e in lines.itertuples(index=False):
            if task is not None and task[6]:
                break  # what follows END is not part of the session
            task = task or [0, int(e.ts_ns), int(e.ts_ns), int(e.ts_ns), 0, False, False, None, False, ""]
            self._line(session, task, e, out)
        if task is not None:
            self.open.update(tuple(task))
        for name in self.maps:
            getattr(self, name).write()
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)  # whole numbers beside nulls stay whole

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self._load()
        self._end(key[0], out)
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def _end(self, session: str, out: list[tuple]) -> None:
        """The tail of the session, and nothing held of it any more."""
        if self.open.exists():
            task = list(self.open.get())
            if not task[6]:
                self._flush(session, task, "tail", "-", task[2], out, marked=False)
        for state in (self.open, *self.maps.values()):
            state.clear()

    # -- one line --------------------------------------------------------------------------------------

    def _line(self, session: str, task: list, e, out: list[tuple]) -> None:
        marker = e.op in MARKERS
        if marker:
            if task[7] is None:
                task[7] = int(e.pid)
            elif int(e.pid) != task[7] and self.processes.get(int(e.pid)) is not None:
                return  # of a session that a tool started underneath
            task[8] = True
        elif self._is_tooling(e):
            return
        if not task[5] and task[4] == 0:
            task[3] = int(e.ts_ns)
        task[2] = max(task[2], int(e.ts_ns)) if task[5] or task[4] else int(e.ts_ns)
        task[4] += 1
        if e.op == "TASK":
            if e.mode != "paused":
                self._flush(session, task, e.path, e.mode, int(e.ts_ns), out, marked=True)
            self._forget()
            task[:6] = [task[0] + 1, int(e.ts_ns), int(e.ts_ns), int(e.ts_ns), 0, False]
            return
        if e.op == "END":
            self._flush(session, task, "tail", "-", int(e.ts_ns), out, marked=False)
            self._forget()
            task[6] = True
            return
        cls = self._class(task, e.path, e.cls)
        if e.op == "ENV":
            task[9] = ",".join(p for p in [task[9], *(x.strip() for x in e.path.split(","))] if p)
            self._started(task)
        elif e.op == "exec":
            task[5] = True
            for path in e.words:
                if path.startswith("/"):
                    self.programs.put((path,), (True,))
        elif e.op in ("connect", "openfail"):
            task[5] = task[5] or e.op == "connect" or cls == "project"
        elif e.op in ("open", "inherit", "closew", "unlink"):
            self._touch(task, e, cls)
        elif e.op == "rename":
            self._rename(task, e, cls)

    def _is_tooling(self, e) -> bool:
        pid, parent = int(e.pid), int(e.ppid)
        known, above = self.processes.get(pid), self.processes.get(parent) if parent else None
        tool = bool(known and known[0]) or bool(above and above[0])
        if e.op == "exec" and self.tooling:
            program = next((w for w in e.words if not (w.startswith("-") or "=" in w or w.rpartition("/")[2] == "env")), "")
            tool = tool or program.rpartition("/")[2] in self.tooling
        if known != (tool,):
            self.processes.put((pid,), (tool,))
        return tool

    @staticmethod
    def _class(task: list, path: str, cls: str) -> str:
        if task[9] and cls in ("outside", "system", "temp", "env") and any(_under(path, p) for p in task[9].split(",")):
            return "env"
        return cls

    def _started(self, task: list) -> None:
        """ENV: what the open task did outside the project before was the runtime's start."""
        for state, at in ((self.reads, lambda k, r: k[2]), (self.paths, lambda k, r: r[11])):
            for key in [k for k, r in state.items() if at(k, r) != "project"]:
                state.put(key, None)

    def _path(self, path: str) -> _Path:
        return _Path(self.paths.get(path))

    def _touch(self, task: list, e, cls: str) -> None:
        p, opens = self._path(e.path), e.op in ("open", "inherit") and not e.mode.endswith("d")
        p.cls = max(p.cls, cls)
        fresh, sha = "1" in (_field(e.extra, "new"), _field(e.extra, "trunc")), _field(e.extra, "sha256")
        before = bool(p.written)
        if e.op == "inherit" and task[0] == 0 and not task[8]:
            known = self.console.get(e.path)
            self.console.put((e.path,), (int(e.pid), not before or bool(known and known[1])))
        if opens and e.op == "open" and e.mode.startswith("r") and not fresh and cls in ("project", "outside") and not before:
            key = (e.path, sha, cls)
            first, last, pid = self.reads.get(*key) or (int(e.ord), int(e.ts_ns), int(e.pid))
            self.reads.put(key, (first, max(last, int(e.ts_ns)), pid))
            if not p.read:
                p.read, p.read_sha, p.read_mtime = True, sha, int(e.mtime_ns)
        if opens and "w" in e.mode and cls in ("project", "outside", "temp"):
            p.written = True
            p.recreated = p.recreated or fresh
        if e.op == "closew":
            p.closed, p.close_sha, p.close_mtime = True, sha, int(e.mtime_ns)
            p.written_at = max(p.written_at or 0, int(e.ts_ns))
            if sha:
                self.held.put((e.path,), (sha, int(e.mtime_ns)))
        elif e.op == "unlink":
            p.deleted = p.deleted or before
            p.recreated = True
            self.held.put((e.path,), None)
        self.paths.put((e.path,), p.row())

    def _rename(self, task: list, e, cls: str) -> None:
        source = self._path(e.extra)
        source.cls = max(source.cls, self._class(task, e.extra, e.source_cls))
        source.moved = source.moved or bool(source.written)
        source.written = False
        self.paths.put((e.extra,), source.row())
        bytes_ = self.held.get(e.extra)
        self.held.put((e.extra,), None)
        p = self._path(e.path)
        p.cls, p.written, p.deleted = max(p.cls, cls), True, False
        self.held.put((e.path,), bytes_)
        if bytes_ is not None:
            p.closed, p.close_sha, p.close_mtime = True, bytes_[0], bytes_[1]
        self.paths.put((e.path,), p.row())

    # -- a task's end ----------------------------------------------------------------------------------

    def _is_console(self, path: str, owner: int | None) -> bool:
        known = self.console.get(path)
        return known is not None and (known[1] or known[0] == owner)

    def _flush(self, session: str, task: list, name: str, status: str, end: int, out: list[tuple], marked: bool) -> None:
        start = task[1] if task[0] else task[3]
        rows: list[tuple] = []
        row = lambda role, **kw: rows.append(tuple({"session": session, "task_no": task[0], "role": role, **kw}.get(c) for c in _COLUMNS))
        paths = {k[0]: _Path(r) for k, r in self.paths.items()}
        used = False
        for (path, sha, cls), (first, last, pid) in self.reads.items():
            if cls != "project" and self.programs.get(path) is not None:
                continue
            p, used = paths[path], True
            again = bool(p.written) and (not p.closed or p.close_sha != sha or p.recreated or p.rewrote)
            row("in", path=path, sha=sha, first_read=first, last_read=last, pid=pid, rewritten=again)
        for path, p in paths.items():
            if p.written and not self._is_console(path, task[7]):
                scratch = p.deleted or p.cls == "temp" or not p.closed
                unchanged = p.read and p.closed and p.read_sha == p.close_sha and not p.recreated and not p.rewrote
                if scratch:
                    row("temporary", path=path)
                elif not unchanged and p.cls in ("project", "outside"):
                    used = True
                    row("out", path=path, sha=p.close_sha, written_at=p.written_at if p.written_at is not None else end)
            elif not p.written and p.moved:
                row("temporary", path=path)
        if marked or used or task[5]:
            row("task", task=name, status=status, start=start, end=end)
        out.extend(rows)

    def _forget(self) -> None:
        for state in (self.paths, self.reads, self.programs):
            state.empty()


def follow(trace: DataFrame, project: str | Column, *, idle_ms: int = 3_600_000, home: str = "", env_prefixes: list[str] | None = None, tooling: list[str] | None = None) -> DataFrame:
    """Closed tasks of followed logs with their files, each once. ``trace`` is a stream of events with ``arrived``, when a line came in.

    The state of a session is its open task and the bytes its paths hold. A batch holds only the lines that are new.
    """
    project = F.lit(project) if isinstance(project, str) else project
    cls = lambda c: path_class(c, project, home=home, env_prefixes=env_prefixes)
    extra = F.coalesce("extra", F.lit(""))
    lines = trace.withWatermark("arrived", "1 millisecond").select(
        "session", "ord", "ts_ns", "pid", "ppid", "op", "mode", "path", "mtime_ns", extra.alias("extra"), "arrived", cls(F.col("path")).alias("cls"),
        F.when(F.col("op") == "rename", cls(extra)).otherwise("").alias("source_cls"), F.when(F.col("op") == "exec", words(extra)).otherwise(F.expr("cast(array() as array<string>)")).alias("words"))
    return lines.groupBy("session").transformWithStateInPandas(TaskBuilder(idle_ms, tooling or []), OUT, "Append", "EventTime")


def replay(trace: DataFrame, project: str, folder: str, batches: int, **kw) -> DataFrame:
    """The rows of ``follow`` for a whole trace that arrives in ``batches`` pieces below ``folder``, then ends.

    A last line without a session comes in long after the others, so that the sessions' timers end them.
    """
    spark, idle = trace.sparkSession, kw.get("idle_ms", 3_600_000)
    edges = trace.agg(F.min("ord").alias("a"), F.max("ord").alias("b")).first()
    width = ((edges.b or 0) - (edges.a or 0)) // batches + 1
    piece = F.floor((F.col("ord") - (edges.a or 0)) / width)
    arrived = lambda n: F.timestamp_millis((n.cast("bigint") + 1) * 1000)
    columns = ["session", "ord", "ts_ns", "pid", "ppid", "op", "mode", "path", "mtime_ns", "extra", "arrived"]
    rows = trace.withColumn("arrived", arrived(piece)).select(*columns)
    for n in range(batches):
        rows.where(F.col("arrived") == arrived(F.lit(n))).coalesce(1).write.parquet(f"{folder}/in/p{n:05d}")
    clock = trace.limit(0).select(*columns[:-1]).unionByName(spark.sql(
        "SELECT '' AS session, 0L AS ord, 0L AS ts_ns, 0L AS pid, 0L AS ppid, 'connect' AS op, '-' AS mode, '' AS path, 0L AS mtime_ns, '' AS extra"))
    clock.withColumn("arrived", arrived(F.lit(batches + 2 * idle // 1000))).coalesce(1).write.parquet(f"{folder}/in/p{batches:05d}")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = (follow(stream, project, **kw).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(f"{folder}/out").where("session <> ''")
