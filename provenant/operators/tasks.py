"""From trace events to tasks with inputs, outputs and the rest, as joins and ordered scans.

Events have ``session, ord, ts_ns, pid, ppid, op, mode, path, size, mtime_ns, extra``; ``ord`` is the line's place
in the log and rules over the clock. Children are keyed ``(session, task_no)``. Nothing is folded row by row:
the state of a path is a running value over (session, path), so a session of any size is split like the rest.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.paths import base, path_class, program_name, words
from provenant.functions.terms import field_of
from provenant.operators import graph
from provenant.operators.ordered import Scan, key_sizes, previous, scan
from provenant.operators.prefixes import longest
from provenant.session import cut, cut_counted, hot_rows, release

MARKERS = ["TASK", "END", "SOURCE", "ENV", "VARS"]
UNSEEN_GRACE_NS = 2_000_000_000
CACHE_WRITE_NS = 5_000_000_000
KEY = ["session", "task_no"]


def without_tooling(events: DataFrame, programs: list[str], **kw) -> DataFrame:
    """Drop processes of the given programs from the line that starts them, with all they start."""
    found = _tooling(events, programs)
    return events if found is None else _by_process(events, found, kw).select(*events.columns)


def _tooling(events: DataFrame, programs: list[str]) -> DataFrame | None:
    """``(session, pid, since)``: the processes of the given programs and what they start, each from a line on; None if there are none."""
    if not programs:
        return None
    w = F.filter(words("extra"), lambda x: ~(x.startswith("-") | x.contains("=") | (base(x) == "env")))
    traced = events.filter(~F.col("op").isin(MARKERS))
    seeds = traced.filter((F.col("op") == "exec") & base(F.get(w, 0)).isin(programs)).groupBy("session", "pid").agg(
        F.min("ord").alias("since"))
    found, n = cut_counted(seeds.filter("session IS NOT NULL AND pid IS NOT NULL"))
    if n == 0:
        return None
    # Who started whom, and when that was first and last seen; single lines are looked up only for a child that was there before its parent became tooling.
    lines = traced.filter("ppid <> 0").join(found.select("session").distinct(), "session", "left_semi").select("session", "ppid", "pid", "ord")
    links = cut(lines.groupBy("session", "ppid", "pid").agg(F.min("ord").alias("first"), F.max("ord").alias("last")))
    frontier = found
    while True:
        met = cut(links.join(frontier.select("session", F.col("pid").alias("ppid"), "since"), ["session", "ppid"]).filter("last >= since AND pid IS NOT NULL"))
        reached = met.filter("first >= since").select("session", "pid", F.col("first").alias("since"))
        older = met.filter("first < since").select("session", "ppid", "pid", "since")
        if not older.isEmpty():
            reached = reached.unionByName(lines.join(older, ["session", "ppid", "pid"]).filter("ord >= since").select("session", "pid", F.col("ord").alias("since")))
        reached = reached.groupBy("session", "pid").agg(F.min("since").alias("since"))
        known = found.select("session", "pid", F.col("since").alias("had"))
        frontier, n = cut_counted(reached.join(known, ["session", "pid"], "left").filter("had IS NULL OR since < had").select("session", "pid", "since"))
        release(met)
        if n == 0:
            break
        found = cut(found.unionByName(frontier).groupBy("session", "pid").agg(F.min("since").alias("since")))
    release(links)
    return found


def _by_process(events: DataFrame, found: DataFrame | None, kw: dict) -> DataFrame:
    """``events`` without what is tooling, with ``__traced``: whether a line of the process that is no marker came before."""
    mark = F.col("op").isin(MARKERS)
    rows = events.withColumns({"__side": F.lit(1), "__since": F.lit(None).cast("bigint")})
    if found is not None:
        # a row per process of when it became tooling, before the line of that place; both sides dealt out alike are united without another deal
        since = found.select("session", "pid", F.col("since").alias("ord"), F.col("since").alias("__since"), F.lit(0).alias("__side"))
        rows = rows.unionByName(_together(since, ["session"], kw), allowMissingColumns=True)
    rows = scan(_together(rows, ["session"], kw), ["session", "pid"], ["ord", "__side"], [
        Scan("__gone", "min", F.col("__since")), Scan("__first", "min", F.when(~mark & (F.col("__side") == 1), F.col("ord")))], **kw)
    traced = F.col("pid").isNotNull() & F.col("__first").isNotNull() & (F.col("__gone").isNull() | (F.col("__first") < F.col("__gone")))
    return rows.filter("__side = 1").filter(mark | F.col("__gone").isNull()).select(*events.columns, traced.alias("__traced"))


def _together(rows: DataFrame, keys: list[str], kw: dict) -> DataFrame:
    """``rows`` dealt out by ``keys`` alone, if no key is a hot one: scans by these and more keys then need no other deal."""
    sizes = kw.get("sizes")
    return rows.repartition(*keys) if sizes is not None and sizes.largest <= hot_rows(rows.sparkSession) else rows


def without_nested_markers(events: DataFrame, **kw) -> DataFrame:
    """Markers count from the session's first marking process and from processes never traced before them."""
    return _own_markers(_by_process(events, None, kw), kw)


def _own_markers(rows: DataFrame, kw: dict) -> DataFrame:
    mark = F.col("op").isin(MARKERS)
    rows = scan(rows, ["session"], ["ord"], [Scan("__owner", "min", F.when(mark, F.struct("ord", "pid")))], **kw)
    kept = F.coalesce(F.col("pid") == F.col("__owner.pid"), F.lit(False)) | ~F.col("__traced")
    return rows.filter(~mark | (kept & F.col("session").isNotNull())).drop("__traced", "__owner")


def numbered_events(events: DataFrame, tooling: list[str] | None = None, **kw) -> DataFrame:
    """Events with the number of their task: markers seen before the line. What follows END is dropped."""
    if "sizes" not in kw:
        seen = key_sizes(events, ["session"])
        kw["sizes"] = seen + seen
    e = _own_markers(_by_process(events, _tooling(events, tooling or []), kw), kw)
    is_task, is_end = (F.col("op") == "TASK").cast("bigint"), (F.col("op") == "END").cast("bigint")
    e = scan(e, ["session"], ["ord"], [Scan("task_no", "sum", is_task, False), Scan("__ended", "sum", is_end, False)], **kw)
    return e.filter(F.coalesce("__ended", F.lit(0)) == 0).drop("__ended").withColumn("task_no", F.coalesce("task_no", F.lit(0)))


class Traces:
    """The tasks of sessions and their child tables, each made when it is first asked for.

    ``plain`` are the session's lines with the number of their task and their class before ENV is looked at; tables that no class but the project's matters to are
    read from them. What is recorded in paused commands is in no table.
    """

    def __init__(self, plain: DataFrame, project: Column, home: str, env_prefixes: list[str] | None, manifest: DataFrame | None, cache_dir: str, kw: dict):
        self._plain, self._project, self._home, self._prefixes, self._manifest, self._cache_dir, self._kw = plain, project, home, env_prefixes, manifest, cache_dir, kw

    @cached_property
    def _paused(self) -> DataFrame:
        mark = self._plain.filter("op = 'TASK'").groupBy(*KEY).agg(F.max(F.struct("path", "mode", "extra", "ts_ns")).alias("m"))
        return mark.filter("m.mode = 'paused'").select(*KEY)

    @cached_property
    def _lines(self) -> DataFrame:
        return self._plain.join(self._paused, KEY, "left_anti")

    def _live(self, rows: Column) -> DataFrame:
        """Such of the lines with their last class: only what a table is made of is looked up under the prefixes of ENV."""
        return _session_env(self._plain, rows).join(self._paused, KEY, "left_anti")

    @cached_property
    def _files(self) -> DataFrame:
        return self._live(F.col("op").isin("open", "inherit", "closew", "unlink", "rename"))

    @cached_property
    def _all_tasks(self) -> DataFrame:
        return task_rows(self._plain, **self._kw).filter("status <> 'paused'")

    @cached_property
    def _states(self) -> DataFrame:
        return cut(_path_states(self._files, self._project, self._home, self._prefixes, self._kw))

    @cached_property
    def _inputs_outputs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return _inputs_outputs(self._lines, self._states, self._all_tasks, self.unrecorded, self._manifest)

    @cached_property
    def inputs(self) -> DataFrame:
        return self._inputs_outputs[0]

    @cached_property
    def outputs(self) -> DataFrame:
        return self._inputs_outputs[1]

    @cached_property
    def temporary(self) -> DataFrame:
        return self._inputs_outputs[2]

    @cached_property
    def tasks(self) -> DataFrame:
        """Marked tasks, and the tail of a session if anything is left of it."""
        marked, tail = self._all_tasks.filter("marked"), self._all_tasks.filter("NOT marked")
        # only a tail with lines that are no markers can have children
        tail = cut(tail.join(self._lines.filter(~F.col("op").isin(MARKERS)).select(*KEY), KEY, "left_semi"))
        if tail.isEmpty():
            return marked
        some = [d.select(*KEY) for d in (self.inputs, self.outputs, self.commands, self.network, self.missing)]
        seen = some[0]
        for d in some[1:]:
            seen = seen.unionByName(d)
        return marked.unionByName(tail.join(seen, KEY, "left_semi"))

    @cached_property
    def missing(self) -> DataFrame:
        # what was looked for before the session said where it works was looked for by its start, not by a command
        started = self._lines.filter("op = 'ENV'").groupBy(*KEY).agg(F.max("ord").alias("__env"))
        fails = self._lines.filter("op = 'openfail' AND class = 'project'").join(started, KEY, "left").filter("__env IS NULL OR ord > __env").select(*KEY, "path").distinct()
        writing = (F.col("op") == "rename") | (F.col("op").isin("open", "inherit") & F.contains("mode", F.lit("w")))
        written = _path_rows(self._live(writing), self._project, self._home, self._prefixes).filter("is_written IS NOT NULL").groupBy(*KEY, "path").agg(F.max_by("is_written", "at").alias("w")).filter("w")
        return fails.join(written, [*KEY, "path"], "left_anti")

    @cached_property
    def listings(self) -> DataFrame:
        seen = F.col("class").isin("project", "outside")
        return self._live(F.col("op").isin("open", "inherit") & F.col("mode").endswith("d") & seen).filter(seen).select(*KEY, "path").distinct()

    @cached_property
    def sources(self) -> DataFrame:
        return self._live(F.col("op") == "SOURCE").groupBy(*KEY, "path", "class").agg(F.min("ord").alias("ord"))

    @cached_property
    def commands(self) -> DataFrame:
        return self._lines.filter("op = 'exec'").select(*KEY, "ord", "pid", "ppid", F.get(words("extra"), 0).alias("program"), F.col("extra").alias("cmdline"), F.col("path").alias("cwd"))

    @cached_property
    def unrecorded(self) -> DataFrame:
        return _unrecorded(self._lines)

    @cached_property
    def network(self) -> DataFrame:
        return network(self._lines, self._cache_dir, **self._kw)

    @cached_property
    def variables(self) -> DataFrame:
        return self._lines.filter("op = 'VARS'").select(*KEY, "ord", F.posexplode(F.split("extra", ";")).alias("pos", "kv")).filter(
            F.instr("kv", "=") > 1).select(*KEY, "ord", "pos", F.substring_index("kv", "=", 1).alias("name"),
                                          F.expr("substring(kv, instr(kv, '=') + 1)").alias("desc"))

    @cached_property
    def ops(self) -> DataFrame:
        return _ops(self._lines, self._states)


def task_rows(events: DataFrame, **kw) -> DataFrame:
    """One row per task: id, status, expression, start and end; what follows the last marker is ``tail``."""
    mark = F.when(F.col("op") == "TASK", F.struct("path", "mode", "extra", "ts_ns"))
    t = events.groupBy(*KEY).agg(
        F.max(mark).alias("m"), F.min_by("ts_ns", "ord").alias("first_ts"), F.max("ts_ns").alias("last_ts"),
        F.max(F.when(F.col("op") == "END", F.col("ts_ns"))).alias("end_ts"), F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("events"))
    t = t.select(
        *KEY, F.coalesce("m.path", F.lit("tail")).alias("task"), F.coalesce("m.mode", F.lit("-")).alias("status"),
        F.coalesce("m.extra", F.lit("(after the last command)")).alias("expr"), "first_ts",
        F.coalesce("m.ts_ns", "end_ts", "last_ts").alias("end"), F.col("m").isNotNull().alias("marked"), "first_ord")
    t = previous(t, ["session"], ["task_no"], "__before", F.col("end"), **kw)
    return t.withColumn("start", F.coalesce("__before", "first_ts")).drop("__before", "first_ts")


def build(events: DataFrame, project: str | Column, *, manifest: DataFrame | None = None, home: str = "",
          env_prefixes: list[str] | None = None, tooling: list[str] | None = None, cache_dir: str = "/.cache/oak/", libraries: DataFrame | None = None) -> Traces:
    """Tasks of all sessions. ``manifest`` (path, sha, mtime_ns) stands for the files as they are now, ``libraries`` (prefix) for the folders of packages."""
    project = F.lit(project) if isinstance(project, str) else project
    # Every key below holds part of one session: when the largest session is small, so are they all.
    seen = key_sizes(events, ["session"])
    kw = {"sizes": seen + seen}  # a rename is two rows
    e = cut(numbered_events(events, tooling, **kw).withColumn("class", path_class("path", project, home=home, env_prefixes=env_prefixes)))
    if libraries is not None:
        inside = longest(e.filter("class = 'outside'").select("path").distinct(), libraries.select(F.concat("prefix", F.lit("/")).alias("prefix"))).where("prefix IS NOT NULL")
        e = e.join(inside.select("path", F.lit(True).alias("__library")), "path", "left").withColumn(
            "class", F.when((F.col("class") == "outside") & F.col("__library"), "env").otherwise(F.col("class"))).select(*e.columns)
    return Traces(e, project, home, env_prefixes, manifest, cache_dir, kw)


def _session_env(e: DataFrame, rows: Column) -> DataFrame:
    """Such ``rows`` of ``e`` with the class that follows from the prefixes a session names in ENV: files under them are environment; so is, outside the
    project, all before it."""
    said, e = e.filter("op = 'ENV'"), e.filter(rows)
    if said.isEmpty():
        return e
    named = said.select("session", F.explode(F.transform(F.split("path", ","), lambda p: F.trim(p))).alias("prefix")).distinct()
    first = said.groupBy("session").agg(F.min("ord").alias("__at"))
    found = longest(e.join(first, "session", "left_semi").select("session", "path").distinct(), named, ["session"]).where("prefix IS NOT NULL").select("session", "path", F.lit(True).alias("__named"))
    early = (F.col("ord") < F.col("__at")) & (F.col("class") != "project") & ~F.col("op").isin(MARKERS)
    env = F.col("class").isin("outside", "system", "temp", "env") & (F.coalesce("__named", F.lit(False)) | early)
    return e.join(first, "session", "left").join(found, ["session", "path"], "left").withColumn(
        "class", F.when(F.coalesce(env, F.lit(False)), "env").otherwise(F.col("class"))).select(*e.columns)


def _path_rows(e: DataFrame, project, home, env_prefixes) -> DataFrame:
    """What each line does to a path. A rename is two rows: its source moves away, its target is written."""
    fresh = (field_of("extra", "new") == "1") | (field_of("extra", "trunc") == "1")
    mode = F.regexp_replace("mode", "d$", "")
    opens = F.col("op").isin("open", "inherit") & ~F.col("mode").endswith("d")
    reads = opens & (F.col("op") == "open") & mode.startswith("r") & ~fresh & F.col("class").isin("project", "outside")
    writes = opens & F.contains(mode, F.lit("w")) & F.col("class").isin("project", "outside", "temp")
    sha = F.nullif(field_of("extra", "sha256"), F.lit(""))
    common = [*KEY, "ord", "ts_ns", "pid", "mtime_ns"]
    part = lambda **c: [*common, *[v.alias(k) for k, v in c.items()]]
    nothing = F.lit(None)
    lines = e.filter(F.col("op").isin("open", "inherit", "closew", "unlink")).select(*part(
        kind=F.col("op"), path=F.col("path"), cls=F.col("class"), half=F.lit(0), reads=F.coalesce(reads, F.lit(False)),
        fresh=F.coalesce(writes & fresh, F.lit(False)), sha=sha, is_written=F.when(writes, True),
        large=field_of("extra", "unhashed") == "large"))
    ren = e.filter("op = 'rename'")
    away = ren.select(*part(kind=F.lit("away"), path=F.col("extra"), cls=path_class("extra", project, home=home, env_prefixes=env_prefixes),
                            half=F.lit(0), reads=F.lit(False), fresh=F.lit(False), sha=nothing.cast("string"), is_written=F.lit(False), large=F.lit(False)))
    onto = ren.select(*part(kind=F.lit("onto"), path=F.col("path"), cls=F.col("class"), half=F.lit(1), reads=F.lit(False), fresh=F.lit(False),
                            sha=nothing.cast("string"), is_written=F.lit(True), large=F.lit(False)))
    return lines.unionByName(away).unionByName(onto).withColumn("at", F.col("ord") * 2 + F.col("half"))


def _path_states(e: DataFrame, project, home, env_prefixes, kw) -> DataFrame:
    """``_path_rows`` with the state of the path before them. ``sha`` of a renamed file is the one its source had, through any number of
    renames, in this task or before."""
    nothing = F.lit(None)
    rows = _path_rows(e, project, home, env_prefixes)
    rows = scan(rows, [*KEY, "path"], ["at"], [Scan("written_before", "last", F.col("is_written"), False)], **kw)
    rows = rows.withColumn("written_before", F.coalesce("written_before", F.lit(False)))
    # What the path last held: bytes with a hash, bytes moved here by a rename, or nothing.
    holds = (F.when((F.col("kind") == "closew") & F.col("sha").isNotNull(), F.struct(F.col("sha"), nothing.cast("bigint").alias("via"), "mtime_ns"))
             .when(F.col("kind") == "onto", F.struct(nothing.cast("string").alias("sha"), F.col("ord").alias("via"), "mtime_ns"))
             .when(F.col("kind").isin("unlink", "away"), F.struct(nothing.cast("string").alias("sha"), nothing.cast("bigint").alias("via"), F.lit(0).cast("bigint").alias("mtime_ns"))))
    rows = scan(rows, ["session", "path"], ["at"], [Scan("held", "last", holds, False)], **kw)
    moves = rows.filter("kind = 'away'").select("session", "ord", "held")
    moves = cut(moves)
    if moves.isEmpty():
        return rows.drop("held")
    node = lambda c: F.concat_ws("\u0001", "session", c)
    nodes = moves.select(node(F.col("ord")).alias("id"), F.when(F.col("held.via").isNotNull(), node(F.col("held.via"))).alias("prev"),
                         F.col("held.sha").isNotNull().alias("is_root"), "held")
    origin = graph.chase(nodes.select("id", "prev", "is_root")).filter("state = 'root'").select("id", "root")
    known = nodes.select(F.col("id").alias("root"), F.col("held.sha").alias("r_sha"), F.col("held.mtime_ns").alias("r_mtime"))
    moved = origin.join(known, "root").select("id", "r_sha", "r_mtime")
    targets = rows.filter("kind = 'onto'").withColumn("id", node(F.col("ord"))).join(moved, "id", "left")
    targets = targets.withColumn("sha", F.col("r_sha")).withColumn("mtime_ns", F.coalesce("r_mtime", "mtime_ns"))
    return rows.filter("kind <> 'onto'").drop("held").unionByName(targets.select(*[c for c in rows.columns if c != "held"]))


def _inputs_outputs(live, states, tasks, spawned, manifest):
    readable = (F.col("reads")) & ~F.col("written_before")
    reads = states.filter(readable).groupBy(*KEY, "path", "cls", F.coalesce("sha", F.lit("")).alias("sha")).agg(
        F.min("ord").alias("first_read"), F.max("ts_ns").alias("last_read"), F.min_by("pid", "ord").alias("pid"), F.bool_or("large").alias("large"))
    closes = F.col("kind").isin("closew", "onto")
    hashed = closes & ((F.col("kind") == "closew") | F.col("sha").isNotNull())
    # The scratch console log: inherited before any marker and not opened by the session itself.
    first_mark = live.filter(F.col("op").isin(MARKERS)).groupBy("session").agg(F.min("ord").alias("m"), F.min_by("pid", "ord").alias("owner"))
    inherited = states.filter("kind = 'inherit' AND task_no = 0").join(first_mark, "session", "left").filter(F.col("m").isNull() | (F.col("ord") < F.col("m")))
    console = inherited.filter(~F.col("written_before") | (F.col("pid") == F.col("owner"))).select("session", "path").distinct().withColumn("console", F.lit(True))
    per = states.groupBy(*KEY, "path").agg(
        F.max_by("is_written", F.when(F.col("is_written").isNotNull(), F.col("at"))).alias("written"),
        F.bool_or((F.col("kind") == "away") & F.col("written_before")).alias("moved"),
        F.coalesce(F.max_by(F.col("kind") == "unlink", F.when(((F.col("kind") == "unlink") & F.col("written_before")) | (F.col("kind") == "onto"), F.col("at"))),
                   F.lit(False)).alias("deleted"),
        F.bool_or((F.col("kind") == "unlink") | F.col("fresh")).alias("recreated"),
        F.max_by(F.struct(F.coalesce("sha", F.lit("")).alias("sha"), "mtime_ns"), F.when(hashed, F.col("at"))).alias("close"),
        F.max(F.when(F.col("kind") == "closew", F.col("ts_ns"))).alias("written_at"),
        F.min_by(F.struct(F.coalesce("sha", F.lit("")).alias("sha"), "mtime_ns"), F.when(readable, F.col("at"))).alias("read"),
        F.max("cls").alias("class"))
    per = per.join(console, ["session", "path"], "left").withColumn("written", F.coalesce("written", F.lit(False)))
    rewrote = (F.col("close.mtime_ns") != 0) & (F.col("read.mtime_ns") != 0) & (F.col("close.mtime_ns") != F.col("read.mtime_ns"))
    per = per.withColumn("rewrote", F.coalesce(rewrote, F.lit(False)))
    per = cut(per)
    cand = per.filter("written AND console IS NULL").join(tasks.select(*KEY, "end", "marked"), KEY)
    if manifest is not None:
        grace = spawned.select(*KEY).distinct().withColumn("grace", F.lit(UNSEEN_GRACE_NS))
        now = manifest.select("path", F.col("sha").alias("now_sha"), F.col("mtime_ns").alias("now_mtime"))
        cand = cand.join(now, "path", "left").join(grace, KEY, "left")
        late = (F.col("now_mtime") != F.col("close.mtime_ns")) & (F.col("now_mtime") <= F.col("end") + F.coalesce("grace", F.lit(0)))
        late = F.coalesce(late & (F.col("close.sha") != "") & (F.col("now_sha") != F.col("close.sha")), F.lit(False))
        sha = F.when(late, F.col("now_sha")).otherwise(F.coalesce("close.sha", "now_sha"))
    else:
        late, sha = F.lit(False), F.col("close.sha")
    cand = cand.withColumn("late", late).withColumn("sha", sha)
    scratch = F.col("deleted") | (F.col("class") == "temp") | F.col("sha").isNull()
    unchanged = F.coalesce(F.col("read.sha") == F.col("sha"), F.lit(False)) & ~F.col("recreated") & ~F.col("rewrote")
    status = F.when(F.col("late"), "written-unseen").when(F.col("sha") == "", "unhashed-large").otherwise("observed")
    outputs = cand.filter(~scratch & ~unchanged & F.col("class").isin("project", "outside")).select(
        *KEY, "path", "class", "sha", status.alias("status"), F.coalesce("written_at", "end").alias("written_at"), "end")
    temporary = cand.filter(scratch).select(*KEY, "path").unionByName(per.filter("moved AND NOT written").select(*KEY, "path")).distinct()
    programs = live.filter("op = 'exec'").select(*KEY, F.explode(words("extra")).alias("path")).filter(F.col("path").startswith("/")).distinct().withColumn(
        "program", F.lit(True))
    state = per.select(*KEY, "path", "written", "recreated", "rewrote", F.col("close.sha").alias("close_sha"))
    inputs = reads.join(programs, [*KEY, "path"], "left").filter((F.col("cls") == "project") | F.col("program").isNull()).join(state, [*KEY, "path"])
    again = F.col("written") & (F.col("close_sha").isNull() | (F.col("close_sha") != F.col("sha")) | F.col("recreated") | F.col("rewrote"))
    inputs = inputs.select(*KEY, "path", F.col("cls").alias("class"), "sha", "first_read", "last_read", "pid",
                           F.when(F.col("large"), "unhashed-large").otherwise("observed").alias("status"), again.alias("rewritten"))
    return inputs, outputs, temporary


def _unrecorded(live: DataFrame) -> DataFrame:
    """Programs started whose process was never seen to run."""
    child = F.coalesce(field_of("extra", "child").try_cast("bigint"), F.col("pid"))
    argv = F.when(F.instr("extra", "argv=") > 0, F.expr("substring(extra, instr(extra, 'argv=') + 5)")).otherwise(F.col("extra"))
    spawns = live.filter("op = 'spawn'").select(*KEY, "ord", child.alias("child"), F.col("path").alias("program"), argv.alias("cmdline"))
    ran = live.filter("op = 'exec'").groupBy(*KEY, F.col("pid").alias("child")).agg(F.max("ord").alias("ran"))
    return spawns.join(ran, [*KEY, "child"], "left").filter("ran IS NULL OR ran < ord").drop("ran")


def network(live: DataFrame, cache_dir: str, **kw) -> DataFrame:
    """Connections with their class. A remote one is the session's background when the same process writes
    the package cache within five seconds: looked up as the next cache write, not as a range join."""
    given = field_of("extra", "class")
    kind = (F.when(given != "", given).when(F.col("path").startswith("unix:"), "unix")
            .when(F.col("path").startswith("inet:127.") | F.col("path").startswith("inet6:[::1]"), "loopback").otherwise("remote"))
    rc = F.when(field_of("extra", "rc") != "", field_of("extra", "rc")).otherwise(F.regexp_extract("extra", r"^rc=(\S+)", 1))
    errno = F.when(field_of("extra", "errno") != "", field_of("extra", "errno")).otherwise(F.regexp_extract("extra", r"errno=(\S+)", 1))
    caching = F.col("op").isin("open", "inherit") & F.contains(F.col("path"), F.lit(cache_dir)) & F.col("mode").isin("w", "rw")
    rows = live.filter((F.col("op") == "connect") | caching)
    rows = scan(rows, [*KEY, "pid"], ["ts_ns", "ord"], [Scan("cached", "last", F.when(caching, F.col("ts_ns")))], reverse=True, **kw)
    near = F.col("cached") - F.col("ts_ns") <= CACHE_WRITE_NS
    return rows.filter("op = 'connect'").withColumn("kind", kind).select(
        *KEY, "ord", "pid", "ts_ns", F.col("path").alias("address"),
        F.when((F.col("kind") == "remote") & near, "background").otherwise(F.col("kind")).alias("class"),
        ((rc == "0") | (errno == "115")).alias("ok"))


def _ops(live: DataFrame, states: DataFrame) -> DataFrame:
    """File operations per process for the tool calls: r read, w opened for writing, c closed, m missed, d gone."""
    shown = states.filter(F.col("cls").isin("project", "outside"))
    base_cols = [*KEY, "at", "pid", "path", "sha", (F.col("cls") == "outside").alias("outside")]
    op = lambda k, cond: shown.filter(cond).select(*base_cols, F.lit(k).alias("op"))
    mine = F.col("cls") == "project"
    missed = live.filter("op = 'openfail' AND class = 'project'").select(
        *KEY, (F.col("ord") * 2).alias("at"), "pid", "path", F.lit(None).cast("string").alias("sha"), F.lit(False).alias("outside"), F.lit("m").alias("op"))
    return (op("r", F.col("reads")).unionByName(op("w", F.col("kind").isin("open") & F.col("is_written")))
            .unionByName(op("c", (F.col("kind") == "closew") | (mine & (F.col("kind") == "onto") & F.col("sha").isNotNull())))
            .unionByName(op("d", mine & F.col("kind").isin("unlink", "away"))).unionByName(missed))


def program_names(commands: DataFrame) -> DataFrame:
    return commands.withColumn("name", program_name("program", "cmdline"))


def own_log(events: DataFrame, log_name: str) -> DataFrame:
    """Sessions without markers whose log is named after their first process (maybe with ``-2``)."""
    s = events.groupBy("session").agg(F.bool_or(F.col("op").isin(MARKERS)).alias("marked"), F.min_by("pid", F.when(~F.col("op").isin(MARKERS), F.col("ord"))).alias("root"),
                                      F.first(log_name).alias("log"))
    stem = F.regexp_replace(F.regexp_replace(base("log"), r"\.[^.]*$", ""), r"-\d+$", "")
    whole = F.regexp_replace(base("log"), r"\.[^.]*$", "")
    named = lambda b: F.regexp_extract(b, r"(\d+)$", 1) == F.col("root").cast("string")
    return s.select("session", (~F.col("marked") & F.col("root").isNotNull() & (named(stem) | named(whole))).alias("own_log"))


def placed(events: DataFrame, roots: DataFrame, repositories: DataFrame) -> DataFrame:
    """Project of each session: what ENV says, else by where its first command ran.

    The longest hashed root over that directory, or the repository around it when that lies in the root.
    Ancestors of the directory are looked up by equality, so no prefix is compared with every row.
    """
    said = events.filter("op = 'ENV'").select("session", "ord", F.nullif(field_of("extra", "project"), F.lit("")).alias("p")).filter(
        "p IS NOT NULL").groupBy("session").agg(F.max_by("p", "ord").alias("said"))
    where = events.filter("op = 'exec' AND path LIKE '/%'").groupBy("session").agg(F.min_by("path", "ord").alias("cwd"))
    parts = F.split("cwd", "/")
    above = where.select("session", "cwd", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    root = above.join(roots.select("session", F.col("root").alias("dir")), ["session", "dir"]).groupBy("session").agg(F.max_by("dir", F.length("dir")).alias("root"))
    repo = above.join(repositories.select(F.col("path").alias("dir")), "dir", "left_semi").groupBy("session").agg(F.max_by("dir", F.length("dir")).alias("repo"))
    inside = (F.col("repo") == F.col("root")) | F.col("repo").startswith(F.concat("root", F.lit("/")))
    return (events.select("session").distinct().join(said, "session", "left").join(root, "session", "left").join(repo, "session", "left")
            .select("session", F.coalesce("said", F.when(inside, F.col("repo")), "root").alias("project")))


def script_of(commands: DataFrame) -> DataFrame:
    """The R script a session's first command runs: ``R -f x``, ``R --file=x``, ``Rscript x``, made absolute."""
    first = commands.groupBy("session").agg(F.min_by(F.struct("cmdline", "cwd"), "ord").alias("c")).select("session", "c.*")
    w = words("cmdline")
    prog = base(F.get(w, 0))
    args = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
    after_f = F.get(args, F.when(F.array_position(args, F.lit("-f")) > 0, F.array_position(args, F.lit("-f")).cast("int")))
    eq = F.regexp_replace(F.get(F.filter(args, lambda a: a.startswith("--file=")), 0), "^--file=", "")
    plain = F.get(F.filter(args, lambda a: ~a.startswith("-")), 0)
    script = F.when(prog == "Rscript", F.coalesce(eq, plain)).when(prog == "R", F.coalesce(after_f, eq))
    full = F.when(script.startswith("/"), script).otherwise(F.concat("cwd", F.lit("/"), script))
    return first.select("session", full.alias("script")).filter("script IS NOT NULL")
