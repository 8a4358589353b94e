"""File versions, recipes, stories, descendants and summaries over recorded steps.

Steps are named by one key ``step``. ``inputs`` has (step, path, sha, from_step, status), ``outputs`` (step, path,
sha), ``steps`` (step, session, project, start, end, …), ``uses`` (step, def_step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.paths import base, directory, extension, work_file
from provenant.functions.terms import EMPTY_SHA256
from provenant.operators import components, graph, reach
from provenant.operators.ordered import Scan, asof, key_sizes, numbered, previous, scan
from provenant.session import cut

# Extensions of files that are code.
CODE_EXTENSIONS = [".r", ".py", ".qmd", ".rmd", ".ctl", ".mod", ".yaml", ".yml", ".sh", ".toml", ".jl"]


def effect(steps: DataFrame, inputs: DataFrame, outputs: DataFrame, network: DataFrame, missing: DataFrame, unrecorded: DataFrame) -> DataFrame:
    """Steps that touched project data, reached outside, or left a gap."""
    touched = inputs.filter(F.col("class").isin("project", "outside")).select("step")
    for part in (outputs, network.filter("class = 'remote'"), missing, unrecorded):
        touched = touched.unionByName(part.select("step"))
    return steps.join(touched, "step", "left_semi")


def without_noise(inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs without empty, rewritten and work files; outputs without empty and work files."""
    real = (F.col("sha") != EMPTY_SHA256) & ~work_file("path")
    return inputs.filter(real & ~F.col("rewritten")), outputs.filter(real)


def real_commands(commands: DataFrame, helpers: list[str]) -> DataFrame:
    return commands.filter(~F.col("name").isin(helpers))


def matching(steps: DataFrame, names: DataFrame, paths: DataFrame, tool: str | None, text: str | None) -> DataFrame:
    """Steps that ran a tool and touched a path with the text: ``names`` (step, name), ``paths`` (step, path)."""
    if tool is not None:
        steps = steps.join(names.filter(F.contains("name", F.lit(tool))).select("step"), "step", "left_semi")
    if text is not None:
        steps = steps.join(paths.filter(F.contains("path", F.lit(text))).select("step"), "step", "left_semi")
    return steps


def session_view(steps: DataFrame, children: DataFrame, labelled: DataFrame, outputs: DataFrame) -> DataFrame:
    """Steps with something left; the first of a labelled session goes when it has no label and no output."""
    kept = steps.join(children.select("step"), "step", "left_semi")
    first = steps.groupBy("session").agg(F.min_by("step", "start").alias("step"))
    first = first.join(labelled.join(steps, "step").select("session"), "session", "left_semi").select("step")
    idle = first.join(labelled.select("step"), "step", "left_anti").join(outputs.select("step"), "step", "left_anti")
    return kept.join(idle, "step", "left_anti")


def watched(sessions: DataFrame, folders: DataFrame, kept: DataFrame) -> DataFrame:
    """Sessions in or under a watched folder, and those kept by id; unplaced ones until they are closed.

    The folders above a project are looked up by equality.
    """
    parts = F.split("project", "/")
    above = sessions.select("session", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    hit = above.join(folders.select("path"), "path", "left_semi").select("session").unionByName(kept.select("session"))
    open_ = sessions.filter("project IS NULL AND NOT closed").select("session")
    return sessions.join(hit.unionByName(open_), "session", "left_semi")


def versions(inputs: DataFrame, outputs: DataFrame, steps: DataFrame) -> DataFrame:
    """Per (path, sha): source, intermediate or result, its last producer and how many steps read it."""
    times = steps.select("step", "end")
    made = outputs.join(times, "step").groupBy("path", "sha").agg(F.max_by("step", F.struct("end", "step")).alias("producer"), F.max("end").alias("made"))
    read = inputs.join(times, "step").groupBy("path", "sha").agg(F.count(F.lit(1)).alias("readers"), F.min("end").alias("seen"))
    role = F.when(F.col("producer").isNull(), "source").when(F.col("readers").isNull(), "result").otherwise("intermediate")
    return made.join(read, ["path", "sha"], "full").select("path", "sha", role.alias("role"), "producer", F.coalesce("readers", F.lit(0)).alias("readers"),
                                                           F.coalesce("made", "seen").alias("when"))


def step_edges(inputs: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Step → the steps it builds on, through files and variables."""
    edges = inputs.filter("from_step IS NOT NULL").select(F.col("step").alias("src"), F.col("from_step").alias("dst"))
    if uses is not None:
        edges = edges.unionByName(uses.select(F.col("step").alias("src"), F.col("def_step").alias("dst")))
    return edges.filter("src <> dst").distinct()


def recipes(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that led to each target step: ``(target, step, depth)``. Also the lineage tree, by depth."""
    found = graph.walk(targets.select(F.col("step").alias("root"), F.col("step").alias("node")), edges)
    return found.select(F.col("root").alias("target"), F.col("node").alias("step"), "depth")


def recipe_index(edges: DataFrame, inputs: DataFrame, steps: DataFrame) -> reach.Index:
    """Steps and the sources they started from as one index: a step leads to the steps it builds on and to its sources."""
    node = lambda c: F.concat(F.lit("t:"), F.col(c).cast("string"))
    begun = inputs.filter("from_step IS NULL").select(node("step").alias("src"), _source().alias("dst"))
    return reach.build(steps.select(node("step").alias("id")), edges.select(node("src").alias("src"), node("dst").alias("dst")).unionByName(begun))


def _source() -> Column:
    return F.concat_ws("\u0001", F.lit("s:"), "path", "sha")


def summaries(targets: DataFrame, index: reach.Index, inputs: DataFrame, steps: DataFrame, network: DataFrame, unrecorded: DataFrame, uses: DataFrame) -> DataFrame:
    """What can be said of the recipe behind each target in one row, from labels and without a row per target and step.

    ``steps`` has (step, start, script, code, status), null ``script`` for a typed step; ``network`` (step, class), ``unrecorded`` (step), ``uses`` (step,
    def_step). The row has the numbers of steps, sources, typed steps, hand edits, remote accesses, programs not recorded, steps whose code is not known
    and errors, the time the recipe begins, and the verdict as in ``verdicts``.
    """
    node = lambda c: F.concat(F.lit("t:"), F.col(c).cast("string"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    per = lambda df, name: df.groupBy("step").agg(F.count(F.lit(1)).alias(name))
    hand = inputs.filter("from_step IS NULL AND status = 'changed-outside'").select("step", "path", "sha").distinct()
    scripted = steps.select("step", F.col("script").isNotNull().alias("scripted"))
    needs = (uses.select("step", "def_step").join(scripted.filter("scripted").select("step"), "step").join(scripted.select(F.col("step").alias("def_step"), F.col("scripted").alias("by")), "def_step", "left")
             .filter(~F.coalesce("by", F.lit(False))))
    counted = ["hand", "network", "unrecorded", "needs"]
    rows = steps.select("step", "start", one(F.col("script").isNull()).alias("interactive"), one(F.col("code").isNull() | (F.col("code") == "")).alias("no_code"), one(F.col("status") == "err").alias("errors"))
    for name, df in zip(counted, (hand, network.filter("class = 'remote'"), unrecorded, needs), strict=True):
        rows = rows.join(per(df, name), "step", "left")
    rows = cut(rows)
    sums = ["steps", "sources", "interactive", *counted, "no_code", "errors"]
    zero, unit = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    at_steps = rows.select(node("step").alias("id"), unit.alias("steps"), zero.alias("sources"), "interactive", *(F.coalesce(c, zero).alias(c) for c in counted), "no_code", "errors")
    at_sources = inputs.filter("from_step IS NULL").select(_source().alias("id")).distinct().select("id", *((unit if c == "sources" else zero).alias(c) for c in sums))
    total = reach.totals(index, at_steps.select("id", *sums).unionByName(at_sources), sums)
    begins = reach.least(index, rows.select(node("step").alias("id"), F.col("start").alias("begins")), ["begins"])
    verdict = (F.when(F.col("interactive") > 0, "interactive").when(F.col("needs") > 0, "scripts-need-session").when(F.col("hand") > 0, "scripts-with-gaps").otherwise("scripts"))
    found = targets.select("step", node("step").alias("id")).distinct().join(total, "id").join(begins, "id")
    return found.select(F.col("step").alias("target"), *(c for c in sums if c != "needs"), "begins", verdict.alias("verdict"))


def recipe_steps(targets: DataFrame, index: reach.Index) -> DataFrame:
    """``(target, step)``: the steps behind some given targets, listed from labels; step as text."""
    found = reach.reached(index, targets.select(F.col("step").alias("root"), F.concat(F.lit("t:"), F.col("step").cast("string")).alias("node")))
    return found.filter("node LIKE 't:%'").select(F.col("root").alias("target"), F.expr("substring(node, 3)").alias("step"))


def detour_steps(recipe: DataFrame, steps: DataFrame) -> DataFrame:
    """``(target, step)``: other steps with effect in the recipe's sessions, from its first step to its target.

    Steps are numbered in their session, so a target's stretch of a session is a span of numbers, and only the steps in it are met.
    """
    numbered_steps = cut(numbered(steps.filter("effect").select("session", "step", "end"), ["session"], ["end", "step"], "n"))
    r = cut(recipe.join(steps.select("step", "session", "start", "end"), "step"))
    span = r.groupBy("target").agg(F.min("start").alias("first"), F.max(F.when(F.col("step") == F.col("target"), F.col("end"))).alias("last"))
    per = r.select("target", "session").distinct().join(span, "target")
    sizes = key_sizes(numbered_steps, ["session"]) + key_sizes(per, ["session"])
    a = asof(per, numbered_steps, ["session"], "last", "end", F.col("n"), "upto", right_tie=["n"], sizes=sizes)
    a = asof(a, numbered_steps, ["session"], "first", "end", F.col("n"), "before", right_tie=["n"], include_equal=False, sizes=sizes)
    inside = a.filter("upto IS NOT NULL AND upto > coalesce(before, 0)").select("target", "session", F.explode(F.sequence(F.coalesce("before", F.lit(0)) + 1, F.col("upto"))).alias("n"))
    return inside.join(numbered_steps.select("session", "n", "step"), ["session", "n"]).select("target", "step").join(r.select("target", "step"), ["target", "step"], "left_anti")


def recipe_sources(recipe: DataFrame, inputs: DataFrame) -> DataFrame:
    """Where each recipe started: inputs of its steps that nothing recorded produced."""
    return recipe.join(inputs.filter("from_step IS NULL").select("step", "path", "sha", "status"), "step").groupBy("target", "path", "sha").agg(
        F.max("status").alias("status"), F.count(F.lit(1)).alias("reads"))


def detours(recipe: DataFrame, steps: DataFrame) -> DataFrame:
    """Other steps with effect in the recipe's sessions between its first step and its target.

    Counted as the difference of two running counts per session, less the recipe's own steps.
    """
    r = recipe.join(steps.select("step", "session", "start", "end", "effect"), "step")
    span = r.groupBy("target").agg(F.min("start").alias("first"), F.max(F.when(F.col("step") == F.col("target"), F.col("end"))).alias("last"))
    per = r.select("target", "session").distinct().join(span, "target")
    own = steps.filter("effect").select("session", "end", "step")
    sizes = key_sizes(own, ["session"])
    counted = scan(own, ["session"], ["end", "step"], [Scan("n", "sum", F.lit(1).cast("bigint"))], sizes=sizes)
    both = sizes + key_sizes(per, ["session"])
    a = asof(per, counted, ["session"], "last", "end", F.col("n"), "upto", right_tie=["n"], sizes=both)
    a = asof(a, counted, ["session"], "first", "end", F.col("n"), "before", right_tie=["n"], include_equal=False, sizes=both)
    zero = F.lit(0).cast("bigint")
    total = a.groupBy("target").agg(F.sum(F.coalesce("upto", zero) - F.coalesce("before", zero)).alias("all"))
    own = r.join(span, "target").filter("effect AND `end` >= first AND `end` <= last").groupBy("target").agg(F.count(F.lit(1)).alias("own"))
    return total.join(own, "target", "left").select("target", (F.col("all") - F.coalesce("own", zero)).alias("detours"))


def writers_before(changed: DataFrame, outputs: DataFrame, steps: DataFrame) -> DataFrame:
    """The last step that wrote each path before a time: ``changed`` has (step, path, at)."""
    w = outputs.join(steps.select("step", "end"), "step").select("path", "end", F.col("step").alias("writer"))
    return asof(changed, w, ["path"], "at", "end", F.col("writer"), "writer", right_tie=["writer"])


def stories(targets: DataFrame, edges: DataFrame, inputs: DataFrame, outputs: DataFrame, steps: DataFrame) -> DataFrame:
    """A recipe and, behind each hand edit, the recipe of the version that was edited."""
    return recipes(targets, story_edges(edges, inputs, outputs, steps))


def story_edges(edges: DataFrame, inputs: DataFrame, outputs: DataFrame, steps: DataFrame) -> DataFrame:
    """The edges of recipes and those from a step that read a hand edit to the writer of what was edited."""
    hand = inputs.filter("status = 'changed-outside'").join(steps.select("step", F.col("start").alias("at")), "step").select("step", "path", "at")
    behind = writers_before(hand, outputs, steps).filter("writer IS NOT NULL AND writer <> step").select(F.col("step").alias("src"), F.col("writer").alias("dst"))
    return edges.unionByName(behind).distinct()


def gaps(recipe: DataFrame, sources: DataFrame, network: DataFrame, unrecorded: DataFrame, steps: DataFrame) -> DataFrame:
    """What a recording cannot account for; equal texts once with their number."""
    hand = sources.filter("status = 'changed-outside'").select("target", F.concat("path", F.lit(" was changed by hand")).alias("gap"))
    of = lambda df, text: recipe.join(df, "step").select("target", text.alias("gap"))
    net = of(network.filter("class = 'remote'").select("step", "address"), F.concat(F.lit("network access to "), "address"))
    prog = of(unrecorded.select("step", "program"), F.concat(F.lit("not recorded: "), base("program")))
    code = of(steps.filter("code IS NULL OR code = ''").select("step"), F.lit("code not known"))
    err = of(steps.filter("status = 'err'").select("step"), F.lit("ended with an error"))
    return hand.unionByName(net).unionByName(prog).unionByName(code).unionByName(err).groupBy("target", "gap").agg(F.count(F.lit(1)).alias("times"))


def verdicts(recipe: DataFrame, sources: DataFrame, uses: DataFrame, steps: DataFrame) -> DataFrame:
    """Can a target be redone: interactive, scripts-need-session, scripts-with-gaps or scripts.

    ``steps`` has ``script`` (null for a step that ran none).
    """
    s = steps.select("step", F.col("script").isNotNull().alias("scripted"))
    r = recipe.join(s, "step")
    typed = r.groupBy("target").agg(F.count_if(~F.col("scripted")).alias("interactive"))
    defs = s.select(F.col("step").alias("def_step"), F.col("scripted").alias("def_scripted"))
    needs = r.filter("scripted").join(uses.select("step", "def_step"), "step").join(defs, "def_step", "left").groupBy("target").agg(
        F.count_if(~F.coalesce("def_scripted", F.lit(False))).alias("session_vars"))
    hand = sources.groupBy("target").agg(F.bool_or(F.col("status") == "changed-outside").alias("hand"))
    kind = (F.when(F.col("interactive") > 0, "interactive").when(F.coalesce("session_vars", F.lit(0)) > 0, "scripts-need-session")
            .when(F.coalesce("hand", F.lit(False)), "scripts-with-gaps").otherwise("scripts"))
    return typed.join(needs, "target", "left").join(hand, "target", "left").select("target", "interactive", kind.alias("verdict"))


def script_runs(recipe: DataFrame, steps: DataFrame) -> DataFrame:
    """Script runs of a recipe in order; consecutive steps of one script are one run."""
    r = recipe.join(steps.filter("script IS NOT NULL").select("step", "script", "end"), "step")
    r = previous(r, ["target"], ["end", "step"], "__before", F.col("script"))
    return r.filter("__before IS NULL OR __before <> script").select("target", "step", "script")


def descendants(starts: DataFrame, inputs: DataFrame, outputs: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Steps that used a version directly or through what they made: ``(path, sha, step)``.

    Versions and steps are both nodes, so a version that many steps read costs its readers, not pairs.
    """
    v = lambda p="path", s="sha": F.concat_ws("\u0001", F.lit("v"), p, s)
    st = lambda c: F.concat_ws("\u0001", F.lit("t"), c)
    edges = inputs.select(v().alias("src"), st("step").alias("dst")).unionByName(outputs.select(st("step").alias("src"), v().alias("dst")))
    if uses is not None:
        edges = edges.unionByName(uses.select(st("def_step").alias("src"), st("step").alias("dst")))
    found = graph.walk(starts.select(v().alias("root"), v().alias("node")), edges).filter(F.col("node").startswith("t\u0001"))
    parts = F.split("root", "\u0001")
    return found.select(parts[1].alias("path"), parts[2].alias("sha"), F.substring_index("node", "\u0001", -1).alias("step"))


def flow_order(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``steps`` (step, end) with level, in_cycle and place: producer before reader, the steps of a cycle by time. Order an answer by them."""
    before = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return components.order(steps.select(F.col("step").alias("id"), "end"), before, F.col("end")).select(F.col("id").alias("step"), "level", "in_cycle", "place")


def flow_levels(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Producer before reader: order an answer by (level, end)."""
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.levels(steps.select(F.col("step").alias("id")), up).select(F.col("id").alias("step"), "level")


def place_of(steps: DataFrame) -> DataFrame:
    """Where a step ran: document chunk, script, file, command or console; ``steps`` has chunk, file, script, command."""
    return steps.select("step", F.when(F.col("chunk").isNotNull(), F.concat("file", F.lit(" chunk "), "chunk")).when(F.col("script").isNotNull(), F.col("script"))
                        .when(F.col("file").isNotNull(), F.col("file")).when(F.col("command").isNotNull(), F.col("command")).otherwise("console").alias("place"))


def tools_of(commands: DataFrame, tools: list[str]) -> DataFrame:
    """Known tools each step's programs stand for, in the order of the list."""
    hit = F.filter(F.array(*[F.lit(x) for x in tools]), lambda x: F.contains(F.col("name"), x))
    return commands.select("step", F.explode(hit).alias("tool")).distinct().groupBy("step").agg(
        F.array_sort(F.collect_set(F.struct(F.array_position(F.array(*[F.lit(x) for x in tools]), F.col("tool")).alias("i"), "tool"))).alias("t")).select(
        "step", F.col("t.tool").alias("tools"))


def attach_reproduction(steps: DataFrame, reports: DataFrame) -> DataFrame:
    """The latest reproduction of each target joined to the steps it repeated: different and not produced outputs."""
    newest = reports.groupBy("target").agg(F.max("when").alias("when"))
    rows = reports.join(newest, ["target", "when"])
    state = rows.groupBy("target", "step").agg(
        F.count_if(F.col("reproduced").isNotNull() & (F.col("reproduced") != F.col("recorded"))).alias("different"),
        F.count_if(F.col("reproduced").isNull()).alias("not_produced"))
    return steps.join(state, "step")


def node_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32)


def observation_nodes(steps: DataFrame, inputs: DataFrame) -> DataFrame:
    """Step nodes and source nodes; a source is code or a dataset by its extension."""
    own = steps.select(node_id("session", "step").alias("id"), F.lit("step").alias("type"), F.lit(None).cast("string").alias("kind"), F.col("session").alias("participant"))
    src = inputs.filter("from_step IS NULL AND sha <> ''").join(steps.select("step", "session", "end"), "step")
    src = src.groupBy(F.col("sha").alias("id")).agg(F.min_by(F.struct("path", "session"), F.struct("end", "step", "path")).alias("s"))
    kind = F.when(extension("s.path").isin(CODE_EXTENSIONS), "code").otherwise("dataset")
    return own.unionByName(src.select("id", F.lit("source").alias("type"), kind.alias("kind"), F.col("s.session").alias("participant")))


def observation_edges(steps: DataFrame, inputs: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """builds-on edges between steps and to sources."""
    ids = steps.select("step", node_id("session", "step").alias("id"))
    between = step_edges(inputs, uses).join(ids.select(F.col("step").alias("src"), F.col("id").alias("source")), "src").join(
        ids.select(F.col("step").alias("dst"), F.col("id").alias("target")), "dst").select("source", "target")
    to_src = inputs.filter("from_step IS NULL AND sha <> ''").join(ids, "step").select(F.col("id").alias("source"), F.col("sha").alias("target"))
    return between.unionByName(to_src).distinct().withColumn("kind", F.lit("builds-on"))


def participant_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different participants with their number; a source belongs to nobody."""
    n = nodes.filter("type = 'step'").select("id", "participant")
    return (edges.join(n.select(F.col("id").alias("source"), F.col("participant").alias("from")), "source")
            .join(n.select(F.col("id").alias("target"), F.col("participant").alias("to")), "target").filter("`from` <> `to`")
            .groupBy("from", "to", "kind").agg(F.count(F.lit(1)).alias("edges")))


def projects(steps: DataFrame) -> DataFrame:
    """Sessions, tasks and last activity per project. Counted per session first, so one project is few rows."""
    per = steps.groupBy("project", "session").agg(F.count(F.lit(1)).alias("tasks"), F.max("end").alias("last"))
    return per.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("tasks").alias("tasks"), F.max("last").alias("last"))


def runs(sessions: DataFrame, steps: DataFrame, interesting: DataFrame, with_empty: bool = False) -> DataFrame:
    """Sessions as runs with their kind and the number of steps worth showing."""
    n = steps.join(interesting.select("step"), "step", "left_semi").groupBy("session").agg(F.count(F.lit(1)).alias("shown"))
    kind = F.when(F.col("language") == "python", "Python").when(F.col("console"), "console").otherwise("terminal")
    out = sessions.join(n, "session", "left").select("session", kind.alias("kind"), F.coalesce("shown", F.lit(0)).alias("steps"), "start")
    return out if with_empty else out.filter("steps > 0")


def difference_origins(outcome: DataFrame, edges: DataFrame) -> DataFrame:
    """Per reproduced step: failed, reproduces or differs, and whether a step it builds on already did not reproduce.

    A differing step with no such step behind it differs on its own.
    """
    bad = outcome.filter("state <> 'reproduces'").select(F.col("step").alias("dst"))
    caused = edges.join(bad, "dst", "left_semi").select(F.col("src").alias("step")).distinct().withColumn("__up", F.lit(True))
    return outcome.join(caused, "step", "left").select("step", "state", ((F.col("state") == "differs") & F.col("__up").isNull()).alias("on_its_own"))


def new_versions(outputs: DataFrame, steps: DataFrame, published: DataFrame) -> DataFrame:
    """New bytes nobody published at a path whose bytes before were: with the last publisher of those.

    ``published`` has (sha, record, seq).
    """
    o = outputs.join(steps.select("step", "end"), "step")
    o = previous(o, ["path"], ["end", "step"], "before_sha", F.col("sha"))
    last = published.groupBy(F.col("sha").alias("before_sha")).agg(F.max_by("record", "seq").alias("replaces"))
    return o.join(published.select("sha"), "sha", "left_anti").join(last, "before_sha").select("step", "path", "sha", "replaces")


def based_on(control: DataFrame, outputs: DataFrame, published: DataFrame) -> DataFrame:
    """The parent run a control file names in a comment: its listing's last published producer.

    The comment starts a line (``; based_on: run``), ``-`` names none; the listing lies in the parent's own folder beside
    the control file's.
    """
    name = F.regexp_extract("text", r"(?m)^;\s*based_on:\s*(\S+)", 1)
    sibling = F.concat(F.regexp_replace(directory(directory("path")), "/$", ""), F.lit("/"), F.col("parent"), F.lit("/"), F.col("parent"), F.lit(".lst"))
    c = control.withColumn("parent", name).filter("parent NOT IN ('', '-')").withColumn("listing", sibling)
    made = outputs.select(F.col("path").alias("listing"), "sha").join(published, "sha").groupBy("listing").agg(F.max_by("record", "seq").alias("record"))
    return c.join(made, "listing").select("path", "parent", "record")


def roles(version: DataFrame) -> DataFrame:
    return version.groupBy("role").agg(F.count(F.lit(1)).alias("files"))


def directories(files: DataFrame, prefix: str) -> DataFrame:
    """The next directory level under a prefix with its number of files; files right there are under the empty name."""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    return files.filter(F.col("path").startswith(prefix)).groupBy(F.regexp_extract(rest, "^[^/]*/", 0).alias("directory")).agg(F.count(F.lit(1)).alias("files"))


def expired(sessions: DataFrame, before, kept: DataFrame, noted: DataFrame, kept_projects: DataFrame) -> DataFrame:
    """Sessions older than a limit that nothing keeps."""
    old = sessions.filter(F.col("last") < F.lit(before)).join(kept.select("session"), "session", "left_anti").join(noted.select("session"), "session", "left_anti")
    return old.join(kept_projects.select("project"), "project", "left_anti").select("session")


def evicted(store: DataFrame, cap: int) -> DataFrame:
    """Least recently used files to remove so that what is left fits the cap."""
    total = store.agg(F.sum("size")).first()[0] or 0
    return _running_total(store).filter(F.coalesce("__before", F.lit(0)) < total - cap).select("sha", "size")


def _running_total(store: DataFrame) -> DataFrame:
    """Sizes of everything used before a file. There is one order over the whole store, so it is cut by day:
    running sums within days, and days carried over from a table of one row a day."""
    day = F.floor(F.col("last_use") / 86_400).alias("day")
    s = store.withColumn("day", day)
    days = s.groupBy("day").agg(F.sum("size").alias("total")).withColumn("all", F.lit(0))
    carried = scan(days, ["all"], ["day"], [Scan("carry", "sum", F.col("total"), False)]).select("day", "carry")
    inside = scan(s, ["day"], ["last_use", "sha"], [Scan("__in", "sum", F.col("size"), False)])
    return inside.join(carried, "day").withColumn("__before", F.coalesce("carry", F.lit(0)) + F.coalesce("__in", F.lit(0)))
