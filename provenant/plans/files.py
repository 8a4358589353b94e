"""Queries over file versions, recipes, calls, plans and workflows.

Steps are read from the events: a purchase writes the file of its key, a click reads that file and writes the
next one, a view reads it. A reader gets what the last writer before it left; from a value of 30 up it finds the
file edited by hand.
"""

from pyspark.sql import functions as F

from provenant.functions.terms import field_of
from provenant.operators import calls as CA
from provenant.operators import files as X
from provenant.operators import links as L
from provenant.operators import records as R
from provenant.operators import trust as T
from provenant.operators import workflows as W
from provenant.operators.ordered import asof
from provenant.plans.records import _latest
from provenant.plans.registry import query
from provenant.plans.traces import USES, variables
from provenant.session import cut

STEPS = """steps AS (SELECT event_id AS step, 's'||user_id AS session, epoch_us(ts) AS "end", event_type, k, value FROM trace_source WHERE event_type IN ('purchase','click','view')),
outp AS (SELECT step, '/proj/'||(CASE event_type WHEN 'purchase' THEN k ELSE (k+1)%100 END) AS path, 'v'||step AS sha, "end" FROM steps WHERE event_type<>'view'),
rd AS (SELECT step, '/proj/'||k AS path, "end", value FROM steps WHERE event_type<>'purchase'),
inp0 AS MATERIALIZED (SELECT rd.*, w.step AS w FROM rd ASOF LEFT JOIN outp w ON rd.path=w.path AND rd."end">w."end"),
inp AS (SELECT step, path, "end", w, CASE WHEN w IS NULL THEN 'orig'||path WHEN value>=30 THEN 'edit'||step ELSE 'v'||w END AS sha,
  CASE WHEN value<30 THEN w END AS from_step, CASE WHEN w IS NOT NULL AND value>=30 THEN 'changed-outside' ELSE 'observed' END AS status FROM inp0),
edges AS (SELECT DISTINCT step AS src, from_step AS dst FROM inp WHERE from_step IS NOT NULL)"""
# Every step's recipe in SQL: a step has at most one step before it.
RECIPES = STEPS + """,
rec AS (SELECT step AS target, step, CAST(0 AS BIGINT) AS depth FROM outp UNION ALL SELECT r.target, e.dst, r.depth+1 FROM rec r JOIN edges e ON e.src=r.step)"""


class Steps:
    def __init__(self, t):
        e = t._events.filter("event_type IN ('purchase', 'click', 'view')")
        self.steps = e.select(F.col("event_id").alias("step"), F.concat(F.lit("s"), "user_id").alias("session"), F.lit("/proj").alias("project"),
                              F.unix_micros("ts").alias("start"), F.unix_micros("ts").alias("end"), "event_type", "value", "k",
                              F.lit(True).alias("effect"))
        path = lambda k: F.concat(F.lit("/proj/"), k)
        k = F.when(F.col("event_type") == "purchase", F.col("k")).otherwise((F.col("k") + 1) % 100)
        self.outputs = self.steps.filter("event_type <> 'view'").select("step", path(k).alias("path"), F.concat(F.lit("v"), "step").alias("sha"), "end")
        reads = self.steps.filter("event_type <> 'purchase'").select("step", path(F.col("k")).alias("path"), "end", "value")
        got = asof(reads, self.outputs.select("path", F.col("end").alias("at"), F.col("step").alias("w")), ["path"], "end", "at", F.col("w"), "w",
                   right_tie=["w"], include_equal=False)
        hand = F.col("value") >= 30
        self.inputs = got.select(
            "step", "path", F.when(F.col("w").isNull(), F.concat(F.lit("orig"), "path")).when(hand, F.concat(F.lit("edit"), "step")).otherwise(
                F.concat(F.lit("v"), "w")).alias("sha"), F.when(~hand, F.col("w")).alias("from_step"),
            F.when(F.col("w").isNotNull() & hand, "changed-outside").otherwise("observed").alias("status"))
        self.outputs = self.outputs.drop("end")

    def recipes(self):
        return X.recipes(self.outputs.select("step"), X.step_edges(self.inputs))


@query("file_versions", f"""WITH {STEPS},
m AS (SELECT path, sha, arg_max(step, "end") AS producer FROM outp GROUP BY ALL), r AS (SELECT path, sha, count(*) AS readers FROM inp GROUP BY ALL)
SELECT path, sha, CASE WHEN producer IS NULL THEN 'source' WHEN readers IS NULL THEN 'result' ELSE 'intermediate' END AS role, producer, coalesce(readers,0) AS readers
FROM m FULL JOIN r USING (path, sha)""")
def _(t):
    s = Steps(t)
    return X.versions(s.inputs, s.outputs, s.steps).drop("when")


@query("files_per_role", f"""WITH {STEPS}, v AS (SELECT path, sha, bool_or(o) AS made, bool_or(NOT o) AS read FROM (SELECT path, sha, true AS o FROM outp UNION ALL SELECT path, sha, false FROM inp) GROUP BY ALL)
SELECT CASE WHEN NOT made THEN 'source' WHEN NOT read THEN 'result' ELSE 'intermediate' END AS role, count(*) AS files FROM v GROUP BY 1""")
def _(t):
    s = Steps(t)
    return X.roles(X.versions(s.inputs, s.outputs, s.steps))


@query("files_per_directory", "SELECT source||'/' AS directory, count(*) AS files FROM manifest GROUP BY source")
def _(t):
    return X.directories(t.manifest, "/d/")


@query("recipes", f"WITH RECURSIVE {RECIPES} SELECT target, step, min(depth) AS depth FROM rec GROUP BY target, step")
def _(t):
    return Steps(t).recipes()


@query("recipe_sources", f"""WITH RECURSIVE {RECIPES} SELECT target, path, sha, max(status) AS status, count(*) AS reads FROM rec JOIN inp USING (step) WHERE from_step IS NULL GROUP BY ALL""")
def _(t):
    s = Steps(t)
    return X.recipe_sources(s.recipes(), s.inputs)


@query("detours", f"""WITH RECURSIVE {RECIPES},
sp AS (SELECT target, min(s."end") AS first, max(s."end") AS last FROM rec JOIN steps s USING (step) GROUP BY target),
ses AS (SELECT DISTINCT target, session FROM rec JOIN steps USING (step))
SELECT sp.target, (SELECT count(*) FROM steps s JOIN ses ON ses.session=s.session AND ses.target=sp.target WHERE s."end">=first AND s."end"<=last)
  - (SELECT count(*) FROM rec WHERE rec.target=sp.target) AS detours FROM sp""")
def _(t):
    s = Steps(t)
    return X.detours(s.recipes(), s.steps)


@query("recipe_verdicts", f"""WITH RECURSIVE {RECIPES},
h AS (SELECT target, bool_or(status='changed-outside') AS hand FROM rec JOIN inp USING (step) WHERE from_step IS NULL GROUP BY target),
i AS (SELECT target, count(*) FILTER (value<3) AS interactive FROM rec JOIN steps USING (step) GROUP BY target)
SELECT target, interactive, CASE WHEN interactive>0 THEN 'interactive' WHEN coalesce(hand,false) THEN 'scripts-with-gaps' ELSE 'scripts' END AS verdict FROM i LEFT JOIN h USING (target)""")
def _(t):
    """Steps of a small value were typed, the rest ran a script."""
    s = Steps(t)
    recipe = cut(s.recipes())
    steps = s.steps.withColumn("script", F.when(F.col("value") >= 3, F.concat(F.lit("/proj/step"), "k", F.lit(".R"))))
    none = s.steps.select("step", F.col("step").alias("def_step")).limit(0)
    return X.verdicts(recipe, X.recipe_sources(recipe, s.inputs), none, steps)


@query("recipe_verdicts_with_variables", f"""WITH RECURSIVE {RECIPES},
df AS (SELECT session, k, step FROM steps WHERE event_type='purchase'),
us AS (SELECT u.step, d.step AS def_step FROM (SELECT session, k, step FROM steps WHERE event_type='click') u ASOF JOIN df d ON u.session=d.session AND u.k=d.k AND u.step>d.step),
nd AS (SELECT DISTINCT rec.target FROM rec JOIN steps s USING (step) JOIN us USING (step) JOIN steps d ON d.step=us.def_step WHERE s.value>=3 AND d.value<3),
h AS (SELECT target, bool_or(status='changed-outside') AS hand FROM rec JOIN inp USING (step) WHERE from_step IS NULL GROUP BY target),
i AS (SELECT target, count(*) FILTER (value<3) AS interactive FROM rec JOIN steps USING (step) GROUP BY target)
SELECT target, interactive, CASE WHEN interactive>0 THEN 'interactive' WHEN target IN (SELECT target FROM nd) THEN 'scripts-need-session' WHEN coalesce(hand,false) THEN 'scripts-with-gaps' ELSE 'scripts' END AS verdict FROM i LEFT JOIN h USING (target)""")
def _(t):
    """As before; a click is code that uses the variable its session's last purchase of the same key defined."""
    s = Steps(t)
    recipe = cut(s.recipes())
    steps = s.steps.withColumn("script", F.when(F.col("value") >= 3, F.concat(F.lit("/proj/step"), "k", F.lit(".R"))))
    of = lambda kind: s.steps.filter(F.col("event_type") == kind).select("session", F.col("step").alias("task_no"), F.concat(F.lit("x"), "k").alias("name"))
    uses = L.variable_uses(of("click"), of("purchase")).select(F.col("task_no").alias("step"), F.col("def_task").alias("def_step"))
    return X.verdicts(recipe, X.recipe_sources(recipe, s.inputs), uses, steps)


USES_OF = """df AS (SELECT session, k, step FROM steps WHERE event_type='purchase'),
us AS (SELECT u.step, d.step AS def_step FROM (SELECT session, k, step FROM steps WHERE event_type='click') u ASOF JOIN df d ON u.session=d.session AND u.k=d.k AND u.step>d.step)"""


def _summed(s, t, targets, edges):
    """Summaries with the tables' variables and connects; steps of a small value were typed, of a great one failed."""
    of = lambda kind: s.steps.filter(F.col("event_type") == kind).select("session", F.col("step").alias("task_no"), F.concat(F.lit("x"), "k").alias("name"))
    uses = L.variable_uses(of("click"), of("purchase")).select(F.col("task_no").alias("step"), F.col("def_task").alias("def_step"))
    steps = s.steps.withColumn("script", F.when(F.col("value") >= 3, F.concat(F.lit("/proj/step"), "k", F.lit(".R")))).withColumn(
        "status", F.when(F.col("value") > 100, "err").otherwise("ok")).withColumn("code", F.when(F.col("value") >= 1, "run()"))
    net = t.trace_event.filter("op = 'connect'").select(F.floor(F.col("ord") / 2).alias("step"), field_of("extra", "class").alias("class"))
    inputs = cut(s.inputs)
    return X.summaries(targets, X.recipe_index(edges(inputs), inputs, s.steps), inputs, steps, net, s.steps.limit(0).select("step"), uses)


SUMMARY = """pr AS (SELECT DISTINCT target, step FROM rec),
src AS (SELECT target, count(DISTINCT (path, sha)) AS sources, count(DISTINCT (step, path, sha)) FILTER (status='changed-outside') AS hand FROM pr JOIN inp USING (step) WHERE from_step IS NULL GROUP BY target),
nd AS (SELECT pr.target, count(*) AS needs FROM pr JOIN steps s USING (step) JOIN us USING (step) JOIN steps d ON d.step=us.def_step WHERE s.value>=3 AND d.value<3 GROUP BY pr.target),
sm AS (SELECT target, count(*) AS steps, count(*) FILTER (value<3) AS interactive, count(*) FILTER (event_type='click' AND value<5) AS network, 0 AS unrecorded,
  count(*) FILTER (value<1) AS no_code, count(*) FILTER (value>100) AS errors, min("end") AS begins FROM pr JOIN steps USING (step) GROUP BY target)
SELECT target, steps, coalesce(sources,0) AS sources, interactive, coalesce(hand,0) AS hand, network, unrecorded, no_code, errors, begins,
  CASE WHEN interactive>0 THEN 'interactive' WHEN needs>0 THEN 'scripts-need-session' WHEN hand>0 THEN 'scripts-with-gaps' ELSE 'scripts' END AS verdict
FROM sm LEFT JOIN src USING (target) LEFT JOIN nd USING (target)"""


@query("recipe_summaries", f"WITH RECURSIVE {RECIPES}, {USES_OF}, {SUMMARY}")
def _(t):
    """One row per recipe, merged along the labels of the reachability index; nothing is written per recipe and step."""
    s = Steps(t)
    return _summed(s, t, s.outputs.select("step"), X.step_edges)


@query("story_summaries", f"""WITH RECURSIVE {STEPS}, e2 AS (SELECT DISTINCT step AS src, w AS dst FROM inp WHERE w IS NOT NULL),
rec AS (SELECT step AS target, step FROM outp UNION ALL SELECT r.target, e.dst FROM rec r JOIN e2 e ON e.src=r.step), {USES_OF}, {SUMMARY}""")
def _(t):
    """The same of stories: behind each hand edit goes on the recipe of the version that was edited."""
    s = Steps(t)
    return _summed(s, t, s.outputs.select("step"), lambda inputs: X.story_edges(X.step_edges(inputs), inputs, s.outputs, s.steps))


@query("detour_steps", f"""WITH RECURSIVE {RECIPES},
res AS (SELECT step FROM outp WHERE (path, sha) NOT IN (SELECT (path, sha) FROM inp) QUALIFY row_number() OVER (PARTITION BY path ORDER BY "end" DESC, step DESC)=1),
rr AS (SELECT DISTINCT target, step FROM rec WHERE target IN (SELECT step FROM res)),
sp AS (SELECT target, min(s."end") AS first, max(CASE WHEN step=target THEN s."end" END) AS last FROM rr JOIN steps s USING (step) GROUP BY target),
ses AS (SELECT DISTINCT target, session FROM rr JOIN steps USING (step))
SELECT sp.target, s.step FROM sp JOIN ses USING (target) JOIN steps s USING (session) WHERE s."end">=first AND s."end"<=last AND (sp.target, s.step) NOT IN (SELECT (target, step) FROM rr)""")
def _(t):
    """The steps themselves, for the newest result of every path."""
    s = Steps(t)
    inputs = cut(s.inputs)
    unread = s.outputs.join(inputs.select("path", "sha"), ["path", "sha"], "left_anti").join(s.steps.select("step", "end"), "step")
    newest = unread.groupBy("path").agg(F.max_by("step", F.struct("end", "step")).alias("step")).select("step")
    index = X.recipe_index(X.step_edges(inputs), inputs, s.steps)
    recipe = X.recipe_steps(newest, index).select("target", F.col("step").cast("bigint").alias("step"))
    return X.detour_steps(recipe, s.steps)


@query("recipe_gaps", f"""WITH RECURSIVE {RECIPES},
g AS (SELECT target, path||' was changed by hand' AS gap, 1 AS n FROM (SELECT DISTINCT target, path, sha FROM rec JOIN inp USING (step) WHERE status='changed-outside')
UNION ALL SELECT target, 'ended with an error', 1 FROM rec JOIN steps USING (step) WHERE value>100)
SELECT target, gap, count(*) AS times FROM g GROUP BY ALL""")
def _(t):
    s = Steps(t)
    recipe = cut(s.recipes())
    steps = s.steps.withColumn("status", F.when(F.col("value") > 100, "err").otherwise("ok")).withColumn("code", F.lit("run()"))
    none = s.steps.limit(0)
    net = none.select("step", F.lit("remote").alias("class"), F.lit("").alias("address"))
    return X.gaps(recipe, X.recipe_sources(recipe, s.inputs), net, none.select("step", F.lit("").alias("program")), steps)


@query("recipe_gaps_with_network", f"""WITH RECURSIVE {RECIPES},
g AS (SELECT target, path||' was changed by hand' AS gap, 1 AS n FROM (SELECT DISTINCT target, path, sha FROM rec JOIN inp USING (step) WHERE status='changed-outside')
UNION ALL SELECT target, 'network access to inet:10.0.0.'||k||':443', 1 FROM rec JOIN steps USING (step) WHERE event_type='click' AND value<5
UNION ALL SELECT target, 'ended with an error', 1 FROM rec JOIN steps USING (step) WHERE value>100)
SELECT target, gap, count(*) AS times FROM g GROUP BY ALL""")
def _(t):
    """As before, with the remote connects of the trace; the trace has no spawns, so no program in it is unrecorded."""
    s = Steps(t)
    recipe = cut(s.recipes())
    steps = s.steps.withColumn("status", F.when(F.col("value") > 100, "err").otherwise("ok")).withColumn("code", F.lit("run()"))
    net = t.trace_event.filter("op = 'connect'").select(F.floor(F.col("ord") / 2).alias("step"), field_of("extra", "class").alias("class"), F.col("path").alias("address"))
    return X.gaps(recipe, X.recipe_sources(recipe, s.inputs), net, s.steps.limit(0).select("step", F.lit("").alias("program")), steps)


@query("stories", f"""WITH RECURSIVE {STEPS},
e2 AS (SELECT DISTINCT step AS src, w AS dst FROM inp WHERE w IS NOT NULL),
rec AS (SELECT step AS target, step, CAST(0 AS BIGINT) AS depth FROM outp UNION ALL SELECT r.target, e.dst, r.depth+1 FROM rec r JOIN e2 e ON e.src=r.step)
SELECT target, step, min(depth) AS depth FROM rec GROUP BY target, step""")
def _(t):
    s = Steps(t)
    ins = cut(s.inputs)
    return X.stories(s.outputs.select("step"), X.step_edges(ins), ins, s.outputs, s.steps)


@query("descendants", f"""WITH RECURSIVE {STEPS},
down AS (SELECT i.path, i.sha, i.step FROM inp i WHERE i.sha LIKE 'orig%' UNION SELECT d.path, d.sha, e.src FROM down d JOIN edges e ON e.dst=d.step)
SELECT * FROM down""")
def _(t):
    s = Steps(t)
    ins = cut(s.inputs)
    starts = ins.filter("sha LIKE 'orig%'").select("path", "sha").distinct()
    return X.descendants(starts, ins, s.outputs).withColumn("step", F.col("step").cast("bigint"))


@query("flow_levels", f"""WITH RECURSIVE {STEPS},
lv AS (SELECT s.step, CAST(0 AS BIGINT) AS level FROM steps s WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src=s.step) UNION ALL SELECT e.src, l.level+1 FROM lv l JOIN edges e ON e.dst=l.step)
SELECT step, max(level) AS level FROM lv GROUP BY step""")
def _(t):
    s = Steps(t)
    return X.flow_levels(s.steps, X.step_edges(s.inputs))


@query("flow_order", f"""WITH RECURSIVE {STEPS},
lv AS (SELECT s.step, CAST(0 AS BIGINT) AS level FROM steps s WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src=s.step) UNION ALL SELECT e.src, l.level+1 FROM lv l JOIN edges e ON e.dst=l.step)
SELECT step, max(level) AS level, false AS in_cycle, 1 AS place FROM lv GROUP BY step""")
def _(t):
    s = Steps(t)
    return X.flow_order(s.steps, X.step_edges(s.inputs))


@query("observation_graph", f"""WITH {STEPS},
x AS (SELECT substr(sha256(s.session||chr(0)||s.step),1,32) AS source, CASE WHEN from_step IS NULL THEN sha ELSE substr(sha256(f.session||chr(0)||f.step),1,32) END AS target
FROM inp i JOIN steps s USING (step) LEFT JOIN steps f ON f.step=i.from_step)
SELECT DISTINCT source, target, 'builds-on' AS kind FROM x""")
def _(t):
    s = Steps(t)
    return X.observation_edges(s.steps, s.inputs)


@query("observation_nodes", f"""WITH {STEPS}
SELECT substr(sha256(session||chr(0)||step),1,32) AS id, 'step' AS type, NULL AS kind, session AS participant FROM steps
UNION ALL SELECT sha, 'source', 'dataset', arg_min(session, (s."end", s.step)) FROM inp i JOIN steps s USING (step) WHERE from_step IS NULL GROUP BY sha""")
def _(t):
    s = Steps(t)
    return X.observation_nodes(s.steps, s.inputs)


@query("participant_edges", f"""WITH {STEPS}
SELECT a.session AS "from", b.session AS "to", 'builds-on' AS kind, count(*) AS edges FROM edges e JOIN steps a ON a.step=e.src JOIN steps b ON b.step=e.dst WHERE a.session<>b.session GROUP BY ALL""")
def _(t):
    s = Steps(t)
    return X.participant_edges(X.observation_nodes(s.steps, s.inputs), X.observation_edges(s.steps, s.inputs))


@query("projects", f"""WITH {STEPS} SELECT '/proj' AS project, count(DISTINCT session) AS sessions, count(*) AS tasks, max("end") AS last FROM steps""")
def _(t):
    return X.projects(Steps(t).steps)


@query("runs", f"""WITH {STEPS} SELECT session, CASE WHEN count(*) FILTER (event_type='view')>0 THEN 'console' ELSE 'terminal' END AS kind, count(*) FILTER (value>=20) AS steps
FROM steps GROUP BY session HAVING count(*) FILTER (value>=20)>0""")
def _(t):
    s = Steps(t).steps
    sessions = s.groupBy("session").agg(F.max(F.col("event_type") == "view").alias("console"), F.min("start").alias("start")).withColumn("language", F.lit("r"))
    return X.runs(sessions, s, s.filter("value >= 20")).drop("start")


@query("origins_of_differences", f"""WITH {STEPS}, o AS (SELECT step, CASE WHEN value>=40 THEN 'failed' WHEN value>=15 THEN 'differs' ELSE 'reproduces' END AS state FROM steps)
SELECT o.step, o.state, o.state='differs' AND NOT EXISTS (SELECT 1 FROM edges e JOIN o b ON b.step=e.dst WHERE e.src=o.step AND b.state<>'reproduces') AS on_its_own FROM o""")
def _(t):
    s = Steps(t)
    outcome = s.steps.select("step", F.when(F.col("value") >= 40, "failed").when(F.col("value") >= 15, "differs").otherwise("reproduces").alias("state"))
    return X.difference_origins(outcome, X.step_edges(s.inputs))


@query("new_versions", f"""WITH {STEPS}, l AS (SELECT step, path, sha, lag(sha) OVER (PARTITION BY path ORDER BY "end", step) AS b FROM outp),
p AS (SELECT o.sha, o.step FROM outp o JOIN steps s USING (step) WHERE s.value<10)
SELECT l.step, l.path, l.sha, 'rec'||substr(l.b,2) AS replaces FROM l WHERE l.sha NOT IN (SELECT sha FROM p) AND l.b IN (SELECT sha FROM p)""")
def _(t):
    s = Steps(t)
    pub = s.outputs.join(s.steps.filter("value < 10").select("step"), "step").select("sha", F.concat(F.lit("rec"), "step").alias("record"), F.col("step").alias("seq"))
    return X.new_versions(s.outputs, s.steps, pub)


@query("reproductions_attached", f"""WITH {STEPS}
SELECT step, CAST(value>=20 AND value<40 AS BIGINT)::BIGINT AS different, CAST(value>=40 AS BIGINT) AS not_produced FROM steps WHERE event_type<>'view'""")
def _(t):
    s = Steps(t)
    rows = s.outputs.join(s.steps.select("step", "value"), "step")
    again = F.when(F.col("value") < 20, F.col("sha")).when(F.col("value") < 40, F.concat("sha", F.lit("x")))
    reports = rows.select(F.col("path").alias("target"), "step", F.col("sha").alias("recorded"), again.alias("reproduced"), F.lit(2).alias("when"))
    older = reports.withColumn("when", F.lit(1)).withColumn("reproduced", F.lit(None).cast("string"))
    return X.attach_reproduction(s.steps.select("step"), reports.unionByName(older)).select("step", "different", "not_produced")


@query("expired_sessions", f"""WITH {STEPS}, l AS (SELECT session, max("end") AS last, min(event_type) AS m FROM steps GROUP BY session)
SELECT session FROM l WHERE last<1706500000000000 AND session NOT LIKE '%7'""")
def _(t):
    last = Steps(t).steps.groupBy("session", "project").agg(F.max("end").alias("last"))
    none = last.limit(0)
    return X.expired(last, 1706500000000000, last.filter("session LIKE '%7'"), none, none)


@query("expired_sessions_of_projects", f"""WITH {STEPS}, l AS (SELECT session, max("end") AS last FROM steps GROUP BY session)
SELECT session FROM l WHERE last<1706500000000000 AND session NOT LIKE '%7' AND session NOT LIKE '%3' AND session NOT LIKE '%4_'""")
def _(t):
    """Sessions in 7 are kept, sessions in 3 are noted; a session's last digit but one names its project, of which 4 is kept."""
    last = Steps(t).steps.groupBy("session").agg(F.max("end").alias("last")).withColumn("project", F.concat(F.lit("/proj/"), F.expr("substring(substring(session, 2), -2, 1)")))
    last = last.withColumn("project", F.when(F.length("session") > 2, F.col("project")).otherwise("/proj"))
    kept = last.select("project").distinct().filter("project = '/proj/4'")
    return X.expired(last, 1706500000000000, last.filter("session LIKE '%7'"), last.filter("session LIKE '%3'"), kept)


@query("evicted_files", """WITH d AS (SELECT sha256(text) AS sha, min(doc_id) AS u, min(n_chars) AS size FROM documents GROUP BY 1),
r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY u, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM d)
SELECT sha, size FROM r WHERE b<(SELECT sum(size) FROM d)-500000""")
def _(t):
    store = t.manifest.groupBy("sha").agg(F.min("ino").alias("last_use"), F.min("size").alias("size"))
    return X.evicted(store.select("sha", "size", (F.col("last_use") * 3600).alias("last_use")), 500_000)


# -- calls: an order is a call of its customer's tool; it reads the state before and parts, and writes its outputs


def call_tables(t):
    return t.work_file.select(F.col("record_id").alias("call"), F.when(F.col("role") == "in", "read").otherwise("write").alias("role"), "path", F.col("hash").alias("sha"))


KEPT = "kept AS (SELECT DISTINCT hash AS sha FROM work_file WHERE hash LIKE 'part:%' AND hash NOT LIKE 'part:1%')"


@query("producible_files", f"""WITH RECURSIVE {KEPT},
ok AS (SELECT s.o_custkey, s.n, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND 'part:'||l_partkey NOT IN (SELECT sha FROM kept)) AS good FROM states s),
mk AS (SELECT o_custkey, n FROM ok WHERE n=1 AND good UNION ALL SELECT o.o_custkey, o.n FROM mk JOIN ok o ON o.o_custkey=mk.o_custkey AND o.n=mk.n+1 WHERE o.good)
SELECT DISTINCT hash AS sha, CASE WHEN hash IN (SELECT sha FROM kept) THEN 'kept' WHEN hash IN (SELECT f.hash FROM work_file f JOIN states s ON f.record_id='w'||s.o_orderkey JOIN mk USING (o_custkey, n) WHERE f.role='out') THEN 'producible' ELSE 'lost' END AS state
FROM work_file""")
def _(t):
    files = call_tables(t)
    kept = files.filter("sha LIKE 'part:%' AND sha NOT LIKE 'part:1%'").select("sha").distinct()
    return CA.producible(kept, files)


@query("reproduction_plans", f"""WITH last AS (SELECT o_custkey, max(n) AS n FROM states GROUP BY o_custkey), x AS (SELECT 'cust:'||l.o_custkey||':'||l.n AS target, s.* FROM last l JOIN states s USING (o_custkey)),
{KEPT}
SELECT target, 'run' AS kind, 'w'||o_orderkey AS item FROM x
UNION SELECT target, CASE WHEN w.hash IN (SELECT sha FROM kept) THEN 'put' ELSE 'lost' END, w.hash FROM x JOIN work_file w ON w.record_id='w'||o_orderkey AND w.role='in' AND w.hash LIKE 'part:%'""")
def _(t):
    """Plans for the last states; what else their makers wrote is no target."""
    files = call_tables(t).filter("sha NOT LIKE 'supp:%'")
    kept = files.filter("sha LIKE 'part:%' AND sha NOT LIKE 'part:1%'").select("sha").distinct()
    made = files.filter("role = 'write'").select("sha")
    targets = made.join(files.filter("role = 'read'").select("sha"), "sha", "left_anti").distinct()
    return CA.reproduction_plan(targets, files, kept, t.work.select(F.col("record_id").alias("call"), F.col("seq").alias("ord"))).distinct()


@query("reproduction_plans_of_outputs", f"""WITH {KEPT}, last AS (SELECT o_custkey, max(n) AS n FROM states GROUP BY o_custkey),
first AS (SELECT l_suppkey, min(l_orderkey) AS o_orderkey FROM lineitem GROUP BY l_suppkey),
x AS (SELECT 'cust:'||l.o_custkey||':'||l.n AS target, s.o_orderkey FROM last l JOIN states s USING (o_custkey)
UNION ALL SELECT 'supp:'||l_suppkey, s.o_orderkey FROM first JOIN states f USING (o_orderkey) JOIN states s ON s.o_custkey=f.o_custkey AND s.n<=f.n)
SELECT target, 'run' AS kind, 'w'||o_orderkey AS item FROM x
UNION SELECT target, CASE WHEN w.hash IN (SELECT sha FROM kept) THEN 'put' ELSE 'lost' END, w.hash FROM x JOIN work_file w ON w.record_id='w'||o_orderkey AND w.role='in' AND w.hash LIKE 'part:%'""")
def _(t):
    """Plans for every last output; a supplier's file is made by the first of its many calls."""
    files = call_tables(t)
    kept = files.filter("sha LIKE 'part:%' AND sha NOT LIKE 'part:1%'").select("sha").distinct()
    targets = _latest(t).withColumnRenamed("hash", "sha")
    return CA.reproduction_plan(targets, files, kept, t.work.select(F.col("record_id").alias("call"), F.col("seq").alias("ord"))).distinct()


@query("reusable_records", """WITH lost AS (SELECT DISTINCT record_id FROM work_file WHERE role='out' AND hash LIKE 'supp:%1')
SELECT 'c'||o_custkey AS key, 'w'||o_orderkey AS record_id FROM orders WHERE 'w'||o_orderkey IN (SELECT record_id FROM verified) AND o_orderpriority<>'4-NOT SPECIFIED' AND 'w'||o_orderkey NOT IN (SELECT record_id FROM lost)""")
def _(t):
    good = T.verified(t.signature, t.trust_key).select("record_id").distinct().withColumn("v", F.lit(True))
    records = t.work.join(good, "record_id", "left").select("record_id", F.col("owner").alias("key"), F.coalesce("v", F.lit(False)).alias("verified"), F.col("declared").alias("conditions"))
    outs = t.work_file.filter("role = 'out'").select("record_id", F.col("hash").alias("sha"))
    return CA.own_hits(records, outs, outs.filter("sha NOT LIKE 'supp:%1'").select("sha").distinct())


@query("normal_command_lines", "SELECT record_id, split_part(split_part(cmd,'&& ',2),' ',1)||' state.csv --level='||substr(kind,1,1) AS line FROM work")
def _(t):
    w = t.work.select("record_id", F.concat(F.lit("/bin/bash /opt/"), F.expr("substring_index(substring_index(cmd, '&& ', -1), ' ', 1)"), F.lit(" /c/1/state.csv --level="),
                                            F.substring("kind", 1, 1)).alias("cmdline"), F.lit("/c/1").alias("cwd"))
    return w.select("record_id", F.array_join(CA.normal_words("cmdline", "cwd"), " ").alias("line"))


@query("executions", "SELECT record_id, 'c'||o_custkey AS owner, CAST(o_custkey AS VARCHAR) AS step, CASE WHEN n>1 THEN 'state.csv' END AS command_file FROM work JOIN states ON record_id='w'||o_orderkey")
def _(t):
    return W.executions(t.work, t.work_file).join(t.work.select("record_id", "owner"), "record_id").select("record_id", "owner", "step", "command_file")


@query("workflow_parameters", """WITH w AS (SELECT substr(owner,2) AS step, string_split(split_part(cmd,'&& ',2),' ') AS ws FROM work), e AS (SELECT step, unnest(ws) AS word, generate_subscripts(ws,1)-1 AS pos FROM w)
SELECT step, pos, count(DISTINCT word) AS values, min(word) AS example FROM e GROUP BY ALL HAVING count(DISTINCT word)>1""")
def _(t):
    return W.parameters(W.executions(t.work, t.work_file))


@query("workflow_candidates", """WITH w AS (SELECT substr(owner,2) AS step, string_split(split_part(cmd,'&& ',2),' ') AS ws FROM work), e AS (SELECT step, unnest(ws) AS word, generate_subscripts(ws,1)-1 AS pos FROM w),
p AS (SELECT step, 1 AS kind, 'word '||pos AS name FROM e GROUP BY step, pos HAVING count(DISTINCT word)>1),
f AS (SELECT DISTINCT substr(w.owner,2) AS step, 0 AS kind, path AS name FROM work_file JOIN work w USING (record_id) WHERE role='in')
SELECT step, kind, name, row_number() OVER (PARTITION BY step ORDER BY kind, name) AS number FROM (SELECT * FROM p UNION ALL SELECT * FROM f)""")
def _(t):
    ex = W.executions(t.work, t.work_file)
    files = t.work_file.filter("role = 'in'").join(ex.select("record_id", "step"), "record_id").select("step", "path")
    return W.candidates(files, W.parameters(ex))


@query("workflow_wiring", """SELECT 'w'||a.o_orderkey AS maker, 'w'||b.o_orderkey AS record_id, 'cust:'||a.o_custkey||':'||a.n AS hash FROM states a JOIN states b ON a.o_custkey=b.o_custkey AND b.n=a.n+1""")
def _(t):
    return W.wiring(t.work_file, t.work.select("record_id")).select("maker", "record_id", "hash")


@query("executions_behind_endpoints", "SELECT record_id FROM work WHERE record_id IN (SELECT record_id FROM verified)")
def _(t):
    return W.behind_endpoints(t.work_file, _latest(t), T.verified(t.signature, t.trust_key).select("record_id").distinct())


@query("reference_runs", "SELECT p_brand AS workflow, 'step '||p_size AS step, 'w'||p_partkey AS record_id FROM part JOIN orders ON o_orderkey=p_partkey")
def _(t):
    said = t.base("part").select(F.col("p_brand").alias("workflow"), F.concat(F.lit("step "), "p_size").alias("step"), F.concat(F.lit("w"), "p_partkey").alias("record_id"))
    return W.reference_runs(said, t.work)


@query("draft_of_publication", f"""WITH {STEPS}
SELECT step, 'in' AS role, path, sha, true AS selected, CASE WHEN status='changed-outside' THEN 'changed by hand before it was read' END AS note FROM inp
UNION ALL SELECT step, 'out', path, sha, true, NULL FROM outp""")
def _(t):
    s = Steps(t)
    ins = s.inputs.withColumn("class", F.lit("project"))
    return W.draft(ins, s.outputs, ins.limit(0).select("step", "path", "sha"))


@query("draft_with_objects", f"""WITH {STEPS}, {USES},
u AS (SELECT u.task_no AS step, d.name FROM use u ASOF JOIN def d ON u.session=d.session AND u.name=d.name AND u.task_no>d.task_no)
SELECT step, 'in' AS role, path, sha, true AS selected, CASE WHEN status='changed-outside' THEN 'changed by hand before it was read' END AS note FROM inp
UNION ALL SELECT step, 'out', path, sha, true, NULL FROM outp
UNION ALL SELECT step, 'in', '/in/'||substr(name, 2), 'h', true, 'read by an earlier step whose object it uses' FROM u""")
def _(t):
    s = Steps(t)
    define, code = variables(t)
    read = define.select("session", "task_no", F.concat(F.lit("/in/"), F.expr("substring(name, 2)")).alias("path"), F.lit("h").alias("sha"))
    reached = L.via_objects(L.variable_uses(L.names_used(code), define), read).select(F.col("task_no").alias("step"), "path", "sha")
    return W.draft(s.inputs.withColumn("class", F.lit("project")), s.outputs, reached)


@query("own_files_known", "SELECT DISTINCT path, sha FROM manifest WHERE sha IN (SELECT sha256(text) FROM documents WHERE lang='en')")
def _(t):
    mine = t.manifest.filter("lang = 'en'").select("sha")
    return t.manifest.join(mine, "sha", "left_semi").select("path", "sha").distinct()


@query("first_two_per_source", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r<=2")
def _(t):
    return R.first_n(t.base("documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 2).select("doc_id")


@query("writers_before_hand_edits", f"WITH {STEPS} SELECT step, path, w AS writer FROM inp WHERE status='changed-outside'")
def _(t):
    s = Steps(t)
    hand = s.inputs.filter("status = 'changed-outside'").join(s.steps.select("step", F.col("start").alias("at")), "step").select("step", "path", "at")
    return X.writers_before(hand, s.outputs, s.steps).select("step", "path", "writer")


@query("inputs_without_noise", f"WITH {STEPS} SELECT i.step, i.path FROM inp i JOIN steps s USING (step) WHERE s.value>=1 AND s.k<>7")
def _(t):
    """Inputs of the smallest values were rewritten; the file of key 7 is a tool's work file."""
    s = Steps(t)
    i = s.inputs.join(s.steps.select("step", "value", "k"), "step").withColumn("rewritten", F.col("value") < 1)
    i = i.withColumn("real", F.col("path")).withColumn("path", F.when(F.col("k") == 7, "/proj/FILE07").otherwise(F.col("path")))
    return X.without_noise(i, s.outputs)[0].select("step", F.col("real").alias("path"))


@query("matching_steps", f"WITH {STEPS} SELECT DISTINCT step FROM steps JOIN inp USING (step) WHERE event_type='click' AND path LIKE '%/1%'")
def _(t):
    s = Steps(t)
    return X.matching(s.steps.select("step"), s.steps.select("step", F.col("event_type").alias("name")), s.inputs.select("step", "path"), "click", "/1")


@query("steps_in_view", f"""WITH {STEPS}, f AS (SELECT session, arg_min(step, "end") AS step FROM steps GROUP BY session)
SELECT step FROM steps WHERE event_type<>'view' OR step NOT IN (SELECT step FROM f)""")
def _(t):
    s = Steps(t)
    label = s.steps.filter("event_type <> 'view'").select("step")
    return X.session_view(s.steps.select("step", "session", "start"), s.steps.select("step"), label, s.outputs).select("step")


@query("watched_sessions", "SELECT 'd'||doc_id AS session FROM documents WHERE source IN ('src1','src2') OR (source='src3' AND lang='en') OR n_chars<100")
def _(t):
    d = t.base("documents").select(F.concat(F.lit("d"), "doc_id").alias("session"), F.concat(F.lit("/d/"), "source", F.lit("/"), "lang").alias("project"), "source", "lang", "n_chars",
                                   F.lit(True).alias("closed"))
    folders = d.filter("source IN ('src1', 'src2')").select(F.concat(F.lit("/d/"), "source").alias("path")).unionByName(
        d.filter("source = 'src3' AND lang = 'en'").select(F.col("project").alias("path"))).distinct()
    return X.watched(d, folders, d.filter("n_chars < 100")).select("session")


@query("tools_of_records", "SELECT record_id, split_part(split_part(cmd,'&& ',2),' ',1) AS tools FROM work WHERE environment<>'env-p'")
def _(t):
    c = t.work.select(F.col("record_id").alias("step"), F.expr("substring_index(substring_index(cmd, '&& ', -1), ' ', 1)").alias("name"))
    return X.tools_of(c, ["toolO", "toolF"]).select(F.col("step").alias("record_id"), F.array_join("tools", ",").alias("tools"))


@query("parents_in_control_files", "SELECT '/m/'||p_partkey||'/'||p_partkey||'.mod' AS path, CAST(p_partkey-1 AS VARCHAR) AS parent, 'w'||(p_partkey-1) AS record FROM part WHERE p_partkey-1 IN (SELECT p_partkey FROM part)")
def _(t):
    p = t.base("part").select("p_partkey")
    path = lambda ext: F.concat(F.lit("/m/"), "p_partkey", F.lit("/"), "p_partkey", F.lit(ext)).alias("path")
    control = p.select(path(".mod"), F.concat(F.lit("$PROBLEM x\n; based_on: "), (F.col("p_partkey") - 1).cast("string"), F.lit("\n$DATA d\n")).alias("text"))
    outs = p.select(path(".lst"), F.concat(F.lit("lst"), "p_partkey").alias("sha"))
    pub = p.select(F.concat(F.lit("lst"), "p_partkey").alias("sha"), F.concat(F.lit("w"), "p_partkey").alias("record"), F.col("p_partkey").alias("seq"))
    return X.based_on(control, outs, pub)


@query("common_base_of_calls", "SELECT record_id AS call, CASE WHEN EXISTS (SELECT 1 FROM work_file f WHERE f.record_id=w.record_id AND role='in' AND path LIKE '/p/%') THEN '/' ELSE '/c/'||substr(owner,2) END AS base FROM work w")
def _(t):
    calls = t.work.select(F.col("record_id").alias("call"), F.concat(F.lit("/c/"), F.expr("substring(owner, 2)")).alias("cwd"), F.array(F.lit("tool"), F.lit("x")).alias("argv"))
    return CA.common_base(calls, t.work_file.filter("role = 'in'").select(F.col("record_id").alias("call"), "path"))


@query("files_named_by_calls", "SELECT record_id AS call, 1 AS pos, '/c/'||o_custkey||'/state.csv' AS path FROM work JOIN orders ON record_id='w'||o_orderkey")
def _(t):
    calls = W.executions(t.work, t.work_file).select(F.col("record_id").alias("call"), F.col("folder").alias("cwd"), F.col("words").alias("argv"))
    return CA.referenced_files(calls, t.work_file.select("path").distinct())


@query("stored_sessions", f"""WITH {STEPS}, l AS (SELECT session, max("end") AS last, arg_max(event_type, "end") AS e FROM steps GROUP BY session)
SELECT session FROM l WHERE e<>'view' AND (last>=1706500000000000 OR session LIKE '%3')""")
def _(t):
    from provenant.sources.store import stored_sessions
    last = Steps(t).steps.groupBy("session").agg(F.max("end").alias("last"), F.max_by("event_type", "end").alias("e"))
    return stored_sessions(last, last.filter("e = 'view'"), last.filter("session LIKE '%3'"), 1706500000000000).select("session")
