"""Queries over traces: tasks, their children and the links between them."""

import uuid

from pyspark.sql import functions as F

from provenant.functions.paths import path_class, program_name
from provenant.functions.terms import field_of
from provenant.operators import links as L
from provenant.operators import prefixes as P
from provenant.operators import tasks as K
from provenant.plans.registry import query
from provenant.session import app_folder, cut
from provenant.streaming import tasks as ST

# The tasks of the trace in SQL: numbers, states of paths, inputs and outputs.
NUM = """num AS (SELECT *, coalesce(sum(CASE WHEN op='TASK' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS task_no FROM trace_event)"""
TASKS = NUM + """,
raw AS (SELECT session, task_no, max(CASE WHEN op='TASK' THEN path END) AS task, max(CASE WHEN op='TASK' THEN mode END) AS status,
  max(CASE WHEN op='TASK' THEN ts_ns END) AS mark_ts, arg_min(ts_ns, ord) AS first_ts, max(ts_ns) AS last_ts,
  count(*) FILTER (op IN ('exec','connect')) AS plain_rows FROM num GROUP BY session, task_no),
tsk AS (SELECT session, task_no, coalesce(task,'tail') AS task, coalesce(status,'-') AS status, coalesce(mark_ts,last_ts) AS "end",
  coalesce(lag(mark_ts) OVER (PARTITION BY session ORDER BY task_no), first_ts) AS start, task IS NOT NULL AS marked, plain_rows FROM raw)"""
STATES = TASKS + """,
ps0 AS (SELECT session, task_no, ord*2 AS a_t, ts_ns, pid, mtime_ns, op AS kind, path, sha, op='open' AND mode='r' AS reads,
   op='open' AND mode='w' AS fresh, CASE WHEN op='open' AND mode='w' THEN true END AS is_written FROM num WHERE op IN ('open','closew','unlink')
 UNION ALL SELECT session, task_no, ord*2, ts_ns, pid, mtime_ns, 'away', extra, NULL, false, false, false FROM num WHERE op='rename'
 UNION ALL SELECT session, task_no, ord*2+1, ts_ns, pid, mtime_ns, 'onto', path, NULL, false, false, true FROM num WHERE op='rename'),
ps1 AS (SELECT *, coalesce(last_value(is_written IGNORE NULLS) OVER (PARTITION BY session, task_no, path ORDER BY a_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),false) AS written_before,
  last_value(CASE WHEN kind='closew' THEN {'sha': sha, 'm': mtime_ns} WHEN kind IN ('unlink','away') THEN {'sha': NULL, 'm': 0} END IGNORE NULLS)
    OVER (PARTITION BY session, path ORDER BY a_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ps0),
mv AS (SELECT session, a_t+1 AS a_t, held.sha AS msha, held.m AS mm FROM ps1 WHERE kind='away'),
ps AS (SELECT p.* EXCLUDE (sha, mtime_ns, held), CASE WHEN kind='onto' THEN msha ELSE sha END AS sha, CASE WHEN kind='onto' AND msha IS NOT NULL THEN mm ELSE mtime_ns END AS mtime_ns
   FROM ps1 p LEFT JOIN mv USING (session, a_t)),
per AS (SELECT session, task_no, path, coalesce(arg_max(is_written, a_t) FILTER (is_written IS NOT NULL), false) AS written,
  bool_or(kind='away' AND written_before) AS moved,
  coalesce(arg_max(kind='unlink', a_t) FILTER ((kind='unlink' AND written_before) OR kind='onto'), false) AS deleted,
  bool_or(kind='unlink' OR fresh) AS recreated,
  arg_max(sha, a_t) FILTER (kind='closew' OR (kind='onto' AND sha IS NOT NULL)) AS csha, arg_max(mtime_ns, a_t) FILTER (kind='closew' OR (kind='onto' AND sha IS NOT NULL)) AS cm,
  max(ts_ns) FILTER (kind='closew') AS written_at, arg_min(sha, a_t) FILTER (reads AND NOT written_before) AS rsha, arg_min(mtime_ns, a_t) FILTER (reads AND NOT written_before) AS rm
  FROM ps GROUP BY ALL),
outp AS (SELECT p.session, p.task_no, p.path, csha AS sha, coalesce(written_at, t."end") AS written_at, t."end" FROM per p JOIN tsk t USING (session, task_no)
  WHERE written AND NOT deleted AND csha IS NOT NULL AND NOT (coalesce(rsha=csha,false) AND NOT recreated AND NOT coalesce(cm<>0 AND rm<>0 AND cm<>rm,false))),
inp AS (SELECT r.session, r.task_no, r.path, r.sha, first_read, last_read, written AND (csha IS NULL OR csha<>r.sha OR recreated OR coalesce(cm<>0 AND rm<>0 AND cm<>rm,false)) AS rewritten
  FROM (SELECT session, task_no, path, sha, min(a_t)//2 AS first_read, max(ts_ns) AS last_read FROM ps WHERE reads AND NOT written_before GROUP BY ALL) r JOIN per USING (session, task_no, path))"""
PRIOR = STATES + """,
lnk AS (SELECT i.*, o.sha AS psha, o.task_no AS ptask FROM inp i ASOF LEFT JOIN outp o ON i.session=o.session AND i.path=o.path AND i.task_no>o.task_no)"""


def build(t):
    """The traces of the given tables, with the tables the links read again written once."""
    tr = K.build(t.trace_event, "/proj")
    tr.inputs, tr.outputs, tr.tasks = cut(tr.inputs), cut(tr.outputs), cut(tr.tasks)
    return tr


@query("tasks", f"WITH {STATES} SELECT t.session, t.task_no, task, status, start, \"end\" FROM tsk t WHERE marked OR plain_rows>0 OR EXISTS (SELECT 1 FROM inp i WHERE i.session=t.session AND i.task_no=t.task_no) OR EXISTS (SELECT 1 FROM outp o WHERE o.session=t.session AND o.task_no=t.task_no)")
def _(t):
    return K.build(t.trace_event, "/proj").tasks.select("session", "task_no", "task", "status", "start", "end")


@query("task_inputs", f"WITH {STATES} SELECT session, task_no, path, sha, first_read, last_read, rewritten FROM inp")
def _(t):
    return K.build(t.trace_event, "/proj").inputs.select("session", "task_no", "path", "sha", "first_read", "last_read", "rewritten")


@query("task_outputs", f"WITH {STATES} SELECT session, task_no, path, sha, written_at FROM outp")
def _(t):
    return K.build(t.trace_event, "/proj").outputs.select("session", "task_no", "path", "sha", "written_at")


@query("task_temporary", f"""WITH {STATES} SELECT session, task_no, path FROM per WHERE (written AND (deleted OR csha IS NULL)) OR (moved AND NOT written)""")
def _(t):
    return K.build(t.trace_event, "/proj").temporary


@query("followed_tasks", f"""WITH {STATES},
k AS (SELECT t.session, t.task_no, task, status, start, "end" FROM tsk t WHERE marked OR plain_rows>0 OR EXISTS (SELECT 1 FROM inp i WHERE i.session=t.session AND i.task_no=t.task_no) OR EXISTS (SELECT 1 FROM outp o WHERE o.session=t.session AND o.task_no=t.task_no))
SELECT session, task_no, 'task' AS role, task, status, start, "end", NULL AS path, NULL AS sha, NULL::BIGINT AS first_read, NULL::BIGINT AS last_read, NULL::BOOLEAN AS rewritten, NULL::BIGINT AS written_at FROM k
UNION ALL SELECT session, task_no, 'in', NULL, NULL, NULL, NULL, path, sha, first_read, last_read, rewritten, NULL FROM inp
UNION ALL SELECT session, task_no, 'out', NULL, NULL, NULL, NULL, path, sha, NULL, NULL, NULL, written_at FROM outp
UNION ALL SELECT session, task_no, 'temporary', NULL, NULL, NULL, NULL, path, NULL, NULL, NULL, NULL, NULL FROM per WHERE (written AND (deleted OR csha IS NULL)) OR (moved AND NOT written)""")
def _(t):
    """The tables' trace as a stream that arrives in four pieces: its rows are those of the batch."""
    return ST.replay(t.trace_event, "/proj", f"{app_folder(t.spark)}/{uuid.uuid4().hex}", 4).drop("pid")


@query("task_commands", f"WITH {NUM} SELECT session, task_no, pid, split_part(extra,' ',1) AS program, regexp_extract(split_part(extra,' ',1),'[^/]*$') AS name FROM num WHERE op='exec'")
def _(t):
    return K.program_names(K.build(t.trace_event, "/proj").commands).select("session", "task_no", "pid", "program", "name")


@query("task_network", f"WITH {NUM} SELECT session, task_no, path AS address, 'remote' AS class, true AS ok FROM num WHERE op='connect'")
def _(t):
    return K.build(t.trace_event, "/proj").network.select("session", "task_no", "address", "class", "ok")


@query("background_network", """
WITH w AS (SELECT user_id, ts FROM events WHERE event_type='view')
SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.user_id=e.user_id AND w.ts>=e.ts AND w.ts<=e.ts+INTERVAL 4 HOUR) THEN 'background' ELSE 'remote' END AS class
FROM events e WHERE event_type='click'""")
def _(t):
    """Clicks as connections, views as writes of the cache; a second of the log is 4 h / 5 s of the table."""
    e = t.base("events").filter("event_type IN ('click', 'view')")
    lines = e.select(F.lit("all").alias("session"), F.lit(0).cast("bigint").alias("task_no"), F.col("event_id").alias("ord"), F.col("user_id").alias("pid"),
                     (F.unix_micros(F.col("ts").cast("timestamp")) * 5 / 14400).alias("x"), F.when(F.col("event_type") == "click", "connect").otherwise("open").alias("op"))
    lines = lines.select("session", "task_no", "ord", "pid", F.round(F.col("x") * 1000).cast("bigint").alias("ts_ns"), "op", F.lit("w").alias("mode"),
                         F.when(F.col("op") == "connect", "inet:1.2.3.4:443").otherwise("/home/u/.cache/oak/x").alias("path"), F.lit("rc=0").alias("extra"))
    return K.network(lines, "/.cache/oak/").select(F.col("ord").alias("event_id"), "class")


@query("path_classes", """
SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'project' WHEN url LIKE 'https://%' THEN 'env' ELSE 'outside' END AS class FROM pages""")
def _(t):
    p = t.base("pages").select("page_id", F.when(F.col("url").startswith("https://m."), F.concat(F.lit("/work/"), F.expr("substring(url, 9)")))
                               .when(F.col("url").startswith("https://"), F.concat(F.lit("/opt/"), F.expr("substring(url, 9)")))
                               .otherwise(F.concat(F.lit("/data/"), F.expr("substring(url, 8)"))).alias("path"))
    return p.select("page_id", path_class("path", F.lit("/work")).alias("class"))


@query("classes_of_files", """
WITH f AS (SELECT DISTINCT 'o'||l_orderkey AS session, '/data/s'||l_suppkey||'/p'||l_partkey||'/f'||l_linenumber||'.R' AS path, l_suppkey AS s, l_partkey AS p, l_orderkey AS o FROM lineitem
  UNION SELECT 'o'||o_orderkey, '/work/'||o_custkey||'/x.csv', NULL, NULL, o_orderkey FROM orders UNION SELECT 'o'||o_orderkey, '/tmp/Rtmp'||o_custkey||'/x', NULL, NULL, o_orderkey FROM orders
  UNION SELECT 'o'||o_orderkey, '/proc/'||o_custkey, NULL, NULL, o_orderkey FROM orders UNION SELECT 'o'||o_orderkey, '/log/o'||o_orderkey, NULL, NULL, o_orderkey FROM orders),
lib AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber=1),
en AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_returnflag='R')
SELECT session, path, CASE WHEN path='/log/'||session THEN 'self' WHEN path LIKE '/work/%' THEN 'project' WHEN path LIKE '/tmp/%' THEN 'temp' WHEN path LIKE '/proc/%' THEN 'system'
  WHEN (o, s) IN (SELECT (o, s) FROM en) THEN 'env' WHEN (s, p) IN (SELECT (s, p) FROM lib) THEN 'env' ELSE 'outside' END AS class FROM f""")
def _(t):
    """Every line item is a file of its order's session; thousands of folders hold packages; sessions named the folders of suppliers."""
    l, o = t.base("lineitem"), t.base("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("session"), F.col("o_custkey").cast("string").alias("c"))
    session, supp = F.concat(F.lit("o"), "l_orderkey").alias("session"), F.concat(F.lit("/data/s"), "l_suppkey")
    pack = F.concat(supp, F.lit("/p"), "l_partkey")
    of = lambda path: o.select("session", path.alias("path"))
    files = l.select(session, F.concat(pack, F.lit("/f"), "l_linenumber", F.lit(".R")).alias("path"))
    for path in (F.concat(F.lit("/work/"), "c", F.lit("/x.csv")), F.concat(F.lit("/tmp/Rtmp"), "c", F.lit("/x")), F.concat(F.lit("/proc/"), "c"), F.concat(F.lit("/log/"), "session")):
        files = files.unionByName(of(path))
    there = l.filter("l_linenumber = 1").select(F.concat(pack, F.lit("/Meta/package.rds")).alias("path"))
    named = l.filter("l_returnflag = 'R'").select(session, supp.alias("prefix")).distinct()
    return P.classes(files.distinct(), "/work", named=named, keys=["session"], libraries=P.library_roots(there), log=F.concat(F.lit("/log/"), "session"))


@query("extra_fields", "SELECT ord, CASE WHEN op='open' AND mode='w' THEN '1' ELSE '' END AS trunc, coalesce(sha,'') AS sha256 FROM trace_event")
def _(t):
    return t.trace_event.select("ord", field_of("extra", "trunc").alias("trunc"), field_of("extra", "sha256").alias("sha256"))


@query("programs_of_lines", "SELECT ord, 'tool'||(pid-10) AS name FROM trace_event WHERE op='exec'")
def _(t):
    return t.trace_event.filter("op = 'exec'").select("ord", program_name(F.lit(None).cast("string"), "extra").alias("name"))


@query("links_in_session", f"""WITH {PRIOR},
ff AS (SELECT session, sha, path, min(task_no) AS task_no FROM outp GROUP BY ALL)
SELECT session, task_no, path, sha, CASE WHEN psha=sha THEN ptask END AS from_task, CASE WHEN psha<>sha THEN 'changed-outside' ELSE 'observed' END AS status,
  CASE WHEN psha IS NULL THEN (SELECT count(*) FROM ff WHERE ff.session=lnk.session AND ff.sha=lnk.sha AND ff.task_no<lnk.task_no) ELSE 0 END AS same_as FROM lnk""")
def _(t):
    tr = build(t)
    return L.in_session(tr.inputs, tr.outputs).select("session", "task_no", "path", "sha", "from_task", "status", "same_as")


@query("same_bytes_elsewhere", f"WITH {STATES} SELECT session, sha, path, min(task_no) AS task_no FROM outp GROUP BY ALL")
def _(t):
    return L.same_bytes(build(t).outputs)


@query("overwritten_outputs", f"""WITH {STATES} SELECT session, task_no, path, coalesce(lead(sha) OVER (PARTITION BY session, path ORDER BY task_no)<>sha,false) AS overwritten FROM outp""")
def _(t):
    return L.overwritten(build(t).outputs).select("session", "task_no", "path", "overwritten")


def linked(t, tr=None):
    """Inputs linked in their session, with project and start, and the outputs with project."""
    tr = tr or build(t)
    inp = cut(L.in_session(tr.inputs, tr.outputs)).join(tr.tasks.select("session", "task_no", "start"), ["session", "task_no"]).withColumn("project", F.lit("/proj"))
    return inp, tr.outputs.withColumn("project", F.lit("/proj")), tr


ACROSS = PRIOR + """,
crs AS (SELECT l.session, l.task_no, l.path, l.sha, CASE WHEN psha=l.sha THEN ptask END AS from_task, psha, t.start,
  (SELECT arg_max({'s': o.session, 't': o.task_no}, (o."end", o.session, o.task_no)) FROM outp o WHERE o.path=l.path AND o.sha=l.sha AND o.session<>l.session AND o."end"<=t.start) AS before,
  (SELECT arg_min({'s': o.session, 't': o.task_no}, (o."end", o.session, o.task_no)) FROM outp o WHERE o.path=l.path AND o.sha=l.sha AND o.session<>l.session) AS early,
  (SELECT max(o."end") FROM outp o WHERE o.path=l.path AND o.session<>l.session) AS lastw
  FROM lnk l JOIN tsk t USING (session, task_no)),
cx AS (SELECT *, CASE WHEN from_task IS NULL THEN coalesce(before, early) END AS ch FROM crs)"""


@query("links_across_sessions", f"""WITH {ACROSS}
SELECT session, task_no, path, sha, ch.s AS from_session, ch.t AS cross_task,
  CASE WHEN ch IS NOT NULL THEN 'observed' WHEN psha<>sha THEN 'changed-outside' WHEN from_task IS NULL AND lastw<=start THEN 'changed-outside' ELSE 'observed' END AS status FROM cx""")
def _(t):
    inp, outs, _ = linked(t)
    return L.across_sessions(inp, outs).select("session", "task_no", "path", "sha", "from_session", "cross_task", "status")


@query("written_again_later", f"""WITH {STATES},
c AS (SELECT i.session, i.task_no, i.path, i.sha,
  (SELECT arg_min({{'s': o.session, 't': o.task_no, 'h': o.sha}}, (o.written_at, -o.task_no)) FROM outp o WHERE o.path=i.path AND o.written_at>i.last_read AND (o.session<>i.session OR o.task_no<>i.task_no) AND o.sha<>i.sha) AS ch,
  (SELECT arg_min({{'s': o.session, 't': o.task_no, 'h': o.sha}}, (o.written_at, -o.task_no)) FROM outp o WHERE o.path=i.path AND o.written_at>i.last_read AND (o.session<>i.session OR o.task_no<>i.task_no)) AS an FROM inp i)
SELECT session, task_no, path, sha, coalesce(ch, an).s AS later_session, coalesce(ch, an).t AS later_task, coalesce(ch, an).h=sha AS later_same FROM c""")
def _(t):
    tr = build(t)
    p = F.lit("/proj").alias("project")
    seen = tr.inputs.select(p, "session", "task_no", "path", "sha", F.col("last_read").alias("at"))
    return L.written_again(seen, tr.outputs.select(p, "session", "task_no", "path", "sha", "written_at")).select(
        "session", "task_no", "path", "sha", "later_session", "later_task", "later_same")


@query("state_against_now", f"""WITH {STATES}, now AS (SELECT path, arg_max(sha, (written_at, session)) AS sha FROM outp GROUP BY path)
SELECT o.session, o.task_no, o.path, o.sha, CASE WHEN n.sha IS NULL THEN 'gone' WHEN n.sha=o.sha THEN 'same' ELSE 'changed' END AS now FROM inp o LEFT JOIN now n USING (path)""")
def _(t):
    tr = build(t)
    now = tr.outputs.groupBy("path").agg(F.max_by("sha", F.struct("written_at", "session")).alias("sha"))
    return L.state_now(tr.inputs.select("session", "task_no", "path", "sha"), now)


@query("executions_by_time", f"""WITH {TASKS}
SELECT e.event_id, t.task_no FROM events e JOIN tsk t ON t.session='s'||e.user_id AND epoch_us(e.ts)*1000>=t.start AND epoch_us(e.ts)*1000<=t."end"
WHERE e.event_type='view' AND NOT (epoch_us(e.ts)*1000=t.start AND t.task_no>0 AND EXISTS (SELECT 1 FROM tsk p WHERE p.session=t.session AND p.task_no=t.task_no-1 AND p."end"=t.start))""")
def _(t):
    events = K.numbered_events(t.trace_event)
    tasks = cut(K.task_rows(events))
    views = t.base("events").filter("event_type = 'view'").select(
        F.concat(F.lit("s"), "user_id").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), F.lit("").alias("file"), "event_id")
    none = tasks.limit(0).select("session", "task_no", F.lit("").alias("path"))
    return L.attach_origins(views, tasks, none).select("event_id", "task_no")


@query("executions_by_file", f"""WITH RECURSIVE {TASKS},
ran AS (SELECT DISTINCT x.session, x.task_no, list_extract(string_split(x.extra, ' -i '), -1) AS file, t.start, t."end" FROM num x JOIN tsk t USING (session, task_no) WHERE x.op='exec'),
ex AS (SELECT 's'||user_id AS session, epoch_us(ts)*1000 AS ts, '/proj/'||(props->>'$.k')||'.csv' AS file, event_id FROM events WHERE event_type='view'),
o AS (SELECT *, row_number() OVER (PARTITION BY session, file ORDER BY ts, event_id) AS i FROM ex),
near AS (SELECT o.session, o.file, o.i, o.event_id, list((greatest(r.start-o.ts, o.ts-r."end", 0), r.start, r.task_no) ORDER BY greatest(r.start-o.ts, o.ts-r."end", 0), r.start, r.task_no) FILTER (r.task_no IS NOT NULL) AS c
  FROM o LEFT JOIN ran r ON r.session=o.session AND r.file=o.file AND o.ts BETWEEN r.start-2000000000 AND r."end"+2000000000 GROUP BY ALL),
greedy AS (SELECT session, file, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS task_no, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT session, file FROM o)
  UNION ALL SELECT session, file, i, event_id, task_no, CASE WHEN task_no IS NULL THEN taken ELSE list_append(taken, task_no) END FROM (
    SELECT n.session, n.file, n.i, n.event_id, g.taken, (list_filter(n.c, lambda x: NOT list_contains(g.taken, x[3]))[1])[3] AS task_no FROM greedy g JOIN near n ON n.session=g.session AND n.file=g.file AND n.i=g.i+1)),
byfile AS (SELECT event_id, task_no FROM greedy WHERE task_no IS NOT NULL)
SELECT * FROM byfile UNION ALL
SELECT e.event_id, t.task_no FROM events e JOIN tsk t ON t.session='s'||e.user_id AND epoch_us(e.ts)*1000>=t.start AND epoch_us(e.ts)*1000<=t."end"
WHERE e.event_type='view' AND e.event_id NOT IN (SELECT event_id FROM byfile)
  AND NOT (epoch_us(e.ts)*1000=t.start AND t.task_no>0 AND EXISTS (SELECT 1 FROM tsk p WHERE p.session=t.session AND p.task_no=t.task_no-1 AND p."end"=t.start))""")
def _(t):
    """Views are console runs of their key's file; a task sourced the files its commands named."""
    events = cut(K.numbered_events(t.trace_event))
    tasks = cut(K.task_rows(events))
    views = t.base("events").filter("event_type = 'view'").select(
        F.concat(F.lit("s"), "user_id").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"),
        F.concat(F.lit("/proj/"), F.get_json_object("props", "$.k"), F.lit(".csv")).alias("file"), "event_id")
    ran = events.filter("op = 'exec'").select("session", "task_no", F.element_at(F.split("extra", " -i "), -1).alias("path"))
    return L.attach_origins(views, tasks, ran).select("event_id", "task_no")


USES = """def AS (SELECT DISTINCT 's'||user_id AS session, 'x'||k AS name, event_id AS task_no FROM trace_source WHERE event_type='purchase'),
use AS (SELECT DISTINCT 's'||user_id AS session, 'x'||k AS name, event_id AS task_no FROM trace_source WHERE event_type='view')"""


def variables(t):
    """Purchases define a variable, views are code that reads it and calls a function."""
    e = t._events
    name = F.concat(F.lit("x"), "k")
    define = e.filter("event_type = 'purchase'").select(F.concat(F.lit("s"), "user_id").alias("session"), F.col("event_id").alias("task_no"), name.alias("name"))
    code = e.filter("event_type = 'view'").select(F.concat(F.lit("s"), "user_id").alias("session"), F.col("event_id").alias("task_no"), F.concat(
        F.lit("y <- mean("), name, F.lit("$value, na.rm = TRUE) # x1 x2\nprint('x3', y)")).alias("code"))
    return define, code


@query("names_used_by_code", """SELECT 's'||user_id AS session, event_id AS task_no, 'x'||k AS name FROM trace_source WHERE event_type='view'""")
def _(t):
    return L.names_used(variables(t)[1])


@query("variable_uses", f"""WITH {USES}
SELECT u.session, u.task_no, u.name, d.task_no AS def_task FROM use u ASOF JOIN def d ON u.session=d.session AND u.name=d.name AND u.task_no>d.task_no""")
def _(t):
    define, code = variables(t)
    return L.variable_uses(L.names_used(code), define)


@query("document_chunks", """
SELECT doc_id, 'd'||doc_id AS label, 4 AS start_line, 4+length(text)-length(replace(text,chr(10),'')) AS end_line FROM documents""")
def _(t):
    """Every document as the body of a labelled chunk; fences of its own are quoted, as they would end the chunk."""
    d = t.base("documents").withColumn("text", F.replace("text", F.lit("```"), F.lit("'''"))).select(F.col("doc_id").alias("file"), F.concat(
        F.lit("# Title\n\n```{r d"), "doc_id", F.lit(", echo=FALSE}\n"), "text", F.lit("\n```\ntext\n")).alias("text"))
    return L.chunks(d).select(F.col("file").alias("doc_id"), "label", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query("variables_reach_files", f"""WITH {USES}, u AS (SELECT u.session, u.task_no, d.task_no AS def_task FROM use u ASOF JOIN def d ON u.session=d.session AND u.name=d.name AND u.task_no>d.task_no)
SELECT u.session, u.task_no, '/in/'||k AS path, 1 AS depth FROM u JOIN trace_source s ON s.event_id=u.def_task""")
def _(t):
    define, code = variables(t)
    uses = L.variable_uses(L.names_used(code), define)
    read = define.select("session", "task_no", F.concat(F.lit("/in/"), F.expr("substring(name, 2)")).alias("path"), F.lit("h").alias("sha"))
    return L.via_objects(uses, read).select("session", "task_no", "path", "depth")


@query("projects_of_sessions", """WITH f AS (SELECT 's'||user_id AS session, arg_min(k, event_id) FILTER (event_type='click' AND value>=5) AS k FROM trace_source GROUP BY user_id)
SELECT session, CASE WHEN k<20 THEN '/r/'||k||'/sub' WHEN k<50 THEN '/r/'||k WHEN k IS NOT NULL THEN '/r' END AS project FROM f""")
def _(t):
    """Commands ran in a folder per key; some keys are hashed roots of their own, some are repositories."""
    e = t.trace_event.withColumn("path", F.when(F.col("op") == "exec", F.concat(F.lit("/r/"), (F.col("pid") - 10).cast("string"), F.lit("/sub"))).otherwise(F.col("path")))
    k = t._events.select("k").distinct()
    own = e.select("session").distinct()
    narrow = t._events.filter("k < 50").select(F.concat(F.lit("s"), "user_id").alias("session"), F.concat(F.lit("/r/"), "k").alias("root")).distinct()
    roots = own.withColumn("root", F.lit("/r")).unionByName(narrow)
    repos = k.filter("k < 20").select(F.concat(F.lit("/r/"), "k", F.lit("/sub")).alias("path"))
    return K.placed(e, roots, repos)


CALLS = NUM + """,
cal AS (SELECT DISTINCT session, task_no, pid FROM num WHERE op='exec'),
cop AS (SELECT n.session, n.task_no, n.pid, n.ord, CASE WHEN op='open' AND mode='r' THEN 'r' WHEN op='open' THEN 'w' WHEN op='closew' THEN 'c' ELSE 'd' END AS o, sha
  FROM num n JOIN cal USING (session, task_no, pid) WHERE op IN ('open','closew','rename','unlink')),
cst AS (SELECT *, coalesce(bool_or(o IN ('w','c')) OVER v, false) AS w0, coalesce(bool_or(o='w') OVER v, false) AS o0 FROM cop
  WINDOW v AS (PARTITION BY session, task_no, pid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cfi AS (SELECT session, task_no, pid, arg_min(sha, ord) FILTER (o='r' AND NOT w0) AS r, arg_max(CASE WHEN o='c' THEN sha ELSE '-' END, ord) FILTER ((o='c' AND o0) OR o='d') AS w FROM cst GROUP BY ALL)"""


def calls(t):
    from provenant.operators import calls as CA
    tr = K.build(t.trace_event, "/proj")
    commands = cut(tr.commands)
    found = cut(CA.tool_calls(commands, [f"tool{i}" for i in range(100)]))
    trees = CA.subtrees(found, CA.process_edges(commands))
    return found, CA.call_files(found, trees, tr.ops)


@query("call_files", f"""WITH {CALLS} SELECT session, task_no, pid, 'read' AS role, r AS sha FROM cfi WHERE r IS NOT NULL
UNION ALL SELECT session, task_no, pid, 'write', w FROM cfi WHERE w IS NOT NULL AND w<>'-' AND w IS DISTINCT FROM r""")
def _(t):
    parts = F.split("call", "\u0001")
    return calls(t)[1].select(parts[0].alias("session"), parts[1].cast("bigint").alias("task_no"), parts[2].cast("bigint").alias("pid"), "role", "sha")


@query("call_keys", f"""WITH {CALLS} SELECT session, task_no, pid, 'sha256:'||sha256('{{"inputs":{{'||coalesce('"'||(pid-10)||'.csv":"'||r||'"','')||'}},"protocol":{{"kind":"cmd","ref":"sha256:'||
  sha256('{{"argv":["tool'||(pid-10)||'","-i","'||(pid-10)||'.csv"]}}')||'"}}}}') AS key FROM cal LEFT JOIN cfi USING (session, task_no, pid)""")
def _(t):
    from provenant.operators import calls as CA
    found, files = calls(t)
    return CA.call_keys(found, files).select("session", "task_no", "pid", "key")


@query("files_to_keep", f"""WITH {NUM}, k AS (SELECT DISTINCT sha FROM trace_event WHERE op='closew') SELECT DISTINCT sha FROM num WHERE op='open' AND mode='r' AND sha NOT IN (SELECT sha FROM k)""")
def _(t):
    from provenant.sources.store import pending
    seen = t.trace_event.filter("op IN ('open', 'closew')").select("path", F.nullif(field_of("extra", "sha256"), F.lit("")).alias("sha"), "op")
    kept = seen.filter("op = 'closew'").select("sha")
    return pending(seen.select("path", "sha"), calls(t)[1].select("path", "sha"), kept).select("sha")
