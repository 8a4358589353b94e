"""Queries over work records, signatures and trust."""

from pyspark.sql import functions as F

from provenant.operators import components
from provenant.operators import records as R
from provenant.operators import trust as T
from provenant.plans.registry import query
from provenant.session import cut


@query("reproductions", """
WITH made AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out'),
facts AS (SELECT m.hash, m.record_id, w.declared, v.keyid FROM made m JOIN work w USING (record_id)
          LEFT JOIN verified v USING (record_id))
SELECT hash, count(DISTINCT CASE WHEN NOT declared THEN keyid END) AS signers,
       count(DISTINCT CASE WHEN NOT declared AND keyid IS NOT NULL THEN record_id END) AS records,
       count(DISTINCT CASE WHEN NOT declared AND keyid IS NULL THEN record_id END) AS untrusted,
       count(DISTINCT CASE WHEN declared THEN record_id END) AS declared
FROM facts GROUP BY hash""")
def _(t):
    return R.reproductions(t.work, t.work_file, t.signature, t.trust_key)


@query("reproductions_one_tier", """
WITH made AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out'),
facts AS (SELECT m.hash, m.record_id, w.declared, v.keyid FROM made m JOIN work w USING (record_id)
          LEFT JOIN (SELECT * FROM verified WHERE tier='asia') v USING (record_id))
SELECT hash, count(DISTINCT CASE WHEN NOT declared THEN keyid END) AS signers,
       count(DISTINCT CASE WHEN NOT declared AND keyid IS NULL THEN record_id END) AS untrusted
FROM facts GROUP BY hash""")
def _(t):
    return R.reproductions(t.work, t.work_file, t.signature, t.trust_key, tier="asia").select("hash", "signers", "untrusted")


@query("minimum_reproductions", """
WITH made AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out'),
n AS (SELECT m.hash, count(DISTINCT CASE WHEN NOT declared THEN keyid END) AS signers
      FROM made m JOIN work w USING (record_id) LEFT JOIN verified v USING (record_id) GROUP BY m.hash)
SELECT hash, signers, signers>=5 AS met, CASE WHEN signers<5 THEN signers||' of 5 required reproductions' END AS reason FROM n""")
def _(t):
    counts = R.reproductions(t.work, t.work_file, t.signature, t.trust_key).select("hash", "signers")
    return T.at_least(counts, "signers", 5)


@query("resolved_tier", """
SELECT w.record_id, v.keyid, v.tier, v.name FROM work w LEFT JOIN
 (SELECT record_id, arg_min(keyid,pos) AS keyid, arg_min(tier,pos) AS tier, arg_min(name,pos) AS name FROM verified
  GROUP BY record_id) v USING (record_id)""")
def _(t):
    return T.resolved_tier(t.work.select("record_id"), t.signature, t.trust_key)


@query("signers_of_record", """
SELECT record_id, string_agg(keyid||'/'||tier, ',' ORDER BY pos) AS signers FROM verified GROUP BY record_id""")
def _(t):
    s = T.signers_of(t.signature, t.trust_key)
    return s.select("record_id", F.array_join(F.transform("signers", lambda x: F.concat(x.keyid, F.lit("/"), x.tier)),
                                              ",").alias("signers"))


@query("tiers_of_record", """
SELECT record_id, string_agg(tier, ',' ORDER BY tier) AS tiers FROM (SELECT DISTINCT record_id, tier FROM verified)
GROUP BY record_id""")
def _(t):
    return T.tiers_of(t.signature, t.trust_key).select("record_id", F.array_join("tiers", ",").alias("tiers"))


@query("key_names", "SELECT keyid, name||' ('||tier||')' AS label FROM trust_key")
def _(t):
    return T.key_names(t.trust_key)


@query("keys_of_tier", "SELECT keyid FROM trust_key WHERE tier='europe'")
def _(t):
    return T.tier_keys(t.trust_key, "europe").select("keyid")


@query("included_and_excluded", """
WITH r AS (SELECT record_id, arg_min(tier,pos) AS tier FROM verified GROUP BY record_id)
SELECT w.record_id, coalesce(r.tier='asia', false) AS included, CASE WHEN r.tier='asia' THEN w.cmd END AS cmd,
       CASE WHEN r.tier='asia' THEN w.environment END AS environment
FROM work w LEFT JOIN r USING (record_id)""")
def _(t):
    resolved = T.resolved_tier(t.work, t.signature, t.trust_key)
    keep, _ = T.work_keeps(tier="asia")
    return T.split(resolved, keep, ["cmd", "environment"])


@query("producers", """
SELECT DISTINCT f.hash, f.record_id FROM work_file f WHERE role='out' AND EXISTS
 (SELECT 1 FROM work_file i WHERE i.role='in' AND i.hash=f.hash)""")
def _(t):
    read = t.work_file.filter("role = 'in'").select("hash").distinct()
    return R.producers(t.work_file, read)


@query("uses", """
SELECT DISTINCT f.hash, f.record_id FROM work_file f WHERE role='in' AND EXISTS
 (SELECT 1 FROM work_file o WHERE o.role='out' AND o.hash=f.hash)""")
def _(t):
    made = t.work_file.filter("role = 'out'").select("hash").distinct()
    return R.uses(t.work_file, made)


def _latest(t):
    """Outputs that no record reads: the last state of every customer, the suppliers' files."""
    out = t.work_file.filter("role = 'out'").select("hash").distinct()
    return out.join(t.work_file.filter("role = 'in'").select("hash"), "hash", "left_anti")


@query("lineage_of_last_states", """
WITH RECURSIVE last AS (SELECT 'cust:'||o_custkey||':'||max(n) AS hash FROM states GROUP BY o_custkey),
prod AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out' AND hash LIKE 'cust:%'),
ins AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='in' AND hash LIKE 'cust:%'),
walk AS (SELECT l.hash AS hash, p.record_id, CAST(0 AS BIGINT) AS depth FROM last l JOIN prod p ON p.hash=l.hash
         UNION ALL
         SELECT w.hash, p.record_id, w.depth+1 FROM walk w JOIN ins i ON i.record_id=w.record_id JOIN prod p ON p.hash=i.hash)
SELECT hash, record_id, min(depth) AS depth FROM walk GROUP BY ALL""")
def _(t):
    states = _latest(t).filter(F.col("hash").startswith("cust:"))
    return R.lineage(t.work_file, states)


LAST = """fin AS (SELECT DISTINCT hash FROM work_file WHERE role='out' AND hash NOT IN (SELECT hash FROM work_file WHERE role='in'))"""
# Every last output's producers, the producers of their inputs, and so on.
BEHIND = LAST + """,
made AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out'),
up AS (SELECT DISTINCT i.record_id AS src, m.record_id AS dst FROM work_file i JOIN made m USING (hash) WHERE i.role='in'),
behind AS (SELECT hash, record_id, CAST(0 AS BIGINT) AS depth FROM fin JOIN made USING (hash)
  UNION ALL SELECT b.hash, up.dst, b.depth+1 FROM behind b JOIN up ON up.src=b.record_id)"""


@query("lineage_of_last_outputs", f"WITH RECURSIVE {BEHIND} SELECT hash, record_id, min(depth) AS depth FROM behind GROUP BY ALL")
def _(t):
    return R.lineage(t.work_file, _latest(t))


@query("lineage_totals", f"""WITH RECURSIVE {BEHIND},
pairs AS (SELECT DISTINCT hash, record_id FROM behind),
i AS (SELECT record_id, count(DISTINCT hash) FILTER (hash IN (SELECT hash FROM made)) AS linked, count(DISTINCT hash) FILTER (hash NOT IN (SELECT hash FROM made)) AS reads
  FROM work_file WHERE role='in' GROUP BY record_id)
SELECT hash, count(*) AS records, count(*) FILTER (coalesce(linked,0)=0) AS ends, CAST(sum(coalesce(reads,0)) AS BIGINT) AS reads FROM pairs LEFT JOIN i USING (record_id) GROUP BY hash""")
def _(t):
    """From the labels of the reachability index: one row per last output."""
    return R.lineage_totals(t.work_file, _latest(t))


@query("lineage_leads", f"""WITH RECURSIVE {BEHIND},
last AS (SELECT hash, TRY_CAST(split_part(hash,':',2) AS BIGINT) AS owner FROM fin WHERE hash LIKE 'cust:%'),
ask AS (SELECT f.hash, 'w'||s.o_orderkey AS record_id FROM states s JOIN fin f ON f.hash='supp:'||(1+s.o_custkey%10) WHERE s.n%3=1
  UNION SELECT l.hash, 'w'||o.o_orderkey FROM orders o JOIN last l ON l.owner=o.o_custkey UNION SELECT l.hash, 'w'||o.o_orderkey FROM orders o JOIN last l ON l.owner=o.o_custkey+1)
SELECT hash, record_id, bool_or(found) AS leads FROM (SELECT hash, record_id, false AS found, true AS asked FROM ask UNION ALL SELECT hash, record_id, true, false FROM behind)
GROUP BY hash, record_id HAVING bool_or(asked)""")
def _(t):
    """Is a record in the lineage of a supplier's file, of its customer's last state, of the next customer's? One row per question."""
    states, fin = t._states.select(F.col("o_custkey").alias("c"), "n", F.concat(F.lit("w"), "o_orderkey").alias("record_id")), _latest(t)
    supp = states.filter("n % 3 = 1").select(F.concat(F.lit("supp:"), 1 + F.col("c") % 10).alias("hash"), "record_id")
    last = fin.filter("hash LIKE 'cust:%'").select("hash", F.split("hash", ":")[1].cast("bigint").alias("owner"))
    mine = states.select("record_id", F.explode(F.array("c", F.col("c") + 1)).alias("owner")).join(last, "owner").select("hash", "record_id")
    return R.leads_to(t.work_file, supp.join(fin, "hash", "left_semi").unionByName(mine).distinct())


@query("pedigree_three_hops", """
WITH prod AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out'),
e AS (SELECT DISTINCT i.record_id AS src, p.record_id AS dst FROM work_file i JOIN prod p ON i.hash=p.hash WHERE i.role='in'),
w0 AS (SELECT DISTINCT p.record_id AS root, p.record_id FROM prod p WHERE hash IN
   (SELECT 'cust:'||o_custkey||':'||max(n) FROM states GROUP BY o_custkey)),
w1 AS (SELECT DISTINCT root, dst AS record_id FROM w0 JOIN e ON src=record_id),
w2 AS (SELECT DISTINCT root, dst AS record_id FROM w1 JOIN e ON src=record_id),
w3 AS (SELECT DISTINCT root, dst AS record_id FROM w2 JOIN e ON src=record_id)
SELECT root, record_id, min(level) AS level FROM (SELECT *, CAST(0 AS BIGINT) AS level FROM w0 UNION ALL
  SELECT *, 1 FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3) GROUP BY ALL""")
def _(t):
    states = _latest(t).filter(F.col("hash").startswith("cust:"))
    heads = R.producers(t.work_file, states).select("record_id").distinct()
    return R.pedigree(t.work_file, heads, hops=3)


@query("pedigree_of_last_outputs", f"""
WITH {LAST}, prod AS (SELECT DISTINCT record_id, hash FROM work_file WHERE role='out'),
e AS (SELECT DISTINCT i.record_id AS src, p.record_id AS dst FROM work_file i JOIN prod p ON i.hash=p.hash WHERE i.role='in'),
w0 AS (SELECT DISTINCT record_id AS root, record_id FROM prod JOIN fin USING (hash)),
w1 AS (SELECT DISTINCT root, dst AS record_id FROM w0 JOIN e ON src=record_id),
w2 AS (SELECT DISTINCT root, dst AS record_id FROM w1 JOIN e ON src=record_id),
w3 AS (SELECT DISTINCT root, dst AS record_id FROM w2 JOIN e ON src=record_id)
SELECT root, record_id, min(level) AS level FROM (SELECT *, CAST(0 AS BIGINT) AS level FROM w0 UNION ALL
  SELECT *, 1 FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3) GROUP BY ALL""")
def _(t):
    heads = R.producers(t.work_file, _latest(t)).select("record_id").distinct()
    return R.pedigree(t.work_file, heads, hops=3)


@query("uses_one_hop", """
SELECT DISTINCT o.record_id AS root, i.record_id AS record_id
FROM work_file o JOIN work_file i ON o.hash=i.hash AND o.role='out' AND i.role='in' WHERE o.record_id<>i.record_id""")
def _(t):
    all_records = t.work.select("record_id")
    return R.pedigree(t.work_file, all_records, hops=1, up=False).filter("level = 1").select("root", "record_id")


@query("record_detail", """
WITH r AS (SELECT record_id, arg_min(keyid,pos) AS keyid, arg_min(tier,pos) AS tier FROM verified GROUP BY record_id),
f AS (SELECT record_id, string_agg(CASE WHEN role='in' THEN path||'='||hash END, ';' ORDER BY path, hash) AS inputs,
  string_agg(CASE WHEN role='out' THEN path||'='||hash END, ';' ORDER BY path, hash) AS outputs FROM work_file GROUP BY record_id)
SELECT w.record_id, kind, cmd, environment, keyid, tier, coalesce(inputs,'') AS inputs, coalesce(outputs,'') AS outputs
FROM work w LEFT JOIN r USING (record_id) LEFT JOIN f USING (record_id)""")
def _(t):
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x.path, F.lit("="), x.hash)), ";").alias(c)
    return R.detail(t.work, t.work_file, t.signature, t.trust_key).select(
        "record_id", "kind", "cmd", "environment", "keyid", "tier", flat("inputs"), flat("outputs"))


@query("agreed_environment", """
WITH m AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out')
SELECT hash, CASE WHEN count(DISTINCT environment)=1 THEN min(environment) END AS environment
FROM m JOIN work USING (record_id) GROUP BY hash""")
def _(t):
    return R.agreed_environment(t.work, t.work_file)


@query("normaliser_of_record", """
SELECT record_id, CASE WHEN declared THEN 'strip-times' WHEN environment='env-f' THEN 'sort-lines' ELSE 'none' END AS normaliser,
       CASE WHEN declared THEN 'call' WHEN environment='env-f' THEN 'class' ELSE 'repository' END AS via FROM work""")
def _(t):
    calls = t.work.select("record_id", "environment", F.when(F.col("declared"), "strip-times").alias("own_normaliser"))
    classes = t.work.select("environment").distinct().select(
        "environment", F.when(F.col("environment") == "env-f", "sort-lines").alias("class_normaliser"))
    return R.normaliser(calls, classes, "none").select("record_id", "normaliser", "via")


@query("reproduction_level", """
WITH d AS (SELECT doc_id, source, sha256(text) AS raw, sha256(lower(regexp_replace(text,'\\s+',' ','g'))) AS norm FROM documents),
r AS (SELECT source, arg_min(raw, doc_id) AS raw, arg_min(norm, doc_id) AS norm FROM d GROUP BY source)
SELECT d.doc_id, CASE WHEN d.raw=r.raw THEN 'L0' WHEN d.norm=r.norm THEN 'L1' END AS repro_level FROM d JOIN r USING (source)""")
def _(t):
    norm = F.sha2(F.lower(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), 256)
    d = t.base("documents").select("doc_id", "source", F.sha2("text", 256).alias("candidate"), norm.alias("candidate_norm"))
    ref = d.groupBy("source").agg(F.min_by(F.struct("candidate", "candidate_norm"), "doc_id").alias("r")).select(
        "source", F.col("r.candidate").alias("reference"), F.col("r.candidate_norm").alias("reference_norm"))
    return R.reproduction_level(d.join(ref, "source")).select("doc_id", "repro_level")


@query("corroborated_bases", """
WITH made AS (SELECT DISTINCT hash, record_id FROM work_file WHERE role='out'),
n AS (SELECT m.hash, count(DISTINCT CASE WHEN NOT declared THEN keyid END) AS signers
      FROM made m JOIN work w USING (record_id) LEFT JOIN verified v USING (record_id) GROUP BY m.hash),
b AS (SELECT record_id AS claim_id, hash, row_number() OVER (PARTITION BY record_id ORDER BY hash) AS ord
      FROM work_file WHERE role='in'),
s AS (SELECT b.*, coalesce(n.signers,0) AS signers FROM b LEFT JOIN n USING (hash) WHERE coalesce(n.signers,0)<1)
SELECT claim_id, arg_min(hash,ord) AS hash, arg_min(signers,ord) AS signers, arg_min(signers,ord)||' of 1 signers' AS reason
FROM s GROUP BY claim_id""")
def _(t):
    counts = R.reproductions(t.work, t.work_file, t.signature, t.trust_key)
    basis = t.work_file.filter("role = 'in'").select(F.col("record_id").alias("claim_id"), "hash", F.col("hash").alias("ord"))
    return R.corroboration(basis, counts, 1)


@query("run_levels", """
SELECT 'w'||o_orderkey AS record_id, n-1 AS level FROM states""")
def _(t):
    return R.run_levels(t.work_file, t.work.select("record_id"))


@query("run_order", """
SELECT 'w'||o_orderkey AS record_id, kind AS step, 2*(n-1) AS level, false AS in_cycle, 1 AS place FROM states JOIN work ON record_id='w'||o_orderkey""")
def _(t):
    return R.run_order(t.work_file, t.work.select("record_id", F.col("kind").alias("step")))


@query("order_with_cycles", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id||':'||k AS src, user_id||':'||((k*7+3)%100) AS dst FROM trace_source WHERE event_type IN ('click','view','purchase')),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
far AS (SELECT src, dst FROM e UNION SELECT far.src, e.dst FROM far JOIN e ON e.src=far.dst),
ring AS (SELECT a.src AS id, max(a.dst) AS other, count(*) FILTER (a.dst<>a.src) AS others FROM far a JOIN far b ON a.src=b.dst AND a.dst=b.src GROUP BY a.src),
p AS (SELECT n.id, greatest(n.id, coalesce(other, n.id)) AS part, coalesce(others, 0)>0 AS in_cycle FROM n LEFT JOIN ring USING (id)),
pe AS (SELECT DISTINCT a.part AS src, b.part AS dst FROM e JOIN p a ON a.id=e.src JOIN p b ON b.id=e.dst WHERE a.part<>b.part),
lv AS (SELECT DISTINCT part, CAST(0 AS BIGINT) AS level FROM p UNION SELECT pe.dst, level+1 FROM lv JOIN pe ON pe.src=lv.part)
SELECT p.id, part, max(level) AS level, in_cycle, row_number() OVER (PARTITION BY part ORDER BY p.id) AS place FROM p JOIN lv USING (part) GROUP BY p.id, part, in_cycle""")
def _(t):
    """Every key of a user's events leads to one other key, so that ways run into rings: levels exist behind them, and rings are ordered by name."""
    e = t._events.filter("event_type IN ('click', 'view', 'purchase')")
    node = lambda k: F.concat_ws(":", "user_id", k)
    edges = cut(e.select(node(F.col("k")).alias("src"), node((F.col("k") * 7 + 3) % 100).alias("dst")).distinct())
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return components.order(nodes, edges)


@query("workflow_trace", """
WITH r AS (SELECT record_id, arg_min(keyid,pos) AS keyid, arg_min(tier,pos) AS tier FROM verified GROUP BY record_id)
SELECT w.record_id, n-1 AS level, kind, cmd, keyid, tier FROM work w JOIN states ON record_id='w'||o_orderkey
LEFT JOIN r USING (record_id)""")
def _(t):
    return R.workflow_trace(t.work, t.work_file, t.signature, t.trust_key, _latest(t))


@query("source_status", """
WITH a AS (SELECT unnest(registries) AS registry, 'work' AS layer, record_id FROM work UNION ALL
           SELECT unnest(registries), 'claim', claim_id FROM claim),
ok AS (SELECT DISTINCT record_id FROM verified UNION SELECT claim_id FROM trusted_claim)
SELECT registry, layer, count(*) AS records, count(ok.record_id) AS verified FROM a LEFT JOIN ok USING (record_id)
GROUP BY registry, layer""")
def _(t):
    held = t.work.select(F.explode("registries").alias("registry"), F.lit("work").alias("layer"), "record_id").unionByName(
        t.claim.select(F.explode("registries").alias("registry"), F.lit("claim").alias("layer"),
                       F.col("claim_id").alias("record_id")))
    sigs = t.signature.select("record_id", "pos", "keyid").unionByName(
        t.claim.select(F.col("claim_id").alias("record_id"), F.lit(0).cast("bigint").alias("pos"), "keyid"))
    return R.source_status(held, sigs, t.trust_key)


def _claims_on_work(t):
    """Claims read as being about work records: event n speaks about order n."""
    return t.claim.select(F.concat(F.lit("w"), "seq").alias("record_id"), "claim_id", "predicate", "keyid", "seq")


@query("run_state", """
WITH o AS (SELECT record_id, count(*) AS outputs FROM work_file WHERE role='out' GROUP BY record_id),
s AS (SELECT 'w'||seq AS record_id, count(*) AS claims, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS templates
      FROM claim GROUP BY seq)
SELECT w.record_id, coalesce(outputs,0) AS outputs, coalesce(claims,0) AS claims, claims IS NOT NULL AS claimed, templates,
       false AS reproduces FROM work w LEFT JOIN o USING (record_id) LEFT JOIN s USING (record_id)""")
def _(t):
    return R.run_state(t.work, t.work_file, _claims_on_work(t)).withColumn("templates", F.array_join("templates", ","))


@query("residence_of_files", """
WITH r AS (SELECT record_id, arg_min(tier,pos) AS tier FROM verified GROUP BY record_id),
p AS (SELECT f.hash, arg_min(f.record_id, w.seq) AS record_id, arg_min(r.tier, w.seq) AS tier
      FROM work_file f JOIN r USING (record_id) JOIN work w USING (record_id) WHERE role='out' GROUP BY f.hash),
c AS (SELECT 'w'||seq AS record_id, claim_id, tier AS ctier, seq FROM trusted_claim)
SELECT p.hash, p.record_id, p.tier, arg_min(c.claim_id, (CASE WHEN c.ctier<>p.tier THEN 1 ELSE 0 END, c.seq)) AS claim_id
FROM p LEFT JOIN c USING (record_id) GROUP BY ALL""")
def _(t):
    files = t.work_file.filter("role = 'out'").select("hash").distinct()
    told = _claims_on_work(t).join(t.trust_key.select("keyid", "tier"), "keyid")
    return R.residence(files, t.work_file, t.work, t.signature, t.trust_key, told)


@query("steps_published", """
WITH so AS (SELECT DISTINCT record_id AS step, hash FROM work_file WHERE role='out'),
si AS (SELECT step, list_sort(list(hash)) AS ins FROM (SELECT DISTINCT f.record_id AS step, f.hash FROM work_file f WHERE f.role='in' AND NOT EXISTS
  (SELECT 1 FROM back b WHERE b.record_id=f.record_id AND b.hash=f.hash)) GROUP BY step),
made AS (SELECT DISTINCT f.record_id, hash FROM work_file f JOIN work w USING (record_id) WHERE role='out' AND environment='env-f'),
rd AS (SELECT f.record_id, list(DISTINCT hash) AS ins FROM work_file f JOIN work w USING (record_id) WHERE role='in' AND environment='env-f' GROUP BY f.record_id),
pairs AS (SELECT so.step, so.hash, made.record_id, coalesce(list_has_all(coalesce(si.ins,[]), rd.ins), true) AS fits FROM so JOIN made USING (hash) LEFT JOIN si ON si.step=so.step LEFT JOIN rd ON rd.record_id=made.record_id),
per AS (SELECT so.step, so.hash, bool_or(fits) AS exact FROM so LEFT JOIN pairs USING (step, hash) GROUP BY ALL)
SELECT step, CASE WHEN bool_and(coalesce(exact,false)) THEN 'published' WHEN bool_and(exact IS NOT NULL) THEN 'same' ELSE 'new' END AS state FROM per GROUP BY step""".replace(
    "WITH so", "WITH back AS (SELECT 'w'||l_orderkey AS record_id, 'part:'||l_partkey AS hash FROM lineitem GROUP BY ALL HAVING bool_and(l_returnflag='R')),\nso", 1))
def _(t):
    """Steps are the orders with all they wrote; they did not read the parts that all came back. Only one class is published."""
    back = t.base("lineitem").groupBy(F.concat(F.lit("w"), "l_orderkey").alias("record_id"), F.concat(F.lit("part:"), "l_partkey").alias("hash")).agg(
        F.bool_and(F.col("l_returnflag") == "R").alias("all")).filter("all").select("record_id", "hash", F.lit("in").alias("role"))
    step = t.work_file.join(back, ["record_id", "hash", "role"], "left_anti").select(F.col("record_id").alias("step"), "role", "hash")
    published = t.work.filter("environment = 'env-f'").select("record_id")
    return R.steps_published(step, t.work_file.join(published, "record_id", "left_semi"))


@query("published_upstream", """
WITH mine AS (SELECT DISTINCT record_id FROM work_file JOIN work USING (record_id) WHERE role='out' AND environment='env-o')
SELECT 'w'||o_orderkey AS record_id FROM states WHERE 'w'||o_orderkey NOT IN (SELECT record_id FROM mine)""")
def _(t):
    # Steps recorded here wrote customer states.
    outs = t.work_file.filter("role = 'out' AND hash LIKE 'cust:%'").join(
        t.work.filter("environment = 'env-o'").select("record_id"), "record_id", "left_semi")
    return R.published_upstream(t.work_file, _latest(t), outs)


@query("published_upstream_of_outputs", """
WITH mine AS (SELECT DISTINCT hash FROM work_file JOIN work USING (record_id) WHERE role='out' AND environment='env-o')
SELECT record_id FROM work WHERE record_id NOT IN (SELECT record_id FROM work_file WHERE role='out' AND hash IN (SELECT hash FROM mine))""")
def _(t):
    outs = t.work_file.filter("role = 'out'").join(t.work.filter("environment = 'env-o'").select("record_id"), "record_id", "left_semi")
    return R.published_upstream(t.work_file, _latest(t), outs)


@query("reproduced_outputs", """
SELECT f.record_id, f.hash, CASE WHEN EXISTS (SELECT 1 FROM work_file o JOIN work w2 USING (record_id)
   WHERE o.role='out' AND o.hash=f.hash AND w2.environment='env-f') THEN 'same' ELSE 'differs' END AS state
FROM work_file f JOIN work w USING (record_id) WHERE f.role='out' AND w.environment='env-o'""")
def _(t):
    outs = t.work_file.filter("role = 'out'").join(t.work.select("record_id", "environment"), "record_id")
    return R.reproduced_outputs(outs.filter("environment = 'env-o'").select("record_id", "hash"),
                                outs.filter("environment = 'env-f'"))


@query("material_report", """
WITH m AS (SELECT record_id, pos, keyid IS NOT NULL AS decodes, CASE WHEN pos=1 THEN 'w0' ELSE record_id END AS bound_to,
  CASE WHEN t.keyid2 IS NOT NULL THEN true WHEN keyid='n0' THEN false END AS chain_ok
  FROM signature LEFT JOIN (SELECT keyid AS keyid2 FROM trust_key) t ON keyid=keyid2),
r AS (SELECT *, CASE WHEN NOT decodes THEN 'unreadable' WHEN bound_to<>record_id THEN 'not-bound' WHEN chain_ok=false THEN 'chain' END AS why FROM m)
SELECT record_id, pos, CASE WHEN why IS NOT NULL THEN 'failed' WHEN chain_ok THEN 'verified' ELSE 'carried' END AS verdict, why FROM r""")
def _(t):
    return R.material_report(_material(t)).select("record_id", "pos", "verdict", "why")


def _material(t):
    trusted = t.trust_key.select("keyid", F.lit(True).alias("__t"))
    return t.signature.join(trusted, "keyid", "left").select(
        "record_id", "pos", F.lit("certificate").alias("scheme"), F.col("keyid").isNotNull().alias("decodes"),
        F.when(F.col("pos") == 1, "w0").otherwise(F.col("record_id")).alias("bound_to"),
        F.when(F.col("__t"), True).when(F.col("keyid") == "n0", False).alias("chain_ok"))


@query("strongest_verdict", """
WITH m AS (SELECT record_id, pos, keyid IS NOT NULL AS decodes, CASE WHEN pos=1 THEN 'w0' ELSE record_id END AS bound_to,
  CASE WHEN t.keyid2 IS NOT NULL THEN true WHEN keyid='n0' THEN false END AS chain_ok
  FROM signature LEFT JOIN (SELECT keyid AS keyid2 FROM trust_key) t ON keyid=keyid2),
r AS (SELECT *, CASE WHEN NOT decodes THEN 'unreadable' WHEN bound_to<>record_id THEN 'not-bound' WHEN chain_ok=false THEN 'chain' END AS why FROM m),
v AS (SELECT record_id, CASE WHEN why IS NOT NULL THEN 0 WHEN chain_ok THEN 2 ELSE 1 END AS rank FROM r)
SELECT record_id, ['failed','carried','verified'][max(rank)+1] AS verdict FROM v GROUP BY record_id""")
def _(t):
    return R.strongest(R.material_report(_material(t)), ["record_id"], "pos")


@query("ran_in_accounts", """
SELECT DISTINCT s.record_id, s.keyid, w.environment AS value FROM signature s JOIN work w USING (record_id)
JOIN verified v ON v.record_id=s.record_id AND v.keyid=s.keyid""")
def _(t):
    statements = t.signature.join(t.work.select("record_id", "environment"), "record_id").select(
        "record_id", "keyid", F.lit("environment").alias("scheme"), F.col("environment").alias("value"))
    return R.ran_in(statements, t.signature, t.trust_key)


@query("locators_of_files", """
SELECT DISTINCT f.record_id, f.path, f.hash, 'store:'||f.hash AS value FROM work_file f JOIN signature s USING (record_id)
JOIN trust_key t ON t.keyid=s.declared""")
def _(t):
    said = t.work_file.join(t.signature.select("record_id", F.col("declared").alias("keyid")), "record_id").select(
        "record_id", "keyid", "path", "hash", F.lit("locator").alias("scheme"), F.concat(F.lit("store:"), "hash").alias("value"))
    return R.locators(said, t.work_file, t.trust_key)


@query("records_of_a_page", """
SELECT record_id, cmd FROM work ORDER BY seq OFFSET 100 LIMIT 500""")
def _(t):
    return R.page(t.work, ["seq"], offset=100, limit=500)[0].select("record_id", "cmd")
