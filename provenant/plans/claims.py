"""The algebra and the named questions over claims."""

from pyspark.sql import functions as F

from provenant.operators import questions as Q
from provenant.operators import records as R
from provenant.operators import trust as T
from provenant.operators import unions as U
from provenant.operators import view as V
from provenant.operators.scopes import heads
from provenant.plans.records import BEHIND, _latest
from provenant.plans.registry import hash_sum_sql, query
from provenant.plans.view import LABELS, labels, nodes, view


def attribution(t):
    return T.verified(t.signature, t.trust_key)


def trusted(t):
    return t.claim.join(t.trust_key, "keyid")


def flat_view(t):
    """Trusted claims with whether a claim of theirs replaced them."""
    gone = V.replaced_by(nodes(t)).select("claim_id").distinct().withColumn("replaced", F.lit(True))
    return trusted(t).join(gone, "claim_id", "left").withColumn("replaced", F.coalesce("replaced", F.lit(False)))


FLAT = """flat AS (SELECT c.*, r.x IS NOT NULL AS replaced FROM trusted_claim c
  LEFT JOIN (SELECT DISTINCT replaces AS x FROM trusted_claim WHERE replaces IS NOT NULL) r ON r.x=c.claim_id)"""


@query("pattern_join", """
SELECT 'urn:work:'||a.record_id AS step, 'urn:file:'||a.hash AS file, 'urn:work:'||b.record_id AS maker
FROM (SELECT DISTINCT record_id, hash FROM work_file WHERE role='in') a
JOIN (SELECT DISTINCT record_id, hash FROM work_file WHERE role='out') b USING (hash)""")
def _(t):
    q = V.project_work(t.work, t.work_file, t.signature, t.trust_key)
    return Q.pattern(q, V.USED, "step", "file").join(Q.pattern(q, V.GENERATED, "file", "maker"), "file")


@query("optional_pattern", """
SELECT c.claim_id, r.claim_id AS later FROM claim c LEFT JOIN claim r ON r.replaces=c.claim_id""")
def _(t):
    later = t.claim.filter("replaces IS NOT NULL").select(F.col("replaces").alias("claim_id"), F.col("claim_id").alias("later"))
    return t.claim.select("claim_id").join(later, "claim_id", "left")


@query("not_exists", "SELECT claim_id FROM claim c WHERE NOT EXISTS (SELECT 1 FROM claim r WHERE r.replaces=c.claim_id)")
def _(t):
    return Q.without(t.claim.select("claim_id"), t.claim.select(F.col("replaces").alias("claim_id")), ["claim_id"])


@query("exists_as_value", """
SELECT DISTINCT person, subject, EXISTS (SELECT 1 FROM claim p WHERE p.predicate='purchase' AND p.person=c.person AND p.subject=c.subject) AS bought
FROM claim c WHERE predicate='view'""")
def _(t):
    seen = t.claim.filter("predicate = 'view'").select("person", "subject").distinct()
    return Q.flagged(seen, t.claim.filter("predicate = 'purchase'"), ["person", "subject"], "bought")


@query("values_join", """
SELECT claim_id, w.label FROM claim JOIN (VALUES ('view','looked at'),('purchase','bought')) w(predicate,label) USING (predicate)""")
def _(t):
    return t.claim.join(Q.inline(t.spark, [("view", "looked at"), ("purchase", "bought")], ["predicate", "label"]), "predicate").select(
        "claim_id", "label")


@query("computed_columns", "SELECT claim_id, 'urn:claim:'||claim_id AS node, predicate||' '||level AS title FROM claim")
def _(t):
    return t.claim.select("claim_id", V.iri("claim", "claim_id").alias("node"), F.concat("predicate", F.lit(" "), "level").alias("title"))


@query("typed_comparison", """
SELECT doc_id FROM documents WHERE coalesce(TRY_CAST(regexp_extract(text,'([0-9]+)',1) AS BIGINT)>50, false) OR regexp_matches(lang,'(?i)^E')""")
def _(t):
    number = F.regexp_extract("text", "([0-9]+)", 1)
    big = Q.compares(number, "bigint", lambda c: c > 50)
    return t.base("documents").filter(big | F.col("lang").rlike("(?i)^E")).select("doc_id")


@query("transitive_path", """
SELECT a.claim_id AS src, b.claim_id AS dst FROM claim a JOIN claim b ON a.scope=b.scope AND (b.at,b.seq)<(a.at,a.seq)
WHERE a.predicate='error'""")
def _(t):
    back = t.claim.filter("prev IS NOT NULL").select(F.col("claim_id").alias("src"), F.col("prev").alias("dst"))
    return Q.closure(back, t.claim.filter("predicate = 'error'").select(F.col("claim_id").alias("src")))


@query("transitive_totals", """
WITH n AS (SELECT claim_id, row_number() OVER (PARTITION BY scope ORDER BY claim.at, seq)-1 AS reached FROM claim)
SELECT claim_id AS src, reached, CAST(reached>0 AS BIGINT) AS ends FROM n""")
def _(t):
    """How many earlier claims of its scope each claim leads to, and how many firsts among them, from labels."""
    back = t.claim.filter("prev IS NOT NULL").select(F.col("claim_id").alias("src"), F.col("prev").alias("dst"))
    return Q.closure_totals(back, t.claim.select(F.col("claim_id").alias("src")))


@query("graph_as_variable", "SELECT 'urn:work:'||record_id AS g, count(DISTINCT 'u'||hash) FILTER (role='in') AS used FROM work_file GROUP BY record_id")
def _(t):
    q = V.project_work(t.work, t.work_file, t.signature, t.trust_key)
    used = Q.pattern(q, V.USED, "step", "file", g="g").groupBy("g").agg(F.count(F.lit(1)).alias("used"))
    return q.select("g").distinct().join(used, "g", "left").select("g", F.coalesce("used", F.lit(0)).alias("used"))


@query("latest_in_scope", """
WITH m AS (SELECT scope, subject, predicate, max(position) AS position FROM claim JOIN claim_position USING (claim_id) GROUP BY ALL)
SELECT claim_id, m.scope, m.subject, m.predicate, m.position FROM m JOIN claim_position p USING (position) JOIN claim c USING (claim_id, scope, subject, predicate)""")
def _(t):
    from provenant.operators.scopes import positions
    placed = t.claim.join(positions(t.claim), "claim_id").select("claim_id", "scope", "subject", "predicate", "position")
    return Q.latest(placed, ["scope", "subject", "predicate"], "position")


@query("distinct_terms", "SELECT DISTINCT subject, predicate FROM claim")
def _(t):
    return t.claim.select("subject", "predicate").distinct()


@query("claim_count", "SELECT count(*) AS claims FROM trusted_claim")
def _(t):
    return trusted(t).agg(F.count(F.lit(1)).alias("claims"))


@query("latest_time_per_subject", "SELECT subject, epoch_us(max(c.at)) AS latest_us FROM claim c GROUP BY subject")
def _(t):
    return t.claim.groupBy("subject").agg(F.unix_micros(F.max("at")).alias("latest_us"))


@query("ordered_top", "SELECT claim_id, value FROM claim ORDER BY value DESC, claim_id LIMIT 20")
def _(t):
    return Q.limited(t.claim.select("claim_id", "value").orderBy(F.desc("value"), "claim_id"), 20)[0]


@query("everything_about_a_node", """
SELECT p, o FROM (SELECT 'urn:prov:kind' AS p, kind AS o, record_id FROM work UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#label', cmd, record_id FROM work
  UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:prov:Work', record_id FROM work
  UNION ALL SELECT DISTINCT 'http://www.w3.org/ns/prov#used', 'urn:file:'||hash, record_id FROM work_file WHERE role='in'
  UNION ALL SELECT DISTINCT 'http://www.w3.org/ns/prov#wasAttributedTo', 'urn:key:'||keyid, record_id FROM verified)
WHERE record_id=(SELECT min(record_id) FROM work)""")
def _(t):
    q = V.project_work(t.work, t.work_file, t.signature, t.trust_key)
    node = V.iri("work", F.lit(t.work.agg(F.min("record_id")).first()[0]))
    return Q.about_node(q, node).distinct()


@query("users_with_signer", """
SELECT DISTINCT f.hash, f.record_id, v.keyid FROM (SELECT DISTINCT hash, record_id FROM work_file WHERE role='in') f LEFT JOIN verified v USING (record_id)""")
def _(t):
    used = t.work_file.filter("role = 'in'").select("hash").distinct()
    return Q.users_with_signer(t.work_file, used, attribution(t))


@query("descriptions_and_rationales", f"""WITH {FLAT}
SELECT subject, claim_id, CASE predicate WHEN 'view' THEN 'description' ELSE 'rationale' END AS label FROM flat WHERE predicate IN ('view','click')""")
def _(t):
    return Q.labelled(trusted(t), {"view": "description", "click": "rationale"}).select("subject", "claim_id", "label")


@query("latest_description", "SELECT subject, claim_id, name FROM trusted_claim c WHERE predicate='view' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY c.at DESC, claim_id)=1")
def _(t):
    return Q.newest(trusted(t).filter("predicate = 'view'"), ["subject"], "at", ["claim_id", "name"])


@query("signer_in_time_window", """
SELECT claim_id FROM trusted_claim c WHERE keyid='n7' AND c.at>=TIMESTAMP '2024-01-08' AND c.at<TIMESTAMP '2024-01-15'""")
def _(t):
    import datetime as dt
    utc = dt.timezone.utc
    return Q.in_window(trusted(t), "n7", dt.datetime(2024, 1, 8, tzinfo=utc), dt.datetime(2024, 1, 15, tzinfo=utc)).select("claim_id")


@query("claims_in_named_scope", f"""WITH {FLAT}, {LABELS}
SELECT c.claim_id, c.scope, position FROM flat c JOIN lab ON lab.graph=c.scope JOIN claim_position p USING (claim_id)
WHERE NOT replaced AND label='day 2024-01-01'""")
def _(t):
    return Q.of_scope_named(view(t), labels(t), "day 2024-01-01").select("claim_id", "scope", "position")


@query("files_of_two_signers", """
WITH o AS (SELECT DISTINCT f.hash, f.path, f.record_id, v.keyid FROM work_file f JOIN verified v USING (record_id) WHERE role='out' )
SELECT hash, min(path) AS path FROM o a WHERE EXISTS (SELECT 1 FROM o b WHERE b.hash=a.hash AND b.record_id<>a.record_id AND b.keyid<>a.keyid) GROUP BY hash""")
def _(t):
    return Q.files_of_several(t.work_file, attribution(t))


@query("runs_of_script", "SELECT DISTINCT record_id, path, hash FROM work_file WHERE role='in' AND regexp_matches(path,'^/p/1[0-9]*\\.csv$')")
def _(t):
    return Q.runs_of_script(t.work_file, r"^/p/1[0-9]*\.csv$")


@query("all_sources", """
WITH mine AS (SELECT o_custkey, o_orderkey, n FROM states),
last AS (SELECT o_custkey, 'cust:'||o_custkey||':'||max(n) AS hash FROM states GROUP BY o_custkey)
SELECT l.hash, i.hash AS source, min(i.path) AS path FROM last l JOIN mine m USING (o_custkey) JOIN work_file i ON i.record_id='w'||m.o_orderkey AND i.role='in'
GROUP BY ALL""")
def _(t):
    out = t.work_file.filter("role = 'out' AND hash LIKE 'cust:%'").select("hash").distinct()
    return Q.all_sources(t.work_file, out.join(t.work_file.filter("role = 'in'").select("hash"), "hash", "left_anti"))


@query("all_sources_of_outputs", f"""WITH RECURSIVE {BEHIND}
SELECT b.hash, i.hash AS source, min(i.path) AS path FROM (SELECT DISTINCT hash, record_id FROM behind) b JOIN work_file i ON i.record_id=b.record_id AND i.role='in'
GROUP BY ALL""")
def _(t):
    return Q.all_sources(t.work_file, _latest(t))


@query("sources_of_given_outputs", f"""WITH RECURSIVE {BEHIND}
SELECT b.hash, i.hash AS source, min(i.path) AS path FROM (SELECT DISTINCT hash, record_id FROM behind WHERE hash IN (SELECT 'cust:'||o_custkey||':'||max(n) FROM states GROUP BY o_custkey)) b
JOIN work_file i ON i.record_id=b.record_id AND i.role='in' GROUP BY ALL""")
def _(t):
    """What the customers' last states were derived from, listed from the labels of the index over all files."""
    return R.sources_of(t.work_file, _latest(t).filter(F.col("hash").startswith("cust:")))


@query("trusted_production", """
SELECT hash, bool_or(v.record_id IS NOT NULL) AS trusted FROM work_file f LEFT JOIN (SELECT DISTINCT record_id FROM verified) v USING (record_id)
WHERE role='out' GROUP BY hash""")
def _(t):
    return Q.trusted_production(t.work_file, attribution(t), t.work_file.filter("role = 'out'").select("hash").distinct())


@query("latest_versions", f"""WITH {FLAT},
own AS (SELECT subject, arg_max(person, (f.at, claim_id)) AS owner FROM flat f WHERE predicate='signup' GROUP BY subject)
SELECT d.claim_id, d.subject, d.level, own.owner FROM flat d LEFT JOIN own USING (subject) WHERE d.predicate='error' AND NOT d.replaced""")
def _(t):
    f = flat_view(t)
    owner = f.filter("predicate = 'signup'").groupBy("subject").agg(F.max_by("person", F.struct("at", "claim_id")).alias("owner"))
    return Q.current(f, "error").join(owner, "subject", "left").select("claim_id", "subject", "level", "owner")


@query("latest_version_of_one", f"WITH {FLAT} SELECT claim_id, person, level FROM flat WHERE predicate='error' AND NOT replaced AND subject='part:9'")
def _(t):
    return Q.current(flat_view(t), "error").filter("subject = 'part:9'").select("claim_id", "person", "level")


@query("version_history", """
SELECT x.claim_id, x.subject, epoch_us(x.at) AS created, x.replaces, r.claim_id AS replaced_by FROM trusted_claim x
LEFT JOIN trusted_claim r ON r.replaces=x.claim_id WHERE x.predicate='error'""")
def _(t):
    errors = trusted(t).filter("predicate = 'error'").withColumn("created", F.unix_micros("at"))
    return Q.history(errors, V.replaced_by(nodes(t)))


@query("approvals", f"""
SELECT a.claim_id AS approval, a.keyid AS approver, a.prev AS target, d.predicate, d.subject
FROM trusted_claim a JOIN trusted_claim d ON a.prev=d.claim_id WHERE a.predicate='purchase' AND d.predicate IN ('error','view')""")
def _(t):
    c = trusted(t)
    return Q.approvals(c.filter("predicate = 'purchase'").withColumn("target", F.col("prev")), c.filter("predicate IN ('error', 'view')"))


@query("approval_counts", """
SELECT claim_id, level<>'L0' AND (keyid='n3' OR coalesce(tier IN ('asia','europe'),false)) AS counts,
 CASE WHEN level='L0' THEN 'not approved' WHEN NOT (keyid='n3' OR coalesce(tier IN ('asia','europe'),false)) THEN 'not signed by a person' END AS reason
FROM claim LEFT JOIN trust_key USING (keyid) WHERE predicate='purchase'""")
def _(t):
    given = t.claim.filter("predicate = 'purchase'").select(
        "claim_id", "keyid", F.when(F.col("level") == "L0", "rejected").otherwise("approved").alias("outcome"))
    return T.approval_counts(given, t.trust_key, "n3", ["asia", "europe"]).select("claim_id", "counts", "reason")


@query("roles_of_area", f"""WITH {FLAT}, {LABELS}
SELECT f.claim_id, f.person, f.subject FROM flat f JOIN lab ON lab.graph=f.scope WHERE NOT replaced AND predicate='signup' AND label='day 2024-01-01'""")
def _(t):
    return Q.of_scope_named(flat_view(t).filter("predicate = 'signup'"), labels(t), "day 2024-01-01").select("claim_id", "person", "subject")


TRAINING = """docs AS (SELECT DISTINCT subject AS document FROM trusted_claim WHERE predicate='signup'),
tr AS (SELECT DISTINCT person, subject AS document FROM trusted_claim WHERE predicate='view')"""


def training(t):
    c = trusted(t)
    return (c.select("person").distinct(), c.filter("predicate = 'signup'").select(F.col("subject").alias("document")).distinct(),
            c.filter("predicate = 'view'").select("person", F.col("subject").alias("document")))


@query("training_obligations", f"""WITH {TRAINING},
m AS (SELECT person, count(*) AS met FROM tr JOIN docs USING (document) GROUP BY person)
SELECT p.person, coalesce(met,0) AS met, (SELECT count(*) FROM docs)-coalesce(met,0) AS open FROM (SELECT DISTINCT person FROM trusted_claim) p LEFT JOIN m USING (person)""")
def _(t):
    return Q.obligations_of(*training(t))


@query("training_of_one_person", f"""WITH {TRAINING}
SELECT document, document IN (SELECT document FROM tr WHERE person='u7') AS trained FROM docs""")
def _(t):
    _, docs, trained = training(t)
    return Q.obligations_for("u7", docs, trained)


@query("rule_findings", f"""WITH {FLAT}
SELECT 'major-needs-owner' AS rule, d.subject||'/'||d.claim_id AS subject, 'error '||d.claim_id||' has no owner' AS message FROM flat d
WHERE d.predicate='error' AND d.level IN ('L1','L2') AND NOT d.replaced AND NOT EXISTS (SELECT 1 FROM flat o WHERE o.predicate='signup' AND o.scope=d.scope AND o.subject=d.subject)
UNION ALL
SELECT 'toxic-needs-quality', subject, 'toxic document of quality '||quality FROM label_claim WHERE toxic=1 AND quality=0""")
def _(t):
    f = flat_view(t)
    major = f.filter("predicate = 'error' AND level IN ('L1', 'L2') AND NOT replaced")
    open_ = Q.without(major, f.filter("predicate = 'signup'"), ["scope", "subject"]).withColumn("about", F.concat_ws("/", "subject", "claim_id"))
    toxic = t.label_claim.filter("toxic = 1 AND quality = 0")
    return Q.finding("major-needs-owner", open_, "about", F.concat(F.lit("error "), "claim_id", F.lit(" has no owner"))).unionByName(
        Q.finding("toxic-needs-quality", toxic, "subject", F.concat(F.lit("toxic document of quality "), "quality")))


MESSAGES = """msg AS (SELECT 'c'||conv_id AS topic, claim_id AS message, text, seq FROM (SELECT *, split_part(substr(claim_id,2),':',1) AS conv_id FROM turn_claim))"""


def messages(t):
    return t.turn.select(F.substring_index("claim_id", ":", 1).alias("topic"), F.col("claim_id").alias("message"), F.col("seq").alias("at"), "keyid", "prev")


@query("open_messages", """
WITH m AS (SELECT split_part(claim_id,':',1) AS topic, claim_id AS message, seq, keyid, prev FROM turn_claim),
cl AS (SELECT prev AS message FROM m WHERE keyid='assistant'),
op AS (SELECT * FROM m WHERE message NOT IN (SELECT message FROM cl WHERE message IS NOT NULL) AND keyid='user')
SELECT l.topic AS lane, l.topic, count(op.message) AS open, arg_max(op.message, op.seq) AS newest FROM (SELECT DISTINCT topic FROM m) l LEFT JOIN op USING (topic) GROUP BY l.topic""")
def _(t):
    m = messages(t)
    closed = m.filter("keyid = 'assistant'").select(F.col("prev").alias("message"))
    lanes = m.select(F.col("topic").alias("lane"), "topic").distinct()
    return Q.open_messages(m.filter("keyid = 'user'"), lanes, closed)


@query("unseen_messages", "SELECT claim_id AS message FROM turn_claim WHERE keyid<>'system'")
def _(t):
    m = messages(t)
    return Q.unseen(m, m.filter("keyid = 'system'")).select("message")


@query("rows_of_folder", "SELECT path FROM manifest WHERE source='src7' AND lang='en'")
def _(t):
    return Q.in_folder(t.manifest, "path", "/src7/en").select("path")


@query("installed_workflows", """
SELECT p.p_brand AS workflow, p.p_type AS role, count(*) AS inputs FROM part p JOIN (SELECT DISTINCT l_partkey FROM lineitem) l ON l.l_partkey=p.p_partkey GROUP BY ALL""")
def _(t):
    p = t.base("part").select("p_partkey", "p_brand", "p_type")
    q = p.select(F.col("p_brand").alias("g"), F.concat(F.lit("urn:file:part:"), "p_partkey").alias("s"), F.lit("role").alias("p"), F.col("p_type").alias("o"))
    used = V.project_work(t.work, t.work_file, t.signature, t.trust_key).filter(F.col("p") == V.USED).select(F.col("o").alias("file")).distinct()
    return Q.pattern(q, "role", "file", "role", g="workflow").join(used, "file").groupBy("workflow", "role").agg(F.count(F.lit(1)).alias("inputs"))


@query("pinned_dataset", "SELECT claim_id FROM claim WHERE scope IN (SELECT scope FROM claim WHERE genesis AND level='L0')")
def _(t):
    small = t.claim.filter("genesis AND level = 'L0'").select("scope")
    pinned = heads(t.claim).join(small, "scope", "left_semi")
    return Q.on_pinned_chains(t.claim, pinned).select("claim_id")


@query("result_hash", f"""WITH r AS (SELECT sha256('{{{{"claim_id":"'||claim_id||'","predicate":"'||predicate||'","subject":"'||subject||'","tier":"'||tier||'"}}}}') AS h FROM trusted_claim)
SELECT count(*) AS rows, {hash_sum_sql("h")} AS hash FROM r""".replace("{{", "{").replace("}}", "}"))
def _(t):
    return Q.result_hash(trusted(t).select("claim_id", "subject", "predicate", "tier"))


@query("values_used", "SELECT DISTINCT json_extract_string(props,'$.k') AS used FROM events")
def _(t):
    k = F.variant_get(F.parse_json("props"), "$.k", "string")
    return t.base("events").select(k.alias("used")).distinct()


@query("claims_about", "SELECT subject, claim_id FROM claim WHERE subject IN (SELECT hash FROM work_file WHERE role='in')")
def _(t):
    subjects = t.work_file.filter("role = 'in'").select(F.col("hash").alias("subject")).distinct()
    return t.claim.join(subjects, "subject", "left_semi").select("subject", "claim_id")


@query("claims_by_axis", """SELECT 'signer' AS axis, claim_id FROM claim WHERE keyid='n3' UNION ALL SELECT 'predicate', claim_id FROM claim WHERE predicate='error'
UNION ALL SELECT 'object', claim_id FROM claim WHERE level='L2' OR person='L2'""")
def _(t):
    from provenant.operators.axes import by_axis
    obj = t.claim.withColumn("object", F.to_json(F.struct("level", "person")))
    parts = [by_axis(obj, a, v).select(F.lit(a).alias("axis"), "claim_id") for a, v in (("signer", "n3"), ("predicate", "error"), ("object", "L2"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filtered_claims", "SELECT claim_id FROM trusted_claim WHERE tier='asia' AND level='L1' AND keyid='n7'")
def _(t):
    return trusted(t).filter(T.claim_keeps(tier="asia", level="L1", signer="n7")).select("claim_id")


@query("sources_holding_answer", "SELECT claim_id, array_to_string(registries, ',') AS sources FROM trusted_claim WHERE predicate='purchase'")
def _(t):
    from provenant.plans.unions import held_claims
    held = U.sources_of(held_claims(t)).select(F.col("record_id").alias("claim_id"), F.array_join("sources", ",").alias("sources"))
    return trusted(t).filter("predicate = 'purchase'").select("claim_id").join(held, "claim_id")
