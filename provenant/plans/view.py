"""Queries over the quad projection and the claim view."""

from pyspark.sql import functions as F

from provenant.operators import view as V
from provenant.plans.registry import query


def templates(t):
    """One template per predicate but one; views are rows."""
    return (t.base("events").select(F.col("event_type").alias("predicate")).distinct().filter("predicate <> 'signup'")
            .select("predicate", F.concat(F.lit("tpl-"), "predicate").alias("name"), (F.col("predicate") == "view").alias("is_rows")))


def nodes(t):
    """Trusted claims as nodes, straight from the claim table."""
    c = V.trusted_only(t.claim, t.trust_key)
    one = lambda x: F.array_compact(F.array(x))
    return c.select("claim_id", one("keyid").alias("signers"), one("subject").alias("about"), "predicate",
                    F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created"), "scope", "prev", "genesis",
                    one("replaces").alias("replaces"))


def view(t):
    return V.claim_view(t.claim, nodes(t), templates(t))


@query("quads_of_work", """
WITH f AS (SELECT 'urn:work:'||record_id AS r, 'urn:file:'||hash AS h, role, path FROM work_file),
q AS (SELECT 'urn:work:'||record_id AS g, 'urn:work:'||record_id AS s, unnest(['T','K','L']) AS p, unnest(['W',kind,cmd]) AS o FROM work
UNION ALL SELECT DISTINCT r, r, 'U', h FROM f WHERE role='in' UNION ALL SELECT DISTINCT r, h, 'G', r FROM f WHERE role='out'
UNION ALL SELECT DISTINCT r, h, 'L', path FROM f UNION ALL SELECT 'urn:work:'||record_id, 'urn:work:'||record_id, 'A', 'urn:key:'||keyid FROM verified)
SELECT g, s, p, o FROM q""")
def _(t):
    short = F.create_map(*[F.lit(x) for kv in {V.TYPE: "T", V.NS + "kind": "K", V.LABEL: "L", V.USED: "U", V.GENERATED: "G",
                                               V.ATTRIBUTED: "A"}.items() for x in kv])
    q = V.project_work(t.work, t.work_file, t.signature, t.trust_key)
    return q.select("g", "s", short[F.col("p")].alias("p"), F.when(F.col("o") == V.NS + "Work", "W").otherwise(F.col("o")).alias("o"))


@query("quads_of_claims", """
SELECT predicate, count(*)*9 + count(prev) + count(replaces) + count(*) FILTER (genesis) + count(*) AS quads FROM claim GROUP BY predicate""")
def _(t):
    q = V.project_claims(t.claim, t.trust_key)
    ids = t.claim.select("claim_id", "predicate")
    return (q.withColumn("claim_id", F.regexp_extract("g", r"^urn:(?:claim|attribution):([^#/]+)", 1)).join(ids, "claim_id")
            .groupBy("predicate").agg(F.count(F.lit(1)).alias("quads")))


@query("trusted_claims", "SELECT claim_id FROM trusted_claim")
def _(t):
    return V.trusted_only(t.claim, t.trust_key).select("claim_id")


@query("claim_nodes_from_quads", """
SELECT claim_id, keyid AS signers, subject AS about, predicate, strftime(c.at, '%Y-%m-%dT%H:%M:%S.%f')||'Z' AS created, scope, prev,
  genesis, coalesce(replaces,'') AS replaces FROM trusted_claim c""")
def _(t):
    n = V.claim_nodes(V.project_claims(t.claim, t.trust_key), t.trust_key)
    flat = lambda c: F.array_join(c, ",").alias(c)
    return n.select("claim_id", flat("signers"), flat("about"), "predicate", "created", "scope", "prev", "genesis", flat("replaces"))


@query("replaced_by", """
SELECT x.claim_id, r.claim_id AS replaced_by FROM trusted_claim x JOIN trusted_claim r ON r.replaces=x.claim_id
WHERE r.predicate=x.predicate AND r.subject=x.subject AND r.keyid=x.keyid""")
def _(t):
    return V.replaced_by(nodes(t))


@query("claim_view", """
SELECT c.claim_id, c.keyid AS signer, c.subject AS about, c.predicate, CASE WHEN c.predicate<>'signup' THEN 'tpl-'||c.predicate END AS template,
  CASE WHEN c.predicate<>'signup' THEN c.predicate='view' END AS row, p.position, r.claim_id IS NOT NULL AS replaced, c.scope AS graph
FROM trusted_claim c JOIN claim_position p USING (claim_id)
LEFT JOIN (SELECT replaces AS x, claim_id FROM trusted_claim WHERE replaces IS NOT NULL) r ON r.x=c.claim_id""")
def _(t):
    return view(t).select("claim_id", F.col("signers")[0].alias("signer"), F.col("about")[0].alias("about"), "predicate", "template", "row",
                          "position", "replaced", "graph")


def fields(t):
    c = V.trusted_only(t.claim, t.trust_key)
    return c.select("claim_id", "predicate", F.explode(F.create_map(
        F.lit("level"), F.col("level"), F.lit("owner"), F.concat(F.lit("urn:person:"), "person"), F.lit("day"), F.date_format("at", "yyyy-MM-dd"),
        F.lit("amount"), F.floor("value").cast("string"))).alias("key", "value"))


def aliases(t):
    """Aliases: every template but one names the level itself, the repository names level and owner."""
    own = templates(t).filter("predicate <> 'view'").select(F.col("name").alias("owner"), F.lit("level").alias("key"),
                                                            F.concat(F.lit("urn:vocab:"), "predicate", F.lit("/level")).alias("iri"))
    common = t.base("region").filter("r_regionkey = 0").select(F.lit("*").alias("owner"), F.explode(F.array(
        F.struct(F.lit("level").alias("key"), F.lit("urn:vocab:level").alias("iri")),
        F.struct(F.lit("owner").alias("key"), F.lit("urn:vocab:owner").alias("iri")),
        F.struct(F.lit("amount").alias("key"), F.lit("urn:prov:scope").alias("iri")))).alias("a")).select("owner", "a.*")
    return own.unionByName(common)


@query("aliased_fields", """
WITH f AS (SELECT claim_id, predicate, unnest(['level','owner','day','amount']) AS key FROM trusted_claim)
SELECT claim_id, CASE WHEN predicate<>'signup' THEN 'tpl-'||predicate END AS template, key,
  CASE WHEN predicate='signup' OR key IN ('day','amount') THEN 'urn:prov:field:'||key
       WHEN key='owner' THEN 'urn:vocab:owner' WHEN predicate='view' THEN 'urn:vocab:level' ELSE 'urn:vocab:'||predicate||'/level' END AS iri FROM f""")
def _(t):
    return V.aliased(fields(t), templates(t), aliases(t)).drop("value")


@query("typed_fields", """
WITH f AS (SELECT claim_id, predicate, unnest(['level','owner','day','amount']) AS key,
   unnest([level, 'urn:person:'||person, strftime(c.at,'%Y-%m-%d'), CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)]) AS value FROM trusted_claim c)
SELECT claim_id, key, CASE WHEN key='owner' AND predicate<>'signup' THEN 'iri' ELSE 'literal' END AS term_type, value,
  CASE WHEN predicate='signup' THEN NULL WHEN key='day' THEN 'http://www.w3.org/2001/XMLSchema#date'
       WHEN key='amount' THEN 'http://www.w3.org/2001/XMLSchema#integer' END AS datatype FROM f
UNION ALL SELECT claim_id, 'file', CASE WHEN predicate='signup' THEN 'literal' ELSE 'iri' END,
  CASE WHEN predicate='signup' THEN 'sha256:'||upper(sha256(subject)) ELSE 'urn:sha256:'||sha256(subject) END, NULL FROM trusted_claim
UNION ALL SELECT claim_id, 'whom', 'literal', 'urn:person:'||person, NULL FROM trusted_claim
UNION ALL SELECT claim_id, 'grade', CASE WHEN predicate='signup' OR level='L0' THEN 'literal' ELSE 'iri' END,
  CASE WHEN level='L0' THEN 'urn:grade:L0' WHEN predicate='signup' THEN 'g:'||level ELSE 'https://grades.example/'||level END, NULL FROM trusted_claim""")
def _(t):
    named = V.aliased(fields(t), templates(t), aliases(t))
    more = fields(t).filter("key = 'level'").join(t.claim.select("claim_id", "subject", "person", "level"), "claim_id").select("claim_id", "predicate", F.explode(F.create_map(
        F.lit("file"), F.concat(F.lit("sha256:"), F.upper(F.sha2("subject", 256))), F.lit("whom"), F.concat(F.lit("urn:person:"), "person"),
        F.lit("grade"), F.when(F.col("level") == "L0", "urn:grade:L0").otherwise(F.concat(F.lit("g:"), "level")))).alias("key", "value"))
    kinds = {"level": "enum", "owner": "iri", "day": "date", "amount": "integer", "file": "ref", "whom": "ref", "grade": "enum"}
    types = templates(t).select(F.col("name").alias("template"), F.explode(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])).alias("key", "type"))
    prefixes = t.base("region").filter("r_regionkey = 0").select(F.lit("g").alias("prefix"), F.lit("https://grades.example/").alias("iri"))
    return V.typed_fields(named.unionByName(V.aliased(more, templates(t), aliases(t))), types, prefixes)


@query("nested_fields", """
SELECT claim_id, '' AS path, 'by' AS key, person AS value FROM claim UNION ALL SELECT claim_id, '', 'ref', subject FROM claim
UNION ALL SELECT claim_id, 'qualification/', 'level', level FROM claim UNION ALL SELECT claim_id, 'qualification/role/', 'name', predicate FROM claim
UNION ALL SELECT claim_id, 'seen['||i||']/', 'at', r FROM (SELECT claim_id, unnest(registries) AS r, unnest(range(len(registries))) AS i FROM claim)
UNION ALL SELECT claim_id, '', 'tags', unnest([predicate, level]) FROM claim
UNION ALL SELECT claim_id, repeat('d/', 20), 'leaf', keyid FROM claim""")
def _(t):
    deep = F.struct(F.col("keyid").alias("leaf"))
    for _ in range(20):
        deep = F.struct(deep.alias("d"))
    obj = F.to_json(F.struct(F.col("person").alias("by"), F.struct(F.col("subject").alias("hash")).alias("ref"),
                             F.struct("level", F.struct(F.col("predicate").alias("name")).alias("role")).alias("qualification"),
                             F.transform("registries", lambda r: F.struct(r.alias("at"))).alias("seen"), F.array("predicate", "level").alias("tags"), deep["d"].alias("d")))
    return V.nested_fields(t.claim.select("claim_id", obj.alias("object")))


@query("signer_labels", "SELECT DISTINCT keyid, name, tier FROM trusted_claim")
def _(t):
    return V.signer_labels(nodes(t), t.trust_key)


LABELS = """lab AS (SELECT claim_id AS graph, 'day '||strftime(c.at,'%Y-%m-%d') AS label FROM claim c WHERE genesis)"""


def labels(t):
    return t.claim.filter("genesis").select(F.col("claim_id").alias("graph"), F.concat(F.lit("day "), F.date_format("at", "yyyy-MM-dd")).alias("label"))


@query("scope_graphs", f"""WITH {LABELS},
s AS (SELECT scope AS graph, string_agg(DISTINCT r, ',' ORDER BY r) AS sources FROM (SELECT scope, unnest(registries) AS r FROM trusted_claim) GROUP BY scope)
SELECT c.scope AS graph, count(*)-count(*) FILTER (genesis) AS claims, s.sources, lab.label, false AS unscoped
FROM trusted_claim c JOIN s ON s.graph=c.scope LEFT JOIN lab ON lab.graph=c.scope GROUP BY ALL""")
def _(t):
    n = nodes(t).select("claim_id", "genesis", V.graph_of().alias("graph"))
    return V.scope_graphs(n, t.claim.select("claim_id", F.col("registries").alias("sources")), labels(t)).withColumn(
        "sources", F.array_join("sources", ","))


@query("repeated_labels", f"WITH {LABELS} SELECT label, count(*) AS graphs FROM lab GROUP BY label HAVING count(*)>1")
def _(t):
    return V.repeated_labels(labels(t))


@query("dataset_of_registries", """
WITH held AS (SELECT record_id, unnest(registries) AS registry FROM work),
att AS (SELECT s.record_id, CASE WHEN pos=0 THEN 'own' ELSE 'partner' END AS registry, s.keyid FROM signature s JOIN trust_key USING (keyid))
SELECT w.record_id, coalesce((SELECT string_agg(DISTINCT a.keyid, ',' ORDER BY a.keyid) FROM att a JOIN held h USING (record_id, registry)
  WHERE a.record_id=w.record_id),'') AS keyids FROM work w""")
def _(t):
    holds = t.work.select("record_id", F.explode("registries").alias("registry"))
    attests = t.signature.select("record_id", "keyid", F.when(F.col("pos") == 0, "own").otherwise("partner").alias("registry"))
    return V.dataset(holds, attests, t.trust_key).withColumn("keyids", F.array_join("keyids", ","))


@query("derived_from", """
SELECT DISTINCT o.hash, i.hash AS source FROM work_file o JOIN work_file i USING (record_id)
WHERE o.role='out' AND i.role='in'""")
def _(t):
    return V.derived_from(t.work_file, t.work_file.filter("role = 'out'").select("hash"))
