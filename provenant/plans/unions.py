"""Queries over several registries."""

from pyspark.sql import functions as F

from provenant.operators import unions as U
from provenant.operators.ordered import previous
from provenant.plans.registry import hash_sum_sql, query


def held_claims(t):
    reg = F.explode("registries").alias("registry")
    c = t.claim.select("*", reg)
    return c.withColumn("registry_ord", F.when(F.col("registry") == "own", 0).otherwise(1)).withColumn("record_id", F.col("claim_id"))


HELD = """held AS (SELECT *, unnest(registries) AS registry FROM claim)"""


@query("federated_union", """
SELECT claim_id AS record_id, subject, predicate, keyid AS keyids FROM claim""")
def _(t):
    own = t.claim.filter(F.array_contains("registries", "own"))
    partner = t.claim.filter(F.array_contains("registries", "partner"))
    held = U.as_union({"own": own, "partner": partner}).withColumn("record_id", F.col("claim_id"))
    return U.federated(held, ["subject", "predicate"]).withColumn("keyids", F.array_join("keyids", ","))


@query("claim_sources", f"""WITH {HELD}
SELECT claim_id AS record_id, string_agg(registry, ',' ORDER BY registry) AS sources FROM held GROUP BY claim_id""")
def _(t):
    return U.sources_of(held_claims(t)).withColumn("sources", F.array_join("sources", ","))


@query("material_of_union", """
SELECT DISTINCT f.record_id, f.path, f.hash FROM work_file f JOIN (SELECT record_id, unnest(registries) AS r FROM work) USING (record_id)""")
def _(t):
    held = t.work.select("record_id", F.explode("registries").alias("registry"))
    return U.material_union(t.work_file.select("record_id", "path", "hash").join(held, "record_id"))


@query("record_of_either_layer", """
SELECT 'x'||k AS record_id, CASE WHEN o_orderkey IS NOT NULL THEN 'work' ELSE 'claim' END AS layer FROM
 (SELECT event_id AS k FROM events UNION SELECT o_orderkey FROM orders) LEFT JOIN orders ON o_orderkey=k""")
def _(t):
    w = t.work.select(F.concat(F.lit("x"), "seq").alias("record_id"))
    c = t.claim.select(F.concat(F.lit("x"), "seq").alias("record_id"))
    return U.by_id(w, c, w.union(c))


@query("registry_stamp", f"""WITH {HELD}
SELECT registry, count(*) AS n, {hash_sum_sql("sha256(claim_id)")} AS stamp
FROM held GROUP BY registry""")
def _(t):
    return U.stamp(held_claims(t), ["registry"], F.col("claim_id"))


@query("moved_registries", "SELECT DISTINCT unnest(registries) AS registry FROM claim WHERE predicate='signup'")
def _(t):
    now = U.stamp(held_claims(t), ["registry"], F.col("claim_id"))
    before = U.stamp(held_claims(t).filter("predicate <> 'signup'"), ["registry"], F.col("claim_id"))
    return U.moved(now, before, ["registry"])


TEMPLATES = """tpl AS (SELECT DISTINCT p_name AS predicate, p_type AS source, p_size AS source_rank, p_brand AS name FROM part)"""


def templates(t):
    return t.base("part").select(F.col("p_name").alias("predicate"), F.col("p_type").alias("source"),
                                 F.col("p_size").alias("source_rank"), F.col("p_brand").alias("name")).distinct()


@query("template_precedence", f"""WITH {TEMPLATES}
SELECT predicate, source, source_rank, name,
  row_number() OVER (PARTITION BY predicate ORDER BY source_rank, name, source)=1 AS kept,
  CASE WHEN dense_rank() OVER (PARTITION BY name ORDER BY source_rank, source)=1 THEN name ELSE source||'/'||name END AS known_as FROM tpl""")
def _(t):
    return U.template_precedence(templates(t))


@query("row_templates", """SELECT DISTINCT p_brand AS name FROM part WHERE p_type='SMALL'""")
def _(t):
    return U.row_templates(templates(t).withColumn("is_rows", F.col("source") == "SMALL")).distinct()


@query("latest_installations", """SELECT o_custkey AS package, o_orderkey AS revision FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r=1""")
def _(t):
    o = t.base("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    chained = previous(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "follows", F.col("o_orderkey"))
    return U.latest_installations(chained.select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("revision"),
                                                 "follows")).select("package", "revision")


CURSOR = """cur AS (SELECT registry, CASE WHEN registry='own' THEN max(seq)//2 ELSE max(seq)//3 END AS cseq FROM held GROUP BY registry)"""


def cursor(t):
    """A reader's position: half of the own registry, a third of the partner's."""
    at = F.when(F.col("registry") == "own", F.expr("max(seq) div 2")).otherwise(F.expr("max(seq) div 3"))
    return held_claims(t).groupBy("registry").agg(at.alias("seq")).select(
        "registry", F.lit("claim").alias("layer"), F.lit(1).alias("epoch"), "seq")


@query("records_after_cursor", f"""WITH {HELD}, {CURSOR}
SELECT registry, claim_id FROM held JOIN cur USING (registry) WHERE seq>cseq""")
def _(t):
    held = held_claims(t).withColumn("layer", F.lit("claim")).withColumn("epoch", F.lit(1))
    return U.after_cursor(held, cursor(t)).select("registry", "claim_id")


@query("records_after_epoch_change", f"""WITH {HELD}, {CURSOR}
SELECT registry, claim_id FROM held JOIN cur USING (registry) WHERE registry='partner' OR seq>cseq""")
def _(t):
    held = held_claims(t).withColumn("layer", F.lit("claim")).withColumn(
        "epoch", F.when(F.col("registry") == "partner", 2).otherwise(1))
    return U.after_cursor(held, cursor(t)).select("registry", "claim_id")


@query("departed_records", f"""WITH {HELD} SELECT registry, claim_id FROM held WHERE level='L2'""")
def _(t):
    kept = held_claims(t).select("registry", "claim_id")
    now = held_claims(t).filter("level <> 'L2'").select("registry", "claim_id")
    return U.departed(kept, now, ["registry", "claim_id"])
