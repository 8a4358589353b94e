"""Queries over chains of claims."""

from pyspark.sql import functions as F

from provenant.operators import scopes as S
from provenant.plans.registry import query

# The turns a reader holds: those a person or the assistant wrote.
HELD = "SELECT * FROM turn_claim WHERE keyid<>'system'"


def held_turns(t):
    return t.turn.filter("keyid <> 'system'")


def roles(t):
    """Trust table of the turns: the assistant's key and the user's."""
    return t.turn.filter("keyid <> 'system'").select("keyid").distinct().withColumn("tier", F.concat(F.lit("tier-"), "keyid"))


PLACED = f"""h AS ({HELD}),
walk AS (SELECT claim_id, scope, CAST(0 AS BIGINT) AS position FROM h WHERE genesis
  UNION ALL SELECT h.claim_id, h.scope, w.position+1 FROM walk w JOIN h ON h.prev=w.claim_id),
placed AS (SELECT h.*, w.position, EXISTS (SELECT 1 FROM h f WHERE f.prev=h.claim_id AND f.scope=h.scope) AS followed
  FROM h LEFT JOIN walk w USING (claim_id))"""


@query("chain_positions", "SELECT claim_id, position FROM claim_position")
def _(t):
    return S.positions(t.claim)


@query("turn_positions", f"WITH RECURSIVE {PLACED} SELECT claim_id, position FROM placed")
def _(t):
    return S.positions(held_turns(t))


@query("scope_heads", "SELECT scope, arg_max(claim_id, (claim.at, seq)) AS claim_id, count(*)-1 AS position FROM claim GROUP BY scope")
def _(t):
    return S.heads(t.claim)


@query("scope_head_counts", f"""WITH RECURSIVE {PLACED}
SELECT scope, count(*) FILTER (position IS NOT NULL AND NOT followed) AS heads, count(*) FILTER (position>0) AS length,
  count(*) FILTER (position IS NULL) AS unresolved, max(position) AS last,
  count(*) FILTER (position IS NOT NULL AND NOT followed)>1 AS branched FROM placed GROUP BY scope""")
def _(t):
    return S.head_counts(held_turns(t))


@query("branched_scopes", """
WITH b AS (SELECT *, 'c:'||source AS scope, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT b.doc_id, b.scope, b.r, min(b2.doc_id) AS first FROM b JOIN b b2 ON b.scope=b2.scope AND b2.r=1 GROUP BY ALL)
SELECT scope, greatest(count(*)-1,1) AS heads, count(*)>2 AS branched FROM p GROUP BY scope""")
def _(t):
    """Every document of a source follows the source's first one: one scope per source, all branches."""
    d = t.base("documents").select("doc_id", "source")
    first = d.groupBy("source").agg(F.min("doc_id").alias("first"))
    claims = d.join(first, "source").select(
        F.col("doc_id").cast("string").alias("claim_id"), F.concat(F.lit("c:"), "source").alias("scope"),
        F.when(F.col("doc_id") != F.col("first"), F.col("first").cast("string")).alias("prev"),
        (F.col("doc_id") == F.col("first")).alias("genesis"))
    return S.head_counts(claims).select("scope", "heads", "branched")


@query("scope_chain", "SELECT scope, claim_id, row_number() OVER (PARTITION BY scope ORDER BY seq) AS place FROM claim")
def _(t):
    return S.chain(t.claim.select("scope", "claim_id", "seq")).drop("seq")


@query("scope_seeds", "SELECT claim_id, person, keyid, epoch_us(claim.at) AS at_us FROM claim WHERE genesis")
def _(t):
    return S.seeds(t.claim).select("claim_id", "person", "keyid", F.unix_micros("at").alias("at_us"))


@query("seal_verdict", f"""WITH RECURSIVE {PLACED},
n AS (SELECT scope, count(*) FILTER (position IS NOT NULL AND NOT followed) AS heads, count(*) FILTER (position>0) AS length,
  count(*) FILTER (position IS NULL) AS unresolved, max(CASE WHEN genesis THEN keyid END) AS seed FROM placed GROUP BY scope)
SELECT scope, heads, length, unresolved, 'tier-'||seed AS seed_tier, seed IS NOT NULL AND unresolved=0 AND heads<=1 AS complete,
  CASE WHEN seed IS NULL THEN 'no-seed' WHEN unresolved>0 AND heads>1 THEN 'both' WHEN unresolved>0 THEN 'gap'
       WHEN heads>1 THEN 'branch' END AS reason FROM n""")
def _(t):
    return S.seal(held_turns(t), roles(t), [])


@query("seal_verdict_with_details", """
SELECT c.scope, 1 AS heads, count(*)-1 AS length, max(CASE WHEN genesis THEN tier END) AS seed_tier,
  max(CASE WHEN genesis AND tier IS NOT NULL THEN person END) AS person, true AS complete
FROM claim c LEFT JOIN trust_key t USING (keyid) GROUP BY c.scope""")
def _(t):
    return S.seal(t.claim, t.trust_key, ["person"]).select("scope", "heads", "length", "seed_tier", "person", "complete")


@query("scope_writers", """
SELECT scope, CASE WHEN tier IS NULL THEN '(unverified)' ELSE keyid END AS writer, tier, count(*) AS claims
FROM turn_claim LEFT JOIN (SELECT DISTINCT keyid, 'tier-'||keyid AS tier FROM turn_claim WHERE keyid<>'system') USING (keyid)
GROUP BY ALL""")
def _(t):
    return S.writers(t.turn, roles(t))


SCOPE_TREE = """seed AS (SELECT claim_id AS scope, CAST(substr(person,2) AS BIGINT) AS u, tier
  FROM claim LEFT JOIN trust_key USING (keyid) WHERE genesis),
tree AS (SELECT s.scope, p.scope AS parent, s.tier FROM seed s LEFT JOIN seed p ON s.u>0 AND p.u=s.u//2)"""


def scope_tree(t):
    """Scopes as a tree: the scope of user u has that of user u/2 as its parent."""
    seed = S.seeds(t.claim).join(t.trust_key.select("keyid", "tier"), "keyid", "left").select(
        "scope", F.expr("CAST(substring(person, 2) AS BIGINT)").alias("u"), "tier")
    above = seed.select(F.col("scope").alias("parent"), F.col("u").alias("pu"))
    return seed.join(above, (F.col("u") > 0) & (F.expr("u div 2") == F.col("pu")), "left").select("scope", "parent", "tier")


@query("scope_ancestors", f"""WITH RECURSIVE {SCOPE_TREE},
walk AS (SELECT scope, parent AS ancestor, 1 AS depth FROM tree WHERE tier IS NOT NULL AND parent IS NOT NULL
  UNION ALL SELECT w.scope, t.parent, w.depth+1 FROM walk w JOIN tree t ON t.scope=w.ancestor
  WHERE t.tier IS NOT NULL AND t.parent IS NOT NULL AND w.depth<32)
SELECT w.scope, w.ancestor, w.depth, CASE WHEN t.scope IS NULL THEN 'missing' WHEN t.tier IS NULL THEN 'untrusted' ELSE 'ok' END AS state
FROM walk w LEFT JOIN tree t ON t.scope=w.ancestor""")
def _(t):
    tree = scope_tree(t)
    return S.ancestors(tree.select("scope"), tree)


@query("scope_answer", """
SELECT c.scope, c.claim_id, tier IS NOT NULL AS included, CASE WHEN tier IS NOT NULL THEN subject END AS subject
FROM claim c LEFT JOIN trust_key USING (keyid)""")
def _(t):
    return S.scope_answer(t.claim, t.trust_key, ["subject"])


@query("append_points", "SELECT scope, arg_max(claim_id, (claim.at, seq)) AS head, count(*)-1 AS length FROM claim GROUP BY scope")
def _(t):
    return S.append_points(t.claim)


@query("unexpected_heads", """
WITH last AS (SELECT scope, arg_max(claim_id, (claim.at, seq)) AS head FROM claim GROUP BY scope),
expected AS (SELECT scope, arg_max(claim_id, (claim.at, seq)) AS head FROM claim WHERE predicate<>'purchase' GROUP BY scope)
SELECT e.scope, e.head FROM expected e JOIN last l USING (scope) WHERE e.head<>l.head""")
def _(t):
    expected = t.claim.filter("predicate <> 'purchase'").groupBy("scope").agg(
        F.max_by("claim_id", F.struct("at", "seq")).alias("head"))
    return S.unexpected_heads(expected, t.claim)


@query("chained_batch", """
WITH st AS (SELECT * FROM claim WHERE predicate<>'purchase'), ba AS (SELECT * FROM claim WHERE predicate='purchase'),
pts AS (SELECT person, arg_max(claim_id, (st.at, seq)) AS head, count(*) AS n FROM st GROUP BY person)
SELECT b.claim_id, b.person AS scope,
  coalesce(lag(b.claim_id) OVER (PARTITION BY b.person ORDER BY b.seq), p.head) AS prev,
  coalesce(p.n,0)+row_number() OVER (PARTITION BY b.person ORDER BY b.seq) AS length,
  lag(b.claim_id) OVER (PARTITION BY b.keyid, b.predicate, b.subject ORDER BY b.seq) AS replaces
FROM ba b LEFT JOIN pts p USING (person)""")
def _(t):
    """Purchases appended behind what each person had said before."""
    c = t.claim.withColumn("scope", F.col("person"))
    stored = c.filter("predicate <> 'purchase'")
    points = stored.groupBy("scope").agg(F.max_by("claim_id", F.struct("at", "seq")).alias("head"), F.count(F.lit(1)).alias("length"))
    batch = c.filter("predicate = 'purchase'").withColumn("ord", F.col("seq"))
    return S.chain_batch(batch, points, S.newest_unreplaced(stored))


@query("batch_refusal", """
WITH b AS (SELECT *, value>150 AS bad FROM claim)
SELECT scope, claim_id, CASE WHEN bad THEN 'refused' WHEN coalesce(max(CASE WHEN bad THEN 1 ELSE 0 END) OVER
  (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=1 THEN 'behind' ELSE 'whole' END AS state FROM b""")
def _(t):
    return S.batch_states(t.claim.withColumn("ord", F.col("seq")), F.col("value") > 150)


@query("newest_unreplaced", """
SELECT keyid, predicate, subject, arg_max(claim_id, (c.at, claim_id)) AS claim_id FROM claim c
WHERE NOT EXISTS (SELECT 1 FROM claim r WHERE r.replaces=c.claim_id AND r.keyid=c.keyid) GROUP BY ALL""")
def _(t):
    return S.newest_unreplaced(t.claim)


@query("unconfirmed_writes", """
SELECT claim_id, subject FROM claim w WHERE NOT EXISTS (SELECT 1 FROM claim s WHERE s.claim_id=w.claim_id AND s.predicate<>'signup')""")
def _(t):
    return S.unconfirmed(t.claim, t.claim.filter("predicate <> 'signup'"))
