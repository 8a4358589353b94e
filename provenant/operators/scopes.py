"""Chains of claims in a scope: positions, heads, seal verdicts, ancestors, appending in batches.

Claims have ``claim_id, scope, prev, genesis, keyid, seq``; ids are unique and a scope is named by its seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators import graph
from provenant.operators.ordered import Scan, numbered, scan


def positions(claims: DataFrame) -> DataFrame:
    """Steps from the seed ``(claim_id, position)``; null when the chain does not reach one. All claims count,
    trusted or not."""
    nodes = claims.select(F.col("claim_id").alias("id"), "prev", F.col("genesis").alias("is_root"))
    return graph.chase(nodes).select(F.col("id").alias("claim_id"), F.col("dist").alias("position"))


def _placed(claims: DataFrame) -> DataFrame:
    """Claims with position and whether some claim of the same scope names them as prev."""
    named = claims.filter("prev IS NOT NULL").select("scope", F.col("prev").alias("claim_id")).distinct().withColumn(
        "followed", F.lit(True))
    return (claims.join(positions(claims), "claim_id").join(named, ["scope", "claim_id"], "left")
            .withColumn("followed", F.coalesce("followed", F.lit(False))))


def heads(claims: DataFrame) -> DataFrame:
    """Tips of each scope reachable from its seed."""
    return _placed(claims).filter("position IS NOT NULL AND NOT followed").select("scope", "claim_id", "position")


def head_counts(claims: DataFrame) -> DataFrame:
    """Per scope: heads, claims under the seed, whether it branches, and claims that do not reach the seed."""
    at = F.col("position")
    return _placed(claims).groupBy("scope").agg(
        F.count_if(at.isNotNull() & ~F.col("followed")).alias("heads"),
        F.count_if(at > 0).alias("length"),
        F.count_if(at.isNull()).alias("unresolved"),
        F.max("position").alias("last"),
    ).withColumn("branched", F.col("heads") > 1)


def chain(claims: DataFrame) -> DataFrame:
    """Claims of each scope numbered in order of arrival, also those not reachable."""
    return numbered(claims, ["scope"], ["seq"], "place")


def seeds(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("genesis") & (F.col("claim_id") == F.col("scope")))


def seal(claims: DataFrame, trust: DataFrame, details: list[str]) -> DataFrame:
    """Whether each chain is whole, else why not; details of a seed no trusted key signed are withheld."""
    seed = seeds(claims).join(trust.select("keyid", "tier"), "keyid", "left").select(
        "scope", F.col("tier").alias("seed_tier"), F.lit(True).alias("has_seed"),
        *[F.when(F.col("tier").isNotNull(), F.col(c)).alias(c) for c in details])
    gap, branch = F.col("unresolved") > 0, F.col("branched")
    why = (F.when(~F.coalesce("has_seed", F.lit(False)), "no-seed").when(gap & branch, "both").when(gap, "gap")
           .when(branch, "branch"))
    return head_counts(claims).join(seed, "scope", "left").select(
        "scope", "heads", "length", "unresolved", "seed_tier", *details, why.isNull().alias("complete"),
        why.alias("reason"))


def writers(claims: DataFrame, trust: DataFrame) -> DataFrame:
    """Claims per scope and verifying key; the unverified are one row."""
    known = claims.join(trust.select("keyid", "tier"), "keyid", "left")
    key = F.when(F.col("tier").isNotNull(), F.col("keyid")).otherwise("(unverified)")
    return known.groupBy("scope", key.alias("writer"), "tier").agg(F.count(F.lit(1)).alias("claims"))


def ancestors(starts: DataFrame, seed: DataFrame, most: int = 32) -> DataFrame:
    """Parents of each scope, nearest first: ``(scope, ancestor, depth, state)``.

    ``seed`` has (scope, parent, tier). An untrusted seed is reported and not followed, a missing one is
    reported, a repeat ends the walk.
    """
    own = seed.select("scope", "parent", "tier")
    steps = own.filter("tier IS NOT NULL AND parent IS NOT NULL").select(F.col("scope").alias("src"), F.col("parent").alias("dst"))
    found = graph.walk(starts.select(F.col("scope").alias("root"), F.col("scope").alias("node")), steps, max_hops=most)
    known = own.select(F.col("scope").alias("node"), "tier", F.lit(True).alias("held"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("tier").isNull(), "untrusted").otherwise("ok")
    return found.filter("depth > 0").join(known, "node", "left").select(
        F.col("root").alias("scope"), F.col("node").alias("ancestor"), "depth", state.alias("state"))


def scope_answer(claims: DataFrame, trust: DataFrame, content: list[str]) -> DataFrame:
    """Claims of scopes split into included, with content, and excluded, by id alone."""
    known = claims.join(trust.select("keyid", "tier"), "keyid", "left").withColumn("included", F.col("tier").isNotNull())
    return known.select("scope", "claim_id", "included", *[F.when(F.col("included"), F.col(c)).alias(c) for c in content])


def append_points(claims: DataFrame) -> DataFrame:
    """Where the next claim of a scope follows: the smallest head."""
    return heads(claims).groupBy("scope").agg(F.min("claim_id").alias("head"), F.max("position").alias("length"))


def unexpected_heads(expected: DataFrame, claims: DataFrame) -> DataFrame:
    """Expected heads that are heads no longer: the write is refused."""
    return expected.join(heads(claims).select("scope", F.col("claim_id").alias("head")), ["scope", "head"], "left_anti")


def chain_batch(batch: DataFrame, points: DataFrame, stored: DataFrame) -> DataFrame:
    """Chain a batch per scope in its order: prev, length, and the claim each one replaces.

    ``batch`` has (claim_id, scope, ord, keyid, predicate, subject); ``points`` (scope, head, length);
    ``stored`` (keyid, predicate, subject, claim_id): the newest unreplaced claim of each.
    """
    b = scan(batch, ["scope"], ["ord"], [Scan("__n", "sum", F.lit(1).cast("bigint")),
                                         Scan("__before", "last", F.col("claim_id"), False)])
    same = ["keyid", "predicate", "subject"]
    b = scan(b, same, ["ord"], [Scan("__mine", "last", F.col("claim_id"), False)])
    old = stored.select(*same, F.col("claim_id").alias("__old"))
    return b.join(points, "scope", "left").join(old, same, "left").select(
        "claim_id", "scope", F.coalesce("__before", "head").alias("prev"),
        (F.coalesce("length", F.lit(0)) + F.col("__n")).alias("length"),
        F.coalesce("__mine", "__old").alias("replaces"))


def batch_states(batch: DataFrame, refused: Column) -> DataFrame:
    """Per claim: refused, behind (a refused one before it in the scope), or whole."""
    b = scan(batch.withColumn("__bad", refused.cast("int")), ["scope"], ["ord"], [Scan("__any", "max", F.col("__bad"), False)])
    return b.select("scope", "claim_id", F.when(F.col("__bad") == 1, "refused").when(F.col("__any") == 1, "behind")
                    .otherwise("whole").alias("state"))


def newest_unreplaced(claims: DataFrame) -> DataFrame:
    """Newest own claim by (signer, predicate, subject) that none of the signer's claims replaces."""
    replaced = claims.filter("replaces IS NOT NULL").select(F.col("replaces").alias("claim_id"), "keyid").distinct()
    return (claims.join(replaced, ["claim_id", "keyid"], "left_anti").groupBy("keyid", "predicate", "subject")
            .agg(F.max_by("claim_id", F.struct("at", "claim_id")).alias("claim_id")))


def unconfirmed(written: DataFrame, stored: DataFrame) -> DataFrame:
    """Written claims that asking about their subject does not give back; must be empty."""
    return written.select("claim_id", "subject").join(stored.select("claim_id", "subject"), ["claim_id", "subject"], "left_anti")
