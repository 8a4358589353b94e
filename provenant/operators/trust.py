"""Trust, applied when a question is asked: tiers and signers of records, and what a filter leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verified(signature: DataFrame, trust: DataFrame) -> DataFrame:
    """Signatures by keys of the trust table: ``(record_id, pos, keyid, tier, name)``.

    ``signature.keyid`` is the key that verified, never the declared one.
    """
    # positions count within a registry, so the registry's own place comes first where there are several
    pos = F.struct("registry_ord", "pos") if "registry_ord" in signature.columns else F.col("pos")
    return (signature.filter(F.col("keyid").isNotNull()).select("record_id", pos.alias("pos"), "keyid")
            .join(trust.select("keyid", "tier", "name"), "keyid"))


def resolved_tier(records: DataFrame, signature: DataFrame, trust: DataFrame) -> DataFrame:
    """Tier and signer of each record: the verifying key at the lowest position; null tier is untrusted."""
    first = verified(signature, trust).groupBy("record_id").agg(
        F.min_by(F.struct("keyid", "tier", "name"), "pos").alias("s"))
    return records.join(first, "record_id", "left").select(*records.columns, "s.keyid", "s.tier", "s.name")


def signers_of(signature: DataFrame, trust: DataFrame) -> DataFrame:
    """Every trusted signer of a record once, in signature order (an envelope holds few signatures)."""
    each = verified(signature, trust).groupBy("record_id", "keyid").agg(
        F.min("pos").alias("pos"), F.first("tier").alias("tier"), F.first("name").alias("name"))
    return each.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "keyid", "tier", "name"))).alias("signers"))


def tiers_of(signature: DataFrame, trust: DataFrame) -> DataFrame:
    """Distinct tiers of the verifying keys, sorted."""
    return verified(signature, trust).groupBy("record_id").agg(F.array_sort(F.collect_set("tier")).alias("tiers"))


def key_names(trust: DataFrame) -> DataFrame:
    return trust.select("keyid", F.concat("name", F.lit(" ("), "tier", F.lit(")")).alias("label"))


def tier_keys(trust: DataFrame, tier: str | None = None) -> DataFrame:
    return trust if tier is None else trust.filter(F.col("tier") == tier)


def check_filter(trust: DataFrame, *, tier=None, level=None, signer=None, min_reproductions=0) -> None:
    """Refuse a filter that could never match, instead of answering with nothing."""
    if level is not None and level not in ("L0", "L1", "L2"):
        raise ValueError(f"unknown level {level}")
    if min_reproductions < 0:
        raise ValueError("the least number of reproductions is negative")
    if tier is not None and trust.filter(F.col("tier") == tier).isEmpty():
        raise ValueError(f"no key has the tier {tier}")
    if signer is not None and trust.filter(F.col("keyid") == signer).isEmpty():
        raise ValueError(f"unknown signer {signer}")


def check_trust(trust: DataFrame) -> None:
    """A key that cannot be read fails the question; it is not skipped."""
    if not trust.filter(F.col("keyid").isNull() | F.col("tier").isNull()).isEmpty():
        raise ValueError("a configured key cannot be read")


def claim_keeps(*, tier=None, scope=None, level=None, signer=None) -> Column:
    """The claim filter; every part only narrows."""
    keep = F.lit(True)
    if tier is not None:
        keep = keep & (F.col("tier") == tier)
    if scope is not None:
        keep = keep & (F.col("scope") == scope)
    if level is not None:
        keep = keep & (F.col("level") == level)
    if signer is not None:
        keep = keep & (F.col("keyid") == signer)
    return F.coalesce(keep, F.lit(False))


def work_keeps(*, tier=None, signer=None, level=None, scope=None) -> tuple[Column, list[str]]:
    """The record filter, and the parts of it that say nothing about work records (level, scope)."""
    idle = [n for n, v in (("level", level), ("scope", scope)) if v is not None]
    return claim_keeps(tier=tier, signer=signer), idle


def split(resolved: DataFrame, keep: Column, content: list[str]) -> DataFrame:
    """Included rows with content, the rest by id alone: content of an excluded record is null."""
    included = F.coalesce(F.col("tier").isNotNull() & keep, F.lit(False))
    marked = resolved.withColumn("included", included)
    shown = [F.when(F.col("included"), F.col(c)).alias(c) for c in content]
    return marked.select("record_id", "included", *shown)


def at_least(answer: DataFrame, count: str, n: int) -> DataFrame:
    """Empty an answer below the threshold but say why."""
    met = F.col(count) >= n
    return answer.select(
        "*", met.alias("met"),
        F.when(~met, F.concat(F.col(count).cast("string"), F.lit(f" of {n} required reproductions"))).alias("reason"))


def approval_counts(approvals: DataFrame, trust: DataFrame, person_key: str, person_tiers: list[str]) -> DataFrame:
    """Whether an approval counts: approved, and by the person's key or a key of a person tier; else why not."""
    tiers = trust.select("keyid", "tier")
    approved = F.col("outcome") == "approved"
    person = (F.col("keyid") == person_key) | F.coalesce(F.col("tier").isin(person_tiers), F.lit(False))
    return approvals.join(tiers, "keyid", "left").select(
        *approvals.columns, (approved & person).alias("counts"),
        F.when(~approved, "not approved").when(~person, "not signed by a person").alias("reason"))
