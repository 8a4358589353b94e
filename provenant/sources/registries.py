"""Registries of signed records: JSON lines with envelopes, decoded to records, signatures and claims."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.sources.tracelog import numbered_lines

ENVELOPE = T.StructType([
    T.StructField("payload", T.StringType()), T.StructField("payloadType", T.StringType()),
    T.StructField("signatures", T.ArrayType(T.StructType([T.StructField("keyid", T.StringType()), T.StructField("sig", T.StringType())])))])
LINE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("claimId", T.StringType()),
                     T.StructField("recordId", T.StringType()), T.StructField("envelope", ENVELOPE)])
_NAMED = T.StructType([T.StructField("hash", T.StringType()), T.StructField("uri", T.StringType())])
STATEMENT = T.StructType([
    T.StructField("subject", T.ArrayType(T.StructType([T.StructField("digest", T.StructType([T.StructField("sha256", T.StringType())])), T.StructField("uri", T.StringType())]))),
    T.StructField("predicateType", T.StringType()),
    T.StructField("predicate", T.StructType([
        T.StructField("predicate", _NAMED), T.StructField("object", T.VariantType()), T.StructField("context", T.StringType()), T.StructField("by", T.StringType()),
        T.StructField("when", T.StringType()), T.StructField("why", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("prev", T.StringType()),
        T.StructField("genesis", T.BooleanType()), T.StructField("parent", _NAMED), T.StructField("responsible", T.ArrayType(T.StringType())), T.StructField("name", T.StringType())]))])


def _id():
    return F.coalesce("recordId", "claimId", "id")


def read_records(spark: SparkSession, works: str, claims: str, registry: str = "own", order: int = 0) -> DataFrame:
    """Work records, then claims, of one registry. A line that does not parse or has no envelope fails the read."""

    def layer(path: str, name: str) -> DataFrame:
        df = spark.read.schema(LINE).option("mode", "FAILFAST").json(path)
        ok = F.assert_true(F.col("envelope").isNotNull() & _id().isNotNull(), F.concat(F.lit(f"{name} without envelope in {registry}: "), F.coalesce(_id(), F.lit("?"))))
        return df.select(F.lit(registry).alias("registry"), F.lit(order).alias("registry_ord"), F.lit(name).alias("layer"), "seq", _id().alias("record_id"),
                         "envelope", ok.alias("__ok")).filter("__ok IS NULL").drop("__ok")

    return layer(works, "work").unionByName(layer(claims, "claim"))


def federation(spark: SparkSession, own: tuple[str, str], sources: dict[str, tuple[str, str] | None]) -> DataFrame:
    """The own registry first, then each source's; a source that names none is refused."""
    parts = [read_records(spark, *own)]
    for i, (name, paths) in enumerate(sources.items(), 1):
        if not paths:
            raise ValueError(f"source {name} has no registry")
        parts.append(read_records(spark, *paths, registry=name, order=i))
    return reduce(DataFrame.unionByName, parts)


SOURCE_KINDS = {"directory": lambda spec: (str(PurePosixPath(spec) / "works.jsonl"), str(PurePosixPath(spec) / "claims.jsonl"))}


def register_kind(name: str, places) -> None:
    """A source kind maps a specification to the files of a registry."""
    SOURCE_KINDS[name] = places


def places(kind: str, spec: str) -> tuple[str, str]:
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown kind of source {kind}")
    return SOURCE_KINDS[kind](spec)


def signatures(records: DataFrame) -> DataFrame:
    """Declared signatures in order; which key verifies is joined from the verdicts."""
    return records.select("record_id", "registry", F.posexplode("envelope.signatures").alias("pos", "s")).select(
        "record_id", "registry", F.col("pos").cast("bigint").alias("pos"), F.col("s.keyid").alias("declared"))


def claims(records: DataFrame) -> DataFrame:
    """Claims decoded; a payload that cannot be read fails the read. Every subject is kept, ``subject`` is the first."""
    text = F.decode(F.unbase64("envelope.payload"), "UTF-8")
    st = F.from_json(text, STATEMENT, {"mode": "FAILFAST"})
    named = F.coalesce(F.concat(F.lit("sha256:"), "st.predicate.predicate.hash"), "st.predicate.predicate.uri")
    subject = F.transform("st.subject", lambda s: F.coalesce(F.concat(F.lit("sha256:"), s.digest.sha256), s.uri))
    p = "st.predicate"
    return records.filter("layer = 'claim'").withColumn("st", st).select(
        F.col("record_id").alias("claim_id"), "registry", "registry_ord", "seq", subject.alias("subjects"), F.get(subject, 0).alias("subject"), named.alias("predicate"),
        F.col("st.predicateType").alias("predicate_type"), F.col(f"{p}.object").alias("object"), F.col(f"{p}.by").alias("declared_by"),
        F.try_to_timestamp(f"{p}.when").alias("at"), F.col(f"{p}.why").alias("why"), F.col(f"{p}.context").alias("context"), F.col(f"{p}.scope").alias("scope"),
        F.col(f"{p}.prev").alias("prev"), F.coalesce(F.col(f"{p}.genesis"), F.lit(False)).alias("genesis"), F.col(f"{p}.name").alias("name"),
        F.coalesce(F.concat(F.lit("sha256:"), f"{p}.parent.hash"), f"{p}.parent.uri").alias("parent"), F.col(f"{p}.responsible").alias("responsible"))


def read_scope_file(spark: SparkSession, path: str) -> DataFrame:
    """A received scope file, read tolerantly: torn lines and lines without an id are skipped, the order is kept."""
    lines = numbered_lines(spark, path)
    row = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    return lines.withColumn("r", row).select("ord", "r.*").withColumn("record_id", _id()).filter("record_id IS NOT NULL AND envelope IS NOT NULL").select(
        F.lit("received").alias("registry"), F.lit(0).alias("registry_ord"), F.lit("claim").alias("layer"), F.col("ord").alias("seq"), "record_id", "envelope")


BATCH_LINE = T.StructType([T.StructField("subject", T.StringType()), T.StructField("template", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
                           T.StructField("scope", T.StringType()), T.StructField("expectHead", T.StringType()), T.StructField("as", T.StringType())])


def read_batch(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """A batch of claims in order; more than ``most`` or an unreadable line refuse all of it."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    n = lines.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} claims in one batch")
    row = F.from_json("value", BATCH_LINE, {"mode": "FAILFAST"})
    return lines.select("ord", row.alias("r")).select("ord", "r.*")


def batch_errors(batch: DataFrame, templates: DataFrame) -> DataFrame:
    """What is wrong with each claim of a batch, before any is written; ``templates`` has (name, required)."""
    known = batch.join(templates.select(F.col("name").alias("template"), "required"), "template", "left")
    missing = F.array_except("required", F.coalesce(F.map_keys("fields"), F.expr("CAST(array() AS ARRAY<STRING>)")))
    why = (F.when(F.coalesce("subject", F.lit("")) == "", "no subject").when(F.col("required").isNull(), "unknown template")
           .when(F.size(missing) > 0, F.concat(F.lit("missing fields "), F.array_join(missing, ", "))))
    return known.select("ord", why.alias("error")).filter("error IS NOT NULL")
