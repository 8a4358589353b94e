"""Several registries read as one: union by id, precedence, and what changed since a position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.terms import hash_sum


def as_union(inputs: dict[str, DataFrame]) -> DataFrame:
    """Rows of every registry with its name and place in the order; own first."""
    parts = [df.withColumn("registry", F.lit(name)).withColumn("registry_ord", F.lit(i)) for i, (name, df) in enumerate(inputs.items())]
    if not parts:
        raise ValueError("no registry to read")
    return reduce(DataFrame.unionByName, parts)


def federated(held: DataFrame, content: list[str]) -> DataFrame:
    """Set union by id: each record once with the content of its first holder and every signature of any.

    ``held`` has (record_id, registry_ord, keyid, content…), a row per registry, record and signature.
    """
    return held.groupBy("record_id").agg(
        F.min_by(F.struct(*content), "registry_ord").alias("c"),
        F.array_sort(F.collect_set("keyid")).alias("keyids"),
    ).select("record_id", "c.*", "keyids")


def sources_of(held: DataFrame) -> DataFrame:
    """The registries that hold each record, in join order (there are few registries)."""
    return held.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("registry_ord", "registry"))).alias("s")).select(
        "record_id", F.col("s.registry").alias("sources"))


def material_union(material: DataFrame) -> DataFrame:
    return material.drop("registry", "registry_ord").distinct()


def by_id(work: DataFrame, claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of either layer by id; a work record wins over a claim of the same id."""
    both = work.select("record_id", F.lit(0).alias("__l"), F.lit("work").alias("layer")).unionByName(
        claims.select("record_id", F.lit(1).alias("__l"), F.lit("claim").alias("layer")))
    return both.join(ids, "record_id", "left_semi").groupBy("record_id").agg(F.min_by("layer", "__l").alias("layer"))


def stamp(rows: DataFrame, keys: list[str], line) -> DataFrame:
    """A digest of a set of rows that does not depend on their order; equal stamps mean nothing to do.

    Sums each row's hash in pieces, so no group is ever gathered in one place.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hash_sum(F.sha2(line, 256)).alias("stamp"))


def moved(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose stamp differs from the one kept, or had none."""
    return now.join(before.select(*keys, "stamp"), [*keys, "stamp"], "left_anti").select(*keys)


def template_precedence(templates: DataFrame) -> DataFrame:
    """One template per predicate: lowest source rank, then name; the rest are clashes.

    A name that is taken by an earlier source is qualified with its source.
    """
    at = F.struct("source_rank", "name", "source")
    winner = templates.groupBy("predicate").agg(F.min(at).alias("__w"))
    first = templates.groupBy("name").agg(F.min(F.struct("source_rank", "source")).alias("__f"))
    return templates.join(winner, "predicate").join(first, "name").select(
        "predicate", "source", "source_rank", "name",
        (at == F.col("__w")).alias("kept"),
        F.when(F.struct("source_rank", "source") == F.col("__f"), F.col("name"))
        .otherwise(F.concat("source", F.lit("/"), "name")).alias("known_as"))


def row_templates(templates: DataFrame) -> DataFrame:
    return templates.filter("is_rows").select("name")


def latest_installations(installs: DataFrame) -> DataFrame:
    """Installations that no other one of the same package follows."""
    followed = installs.filter("follows IS NOT NULL").select("package", F.col("follows").alias("revision"))
    return installs.join(followed, ["package", "revision"], "left_anti")


def after_cursor(held: DataFrame, cursor: DataFrame) -> DataFrame:
    """Rows behind the kept position of their registry and layer; all of them where a later epoch began, none of an earlier one."""
    c = cursor.select("registry", "layer", F.col("epoch").alias("__e"), F.col("seq").alias("__s"))
    new = F.col("__e").isNull() | (F.col("epoch") > F.col("__e")) | ((F.col("epoch") == F.col("__e")) & (F.col("seq") > F.col("__s")))
    return held.join(c, ["registry", "layer"], "left").filter(new).drop("__e", "__s")


def departed(kept: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """What was kept of a registry and is there no longer."""
    return kept.join(now.select(*keys), keys, "left_anti")
