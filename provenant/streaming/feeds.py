"""Feeds of records: pages after a cursor, change events, and the view kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.unions import after_cursor


def feed(held: DataFrame, cursor: DataFrame, trusted: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, bool]:
    """A page of records behind the cursor in registry order, the cursor after it, and whether more follow.

    Trusted records are shown with their signers, untrusted ones are numbers per registry in the cursor row.
    ``held`` has (registry, registry_ord, layer, epoch, seq, record_id), ``trusted`` (record_id, signers).
    """
    new = after_cursor(held, cursor)
    order = ["registry_ord", "layer", "epoch", "seq"]
    page = new.orderBy(*order).limit(limit + 1)
    more = page.count() > limit
    page = page.orderBy(*order).limit(limit).join(trusted, "record_id", "left")
    after = page.groupBy("registry", "layer").agg(F.max(F.struct("epoch", "seq")).alias("m"), F.count_if(F.col("signers").isNull()).alias("untrusted")).select(
        "registry", "layer", "m.epoch", "m.seq", "untrusted")
    kept = cursor.select("registry", "layer", "epoch", "seq").join(after.select("registry", "layer"), ["registry", "layer"], "left_anti").withColumn("untrusted", F.lit(0).cast("bigint"))
    return page.filter("signers IS NOT NULL"), after.unionByName(kept), more


def present(held: DataFrame) -> DataFrame:
    """Where a reader that starts now begins: the last position of every registry and layer, in its latest epoch."""
    top = F.max(F.struct("epoch", "seq")).alias("m")
    return held.groupBy("registry", "layer").agg(top).select("registry", "layer", "m.epoch", "m.seq")


def events(new: DataFrame) -> DataFrame:
    """What happened in a round: own works published, claims said, and per source how many records were pulled."""
    published = new.filter("registry = 'own' AND layer = 'work'").select(F.lit("published").alias("event"), "record_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("records"))
    said = new.filter("registry = 'own' AND layer = 'claim'").select(F.lit("said").alias("event"), "record_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("records"))
    pulled = new.filter("registry <> 'own'").groupBy("registry").agg(F.count(F.lit(1)).alias("records")).select(
        F.lit("pulled").alias("event"), F.lit(None).cast("string").alias("record_id"), F.col("registry").alias("source"), "records")
    return published.unionByName(said).unionByName(pulled)


def view_changes(new: DataFrame) -> DataFrame:
    """What a refreshed view owes its readers: scopes that changed, or everything when a work record, a source or
    an unscoped claim came. One row per scope; the null scope stands for everything."""
    all_ = (F.col("layer") == "work") | (F.col("registry") != "own") | F.col("scope").isNull()
    return new.select(F.when(~all_, F.col("scope")).alias("scope")).distinct()


def watch(records: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Stream records to a table of change events; the checkpoint is the cursor, so each comes once.

    Every batch is written under its number and replaces what an earlier try of it wrote.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        events(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        view_changes(batch).write.mode("overwrite").parquet(f"{path}/moved/batch={number}")
        batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(held: DataFrame, seen_within: str) -> DataFrame:
    """Each (registry, epoch, seq) once, also when a file is read again."""
    return held.withWatermark("arrived", seen_within).dropDuplicatesWithinWatermark(["registry", "layer", "epoch", "seq"])


def session_spans(trace: DataFrame, idle: str, late: str = "2 seconds") -> DataFrame:
    """Sessions by idle time as a window over the event time: first and last line and their number."""
    t = trace.withColumn("at", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)))
    return t.withWatermark("at", late).groupBy("session", F.session_window("at", idle)).agg(F.count(F.lit(1)).alias("lines"), F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"))
