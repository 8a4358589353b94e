"""Stores: manifests of files, snapshots, versioned views, sessions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.operators.trust import key_names


def read_manifest(spark: SparkSession, paths) -> DataFrame:
    """Files as they are: path, hash, size and time; bytes are hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return f.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("sha"), F.col("length").alias("size"),
                    (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def intact(store: DataFrame) -> DataFrame:
    """Kept files that still hash to their name; the others count as not kept."""
    return store.filter(F.element_at(F.split("path", "/"), -1) == F.col("sha"))


def pending(ops: DataFrame, call_files: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct versions seen in closed tasks' operations and calls that are not kept yet."""
    seen = ops.filter("sha IS NOT NULL AND sha <> ''").select("sha", "path").unionByName(call_files.filter("sha <> ''").select("sha", "path"))
    return seen.groupBy("sha").agg(F.min("path").alias("path")).join(kept.select("sha"), "sha", "left_anti")


def write_snapshot(records: DataFrame, trust: DataFrame, path: str) -> None:
    """A union's records, the trusted keys and their names as three tables."""
    records.write.mode("overwrite").json(f"{path}/union")
    trust.write.mode("overwrite").json(f"{path}/keys")
    key_names(trust).write.mode("overwrite").json(f"{path}/names")


class VersionedTable:
    """A table whose readers see the old or the new version whole: a version is written, then a pointer row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._pointers = f"{path}/pointers"

    def _current(self):
        try:
            rows = self.spark.read.schema("version BIGINT, stamp STRING, written TIMESTAMP").json(self._pointers)
            return rows.orderBy(F.desc("version")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def refresh(self, build, stamp: str) -> bool:
        """Write a new version unless the stamp is the kept one; says whether it did."""
        now = self._current()
        if now is not None and now["stamp"] == stamp:
            return False
        version = 0 if now is None else now["version"] + 1
        build().write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(stamp).alias("stamp"), F.current_timestamp().alias("written")).coalesce(1).write.mode("append").json(self._pointers)
        return True

    def read(self) -> DataFrame:
        now = self._current()
        if now is None:
            raise ValueError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/v{now['version']}")


_OUTPUT = T.StructType([T.StructField("path", T.StringType()), T.StructField("recorded", T.StringType()), T.StructField("reproduced", T.StringType()), T.StructField("same", T.BooleanType())])
REPORT = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("target", T.StringType()), T.StructField("recorded", T.StringType()), T.StructField("reproduced", T.StringType()),
    T.StructField("same", T.BooleanType()), T.StructField("when", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("notes", T.ArrayType(T.StringType())),
    T.StructField("steps", T.ArrayType(T.StructType([T.StructField("session", T.StringType()), T.StructField("task", T.StringType()), T.StructField("outputs", T.ArrayType(_OUTPUT))])))])


def read_reproductions(spark: SparkSession, pattern: str, project: str, target: str | None = None) -> DataFrame:
    """Reproduction reports of a project; ``same`` is taken from the hashes, never from the report. Order by when, descending."""
    r = spark.read.schema(REPORT).option("multiLine", True).json(pattern).filter(F.col("project") == project)
    if target is not None:
        r = r.filter(F.col("target") == target)
    equal = lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False))
    outs = lambda s: F.transform(s.outputs, lambda o: o.withField("same", equal(o.recorded, o.reproduced)))
    return r.withColumn("same", equal(F.col("recorded"), F.col("reproduced"))).withColumn("steps", F.transform("steps", lambda s: s.withField("outputs", outs(s))))


def report_rows(reports: DataFrame) -> DataFrame:
    return reports.select("target", "when", F.explode("steps").alias("s")).select("target", "when", F.concat_ws("/", "s.session", "s.task").alias("step"), F.explode("s.outputs").alias("o")).select(
        "target", "when", "step", "o.*")


def stored_sessions(closed: DataFrame, logs: DataFrame, kept: DataFrame, oldest) -> DataFrame:
    """Closed sessions whose log is gone, not too old unless kept."""
    gone = closed.join(logs.select("session"), "session", "left_anti")
    known = kept.select("session").distinct().withColumn("__k", F.lit(True))
    return gone.join(known, "session", "left").filter((F.col("last") >= F.lit(oldest)) | F.col("__k")).drop("__k")


def write_graph(nodes: DataFrame, edges: DataFrame, summary: DataFrame, path: str) -> None:
    """An observation graph as three JSON tables."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    summary.write.mode("overwrite").json(f"{path}/participants")
