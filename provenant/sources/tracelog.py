"""Trace logs, console origins and received scope files, with the place of every line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines as ``(file, ord, value)``; ``ord`` grows with the line's place in its file.

    A text split has the byte it starts at, and its rows come in order. A line's ``ord`` is that byte plus its
    number in the split; a split has no more lines than bytes, so numbers of later splits are larger. One row
    per split is all that is joined back.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    first = raw.groupBy("file", "block").agg(F.min("id").alias("first"))
    return raw.join(first, ["file", "block"]).select("file", (F.col("block") + F.col("id") - F.col("first")).alias("ord"), "value")


def headers(lines: DataFrame) -> DataFrame:
    """Header of each log: version and hashed prefixes. A header line reads ``#<tool>trace v2<TAB>hash=a:b``."""
    head = lines.filter(F.col("value").rlike(r"^#\w*trace "))
    rest = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t")
    prefixes = F.regexp_replace(F.get(F.filter(rest, lambda x: x.startswith("hash=")), 0), "^hash=", "")
    return head.groupBy("file").agg(F.min_by(F.struct(F.regexp_extract("value", r"^#\w*trace (\S+)", 1).alias("version"),
                                                      F.split(prefixes, ":").alias("roots")), "ord").alias("h")).select("file", "h.*")


def parse_lines(lines: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Event lines as typed columns. Comments and lines of fewer than ten fields are dropped; the tenth may hold
    tabs. Logs whose header is not v1 escape path and extra."""
    f = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", 10)
    rows = lines.filter(~F.col("value").startswith("#")).withColumn("f", f).filter(F.size("f") == 10)
    if head is not None:
        rows = rows.join(head.select("file", "version"), "file", "left")
    else:
        rows = rows.withColumn("version", F.lit("v1"))
    escaped = F.coalesce(F.col("version") != "v1", F.lit(False))
    text = lambda c: F.when(escaped, unescape(c)).otherwise(c)
    num = lambda i: F.coalesce(F.get("f", i).try_cast("bigint"), F.lit(0))
    extra = F.when(F.get("f", 9) == "-", "").otherwise(F.get("f", 9))
    return rows.select(
        F.col("file").alias("session"), "ord", num(0).alias("ts_ns"), num(1).alias("pid"), num(2).alias("ppid"), F.get("f", 3).alias("op"), F.get("f", 4).alias("mode"),
        text(F.get("f", 5)).alias("path"), num(6).alias("size"), num(7).alias("mtime_ns"),
        F.coalesce(F.get("f", 8).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("ino"), text(extra).alias("extra"))


def unescape(c):
    r"""``\\``, ``\t``, ``\n`` and ``\r`` undone; an unknown escape keeps both characters."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+|\\)"), 1)
    plain = lambda t: (F.when(t == "\\t", "\t").when(t == "\\n", "\n").when(t == "\\r", "\r").when(t == "\\\\", "\\").otherwise(t))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(tokens, plain), "")).otherwise(c)


def read_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = numbered_lines(spark, paths)
    return parse_lines(lines, headers(lines))


_POSITION = T.StructType([T.StructField("line", T.LongType()), T.StructField("character", T.LongType())])
ORIGIN_LINE = T.StructType([
    T.StructField("ts_ns", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("code", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("ts", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("payload", T.StructType([
        T.StructField("code", T.StringType()), T.StructField("languageId", T.StringType()),
        T.StructField("attribution", T.StructType([
            T.StructField("source", T.StringType()),
            T.StructField("metadata", T.StructType([T.StructField("codeLocation", T.StructType([
                T.StructField("uri", T.StructType([T.StructField("path", T.StringType())])),
                T.StructField("range", T.StructType([T.StructField("start", _POSITION), T.StructField("end", _POSITION)]))]))]))]))]))])


def read_origins(spark: SparkSession, paths) -> DataFrame:
    """Console executions in either shape; R (also when unnamed) and Python only. Order by ``ts``."""
    raw = spark.read.schema(ORIGIN_LINE).json(paths)
    loc = "payload.attribution.metadata.codeLocation"
    own = F.col("payload").isNull()
    first, last = F.col(f"{loc}.range.start.line"), F.col(f"{loc}.range.end.line")
    nowhere = (first == 0) & (last == 0) & (F.coalesce(F.col(f"{loc}.range.start.character"), F.lit(0)) == 0) & (F.coalesce(F.col(f"{loc}.range.end.character"), F.lit(0)) == 0)
    line = lambda mine, theirs: F.when(own, mine).otherwise(F.when(nowhere, None).otherwise(theirs + 1))
    out = raw.select(
        F.when(own, F.col("ts_ns")).otherwise(F.col("ts") * 1_000_000).alias("ts"), F.coalesce("kind", "payload.attribution.source").alias("kind"),
        F.coalesce("file", f"{loc}.uri.path").alias("file"), line(F.col("start_line"), first).alias("start_line"), line(F.col("end_line"), last).alias("end_line"),
        F.coalesce("code", "payload.code").alias("code"), F.lower(F.coalesce(F.nullif(F.coalesce("language", "payload.languageId"), F.lit("")), F.lit("r"))).alias("language"))
    return out.filter(F.col("language").isin("r", "python") & F.col("ts").isNotNull())


def read_documents(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("file"), F.col("value").alias("text"))

