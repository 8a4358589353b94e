"""N-Triples and N-Quads as tables and back, and graphs loaded under the hash of their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.terms import XSD, nt_term, nt_unquote
from provenant.session import cut
from provenant.sources.tracelog import numbered_lines

_IRI, _BNODE = r"<([^<>\"{}|^`\\\s]*)>", r"_:([A-Za-z0-9_][\w.-]*)"
# The text runs to the last quote before the statement's end; that no quote in it stands bare is checked apart,
# as a repeated alternation would recurse once a character on long texts.
_LITERAL = r'"([^\n\r]*)"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
STATEMENT = rf"^\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+(?:{_IRI}|{_BNODE}|{_LITERAL})\s*(?:(?:{_IRI}|{_BNODE})\s*)?\.\s*(?:#.*)?$"


def parse_quads(lines: DataFrame) -> DataFrame:
    """One statement a line; blank and ``#`` lines are skipped, any other line that does not read raises with its place."""
    rows = lines.filter(~F.trim("value").rlike("^(#.*)?$"))
    g = lambda i: F.nullif(F.regexp_extract("value", STATEMENT, i), F.lit(""))
    body = F.regexp_replace(F.regexp_extract("value", STATEMENT, 6), r"\\.", "")
    ok = F.assert_true(F.col("value").rlike(STATEMENT) & ~F.contains(body, F.lit('"')), F.concat_ws(" ", F.lit("no statement at"), "file", F.col("ord").cast("string")))
    literal = F.col("value").rlike(rf"^\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+\"")
    unq = lambda c: nt_unquote(F.coalesce(c, F.lit("")))
    kind = F.when(literal, "literal").when(g(5).isNotNull(), "bnode").otherwise("iri")
    datatype = F.when(g(7) != XSD + "string", g(7))
    return rows.withColumn("__ok", ok).filter("__ok IS NULL").select(
        F.coalesce(g(9), g(10)).alias("g"), F.when(g(2).isNotNull(), "bnode").otherwise("iri").alias("s_type"), F.coalesce(g(1), g(2)).alias("s"), g(3).alias("p"),
        kind.alias("o_type"), F.when(literal, unq(F.regexp_extract("value", STATEMENT, 6))).otherwise(F.coalesce(g(4), g(5))).alias("o"),
        datatype.alias("o_datatype"), g(8).alias("o_lang"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return parse_quads(numbered_lines(spark, path))


def lines_of(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """Statements as text."""
    s = nt_term("s_type", "s", F.lit(None).cast("string"), F.lit(None).cast("string"))
    o = nt_term("o_type", "o", "o_datatype", "o_lang")
    parts = [s, F.concat(F.lit("<"), "p", F.lit(">")), o]
    if graphs:
        parts.append(F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), "g", F.lit(">"))))
    return quads.select("g", F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def write_quads(quads: DataFrame, path: str) -> None:
    """N-Quads, graphs in sorted order over the files. The range sort spreads one large graph over many files."""
    rows = lines_of(quads)
    rows.orderBy("g", "value").select("value").write.text(path)


def load_graphs(files: DataFrame, statements: DataFrame, record_ids: DataFrame, catalogue: DataFrame, repository: str, most_triples: int, most_bytes: int) -> DataFrame:
    """The catalogue rows of files to load: refused when a file is too large, holds no triples or quads, clashes
    with a record or would take the repository over its limit.

    ``files`` has (file, sha, size), ``statements`` parsed lines with ``file``. Graph = urn:sha256:<hash>.
    """
    def refuse(bad: DataFrame, why: str) -> None:
        row = bad.select("file").first()
        if row is not None:
            raise ValueError(f"{row[0]}: {why}")

    refuse(files.filter(F.col("size") > most_bytes), "over the byte limit")
    refuse(statements.filter("g IS NOT NULL"), "names graphs of its own")
    refuse(files.join(record_ids.select(F.regexp_replace("record_id", "^sha256:", "").alias("sha")), "sha", "left_semi"), "has the hash of a record")
    counted = files.join(statements.groupBy("file").agg(F.count(F.lit(1)).alias("triples")), "file", "left")
    refuse(counted.filter("triples IS NULL"), "holds no triples")
    others = catalogue.filter(F.col("repo") == repository).join(files.select("sha"), "sha", "left_anti").agg(F.sum("triples")).first()[0] or 0
    if others + (counted.dropDuplicates(["sha"]).agg(F.sum("triples")).first()[0] or 0) > most_triples:
        raise ValueError(f"{repository}: over the triple limit")
    return counted.groupBy("sha").agg(F.min("file").alias("file"), F.first("triples").alias("triples")).select(
        F.lit(repository).alias("repo"), "sha", F.concat(F.lit("urn:sha256:"), "sha").alias("graph"), "file", "triples")


BUCKETS = 64


def _bucket(graph: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(graph), F.lit(buckets))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def replace_graphs(statements: DataFrame, graphs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write loaded graphs, each replacing what was there of it; loading again changes nothing.

    Graphs lie in buckets by a hash of their name, one file a bucket, so files are as many as buckets whatever the number of graphs. A bucket
    that holds one of ``graphs`` is written anew, from its other graphs as they are and the new statements; the others are not touched.
    """
    rows = statements.drop("g").join(graphs.select("file", F.col("graph").alias("g")), "file").drop("file").distinct()
    _rewrite(rows, graphs.select(F.col("graph").alias("g")).distinct(), path, buckets)


def drop_graphs(graphs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Remove ``graphs`` (graph); their buckets are written anew without them."""
    loaded = read_graphs(graphs.sparkSession, path)
    _rewrite(loaded.limit(0), graphs.select(F.col("graph").alias("g")).distinct(), path, buckets)


def _rewrite(rows: DataFrame, names: DataFrame, path: str, buckets: int) -> None:
    spark = rows.sparkSession
    names = cut(names.withColumn("bucket", _bucket("g", buckets)))
    touched = [r.bucket for r in names.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    new = rows.withColumn("bucket", _bucket("g", buckets))
    if _there(spark, path):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched) & F.col("g").isNotNull())
        new = old.select(new.columns).join(names.select("g"), "g", "left_anti").select(new.columns).unionByName(new)
    # a row without a graph marks each bucket, so that one whose last graph went is written anew too
    marks = names.select("bucket").distinct().select(*(F.col("bucket") if c == "bucket" else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns))
    staged = cut(new.unionByName(marks))  # whole before anything is replaced, as it is read from what it replaces
    staged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_graphs(spark: SparkSession, path: str, graphs: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The statements of all loaded graphs, or of some, of which only the buckets are read."""
    rows = spark.read.parquet(path).where("g IS NOT NULL")
    if graphs is not None:
        wanted = spark.createDataFrame([(g,) for g in graphs], "g string").select(_bucket("g", buckets).alias("b")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r.b for r in wanted]) & F.col("g").isin(graphs))
    return rows.drop("bucket")


def graph_statistics(loaded: DataFrame) -> DataFrame:
    """``(g, triples, subjects, predicates)`` of loaded graphs."""
    return loaded.groupBy("g").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"))


def droppable(catalogue: DataFrame, repository: str, graphs: DataFrame) -> DataFrame:
    """Graphs to remove when a repository drops them: those no other catalogue lists."""
    others = catalogue.filter(F.col("repo") != repository).select("graph")
    return graphs.join(others, "graph", "left_anti")


def loaded_triples(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("repo").agg(F.sum("triples").alias("triples"), F.count(F.lit(1)).alias("graphs"))
