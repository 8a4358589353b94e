"""Query results as the standard JSON document and as CSV, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions.terms import XSD

TERM = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("datatype", T.StringType()),
                     T.StructField("xml:lang", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("head", T.StructType([T.StructField("vars", T.ArrayType(T.StringType()))])), T.StructField("boolean", T.BooleanType()),
    T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(T.MapType(T.StringType(), TERM)))]))])


def bindings(answer: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    """One JSON binding per row; unbound variables are left out. ``terms`` names columns that hold IRIs."""
    terms = terms or {}
    types = {"int": "integer", "bigint": "integer", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}

    def term(name: str, dtype: str):
        c = F.col(f"`{name}`")
        kind = terms.get(name, "literal")
        datatype = None if kind != "literal" or dtype == "string" else XSD + types.get(dtype, "decimal")
        return F.when(c.isNotNull(), F.struct(F.lit(kind).alias("type"), c.cast("string").alias("value"), F.lit(datatype).cast("string").alias("datatype"))).alias(name)

    return answer.select(F.to_json(F.struct(*[term(n, d) for n, d in answer.dtypes])).alias("value"))


def write_results(answer: DataFrame, path: str, terms: dict[str, str] | None = None) -> None:
    """Bindings as JSON lines beside a head with the variables in order; the parts make up the document."""
    bindings(answer, terms).write.text(f"{path}/bindings")
    head = answer.sparkSession.createDataFrame([(answer.columns,)], "vars array<string>")
    head.select(F.to_json(F.struct("vars")).alias("value")).coalesce(1).write.text(f"{path}/head")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results document: one map of terms per binding, or the boolean of an ASK."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return doc.select(F.col("head.vars").alias("vars"), "boolean", F.explode_outer("results.bindings").alias("binding"))


def values(results: DataFrame, variables: list[str]) -> DataFrame:
    return results.select(*[F.col("binding")[v]["value"].alias(v) for v in variables])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, whose names may be quoted; every column is text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)
