"""Longest prefixes of paths, and the classes of files that follow from them.

A prefix counts in whole components, so the prefixes of a path are among its own ancestors. They are looked up there by equality: each
distinct directory is laid out into its ancestors once and joined with the table of prefixes, however many there are. No prefix is compared
with every path, and no list of prefixes goes into an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.paths import directory, path_class

PACKAGE_MARK = "/Meta/package.rds"


def _ancestors(folder: Column) -> Column:
    """The folder and all above it, but the root."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest(paths: DataFrame, prefixes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``paths`` (keys, path) with ``prefix``: the longest of ``prefixes`` (keys, prefix) that the path is or lies under, or null.

    A prefix that ends in ``/`` holds what lies under it, not the folder itself.
    """
    keys = keys or []
    given = prefixes.where("prefix <> ''").select(*keys, F.regexp_replace("prefix", "/+$", "").alias("folder"), F.col("prefix").endswith("/").alias("inside"), "prefix")
    known = given.groupBy(*keys, "folder").agg(F.min("prefix").alias("prefix"), F.bool_and("inside").alias("inside"))
    seen = paths.select(*keys, "path").distinct().withColumn("folder", directory("path"))
    folders = seen.select(*keys, "folder").distinct()
    above = folders.select(*keys, "folder", F.explode(_ancestors(F.col("folder"))).alias("up")).join(known.select(*keys, F.col("folder").alias("up"), "prefix"), [*keys, "up"])
    best = above.groupBy(*keys, "folder").agg(F.max_by("prefix", F.length("up")).alias("by_folder"))
    itself = known.where(~F.col("inside")).select(*keys, F.col("folder").alias("path"), F.col("prefix").alias("by_name"))
    found = seen.join(best, [*keys, "folder"], "left").join(itself, [*keys, "path"], "left").select(*keys, "path", F.coalesce("by_name", "by_folder").alias("prefix"))
    # null paths and null keys have no prefix; they stay, by a left join
    return paths.join(found.where("prefix IS NOT NULL"), [*keys, "path"], "left").select(*paths.columns, "prefix")


def library_roots(files: DataFrame) -> DataFrame:
    """``prefix``: folders that hold an installed package, told from the files that are there."""
    return files.where(F.col("path").endswith(PACKAGE_MARK)).select(F.expr(f"substring(path, 1, length(path) - {len(PACKAGE_MARK)})").alias("prefix")).where("prefix <> ''").distinct()


def classes(files: DataFrame, project: str | Column, *, named: DataFrame | None = None, keys: list[str] | None = None, libraries: DataFrame | None = None,
            home: str = "", log: Column | None = None, env_prefixes: list[str] | None = None) -> DataFrame:
    """``files`` (keys, path) with ``class``. ``named`` (keys, prefix) are prefixes that sessions named, ``libraries`` (prefix) the roots of packages."""
    columns, own, packaged = files.columns, None, None
    if named is not None:
        files = longest(files, named, keys).withColumnRenamed("prefix", "own_prefix")
        own = F.col("own_prefix").isNotNull()
    if libraries is not None:
        files = longest(files, libraries.select(F.concat("prefix", F.lit("/")).alias("prefix"))).withColumnRenamed("prefix", "library_prefix")
        packaged = F.col("library_prefix").isNotNull()
    project = F.lit(project) if isinstance(project, str) else project
    return files.select(*columns, path_class("path", project, log=log, home=home, named=own, library=packaged, env_prefixes=env_prefixes).alias("class"))
