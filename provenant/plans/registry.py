"""Registration of named queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provenant.plans.model_sql import with_models
from provenant.sources.testdata import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AREAS = ("base", "records", "scopes", "unions", "view", "claims", "traces", "sessions", "files", "studies", "feeds", "sources")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its check."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_models(sql)
        return fn

    return register


def hash_sum_sql(digest: str) -> str:
    """The check's form of ``terms.hash_sum``."""
    piece = "sum(CAST(CAST('0x'||substr({d},{at},13) AS BIGINT) AS DECIMAL(38,0)))::VARCHAR"
    return "sha256(count(*)||':'||" + "||':'||".join(piece.format(d=digest, at=at) for at in (1, 14, 27, 40, 53)) + ")"


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"provenant.plans.{area}")
