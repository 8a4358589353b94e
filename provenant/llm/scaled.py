"""Vectors as whole numbers, as exact top-k search and hard-negative mining take them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import lists

SCALE = 256
# Greater components could make an inner product leave 64 bits.
LARGEST = 2**24


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x))


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, keep: dict[str, Column] | None = None) -> DataFrame:
    """``id``, ``v`` and the columns of ``keep``: the rows that take part, each different one once.

    A row takes part if its id is not null and its vector is not null, holds no null or non-finite component and none that is
    ``LARGEST`` or more once scaled, and has the length that most vectors have (of equally many, the greater; at least 1).
    """
    given = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *(c.alias(n) for n, c in (keep or {}).items()))
    given = given.where("id IS NOT NULL AND size(v) > 0")
    good = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * float(scale) < float(LARGEST))))
    counted = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("v") == (counted["d"] if counted else 1)).withColumn("v", whole_numbers(F.col("v"), scale).cast("array<int>")).distinct()


def matrix(column) -> np.ndarray:
    """The rows of a list column of equally long lists."""
    values, offsets = lists(column)
    return values[offsets[0] : offsets[-1]].reshape(len(offsets) - 1, -1)
