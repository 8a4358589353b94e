"""Ordered scans within a key: running values, previous rows, as-of joins.

A window over ``key`` puts all rows of a key into one task. That is fine until one key holds a large
part of the data, so ``scan`` looks at the largest key first. If it is above the limit, the rows are sorted by key and
order over all partitions and written; the part of a key in one partition is a block. The window then runs per (key, block),
and a table with one row per block carries the value over from the blocks before. The answer is the same either way, and rows
split over blocks by all columns of the order, so ties in the first do not matter.

The look is a job of its own over what leads to the rows. Several scans by one key, or by keys that hold it, share one: it is given on as ``sizes``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.session import cut, hot_rows

_BLOCK = "__block"


@dataclass(frozen=True)
class Scan:
    """One running value: ``op`` is sum, max, min or last (the last non-null)."""

    name: str
    op: str
    value: Column
    inclusive: bool = True


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    *,
    reverse: bool = False,
    bounded: bool = False,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Add the running values to ``df``.

    ``reverse`` runs from the end. ``bounded`` states that a key has few rows by construction, so the
    size is not looked at; ``sizes`` is what was seen before, of these keys or of some of them, on these rows or on more.
    """
    limit = hot_rows(df.sparkSession)
    if not bounded:
        sizes = sizes or key_sizes(df, keys)
    if bounded or sizes.largest <= limit:
        window = Window.partitionBy(*keys).orderBy(*_order(order, reverse))
        return df.select("*", *[_over(s, window).alias(s.name) for s in scans])
    return _scan_in_blocks(df, list(keys), list(order), list(scans), reverse, sizes.rows // limit)


@dataclass(frozen=True)
class Sizes:
    """Rows of the largest key, and of all."""

    largest: int
    rows: int

    def __add__(self, other: Sizes) -> Sizes:
        return Sizes(self.largest + other.largest, self.rows + other.rows)


def key_sizes(df: DataFrame, keys: Sequence[str]) -> Sizes:
    """One look at how many rows the largest key has."""
    found = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return Sizes(found[0] or 0, found[1] or 0)


def _order(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _aggregate(op: str, value: Column) -> Column:
    if op == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[op](value)


def _over(s: Scan, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow if s.inclusive else -1)
    return _aggregate(s.op, s.value).over(frame)


def _scan_in_blocks(df, keys, order, scans, reverse, pieces) -> DataFrame:
    # Sorted over all partitions, twice as many as there are limits' worth of rows, so that bounds from samples keep below it;
    # written, so that every use sees the same blocks.
    parts = max(2 * pieces, 2) + 1
    blocks = cut(df.repartitionByRange(parts, *keys, *order).withColumn(_BLOCK, F.spark_partition_id()))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    local = Window.partitionBy(*keys, _BLOCK).orderBy(*_order(order, reverse))
    at = F.struct(*order)
    totals = []
    for i, s in enumerate(scans):
        if s.op == "last":
            pick = F.min_by if reverse else F.max_by
            total = pick(s.value, F.when(s.value.isNotNull(), at))
        else:
            total = _aggregate(s.op, s.value)
        totals.append(total.alias(f"__c{i}"))
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(_BLOCK).desc() if reverse else F.col(_BLOCK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        blocks.groupBy(*keys, _BLOCK)
        .agg(*totals)
        .select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            F.col(_BLOCK).alias("__b"),
            *[_aggregate(s.op, F.col(f"__c{i}")).over(before).alias(f"__c{i}") for i, s in enumerate(scans)],
        )
    )
    inner = blocks.select("*", *[_over(s, local).alias(s.name) for s in scans])
    joined = inner.join(carry, [*on, F.col(_BLOCK) == F.col("__b")], "left")
    names = {s.name: _combine(s, F.col(s.name), F.col(f"__c{i}")).alias(s.name) for i, s in enumerate(scans)}
    return joined.select(*df.columns, *names.values())


def _combine(s: Scan, here: Column, carried: Column) -> Column:
    if s.op == "last":
        return F.coalesce(here, carried)
    if s.op == "sum":
        return F.when(here.isNull(), carried).when(carried.isNull(), here).otherwise(here + carried)
    return (F.greatest if s.op == "max" else F.least)(here, carried)


def previous(df: DataFrame, keys, order, name: str, value: Column, **kw) -> DataFrame:
    """The value of the row before (null on the first row)."""
    return scan(df, keys, order, [Scan("__p", "last", F.struct(value.alias("v")), False)], **kw).select(
        *df.columns, F.col("__p.v").alias(name)
    )


def following(df: DataFrame, keys, order, name: str, value: Column, **kw) -> DataFrame:
    """The value of the row after (null on the last row)."""
    return previous(df, keys, order, name, value, reverse=True, **kw)


def numbered(df: DataFrame, keys, order, name: str, **kw) -> DataFrame:
    """1, 2, 3, … within the key."""
    return scan(df, keys, order, [Scan(name, "sum", F.lit(1).cast("bigint"))], **kw)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    value: Column,
    name: str,
    *,
    right_tie: Sequence[str] = (),
    include_equal: bool = True,
    **kw,
) -> DataFrame:
    """For each left row the value of the last right row with the same keys at or before it.

    One union and one scan instead of a range join: a hot key costs its rows, not its pairs.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    ties = [f"__t{i}" for i in range(len(right_tie))]
    tie_types = dict(right.dtypes)
    lefts = left.select(
        *keys,
        F.col(left_at).alias("__at"),
        F.lit(1 if include_equal else 0).alias("__side"),
        *[F.lit(None).cast(tie_types[c]).alias(t) for t, c in zip(ties, right_tie)],
        row.alias("__row"),
        F.lit(None).cast(right.select(F.struct(value.alias("v")).alias("x")).schema["x"].dataType).alias("__v"),
    )
    rights = right.select(
        *keys,
        F.col(right_at).alias("__at"),
        F.lit(0 if include_equal else 1).alias("__side"),
        *[F.col(c).alias(t) for t, c in zip(ties, right_tie)],
        F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType).alias("__row"),
        F.struct(value.alias("v")).alias("__v"),
    )
    both = scan(
        lefts.unionByName(rights), keys, ["__at", "__side", *ties], [Scan("__last", "last", F.col("__v"))], **kw
    )
    return both.filter(F.col("__row").isNotNull()).select("__row.*", F.col("__last.v").alias(name))
