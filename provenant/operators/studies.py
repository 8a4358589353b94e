"""Grouped and windowed table jobs on any table with a group, a time and a value."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.ordered import previous, scan, Scan


def derived_dose(samples: DataFrame, dose: str, weight: str) -> DataFrame:
    """Dose times weight to one place, half to even."""
    return samples.withColumn("dose", F.bround(F.col(dose) * F.col(weight), 1))


def subjects(samples: DataFrame, columns: list[str]) -> DataFrame:
    return samples.select(*columns).distinct()


def _steps(samples: DataFrame, keys: list[str], time: str, value: str, tie: list[str]) -> DataFrame:
    return previous(samples, keys, [time, *tie], "__b", F.struct(F.col(time).alias("t"), F.col(value).alias("c")))


def trapezoid(samples: DataFrame, keys: list[str], time: str, value: str, tie: tuple = (), log_down: bool = False) -> DataFrame:
    """Cmax, Tmax (the first) and the area under the curve per group; optionally by the log rule where it falls."""
    s = _steps(samples.filter(F.col(value).isNotNull()), keys, time, value, list(tie))
    dt, c1, c2 = F.col(time) - F.col("__b.t"), F.col("__b.c"), F.col(value)
    area = dt * (c1 + c2) / 2
    if log_down:
        falls = (c2 < c1) & (c2 > 0) & (c1 > 0)
        area = F.when(falls, dt * (c1 - c2) / F.ln(F.when(falls, c1 / c2))).otherwise(area)
    return s.groupBy(*keys).agg(F.max(value).alias("cmax"), F.min_by(time, F.struct(-F.col(value), F.col(time))).alias("tmax"),
                                F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"))


def last_samples(samples: DataFrame, keys: list[str], time: str, n: int, tie: tuple = ()) -> DataFrame:
    """The last n samples of each group by a running count from the end."""
    back = scan(samples, keys, [time, *tie], [Scan("__n", "sum", F.lit(1).cast("bigint"))], reverse=True)
    return back.filter(F.col("__n") <= n).drop("__n")


def half_life(samples: DataFrame, keys: list[str], time: str, value: str, tie: tuple = (), n: int = 3) -> DataFrame:
    """ln 2 over the slope of ln value on time over the last n positive samples."""
    last = last_samples(samples.filter(F.col(value) > 0), keys, time, n, tie)
    slope = F.regr_slope(F.ln(value), F.col(time))
    return last.groupBy(*keys).agg((-slope).alias("lambda"), F.count(F.lit(1)).alias("n")).withColumn(
        "half_life", F.when((F.col("n") == n) & (F.col("lambda") > 0), math.log(2) / F.col("lambda"))).drop("n")


def with_start(samples: DataFrame, keys: list[str], time: str, value: str, tie: tuple = ()) -> DataFrame:
    """The value at time 0 by going back from the first two samples in the log, added as a row."""
    count = scan(samples, keys, [time, *tie], [Scan("__n", "sum", F.lit(1).cast("bigint"))]).filter("__n <= 2")
    pick = lambda c, i: F.max(F.when(F.col("__n") == i, F.col(c)))
    two = count.groupBy(*keys).agg(pick(time, 1).alias("t1"), pick(value, 1).alias("c1"), pick(time, 2).alias("t2"), pick(value, 2).alias("c2"))
    fit = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("t2") > F.col("t1"))
    rate = F.when(fit, (F.ln(F.when(fit, F.col("c1"))) - F.ln(F.when(fit, F.col("c2")))) / (F.col("t2") - F.col("t1")))
    zero = two.filter(fit & (F.col("t1") > 0)).select(*keys, F.lit(0).cast("double").alias(time), (F.col("c1") * F.exp(rate * F.col("t1"))).alias(value))
    return samples.select(*keys, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value)).unionByName(zero)


def clearance(samples: DataFrame, doses: DataFrame, keys: list[str], time: str, value: str, tie: tuple = ()) -> DataFrame:
    """Area to infinity and dose over it: the last value over the terminal rate is added."""
    auc = trapezoid(samples, keys, time, value, tie)
    rate = half_life(samples, keys, time, value, tie)
    last = samples.groupBy(*keys).agg(F.max_by(value, F.struct(time, *tie)).alias("c_last"))
    inf = auc.join(rate, keys).join(last, keys).filter(F.col("half_life").isNotNull()).withColumn("auc_inf", F.col("auc") + F.col("c_last") / F.col("lambda"))
    return inf.join(doses, keys).select(*keys, "auc_inf", (F.col("dose") / F.col("auc_inf")).alias("clearance"))


def middle(df: DataFrame, column: str) -> DataFrame:
    """The median over all rows: the values where the running count passes the middle. Spark's own median keeps
    all values in one buffer; here values are counted first and the running count is split like any hot key."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    total = F.lit(counts.agg(F.sum("n")).first()[0] or 0)
    at = scan(counts, ["all"], [column], [Scan("upto", "sum", F.col("n"))])
    first = lambda k: F.min(F.when(F.col("upto") >= k, F.col(column)))
    return at.agg(((first(F.floor((total + 1) / 2)) + first(F.floor((total + 2) / 2))) / 2).alias("median"))


def paired_logs(rows: DataFrame, subject: str, arm: str, value: str, arms: tuple[str, str]) -> DataFrame:
    """Log differences of two arms per subject, as count, mean and deviation."""
    wide = rows.groupBy(subject).pivot(arm, list(arms)).agg(F.avg(value)).filter(F.col(arms[0]).isNotNull() & F.col(arms[1]).isNotNull())
    d = F.ln(F.col(arms[0])) - F.ln(F.col(arms[1]))
    return wide.select(d.alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))


def ratio_interval(stats: DataFrame, level: float = 0.9) -> DataFrame:
    """Geometric mean ratio with its interval: the t quantile is computed on the aggregated rows."""

    def add(batches):
        for b in batches:
            t = [_t_quantile(1 - (1 - level) / 2, n - 1) if n > 1 else float("nan") for n in b["n"]]
            half = pd.Series(t) * b["sd"].values / b["n"].astype(float).values ** 0.5
            mean = b["mean"].reset_index(drop=True)
            b = b.reset_index(drop=True)
            b["ratio"], b["low"], b["high"] = mean.map(math.exp), (mean - half).map(math.exp), (mean + half).map(math.exp)
            yield b

    from pyspark.sql import types as T
    schema = T.StructType([*stats.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("ratio", "low", "high")]])
    return stats.mapInPandas(add, schema)


def _t_density(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def t_tail(t: float, df: float, pieces: int = 4000) -> float:
    """P(T > t) by Simpson's rule from 0."""
    t = abs(t)
    h = t / pieces
    total = _t_density(0, df) + _t_density(t, df) + sum((4 if i % 2 else 2) * _t_density(i * h, df) for i in range(1, pieces))
    return max(0.0, 0.5 - total * h / 3)


def _t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df, 1000) < p else (lo, mid)
    return (lo + hi) / 2


def regression(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, correlation and n of y on x per key."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("r"), F.regr_count(y, x).alias("n"))


def slope_p(fits: DataFrame) -> DataFrame:
    """Two-sided p of each slope, on the aggregated rows."""
    from pyspark.sql import types as T

    def add(batches):
        for b in batches:
            b["p"] = [2 * t_tail(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2) if n > 2 and abs(r) < 1 else float("nan") for r, n in zip(b["r"], b["n"])]
            yield b

    return fits.mapInPandas(add, T.StructType([*fits.schema.fields, T.StructField("p", T.DoubleType())]))


def exposure(simulations: list[DataFrame], low: float, high: float) -> DataFrame:
    """United simulations: least and largest exposure per dose against two thresholds."""
    rows = simulations[0]
    for more in simulations[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("dose").agg(F.min("value").alias("least"), F.max("value").alias("most")).select(
        "*", (F.col("least") >= low).alias("reached"), (F.col("most") <= high).alias("safe"))


def study_file(samples: DataFrame, names: dict[str, str], order: list[str]) -> DataFrame:
    return samples.select(*names).withColumnsRenamed(names).orderBy(*order)


def ranking(rows: DataFrame, group: str, year: str, now: int, top: int, missing: int | None = 0) -> DataFrame:
    """Mean age per group, oldest first; rows with the value that stands for unknown are left out if it is given."""
    y = F.col(year).try_cast("int")
    known = rows.withColumn("__y", y).filter("__y IS NOT NULL")
    if missing is not None:
        known = known.filter(F.col("__y") > missing)
    return known.groupBy(group).agg(F.round(now - F.avg("__y"), 1).alias("age")).orderBy(F.desc("age"), group).limit(top)
