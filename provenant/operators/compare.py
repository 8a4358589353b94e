"""Comparisons: numeric comparison of text files, two sides of a result, anonymised text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a number, with Fortran's D exponent.
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eEdD][-+]?\d+)?$"


def number(token: Column) -> Column:
    t = F.regexp_replace(token, "^[\"']+|[\"']+$", "")
    return F.when(t.rlike(NUMBER), F.translate(t, "Dd", "Ee").try_cast("double"))


def lines_of(files: DataFrame) -> DataFrame:
    """``(pair, side, line, text)`` of text files ``(pair, side, text)``; a last empty line is none, an empty file has none."""
    body = F.regexp_replace("text", r"\n\z", "")
    rows = files.filter("text <> ''").select("pair", "side", F.posexplode(F.split(body, "\n", -1)).alias("pos", "text"))
    return rows.select("pair", "side", (F.col("pos") + 1).alias("line"), F.regexp_replace("text", r"[ \r]+$", "").alias("text"))


def compare_files(files: DataFrame, rtol: float, volatile: str | None = None) -> DataFrame:
    """Per pair: same, within (the tolerance) or different, how many numbers differ, the largest relative
    difference and its line. ``files`` has (pair, side a or b, text, sha); lines meet by number, tokens by place.
    """
    sides = files.groupBy("pair").agg((F.max("sha") == F.min("sha")).alias("equal"), F.count(F.lit(1)).alias("n"),
                                      F.bool_or(F.contains(F.substring("text", 1, 8192), F.lit("\u0000"))).alias("binary"))
    # Only pairs whose bytes differ are split into lines.
    rows = lines_of(files.join(sides.filter("NOT equal").select("pair"), "pair"))
    both = rows.filter("side = 'a'").select("pair", "line", F.col("text").alias("a")).join(
        rows.filter("side = 'b'").select("pair", "line", F.col("text").alias("b")), ["pair", "line"], "full")
    length = both.groupBy("pair").agg(F.bool_or(F.col("a").isNull() | F.col("b").isNull()).alias("ragged"))
    unlike = both.filter("a <> b")
    if volatile is not None:
        unlike = unlike.filter(~(F.col("a").rlike(volatile) & F.col("b").rlike(volatile)))
    parts = lambda c: F.filter(F.split(c, r"[ \t,;]+"), lambda x: x != "")
    toks = unlike.select("pair", "line", parts("a").alias("ta"), parts("b").alias("tb"))
    shape = toks.groupBy("pair").agg(F.min(F.when(F.size("ta") != F.size("tb"), F.col("line"))).alias("built"))
    each = toks.filter(F.size("ta") == F.size("tb")).select("pair", "line", F.posexplode(F.arrays_zip("ta", "tb")).alias("pos", "t")).filter("t.ta <> t.tb")
    x, y = number(F.col("t.ta")), number(F.col("t.tb"))
    rel = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-300))
    each = each.withColumn("rel", rel)
    # what follows the first line that is built differently, or the first other word, is not compared any more
    stop = each.filter("rel IS NULL").groupBy("pair").agg(F.min(F.struct("line", "pos")).alias("word")).join(shape.filter("built IS NOT NULL"), "pair", "full").select(
        "pair", F.least("word", F.when(F.col("built").isNotNull(), F.struct(F.col("built").alias("line"), F.lit(-1).alias("pos")))).alias("stop"))
    each = each.join(stop, "pair", "left").filter(F.col("stop").isNull() | (F.struct("line", "pos") <= F.col("stop")))
    nums = each.groupBy("pair").agg(F.count("rel").alias("numbers"), F.max("rel").alias("max_rel"),
                                    F.max_by("line", F.struct("rel", -F.col("line"))).alias("where"), F.bool_or(F.col("rel").isNull()).alias("words"))
    out = sides.join(length, "pair", "left").join(shape, "pair", "left").join(nums, "pair", "left")
    differs = (F.col("binary") | F.coalesce("ragged", F.lit(False)) | F.col("built").isNotNull() | F.coalesce("words", F.lit(False))
               | (F.coalesce("max_rel", F.lit(0.0)) > rtol))
    note = (F.when(F.col("equal"), None).when(F.col("binary"), "binary file").when(F.coalesce("ragged", F.lit(False)), "other number of lines")
            .when(F.col("built").isNotNull(), "a line is built differently").when(F.coalesce("words", F.lit(False)), "other words")
            .when(F.coalesce("max_rel", F.lit(0.0)) > rtol, "difference above the tolerance"))
    clean = F.col("equal") | ~F.coalesce(differs, F.lit(False))
    return out.select("pair", F.when(F.col("equal"), "same").when(differs, "different").otherwise("within").alias("verdict"), note.alias("note"),
                      F.coalesce("numbers", F.lit(0)).alias("numbers"), F.when(clean | ~F.coalesce("words", F.lit(False)), F.col("max_rel")).alias("max_rel"), "where")


def two_sided(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Outputs by name on two sides: equal, different or missing on one."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    state = F.when(F.col("left").isNull(), "missing-left").when(F.col("right").isNull(), "missing-right").when(F.col("left") == F.col("right"), "equal").otherwise("different")
    return a.join(b, key, "full").select(key, state.alias("state"))


def totals(compared: DataFrame) -> DataFrame:
    return compared.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def anonymised(texts: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The ordered replacements applied to a text, and whether they changed it."""
    new = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, F.col(column))
    return texts.withColumn("clean", new).withColumn("changed", F.col("clean") != F.col(column))
