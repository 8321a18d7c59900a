"""Operators over placed text: intervals, bands, boxes, repeated lines, and what columns hold.

Bounds of a page are few and known, so they are literals in expressions, not tables to join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers
from plumbline.functions import text as t
from plumbline.operators.tally import cells


def bucket(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the rising bounds x has reached."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")


def slot(x: Column, spans: Sequence[tuple[float, float]], tolerance: float = 0) -> Column:
    """The first interval that holds x, null if none does."""
    return F.coalesce(*[F.when(x.between(low - tolerance, high + tolerance), i) for i, (low, high) in enumerate(spans)]).cast("int")


def nearest(x: Column, spans: Sequence[tuple[float, float]]) -> Column:
    """The interval that holds x, else the one with the nearest edge (the first, if two are as near)."""
    away = [F.struct(F.greatest(F.lit(float(low)) - x, x - F.lit(float(high)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, (low, high) in enumerate(spans)]
    return F.array_min(F.array(*away))["i"]


def gutters(runs: DataFrame, group: list[str], low: str, high: str, most: int, least_width: int) -> DataFrame:
    """group, low, high: stretches between covered ones that at most `most` runs cross.

    Coverage is counted bucket by bucket with partial sums; only a group's buckets are ordered.
    """
    covered = runs.select(*group, F.explode(F.sequence(low, high)).alias("_b")).groupBy(*group, "_b").agg(F.count("_b").alias("_n")).where(F.col("_n") > most)
    order = Window.partitionBy(*group).orderBy("_b")
    island = covered.withColumn("_i", F.col("_b") - F.row_number().over(order)).groupBy(*group, "_i").agg(F.min("_b").alias("_low"), F.max("_b").alias("_high"))
    gaps = island.withColumn("low", F.lag("_high").over(Window.partitionBy(*group).orderBy("_low")) + 1).withColumn("high", F.col("_low") - 1)
    return gaps.where((F.col("high") - F.col("low") + 1) >= least_width).select(*group, "low", "high")


def furniture(lines: DataFrame, page: str, text: str, y: str, spread: float = 3.0) -> DataFrame:
    """shape, pages: lines, digits aside, that half of the pages (two at least) show at one height."""
    shaped = lines.select(page, t.line_shape(F.col(text)).alias("shape"), y)
    many = lines.agg(F.count_distinct(page).alias("every"))  # one row
    by = shaped.groupBy("shape").agg(F.count_distinct(page).alias("pages"), F.stddev_pop(y).alias("spread"))
    return by.crossJoin(many).where((F.col("pages") >= F.greatest(F.lit(2), 0.5 * F.col("every"))) & (F.col("spread") <= spread)).drop("every")


def without_furniture(lines: DataFrame, found: DataFrame, text: str) -> DataFrame:
    return lines.withColumn("_shape", t.line_shape(F.col(text))).join(found.select(F.col("shape").alias("_shape")), "_shape", "left_anti").drop("_shape")


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes (x, y, w, h)."""
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(F.col(a)[p] + F.col(a)[q], F.col(b)[p] + F.col(b)[q]) - F.greatest(F.col(a)[p], F.col(b)[p]))
    shared = side("x", "w") * side("y", "h")
    union = F.col(a)["w"] * F.col(a)["h"] + F.col(b)["w"] * F.col(b)["h"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def column_kinds(rows: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """name, samples, kind (date, money, number, text) and decimals of each column.

    A kind holds if 60 % of at least three values have it; numbers are money if one of them has a currency, a
    marker, brackets or two decimals. Values are counted first and each is read once, by as many tasks as a shuffle has, however few files hold the rows.
    """
    value = F.coalesce(F.col("value"), F.lit(""))
    counted = cells(rows, row, columns).where(~t.is_blank(value)).groupBy("name", "value").agg(F.count("*").alias("_n"))
    read = counted.select(
        "name", "_n", numbers.amount(F.col("value")).alias("a"), (dates.inspect(F.col("value"))["kind"] != "not-a-date").alias("d"), F.col("value").rlike(r"^\s*\(").alias("bracketed"),
    )
    a = F.col("a")
    rich = a.isNotNull() & (a["currency"].isNotNull() | a["marker"].isNotNull() | F.col("bracketed") | (a["decimals"] >= 2))
    share = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)) / F.sum("_n")
    by = read.groupBy("name").agg(
        F.sum("_n").alias("samples"), share(F.col("d")).alias("dated"), share(a.isNotNull()).alias("counted"), F.max(F.coalesce(rich, F.lit(False))).alias("rich"),
        F.max(F.coalesce(a["decimals"], F.lit(0))).alias("decimals"),
    )
    enough = F.col("samples") >= 3
    kind = F.when(enough & (F.col("dated") >= 0.6), "date").when(enough & (F.col("counted") >= 0.6), F.when(F.col("rich"), "money").otherwise("number")).otherwise("text")
    return by.select("name", "samples", kind.alias("kind"), "decimals")
