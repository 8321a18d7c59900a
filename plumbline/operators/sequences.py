"""Operators over ordered rows. Each takes its order and partition explicitly; none relies on where rows lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import amount, minor_units
from plumbline.session import settled


def row_digest(by: Sequence[str]) -> Column:
    """SHA-256 of a row's values, each told by its length, nulls apart: 32 bytes stand for texts of any length in a shuffle."""
    told = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in by]
    return F.unhex(F.sha2(F.concat(*told), 256))


def duplicates(rows: DataFrame, row: str, digest: Column) -> DataFrame:
    """row and duplicate_of of each row that repeats an earlier one.

    A minimum and a join on the digest, so that one value that many rows share is combined before the shuffle and
    a skewed join can be split, where a window would hold them all in one task. No text is shuffled.
    """
    keyed = rows.select(F.col(row), digest.alias("_digest"))
    firsts = keyed.groupBy("_digest").agg(F.min(row).alias("duplicate_of"))
    return keyed.join(firsts, "_digest").where(F.col(row) != F.col("duplicate_of")).select(row, "duplicate_of")


def first_occurrences(rows: DataFrame, row: str, by: list[str]) -> DataFrame:
    """rows with duplicate_of: null for the first row of equal ones, else that row. `row` tells rows apart."""
    return rows.join(duplicates(rows, row, row_digest(by)), row, "left")


def reconciled(rows: DataFrame, account: list[str], row: str, delta: Column, balance: Column, decimals: int = 2) -> DataFrame:
    """rows with tested and broken: does the balance before plus this row's change make this balance?

    Compared in whole minor units. An unreadable balance starts anew; a row without a change
    carries its balance on without a test.
    """
    order = Window.partitionBy(*account).orderBy(row)
    here, change = minor_units(balance, decimals), minor_units(delta, decimals)
    before = F.lag(here).over(order)
    tested = before.isNotNull() & here.isNotNull() & change.isNotNull()
    return rows.withColumn("tested", tested).withColumn("broken", F.coalesce(tested & (before + change != here), F.lit(False)))


#: The share of rows with an amount that must have a balance, and of breaks beyond which a column is no balance.
COVERED, BROKEN = 0.8, 0.2


def balance_shapes(rows: DataFrame, sheet: list[str], row: str, balance: str, left: list[str], decimals: int = 2) -> DataFrame:
    """sheet, shape, transitions, breaks: how a sheet's last money column is best read as a running balance of the numbers left of it.

    debit-credit takes the last two columns, signed the last one; the shape with fewer breaks wins, debit-credit on a tie. Cells are
    texts: an empty one adds nothing, an unreadable one leaves its row untested. Sheets with too few balances have no row.
    """
    value = lambda c: amount(F.col(c))["value"]
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    # Each cell is read once, and all shapes are told in one pass over a sheet's rows.
    read = rows.select(*sheet, row, value(balance).alias("_b"), *[value(c).alias(f"_n{i}") for i, c in enumerate(left)], *[blank(c).alias(f"_e{i}") for i, c in enumerate(left)])
    added = [F.when(F.col(f"_e{i}"), 0.0).otherwise(F.col(f"_n{i}")) for i in range(len(left))]
    deltas = {"signed": added[-1]} if left else {}
    if len(left) > 1:
        deltas = {"debit-credit": F.abs(added[-1]) - F.abs(added[-2]), **deltas}
    some = F.greatest(F.lit(False), F.col("_b").isNotNull(), *[F.col(f"_n{i}").isNotNull() for i in range(len(left))])
    told, counts = read, [F.count_if(some).alias("_a"), F.count_if(F.col("_b").isNotNull()).alias("_c")]
    for k, delta in enumerate(deltas.values()):
        told = reconciled(told, sheet, row, delta, F.col("_b"), decimals).withColumnsRenamed({"tested": f"_t{k}", "broken": f"_x{k}"})
        counts += [F.count_if(f"_t{k}").alias(f"_t{k}"), F.count_if(f"_x{k}").alias(f"_x{k}")]
    covered = told.groupBy(*sheet).agg(*counts).where((F.col("_a") > 0) & (F.col("_c") >= COVERED * F.col("_a")))
    each = [F.struct((F.col(f"_t{k}") == 0).alias("idle"), F.col(f"_x{k}").alias("breaks"), F.lit(k).alias("k"), F.lit(shape).alias("shape"), F.col(f"_t{k}").alias("transitions")) for k, shape in enumerate(deltas)]
    best = covered.withColumn("_s", F.array_min(F.array(*each)))
    return best.select(*sheet, "_s.shape", "_s.transitions", "_s.breaks")


def balance_usable(shapes: DataFrame) -> DataFrame:
    """shapes with usable: tested at all, and at most a fifth of the steps broken; only then are broken rows told."""
    return shapes.withColumn("usable", (F.col("transitions") > 0) & (F.col("breaks") <= BROKEN * F.col("transitions")))


def running_totals(rows: DataFrame, group: list[str], row: str, value: Column) -> DataFrame:
    """rows with total_before (of the rows above) and is_total: this value repeats that sum.

    At least two addends, one of them not zero; the tolerance is the greater of 0.01 and 1e-9 of the sum.
    """
    above = Window.partitionBy(*group).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    total, n = F.sum(value).over(above), F.count(value).over(above)
    some = F.max((value != 0).cast("int")).over(above) == 1
    close = F.abs(value - total) <= F.greatest(F.lit(0.01), F.abs(total) * 1e-9)
    return rows.withColumn("total_before", total).withColumn("is_total", F.coalesce((n >= 2) & some & close, F.lit(False)))


def records(rows: DataFrame, sheet: list[str], row: str, starts: Column, texts: list[str]) -> DataFrame:
    """Physical rows folded into records: a row that `starts` one, and those below that don't.

    sheet, record (from 1), first_row, rows, and each text joined by a space.
    """
    order = Window.partitionBy(*sheet).orderBy(row)
    numbered = rows.withColumn("record", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(order))
    joined = [
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col(row).alias("r"), F.col(c).alias("v"))))), lambda s: s["v"]), " ").alias(c)
        for c in texts
    ]
    return numbered.groupBy(*sheet, "record").agg(F.min(row).alias("first_row"), F.count(row).alias("rows"), *joined)


def ranges(numbers: DataFrame, group: list[str], number: str) -> DataFrame:
    """group, ranges: distinct whole numbers as '1-3, 7'."""
    order = Window.partitionBy(*group).orderBy(number)
    islands = numbers.select(*group, number).distinct().withColumn("_island", F.col(number) - F.row_number().over(order))
    spans = islands.groupBy(*group, "_island").agg(F.min(number).alias("low"), F.max(number).alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")))
    return spans.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", text.alias("t")))), lambda s: s["t"]), ", ").alias("ranges"))


def numbered(rows: DataFrame, order: Sequence[str], name: str, folder: str) -> DataFrame:
    """rows with `name`: their number, from 1, in one order over all of them. Rows are dealt by range and ordered in their parts; the driver sees no row, a join adds what stands before a part."""
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")
    parted = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, place), folder, f"parted_{name}")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a part
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def merged_intervals(intervals: DataFrame, group: list[str], low: str, high: str, gap: float = 0) -> DataFrame:
    """group, low, high, parts: intervals that overlap or lie within a gap of one another, joined."""
    order = Window.partitionBy(*group).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col(low) > reach + gap).cast("int"), F.lit(1))
    numbered = intervals.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(low).alias("parts")).drop("_island")


def chained(points: DataFrame, group: list[str], at: str, tolerance: float) -> DataFrame:
    """group, cluster, mean, size: points no further than the tolerance from the next are one cluster."""
    order = Window.partitionBy(*group).orderBy(at)
    starts = F.coalesce((F.col(at) - F.lag(at).over(order) > tolerance).cast("int"), F.lit(1))
    numbered = points.withColumn("_start", starts).withColumn("cluster", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "cluster").agg(F.avg(at).alias("mean"), F.count(at).alias("size"))


def weighted_median(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """group, median: the first value at which half of the weight is reached."""
    upto = Window.partitionBy(*group).orderBy(value)
    summed = rows.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    every = Window.partitionBy(*group)
    return (
        summed.withColumn("_upto", F.sum("_w").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(every))
        .where(F.col("_upto") * 2 >= F.col("_all")).groupBy(*group).agg(F.min(value).alias("median"))
    )


def modal(rows: DataFrame, group: list[str], value: str, weight: str, larger: bool = True) -> DataFrame:
    """group, mode: the value with the greatest weight; ties go to the larger or the smaller one."""
    summed = rows.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    tie = F.col(value) if larger else -F.col(value)
    return summed.groupBy(*group).agg(F.max_by(value, F.struct("_w", tie)).alias("mode"))


def unchanged_gaps(lines: DataFrame, group: list[str], at: str, changed: Column, context: int = 3) -> DataFrame:
    """lines with shown: a changed line, or one within `context` lines of a changed one."""
    around = Window.partitionBy(*group).orderBy(at).rowsBetween(-context, context)
    return lines.withColumn("shown", F.coalesce(F.max(changed.cast("int")).over(around) == 1, F.lit(False)))
