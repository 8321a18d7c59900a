"""What looks wrong with a table, as findings: one row a kind of trouble, the gravest first.

All cells are read once (exploded, one grouped aggregate a column and kind); rows and examples shown with a
finding are the first few, counts are of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators.headers import same_names
from plumbline.operators.tally import cells

#: Error values of spreadsheets, when codes that would be rewritten are told (a number, or a share of a column), and what is shown.
ERROR = r"^#(?:N/A|REF!|DIV/0!|VALUE!|NAME\?|NULL!|NUM!|SPILL!|CALC!|FIELD!|BLOCKED!|CONNECT!|UNKNOWN!|GETTING_DATA)$"
FEWEST, SHARE, ROWS, EXAMPLES = 3, 0.01, 500, 4
SEVERITY = {"unclosed-quote": "serious", "ragged-rows": "warning", "excel-error-cells": "warning", "leading-zeros": "warning", "invisible-characters": "warning", "duplicate-headers": "warning", "index-only-rows": "info"}
RANK = {"serious": 0, "warning": 1, "info": 2}


def cell_kinds(value: Column) -> Column:
    """The kinds of trouble of a trimmed value."""
    return F.array_compact(F.array(
        F.when(value.startswith("#") & value.rlike(ERROR), F.lit("excel-error-cells")), F.when(t.would_spreadsheet_change(value), F.lit("leading-zeros")),
        F.when(t.has_invisible(value), F.lit("invisible-characters")),
    ))


def column_troubles(long: DataFrame) -> DataFrame:
    """name, kind, cells, seen of long cells (row, name, value): how many of the filled cells seen have a kind of trouble, where that is worth telling."""
    known = long.select("row", "name", t.js_trim(F.coalesce("value", F.lit(""))).alias("value")).where("value <> ''").withColumn("kinds", cell_kinds(F.col("value")))
    seen = known.groupBy("name").agg(F.count("row").alias("seen"))
    hits = known.select("name", F.explode("kinds").alias("kind")).groupBy("name", "kind").agg(F.count("kind").alias("cells"))
    worth = (F.col("kind") != "leading-zeros") | (F.col("cells") >= FEWEST) | (F.col("cells") >= F.col("seen") * SHARE)
    return hits.join(seen, "name").where(worth)


def column_cards(long: DataFrame) -> DataFrame:
    """kind, count, columns, worst (the column with most), rows (the first 500): troubles of cells folded to one row a kind."""
    told = column_troubles(long)
    known = long.select("row", "name", cell_kinds(t.js_trim(F.coalesce("value", F.lit("")))).alias("kinds")).where(F.size("kinds") > 0)
    rows = known.select("row", "name", F.explode("kinds").alias("kind")).join(told.select("name", "kind"), ["name", "kind"], "left_semi").select("kind", "row").distinct()
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy("row"))).where(F.col("_k") <= ROWS).groupBy("kind").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return told.groupBy("kind").agg(F.sum("cells").alias("count"), F.count("name").alias("columns"), F.max_by("name", F.struct("cells", "name")).alias("worst")).join(first, "kind")


def ragged(grid: DataFrame, start: int = 0, swallowed: DataFrame | None = None) -> DataFrame:
    """_row of a grid (_row, cells) from start on whose width isn't the usual one; rows that an open quote swallowed aside."""
    usual = grid.groupBy(F.size("cells").alias("_w")).count().agg(F.max_by("_w", F.struct("count", "_w")).alias("_usual"))  # one row
    odd = grid.join(F.broadcast(usual), F.size("cells") != F.col("_usual")).where(F.col("_row") >= start).select("_row")
    return odd if swallowed is None else odd.join(swallowed.select("_row"), "_row", "left_anti")


def index_only(rows: DataFrame, columns: Sequence[str], index: str) -> DataFrame:
    """_row of rows that hold nothing but their number."""
    filled = lambda c: t.js_trim(F.coalesce(F.col(c), F.lit(""))) != ""
    empty = F.lit(True)
    for c in columns:
        if c != index:
            empty = empty & ~filled(c)
    return rows.where(filled(index) & empty).select("_row")


def report(rows: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None, index: str | None = None, ragged_rows: DataFrame | None = None, unclosed: DataFrame | None = None) -> DataFrame:
    """kind, severity, count, columns, worst, rows, place: all findings of a table (_row and columns), in the order in which to read them."""
    spark = rows.sparkSession
    found = column_cards(cells(rows, "_row", list(columns)))

    def of_rows(kind: str, frame: DataFrame) -> DataFrame:
        first = frame.orderBy("_row").limit(ROWS).agg(F.array_sort(F.collect_list("_row")).alias("rows"))
        return frame.agg(F.count("_row").alias("count")).crossJoin(first).where("count > 0").select(  # two single rows
            F.lit(kind).alias("kind"), "count", F.lit(0).cast("long").alias("columns"), F.lit(None).cast("string").alias("worst"), "rows",
        )

    for kind, frame in (("unclosed-quote", unclosed), ("ragged-rows", ragged_rows), ("index-only-rows", index_only(rows, columns, index) if index else None)):
        if frame is not None:
            found = found.unionByName(of_rows(kind, frame))
    clashing = same_names(names or [])
    if clashing:
        found = found.unionByName(spark.createDataFrame([("duplicate-headers", len(clashing), sum(map(len, clashing)), clashing[0][0], [])], "kind string, count long, columns long, worst string, rows array<long>"))
    severity = F.coalesce(*[F.when(F.col("kind") == k, s) for k, s in SEVERITY.items()])
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in RANK.items()])
    order = F.row_number().over(Window.orderBy(rank, F.desc("count"), "kind"))  # seven rows at most
    return found.withColumn("severity", severity).withColumn("place", order).select("place", "kind", "severity", "count", "columns", "worst", "rows")


def worst_severity(found: DataFrame) -> DataFrame:
    """severity: the gravest of all findings."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in RANK.items()])
    return found.agg(F.min_by("severity", rank).alias("severity"))
