"""Found tables as sheets: records of several lines put together, headers that come again taken out, columns and cells typed, rows flagged, and each row's way back to its lines.

Lines are (table: some key columns; row: their order in it; page, cells, and overflow where a text was wider than its column). Nothing is lost on the way: a line is a source of one kept record or of a
removed one, which tells why.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import dates
from plumbline.functions import text as t
from plumbline.functions.numbers import fits, reading, typed_reading
from plumbline.session import scratch, settled

#: Values of a column at least, the share of one kind that types it, decimals shown at most.
SAMPLES, SHARE, DECIMALS = 3, 0.6, 4
#: What flags say.
SAID = {"balance": "Balance doesn’t add up", "type": "Something here isn’t a number", "overflow": "Text wider than its column", "sparse": "Almost nothing on this row", "pageBreak": "Split across two pages"}


@dataclass(frozen=True)
class Sheets:
    """rows: table, record (from 1), is_header, cells, typed (kind, iso, number, text, off_type a cell), page, end_page, flags, reasons, ok, sources. columns: table, col, header, kind, decimals, order, samples.
    removed: table, sources, reason. sheets: table, rows, dropped, confidence, pages, ambiguous (dates that could be read two ways were)."""

    rows: DataFrame
    columns: DataFrame
    removed: DataFrame
    sheets: DataFrame


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c != ""))


def _read(cells: str) -> Column:
    """What is read of trimmed cells."""
    return F.transform(cells, reading)


def column_types(rows: DataFrame, table: Sequence[str]) -> DataFrame:
    """table, col (from 0), kind (date, money, number, text), decimals, order (of days and months), samples, ambiguous of the columns of rows' cells, or of what was read of them (read)."""
    table = [*table]
    read = F.col("read") if "read" in rows.columns else F.transform("cells", lambda c: reading(t.js_trim(c)))
    told = rows.select(*table, F.posexplode(read).alias("col", "_r"))
    vote = lambda order: F.count_if((F.col("_r.order") == order) & ~F.col("_r.ambiguous"))
    # Blank cells are no samples, but tell that there is a column.
    by = told.groupBy(*table, "col").agg(
        F.count_if("_r.some").alias("samples"), F.count_if(F.col("_r.value").isNotNull()).alias("_amounts"), F.coalesce(F.max(F.col("_r.decimals")), F.lit(0)).alias("_decimals"), F.coalesce(F.max("_r.rich"), F.lit(False)).alias("_rich"),
        vote("dmy").alias("_days"), vote("mdy").alias("_months"), F.count_if("_r.ambiguous").alias("_either"), F.count_if(F.col("_r.y").isNotNull()).alias("_dates"),
    ).withColumn("order", dates.column_order(F.col("_days"), F.col("_months"), F.col("_either")))
    enough = F.col("samples") >= SAMPLES
    share = lambda c: F.try_divide(F.col(c), F.col("samples"))
    kind = F.when(enough & (share("_dates") >= SHARE), "date").when(enough & (share("_amounts") >= SHARE), F.when(F.col("_rich"), "money").otherwise("number")).otherwise("text")
    return by.select(*table, "col", kind.alias("kind"), F.least(F.lit(DECIMALS), F.col("_decimals")).alias("decimals"), "order", "samples", (F.col("_either") > 0).alias("ambiguous"))


def reasons(flags: Column, page: Column, end_page: Column) -> Column:
    """What a row's flags say, joined by semicolons."""
    said = F.create_map(*[F.lit(x) for pair in SAID.items() for x in pair])
    split = F.concat(F.lit("Split across pages "), page.cast("string"), F.lit(" and "), end_page.cast("string"))
    return F.array_join(F.transform(flags, lambda f: F.when((f == "pageBreak") & (end_page > page), split).otherwise(F.element_at(said, f))), "; ")


def confidence(rows: DataFrame, table: Sequence[str], ok: str = "ok") -> DataFrame:
    """table, confidence: the share of a table's rows that are right."""
    return rows.groupBy(*table).agg(F.avg(F.col(ok).cast("double")).alias("confidence"))


def sheets(lines: DataFrame, table: Sequence[str], money: DataFrame | None = None, folder: str | None = None) -> Sheets:
    """The sheets of tables. money (table, cols: columns that hold it) is told by the types of all lines where it isn't given.

    A record begins where the first cell or a money column is filled; lines below add to it. Records equal to the first, spaces aside, are headers that come again. A first record without an amount is the header.
    """
    table, folder = [*table], folder or scratch(lines.sparkSession)
    over = F.coalesce(F.col("overflow"), F.lit(False)) if "overflow" in lines.columns else F.lit(False)
    rows = lines.select(*table, "row", "page", F.transform("cells", lambda c: t.js_trim(F.coalesce(c, F.lit("")))).alias("cells"), over.alias("overflow"))
    # A cell is read once; what was read goes with it to its record, its column's type and its own.
    rows = rows.withColumn("read", _read("cells"))
    if money is None:
        rows = settled(rows, folder, "rows")
        money = column_types(rows, table).where(F.col("kind").isin("money", "number")).groupBy(*table).agg(F.collect_list("col").alias("cols"))
    told = rows.join(money, table, "left").withColumn("cols", F.coalesce("cols", F.expr("cast(array() as array<int>)")))
    order = Window.partitionBy(*table).orderBy("row")
    begins = (F.row_number().over(order) == 1) | (F.coalesce(F.get("cells", F.lit(0)), F.lit("")) != "") | F.exists("cols", lambda c: F.coalesce(F.get("cells", c), F.lit("")) != "")
    numbered = told.withColumn("_begins", begins.cast("int")).withColumn("_record", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = numbered.groupBy(*table, "_record").agg(F.array_sort(F.collect_list(F.struct("row", "cells", "page", "read"))).alias("_l"), F.max("overflow").alias("overflow"))
    width = F.array_max(F.transform("_l", lambda x: F.size(x["cells"])))
    cell = lambda c: F.array_join(F.filter(F.transform("_l", lambda x: F.coalesce(F.get(x["cells"], c), F.lit(""))), lambda v: v != ""), " ")
    pages = F.transform("_l", lambda x: x["page"])
    first, one = F.get("_l", F.lit(0)), F.size("_l") == 1
    several = F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), cell)).otherwise(F.expr("cast(array() as array<string>)"))
    records = gathered.select(
        *table, "_record", "overflow", "_l", F.when(one, first["cells"]).otherwise(several).alias("cells"),
        F.get(pages, F.lit(0)).alias("page"), F.array_max(pages).alias("end_page"), F.transform("_l", lambda x: x["row"]).alias("sources"),
    )
    # Only a cell that other lines add to is read again.
    again = F.transform("cells", lambda v, c: F.when(F.get(first["cells"], c) == v, F.get(first["read"], c)).otherwise(reading(v)))
    records = records.withColumn("read", F.when(one, first["read"]).otherwise(again)).drop("_l")
    key = F.array_join(F.filter("cells", lambda c: c != ""), "")
    every = Window.partitionBy(*table)
    filled = records.withColumn("_key", key).withColumn("_first", F.min(F.when(F.col("_key") != "", F.col("_record"))).over(every))
    is_head = (_filled(F.col("cells")) >= 2) & ~F.exists("read", lambda r: r["value"].isNotNull())
    judged = filled.withColumn("_head", F.max(F.when(F.col("_record") == F.col("_first"), F.struct(F.col("_key").alias("key"), is_head.alias("is_head")))).over(every))
    judged = judged.withColumn("reason", F.when(F.col("_key") == "", "blank").when((F.col("_key") == F.col("_head.key")) & (F.col("_record") != F.col("_first")), "header-repeated"))
    upto = Window.partitionBy(*table).orderBy("_record").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("record", F.count_if(F.col("reason").isNull()).over(upto).cast("int")).withColumn("is_header", F.col("_head.is_head") & (F.col("record") == 1))
    judged = settled(judged.drop("_key", "_first", "_head", "_record"), folder, "records")
    kept = judged.where("reason is null").drop("reason")
    types = column_types(kept.where("not is_header"), table)
    named = kept.where("is_header").select(*table, F.posexplode("cells").alias("col", "header"))
    typed = types.join(named, [*table, "col"], "full").select(*table, "col", "header", F.coalesce("kind", F.lit("text")).alias("kind"), F.coalesce("decimals", F.lit(0)).alias("decimals"), "order", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    typed = settled(typed, folder, "columns")
    # A record's cells are typed where they lie; only what a table's columns are comes to them.
    shape = typed.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("col", "kind", "order"))).alias("_shape"))
    blank = reading(F.lit(""))

    def typed_as(c: Column) -> Column:
        raw = F.coalesce(F.get("cells", c["col"]), F.lit(""))
        as_text = F.struct(F.when(raw == "", "empty").otherwise("text").alias("kind"), F.lit(None).cast("string").alias("iso"), F.lit(None).cast("double").alias("number"), F.when(raw != "", raw).alias("text"), F.lit(False).alias("off_type"))
        as_read = F.transform(F.array(F.coalesce(F.get("read", c["col"]), blank)), lambda r: typed_reading(raw, r, c["kind"], c["order"]))[0]
        return F.when(F.col("is_header") | (c["kind"] == "text"), as_text).otherwise(as_read)

    off = F.exists("_shape", lambda c: (c["kind"] != "text") & (F.coalesce(F.get("cells", c["col"]), F.lit("")) != "") & ~fits(F.get("read", c["col"]), c["kind"], c["order"]))
    out = kept.join(shape, table).withColumn("typed", F.transform("_shape", typed_as)).withColumn("_off", ~F.col("is_header") & off).drop("_shape", "read")
    flag = lambda on, name: F.when(on, F.array(F.lit(name))).otherwise(F.expr("cast(array() as array<string>)"))
    flags = F.concat(flag(F.col("overflow"), "overflow"), flag(F.col("end_page") > F.col("page"), "pageBreak"), flag(_filled(F.col("cells")) < 2, "sparse"), flag(F.col("_off"), "type"))
    out = out.withColumn("flags", flags).withColumn("ok", F.size("flags") == 0)
    final = out.select(*table, "record", "is_header", "cells", "typed", "page", "end_page", "flags", reasons(F.col("flags"), F.col("page"), F.col("end_page")).alias("reasons"), "ok", "sources")
    gone = judged.where("reason is not null").select(*table, "sources", "reason")
    dropped = gone.where("reason = 'header-repeated'").groupBy(*table).agg(F.count("*").alias("dropped"))
    votes = typed.where("ambiguous and kind = 'date'").groupBy(*table).agg(F.lit(True).alias("ambiguous"))
    whole = final.groupBy(*table).agg(F.count("*").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("page", "end_page"))))).alias("pages"), F.avg(F.col("ok").cast("double")).alias("confidence"))
    whole = whole.join(dropped, table, "left").join(votes, table, "left").withColumn("dropped", F.coalesce("dropped", F.lit(0))).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    return Sheets(final, typed, gone, whole)


def laid_out(made: Sheets, table: Sequence[str]) -> DataFrame:
    """table, record, values: rows as written, the header first, with the page as a column where a sheet has several and what is wrong where something is."""
    table = [*table]
    body = made.rows.where("not is_header")
    shape = body.groupBy(*table).agg(F.max(F.size("flags") > 0).alias("_checks")).join(made.sheets.select(*table, (F.size("pages") > 1).alias("_pages")), table)
    names = made.columns.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("col", F.when(F.coalesce(t.js_trim(F.col("header")), F.lit("")) != "", t.js_trim(F.col("header"))).otherwise(F.concat(F.lit("Column "), (F.col("col") + 1).cast("string"))).alias("n")))).alias("_n"))
    some = lambda on, v: F.when(on, F.array(v)).otherwise(F.expr("cast(array() as array<string>)"))
    head = names.join(shape, table).select(*table, F.lit(0).alias("record"), F.concat(F.transform("_n", lambda x: x["n"]), some(F.col("_pages"), F.lit("Page")), some(F.col("_checks"), F.lit("Check"))).alias("values"))
    rows = body.join(shape, table).select(*table, "record", F.concat("cells", some(F.col("_pages"), F.col("page").cast("string")), some(F.col("_checks"), F.col("reasons"))).alias("values"))
    return head.unionByName(rows)
