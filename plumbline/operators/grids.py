"""Tables that rules draw: grid lines of rules that hang together, how closed a grid is, its cells with what they span, and tables that go on over pages.

Rules are (axis h or v, at, low, high) on a page (one or more key columns). A page's rules meet in joins on the page; cells of a grid are folded one
grid at a time, and a grid has a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as t
from plumbline.operators.columns import column_tables, joined, line_tolerance, runs_of
from plumbline.operators.layout import TOUCH, anchored, rule_groups, shade_of
from plumbline.session import scratch, settled

#: How near rules of one grid line lie, the share of its edges that a grid must have drawn, its greatest number of columns and rows, how far a rule may be from one it meets.
SEGMENT, CLOSED, MOST_COLUMNS, MOST_ROWS, MEETS = 1.2, 0.75, 63, 256, 4.0
#: How far into its cell a line begins, and the greatest size of a shade, in sizes of the grid.
INTO, SHADE = 2.0, 1.8


def join_gap(body: Column) -> Column:
    """How far apart pieces of one rule may lie, by the size of the body's type (fixed values)."""
    return F.greatest(F.lit(4.0), 0.5 * body)


def joined_rules(rules: DataFrame, page: Sequence[str], gap: float | Column) -> DataFrame:
    """page, id, axis, at, low, high, thickness: rules on one height that overlap or nearly meet, as one. id is unique on its page."""
    page = [*page]
    placed = anchored(rules, [*page, "axis"], "at", SEGMENT)
    order = Window.partitionBy(*page, "axis", "anchor").orderBy("low", "high", "at")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("low") > reach + gap).cast("int"), F.lit(1))
    pieces = placed.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = pieces.groupBy(*page, "axis", "anchor", "_run").agg(F.min("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("thickness").alias("thickness"))
    return runs.select(*page, F.row_number().over(Window.partitionBy(*page).orderBy("axis", "at", "low")).alias("id"), "axis", "at", "low", "high", "thickness")


def _lines_at(rules: str, axis: str) -> Column:
    """The grid lines of an axis, rising: from the least rule on, one further than SEGMENT from the first of the line before begins the next; a line lies at the mean of its rules."""
    at = F.array_sort(F.transform(F.filter(rules, lambda r: (r["axis"] == axis) & r["at"].isNotNull()), lambda r: r["at"]))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.expr("cast(array() as array<double>)").alias("out"))
    done = lambda s: F.when(s["n"] > 0, F.array_append(s["out"], s["sum"] / s["n"])).otherwise(s["out"])

    def put(s: Column, v: Column) -> Column:
        near = s["anchor"].isNotNull() & (v - s["anchor"] <= SEGMENT)
        more = F.struct(s["anchor"].alias("anchor"), (s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n"), s["out"].alias("out"))
        return F.when(near, more).otherwise(F.struct(v.alias("anchor"), v.alias("sum"), F.lit(1).alias("n"), done(s).alias("out")))

    return F.aggregate(at, start, put, done)


def grids(rules: DataFrame, page: Sequence[str], tolerance: float = MEETS, folder: str | None = None) -> DataFrame:
    """page, grid, xs, ys, cols, rows, closed, rules of each group of rules (id, unique on its page) that draws two grid lines each way at least: closed is the share
    of the edges between neighbouring grid lines that a rule covers whole."""
    page, folder = [*page], folder or scratch(rules.sparkSession)
    kept = settled(rules.select(*page, "id", "axis", *[F.col(c).cast("double").alias(c) for c in ("at", "low", "high")]), folder, "rules")
    grouped = rule_groups(kept, page, tolerance, f"{folder}/groups").withColumnRenamed("component", "grid")
    grid = [*page, "grid"]
    parts = grouped.groupBy(*grid).agg(F.array_sort(F.collect_list(F.struct("axis", "at", "low", "high"))).alias("rules"))
    laid = parts.select(*grid, "rules", *[_lines_at("rules", axis).alias(name) for axis, name in (("v", "xs"), ("h", "ys"))])
    laid = laid.withColumn("cols", F.size("xs") - 1).withColumn("rows", F.size("ys") - 1).where(F.col("cols").between(1, MOST_COLUMNS) & F.col("rows").between(1, MOST_ROWS))

    def painted(axis: str, own: str, other: str) -> Column:
        """How many edges of the grid lines of one axis its rules cover."""
        at = lambda r: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.abs(F.get(own, i) - r["at"]) <= SEGMENT)
        edge = lambda r: F.filter(F.sequence(F.lit(0), F.size(other) - 2), lambda i: (r["low"] <= F.get(other, i) + SEGMENT) & (r["high"] >= F.get(other, i + 1) - SEGMENT))
        pairs = lambda r: F.flatten(F.transform(at(r), lambda a: F.transform(edge(r), lambda b: a * 1000 + b)))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter("rules", lambda r: r["axis"] == axis), pairs))))

    total = (F.col("rows") + 1) * F.col("cols") + (F.col("cols") + 1) * F.col("rows")
    closed = (painted("v", "xs", "ys") + painted("h", "ys", "xs")) / total
    return settled(laid.select(*grid, "xs", "ys", "cols", "rows", closed.alias("closed"), "rules"), folder, "laid")


def whole_grids(found: DataFrame) -> DataFrame:
    """Those of the grids that are tables: two columns and two rows at least, and closed enough."""
    return found.where((F.col("cols") >= 2) & (F.col("rows") >= 2) & (F.col("closed") >= CLOSED))


def boxes(found: DataFrame) -> DataFrame:
    """Those of the grids that are a bordered text: one closed cell. x, y, w, h tell where."""
    side = lambda c: (F.get(c, F.lit(0)), F.get(c, F.lit(1)) - F.get(c, F.lit(0)))
    (x, w), (y, h) = side("xs"), side("ys")
    return found.where((F.col("cols") == 1) & (F.col("rows") == 1) & (F.col("closed") >= CLOSED)).select("*", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def spanned(xs: list[float], ys: list[float], rules: list[tuple[str, float, float, float]]) -> list[tuple[int, int, int, int]]:
    """row, col, row_span, col_span of a grid's cells: from the top left on, a cell grows right and then down over edges that no rule touches."""
    def touching(axis: str, places: list[float]) -> list[list[tuple[float, float]]]:
        return [[(low, high) for a, at, low, high in rules if a == axis and abs(at - place) <= SEGMENT] for place in places]

    upright, level = touching("v", xs), touching("h", ys)

    def is_open(parts: list[tuple[float, float]], low: float, high: float) -> bool:
        return not any(a < high - SEGMENT and b > low + SEGMENT for a, b in parts)

    rows, cols = len(ys) - 1, len(xs) - 1
    free, out = [[True] * cols for _ in range(rows)], []
    for r in range(rows):
        for c in range(cols):
            if not free[r][c]:
                continue
            right, below = c + 1, r + 1
            while right < cols and free[r][right] and is_open(upright[right], ys[r], ys[r + 1]):
                right += 1
            while below < rows and free[below][c] and is_open(level[below], xs[c], xs[right]):
                below += 1
            for k in range(r, below):
                free[k][c:right] = [False] * (right - c)
            out.append((r, c, below - r, right - c))
    return out


def grid_cells(found: DataFrame, page: Sequence[str]) -> DataFrame:
    """page, grid, row, col, row_span, col_span, x, y, w, h of the cells of grids, merged where edges between them aren't drawn."""
    shape = T.StructType([*[found.schema[c] for c in (*page, "grid")], *T.StructType.fromDDL("row int, col int, row_span int, col_span int, x double, y double, w double, h double").fields])
    names = [f.name for f in shape]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for *key, xs, ys, rules in batch.itertuples(index=False):
                for r, c, down, right in spanned(list(xs), list(ys), [(p["axis"], p["at"], p["low"], p["high"]) for p in rules]):
                    made.append((*key, r, c, down, right, xs[c], ys[r], xs[c + right] - xs[c], ys[r + down] - ys[r]))
            yield pd.DataFrame(made, columns=names)

    return found.select(*page, "grid", "xs", "ys", "rules").mapInPandas(run, shape)


def shaded_cells(cells: DataFrame, fills: DataFrame, found: DataFrame, page: Sequence[str]) -> DataFrame:
    """cells with colour (of the smallest fill around a cell that isn't white nor much larger than the grid) and header: half of the cells of the first row are shaded."""
    grid = [*page, "grid"]
    span = lambda c: F.element_at(c, -1) - F.get(c, F.lit(0))
    sized = cells.join(found.select(*grid, (SHADE * F.greatest(F.lit(1.0), span("xs") * span("ys"))).alias("_most")), grid)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in page])
    told = sized.withColumn("_page", key).withColumn("id", F.concat_ws(":", "_page", "grid", "row", "col"))
    shades = shade_of(told, fills.withColumn("_page", key).select("_page", "colour", "x", "y", "w", "h"), "_page", 2.0, "_most")
    top = shades.where("row = 0").groupBy(*grid).agg((F.avg(F.col("colour").isNotNull().cast("double")) >= 0.5).alias("header"))
    return shades.join(top, grid).withColumn("header", F.col("header") & (F.col("row") == 0)).drop("_page", "id", "_most")


def tables_of_rules(rules: DataFrame, lines: DataFrame, page: Sequence[str], fills: DataFrame, folder: str | None = None) -> DataFrame:
    """page, grid, row, col, row_span, col_span, x, y, w, h, colour, header, lines of the cells of drawn tables that hold a line (x0, y): lines is how many begin in the cell."""
    page, folder = [*page], folder or scratch(rules.sparkSession)
    found = settled(whole_grids(grids(rules, page, TOUCH, folder)), folder, "grids")
    grid, x = [*page, "grid"], F.col("x0") + INTO
    within = lambda v, places: v.between(F.get(places, F.lit(0)) - SEGMENT, F.element_at(places, -1) + SEGMENT)
    held = lines.select(*page, "x0", F.col("y").alias("_y")).join(found.select(*grid, "xs", "ys"), page).where(within(x, F.col("xs")) & within(F.col("_y"), F.col("ys")))
    used = held.select(*grid).distinct()
    cells = shaded_cells(grid_cells(found.join(used, grid, "left_semi"), page), fills, found, page)
    begins = held.select(*grid, x.alias("_x"), "_y").join(cells.select(*grid, "row", "col", "x", "y", "w", "h"), grid).where((F.col("_x") >= F.col("x")) & (F.col("_x") < F.col("x") + F.col("w")) & (F.col("_y") >= F.col("y")) & (F.col("_y") < F.col("y") + F.col("h")))
    counts = begins.groupBy(*grid, "row", "col").agg(F.count("*").alias("lines"))
    return cells.join(counts, [*grid, "row", "col"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def ruled_tables(spans: DataFrame, rules: DataFrame, page: Sequence[str], body: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """tables (page, grid, key, cols, rows, missing) and rows (page, grid, row, cells) of grids that hold text.

    A cell's text are the spans whose middle lies in it, line by line. key tells grids of equal columns; missing is how many lines of text there are beyond the rows.
    """
    page, folder = [*page], folder or scratch(spans.sparkSession)
    # Only spans of pages with rules can lie in a grid; the others, mostly many more, are read once and left.
    spans = settled(spans.join(rules.select(*page).distinct(), page, "left_semi"), folder, "spans")
    bodies = spans.groupBy(*page).agg(F.max(body).alias("_body"))
    parts = joined_rules(rules.join(bodies, page), page, join_gap(F.col("_body")))
    found = settled(whole_grids(grids(parts, page, MEETS, folder)).drop("rules"), folder, "grids")
    runs = settled(runs_of(spans, page, body), folder, "runs")
    grid = [*page, "grid"]
    middle = F.col("x") + F.col("w") / 2
    slot = lambda v, places: F.array_position(F.transform(F.sequence(F.lit(0), F.size(places) - 2), lambda i: v.between(F.get(places, i) - SEGMENT, F.get(places, i + 1) + SEGMENT)), True).cast("int") - 1
    inside = runs.join(found.select(*grid, "xs", "ys"), page).withColumn("col", slot(middle, F.col("xs"))).withColumn("row", slot(F.col("y"), F.col("ys"))).where("col >= 0 and row >= 0").drop("xs", "ys")
    inside = settled(inside, folder, "inside")
    cell = [*grid, "row", "col"]
    placed = anchored(inside.drop("line"), cell, "y", line_tolerance(F.col(body)))
    span = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "w", "size")], "text")
    lines = placed.groupBy(*cell, "anchor").agg(F.array_sort(F.collect_list(F.struct("x", "seq", span.alias("s")))).alias("_s"), F.max(body).alias("_body"))
    texts = lines.select(*cell, "anchor", joined(F.transform("_s", lambda s: s["s"]), F.col("_body")).alias("text")).groupBy(*cell).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "text"))), lambda s: s["text"]), " ").alias("text"))
    squashed = t.js_trim(F.regexp_replace("text", f"[{t.SPACE}]+", " "))
    by_row = texts.groupBy(*grid, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", squashed.alias("text")))).alias("_m"))
    held = inside.groupBy(*grid).agg(F.count_distinct("line").alias("_lines"))
    rounded = F.array_join(F.transform("xs", lambda x: F.floor(x + 0.5).cast("string")), ",")
    tables = settled(
        found.join(held, grid).select(*grid, F.concat(F.lit("ruled-"), F.col("cols").cast("string"), F.lit("-"), rounded).alias("key"), "cols", "rows", F.greatest(F.lit(0), F.col("_lines") - F.col("rows")).alias("missing"), F.get("ys", F.lit(0)).alias("top"), F.get("xs", F.lit(0)).alias("left")),
        folder, "tables",
    )
    every = tables.select(*grid, "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    filled = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.coalesce(F.element_at("_m", c), F.lit("")))
    rows = every.join(by_row, [*grid, "row"], "left").select(*grid, "row", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(""), F.col("cols"))).otherwise(filled).alias("cells"))
    return tables, rows


def stitched(tables: DataFrame, doc: Sequence[str], page: str = "page") -> DataFrame:
    """tables with table (from 1): neighbours, in order of page and place, with one key on pages that follow each other are one."""
    order = Window.partitionBy(*doc).orderBy(page, "top", "left")
    goes_on = (F.lag("key").over(order) == F.col("key")) & (F.lag(page).over(order) + 1 == F.col(page))
    return tables.withColumn("_new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("table", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def detected_tables(spans: DataFrame, rules: DataFrame, doc: Sequence[str], body: str, tagged: DataFrame | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (doc, path, table, page, row, cells) and pages (doc, page, path; null if skipped) of the tables of documents.

    A ladder: tables that tags give (doc, table, page, row, cells), then grids that rules draw, then columns. A page is claimed by the first that finds a table on it, and the next look at
    the pages left. Tables of grids that go on over pages are one. A row's number is its place in its table.
    """
    doc, folder = [*doc], folder or scratch(spans.sparkSession)
    page = [*doc, "page"]
    found = []
    left_spans, left_rules = spans, rules
    if tagged is not None:
        found.append(tagged.select(*doc, F.lit("tagged").alias("path"), F.col("table").cast("long").alias("table"), "page", F.col("row").cast("double").alias("_at"), F.lit(0).alias("_part"), "cells"))
        gone = settled(tagged.select(*page).distinct(), folder, "tagged")
        left_spans, left_rules = spans.join(gone, page, "left_anti"), rules.join(gone, page, "left_anti")
    drawn, rows = ruled_tables(left_spans, left_rules, page, body, f"{folder}/ruled")
    whole = settled(stitched(drawn, doc), folder, "stitched")
    part = F.dense_rank().over(Window.partitionBy(*doc, "table").orderBy("page", "top", "left"))
    parts = whole.withColumn("_part", part).select(*page, "grid", "table", "_part")
    found.append(rows.join(parts, [*page, "grid"]).select(*doc, F.lit("ruled").alias("path"), "table", "page", F.col("row").cast("double").alias("_at"), "_part", "cells"))
    gone = settled(drawn.select(*page).distinct(), folder, "drawn")
    texts, _ = column_tables(left_spans.join(gone, page, "left_anti"), doc, body, f"{folder}/columns")
    found.append(texts.select(*doc, F.lit("columns").alias("path"), F.lit(1).cast("long").alias("table"), "page", F.col("line").alias("_at"), F.lit(0).alias("_part"), "cells"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = settled(every, folder, "every")
    nth = F.row_number().over(Window.partitionBy(*doc, "path", "table").orderBy("page", "_part", "_at"))
    out = every.withColumn("row", nth).select(*doc, "path", "table", "page", "row", "cells")
    claimed = every.groupBy(*page).agg(F.first("path").alias("path"))
    return out, spans.select(*page).distinct().join(claimed, page, "left")
