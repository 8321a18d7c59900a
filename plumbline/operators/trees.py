"""Trees given as parent links, and the tables that tags in such trees tell of.

Nodes are (id, parent, ord, role) of a tree that some key columns tell: parent is null at the root, ord orders siblings. Paths from the root are found by pointer jumping: each round
joins a node's path so far with that of the ancestor it reaches, so their lengths double, and a tree of any depth takes as many rounds as its depth has binary digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators.columns import joined, line_tolerance
from plumbline.operators.layout import anchored
from plumbline.operators.sequences import merged_intervals
from plumbline.session import drop, scratch, settled, shuffled

#: Roles of tables, of groups of rows, of rows and of cells.
TABLE, GROUPS, ROW, CELLS = "Table", ("THead", "TBody", "TFoot"), "TR", ("TH", "TD")


def tree_paths(nodes: DataFrame, tree: Sequence[str], folder: str | None = None, rounds: int = 30) -> DataFrame:
    """tree, id, role, path: from the root to the node itself, (ord, id, role) each. Paths sort as the tree is read, parents first.

    Nodes whose parent is missing are roots; nodes on a circle, which no root reaches, are left out.
    """
    tree, folder = [*tree], folder or scratch(nodes.sparkSession)
    own = F.array(F.struct("ord", "id", "role"))
    known = nodes.select(*tree, F.col("id").alias("_parent")).distinct()
    now = shuffled(nodes.select(*tree, "id", F.col("parent").alias("_parent"), "role", own.alias("path"))).join(shuffled(known.withColumn("_known", F.lit(True))), [*tree, "_parent"], "left")
    now = settled(now.select(*tree, "id", F.when(F.col("_known"), F.col("_parent")).alias("_up"), "role", "path"), folder, "paths0")
    now = shuffled(now)
    ended = -1
    for k in range(1, rounds + 1):
        above = now.select(*tree, F.col("id").alias("_up"), F.col("_up").alias("_far"), F.col("path").alias("_path"))
        # Nodes that have reached a root stay out of the join: a key that is null would bring them all to one task.
        further = now.where("_up is not null").join(above, [*tree, "_up"], "left").select(*tree, "id", F.col("_far").alias("_up"), "role", F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
        now = shuffled(settled(further.unionByName(now.where("_up is null").select(further.columns)), folder, f"paths{k}"))
        drop(now.sparkSession, f"{folder}/paths{k - 1}")
        done = now.where("_up is null").count()
        if done == ended:  # all that a root reaches; what goes on runs in circles
            break
        ended = done
    return now.where("_up is null").select(*tree, "id", "role", "path")


def nearest(path: Column, roles: Sequence[str], itself: bool = True) -> Column:
    """The id of the last node of a path that has one of some roles; null if none does."""
    some = path if itself else F.slice(path, 1, F.size(path) - 1)
    return F.try_element_at(F.filter(some, lambda n: n["role"].isin(*roles)), F.lit(-1))["id"]


def tree_cells(paths: DataFrame, tree: Sequence[str]) -> DataFrame:
    """tree, cell (a node's id), table, row, col (from 0 each): the cells of tables, by their places in the tree. Rows lie in a table or in a group of rows in it."""
    tree = [*tree]
    at = lambda k: F.try_element_at("path", F.lit(-k))
    order = F.transform("path", lambda n: n["ord"])
    tables = paths.where(F.col("role") == TABLE).withColumn("table", F.row_number().over(Window.partitionBy(*tree).orderBy(order)) - 1).select(*tree, F.col("id").alias("_table"), "table")
    deep = paths.where((F.col("role") == ROW) & (F.size("path") >= 2))
    grouped = at(2)["role"].isin(*GROUPS) & (F.size("path") >= 3)
    holder = F.when(at(2)["role"] == TABLE, at(2)["id"]).when(grouped, F.when(F.get("path", F.size("path") - 3)["role"] == TABLE, F.get("path", F.size("path") - 3)["id"]))
    rows = deep.withColumn("_table", holder).where("_table is not null")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy(*tree, "_table").orderBy(order)) - 1).select(*tree, F.col("id").alias("_row"), "_table", "row").join(tables, [*tree, "_table"])
    cells = paths.where(F.col("role").isin(*CELLS) & (F.size("path") >= 2)).withColumn("_row", at(2)["id"]).join(rows, [*tree, "_row"])
    col = F.row_number().over(Window.partitionBy(*tree, "_row").orderBy(at(1)["ord"])) - 1
    return cells.select(*tree, F.col("id").alias("cell"), "table", "row", col.alias("col"))


def tagged_cells(spans: DataFrame, marks: DataFrame, paths: DataFrame, page: Sequence[str]) -> DataFrame:
    """spans (mark, …) with table, row, col: of the nearest cell around the node that their mark (mark, node) belongs to; only those in a cell."""
    page = [*page]
    cells = tree_cells(paths, page)
    # What is made of a small file, many rows from each of its own, is taken for as small as the file.
    around = shuffled(paths).select(*page, F.col("id").alias("node"), F.posexplode(F.transform("path", lambda n: n["id"])).alias("_depth", "cell")).join(shuffled(cells), [*page, "cell"])
    owner = around.groupBy(*page, "node").agg(F.max_by(F.struct("table", "row", "col"), "_depth").alias("_c")).select(*page, "node", "_c.*")
    of_mark = shuffled(marks).join(shuffled(owner), [*page, "node"]).select(*page, "mark", "table", "row", "col")
    return shuffled(spans.where(F.length(t.js_trim(F.col("text"))) > 0)).join(shuffled(of_mark), [*page, "mark"])


def tagged_tables(spans: DataFrame, nodes: DataFrame, marks: DataFrame, doc: Sequence[str], body: str, folder: str | None = None) -> DataFrame:
    """doc, table (from 1), page, row (the tree's), cells of the tables that tags tell of, each page with a tree of its own.

    Columns are where the cells of a table, on all pages, cover a page's width, as an empty cell may be missing in the tree; a cell goes to the column that holds its middle, else to the
    nearest. A table that goes on on the next page is one table; one with a single row, column or filled cell is none.
    """
    doc, folder = [*doc], folder or scratch(spans.sparkSession)
    page = [*doc, "page"]
    placed = shuffled(settled(tagged_cells(spans, marks, tree_paths(nodes, page, f"{folder}/tree"), page), folder, "placed"))
    cell = [*page, "table", "row", "col"]
    extent = placed.groupBy(*cell).agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    bands = merged_intervals(extent, [*doc, "table"], "x0", "x1").groupBy(*doc, "table").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_bands"))
    middle = (F.col("x0") + F.col("x1")) / 2
    away = F.transform("_bands", lambda b, i: F.struct(F.when(middle.between(b["low"], b["high"]), -1.0).otherwise(F.least(F.abs(middle - b["low"]), F.abs(middle - b["high"]))).alias("d"), i.alias("i")))
    banded = extent.join(bands, [*doc, "table"]).select(*cell, F.array_min(away)["i"].alias("_band"), F.size("_bands").alias("_cols"))
    lined = anchored(placed, cell, "y", line_tolerance(F.col(body)))
    span = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "w", "size")], "text")
    lines = lined.groupBy(*cell, "anchor").agg(F.array_sort(F.collect_list(F.struct("x", "seq", span.alias("s")))).alias("_s"), F.max(body).alias("_body"))
    texts = lines.select(*cell, "anchor", joined(F.transform("_s", lambda s: s["s"]), F.col("_body")).alias("text")).groupBy(*cell).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "text"))), lambda s: s["text"]), " ").alias("text"))
    row = [*page, "table", "row"]
    in_band = texts.join(shuffled(banded), cell).groupBy(*row, "_band", "_cols").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " ").alias("text"))
    rows = in_band.groupBy(*row, "_cols").agg(F.map_from_entries(F.collect_list(F.struct("_band", "text"))).alias("_m"))
    rows = shuffled(settled(rows.select(*row, F.transform(F.sequence(F.lit(0), F.col("_cols") - 1), lambda c: F.coalesce(F.element_at("_m", c), F.lit(""))).alias("cells")), folder, "rows"))
    pages = rows.select(*page, "table").distinct()
    order = Window.partitionBy(*doc, "table").orderBy("page")
    parts = pages.withColumn("_part", F.col("page") - F.row_number().over(order))
    sized = rows.join(parts, [*page, "table"]).groupBy(*doc, "table", "_part").agg(F.count("*").alias("_rows"), F.max(F.size("cells")).alias("_cols"), F.sum(F.size(F.filter("cells", lambda c: t.js_trim(c) != ""))).alias("_filled"), F.min("page").alias("_first"))
    kept = sized.where((F.col("_rows") >= 2) & (F.col("_cols") >= 2) & (F.col("_filled") > 1))
    numbered = kept.withColumn("_number", F.row_number().over(Window.partitionBy(*doc).orderBy("_first", "table", "_part"))).select(*doc, "table", "_part", "_number")
    return rows.join(parts, [*page, "table"]).join(shuffled(numbered), [*doc, "table", "_part"]).select(*doc, F.col("_number").alias("table"), "page", "row", "cells")
