"""What runs along the pages of documents: heads and feet with their page numbers, and the margins that the rest keeps.

Lines are (page, y, x0, x1, text, artifact: all of it is tagged as no content) with the places of their glyphs (top, bottom); pages have a number from 1, width and height. A page
shows a few such lines, so what is folded in order is a document's distinct heights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.session import scratch, settled

#: Where heads end and feet begin, in heights of a page, also where tags tell; how near heights of one row are; lines of a zone at most.
HEAD, FOOT, HALF, NEAR, MOST = 0.09, 0.9, 0.5, 3.0, 3
#: Pages of a small document, on how many of its pages a line must be, the share of pages in others, how near to the middle a line is centred, in widths.
SMALL, TWICE, SHARE, CENTRE = 3, 2, 0.6, 0.02
#: The edge and margin where nothing tells, the usual margins, how near to one of them, and the greatest, in sizes of the page.
EDGE, MARGIN, USUAL, SNAP, GREATEST = 36.0, 72.0, (36.0, 54.0, 72.0, 90.0, 108.0), 2.0, 0.45


def _zones(lines: DataFrame, pages: DataFrame, doc: Sequence[str]) -> DataFrame:
    """lines in the zones of heads and feet, by tags in documents that have them there. A zone of more than a few lines on a page is none."""
    page = [*doc, "page"]
    sized = lines.where(F.length(t.js_trim(F.col("text"))) > 0).join(pages.select(*page, "width", "height"), page)
    high = F.when(F.col("height") > 0, F.col("height")).otherwise(1.0)
    plain = F.when(F.col("y") <= HEAD * high, "header").when(F.col("y") >= FOOT * high, "footer")
    tagged = F.when(F.col("artifact"), F.when(F.col("y") < HALF * high, "header").otherwise("footer"))
    told = sized.withColumn("_z", F.explode(F.array(F.struct(tagged.alias("zone"), F.lit(True).alias("tagged")), F.struct(plain.alias("zone"), F.lit(False).alias("tagged"))))).select("*", "_z.*").drop("_z").where("zone is not null")
    few = told.withColumn("_n", F.count("*").over(Window.partitionBy(*page, "zone", "tagged"))).where(F.col("_n") <= MOST).drop("_n")
    zone = [*doc, "zone"]
    tags = few.groupBy(*zone).agg(F.max("tagged").alias("_tags"))
    return few.join(tags, zone).where(F.col("tagged") == F.col("_tags")).drop("_tags")


def _rows(zones: DataFrame, doc: Sequence[str]) -> DataFrame:
    """zones with row: the height, in the order of pages the first, that theirs is near."""
    zone = [*doc, "zone"]
    heights = zones.groupBy(*zone, F.col("y").alias("_y")).agg(F.min("page").alias("_p")).groupBy(*zone).agg(F.array_sort(F.collect_list(F.struct("_p", "_y"))).alias("_h"))
    near = lambda a, y: F.abs(a - y) <= NEAR
    found = F.aggregate("_h", F.expr("cast(array() as array<double>)"), lambda rows, h: F.when(F.exists(rows, lambda r: near(r, h["_y"])), rows).otherwise(F.array_append(rows, h["_y"])))
    return zones.join(heights.select(*zone, found.alias("_rows")), zone).withColumn("row", F.get(F.filter("_rows", lambda r: near(r, F.col("y"))), F.lit(0))).drop("_rows")


def running(lines: DataFrame, pages: DataFrame, doc: Sequence[str], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """heads (doc, zone, nth, y, text, template, shape, pages, align, fields) and members (doc, zone, nth, page, y) of running heads and feet.

    Lines at one height that agree, digits aside, on enough of a document's pages run; of several wordings at a height the commonest does, and of rows the first
    few. Numbers that are the page's on all its pages are fields (`page`), as are later ones that are always the number of pages (`pages`); template has them in braces.
    """
    doc, folder = [*doc], folder or scratch(lines.sparkSession)
    zone = [*doc, "zone"]
    every = pages.groupBy(*doc).agg(F.count("*").alias("_total"))
    shape = t.js_trim(F.regexp_replace("text", "[0-9]+", "#"))
    placed = settled(_rows(_zones(lines.withColumn("y", F.col("y").cast("double")), pages, doc), doc).withColumn("shape", shape), folder, "placed")
    first = Window.partitionBy(*zone, "row", "shape", "page").orderBy("y", "x0")
    ones = placed.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    variants = ones.groupBy(*zone, "row", "shape").agg(F.count("*").alias("pages"), F.min(F.struct("page", "y", "x0")).alias("_first"), F.max("tagged").alias("_tagged"))
    best = variants.groupBy(*zone, "row").agg(F.max_by(F.struct("shape", "pages", "_first", "_tagged"), F.struct("pages", -F.col("_first.page"), -F.col("_first.y"), -F.col("_first.x0"))).alias("_b")).select(*zone, "row", "_b.*")
    repeat = F.when(F.col("_total") <= SMALL, F.lit(TWICE)).otherwise(F.ceil(SHARE * F.col("_total")))
    need = F.when(F.col("_tagged"), F.least(repeat, F.col("_total"))).otherwise(repeat)
    some = best.join(every, doc).where(F.col("pages") >= need)
    kept = some.withColumn("nth", F.row_number().over(Window.partitionBy(*zone).orderBy("row"))).where(F.col("nth") <= MOST)
    head = [*zone, "nth"]
    group = settled(ones.join(kept.select(*zone, "row", "shape", "nth", "_total", "pages"), [*zone, "row", "shape"]), folder, "group")
    width = F.col("width")
    left, right = F.col("x0"), width - F.col("x1")
    align = F.when(F.abs(left - right) <= CENTRE * width, "center").when(right < left, "right").otherwise("left")
    lead = group.groupBy(*head, "row", "shape", "pages", "_total").agg(F.min_by(F.struct("text", align.alias("align")), "page").alias("_r"))
    digits = F.regexp_extract_all("text", F.lit("([0-9]+)"))
    many = group.select(*head, "page", "_total", digits.alias("_d"))
    same = many.groupBy(*head).agg(F.min(F.size("_d")).alias("_a"), F.max(F.size("_d")).alias("_b"), F.count("*").alias("_n")).where((F.col("_a") == F.col("_b")) & (F.col("_n") >= 2)).select(*head)
    slots = many.join(same, head).select(*head, "page", "_total", F.posexplode("_d").alias("slot", "_v")).withColumn("_v", F.col("_v").try_cast("double"))
    told = slots.groupBy(*head, "slot").agg(F.every(F.col("_v") == F.col("page")).alias("_page"), F.every(F.col("_v") == F.col("_total")).alias("_pages"))
    before = F.coalesce(F.max(F.col("_page").cast("int")).over(Window.partitionBy(*head).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    fields = told.withColumn("field", F.when(F.col("_page"), "page").when(F.col("_pages") & before, "pages")).where("field is not null").groupBy(*head).agg(F.map_from_entries(F.collect_list(F.struct("slot", "field"))).alias("fields"))
    none = F.expr("cast(map() as map<int,string>)")
    heads = lead.join(fields, head, "left").withColumn("fields", F.coalesce("fields", none)).select(
        *head, F.col("row").alias("y"), F.col("_r.text").alias("text"), _template(F.col("_r.text"), F.col("fields")).alias("template"), "shape", "pages", F.col("_r.align").alias("align"), "fields",
    )
    return heads, group.select(*head, "page", "y", "top", "bottom", "height")


def _template(text: Column, fields: Column) -> Column:
    """text with the numbers that are fields in braces."""
    between, numbers = F.split(text, "[0-9]+"), F.regexp_extract_all(text, F.lit("([0-9]+)"))
    shown = lambda n, i: F.when(F.element_at(fields, i).isNotNull(), F.concat(F.lit("{"), F.element_at(fields, i), F.lit("}"))).otherwise(n)
    pieces = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(F.transform(numbers, shown), i), F.lit(""))))
    return F.array_join(pieces, "")


def snapped(value: Column, limit: Column) -> Column:
    """A margin: the usual one if it is near one, within the page."""
    held = F.greatest(F.lit(0.0), F.least(GREATEST * limit, value))
    return F.when(value.isNotNull(), F.coalesce(*[F.when(F.abs(held - u) <= SNAP, u) for u in USUAL], held))


def margins(lines: DataFrame, pages: DataFrame, members: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, top, right, bottom, left, header, footer of each document: how far its lines, but running ones and artifacts, stay from the edges of its first page.

    Text that never comes near the bottom tells nothing of it, so the bottom margin is no larger than the top one. `members` are those of `running`; lines inside drawn tables, which may overhang, are to be
    left out before (`layout.outside`).
    """
    doc = [*doc]
    page = [*doc, "page"]
    sizes = pages.groupBy(*doc).agg(F.min_by(F.struct("width", "height"), "page").alias("_s")).select(*doc, "_s.*")
    own = lines.where(~F.col("artifact") & (F.length(t.js_trim(F.col("text"))) > 0)).withColumn("y", F.col("y").cast("double")).join(members.select(*page, "y"), [*page, "y"], "left_anti")
    extent = own.groupBy(*doc).agg(F.min("top").alias("_top"), F.min("x0").alias("_left"), F.max("x1").alias("_right"), F.max("y").alias("_base"))
    edges = members.groupBy(*doc).agg(
        F.greatest(F.lit(0.0), F.min(F.when(F.col("zone") == "header", F.col("top")))).alias("_header"), F.greatest(F.lit(0.0), F.min(F.when(F.col("zone") == "footer", F.col("height") - F.col("bottom")))).alias("_footer"),
    )
    told = sizes.join(extent, doc, "left").join(edges, doc, "left")
    top = F.coalesce(snapped(F.col("_top"), F.col("height")), F.lit(MARGIN))
    bottom = F.when(F.col("_base").isNotNull(), F.least(snapped(F.col("height") - F.col("_base"), F.col("height")), top)).otherwise(MARGIN)
    edge = lambda c, most: F.least(snapped(F.coalesce(F.when(F.col(f"_has_{c}"), F.col(c)), F.lit(EDGE)), F.col("height")), most)
    zones = members.groupBy(*doc).agg(F.max(F.col("zone") == "header").alias("_has__header"), F.max(F.col("zone") == "footer").alias("_has__footer"))
    told = told.join(zones, doc, "left").withColumn("_has__header", F.coalesce("_has__header", F.lit(False))).withColumn("_has__footer", F.coalesce("_has__footer", F.lit(False)))
    return told.select(
        *doc, top.alias("top"), F.when(F.col("_right").isNotNull(), snapped(F.col("width") - F.col("_right"), F.col("width"))).otherwise(MARGIN).alias("right"), bottom.alias("bottom"),
        F.when(F.col("_left").isNotNull(), snapped(F.col("_left"), F.col("width"))).otherwise(MARGIN).alias("left"), edge("_header", top).alias("header"), edge("_footer", bottom).alias("footer"),
    )
