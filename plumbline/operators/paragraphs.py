"""Paragraphs, headings and lists from the lines of a page's columns, and the tab stops that lines share.

A column is told by some key columns; its lines have y, x0, x1, size, text, and may have stops (where their fragments after the first begin), marker_x and text_x (of a list's mark and the
text after it), bold. left and right are the column's edges, body and leading the document's size of type and distance of lines. A column's lines are gathered once,
as what breaks a paragraph depends on the lines before it; a page has some hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as t

#: Sizes of type that count as one, the leading where none is known, the gap that ends a paragraph in leadings, gaps remembered.
SIZES, LEADING, GAP, HISTORY, FALLBACK = 0.6, 1.15, 1.3, 5, 11.0
#: Indents that begin a paragraph, in sizes and, after a list's mark, in points; how short a line is that ends one, in sizes; the gap after a mark.
INDENT, HANGING, SHORT, AFTER_MARK = 0.5, 2.0, 2.5, 1.2
#: Fixed values of alignment: how near to the middle in widths and sizes, near edges, the spread of a left edge, shares of lines, lines of a justified block, the width of a centred line.
CENTRE, CENTRE_SIZES, EDGE, VARIES, MOSTLY, JUSTIFIED, BLOCK, NARROW = 0.02, 0.15, 1.5, 3.0, 0.7, 0.8, 3, 0.8
#: Fixed values of headings: sizes in those of the body, lines at most, how far to the right they reach, the deepest; of indents: what counts as one, and their step.
RATIOS, LINES, REACH, DEEPEST, FIRST, STEP = (1.7, 1.3, 1.08), 2, 0.7, 6, 1.0, 3.0
#: Fixed values of tab stops: how near they are, and lines that share them at least.
STOP, RUN = 3.0, 3


def body_metrics(spans: DataFrame, lines_: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, body, family, leading of each document: the size and family of type with the most characters, and the upper median of the gaps between lines of that size."""
    doc = [*doc]
    chars = F.length(t.js_trim(F.col("text")))
    ink = spans.where(chars > 0).select(*doc, "text", "size", "family", F.round("size", 2).alias("_size"))
    sizes = ink.groupBy(*doc, "_size").agg(F.sum(chars).alias("_n")).groupBy(*doc).agg(F.max_by("_size", F.struct("_n", "_size")).alias("body"))
    sizes = sizes.withColumn("body", F.when(F.col("body") > 0, F.col("body")).otherwise(FALLBACK))
    near = lambda c: F.abs(F.col(c) - F.col("body")) <= SIZES
    families = ink.join(sizes, doc).where(near("size") & F.col("family").isNotNull()).groupBy(*doc, "family").agg(F.sum(chars).alias("_n")).groupBy(*doc).agg(F.max_by("family", F.struct(F.col("_n"), F.col("family"))).alias("family"))
    order = Window.partitionBy(*doc, "page").orderBy("y", "x0")
    pairs = lines_.select(*doc, "page", "y", "x0", "size").join(sizes, doc).withColumn("_gap", F.col("y") - F.lag("y").over(order)).withColumn("_before", F.lag("size").over(order))
    gaps = pairs.where(near("size") & near("_before") & (F.col("_gap") > 0.5 * F.col("body")) & (F.col("_gap") < 3 * F.col("body"))).groupBy(*doc, "_gap").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*doc)
    ranked = gaps.withColumn("_upto", F.sum("_n").over(by.orderBy("_gap").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(by))
    leading = ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*doc).agg(F.min("_gap").alias("leading"))
    return sizes.join(families, doc, "left").join(leading, doc, "left").select(*doc, "body", "family", F.coalesce("leading", LEADING * F.col("body")).alias("leading"))


def lower_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def near_share(values: Column, tolerance: float = EDGE) -> Column:
    """The greatest share of values that lie within the tolerance of one of them."""
    counts = F.transform(values, lambda v: F.size(F.filter(values, lambda w: F.abs(w - v) <= tolerance)))
    return F.when(F.size(values) > 0, F.array_max(counts) / F.size(values)).otherwise(0.0)


def _gathered(lines_: DataFrame, column: Sequence[str]) -> DataFrame:
    """column and _l, its lines from the top."""
    own = [c for c in lines_.columns if c not in column]
    first = ["y", "x0", *[c for c in own if c not in ("y", "x0")]]
    return lines_.groupBy(*column).agg(F.array_sort(F.collect_list(F.struct(*first))).alias("_l"))


def segmented(lines_: DataFrame, column: Sequence[str]) -> DataFrame:
    """lines with para (from 0): a line begins a paragraph if the gap before it is wider than usual for its size, its size or indent differs, it has a list's mark, or the line before
    it ends well short of the paragraph's others. Usual is the median of the last gaps before lines of that size.
    """
    column = [*column]
    rows = _gathered(lines_, column)
    gap = F.transform("_l", lambda s, i: F.struct(s["size"].alias("size"), (s["y"] - F.get("_l", i - 1)["y"]).alias("gap")))
    alike = lambda s, i: F.filter(F.slice("_g", 1, i), lambda g: (g["gap"] > 0) & (F.abs(g["size"] - s["size"]) <= SIZES))
    recent = lambda some: F.transform(F.slice(some, F.greatest(F.lit(1), F.size(some) - HISTORY + 1), HISTORY), lambda g: g["gap"])
    marked = lambda s: s["marker_x"].isNotNull()

    def hard(s: Column, i: Column) -> Column:
        before = F.get("_l", i - 1)
        size = F.when(F.greatest(before["size"], s["size"]) > 0, F.greatest(before["size"], s["size"])).otherwise(s["body"])
        own = F.when(s["size"] > 0, s["size"]).otherwise(size)
        usual = F.greatest(F.coalesce(lower_median(recent(alike(s, i))), F.lit(0.0)), LEADING * own)
        start = F.coalesce(before["text_x"], before["x0"])
        indent = F.when(start == before["x0"], INDENT * size).otherwise(HANGING)
        gap = s["y"] - before["y"]
        # No usual gap is less than the least, so the gaps before are looked through for wider ones only.
        wide = F.coalesce(gap > GAP * (LEADING * own), F.lit(True)) & (gap > GAP * usual)
        return (i > 0) & ((F.abs(before["size"] - s["size"]) > SIZES) | (F.abs(s["x0"] - start) > indent) | marked(s) | wide)

    rows = rows.withColumn("_g", gap).withColumn("_hard", F.transform("_l", hard))
    # How far the paragraph reaches, its lines so far, and its number for each line.
    start = F.expr("named_struct('reach', cast(null as double), 'lines', 0, 'para', 0, 'out', cast(array() as array<int>))")

    def step(a: Column, i: Column) -> Column:
        here, before = F.get("_l", i), F.get("_l", i - 1)
        size = F.when(F.greatest(before["size"], here["size"]) > 0, F.greatest(before["size"], here["size"])).otherwise(here["body"])
        short = (a["lines"] >= 2) & (a["reach"] - before["x1"] > SHORT * size)
        breaks = (i > 0) & (F.get("_hard", i) | short)
        para = F.when(breaks, a["para"] + 1).otherwise(a["para"])
        return F.struct(
            F.when(breaks | (i == 0), here["x1"]).otherwise(F.greatest(a["reach"], here["x1"])).cast("double").alias("reach"), F.when(breaks | (i == 0), 1).otherwise(a["lines"] + 1).alias("lines"),
            para.alias("para"), F.array_append(a["out"], para).alias("out"),
        )

    paras = F.aggregate(F.sequence(F.lit(0), F.size("_l") - 1), start, step, lambda a: a["out"])
    told = rows.select(*column, "_l", paras.alias("_p")).select(*column, F.explode(F.arrays_zip("_l", "_p")).alias("_z"))
    return told.select(*column, "_z._l.*", F.col("_z._p").alias("para"))


def alignment(rows: Column, left: Column, right: Column, size: Column) -> Column:
    """left, center, right or justify: how an array of lines (x0, x1) is set between two edges."""
    width = F.greatest(F.lit(1.0), right - left)
    near = F.greatest(CENTRE * width, CENTRE_SIZES * size)
    centred = F.size(F.filter(rows, lambda s: F.abs((s["x0"] + s["x1"]) / 2 - (left + right) / 2) <= near)) / F.size(rows)
    starts, ends = F.transform(rows, lambda s: s["x0"]), F.transform(rows, lambda s: s["x1"])
    body = lambda values: F.slice(values, 1, F.size(rows) - 1)
    varies = F.array_max(starts) - F.array_min(starts) > VARIES
    one = F.get(rows, F.lit(0))
    return (
        F.when(F.size(rows) == 1, F.when((centred >= 1) & (one["x1"] - one["x0"] < NARROW * width), "center").otherwise("left"))
        .when((F.size(rows) >= BLOCK) & (near_share(body(ends)) >= JUSTIFIED) & (near_share(body(starts)) >= JUSTIFIED), "justify")
        .when((centred >= MOSTLY) & varies, "center").when((near_share(ends) >= MOSTLY) & varies, "right").otherwise("left")
    )


def joined_lines(texts: Column) -> Column:
    """Texts of lines as one: a space between them, but a word that a hyphen parts over two lines is put together, and a hyphen that isn't taken off joins as it is."""
    def put(whole: Column, line: Column) -> Column:
        # What ends a text is sought in its last letters, not from each on.
        end = F.right(whole, F.lit(3))
        hyphen, stem = end.rlike("[-‐­]$"), F.substring(whole, F.lit(1), F.length(whole) - 1)
        word, begins = F.regexp_extract(stem, r"(\S*)$", 1), t.js_trim(line)
        whole_word = begins.rlike(r"^\p{Ll}") & (F.length(word) >= 2) & ~word.rlike(r"^\p{Lu}") & ~word.rlike(r"[0-9]$")
        apart = F.when(end.rlike(r"\s$"), F.concat(whole, line)).otherwise(F.concat(whole, F.lit(" "), line))
        joined = F.when(whole.endswith("­") | whole_word, F.concat(stem, line)).otherwise(F.concat(whole, line))
        return F.when(whole == "", line).when(~hyphen | (word == ""), apart).otherwise(joined)

    return t.js_trim(F.translate(F.aggregate(texts, F.lit(""), put), "­", ""))


def heading_score(kind: Column, text: Column, size: Column, body: Column, count: Column, bold: Column, reach: Column, width: Column) -> Column:
    """1 to 3, or null: whether a paragraph is a heading, by its size in that of the body, and where that says little by bold type, capitals and how short it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    capitals = (F.size(words) >= 2) & text.rlike(r"\p{L}") & ~text.rlike(r"\p{Ll}")
    short, ratio = reach < REACH * width, F.when(body > 0, size / body).otherwise(1.0)
    able = (kind == "paragraph") & (count <= LINES) & (~text.rlike(r"[.,;:]\s*$") | capitals)
    third = F.when(ratio >= RATIOS[2], (bold | capitals) & short).otherwise(bold & capitals & short)
    return F.when(able, F.when(ratio >= RATIOS[0], 1).when(ratio >= RATIOS[1], 2).when(third, 3))


def paragraphs(lines_: DataFrame, page: Sequence[str], column: str = "col") -> DataFrame:
    """A row a paragraph of lines (see above): page, column, para, kind (paragraph, heading, listItem), level, text, align, lines, size, top, leading, before, indent_left, indent_right, first_line, hanging, marker_x.

    A heading's level is the rank of its size among those of its page; indents are in steps of points; before is the space above it beyond its leading.
    """
    page = [*page]
    keys = [*page, column]
    every = _gathered(segmented(lines_, keys), [*keys, "para"])
    first, last = F.get("_l", F.lit(0)), F.element_at("_l", -1)
    take = lambda c: F.transform("_l", lambda s: s[c])
    raw = lower_median(take("size"))
    rows = every.withColumn("size", F.when(raw > 0, raw).otherwise(first["body"])).withColumn("_left", first["left"]).withColumn("_right", first["right"])
    rows = rows.withColumn("text", joined_lines(take("text"))).withColumn("align", alignment(F.col("_l"), F.col("_left"), F.col("_right"), F.col("size")))
    gaps = F.filter(F.transform("_l", lambda s, i: F.when(i > 0, s["y"] - F.get("_l", i - 1)["y"])), lambda g: g > 0)
    rows = rows.withColumn("leading", F.coalesce(lower_median(gaps), first["leading"])).withColumn("_last", last["y"])
    above = F.lag("_last").over(Window.partitionBy(*keys).orderBy("para"))
    rows = rows.withColumn("before", F.when(above.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), first["y"] - above - F.col("leading"))))
    marker, count = first["marker_x"], F.size("_l")
    rest = F.array_min(F.slice(take("x0"), 2, F.greatest(count, F.lit(1))))
    off = first["x0"] - rest
    steps = marker.isNull() & (count >= 2) & (F.abs(off) > FIRST)
    indent = F.when(marker.isNotNull(), first["text_x"]).when(steps, rest).otherwise(F.array_min(take("x0"))) - F.col("_left")
    snap = lambda v: F.greatest(F.lit(0.0), F.floor(v / STEP + 0.5) * STEP)
    plain = F.col("align").isin("center", "right")
    reach = F.array_max(take("x1"))
    gap_right = F.when(count < 2, 0.0).otherwise(F.col("_right") - reach)
    kind = F.when(marker.isNotNull(), "listItem").otherwise("paragraph")
    bold = ~F.exists("_l", lambda s: ~s["bold"])
    told = rows.where("text <> ''").select(
        *keys, "para", kind.alias("_kind"), "text", "align", count.alias("lines"), "size", first["y"].alias("top"), "leading", "before",
        F.when(plain, 0.0).otherwise(snap(indent)).alias("indent_left"), F.when(plain | (gap_right <= F.col("size")), 0.0).otherwise(snap(gap_right)).alias("indent_right"),
        F.when(steps & (off > 0), off).otherwise(0.0).alias("first_line"), F.when(marker.isNotNull(), F.greatest(F.lit(0.0), first["text_x"] - marker)).when(steps & (off < 0), -off).otherwise(0.0).alias("hanging"), marker.alias("marker_x"),
        heading_score(kind, F.col("text"), F.col("size"), first["body"], count, bold, reach - F.col("_left"), F.greatest(F.lit(1.0), F.col("_right") - F.col("_left"))).alias("_score"),
    )
    rank = F.dense_rank().over(Window.partitionBy(*page, F.col("_score").isNull()).orderBy(F.desc(F.round("size", 2))))
    return told.withColumn("kind", F.when(F.col("_score").isNotNull(), "heading").otherwise(F.col("_kind"))).withColumn("level", F.when(F.col("_score").isNotNull(), F.least(F.lit(DEEPEST), rank))).drop("_kind", "_score")


# ---- tab stops


def _median(values: Column) -> Column:
    sorted_, half = F.array_sort(values), F.floor(F.size(values) / 2).cast("int")
    return F.when(F.size(values) % 2 == 1, F.get(sorted_, half)).otherwise((F.get(sorted_, half - 1) + F.get(sorted_, half)) / 2)


def has_tab_columns(rows: Column) -> Column:
    """Whether three lines in a row (an array, with their stops) share a stop."""
    near = lambda stop, stops: F.exists(stops, lambda s: F.abs(s - stop) <= STOP)
    start = F.expr("named_struct('run', 0, 'shared', cast(array() as array<double>), 'found', false)")

    def step(a: Column, row: Column) -> Column:
        kept = F.when(a["run"] == 0, row["stops"]).otherwise(F.filter(a["shared"], lambda s: near(s, row["stops"])))
        run = F.when(F.size(kept) == 0, 0).otherwise(a["run"] + 1)
        return F.struct(run.alias("run"), kept.alias("shared"), (a["found"] | (run >= RUN)).alias("found"))

    return F.aggregate(rows, start, step, lambda a: a["found"])


def _bound(value: Column, f) -> Column:
    """f of a value that is evaluated once."""
    return F.transform(F.array(value), f)[0]


def longest_tab_run(rows: Column) -> Column:
    """first (from 0), lines, columns (each stop's places in turn) of the longest run of lines that share stops, the first of equals; null below three lines."""
    kind = "struct<first:int,lines:int,columns:array<array<double>>>"
    start = F.expr(f"named_struct('at', 0, 'now', cast(null as {kind}), 'best', cast(null as {kind}))")
    longer = lambda now, best: F.when((now["lines"] >= RUN) & (best.isNull() | (now["lines"] > best["lines"])), now).otherwise(best)

    def step(a: Column, row: Column) -> Column:
        stops, now = row["stops"], a["now"]
        hit = lambda column: _bound(_median(column), lambda m: F.get(F.filter(stops, lambda s: F.abs(s - m) <= STOP), F.lit(0)))
        merged = F.filter(F.transform(now["columns"], lambda c: _bound(hit(c), lambda h: F.when(h.isNotNull(), F.array_append(c, h)))), lambda c: c.isNotNull())
        new = F.when(F.size(stops) > 0, F.struct(a["at"].alias("first"), F.lit(1).alias("lines"), F.transform(stops, lambda s: F.array(s)).alias("columns")))

        def after(m: Column) -> Column:
            goes_on = now.isNotNull() & (F.size(m) > 0)
            further = F.struct(now["first"].alias("first"), (now["lines"] + 1).alias("lines"), m.alias("columns"))
            return F.struct((a["at"] + 1).alias("at"), F.when(goes_on, further).otherwise(new).alias("now"), F.when(goes_on, a["best"]).otherwise(longer(now, a["best"])).alias("best"))

        return _bound(merged, after)

    return F.aggregate(rows, start, step, lambda a: longer(a["now"], a["best"]))


def tab_stops(lines_: DataFrame, block: Sequence[str], size: str = "body") -> DataFrame:
    """block, tabbed (three lines in a row share a stop), run (lines of the longest run), stops of blocks of lines.

    stops (type, pos) are those of the longest run, or of all lines where there is none and they have equally many; null if a column of stops is ragged. The last column is a right stop if its
    starts wander while all lines end at one edge.
    """
    rows = _gathered(lines_.select(*block, "y", "x0", "x1", F.col("stops").cast("array<double>").alias("stops"), size), [*block])
    told = rows.select(*block, "_l", has_tab_columns(F.col("_l")).alias("tabbed"), longest_tab_run(F.col("_l")).alias("_f"))
    told = told.withColumn("_some", F.when(F.col("_f").isNotNull(), F.slice("_l", F.col("_f.first") + 1, F.col("_f.lines"))).otherwise(F.col("_l")))
    stops_of = lambda i: F.get("_some", F.lit(0) if i is None else i)["stops"]
    told = told.withColumn("_n", F.size(stops_of(None)))
    even = (F.col("_n") > 0) & ~F.exists("_some", lambda s: F.size(s["stops"]) != F.col("_n"))
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n"), F.lit(1)) - 1), lambda i: F.transform("_some", lambda s: F.get(s["stops"], i)))
    told = told.withColumn("_c", F.when(even, whole).otherwise(F.col("_f.columns")))
    told = told.withColumn("_m", F.transform("_c", lambda c: _bound(_median(c), lambda m: F.struct(m.alias("at"), (~F.exists(c, lambda v: F.abs(v - m) > STOP)).alias("agrees")))))
    told = told.withColumn("_right", F.array_max(F.transform("_some", lambda s: s["x1"])).cast("double"))
    edge = F.get("_l", F.lit(0))[size]
    told = told.withColumn("_flush", ~F.exists("_some", lambda s: F.col("_right") - s["x1"] > F.when(edge > 0, 0.5 * edge).otherwise(0.0)))
    ends = lambda m, i: (i == F.size("_m") - 1) & F.col("_flush") & (~m["agrees"] | (F.size("_some") == 1))
    stop = lambda kind, at: F.struct(F.lit(kind).alias("type"), at.alias("pos"))
    told = told.withColumn("_stops", F.transform("_m", lambda m, i: F.when(ends(m, i), stop("right", F.col("_right"))).when(m["agrees"], stop("left", m["at"]))))
    return told.select(*block, "tabbed", F.coalesce("_f.lines", F.lit(0)).alias("run"), F.when(~F.exists("_stops", lambda s: s.isNull()), F.col("_stops")).alias("stops"))


def untabbed(lines_: DataFrame, block: Sequence[str], size: str = "body") -> DataFrame:
    """lines with justified: their block is set to both edges and has no tab columns, so its wide gaps, tabs in `text`, are spaces; such blocks have no stops."""
    from plumbline.operators.layout import justified

    told = tab_stops(lines_, block, size).select(*block, "tabbed").join(justified(lines_, block, "y", "x0", "x1"), [*block]).select(*block, (F.col("justified") & ~F.col("tabbed")).alias("justified"))
    spaced = F.translate(F.regexp_replace("text", r"(?<=[^\S\t])\t", ""), "\t", " ")
    rows = lines_.join(told, [*block])
    return rows.withColumn("text", F.when(F.col("justified"), spaced).otherwise(F.col("text"))).withColumn("stops", F.when(F.col("justified"), F.expr("cast(array() as array<double>)")).otherwise(F.col("stops").cast("array<double>")))
