"""Tables and text columns found from where spans lie: gutters that no span crosses, edges that values line up on, and the lines that hold money.

A document (one or more key columns) has pages, a page has runs: spans (seq, x, y, w, size, text) with the line they lie on. Sums over a
document are partial sums; what is ordered is a document's distinct places or a page's lines, never its spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.functions.numbers import is_amount
from plumbline.operators.layout import NO_SPACE, anchored, fill_ratio, leading, lines, median_of, mode_of
from plumbline.session import scratch, settled

#: The width of a place in points, the least gutter in points and in sizes of type, how near edges line up, the share of them that must.
PLACE, GUTTER, GUTTER_SIZES, EDGE, ALIGNED = 0.5, 4.0, 0.7, 3.0, 0.8
#: The shares of lines that may cross a gutter at first and in the end, the share of a page's runs that may lie in gutters.
SCOUT, STRICT, MISFIT = 0.08, 0.0, 0.05
#: Lines above the first money line that may be its header, the share of cells it fills, and the gap in sizes of type that ends a wrapped tail.
HEADER_LINES, HEADER_FILL, TAIL = 2, 0.6, 2.2
#: Pages a document has at least to have running lines, pages that show one, their share, and how much its height may vary.
RUNNING_PAGES, RUNNING_HITS, RUNNING_SHARE, RUNNING_SPREAD = 3, 2, 0.5, 3.0
#: Fixed values of text columns: least spans, lines and columns at most, the share of wide lines, how near line gaps are, their greatest size, the share of spans that may cross a gutter, its least width.
FEWEST, FEWEST_LINES, MOST, ROUNDS, FILLED, WIDE, LEADING, LOOSE, CROSSING, CHANNEL, CHANNEL_SIZES = 40, 6, 3, 2, 0.6, 0.92, 1.0, 1.8, 0.06, 10.0, 0.9


def line_tolerance(body: Column) -> Column:
    """How far apart in height spans of one line may lie, by the size of the body's type (fixed values)."""
    return F.greatest(F.lit(1.2), 0.3 * body)


def runs_of(spans: DataFrame, page: Sequence[str], body: str) -> DataFrame:
    """spans with ink, and their line: its anchor (`line`) on the page."""
    ink = spans.where(F.length(t.js_trim(F.col("text"))) > 0)
    return anchored(ink, page, "y", line_tolerance(F.col(body))).withColumnRenamed("anchor", "line")


def page_lines(spans: DataFrame, page: Sequence[str], body: str) -> DataFrame:
    """page, line (its anchor), _s (its spans, from left to right), _body of the lines with ink: runs_of and what gathers its lines, from a page's spans gathered once."""
    page = [*page]
    ink = spans.where(t.has_ink(F.col("text"))).dropna(subset=[*page, "y"])
    pages = ink.groupBy(*page).agg(F.sort_array(_spans()).alias("_p"), F.max(line_tolerance(F.col(body))).alias("_tolerance"), F.max(body).cast("double").alias("_body"))
    start = F.expr("named_struct('anchor', cast(null as double), 'i', 0, 'out', cast(array() as array<struct<line:double,at:int>>))")

    def put(s: Column, v: Column) -> Column:
        begins = s["anchor"].isNull() | (v["y"] - s["anchor"] > F.col("_tolerance"))
        out = F.when(begins, F.array_append(s["out"], F.struct(v["y"].alias("line"), s["i"].alias("at")))).otherwise(s["out"])
        return F.struct(F.when(begins, v["y"]).otherwise(s["anchor"]).alias("anchor"), (s["i"] + 1).alias("i"), out.alias("out"))

    def told(a: Column, i: Column) -> Column:
        until = F.coalesce(F.get("_a", i + 1)["at"], F.size("_p"))
        return F.struct(a["line"].alias("line"), F.slice("_p", a["at"] + 1, until - a["at"]).alias("_s"))

    # Heights further apart than the tolerance part lines; only on pages where what lies between is wider than it are spans folded one by one.
    y = lambda i: F.get("_p", i)["y"]
    parted = pages.withColumn("_i", F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: (i == 0) | (y(i) - y(i - 1) > F.col("_tolerance"))))
    wide = F.exists(F.transform("_i", lambda i, n: y(F.coalesce(F.get("_i", n + 1), F.size("_p")) - 1) - y(i) > F.col("_tolerance")), lambda w: w)
    plain = F.transform("_i", lambda i: F.struct(y(i).alias("line"), i.alias("at")))
    begun = parted.withColumn("_a", F.when(wide, F.aggregate("_p", start, put, lambda s: s["out"])).otherwise(plain))
    each = begun.select(*page, "_body", F.explode(F.transform("_a", told)).alias("_l")).select(*page, "_l.line", "_l._s", "_body")
    # Spans of one height are in order by now.
    level = F.get("_s", F.lit(0))["y"] == F.element_at("_s", -1)["y"]
    return each.withColumn("_s", F.when(level, F.col("_s")).otherwise(_across(F.col("_s"))))


def _covered(changes: DataFrame, group: Sequence[str], at: str, change: str, most: Column) -> DataFrame:
    """group, low, high: stretches of places that more than `most` things cover, told by what begins and ends where."""
    order = Window.partitionBy(*group).orderBy(at)
    sums = changes.groupBy(*group, at).agg(F.sum(change).alias("_c"), F.max(most).alias("_most"))
    levels = sums.select(*group, "_most", F.col(at).alias("low"), F.lead(at).over(order).alias("high"), F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"))
    return levels.where((F.col("_n") > F.col("_most")) & F.col("high").isNotNull()).select(*group, "low", "high")


def _between(stretches: DataFrame, group: Sequence[str], begin: Column) -> DataFrame:
    """group, low, high of what lies before and between stretches."""
    before = F.coalesce(F.lag("high").over(Window.partitionBy(*group).orderBy("low")), begin)
    return stretches.select(*group, before.alias("_before"), F.col("low").alias("high")).where("_before < high").select(*group, F.col("_before").alias("low"), "high")


def profile(runs: DataFrame, doc: Sequence[str], body: str, share: float) -> DataFrame:
    """A row a column of each document's runs: col (from 0), x0, x1, align, anchor, left_share, right_share, support, until (where the next column's half begins, null for the last), gutters.

    Columns lie between gutters: stretches of places that no more lines than a share cross. Values line up on the left or right edge if enough of them end
    within the tolerance of their neighbours; both: on the right one.
    """
    gathered = runs.groupBy(*doc, "page", "line").agg(F.collect_list(F.struct("x", "w")).alias("_s"), F.max(body).alias("_body"))
    return profile_of_lines(gathered, doc, share)


def profile_of_lines(gathered: DataFrame, doc: Sequence[str], share: float, folder: str | None = None) -> DataFrame:
    """profile of gathered lines, whose places are counted once."""
    folder = folder or scratch(gathered.sparkSession)
    return _profile(settled(_places(gathered, doc), folder, "places"), doc, share, folder)


def _places(gathered: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, x, w, _n (runs that lie there), _lines (those that are their line's first), _body: a document has few places and many runs, so these are partial sums."""
    runs = gathered.select(*doc, "_body", F.posexplode(F.transform("_s", lambda s: F.struct(s["x"].alias("x"), s["w"].alias("w")))).alias("_i", "_r"))
    return runs.groupBy(*doc, F.col("_r.x").alias("x"), F.col("_r.w").alias("w")).agg(F.count("*").alias("_n"), F.count_if(F.col("_i") == 0).alias("_lines"), F.max("_body").alias("_body"))


def _profile(places: DataFrame, doc: Sequence[str], share: float, folder: str | None = None) -> DataFrame:
    """profile of counted places. Its steps are settled, as all go by the document and would else be one task, with the memory of all of them."""
    doc, folder = [*doc], folder or scratch(places.sparkSession)
    right = F.col("x") + F.col("w")
    extent = places.groupBy(*doc).agg(F.min("x").alias("_lo"), F.max(right).alias("_hi"), F.max("_body").alias("_body"), F.floor(F.sum("_lines") * share).alias("_most"))
    extent = settled(extent, folder, "extent")
    runs = places.drop("_body", "_lines")
    place = lambda x: (x - F.col("_lo")) / PLACE
    ends = F.array(
        F.struct(F.greatest(F.lit(0), F.floor(place(F.col("x")))).alias("at"), F.col("_n").alias("change")),
        F.struct((F.least(F.ceil(place(F.col("_hi"))), F.ceil(place(right))) + 1).alias("at"), (-F.col("_n")).alias("change")),
    )
    changes = runs.join(extent, doc).select(*doc, "_most", F.explode(ends).alias("_e")).select(*doc, "_most", "_e.*")
    free = _between(_covered(changes, doc, "at", "change", F.col("_most")), doc, F.lit(0)).join(extent, doc)
    wide = (F.col("high") - F.col("low")) * PLACE >= F.greatest(F.lit(GUTTER), GUTTER_SIZES * F.col("_body"))
    gaps = free.where(wide).groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct((F.col("_lo") + F.col("low") * PLACE).alias("low"), (F.col("_lo") + F.col("high") * PLACE).alias("high")))).alias("gutters"))
    laid = extent.join(gaps, doc, "left").withColumn("gutters", F.coalesce("gutters", F.expr("cast(array() as array<struct<low:double,high:double>>)")))
    n = F.size("gutters")
    columns = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.col("_lo")).otherwise(F.get("gutters", i - 1)["high"]).alias("x0"), F.when(i == n, F.col("_hi")).otherwise(F.get("gutters", i)["low"]).alias("x1")))
    laid = settled(laid.select(*doc, "gutters", F.filter(columns, lambda c: c["x1"] - c["x0"] > 0.01).alias("_columns")), folder, "laid")
    middle = F.col("x") + F.col("w") / 2
    mine = runs.join(laid, doc).withColumn("_k", F.array_position(F.transform("_columns", lambda c: middle.between(c["x0"], c["x1"])), True)).where("_k > 0")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("x").cast("double").alias("v")), F.struct(F.lit("r").alias("side"), right.cast("double").alias("v"))))
    by = [*doc, "_k", "side"]
    edges = mine.select(*doc, "_k", "_n", sides.alias("_s")).select(*doc, "_k", "_n", "_s.*").groupBy(*by, "v").agg(F.sum("_n").alias("n"))
    order = Window.partitionBy(*by).orderBy("v")
    chained = edges.withColumn("_new", F.coalesce((F.col("v") - F.lag("v").over(order) > EDGE).cast("int"), F.lit(0))).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = chained.groupBy(*by, "_chain").agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("at"))
    best = clusters.groupBy(*by).agg(F.max_by(F.struct("n", "at"), F.struct("n", -F.col("at"))).alias("best"), F.sum("n").alias("support"))
    pick = lambda side, f: F.max(F.when(F.col("side") == side, F.col("best")[f]))
    told = settled(best.groupBy(*doc, "_k").agg(F.max("support").alias("support"), *[pick(s, f).alias(f"_{s}{f}") for s in "lr" for f in ("n", "at")]), folder, "told")
    left_share, right_share = F.col("_ln") / F.col("support"), F.col("_rn") / F.col("support")
    align = F.when((right_share >= left_share) & (right_share >= ALIGNED), "right").when((left_share > right_share) & (left_share >= ALIGNED), "left").otherwise("ragged")
    place_of = told.join(laid, doc).withColumn("_c", F.get("_columns", F.col("_k") - 1))
    order = Window.partitionBy(*doc).orderBy("_k")
    return place_of.select(
        *doc, (F.row_number().over(order) - 1).alias("col"), F.col("_c.x0").alias("x0"), F.col("_c.x1").alias("x1"), align.alias("align"),
        F.when(align == "right", F.col("_rat")).otherwise(F.col("_lat")).alias("anchor"), left_share.alias("left_share"), right_share.alias("right_share"), "support",
        ((F.col("_c.x1") + F.lead(F.col("_c.x0")).over(order)) / 2).alias("until"), "gutters",
    )


def _spans() -> Column:
    """The spans of a group, in no order; compared, they go by height, then from left to right. plain tells that there is no white space to squash."""
    fields = {c: F.col(c).cast("double").alias(c) for c in ("y", "x", "w", "size")}
    plain = t.is_squashed(F.col("text"))
    weight = F.greatest(F.lit(1), F.when(plain, F.length("text")).otherwise(F.length(t.js_trim(F.col("text"))))).cast("double")
    return F.collect_list(F.struct(fields["y"], fields["x"], "seq", fields["w"], fields["size"], "text", weight.alias("weight"), plain.alias("plain")))


def _across(spans: Column) -> Column:
    """spans from left to right."""
    put = lambda fields: lambda s: F.struct(*[s[f].alias(f) for f in fields])
    rest = ("x", "seq", "w", "size")
    return F.transform(F.sort_array(F.transform(spans, put((*rest, "y", "text", "weight", "plain")))), put(("y", *rest, "text", "weight", "plain")))


def _spaced(every: Column, body: Column) -> Column:
    """The texts of spans (x, w, size, text, in order), a space where the gap is as wide as one."""
    def told(s: Column, i: Column) -> Column:
        before = F.get(every, i - 1)
        gap, size = s["x"] - (before["x"] + before["w"]), F.greatest(before["size"], s["size"])
        close = F.when(size > 0, gap / size < NO_SPACE).otherwise(s["x"] - before["x"] - before["w"] < NO_SPACE * body)
        return F.when((i == 0) | close, s["text"]).otherwise(F.concat(F.lit(" "), s["text"]))

    return F.array_join(F.transform(every, told), "")


def joined(spans: Column, body: Column) -> Column:
    """The text of spans (x, w, size, text, in order): a space where the gap is as wide as one, white space as single spaces. body is the size where spans have none."""
    return t.squash(F.transform(F.array(spans), lambda every: _spaced(every, body))[0])


def _joined(spans: Column, body: Column) -> Column:
    """joined of gathered spans: white space is sought only where one of them isn't plain, as plain texts with single spaces between have none to squash."""
    def told(every: Column) -> Column:
        odd = F.exists(every, lambda s: ~s["plain"])
        return F.when(F.size(every) == 0, "").when(odd, t.squash(_spaced(every, body))).when(F.size(every) == 1, F.get(every, F.lit(0))["text"]).otherwise(_spaced(every, body))

    return F.transform(F.array(spans), told)[0]


def _shape(columns: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, _until (inner bounds), _right (right-aligned columns), _cols, gutters: a profile as a row a document."""
    every = F.array_sort(F.collect_list(F.struct("col", "until", "align")))
    return columns.groupBy(*doc).agg(every.alias("_p"), F.first("gutters").alias("gutters")).select(
        *doc, F.transform(F.filter("_p", lambda c: c["until"].isNotNull()), lambda c: c["until"]).alias("_until"),
        F.transform(F.filter("_p", lambda c: c["align"] == "right"), lambda c: c["col"]).alias("_right"), F.size("_p").alias("_cols"), "gutters",
    )


def rows_of(runs: DataFrame, columns: DataFrame, doc: Sequence[str], body: str) -> DataFrame:
    """doc, page, line, y, size, cells (a text a column, by where the middle of a run lies), overflow (a run reaches over a bound) of each line; hits (right-aligned columns that hold amounts), money and counted (any cell is an amount) tell of its cells."""
    doc = [*doc]
    return _rows(_sized(_gathered(runs, [*doc, "page", "line"], body)), columns, doc)


def _gathered(runs: DataFrame, line: Sequence[str], body: str) -> DataFrame:
    """line, _s (its spans, from left to right), _body."""
    return runs.groupBy(*line).agg(_across(_spans()).alias("_s"), F.max(body).cast("double").alias("_body"))


def _places_of(spans: str) -> Column:
    """Where the spans of a line lie, without their texts."""
    return F.transform(spans, lambda s: F.struct(s["x"].alias("x"), s["w"].alias("w")))


def _sized(gathered: DataFrame) -> DataFrame:
    """gathered lines with y and size."""
    return gathered.select("*", median_of("_s", "y").alias("y"), mode_of("_s", "size").alias("size"))


def _rows(gathered: DataFrame, columns: DataFrame, doc: Sequence[str]) -> DataFrame:
    """rows_of gathered and sized lines, with _p (x and w of their spans)."""
    gathered = gathered.join(_shape(columns, doc), [*doc])
    of = lambda s: F.size(F.filter("_until", lambda u: s["x"] + s["w"] / 2 >= u))
    # Each span's column is told once: an array of one, transformed.
    placed = F.array(F.transform("_s", lambda s: F.struct(of(s).alias("k"), s.alias("s"))))
    of_column = lambda every, c: F.transform(F.filter(every, lambda p: p["k"] == c), lambda p: p["s"])
    cells = F.transform(placed, lambda every: F.transform(F.sequence(F.lit(0), F.col("_cols") - 1), lambda c: _joined(of_column(every, c), F.col("_body"))))[0]
    over = F.exists("_s", lambda s: F.exists("_until", lambda u: (s["x"] < u) & (s["x"] + s["w"] > u)))
    rows = gathered.select(*doc, "page", "line", "y", "size", cells.alias("cells"), over.alias("overflow"), "_right", "_cols", "_body", _places_of("_s").alias("_p"))
    rows = rows.withColumn("hits", F.filter("_right", lambda c: is_amount(F.get("cells", c)))).withColumn("money", F.size("hits") > 0)
    # The other cells matter for what may be a header only, which has no money.
    return rows.withColumn("counted", F.col("money") | F.exists("cells", is_amount))


def band(rows: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Those of the rows that are a table: from a page's first to its last line with money, a header shortly above, and wrapped lines below."""
    page = Window.partitionBy(*doc, "page")
    order = page.orderBy("line")
    filled = F.size(F.filter("cells", lambda c: c != ""))
    far = F.col("y") - F.lag("y").over(order) > TAIL * F.coalesce(F.when(F.lag("size").over(order) > 0, F.lag("size").over(order)), F.col("_body"))
    begins = (F.get("cells", F.lit(0)) != "") | F.exists("_right", lambda c: F.get("cells", c) != "")
    told = rows.withColumn("_n", F.row_number().over(order)).withColumn("_stop", begins | F.coalesce(far, F.lit(False)))
    told = told.withColumn("_first", F.min(F.when(F.col("money"), F.col("_n"))).over(page)).withColumn("_last", F.max(F.when(F.col("money"), F.col("_n"))).over(page)).where("_first is not null")
    header = (F.col("_n") < F.col("_first")) & (F.col("_n") >= F.col("_first") - HEADER_LINES) & ~F.col("counted") & (filled >= F.ceil(HEADER_FILL * F.col("_cols")))
    told = told.withColumn("_start", F.coalesce(F.max(F.when(header, F.col("_n"))).over(page), F.col("_first")))
    stops = F.sum(F.when((F.col("_n") > F.col("_last")) & F.col("_stop"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = told.withColumn("_stops", stops).where((F.col("_n") >= F.col("_start")) & ((F.col("_n") <= F.col("_last")) | (F.col("_stops") == 0)))
    return kept.drop("_n", "_stop", "_first", "_last", "_start", "_stops")


def running_lines(lines_: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, shape: lines, digits aside, that half of a document's pages show at one height; documents of a few pages have none."""
    doc = [*doc]
    return _running(lines_.withColumn("shape", t.line_shape(F.col("text"))), doc)


def _running(lines_: DataFrame, doc: Sequence[str]) -> DataFrame:
    """running_lines of lines whose shape is told."""
    firsts = lines_.where("shape <> ''").groupBy(*doc, "shape", "page").agg(F.min("y").alias("y"))
    pages = lines_.groupBy(*doc, "page").agg(F.lit(1)).groupBy(*doc).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= RUNNING_PAGES)
    by = firsts.groupBy(*doc, "shape").agg(F.count("*").alias("_n"), F.stddev_pop("y").alias("_sd")).join(pages, doc)
    return by.where((F.col("_n") >= RUNNING_HITS) & (F.col("_n") >= RUNNING_SHARE * F.col("_pages")) & (F.col("_sd") <= RUNNING_SPREAD)).select(*doc, "shape")


def misfit(runs: DataFrame, columns: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, page, inside: the share of a page's runs whose middle lies in a gutter of its document."""
    shape = columns.where("col = 0").select(*doc, "gutters")
    middle = F.col("x") + F.col("w") / 2
    hit = F.exists("gutters", lambda g: (middle > g["low"] + PLACE) & (middle < g["high"] - PLACE))
    return runs.join(shape, [*doc]).groupBy(*doc, "page").agg(F.avg(hit.cast("double")).alias("inside"))


def column_tables(spans: DataFrame, doc: Sequence[str], body: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows and pages of the tables that columns make: one a document at most.

    rows: doc, page, line, cells, overflow, money; pages: doc, page, claimed (it has rows of a table). Running lines go first. A first profile,
    which some lines may cross, finds the lines of the table; a second, of these lines alone, which none may cross, is the table's. A page of which
    more than a small share lies in gutters is left out, and a table of one page must have three rows, two columns and three amounts in one of its money columns.
    """
    doc, folder = [*doc], folder or scratch(spans.sparkSession)
    line = [*doc, "page", "line"]
    # A line's spans are gathered once; all later looks are at lines.
    every = page_lines(spans, [*doc, "page"], body)
    # A joined text's shape needs no more squashing.
    told = settled(_sized(every).withColumn("shape", F.regexp_replace(_joined(F.col("_s"), F.lit(0.0)), "[0-9]+", "#")), folder, "lines")
    running = settled(_running(told, doc), folder, "running")
    # A document's running lines come to its lines as what is known of its columns does, by the document.
    gone = running.groupBy(*doc).agg(F.collect_list("shape").alias("_gone"))
    without = lambda lines_: lines_.join(gone, doc, "left").where(~F.coalesce(F.array_contains("_gone", F.col("shape")), F.lit(False))).drop("shape", "_gone")
    gathered = without(told)
    scout = settled(profile_of_lines(without(told.select(*line, _places_of("_s").alias("_s"), "_body", "shape")), doc, SCOUT, f"{folder}/scouted"), folder, "scout")
    scout = scout.join(scout.groupBy(*doc).agg(F.count("*").alias("_n")).where("_n >= 2").select(*doc), doc, "left_semi")
    first = settled(band(_rows(gathered, scout, doc), doc), folder, "first")
    many = settled(first.groupBy(*doc).agg(F.count("*").alias("_n1")), folder, "many")
    # What lies where on a line goes with its row, so that lines and rows need no join.
    inside = first.select(*line, "_body", F.col("_p").alias("_s")).join(many.where("_n1 >= 3").select(*doc), doc, "left_semi")
    strict = profile_of_lines(inside, doc, STRICT, f"{folder}/strict")
    final = settled(strict.unionByName(scout.join(many.where("_n1 >= 3").select(*doc), doc, "left_anti")), folder, "final")
    # Where the columns stay the same the rows do; others are told anew.
    shape = ("_until", "_right", "_cols")
    before = _shape(scout, doc).select(*doc, F.struct(*shape).alias("_before"))
    changed = _shape(final, doc).join(before, doc, "left").select(*doc, F.struct(*shape).eqNullSafe(F.col("_before")).alias("_same"))
    changed = settled(changed, folder, "changed")
    second = first.join(changed.where("_same").select(*doc), doc, "left_semi")
    turned = changed.where("not _same").select(*doc)
    if not turned.isEmpty():
        second = settled(second.unionByName(band(_rows(gathered.join(turned, doc, "left_semi"), final, doc), doc)), folder, "second")
    counts = many.join(second.groupBy(*doc).agg(F.count("*").alias("_n2")), doc, "left").select(*doc, (F.coalesce("_n2", F.lit(0)) >= 0.5 * F.col("_n1")).alias("_again"))
    # Lines of the first finding, where that is taken, are still told by the final columns.
    once = settled(counts.where(~F.col("_again")).select(*doc), folder, "once")
    table = second
    if not once.isEmpty():
        chosen = first.select(*line).join(once, doc, "left_semi")
        table = second.join(once, doc, "left_anti").unionByName(_rows(gathered.join(chosen, line, "left_semi"), final, doc))
    kept = table.select(*doc, "page", F.explode("_p").alias("_r")).select(*doc, "page", "_r.x", "_r.w")
    fits = misfit(kept, final, doc).where(F.col("inside") <= MISFIT).select(*doc, "page")
    table = settled(table.drop("_p").join(fits, [*doc, "page"], "left_semi"), folder, "table")
    hits = table.select(*doc, F.explode("hits").alias("col")).groupBy(*doc, "col").agg(F.count("*").alias("_hits"))
    single = table.groupBy(*doc).agg(F.count_distinct("page").alias("_pages"), F.count("*").alias("_rows"), F.max("_cols").alias("_cols")).join(hits.groupBy(*doc).agg(F.max("_hits").alias("_hits")), doc, "left")
    safe = single.where((F.col("_pages") > 1) | ((F.col("_rows") >= 3) & (F.col("_cols") >= 2) & (F.coalesce("_hits", F.lit(0)) >= 3))).select(*doc)
    rows = table.join(safe, doc, "left_semi").select(*doc, "page", "line", "cells", "overflow", "money")
    claimed = rows.select(*doc, "page").distinct().withColumn("claimed", F.lit(True))
    pages = spans.select(*doc, "page").distinct().join(claimed, [*doc, "page"], "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return rows, pages


def lines_text(runs: DataFrame, doc: Sequence[str]) -> DataFrame:
    """doc, page, line, y, text of the lines that runs make."""
    return texts_of_lines(runs.groupBy(*doc, "page", "line").agg(_across(_spans()).alias("_s")), doc)


def texts_of_lines(gathered: DataFrame, doc: Sequence[str]) -> DataFrame:
    """lines_text of gathered lines."""
    return gathered.select(*doc, "page", "line", median_of("_s", "y").alias("y"), _joined(F.col("_s"), F.lit(0.0)).alias("text"))


def text_columns(spans: DataFrame, page: Sequence[str], body: str, width: str, folder: str | None = None) -> DataFrame:
    """page, col, x0, x1: the columns that a page's text is set in, at most MOST, else the page as one.

    A page is split at a gutter of its coverage if what lies on either side is set as text: lines enough, most of them as wide as the widest, and
    evenly spaced alike. Of the gutters that pass, the widest is taken, then the nearest to the middle; halves are split once more. Each round tries all gutters of
    all pages at once. Spans across a gutter belong to neither side.
    """
    page, folder = [*page], folder or scratch(spans.sparkSession)
    right = F.col("x") + F.col("w")
    members = settled(spans.where(F.length(t.js_trim(F.col("text"))) > 0).withColumn("band", F.lit("")), folder, "round0")
    counts = members.groupBy(*page).agg(F.count("*").alias("_n"), F.max(body).alias("_body"), F.max(F.greatest(F.lit(1), F.ceil(F.col(width)))).alias("_width"))
    low = F.greatest(F.lit(0), F.least(F.col("_width") - 1, F.floor("x")))
    ends = F.array(F.struct(low.alias("at"), F.lit(1).alias("change")), F.struct(F.least(F.col("_width"), F.greatest(low + 1, F.ceil(right))).alias("at"), F.lit(-1).alias("change")))
    enough = counts.where(F.col("_n") >= FEWEST)
    changes = members.join(enough, page).select(*page, F.ceil(CROSSING * F.col("_n")).alias("_most"), F.explode(ends).alias("_e")).select(*page, "_most", "_e.*")
    covered = _covered(changes, page, "at", "change", F.col("_most"))
    inner = covered.withColumn("_before", F.lag("high").over(Window.partitionBy(*page).orderBy("low"))).select(*page, F.col("_before").alias("low"), F.col("low").alias("high"))
    free = inner.join(enough.select(*page, "_body"), page).where((F.col("high") - F.col("low") >= F.greatest(F.lit(CHANNEL), CHANNEL_SIZES * F.col("_body"))))
    gutters = settled(free.select(*page, "low", "high"), folder, "gutters")
    bands = members.groupBy(*page, "band").agg(F.min("x").alias("x0"), F.max(right).alias("x1"), F.count("*").alias("_n"))
    for turn in range(1, ROUNDS + 1):
        split = bands.where((F.length("band") == turn - 1) & (F.col("_n") >= FEWEST))
        within = (F.col("low") > F.greatest(F.lit(0), F.floor("x0"))) & (F.col("high") < F.ceil("x1"))
        tried = split.join(gutters, page).where(within).select(*page, "band", "low", "high", F.abs((F.col("low") + F.col("high") - F.col("x0") - F.col("x1")) / 2).alias("_off"))
        side = F.when(right <= F.col("low"), "0").when(F.col("x") >= F.col("high"), "1")
        by = [*page, "band", "low", "side"]
        sided = members.join(tried, [*page, "band"]).withColumn("side", side).where("side is not null")
        set_ = settled(lines(sided, by, line_tolerance(F.col(body))), folder, f"lines{turn}")
        facts = (
            set_.groupBy(*by).agg(F.count("*").alias("_lines")).join(fill_ratio(set_, by, "x0", "x1", WIDE), by).join(leading(set_, by, "y"), by)
            .where((F.col("_lines") >= FEWEST_LINES) & (F.col("fill") >= FILLED))
        )
        pairs = facts.groupBy(*page, "band", "low").agg(*[F.max(F.when(F.col("side") == s, F.col("leading"))).alias(f"_l{s}") for s in "01"]).join(counts.select(*page, "_body"), page)
        good = pairs.where((F.abs(F.col("_l0") - F.col("_l1")) <= LEADING) & (F.col("_l0") <= LOOSE * F.col("_body"))).join(tried, [*page, "band", "low"])
        taken = good.groupBy(*page, "band").agg(F.min_by(F.struct("low", "high"), F.struct(-(F.col("high") - F.col("low")), "_off", "low")).alias("_g")).select(*page, "band", "_g.*")
        halves = members.join(taken, [*page, "band"], "left").withColumn("band", F.when(F.col("low").isNull(), F.col("band")).otherwise(F.concat("band", side))).where("band is not null").drop("low", "high")
        members = settled(halves, folder, f"round{turn}")
        bands = members.groupBy(*page, "band").agg(F.min("x").alias("x0"), F.max(right).alias("x1"), F.count("*").alias("_n"))
    whole = settled(spans.where(F.length(t.js_trim(F.col("text"))) > 0).groupBy(*page).agg(F.min("x").alias("_x0"), F.max(right).alias("_x1")), folder, "whole")
    numbered = bands.withColumn("col", F.row_number().over(Window.partitionBy(*page).orderBy("band")) - 1).withColumn("_cols", F.count("*").over(Window.partitionBy(*page)))
    told = numbered.join(whole, page).where((F.col("_cols") <= MOST) | (F.col("col") == 0))
    return told.select(*page, "col", *[F.when(F.col("_cols") > MOST, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("x0", "x1")])
