"""Operators over what is placed on pages: spans, lines, rules, boxes and pages, each told by the page it is on.

A page holds some thousands of things at most, so what must go one by one, as a greedy choice, folds an array a
page; all else is joins within a page, windows and grouped sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators.graph import components
from plumbline.operators.sequences import merged_intervals
from plumbline.session import scratch, settled

#: Gaps in sizes of type that part words and fragments, and how near edges and rules must be, in points.
NO_SPACE, WORD_GAP = 0.25, 2.0
EDGE, TAB, TOUCH, TWIN = 1.5, 3.0, 1.2, 8.0
#: Rules of a page beyond which its groups are found by joins, and pairs of rules looked at in one step; boxes of a page or lines of a block that are gathered at most.
CROWDED, CELLS, MANY = 20_000, 1_000_000, 1000


def anchored(points: DataFrame, group: Sequence[str], at: str, tolerance: float | Column) -> DataFrame:
    """points with anchor: from the least value on, a value further than the tolerance (one a group) from the anchor before is the next anchor.

    The fold keeps the anchors only, which lie further apart than the tolerance, so a group's values cost no more than their number.
    """
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.expr("cast(array() as array<double>)").alias("out"))

    def put(s: Column, v: Column) -> Column:
        far = s["anchor"].isNull() | (v - s["anchor"] > F.col("_tolerance"))
        return F.when(far, F.struct(v.alias("anchor"), F.array_append(s["out"], v).alias("out"))).otherwise(s)

    wide = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    values = points.select(*group, F.col(at).cast("double").alias("_at"), wide.alias("_tolerance"))
    sorted_ = values.groupBy(*group).agg(F.array_sort(F.collect_set("_at")).alias("_v"), F.max("_tolerance").alias("_tolerance"))
    starts = sorted_.select(*group, "_v", F.aggregate("_v", start, put, lambda s: s["out"]).alias("_a"))
    told = F.transform("_v", lambda v: F.struct(v.alias("_at"), F.element_at(F.filter("_a", lambda a: a <= v), -1).alias("anchor")))
    table = starts.select(*group, F.explode(told).alias("_t")).select(*group, "_t._at", "_t.anchor")
    return points.withColumn("_at", F.col(at).cast("double")).join(table, [*group, "_at"]).drop("_at")


def gap_kind(before_right: Column, x: Column, before_size: Column, size: Column, justified: Column | None = None) -> Column:
    """none, space or fragment: what the gap between two spans is, in sizes of the larger type. In a justified block wide gaps are spaces."""
    em = (x - before_right) / F.greatest(before_size, size)
    wide = em >= WORD_GAP if justified is None else (em >= WORD_GAP) & ~justified
    return F.when(F.greatest(before_size, size) <= 0, "none").when(em < NO_SPACE, "none").when(wide, "fragment").otherwise("space")


def lines(spans: DataFrame, page: str | Sequence[str], tolerance: float | Column) -> DataFrame:
    """page, line (its anchor), y, x0, x1, size, fragments, text of spans (page, seq, text, x, y, w, size).

    Spans on one height, from the anchor on, are a line; its height is the median by characters, its size the
    commonest by characters. Fragments, parted by wide gaps, are joined by tabs. All of a line is told from its spans, gathered once.
    """
    by = [page] if isinstance(page, str) else [*page]
    placed = anchored(spans.where(F.length(t.js_trim(F.col("text"))) > 0), by, "y", tolerance).withColumnRenamed("anchor", "line")
    span = F.struct("x", "seq", "y", "w", F.col("size").cast("double").alias("size"), "text", F.greatest(F.lit(1), F.length(t.js_trim(F.col("text")))).cast("double").alias("weight"))
    grouped = placed.groupBy(*by, "line").agg(F.array_sort(F.collect_list(span)).alias("_s"))
    before = lambda i: F.get("_s", i - 1)
    kinds = F.transform("_s", lambda s, i: F.when(i == 0, "").otherwise(gap_kind(before(i)["x"] + before(i)["w"], s["x"], before(i)["size"], s["size"])))
    spaced = lambda i: F.coalesce(before(i)["text"].rlike(r"\s$"), F.lit(False))
    mark = lambda i: F.when(F.get("_k", i) == "fragment", "\t").when((F.get("_k", i) == "space") & ~spaced(i), " ").otherwise("")
    return grouped.withColumn("_k", kinds).select(
        *by, "line", F.array_min(F.transform("_s", lambda s: s["x"])).alias("x0"), F.array_max(F.transform("_s", lambda s: s["x"] + s["w"])).alias("x1"),
        (F.size(F.filter("_k", lambda k: k == "fragment")) + 1).cast("long").alias("fragments"), F.array_join(F.transform("_s", lambda s, i: F.concat(mark(i), s["text"])), "").alias("text"),
        median_of("_s", "y").alias("y"), mode_of("_s", "size").alias("size"),
    )


def median_of(spans: str, value: str) -> Column:
    """Of an array of spans, the first value at which half of their weight is reached; that of all, if they have one."""
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s[value].cast("double").alias("v"), s["weight"].alias("w"))))
    every = F.aggregate(spans, F.lit(0.0), lambda a, s: a + s["weight"])
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("median"), every.alias("every"))
    step = lambda a, s: F.struct((a["upto"] + s["w"]).alias("upto"), F.when(a["median"].isNull() & (2 * (a["upto"] + s["w"]) >= a["every"]), s["v"]).otherwise(a["median"]).alias("median"), a["every"].alias("every"))
    return F.when(_alike(spans, value), F.get(spans, F.lit(0))[value].cast("double")).otherwise(F.aggregate(sorted_, start, step, lambda a: a["median"]))


def _alike(spans: str, value: str) -> Column:
    """True if all spans have the value of the first."""
    return ~F.exists(spans, lambda s: s[value] != F.get(spans, F.lit(0))[value])


def mode_of(spans: str, value: str) -> Column:
    """Of an array of spans, the value (to two decimals) with the greatest weight, the larger of two."""
    values = F.array_distinct(F.transform(spans, lambda s: F.round(s[value], 2)))
    weight = lambda v: F.aggregate(spans, F.lit(0.0), lambda a, s: a + F.when(F.round(s[value], 2) == v, s["weight"]).otherwise(0.0))
    return F.when(_alike(spans, value), F.round(F.get(spans, F.lit(0))[value], 2)).otherwise(F.array_max(F.transform(values, lambda v: F.struct(weight(v).alias("w"), v.alias("v"))))["v"])


def share_near(values: DataFrame, group: Sequence[str], at: str, tolerance: float = EDGE) -> DataFrame:
    """group, share: the greatest share of values that lie within the tolerance of one of them."""
    by = ", ".join(f"`{g}`" for g in group)
    near = F.expr(f"count(`{at}`) over (partition by {by} order by double(`{at}`) range between {float(tolerance)}D preceding and {float(tolerance)}D following)")
    return values.withColumn("_near", near).groupBy(*group).agg(F.try_divide(F.max("_near"), F.count(at)).alias("share"))


def _justified(lines_: DataFrame, block: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """justified by windows, for blocks of very many lines."""
    body = lines_.withColumn("_n", F.count(at).over(Window.partitionBy(*block))).withColumn("_k", F.row_number().over(Window.partitionBy(*block).orderBy(at)))
    usable = body.where((F.col("_n") >= 3) & (F.col("_k") < F.col("_n")))
    left, right = (share_near(usable, block, c).withColumnRenamed("share", f"_{c}") for c in (low, high))
    both = left.join(right, list(block)).select(*block, ((F.col(f"_{low}") >= 0.8) & (F.col(f"_{high}") >= 0.8)).alias("justified"))
    return lines_.select(*block).distinct().join(both, list(block), "left").withColumn("justified", F.coalesce("justified", F.lit(False)))


def justified(lines_: DataFrame, block: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """block, justified: three lines at least, whose ends agree for 80 % of them, the last line aside. A block's lines are gathered once; blocks of more than MANY go by windows."""
    by = [*block]
    many = lines_.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > MANY).select(*by)
    if not many.isEmpty():
        few = justified(lines_.join(many, by, "left_anti"), by, at, low, high)
        return few.unionByName(_justified(lines_.join(many, by, "left_semi"), by, at, low, high))
    ends = F.struct(F.col(at).alias("at"), F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"))
    gathered = lines_.groupBy(*by).agg(F.sort_array(F.collect_list(ends)).alias("_l"), F.count(at).alias("_n"))
    body = F.slice("_l", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0)).cast("int"))
    usable = gathered.select(*by, "_n", *[F.filter(F.transform(body, lambda v: v[c]), lambda v: v.isNotNull()).alias(f"_{c}") for c in ("low", "high")])  # noqa: B023
    near = lambda c: F.exists(c, lambda v: F.size(F.filter(c, lambda o: F.abs(o - v) <= EDGE)) / F.size(c) >= 0.8)
    return usable.select(*by, F.coalesce((F.col("_n") >= 3) & near("_low") & near("_high"), F.lit(False)).alias("justified"))


def fill_ratio(lines_: DataFrame, block: Sequence[str], low: str, high: str, share: float = 0.92) -> DataFrame:
    """block, fill: the share of lines that are nearly as wide as the widest."""
    wide = F.col(high) - F.col(low)
    widest = F.max(wide).over(Window.partitionBy(*block))
    return lines_.withColumn("_full", ((wide >= share * widest) & (widest > 0)).cast("double")).groupBy(*block).agg(F.avg("_full").alias("fill"))


def leading(lines_: DataFrame, block: Sequence[str], y: str) -> DataFrame:
    """block, leading: the upper median of the gaps between lines."""
    gaps = lines_.withColumn("_gap", F.col(y) - F.lag(y).over(Window.partitionBy(*block).orderBy(y))).where("_gap > 0")
    ranked = gaps.withColumn("_k", F.row_number().over(Window.partitionBy(*block).orderBy("_gap"))).withColumn("_n", F.count("_gap").over(Window.partitionBy(*block)))
    return ranked.where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select(*block, F.col("_gap").alias("leading"))


def coverage(spans: DataFrame, page: str, width: int) -> DataFrame:
    """page, point, n: how many spans (x, w) cover each point across a page.

    A span counts where it begins and ends only, however wide it is; the sums from the left tell what covers a point.
    """
    low = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor("x").cast("int")))
    high = F.least(F.lit(width), F.greatest(low + 1, F.ceil(F.col("x") + F.col("w")).cast("int")))
    ends = F.array(F.struct(low.alias("point"), F.lit(1).alias("d")), F.struct(high.alias("point"), F.lit(-1).alias("d")))
    turns = spans.select(page, F.explode(ends).alias("_e")).groupBy(page, F.col("_e.point").alias("point")).agg(F.sum("_e.d").alias("_d")).where("_d <> 0")
    order = Window.partitionBy(page).orderBy("point")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = turns.select(page, "point", F.lead("point").over(order).alias("_next"), F.sum("_d").over(upto).alias("n")).where("n > 0")
    return stretches.select(page, F.explode(F.sequence("point", F.col("_next") - 1)).alias("point"), "n")


def page_fit(runs: DataFrame, gutters: DataFrame, page: str, slack: float = 0.5) -> DataFrame:
    """page, inside: the share of runs (x, w) whose middle lies in a gutter (low, high) of the page."""
    middle = F.col("x") + F.col("w") / 2
    keyed = runs.withColumn("_id", F.monotonically_increasing_id()).withColumn("_mid", middle)
    hit = keyed.join(gutters.select(F.col(page).alias("_p"), "low", "high"), (F.col(page) == F.col("_p")) & (F.col("_mid") > F.col("low") + slack) & (F.col("_mid") < F.col("high") - slack), "left_semi").groupBy(page).agg(F.count("*").alias("_hit"))
    return runs.groupBy(page).agg(F.count("*").alias("_all")).join(hit, page, "left").select(page, (F.coalesce("_hit", F.lit(0)) / F.col("_all")).alias("inside"))


def _strips(boxes: DataFrame, page: str) -> DataFrame:
    """union_area by joins, for pages of very many boxes."""
    edges = boxes.select(page, F.explode(F.array(F.col("x"), F.col("x") + F.col("w"))).alias("x0")).distinct()
    strips = edges.withColumn("x1", F.lead("x0").over(Window.partitionBy(page).orderBy("x0"))).where("x1 is not null").withColumnRenamed(page, "_p")
    inside = boxes.join(strips, (F.col(page) == F.col("_p")) & (F.col("x") <= F.col("x0")) & (F.col("x") + F.col("w") >= F.col("x1"))).select(page, "x0", "x1", "y", (F.col("y") + F.col("h")).alias("y1"))
    joined = merged_intervals(inside, [page, "x0", "x1"], "y", "y1")
    return joined.groupBy(page).agg(F.sum((F.col("high") - F.col("low")) * (F.col("x1") - F.col("x0"))).alias("area"))


def union_area(boxes: DataFrame, page: str) -> DataFrame:
    """page, area that boxes (x, y, w, h) cover together: strips between neighbouring edges, and in each the joined heights.

    A page's boxes are gathered once, by height; pages of more than MANY go by joins.
    """
    many = boxes.groupBy(page).agg(F.count("*").alias("_n")).where(F.col("_n") > MANY).select(page)
    if many.isEmpty():
        return _gathered_area(boxes, page)
    return _gathered_area(boxes.join(many, page, "left_anti"), page).unionByName(_strips(boxes.join(many, page, "left_semi"), page))


def _gathered_area(boxes: DataFrame, page: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    box = F.struct(d("y").alias("y"), (d("y") + d("h")).alias("y1"), d("x").alias("x"), (d("x") + d("w")).alias("x1"))
    told = boxes.where(F.col(page).isNotNull() & (F.col("w") > 0) & box["x1"].isNotNull() & box["y1"].isNotNull()).groupBy(page).agg(F.sort_array(F.collect_list(box)).alias("_b"))
    edges = told.withColumn("_e", F.sort_array(F.array_distinct(F.concat(F.transform("_b", lambda b: b["x"]), F.transform("_b", lambda b: b["x1"])))))
    start = F.struct(F.lit(float("-inf")).alias("reach"), F.lit(0.0).alias("sum"))

    def put(s: Column, b: Column) -> Column:
        return F.struct(F.greatest(s["reach"], b["y1"]).alias("reach"), (s["sum"] + b["y1"] - F.least(b["y1"], F.greatest(s["reach"], b["y"]))).alias("sum"))

    def strip(x0: Column, i: Column) -> Column:
        x1 = F.get("_e", i + 1)
        return F.aggregate(F.filter("_b", lambda b: (b["x"] <= x0) & (b["x1"] >= x1)), start, put, lambda s: s["sum"] * (x1 - x0))

    return edges.select(page, F.aggregate(F.transform("_e", strip), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("area"))


def crossing(rules: DataFrame, page: str, tolerance: float = TOUCH) -> DataFrame:
    """a, b: rules (id, axis h or v, at, low, high) of a page of which each crosses the other's span, up to the tolerance."""
    h = rules.where("axis = 'h'").select(page, F.col("id").alias("a"), F.col("at").alias("y"), F.col("low").alias("x0"), F.col("high").alias("x1"))
    v = rules.where("axis = 'v'").select(page, F.col("id").alias("b"), F.col("at").alias("x"), F.col("low").alias("y0"), F.col("high").alias("y1"))
    near = lambda p, low, high: F.col(p).between(F.col(low) - tolerance, F.col(high) + tolerance)
    return h.join(v, page).where(near("x", "x0", "x1") & near("y", "y0", "y1")).select("a", "b")


def _least(axis: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float) -> np.ndarray:
    """For each rule of a page (axis 0 level, 1 upright) the first of those that hang together with it. Crossings are told a slice of the level rules at a time."""
    first = np.arange(len(at))
    level, upright = np.flatnonzero(axis == 0), np.flatnonzero(axis == 1)
    step = max(1, CELLS // max(1, len(upright)))
    while True:
        before = first.copy()
        for k in range(0, len(level), step):
            h = level[k : k + step, None]
            a, b = np.nonzero((at[upright] >= low[h] - tolerance) & (at[upright] <= high[h] + tolerance) & (at[h] >= low[upright] - tolerance) & (at[h] <= high[upright] + tolerance))
            a, b = h[a, 0], upright[b]
            np.minimum.at(first, a, first[b])
            np.minimum.at(first, b, first[a])
        first = first[first]
        if (first == before).all():
            return first


def _folded(rules: DataFrame, page: list[str], tolerance: float) -> DataFrame:
    """rules with component, told a page at a time: a page's rules are gathered once, by id, and given back with the first of their group."""
    rest = [c for c in rules.columns if c not in (*page, "id")]

    @F.pandas_udf("array<int>")
    def grouped(axis: pd.Series, at: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        number = lambda v: np.asarray(v, dtype=float)
        return pd.Series([_least(np.asarray(x), number(a), number(b), number(c), tolerance) for x, a, b, c in zip(axis, at, low, high, strict=True)])

    pages = rules.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("id", *rest))).alias("_r"))
    code = lambda r: F.when(r["axis"] == "h", 0).when(r["axis"] == "v", 1).otherwise(2)
    values = lambda c: F.transform("_r", lambda r: r[c].cast("double"))
    told = pages.withColumn("_first", grouped(F.transform("_r", code), *[values(c) for c in ("at", "low", "high")]))
    each = told.select(*page, F.explode(F.transform("_r", lambda r, i: F.struct(r.alias("r"), F.get("_r", F.get("_first", i))["id"].alias("component")))).alias("_e"))
    return each.select(*[F.col(c) if c in page else F.col("_e.r")[c].alias(c) for c in rules.columns], F.col("_e.component").alias("component"))


def rule_groups(rules: DataFrame, page: str | Sequence[str], tolerance: float = TOUCH, folder: str | None = None) -> DataFrame:
    """rules (id, unique on its page) with component: the least id among those that hang together. Pages are folded one at a time; those of very many rules go by joins."""
    by = [page] if isinstance(page, str) else [*page]
    crowded = rules.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select(*by)
    if crowded.isEmpty():
        return _folded(rules, by, tolerance)
    folder = folder or scratch(rules.sparkSession)
    crowded = settled(crowded, folder, "crowded")
    many = rules.join(crowded, by, "left_semi").withColumn("id", F.struct(*by, "id")).withColumn("_page", F.struct(*by))
    found = components(crossing(many, "_page", tolerance), folder).withColumnRenamed("node", "id")
    joined = many.join(found, "id", "left").select(*[F.col("id.id").alias("id") if c == "id" else F.col(c) for c in rules.columns], F.coalesce("component", "id")["id"].alias("component"))
    return _folded(rules.join(crowded, by, "left_anti"), by, tolerance).unionByName(joined)


def link_of(spans: DataFrame, links: DataFrame, page: str, slack: float = 1.0) -> DataFrame:
    """spans (id, x, y, w, size) with url: of the first link (ord, url, left, top, width, height) whose box holds the span's middle."""
    x, y = F.col("x") + F.col("w") / 2, F.col("y") - F.col("size") * 0.35
    boxes = links.select(F.col(page).alias("_p"), "ord", "url", "left", "top", "width", "height")
    within = x.between(F.col("left") - slack, F.col("left") + F.col("width") + slack) & y.between(F.col("top") - slack, F.col("top") + F.col("height") + slack)
    first = spans.join(boxes, (F.col(page) == F.col("_p")) & within).groupBy("id").agg(F.min_by("url", "ord").alias("url"))
    return spans.join(first, "id", "left")


def _wraps(outer: Column, inner: Column, slack: float) -> Column:
    side = lambda p, q: (outer[p] <= inner[p] + slack) & (outer[p] + outer[q] >= inner[p] + inner[q] - slack)
    return side("x", "w") & side("y", "h")


def shade_of(cells: DataFrame, fills: DataFrame, page: str, slack: float = 1.0, most: str | None = None) -> DataFrame:
    """cells (id, x, y, w, h) with colour: of the smallest fill around them that isn't white, nor larger than `most` of the cell."""
    box = lambda: F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])
    own = cells.select("id", page, box().alias("_cell"), (F.col(most) if most else F.lit(float("inf"))).alias("_most"))
    shades = fills.where(F.upper("colour") != "#FFFFFF").select(F.col(page).alias("_p"), "colour", box().alias("_fill"), (F.col("w") * F.col("h")).alias("_area"))
    fits = _wraps(F.col("_fill"), F.col("_cell"), slack) & (F.col("_area") <= F.col("_most"))
    best = own.join(shades, (F.col(page) == F.col("_p")) & fits).groupBy("id").agg(F.min_by("colour", F.struct("_area", "colour")).alias("colour"))
    return cells.join(best, "id", "left")


def _greedy(rows: DataFrame, group: str, order: list[Column], fields: list[str], clashes, most: int | None = None) -> DataFrame:
    """In each group, from the first on, rows that clash with none chosen before. A group is a page or picture."""
    kind = "array<struct<{}>>".format(", ".join(f"`{f}`:{dict(rows.dtypes)[f]}" for f in fields))

    def put(kept: Column, row: Column) -> Column:
        full = F.lit(False) if most is None else F.size(kept) >= most
        return F.when(full | F.exists(kept, lambda k: clashes(k, row)), kept).otherwise(F.array_append(kept, row))

    sorted_ = F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("_row"))))
    chosen = F.aggregate(F.transform(sorted_, lambda s: s["_row"]), F.expr(f"cast(array() as {kind})"), put)
    return rows.groupBy(group).agg(chosen.alias("_kept")).select(group, F.explode("_kept").alias("_k")).select(group, "_k.*")


def without_twins(fills: DataFrame, page: str, slack: float = TWIN) -> DataFrame:
    """page, id, x, y, w, h of fills, largest first, without those that lie in one kept before and are nearly as large."""
    edge = lambda a, b, p, q: F.abs(a[p] - b[p]) + F.abs(a[p] + a[q] - b[p] - b[q])
    twin = lambda a, b: _wraps(a, b, TOUCH) & (F.greatest(edge(a, b, "x", "w"), edge(a, b, "y", "h")) <= 2 * slack)
    return _greedy(fills, page, [-(F.col("w") * F.col("h")), F.col("id")], ["id", "x", "y", "w", "h"], twin)


def best_boxes(found: DataFrame, picture: str, threshold: float = 0.3, most: int | None = None) -> DataFrame:
    """picture, id, score, x, y, w, h of boxes, best first, without those that overlap a better one by more than the threshold."""
    side = lambda a, b, p, q: F.greatest(F.lit(0.0), F.least(a[p] + a[q], b[p] + b[q]) - F.greatest(a[p], b[p]))

    def clash(a: Column, b: Column) -> Column:
        shared = side(a, b, "x", "w") * side(a, b, "y", "h")
        return shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared) > threshold

    return _greedy(found, picture, [-F.col("score"), F.col("id")], ["id", "score", "x", "y", "w", "h"], clash, most)


def outside(spans: DataFrame, boxes: DataFrame, page: str, slack: float = TOUCH) -> DataFrame:
    """spans (x, y) that lie in none of the boxes (left, top, width, height) of their page."""
    told = boxes.select(F.col(page).alias("_p"), "left", "top", "width", "height")
    within = F.col("x").between(F.col("left") - slack, F.col("left") + F.col("width") + slack) & F.col("y").between(F.col("top") - slack, F.col("top") + F.col("height") + slack)
    return spans.join(told, (F.col(page) == F.col("_p")) & within, "left_anti")


def list_depths(markers: DataFrame, page: str, x: str, tolerance: float = TAB, deepest: int = 3) -> DataFrame:
    """markers with depth: the rank, from 1, of their place among the places of a page."""
    placed = anchored(markers, [page], x, tolerance)
    return placed.withColumn("depth", F.least(F.lit(deepest), F.dense_rank().over(Window.partitionBy(page).orderBy("anchor")))).drop("anchor")


def sections(segments: DataFrame, document: str, at: str, same: Sequence[str]) -> DataFrame:
    """document, section, first, last: consecutive segments that agree in some columns."""
    order = Window.partitionBy(document).orderBy(at)
    shape = F.struct(*same)
    begins = F.coalesce((~shape.eqNullSafe(F.lag(shape).over(order))).cast("int"), F.lit(1))
    numbered = segments.withColumn("_b", begins).withColumn("section", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(document, "section").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def heading_levels(headings: DataFrame, document: str, size: str, tagged: str, deepest: int = 6) -> DataFrame:
    """headings with level: a tag's own, else the rank of the size among the document's headings, largest first."""
    rank = F.dense_rank().over(Window.partitionBy(document).orderBy(F.desc(size)))
    return headings.withColumn("level", F.coalesce(F.col(tagged), F.least(F.lit(deepest), rank)).cast("int"))


def merged_notes(notes: DataFrame, key: str) -> DataFrame:
    """key, pages, count of notes (key, pages, count): one a subject."""
    return notes.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.sum("count").alias("count"))


def background_spread(pixels: DataFrame, picture: str, fewest: int = 30) -> DataFrame:
    """picture, r, g, b, spread of background pixels: the mean colour, and how uneven the brightness is, from 0 to 1; null below a number of samples."""
    light = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    by = pixels.groupBy(picture).agg(F.count("r").alias("_n"), *[F.avg(c).alias(c) for c in "rgb"], F.stddev_pop(light).alias("_sd"))
    return by.where(F.col("_n") >= fewest).select(picture, "r", "g", "b", F.least(F.lit(1.0), F.col("_sd") / 40).alias("spread"))


def plan_faults(plan: DataFrame, files: DataFrame) -> DataFrame:
    """ord, fault (missing-file, out-of-range, twice) of pages of a plan (ord, file, page) that files (file, pages) don't bear out."""
    known = plan.join(files, "file", "left")
    first = F.min("ord").over(Window.partitionBy("file", "page"))
    fault = F.when(F.col("pages").isNull(), "missing-file").when(~F.col("page").between(1, F.col("pages")), "out-of-range").when(F.col("ord") > first, "twice")
    return known.withColumn("fault", fault).where("fault is not null").select("ord", "fault")


def checked_plan(plan: DataFrame, files: DataFrame, folder: str | None = None) -> DataFrame:
    """ord (anew, from 1), file, page: the pages of a plan without faults, in order."""
    good = settled(plan.join(plan_faults(plan, files), "ord", "left_anti"), folder or scratch(plan.sparkSession), "plan")
    before = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    # A plan is a list that someone made; its order is over all of it.
    return good.withColumn("_of_file", before).withColumn("ord", F.row_number().over(Window.orderBy("ord"))).select("ord", "file", "page")
