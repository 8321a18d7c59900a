"""Queries of the layout operators, over pages made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import layout, sequences
from plumbline.plans.base import query, table
from plumbline.session import scratch

#: Spans: a page a supplier, places and words from its line items.
_TEXT = "CASE l_linenumber % 4 WHEN 0 THEN 'total' WHEN 1 THEN concat('no ', l_linenumber) WHEN 2 THEN l_returnflag ELSE concat(l_linestatus, ' ') END"
_SPANS = f"SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS seq, {_TEXT} AS text, (l_partkey * 7 % 500)::DOUBLE AS x, (l_quantity * 14 + (l_orderkey % 5) * 0.5)::DOUBLE AS y, (len({_TEXT}) * 5 + l_linenumber)::DOUBLE AS w, (CASE WHEN l_orderkey % 3 = 0 THEN 12 ELSE 9 END)::DOUBLE AS size FROM lineitem"


def _spans(spark, sf_dir):
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.expr(_TEXT)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), (key * 10 + n).alias("seq"), text.alias("text"), (F.col("l_partkey") * 7 % 500).cast("double").alias("x"),
        (F.col("l_quantity") * 14 + (key % 5) * 0.5).alias("y"), (F.length(text) * 5 + n).cast("double").alias("w"), F.when(key % 3 == 0, 12.0).otherwise(9.0).alias("size"),
    )


_ANCHORED = f"""s AS ({_SPANS}), o AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) AS k FROM (SELECT DISTINCT page, y FROM s)),
r AS (SELECT page, y, k, y AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.page, o.y, o.k, CASE WHEN o.y - r.anchor > 1.2 THEN o.y ELSE r.anchor END FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1),
p AS (SELECT s.*, anchor AS line FROM s JOIN r USING (page, y))"""


@query("q_A31_anchors", f"WITH RECURSIVE {_ANCHORED} SELECT page, line, count(*)::BIGINT AS spans, min(y) AS low, max(y) AS high FROM p GROUP BY 1, 2")
def anchors(spark, sf_dir):
    placed = layout.anchored(_spans(spark, sf_dir), ["page"], "y", 1.2)
    return placed.groupBy("page", F.col("anchor").alias("line")).agg(F.count("*").alias("spans"), F.min("y").alias("low"), F.max("y").alias("high"))


@query("q_W15_W16_W36_W38_lines", f"""WITH RECURSIVE {_ANCHORED}, b AS (SELECT *, lag(x + w) OVER z AS br, lag(size) OVER z AS bs, lag(text) OVER z AS bt FROM p WINDOW z AS (PARTITION BY page, line ORDER BY x, seq)),
g AS (SELECT *, CASE WHEN br IS NULL THEN '' WHEN (x - br) / greatest(bs, size) < 0.25 THEN 'none' WHEN (x - br) / greatest(bs, size) >= 2 THEN 'fragment' ELSE 'space' END AS kind, greatest(1, len(trim(text))) AS weight FROM b),
f AS (SELECT page, line, min(x) AS x0, max(x + w) AS x1, (count(*) FILTER (kind = 'fragment') + 1)::BIGINT AS fragments, string_agg(CASE WHEN kind = 'fragment' THEN chr(9) WHEN kind = 'space' AND bt NOT LIKE '% ' THEN ' ' ELSE '' END || text, '' ORDER BY x, seq) AS text FROM g GROUP BY 1, 2),
h AS (SELECT page, line, y, sum(weight) AS wt FROM g GROUP BY 1, 2, 3), hm AS (SELECT page, line, min(y) AS y FROM (SELECT *, sum(wt) OVER (PARTITION BY page, line ORDER BY y) AS upto, sum(wt) OVER (PARTITION BY page, line) AS every FROM h) WHERE 2 * upto >= every GROUP BY 1, 2),
z AS (SELECT page, line, arg_max(size, (wt, size)) AS size FROM (SELECT page, line, size, sum(weight) AS wt FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT page, line, y, x0, x1, size, fragments, text FROM f JOIN hm USING (page, line) JOIN z USING (page, line)""")
def lines(spark, sf_dir):
    return layout.lines(_spans(spark, sf_dir), "page", 1.2)


_LINES = "SELECT l_orderkey AS block, l_linenumber AS pos, (CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber % 2 ELSE l_quantity END)::DOUBLE AS x0, (200 + CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 ELSE l_quantity END)::DOUBLE AS x1, l_linenumber * 10 + CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 10 ELSE 0 END AS y FROM lineitem WHERE l_linenumber <= 7 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1"


def _lines(spark, sf_dir):
    from pyspark.sql import Window

    key, n, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, sf_dir, "lineitem").where(n <= 7).withColumn("_k", first).where("_k = 1").select(
        key.alias("block"), n.alias("at"), F.when(key % 2 == 0, n % 2).otherwise(q).cast("double").alias("x0"), (200 + F.when(key % 3 == 0, n % 2).otherwise(q)).cast("double").alias("x1"),
        (n * 10 + F.when(n % 3 == 0, q / 10).otherwise(0)).alias("y"),
    )


@query("q_A38_W39_justified", f"""WITH l AS ({_LINES}), b AS (SELECT *, count(*) OVER (PARTITION BY block) AS n, row_number() OVER (PARTITION BY block ORDER BY pos) AS k FROM l), u AS (SELECT * FROM b WHERE n >= 3 AND k < n),
s AS (SELECT a.block, a.pos, count(*) FILTER (abs(a.x0 - c.x0) <= 1.5) AS n0, count(*) FILTER (abs(a.x1 - c.x1) <= 1.5) AS n1, count(*) AS n FROM u a JOIN u c USING (block) GROUP BY 1, 2),
j AS (SELECT block, max(n0) / max(n)::DOUBLE >= 0.8 AND max(n1) / max(n)::DOUBLE >= 0.8 AS justified FROM s GROUP BY 1) SELECT DISTINCT block, coalesce(justified, false) AS justified FROM l LEFT JOIN j USING (block)""")
def justified(spark, sf_dir):
    return layout.justified(_lines(spark, sf_dir), ["block"], "at", "x0", "x1")


@query("q_A40_A41_blocks", f"""WITH l AS ({_LINES}), f AS (SELECT block, avg((x1 - x0 >= 0.92 * m AND m > 0)::INT) AS fill FROM (SELECT *, max(x1 - x0) OVER (PARTITION BY block) AS m FROM l) GROUP BY 1),
g AS (SELECT block, gap, row_number() OVER (PARTITION BY block ORDER BY gap) AS k, count(*) OVER (PARTITION BY block) AS n FROM (SELECT block, y - lag(y) OVER (PARTITION BY block ORDER BY y) AS gap FROM l) WHERE gap > 0)
SELECT block, fill, gap AS leading FROM f LEFT JOIN (SELECT block, gap FROM g WHERE k = n // 2 + 1) USING (block)""")
def blocks(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return layout.fill_ratio(rows, ["block"], "x0", "x1").join(layout.leading(rows, ["block"], "y"), "block", "left")


@query("q_A39_coverage", f"SELECT page, point, count(*)::BIGINT AS n FROM (SELECT page, unnest(range(greatest(0, least(399, floor(x)::INT)), least(400, greatest(greatest(0, least(399, floor(x)::INT)) + 1, ceil(x + w)::INT))))::INT AS point FROM ({_SPANS})) GROUP BY 1, 2")
def covered(spark, sf_dir):
    return layout.coverage(_spans(spark, sf_dir), "page", 400)


@query("q_A27_page_fit", f"SELECT page, count(*) FILTER ((x + w / 2 > 100.5 AND x + w / 2 < 139.5) OR (x + w / 2 > 300.5 AND x + w / 2 < 300 + page % 50 - 0.5))::DOUBLE / count(*) AS inside FROM ({_SPANS}) GROUP BY 1")
def fit(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"))
    both = F.array(F.struct(F.lit(100.0).alias("low"), F.lit(140.0).alias("high")), F.struct(F.lit(300.0).alias("low"), (300.0 + F.col("page") % 50).alias("high")))
    gutters = pages.select("page", F.explode(both).alias("g")).select("page", "g.*")
    return layout.page_fit(_spans(spark, sf_dir), gutters, "page")


_BOXES = "SELECT l_orderkey AS page, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS id, l_partkey % 12 AS x, l_suppkey % 12 AS y, l_linenumber + 1 AS w, (l_quantity::INT) % 6 + 1 AS h FROM lineitem"


def _boxes(spark, sf_dir):
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("page"), (key * 100 + n * 10 + F.col("l_partkey") % 10).alias("id"), d(F.col("l_partkey") % 12).alias("x"), d(F.col("l_suppkey") % 12).alias("y"), d(n + 1).alias("w"), d(F.col("l_quantity").cast("int") % 6 + 1).alias("h"),
    )


@query("q_A36_union_area", f"SELECT page, count(*)::DOUBLE AS area FROM (SELECT DISTINCT page, a, b FROM (SELECT page, unnest(range(x, x + w)) AS a, y, h FROM ({_BOXES})), unnest(range(y, y + h)) AS u(b)) GROUP BY 1")
def areas(spark, sf_dir):
    return layout.union_area(_boxes(spark, sf_dir), "page")


_RULES = "SELECT l_orderkey AS page, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id, CASE WHEN l_partkey % 2 = 0 THEN 'h' ELSE 'v' END AS axis, (l_partkey % 30)::DOUBLE AS at, (l_suppkey % 20)::DOUBLE AS low, (l_suppkey % 20 + l_quantity)::DOUBLE AS high FROM lineitem"


@query("q_J13_J14_rule_groups", f"""WITH RECURSIVE r AS ({_RULES}), e AS (SELECT h.id AS a, v.id AS b FROM r h JOIN r v ON h.page = v.page AND h.axis = 'h' AND v.axis = 'v' AND v.at BETWEEN h.low - 4 AND h.high + 4 AND h.at BETWEEN v.low - 4 AND v.high + 4),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT id AS x, id AS y FROM r UNION SELECT c.x, d.b FROM c JOIN d ON c.y = d.a) SELECT x AS id, min(y) AS component FROM c GROUP BY 1""")
def grouped_rules(spark, sf_dir):
    # The ids are made here, by one order over all rows; a real table of rules has its own.
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rules = sequences.numbered(table(spark, sf_dir, "lineitem").select(*order), order, "id", scratch(spark)).select(
        F.col("l_orderkey").alias("page"), F.col("id").cast("long").alias("id"), F.when(F.col("l_partkey") % 2 == 0, "h").otherwise("v").alias("axis"),
        (F.col("l_partkey") % 30).cast("double").alias("at"), (F.col("l_suppkey") % 20).cast("double").alias("low"), (F.col("l_suppkey") % 20 + F.col("l_quantity")).alias("high"),
    )
    return layout.rule_groups(rules, "page", 4.0).select("id", "component")


@query("q_J15_links", f"""WITH s AS ({_SPANS}), l AS (SELECT s_suppkey AS page, k AS ord, 'u' || k AS url, (k * 60)::DOUBLE AS l0, (k * 100)::DOUBLE AS t0 FROM supplier, range(6) x(k))
SELECT s.page, s.seq, s.x, s.y, arg_min(url, ord) AS url FROM (SELECT DISTINCT * FROM s) s LEFT JOIN l ON s.page = l.page AND s.x + s.w / 2 BETWEEN l0 - 1 AND l0 + 121 AND s.y - s.size * 0.35 BETWEEN t0 - 1 AND t0 + 151 GROUP BY 1, 2, 3, 4, s.w, s.size, s.text""")
def linked(spark, sf_dir):
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ord"))
    links = links.select("page", "ord", F.concat(F.lit("u"), F.col("ord").cast("string")).alias("url"), (F.col("ord") * 60.0).alias("left"), (F.col("ord") * 100.0).alias("top"), F.lit(120.0).alias("width"), F.lit(150.0).alias("height"))
    found = layout.link_of(_spans(spark, sf_dir).distinct().withColumn("id", F.concat_ws(":", "page", "seq", "x", "y", "w", "size", "text")), links, "page")
    return found.select("page", "seq", "x", "y", "url")


@query("q_J16_J17_shades", f"""WITH c AS ({_BOXES}), f AS (SELECT o_orderkey AS page, k, CASE k WHEN 0 THEN '#ffffff' WHEN 1 THEN '#aaaaaa' ELSE '#bbbbbb' END AS colour, (o_custkey % 5)::DOUBLE AS x, (o_custkey % 4)::DOUBLE AS y, 6.0 + k * 4 AS w, 5.0 + k * 4 AS h FROM orders, range(3) r(k))
SELECT c.id, c.page, c.x, c.y, c.w, c.h, arg_min(colour, (f.w * f.h, colour)) AS colour FROM (SELECT DISTINCT * FROM c) c LEFT JOIN f ON c.page = f.page AND k > 0 AND f.x <= c.x + 1 AND f.x + f.w >= c.x + c.w - 1 AND f.y <= c.y + 1 AND f.y + f.h >= c.y + c.h - 1 GROUP BY c.id, c.page, c.x, c.y, c.w, c.h""")
def shaded(spark, sf_dir):
    k, key = F.col("k"), F.col("o_custkey")
    fills = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    fills = fills.select("page", F.when(k == 0, "#ffffff").when(k == 1, "#aaaaaa").otherwise("#bbbbbb").alias("colour"), (key % 5).cast("double").alias("x"), (key % 4).cast("double").alias("y"), (6.0 + k * 4).alias("w"), (5.0 + k * 4).alias("h"))
    cells = _boxes(spark, sf_dir).distinct().withColumn("own", F.col("id")).withColumn("id", F.concat_ws(":", "id", "x", "y", "w", "h"))
    return layout.shade_of(cells, fills, "page").select(F.col("own").alias("id"), "page", "x", "y", "w", "h", "colour")


@query("q_J23_best_boxes", """WITH RECURSIVE b AS (SELECT o_custkey AS p, o_orderkey AS id, o_totalprice AS s, (o_orderkey % 9)::DOUBLE AS x, (o_orderkey % 7)::DOUBLE AS y, 6.0::DOUBLE AS w, 5.0::DOUBLE AS h FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, id) AS k FROM b),
r AS (SELECT p, k, [{'id': id, 'x': x, 'y': y}] AS kept FROM o WHERE k = 1
UNION ALL SELECT o.p, o.k, CASE WHEN len(kept) >= 4 OR len(list_filter(kept, lambda q: greatest(0, least(q.x, o.x) + 6 - greatest(q.x, o.x)) * greatest(0, least(q.y, o.y) + 5 - greatest(q.y, o.y)) / (60 - greatest(0, least(q.x, o.x) + 6 - greatest(q.x, o.x)) * greatest(0, least(q.y, o.y) + 5 - greatest(q.y, o.y))) > 0.3)) > 0 THEN kept ELSE list_append(kept, {'id': o.id, 'x': o.x, 'y': o.y}) END FROM r JOIN o ON o.p = r.p AND o.k = r.k + 1),
l AS (SELECT p, arg_max(kept, k) AS kept FROM r GROUP BY 1) SELECT p, unnest(kept).id AS id FROM l""")
def best(spark, sf_dir):
    key = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p"), key.alias("id"), F.col("o_totalprice").alias("score"), (key % 9).cast("double").alias("x"), (key % 7).cast("double").alias("y"), F.lit(6.0).alias("w"), F.lit(5.0).alias("h"))
    return layout.best_boxes(found, "p", 0.3, 4).select("p", "id")


@query("q_J19_outside", f"SELECT page, seq FROM ({_SPANS}) WHERE NOT (x BETWEEN 98.8 AND 251.2 AND y BETWEEN 198.8 AND 401.2) GROUP BY 1, 2")
def outside(spark, sf_dir):
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(100.0).alias("left"), F.lit(200.0).alias("top"), F.lit(150.0).alias("width"), F.lit(200.0).alias("height"))
    return layout.outside(_spans(spark, sf_dir), boxes, "page").select("page", "seq").distinct()


@query("q_W26_list_depths", """WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS page, (l_partkey % 17)::DOUBLE AS x FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x) AS k FROM m),
r AS (SELECT page, x, k, x AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.page, o.x, o.k, CASE WHEN o.x - r.anchor > 3 THEN o.x ELSE r.anchor END FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1)
SELECT page, x, least(3, dense_rank() OVER (PARTITION BY page ORDER BY anchor))::INT AS depth FROM r""")
def depths(spark, sf_dir):
    markers = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 17).cast("double").alias("x")).distinct()
    return layout.list_depths(markers, "page", "x")


@query("q_W27_W28_sections", """WITH s AS (SELECT o_custkey AS doc, o_orderkey AS pos, o_orderstatus AS a, o_orderpriority[1:1] AS b FROM orders), c AS (SELECT *, CASE WHEN lag(a) OVER w IS NOT DISTINCT FROM a AND lag(b) OVER w IS NOT DISTINCT FROM b AND lag(pos) OVER w IS NOT NULL THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos)),
n AS (SELECT *, sum(st) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM c), g AS (SELECT doc, section::BIGINT AS section, min(pos) AS lo, max(pos) AS hi FROM n GROUP BY 1, 2)
SELECT doc, section, lo AS "first", hi AS "last", CASE WHEN lo % 5 = 0 THEN 2 ELSE least(6, dense_rank() OVER (PARTITION BY doc ORDER BY hi - lo DESC)) END::INT AS level FROM g""")
def sectioned(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("a"), F.substring("o_orderpriority", 1, 1).alias("b"))
    found = layout.sections(rows, "doc", "at", ["a", "b"]).withColumn("size", F.col("last") - F.col("first")).withColumn("tagged", F.when(F.col("first") % 5 == 0, 2))
    return layout.heading_levels(found, "doc", "size", "tagged").select("doc", "section", "first", "last", "level")


@query("q_A44_notes", "SELECT o_orderpriority AS code, array_to_string(list_sort(list_distinct(list(p))), ',') AS pages, sum(c)::BIGINT AS count FROM (SELECT o_orderpriority, unnest([o_orderkey % 7, o_custkey % 11]) AS p, 0 AS c FROM orders UNION ALL SELECT o_orderpriority, o_orderkey % 7, 2 FROM orders) GROUP BY 1")
def notes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 11).alias("pages"), F.lit(2).alias("count"))
    return layout.merged_notes(rows, "code").select("code", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "count")


@query("q_A49_background", "SELECT l_suppkey AS picture, avg(l_quantity) AS r, avg(l_linenumber * 10.0::DOUBLE) AS g, avg((l_partkey % 256)::DOUBLE) AS b, round(least(1.0, stddev_pop(l_quantity * 0.299 + l_linenumber * 10 * 0.587 + (l_partkey % 256) * 0.114) / 40), 9) AS spread FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def background(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("picture"), F.col("l_quantity").alias("r"), (F.col("l_linenumber") * 10.0).alias("g"), (F.col("l_partkey") % 256).cast("double").alias("b"))
    return layout.background_spread(pixels, "picture").withColumn("spread", F.round("spread", 9))


_PLAN = "SELECT o_orderkey AS ord, o_custkey % 40 AS file, (o_orderkey % 13)::INT AS page FROM orders"
_FILES = "SELECT n_nationkey::BIGINT AS file, 5 + n_regionkey AS pages FROM nation"


@query("q_J20_plan_faults", f"WITH p AS ({_PLAN}), f AS ({_FILES}) SELECT ord, CASE WHEN pages IS NULL THEN 'missing-file' WHEN page NOT BETWEEN 1 AND pages THEN 'out-of-range' ELSE 'twice' END AS fault FROM (SELECT *, min(ord) OVER (PARTITION BY file, page) AS first FROM p LEFT JOIN f USING (file)) WHERE pages IS NULL OR page NOT BETWEEN 1 AND pages OR ord > first")
def faults(spark, sf_dir):
    return layout.plan_faults(*_plan(spark, sf_dir))


@query("q_J21_checked_plan", f"WITH p AS ({_PLAN}), f AS ({_FILES}) SELECT row_number() OVER (ORDER BY ord)::INT AS ord, file, page FROM (SELECT *, min(ord) OVER (PARTITION BY file, page) AS first FROM p JOIN f USING (file)) WHERE page BETWEEN 1 AND pages AND ord = first")
def planned(spark, sf_dir):
    return layout.checked_plan(*_plan(spark, sf_dir))


def _plan(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 40).alias("file"), (F.col("o_orderkey") % 13).cast("int").alias("page"))
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("file"), (5 + F.col("n_regionkey")).alias("pages"))
    return plan, files
