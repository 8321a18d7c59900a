"""Queries of units, papers, pictures, colours, dates in tables, and small text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dates, numbers
from plumbline.functions import measures as m
from plumbline.functions import text as t
from plumbline.plans.base import DIRTIED, dirtied, query, quote, sql_trim, table

_D = "::DOUBLE"


@query("q_N16_N38_N46_N47_units", "SELECT l_orderkey, l_linenumber, floor(x * 20 + 0.5)::BIGINT AS tw, floor(x * 12700 + 0.5)::BIGINT AS em, floor(x * 20 + 0.5)::BIGINT / 20.0::DOUBLE AS back, floor(x * 12700 + 0.5)::BIGINT / 12700.0::DOUBLE AS back2, least(96, greatest(2, floor(x * 8 + 0.5)))::INT AS eighths, x / 25.4::DOUBLE AS per_mm FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS x FROM lineitem)")
def units(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("x"))
    x = F.col("x")
    return rows.select(
        "l_orderkey", "l_linenumber", m.twips(x).alias("tw"), m.emu(x).alias("em"), m.points_of_twips(m.twips(x)).alias("back"), m.points_of_emu(m.emu(x)).alias("back2"),
        m.border_eighths(x).alias("eighths"), m.pixels_per_mm(x).alias("per_mm"),
    )


@query("q_N17_N18_N41_N44_tolerances", "SELECT p_partkey, greatest(1.2::DOUBLE, 0.3::DOUBLE * b) AS line, greatest(4.0::DOUBLE, 0.7::DOUBLE * b) AS gutter, greatest(4.0::DOUBLE, 0.5::DOUBLE * b) AS rule, ceil(0.06::DOUBLE * p_size)::BIGINT AS budget, CASE WHEN p_size % 7 <> 0 THEN (b + p_size) / 2 END AS mid FROM (SELECT p_partkey, p_size, p_retailprice / 100 AS b FROM part)")
def tolerances(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 100).alias("b"))
    b, high = F.col("b"), F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return rows.select("p_partkey", m.line_tolerance(b).alias("line"), m.least_gutter(b).alias("gutter"), m.rule_gap(b).alias("rule"), m.crossing_budget(F.col("p_size")).alias("budget"), m.midpoint(b, high).alias("mid"))


_PAPER = "CASE p_partkey % 6 WHEN 0 THEN 'a4' WHEN 1 THEN 'letter' WHEN 2 THEN 'legal' WHEN 3 THEN 'a3' WHEN 4 THEN 'a5' ELSE 'foolscap' END"
_WIDE = "CASE p_partkey % 6 WHEN 0 THEN 595.28 WHEN 1 THEN 612 WHEN 2 THEN 612 WHEN 3 THEN 841.89 WHEN 4 THEN 419.53 ELSE 595.28 END::DOUBLE"
_HIGH = "CASE p_partkey % 6 WHEN 0 THEN 841.89 WHEN 1 THEN 792 WHEN 2 THEN 1008 WHEN 3 THEN 1190.55 WHEN 4 THEN 595.28 ELSE 841.89 END::DOUBLE"
_SQL_PAPERS = ", ".join(f"({k}, {quote(name)}, {w}::DOUBLE, {h}::DOUBLE)" for k, (name, (w, h)) in enumerate(m.PAPERS.items()))


@query("q_N29_N30_N31_N33_papers", f"""WITH p AS (SELECT p_partkey, p_size, p_retailprice AS r, {_WIDE} AS w, {_HIGH} AS h FROM part),
n AS (SELECT p_partkey, arg_min(name, (abs(pw - least(r, p_size * 20)) + abs(ph - greatest(r, p_size * 20)), k)) AS nearest FROM p, (VALUES {_SQL_PAPERS}) v(k, name, pw, ph) GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN h ELSE w END AS width, CASE WHEN p_size % 2 = 0 THEN w ELSE h END AS height, nearest,
floor(w * (CASE p_size % 3 WHEN 0 THEN 96 WHEN 1 THEN 150 ELSE 300 END / 96.0::DOUBLE) + 0.5)::BIGINT * floor(h * (CASE p_size % 3 WHEN 0 THEN 96 WHEN 1 THEN 150 ELSE 300 END / 96.0::DOUBLE) + 0.5)::BIGINT AS pixels, CASE WHEN p_size * 20 > w - 72 THEN 'landscape' ELSE 'portrait' END AS orientation FROM p JOIN n USING (p_partkey)""")
def papers(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.expr(_PAPER).alias("paper"))
    upright = m.page_size(F.col("paper"), F.lit("portrait"))
    quality = F.when(size % 3 == 0, "screen").when(size % 3 == 1, "good").otherwise("print")
    return rows.select(
        "p_partkey", m.page_size(F.col("paper"), F.when(size % 2 == 0, "landscape").otherwise("portrait")).alias("s"), m.nearest_paper(F.col("p_retailprice"), size * 20.0).alias("nearest"),
        m.raster_pixels(upright["width"], upright["height"], quality).alias("pixels"), m.auto_orientation(size * 20.0, F.col("paper"), F.lit(36.0)).alias("orientation"),
    ).select("p_partkey", "s.*", "nearest", "pixels", "orientation")


@query("q_N32_N34_N35_columns", """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE least(400.0, greatest(8.0, CASE WHEN l_linenumber % 3 = 0 THEN 48.0 WHEN l_linenumber % 3 = 1 THEN l_quantity * 20 * 0.75 ELSE (l_quantity * 7 + 5) * 0.75 END)) END::DOUBLE AS points FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, points FROM w""")
def widths(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    points = m.column_points(F.when(n % 3 == 1, q * 20), F.when(n % 3 == 2, q), n % 5 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", points.alias("points"))


@query("q_N34_bands", """WITH RECURSIVE a AS (SELECT p_partkey, [p_size * 3.0::DOUBLE, 40.0::DOUBLE, p_size * 7.0::DOUBLE, 90.0::DOUBLE, 15.0::DOUBLE, p_size * 2.0::DOUBLE] AS ws FROM part),
r AS (SELECT p_partkey, ws, 1 AS i, least(ws[1], 200.0) AS used, 0 AS band, [0] AS bands FROM a UNION ALL
SELECT p_partkey, ws, i + 1, CASE WHEN used + least(ws[i + 1], 200.0) > 200.5 THEN least(ws[i + 1], 200.0) ELSE used + least(ws[i + 1], 200.0) END, CASE WHEN used + least(ws[i + 1], 200.0) > 200.5 THEN band + 1 ELSE band END, list_append(bands, CASE WHEN used + least(ws[i + 1], 200.0) > 200.5 THEN band + 1 ELSE band END) FROM r WHERE i < 6)
SELECT p_partkey, array_to_string(bands, ',') AS bands, list_sum(ws) AS natural FROM r WHERE i = 6""")
def bands(spark, sf_dir):
    s = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(s * 3, F.lit(40.0), s * 7, F.lit(90.0), F.lit(15.0), s * 2).alias("ws"))
    return rows.select("p_partkey", F.array_join(F.transform(m.width_bands(F.col("ws"), 200.0), lambda b: b.cast("string")), ",").alias("bands"), F.aggregate("ws", F.lit(0.0), lambda a, b: a + b).alias("natural"))


_PRESET = "CASE p_partkey % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'social' WHEN 2 THEN 'thumb' WHEN 3 THEN 'custom' ELSE 'original' END"


@query("q_N11_N12_N13_N37_F77_pictures", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN l > 1920 THEN 1920 END WHEN 1 THEN CASE WHEN l > 1080 THEN 1080 END WHEN 2 THEN CASE WHEN l > 300 THEN 300 END WHEN 3 THEN CASE WHEN least(1.0, 800 / w, 600 / h) < 1 THEN greatest(1, floor(l * least(1.0, 800 / w, 600 / h) + 0.5)) END END::BIGINT AS edge,
CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN least(20000, floor(h + 0.5)) WHEN 2 THEN NULL ELSE least(20000, floor(p_size * 1000 + 0.5)) END::INT AS pixels, CASE p_partkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'image/webp' END AS kind, p_name || '.' || CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'webp' END AS file,
greatest(32, floor(floor(a * k + 0.5) / 32) * 32)::INT AS model_width, greatest(32, floor(floor(b * k + 0.5) / 32) * 32)::INT AS model_height
FROM (SELECT *, CASE WHEN greatest(a, b) > 1024 THEN 1024.0::DOUBLE / greatest(a, b) ELSE 1.0 END AS k FROM (SELECT *, greatest(w, h) AS l, floor(w * (512 / least(w, h)) + 0.5) AS a, floor(h * (512 / least(w, h)) + 0.5) AS b FROM (SELECT *, p_size * 100.0::DOUBLE AS w, p_retailprice AS h FROM part)))""")
def pictures(spark, sf_dir):
    key, w, h = F.col("p_partkey"), F.col("p_size") * 100.0, F.col("p_retailprice")
    typed = F.when(key % 4 == 0, "").when(key % 4 == 1, F.concat(F.lit(" "), h.cast("string"))).when(key % 4 == 2, "-5").otherwise((F.col("p_size") * 1000).cast("string"))
    source = F.when(key % 3 == 0, "image/jpeg").when(key % 3 == 1, "image/bmp").otherwise("image/bmp")
    kind = m.output_type(source, F.when(key % 3 == 2, "image/webp").otherwise("original"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", m.longest_edge(w, h, F.expr(_PRESET), F.lit(800.0), F.lit(600.0)).alias("edge"), m.pixel_input(typed).alias("pixels"), kind.alias("kind"), m.working_size(w, h).alias("s"),
        F.concat(t.base_name(F.concat("p_name", F.lit(".bmp"))), F.lit("."), m.output_extension(kind)).alias("file"),
    )
    return rows.select("p_partkey", "edge", "pixels", "kind", "file", F.col("s.width").alias("model_width"), F.col("s.height").alias("model_height"))


@query("q_N20_sheet_plan", """SELECT p_partkey, CASE WHEN c2 * r2 > c1 * r1 THEN c2 ELSE c1 END::INT AS columns, CASE WHEN c2 * r2 > c1 * r1 THEN r2 ELSE r1 END::INT AS rows, greatest(c1 * r1, c2 * r2)::INT AS copies FROM (SELECT p_partkey,
greatest(0, floor((102 - 6 + 2) / (w + 2) + 1e-9)) AS c1, greatest(0, floor((152 - 6 + 2) / (h + 2) + 1e-9)) AS r1, greatest(0, floor((152 - 6 + 2) / (w + 2) + 1e-9)) AS c2, greatest(0, floor((102 - 6 + 2) / (h + 2) + 1e-9)) AS r2 FROM (SELECT p_partkey, p_size::DOUBLE AS w, p_size * 1.3::DOUBLE AS h FROM part))""")
def sheets(spark, sf_dir):
    s = F.col("p_size").cast("double")
    plan = m.sheet_plan(F.lit(102.0), F.lit(152.0), s, s * 1.3, F.lit(2.0), F.lit(3.0))
    return table(spark, sf_dir, "part").select("p_partkey", plan.alias("p")).select("p_partkey", "p.*")


@query("q_N23_N24_faces", "SELECT p_partkey, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, round(degrees(atan2(y2 - y1, x2 - x1)), 6) AS tilt, CASE WHEN sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) > 0 THEN round(abs(x1 + 1 - (x1 + x2) / 2) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) ELSE 0 END AS turn FROM (SELECT p_partkey, p_size::DOUBLE AS x1, p_retailprice / 100 AS y1, p_size + p_partkey % 11 + 1.0::DOUBLE AS x2, p_retailprice / 90 AS y2 FROM part)")
def faces(spark, sf_dir):
    s, r, key = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    right, left = point(s, r / 100), point(s + key % 11 + 1.0, r / 90)
    rows = table(spark, sf_dir, "part").select("p_partkey", m.eye_line(right, left).alias("e"), m.turned_share(right, left, point(s + 1, r)).alias("turn"))
    return rows.select("p_partkey", "e.x", "e.y", F.round("e.tilt", 6).alias("tilt"), F.round("turn", 6).alias("turn"))


_HEXA = "printf('%06x', (p_partkey * 7919 + p_size * 104729) % 16777216)"


@query("q_N25_N26_F83_colours", f"""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE r END::INT AS r, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE g END::INT AS g, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE b END::INT AS b, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE round(r / 255.0::DOUBLE, 9) END AS share,
CASE WHEN p_partkey % 10 <> 0 THEN round(least(sqrt((r - 255) ** 2 + (g - 255) ** 2 + (b - 255) ** 2), sqrt((r - 170) ** 2 + (g - 187) ** 2 + (b - 204) ** 2)), 6) END AS away FROM (SELECT p_partkey, ('0x' || substr(x, 1, 2))::INT AS r, ('0x' || substr(x, 3, 2))::INT AS g, ('0x' || substr(x, 5, 2))::INT AS b FROM (SELECT p_partkey, p_size, {_HEXA} AS x FROM part))""")
def colours(spark, sf_dir):
    number = (F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 16777216
    text = F.when(F.col("p_partkey") % 10 == 0, "#12345z").otherwise(F.concat(F.lit(" #"), F.lpad(F.lower(F.hex(number)), 6, "0")))
    rows = table(spark, sf_dir, "part").select("p_partkey", m.hex_colour(text).alias("c"), m.hex_share(text).alias("s"))
    return rows.select("p_partkey", "c.*", F.round("s.r", 9).alias("share"), F.round(m.swatch_distance(F.col("c.r"), F.col("c.g"), F.col("c.b"), ["#fff", "#aabbcc"]), 6).alias("away"))


@query("q_N22_fit_dpi", """WITH RECURSIVE r AS (SELECT p_partkey, w, h, CASE WHEN floor(w * (600 / 25.4::DOUBLE) + 0.5) * floor(h * (600 / 25.4::DOUBLE) + 0.5) > 16777216 THEN greatest(72, floor(600 * sqrt(16777216 / (floor(w * (600 / 25.4::DOUBLE) + 0.5) * floor(h * (600 / 25.4::DOUBLE) + 0.5))) / 25) * 25) ELSE 600 END::INT AS d FROM (SELECT p_partkey, p_size * 20.0::DOUBLE AS w, p_size * 30.0::DOUBLE AS h FROM part)
UNION SELECT p_partkey, w, h, CASE WHEN d > 72 THEN d - 25 ELSE d - 1 END FROM r WHERE d > 1 AND floor(w * (d / 25.4::DOUBLE) + 0.5) * floor(h * (d / 25.4::DOUBLE) + 0.5) > 16777216) SELECT p_partkey, greatest(1, min(d))::INT AS dpi FROM r GROUP BY 1""")
def fitted(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", m.fitting_dpi(F.lit(600), s * 20.0, s * 30.0).cast("int").alias("dpi"))


# ---- dates and cells of tables on pages

_PLACED = "CASE o_orderkey % 8 WHEN 0 THEN date_format(o_orderdate, 'yyyy.M.d') WHEN 1 THEN date_format(o_orderdate, 'd-MMM-yy') WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 4 THEN date_format(o_orderdate, 'MM-dd-yy') WHEN 5 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 6 THEN '31/02/2020' ELSE o_orderpriority END"
_DAY, _MONTH, _ISO = "extract(day FROM o_orderdate)", "extract(month FROM o_orderdate)", "strftime(o_orderdate, '%Y-%m-%d')"
_MAY = "o_orderkey % 8 IN (3, 4, 5)"
_FLIPPED = f"CASE WHEN o_orderkey % 8 = 4 AND {_DAY} <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE {_ISO} END"


@query("q_D08_D09_placed_dates", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 >= 6 THEN NULL ELSE {_FLIPPED} END AS iso, CASE o_orderkey % 8 WHEN 0 THEN 'ymd' WHEN 1 THEN 'dmy' WHEN 2 THEN 'mdy' WHEN 4 THEN CASE WHEN {_DAY} > 12 THEN 'mdy' ELSE 'dmy' END WHEN 3 THEN 'dmy' WHEN 5 THEN 'dmy' END AS "order",
CASE WHEN o_orderkey % 8 >= 6 THEN NULL ELSE {_MAY} AND {_DAY} <= 12 END AS ambiguous, CASE WHEN o_orderkey % 8 >= 6 OR ({_MAY} AND {_DAY} <= 12) THEN NULL ELSE {_ISO} END AS sure FROM orders""")
def placed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PLACED).alias("v"))
    return rows.select("o_orderkey", dates.placed_date(F.col("v"), "dmy").alias("d"), dates.placed_date(F.col("v"))["iso"].alias("sure")).select("o_orderkey", "d.iso", "d.order", "d.ambiguous", "sure")


@query("q_D11_D12_D13_serials", "SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 06:00:00' WHEN 2 THEN ' 12:00:00' ELSE ' 18:00:00' END AS iso, strftime(o_orderdate::DATE, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN o_orderkey % 3 = 0 THEN -2 WHEN o_orderkey % 3 = 1 THEN -3 ELSE 40 END::BIGINT AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'year' WHEN o_orderkey % 3 = 1 THEN 'day' ELSE 'second' END AS unit FROM orders")
def serial_texts(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    seconds = day.cast("long") * 86400
    now = seconds + F.when(key % 3 == 0, 2 * 31_536_000).when(key % 3 == 1, 3 * 86400).otherwise(-40)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_of_serial(day + 25569 + (key % 4) / 4.0).alias("iso"), dates.epoch_text(seconds, now).alias("e"))
    return rows.select("o_orderkey", "iso", "e.at", "e.relative.n", "e.relative.unit")


@query("q_A21_A22_N03_orders", "SELECT o_orderpriority, CASE WHEN a > 0 OR b > 0 THEN CASE WHEN a >= b THEN 'dmy' ELSE 'mdy' END WHEN n > 0 THEN 'dmy' END AS \"order\", abs(s - (s + 0.005)) <= greatest(0.01, abs(s) * 1e-9) AS matches FROM (SELECT o_orderpriority, count(*) FILTER (extract(day FROM o_orderdate) > 12 AND o_orderkey % 3 = 0) AS a, count(*) FILTER (extract(day FROM o_orderdate) > 12 AND o_orderkey % 3 = 1) AS b, count(*) FILTER (extract(day FROM o_orderdate) <= 12) AS n, sum(o_shippriority0) AS s FROM (SELECT *, 1.0::DOUBLE AS o_shippriority0 FROM orders) GROUP BY 1)")
def orders_of(spark, sf_dir):
    key = F.col("o_orderkey")
    v = F.when(key % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(key % 3 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.when(F.dayofmonth("o_orderdate") <= 12, F.date_format("o_orderdate", "dd/MM/yyyy")))
    d = dates.placed_date(v)
    said = lambda o: F.count_if((F.col("d.order") == o) & ~F.col("d.ambiguous"))
    by = table(spark, sf_dir, "orders").select("o_orderpriority", d.alias("d")).groupBy("o_orderpriority").agg(said("dmy").alias("a"), said("mdy").alias("b"), F.count_if("d.ambiguous").alias("n"), F.count("*").alias("s"))
    return by.select("o_orderpriority", dates.column_order(F.col("a"), F.col("b"), F.col("n")).alias("order"), numbers.sums_match(F.col("s") + 0.005, F.col("s").cast("double")).alias("matches"))


_CELL = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN format_string('$%,.2f', o_totalprice) WHEN 2 THEN ' ' WHEN 3 THEN o_orderpriority ELSE 'n/a' END"
_COLUMN = "CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'money' ELSE 'text' END"


@query("q_N07_typed_cells", f"""SELECT o_orderkey, kind, CASE WHEN kind = 'date' THEN {_ISO} END AS iso, CASE WHEN kind = 'number' THEN round(o_totalprice, 2) END AS number, CASE WHEN kind = 'text' THEN CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN format('${{:,.2f}}', o_totalprice) WHEN 3 THEN o_orderpriority ELSE 'n/a' END END AS text, kind = 'text' AND o_orderkey % 3 <> 2 AS off_type
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 2 THEN 'empty' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'date' WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 = 1 THEN 'number' ELSE 'text' END AS kind FROM orders)""")
def typed_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CELL).alias("v"), F.expr(_COLUMN).alias("c"))
    return rows.select("o_orderkey", numbers.typed_cell(F.col("v"), F.col("c"), F.lit("dmy")).alias("t")).select("o_orderkey", "t.*")


_COERCED = "CASE event_id % 11 WHEN 0 THEN '007' WHEN 1 THEN cast(event_id as string) WHEN 2 THEN concat('9007199254740', cast(event_id % 1000 + 1000 as string)) WHEN 3 THEN 'TRUE' WHEN 4 THEN 'Null' WHEN 5 THEN concat(cast(event_id as string), 'e3') WHEN 6 THEN '{}' WHEN 7 THEN ' ' WHEN 8 THEN concat(' -', cast(event_id as string), '.25 ') WHEN 9 THEN props ELSE event_type END"


@query("q_N08_coerced_values", """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'text' WHEN 1 THEN 'number' WHEN 2 THEN 'text' WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN 'number' WHEN 6 THEN 'object' WHEN 7 THEN 'blank' WHEN 8 THEN 'number' ELSE 'text' END AS kind,
CASE event_id % 11 WHEN 1 THEN event_id WHEN 5 THEN event_id * 1000 WHEN 8 THEN -event_id - 0.25 END::DOUBLE AS number, CASE event_id % 11 WHEN 0 THEN '007' WHEN 2 THEN '9007199254740' || (event_id % 1000 + 1000) WHEN 7 THEN ' ' WHEN 9 THEN props WHEN 10 THEN event_type END AS text FROM events""")
def coerced_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.coerced(F.expr(_COERCED)).alias("c")).select("event_id", "c.*")


# ---- small text functions


@query("q_F14_contract_indent", "SELECT o_orderkey, repeat(chr(9), (n // 4)::INT) || repeat(' ', (n % 4)::INT) || o_orderpriority || '  x' AS out FROM (SELECT *, o_orderkey % 11 + CASE WHEN o_orderkey % 2 = 0 THEN 4 - (o_orderkey % 11) % 4 ELSE 0 END AS n FROM orders)")
def contracted(spark, sf_dir):
    key = F.col("o_orderkey")
    line = F.concat(F.repeat(F.lit(" "), (key % 11).cast("int")), F.when(key % 2 == 0, "\t").otherwise(""), "o_orderpriority", F.lit("  x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.contract_indent(line).alias("out"))


@query("q_F15_F45_lines", "SELECT doc_id, CASE WHEN v = '' THEN 0 ELSE len(string_split_regex(v, '\\r\\n|\\n|\\r')) END::BIGINT AS n, CASE WHEN v <> '' THEN string_split_regex(v, '\\r\\n|\\n|\\r')[1] END AS first FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 4 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 4 = 1 THEN replace(text, chr(10), chr(13)) ELSE text END AS v FROM documents)")
def lined(spark, sf_dir):
    key, c = F.col("doc_id"), F.col("text")
    v = F.when(key % 9 == 0, "").when(key % 4 == 0, F.replace(c, F.lit("\n"), F.lit("\r\n"))).when(key % 4 == 1, F.replace(c, F.lit("\n"), F.lit("\r"))).otherwise(c)
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", t.count_lines(F.col("v")).alias("n"), F.get(t.split_lines(F.col("v")), F.lit(0)).alias("first"))


@query("q_F22_F34_names", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 17 = 0 THEN '' WHEN contains(text, ' the ') THEN CASE WHEN doc_id % 3 = 0 THEN 'Zero-width space|No-break space|Soft hyphen|Ideographic space' ELSE 'Zero-width space|Soft hyphen' END ELSE CASE WHEN doc_id % 3 = 0 THEN 'Zero-width space|No-break space|Ideographic space' ELSE 'Zero-width space' END END WHEN doc_id % 3 = 0 AND doc_id % 17 <> 0 THEN 'No-break space|Ideographic space' ELSE '' END AS names, CASE doc_id % 6 WHEN 0 THEN 'Comma' WHEN 1 THEN 'Semicolon' WHEN 2 THEN 'Tab' WHEN 3 THEN 'Pipe' WHEN 4 THEN 'Unit separator' ELSE '\":\"' END AS mark FROM documents")
def named(spark, sf_dir):
    key = F.col("doc_id")
    mark = F.element_at(F.array(*[F.lit(x) for x in (",", ";", "\t", "|", "\x1f", ":")]), (key % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", dirtied(F.col("text"), key).alias("v"), mark.alias("mark"))
    return rows.select("doc_id", F.array_join(t.invisible_names(F.col("v")), "|").alias("names"), t.separator_name(F.col("mark")).alias("mark"))


@query("q_T11_invisible_places", f"""WITH d AS (SELECT doc_id, {DIRTIED} AS v FROM documents), c AS (SELECT doc_id, unnest(string_split(v, '')) AS ch, generate_subscripts(string_split(v, ''), 1) AS i FROM d),
l AS (SELECT *, count(*) FILTER (ch = chr(10)) OVER w AS line0, max(CASE WHEN ch = chr(10) THEN i ELSE 0 END) OVER w AS start FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(ch, {quote(f'{t.FORMATTING}|{t.ODD_SPACE}|{t.CONTROL}')}))
SELECT doc_id, (line0 + 1)::BIGINT AS line, (i - start)::BIGINT AS col, 'U+' || upper(lpad(printf('%x', ord(ch)), 4, '0')) AS code FROM h WHERE k <= 20""")
def placed_invisibles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", dirtied(F.col("text"), F.col("doc_id")).alias("v"))
    found = rows.where(t.has_invisible(F.col("v"))).select("doc_id", F.explode(t.invisible_places(F.col("v"))).alias("p"))
    return found.select("doc_id", "p.line", F.col("p.column").alias("col"), "p.code")


@query("q_F44_F62_counts", "SELECT event_id, CASE WHEN event_id = 1 THEN '1 row' ELSE format('{:,}', event_id) || ' rows' END AS rows, CASE WHEN abs(d) >= 3600000 THEN floor(d / 3600000.0::DOUBLE + 0.5) WHEN abs(d) >= 60000 THEN floor(d / 60000.0::DOUBLE + 0.5) ELSE floor(d / 1000.0::DOUBLE + 0.5) END::BIGINT AS n, CASE WHEN abs(d) >= 3600000 THEN 'hour' WHEN abs(d) >= 60000 THEN 'minute' ELSE 'second' END AS unit FROM (SELECT event_id, (event_id % 90) * (event_id % 90) * 1000 - 4000000 AS d FROM events)")
def counted(spark, sf_dir):
    key = F.col("event_id")
    delta = (key % 90) * (key % 90) * 1000 - 4000000
    return table(spark, sf_dir, "events").select("event_id", t.plural(key, "row").alias("rows"), t.relative_unit(delta).alias("r")).select("event_id", "rows", "r.n", "r.unit")


_MARKER = "CASE l_orderkey % 7 WHEN 0 THEN '•' WHEN 1 THEN concat(l_linenumber, '.') WHEN 2 THEN concat('(', chr(96 + l_linenumber), ')') WHEN 3 THEN 'xiv)' WHEN 4 THEN '-' WHEN 5 THEN ' * ' ELSE 'no' END"
_FONT = "CASE l_orderkey % 5 WHEN 0 THEN 'Liberation Mono' WHEN 1 THEN 'Times New Roman' WHEN 2 THEN 'Arial' WHEN 3 THEN 'DejaVu Serif' ELSE NULL END"


@query("q_F50_F84_marks", "SELECT l_orderkey, l_linenumber, l_orderkey % 7 NOT IN (3, 6) AND l_quantity <= 1.6::DOUBLE * 12 AS marker, CASE l_orderkey % 5 WHEN 0 THEN 'mono' WHEN 1 THEN 'serif' WHEN 3 THEN 'serif' ELSE 'sans' END AS family FROM lineitem")
def marks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.is_list_marker(F.expr(_MARKER), F.col("l_quantity"), F.lit(12.0)).alias("marker"), t.font_family(F.expr(_FONT)).alias("family"))


@query("q_F55_heading_text", "SELECT p_partkey, p_name || ' ' || p_type || ' code ' || p_brand || ' end' AS out FROM part")
def heading(spark, sf_dir):
    raw = F.concat(F.lit("  **"), "p_name", F.lit("** ["), "p_type", F.lit("](http://x.org/a_b) `code` <b>"), "p_brand", F.lit("</b>  ~~end~~ "))
    return table(spark, sf_dir, "part").select("p_partkey", t.heading_text(raw).alias("out"))


@query("q_F56_F57_scripts", "SELECT p_partkey, (code BETWEEN 32 AND 126) OR (code BETWEEN 161 AND 255) OR chr(code) IN ('€', '‚', 'ƒ', '„', '…', '†', '‡', 'ˆ', '‰', 'Š', '‹', 'Œ', 'Ž', '‘', '’', '“', '”', '•', '–', '—', '˜', '™', 'š', '›', 'œ', 'ž', 'Ÿ') AS drawable, CASE WHEN code BETWEEN 1024 AND 1327 THEN 'Cyrillic' WHEN code BETWEEN 880 AND 1023 THEN 'Greek' WHEN code BETWEEN 1424 AND 1535 THEN 'Hebrew' WHEN code BETWEEN 1536 AND 1791 THEN 'Arabic' WHEN code BETWEEN 2304 AND 2431 THEN 'Devanagari' WHEN code BETWEEN 2432 AND 3583 THEN 'an Indian script' WHEN code BETWEEN 3584 AND 3711 THEN 'Thai' WHEN code BETWEEN 12352 AND 12543 THEN 'Japanese' WHEN code BETWEEN 4352 AND 4607 OR code BETWEEN 44032 AND 55215 THEN 'Korean' WHEN code BETWEEN 13312 AND 40959 THEN 'Chinese, Japanese or Korean' WHEN code >= 126976 THEN 'emoji' WHEN code BETWEEN 256 AND 591 THEN 'accented Latin' ELSE 'symbols' END AS script FROM (SELECT p_partkey, (32 + (p_partkey * 37) % 50000)::INT AS code FROM part)")
def scripts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (32 + (F.col("p_partkey") * 37) % 50000).cast("int").alias("code"))
    char = F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32")
    return rows.select("p_partkey", t.drawable(char).alias("drawable"), t.script_of(F.col("code")).alias("script"))


@query("q_F85_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'word/media/a.png' WHEN 1 THEN 'media/a.png' WHEN 2 THEN 'http://x/y' ELSE 'word/b/a.png' END AS out FROM pages")
def parts(spark, sf_dir):
    key = F.col("page_id") % 4
    target = F.when(key == 0, "media/./a.png").when(key == 1, "../media/a.png").when(key == 2, "http://x/y").otherwise("/b//c/../a.png")
    return table(spark, sf_dir, "pages").select("page_id", t.resolved_part(F.lit("word/document.xml"), target).alias("out"))


@query("q_F12_whitespace_notes", f"""WITH d AS (SELECT doc_id, replace({DIRTIED}, chr(10), CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || ' ' || chr(10) ELSE '  ' || chr(10) END) AS v FROM documents),
s AS (SELECT doc_id, v, len(regexp_extract_all(v, {quote(t.FORMATTING)}))::BIGINT AS a, len(regexp_extract_all(v, {quote(t.ODD_SPACE)}))::BIGINT AS o, regexp_replace(regexp_replace(v, {quote(t.FORMATTING)}, '', 'g'), {quote(t.ODD_SPACE)}, ' ', 'g') || chr(10) AS p FROM d),
r AS (SELECT *, regexp_replace(p, '[ \\t]+\\n', chr(10), 'g') AS q FROM s), u AS (SELECT *, regexp_replace(q, '(^|\\n)\\n(\\n)+', '\\1' || chr(10), 'g') AS z FROM r)
SELECT doc_id, substr(z, 1, len(z) - 1) AS output, array_to_string(list_filter(['invisible=' || a, 'odd-spaces=' || o, 'trailing=' || (len(p) - len(q)), 'blank-run=' || (len(q) - len(z))], lambda x: x NOT LIKE '%=0'), '|') AS notes FROM u""")
def whitespace_notes(spark, sf_dir):
    key = F.col("doc_id")
    raw = F.replace(dirtied(F.col("text"), key), F.lit("\n"), F.when(key % 4 == 0, "\n\n \n").otherwise("  \n"))
    out = t.clean_whitespace("v", "doc_id", table(spark, sf_dir, "documents").select("doc_id", raw.alias("v")))
    return out.select("doc_id", "output", F.array_join(F.transform("notes", lambda n: F.concat(n["id"], F.lit("="), n["count"].cast("string"))), "|").alias("notes"))
