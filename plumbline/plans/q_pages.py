"""Queries of tables and columns on pages, over pages made of whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import fold, wrap
from plumbline.operators import columns, grids, paragraphs, running, sheets, trees
from plumbline.plans.base import keyed, query, table
from plumbline.session import scratch

#: Statements: a document a supplier, 30 of its line items a page, each a line of four columns; some go on in a line below.
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS n FROM lineitem"
_ITEMS = f"SELECT l_suppkey AS doc, n // 30 AS page, n % 30 AS k, 100 + 17 * (n // 30 % 9) + 18 * (n % 30) AS top, strftime(l_shipdate, '%d/%m/%Y') AS a, 'part ' || l_partkey AS b, l_quantity::INT || '.50' AS c, (1000 + n) || '.00' AS d FROM ({_NUMBERED})"
_CELLS = """s AS (
    SELECT doc, page, (k * 10)::BIGINT AS seq, top AS y, unnest([{'t': a, 'x': 50}, {'t': b, 'x': 120}, {'t': c, 'x': 400 - 5 * len(c)}, {'t': d, 'x': 480 - 5 * len(d)}]) AS s FROM i
    UNION ALL SELECT doc, page, k * 10 + 4, top + 9, {'t': 'and more of it', 'x': 120} FROM i WHERE k % 5 = 3
    UNION ALL SELECT DISTINCT doc, page, 400, 82 + 17 * (page % 9), unnest([{'t': 'Date', 'x': 50}, {'t': 'Details', 'x': 120}, {'t': 'Paid', 'x': 380}, {'t': 'Balance', 'x': 445}]) FROM i
    UNION ALL SELECT DISTINCT doc, page, 500, 60, {'t': 'All that was paid to and by this account up to the day of this statement', 'x': 50} FROM i
), runs AS (SELECT doc, page, s.t AS text, s.x::DOUBLE AS x, y::DOUBLE AS y, 5.0::DOUBLE * len(s.t) AS w, seq FROM s)"""


def _items(spark, sf_dir):
    keys = "l_orderkey l_linenumber l_partkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    n = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)) - 1).alias("n")
    return keyed(spark, sf_dir, "lineitem", "l_suppkey").select("*", n).select(
        F.col("l_suppkey").alias("doc"), F.expr("n div 30").alias("page"), (F.col("n") % 30).alias("k"), F.expr("100 + 17 * (n div 30 % 9) + 18 * (n % 30)").alias("top"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("a"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("b"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".50")).alias("c"), F.concat((1000 + F.col("n")).cast("string"), F.lit(".00")).alias("d"),
    )


def _some(on, values):
    """An array, empty where a condition doesn't hold."""
    return F.when(on, values).otherwise(F.slice(values, 1, 0))


def _statements(spark, sf_dir):
    """doc, page, seq, text, x, y, w, size, body."""
    items = _items(spark, sf_dir)
    put = lambda text, x, right=False: F.struct(text.alias("t"), (F.lit(x) - 5 * F.length(text) if right else F.lit(x)).cast("double").alias("x"))
    # Each page begins with its item 0, which brings the page's own lines, so that items are numbered once.
    line = lambda seq, y, *texts: F.array(*[F.struct(seq.cast("long").alias("seq"), y.cast("double").alias("y"), s.alias("s")) for s in texts])
    k, top = F.col("k"), F.col("top")
    own = line(k * 10, top, put(F.col("a"), 50), put(F.col("b"), 120), put(F.col("c"), 400, True), put(F.col("d"), 480, True))
    more = line(k * 10 + 4, top + 9, put(F.lit("and more of it"), 120))
    head = line(F.lit(400), 82 + 17 * (F.col("page") % 9), put(F.lit("Date"), 50), put(F.lit("Details"), 120), put(F.lit("Paid"), 380), put(F.lit("Balance"), 445))
    title = line(F.lit(500), F.lit(60), put(F.lit("All that was paid to and by this account up to the day of this statement"), 50))
    every = items.select("doc", "page", F.explode(F.concat(own, _some(k % 5 == 3, more), _some(k == 0, F.concat(head, title)))).alias("l")).select("doc", "page", "l.*")
    return every.select("doc", "page", "seq", F.col("s.t").alias("text"), F.col("s.x").alias("x"), "y", (5.0 * F.length("s.t")).alias("w"), F.lit(10.0).alias("size"), F.lit(10.0).alias("body"))


@query("q_A26_column_profile", f"""WITH i AS MATERIALIZED ({_ITEMS}), {_CELLS}, e AS (SELECT doc, min(x) AS lo, max(x + w) AS hi, floor(0.08::DOUBLE * count(DISTINCT (page, y))) AS most FROM runs GROUP BY 1),
p AS (SELECT doc, unnest(range(greatest(0, floor((x - lo) / 0.5))::INT, least(ceil((hi - lo) / 0.5), ceil((x + w - lo) / 0.5))::INT + 1)) AS b FROM runs JOIN e USING (doc)),
c AS (SELECT doc, b FROM p JOIN e USING (doc) GROUP BY doc, b, most HAVING count(*) > most),
g AS (SELECT doc, lag(b, 1, -1) OVER w + 1 AS f, b AS t FROM c WINDOW w AS (PARTITION BY doc ORDER BY b)), h AS (SELECT doc, lo + f * 0.5 AS f, lo + t * 0.5 AS t FROM g JOIN e USING (doc) WHERE (t - f) * 0.5 >= 7),
k AS (SELECT doc, x0, coalesce(lead(f) OVER (PARTITION BY doc ORDER BY x0), hi) AS x1 FROM (SELECT doc, lo AS x0, NULL AS f, hi FROM e UNION ALL SELECT doc, t, f, hi FROM h JOIN e USING (doc)) q),
m AS (SELECT k.doc, x0, x1, x, x + w AS r FROM k JOIN runs ON k.doc = runs.doc AND x + w / 2 BETWEEN x0 AND x1 WHERE x1 - x0 > 0.01),
v AS (SELECT doc, x0, x1, q.s AS s, q.v AS v, count(*) AS n FROM (SELECT doc, x0, x1, unnest([{{'s': 'l', 'v': x}}, {{'s': 'r', 'v': r}}]) AS q FROM m) GROUP BY ALL),
z AS (SELECT *, sum(st) OVER (PARTITION BY doc, x0, s ORDER BY v ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc, x0, s ORDER BY v) > 3 THEN 1 ELSE 0 END AS st FROM v)),
b AS (SELECT doc, x0, x1, s, max({{'n': n, 'm': -pos}}) AS b, sum(n)::BIGINT AS support FROM (SELECT doc, x0, x1, s, c, sum(n) AS n, sum(v * n) / sum(n) AS pos FROM z GROUP BY ALL) GROUP BY ALL),
o AS (SELECT doc, x0, x1, max(support) AS support, max(b.n) FILTER (s = 'l') / max(support)::DOUBLE AS ls, max(-b.m) FILTER (s = 'l') AS la, max(b.n) FILTER (s = 'r') / max(support)::DOUBLE AS rs, max(-b.m) FILTER (s = 'r') AS ra FROM b GROUP BY ALL)
SELECT doc, (row_number() OVER w - 1)::INT AS col, x0, x1, CASE WHEN rs >= ls AND rs >= 0.8 THEN 'right' WHEN ls > rs AND ls >= 0.8 THEN 'left' ELSE 'ragged' END AS align, round(CASE WHEN rs >= ls AND rs >= 0.8 THEN ra ELSE la END, 6) AS anchor, ls AS left_share, rs AS right_share, support, (x1 + lead(x0) OVER w) / 2 AS until
FROM o WINDOW w AS (PARTITION BY doc ORDER BY x0)""")
def profiles(spark, sf_dir):
    lines = columns.page_lines(_statements(spark, sf_dir), ["doc", "page"], "body")
    return columns.profile_of_lines(lines, ["doc"], columns.SCOUT, scratch(spark)).withColumn("anchor", F.round("anchor", 6)).drop("gutters")


@query("q_F47_F48_joined_spans", f"WITH i AS MATERIALIZED ({_ITEMS}), {_CELLS} SELECT doc, page, y AS line, y, string_agg(text, ' ' ORDER BY x) AS text FROM runs GROUP BY 1, 2, 3")
def joined(spark, sf_dir):
    return columns.texts_of_lines(columns.page_lines(_statements(spark, sf_dir), ["doc", "page"], "body"), ["doc"])


@query("q_P04_P09_P10_P11_W25_column_tables", f"""WITH i AS MATERIALIZED ({_ITEMS})
SELECT doc, page, top::DOUBLE AS line, a || '|' || b || '|' || c || '|' || d AS cells, false AS overflow FROM i
UNION ALL SELECT doc, page, top + 9, '|and more of it||', false FROM i WHERE k % 5 = 3 UNION ALL SELECT DISTINCT doc, page, 82 + 17 * (page % 9), 'Date|Details|Paid|Balance', false FROM i""")
def column_tables(spark, sf_dir):
    rows, _ = columns.column_tables(_statements(spark, sf_dir), ["doc"], "body", scratch(spark))
    return rows.select("doc", "page", "line", F.array_join("cells", "|").alias("cells"), "overflow")


#: Set text: a page a supplier, its line items as lines in one to three columns, or as narrow cells that are no columns of text.
_SET = f"SELECT l_suppkey AS page, least(3, 1 + l_suppkey % 4) AS cols, l_suppkey % 4 = 3 AS cells, n % least(3, 1 + l_suppkey % 4) AS col, n // least(3, 1 + l_suppkey % 4) AS k, l_partkey FROM ({_NUMBERED})"
_PLACED = f"SELECT *, (50 + 190 * col)::DOUBLE AS x, (60 + 12 * k)::DOUBLE AS y, (CASE WHEN cells THEN 20 + l_partkey % 150 WHEN k % 5 = 4 THEN 80 WHEN l_partkey % 5 = 0 THEN 166 ELSE 168 END)::DOUBLE AS w FROM ({_SET})"


@query("q_P16_text_columns", f"""WITH s AS ({_PLACED}), p AS (SELECT page, cols, cells, min(x) AS x0, max(x + w) AS x1 FROM s GROUP BY 1, 2, 3)
SELECT page, col::INT AS col, min(x) AS x0, max(x + w) AS x1 FROM s WHERE NOT cells GROUP BY 1, 2 UNION ALL SELECT page, 0, x0, x1 FROM p WHERE cells""")
def text_columns(spark, sf_dir):
    keys = "l_orderkey l_linenumber l_partkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    n = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)) - 1).alias("n")
    rows = keyed(spark, sf_dir, "lineitem", "l_suppkey").select("*", n).withColumn("cols", F.least(F.lit(3), 1 + F.col("l_suppkey") % 4)).withColumn("k", F.expr("n div cols"))
    w = F.when(F.col("l_suppkey") % 4 == 3, 20 + F.col("l_partkey") % 150).when(F.col("k") % 5 == 4, 80).when(F.col("l_partkey") % 5 == 0, 166).otherwise(168)
    spans = rows.select(
        F.col("l_suppkey").alias("page"), F.col("n").cast("long").alias("seq"), F.lit("words").alias("text"), (50 + 190 * (F.col("n") % F.col("cols"))).cast("double").alias("x"), (60 + 12 * F.col("k")).cast("double").alias("y"),
        w.cast("double").alias("w"), F.lit(10.0).alias("size"), F.lit(10.0).alias("body"), F.lit(620.0).alias("width"),
    )
    return columns.text_columns(spans, ["page"], "body", "width", scratch(spark)).select("page", F.col("col").cast("int").alias("col"), "x0", "x1")


#: Grids: one a customer, ten pages a document; edges inside are missing upright on even pages, level on odd ones, never two next to each other.
_SIZES = "SELECT c_custkey // 10 AS doc, (c_custkey % 10)::INT AS page, c_custkey AS k, 2 + c_custkey // 3 % 3 AS cols, 2 + c_custkey % 4 AS rows FROM customer"
_UPRIGHT = "(k % 2 = 0 AND c > 0 AND c < cols AND (k + r + c) % 3 = 0)"
_LEVEL = "(k % 2 = 1 AND r > 0 AND r < rows AND (k + r + c) % 3 = 0)"
_EDGES = f"""z AS MATERIALIZED ({_SIZES}), v AS (SELECT * FROM (SELECT *, unnest(range(cols + 1)) AS c FROM z), unnest(range(rows)) AS u(r) WHERE NOT {_UPRIGHT}), h AS (SELECT * FROM (SELECT *, unnest(range(cols)) AS c FROM z), unnest(range(rows + 1)) AS u(r) WHERE NOT {_LEVEL}),
e AS (SELECT doc, page, k, cols, rows, 'v' AS axis, 50 + 40 * c + (k + r) % 3 * 0.25 AS pos, c AS i FROM v UNION ALL SELECT doc, page, k, cols, rows, 'h', 60 + 30 * r + (k + c) % 3 * 0.25, r FROM h)"""


def _sizes(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("doc"), (key % 10).cast("int").alias("page"), key.alias("k"), F.expr("2 + c_custkey div 3 % 3").cast("int").alias("cols"), (2 + key % 4).cast("int").alias("rows"))


def _rules(spark, sf_dir, whole=False):
    """doc, page, id, axis, at, low, high, thickness: a rule an edge."""
    until = lambda n: F.explode(F.sequence(F.lit(0), n))
    k, r, c = F.col("k"), F.col("r"), F.col("c")
    turn = (k + r + c) % 3 == 0
    upright = _sizes(spark, sf_dir).withColumn("c", until(F.col("cols"))).withColumn("r", until(F.col("rows") - 1))
    level = _sizes(spark, sf_dir).withColumn("c", until(F.col("cols") - 1)).withColumn("r", until(F.col("rows")))
    if not whole:
        upright = upright.where(~((k % 2 == 0) & (c > 0) & (c < F.col("cols")) & turn))
        level = level.where(~((k % 2 == 1) & (r > 0) & (r < F.col("rows")) & turn))
    told = lambda rows, axis, at, low, step: rows.select("doc", "page", (r * 1000 + c * 2 + F.lit(int(axis == "v"))).cast("long").alias("id"), F.lit(axis).alias("axis"), at.cast("double").alias("at"), low.cast("double").alias("low"), (low + step).cast("double").alias("high"), F.lit(1.0).alias("thickness"))
    return told(upright, "v", 50 + 40 * c + (k + r) % 3 * 0.25, 60 + 30 * r, 30).unionByName(told(level, "h", 60 + 30 * r + (k + c) % 3 * 0.25, 50 + 40 * c, 40))


@query("q_A32_P08_grids", f"""WITH {_EDGES}, p AS (SELECT doc, page, k, cols, rows, axis, i, round(avg(pos), 4) AS pos FROM e GROUP BY ALL),
n AS (SELECT doc, page, count(*) AS painted FROM e GROUP BY 1, 2)
SELECT doc, page, cols::INT AS cols, rows::INT AS rows, round(painted / ((rows + 1) * cols + (cols + 1) * rows)::DOUBLE, 6) AS closed, string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (axis = 'v') AS xs, string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (axis = 'h') AS ys
FROM p JOIN n USING (doc, page) GROUP BY doc, page, cols, rows, painted HAVING round(painted / ((rows + 1) * cols + (cols + 1) * rows)::DOUBLE, 6) >= 0.75""")
def whole_grids(spark, sf_dir):
    found = grids.whole_grids(grids.grids(_rules(spark, sf_dir), ["doc", "page"], folder=scratch(spark)))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 4).cast("string")), ",")
    return found.select("doc", "page", "cols", "rows", F.round("closed", 6).alias("closed"), text("xs").alias("xs"), text("ys").alias("ys"))


@query("q_P18_merged_cells", f"""WITH z AS ({_SIZES}), a AS (SELECT * FROM (SELECT *, unnest(range(cols)) AS c FROM z), unnest(range(rows)) AS u(r))
SELECT doc, page, r::INT AS "row", c::INT AS col, (CASE WHEN k % 2 = 1 AND r + 1 < rows AND (k + r + 1 + c) % 3 = 0 THEN 2 ELSE 1 END)::INT AS row_span, (CASE WHEN k % 2 = 0 AND c + 1 < cols AND (k + r + c + 1) % 3 = 0 THEN 2 ELSE 1 END)::INT AS col_span FROM a WHERE NOT {_UPRIGHT} AND NOT {_LEVEL}""")
def merged_cells(spark, sf_dir):
    found = grids.whole_grids(grids.grids(_rules(spark, sf_dir), ["doc", "page"], folder=scratch(spark)))
    return grids.grid_cells(found, ["doc", "page"]).select("doc", "page", "row", "col", "row_span", "col_span")


def _grid_spans(spark, sf_dir):
    """A text in each cell but the first, of two lines in some."""
    until = lambda n: F.explode(F.sequence(F.lit(0), n))
    cells = _sizes(spark, sf_dir).withColumn("c", until(F.col("cols") - 1)).withColumn("r", until(F.col("rows") - 1)).where("r + c > 0")
    k, r, c = F.col("k"), F.col("r"), F.col("c")
    span = lambda text, x, y: F.struct(text.alias("text"), (50 + 40 * c + x).cast("double").alias("x"), (60 + 30 * r + y).cast("double").alias("y"))
    first, more = span(F.concat(F.lit("k"), k.cast("string")), 3, 8), span(F.concat_ws(".", r, c), 3, 18)
    spans = cells.select("doc", "page", "r", "c", F.posexplode(F.when((k + c) % 4 == 0, F.array(first, more)).otherwise(F.array(first))).alias("i", "s"))
    return spans.select("doc", "page", (r * 1000 + c * 10 + F.col("i")).cast("long").alias("seq"), "s.*", F.lit(20.0).alias("w"), F.lit(8.0).alias("size"), F.lit(8.0).alias("body"))


_FILLED = f"""z AS MATERIALIZED ({_SIZES}), t AS (SELECT *, CASE WHEN r + c = 0 THEN '' WHEN (k + c) % 4 = 0 THEN 'k' || k || ' ' || r || '.' || c ELSE 'k' || k END AS text FROM (SELECT *, unnest(range(cols)) AS c FROM z), unnest(range(rows)) AS u(r)),
f AS (SELECT doc, page, k, cols, r, string_agg(text, '|' ORDER BY c) AS cells FROM t GROUP BY ALL),
s AS (SELECT doc, page, cols, sum(st) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS "table" FROM (SELECT *, CASE WHEN lag(cols) OVER w = cols AND lag(page) OVER w + 1 = page THEN 0 ELSE 1 END AS st FROM z WINDOW w AS (PARTITION BY doc ORDER BY page)))"""


@query("q_P07_W24_ruled_tables", f"""WITH {_FILLED}, l AS (SELECT doc, page, count(DISTINCT (r, i)) AS lines FROM (SELECT *, unnest(CASE WHEN (k + c) % 4 = 0 THEN [0, 1] ELSE [0] END) AS i FROM t WHERE r + c > 0) GROUP BY 1, 2)
SELECT doc, page, "table", r::INT AS "row", cells, greatest(0, lines - rows)::BIGINT AS missing FROM f JOIN s USING (doc, page, cols) JOIN l USING (doc, page) JOIN (SELECT doc, page, rows FROM z) USING (doc, page)""")
def ruled(spark, sf_dir):
    tables, rows = grids.ruled_tables(_grid_spans(spark, sf_dir), _rules(spark, sf_dir, whole=True), ["doc", "page"], "body", scratch(spark))
    named = grids.stitched(tables, ["doc"]).select("doc", "page", "grid", "table", "missing")
    return rows.join(named, ["doc", "page", "grid"]).select("doc", "page", "table", "row", F.array_join("cells", "|").alias("cells"), F.col("missing").cast("long").alias("missing"))


@query("q_P03_detected_tables", f"""WITH i AS MATERIALIZED ({_ITEMS}), {_FILLED}, g AS (SELECT * FROM f WHERE k % 7 <> 0),
gs AS (SELECT doc, page, cols, sum(st) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS "table" FROM (SELECT *, CASE WHEN lag(cols) OVER w = cols AND lag(page) OVER w + 1 = page THEN 0 ELSE 1 END AS st FROM z WHERE k % 7 <> 0 WINDOW w AS (PARTITION BY doc ORDER BY page))),
c AS (SELECT doc, page, top::DOUBLE AS line, a || '|' || b || '|' || c || '|' || d AS cells FROM i UNION ALL SELECT doc, page, top + 9, '|and more of it||' FROM i WHERE k % 5 = 3 UNION ALL SELECT DISTINCT doc, page, 82 + 17 * (page % 9), 'Date|Details|Paid|Balance' FROM i),
o AS (SELECT 'g' || doc AS doc, 'tagged' AS path, k AS "table", page::BIGINT AS page, 0 AS part, 0.0::DOUBLE AS pos, 'tag|' || k AS cells FROM z WHERE k % 7 = 0
UNION ALL SELECT 'g' || doc, 'ruled', "table", page, page, r, cells FROM g JOIN gs USING (doc, page, cols) UNION ALL SELECT 's' || doc, 'columns', 1, page, page, line, cells FROM c)
SELECT doc, path, "table", page, row_number() OVER (PARTITION BY doc, path, "table" ORDER BY page, part, pos)::INT AS "row", cells FROM o""")
def detected(spark, sf_dir):
    name = lambda letter: F.concat(F.lit(letter), F.col("doc").cast("string"))
    kept = lambda rows: rows.withColumn("page", F.col("page").cast("long"))
    spans = kept(_grid_spans(spark, sf_dir)).withColumn("doc", name("g")).unionByName(kept(_statements(spark, sf_dir)).withColumn("doc", name("s")))
    tagged = kept(_sizes(spark, sf_dir).where("k % 7 = 0")).select(name("g").alias("doc"), F.col("k").alias("table"), "page", F.lit(0).alias("row"), F.array(F.lit("tag"), F.col("k").cast("string")).alias("cells"))
    rows, _ = grids.detected_tables(spans, kept(_rules(spark, sf_dir, whole=True)).withColumn("doc", name("g")), ["doc"], "body", tagged, scratch(spark))
    return rows.select("doc", "path", "table", "page", "row", F.array_join("cells", "|").alias("cells"))


#: Reports: a document a supplier, its pages those of its statements, with a head, a foot on most pages and another on every second.
_REPORT = f"SELECT doc, page + 1 AS page, count(*) OVER (PARTITION BY doc) AS total FROM (SELECT DISTINCT doc, page FROM ({_ITEMS}))"


def _report(spark, sf_dir):
    """Lines and pages of reports."""
    items = _items(spark, sf_dir)
    # Each page begins with its item 0, which brings the page's own lines; pages count from 1, so a document's last is their number.
    items = items.withColumn("page", F.col("page") + 1).withColumn("total", F.max("page").over(Window.partitionBy("doc")))
    page, n = F.col("page"), F.col("page").cast("string")
    line = lambda y, x0, x1, text: F.array(F.struct(y.cast("double").alias("y"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), text.alias("text")))
    head = line(30 + page % 3 * 0.5, F.lit(100), F.lit(500), F.concat(F.lit("Supplier "), F.col("doc").cast("string"), F.lit(", page "), n, F.lit(" of "), F.col("total").cast("string")))
    foot = line(F.lit(760), F.lit(400), F.lit(560), F.when(page % 4 == 0, "Note").otherwise(F.concat(F.lit("Printed for you on day "), n)))
    even = line(F.lit(775), F.lit(40), F.lit(90), F.lit("even"))
    own = line(100 + 18 * F.col("k"), 71 + F.col("k") % 3, 300 + F.length("b"), F.col("b"))
    first = F.col("k") == 0
    every = F.concat(own, _some(first, F.concat(head, foot)), _some(first & (page % 2 == 0), even))
    lines = items.select("doc", "page", F.explode(every).alias("l")).select("doc", "page", "l.y", "l.x0", "l.x1", (F.col("l.y") - 9).alias("top"), (F.col("l.y") + 2).alias("bottom"), "l.text", F.lit(False).alias("artifact"))
    pages = items.where(first)
    return lines, pages.select("doc", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


@query("q_W21_W22_W23_running", f"""WITH p AS ({_REPORT}), f AS (SELECT doc, total, count(*) FILTER (page % 4 <> 0) AS n FROM p GROUP BY 1, 2)
SELECT doc, 'header' AS zone, 1 AS nth, 30.5::DOUBLE AS y, 'Supplier ' || doc || ', page {{page}} of {{pages}}' AS template, total AS pages, 'center' AS align FROM f WHERE total > 3
UNION ALL SELECT doc, 'footer', 1, 760, 'Printed for you on day {{page}}', n, 'right' FROM f WHERE total > 3 AND n >= ceil(0.6 * total)""")
def running_lines(spark, sf_dir):
    heads, _ = running.running(*_report(spark, sf_dir), ["doc"], scratch(spark))
    return heads.select("doc", "zone", F.col("nth").cast("int").alias("nth"), "y", "template", "pages", "align")


@query("q_A42_margins", f"""WITH r AS ({_ITEMS}), i AS (SELECT doc, max(100 + 18 * k) AS base, min(71 + k % 3) AS l, max(300 + len(b)) AS x1 FROM r GROUP BY 1)
SELECT doc, 90.0::DOUBLE AS top, 270.0::DOUBLE AS right, least(CASE WHEN abs(800 - base - 90) <= 2 THEN 90 WHEN abs(800 - base - 108) <= 2 THEN 108 WHEN abs(800 - base - 72) <= 2 THEN 72 ELSE least(360, 800 - base) END, 90)::DOUBLE AS bottom, 72.0::DOUBLE AS left, 21.0::DOUBLE AS header, 36.0::DOUBLE AS footer FROM i""")
def margins(spark, sf_dir):
    lines, pages = _report(spark, sf_dir)
    _, members = running.running(lines, pages, ["doc"], scratch(spark))
    # Feet that don't run are no part of the text here.
    return running.margins(lines.where("y < 720"), pages, members, ["doc"])


#: Set pages: forty line items of a supplier a page, five to a paragraph, with two headings.
_TYPED = f"SELECT l_suppkey AS doc, n // 40 AS page, n % 40 AS k, (50 + 12 * (n % 40) + 12 * (n % 40 // 5))::DOUBLE AS y, CASE WHEN n % 20 = 10 THEN 14.0 ELSE 10.0 END::DOUBLE AS size, CASE WHEN n % 20 = 10 THEN 'Heading ' || l_partkey ELSE 'part ' || l_partkey || CASE WHEN n % 5 = 4 THEN '.' ELSE '' END END AS text FROM ({_NUMBERED})"


def _typed(spark, sf_dir):
    keys = "l_orderkey l_linenumber l_partkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    n, part = F.col("n"), F.col("l_partkey").cast("string")
    rows = keyed(spark, sf_dir, "lineitem", "l_suppkey").select("l_suppkey", "l_partkey", (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)) - 1).alias("n"))
    text = F.when(n % 20 == 10, F.concat(F.lit("Heading "), part)).otherwise(F.concat(F.lit("part "), part, F.when(n % 5 == 4, ".").otherwise("")))
    none = F.lit(None).cast("double")
    return rows.select(
        F.col("l_suppkey").alias("doc"), F.expr("n div 40").alias("page"), F.lit(0).alias("col"), F.expr("cast(50 + 12 * (n % 40) + 12 * (n % 40 div 5) as double)").alias("y"), F.lit(60.0).alias("x0"), (400.0 + 4 * (n % 5)).alias("x1"),
        F.when(n % 20 == 10, 14.0).otherwise(10.0).alias("size"), text.alias("text"), none.alias("marker_x"), none.alias("text_x"), F.lit(False).alias("bold"), F.lit(60.0).alias("left"), F.lit(460.0).alias("right"), F.lit(10.0).alias("body"), F.lit(12.0).alias("leading"),
    )


@query("q_W19_W20_P22_P23_P24_P25_paragraphs", f"""WITH l AS ({_TYPED}), p AS (SELECT *, sum(CASE WHEN k % 5 = 0 OR k % 20 = 11 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS para FROM l)
SELECT doc, page, para::INT AS para, CASE WHEN max(size) = 14 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN max(size) = 14 THEN 1 END AS level, string_agg(text, ' ' ORDER BY k) AS text, 'left' AS align, count(*)::INT AS lines, min(y) AS top, 12.0::DOUBLE AS leading, (CASE WHEN min(k) > 0 AND min(k) % 5 = 0 THEN 12 ELSE 0 END)::DOUBLE AS "before" FROM p GROUP BY 1, 2, 3""")
def set_paragraphs(spark, sf_dir):
    return paragraphs.paragraphs(_typed(spark, sf_dir), ["doc", "page"]).select("doc", "page", "para", "kind", "level", "text", "align", "lines", "top", "leading", "before")


@query("q_A37_body_metrics", f"""WITH l AS ({_TYPED}), f AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'Sans' ELSE 'Serif' END AS family FROM l), s AS (SELECT doc, arg_max(size, (n, size)) AS body FROM (SELECT doc, size, sum(len(text)) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT doc, arg_max(family, (n, family)) AS family FROM (SELECT f.doc, family, sum(len(text)) AS n FROM f JOIN s ON f.doc = s.doc AND abs(size - body) <= 0.6 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc, y - lag(y) OVER w AS gap, size, lag(size) OVER w AS was FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY k)), r AS (SELECT g.doc, gap, row_number() OVER (PARTITION BY g.doc ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY g.doc) AS n FROM g JOIN s USING (doc) WHERE abs(size - body) <= 0.6 AND abs(was - body) <= 0.6 AND gap > body / 2 AND gap < 3 * body)
SELECT doc, body, family, coalesce(gap, 1.15 * body) AS leading FROM s JOIN m USING (doc) LEFT JOIN (SELECT doc, gap FROM r WHERE i = n // 2) USING (doc)""")
def body_metrics(spark, sf_dir):
    lines = _typed(spark, sf_dir)
    at = F.expr("cast((y - 50) / 12 as int)")  # the line's number and that of the paragraphs before it
    k = at - F.floor(at / 6).cast("int")
    return paragraphs.body_metrics(lines.withColumn("family", F.when(k % 3 == 0, "Sans").otherwise("Serif")), lines, ["doc"])


_TABBED = "SELECT l_orderkey AS block, l_linenumber AS k, (100 + l_orderkey % 3)::DOUBLE AS a, (250 + CASE WHEN l_linenumber % 4 = 3 THEN l_orderkey % 2 * 9 ELSE l_linenumber % 2 END)::DOUBLE AS b FROM lineitem WHERE l_linenumber <= 7 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber) = 1"


@query("q_W17_W18_P20_tab_stops", f"""WITH l AS ({_TABBED}), g AS (SELECT block, count(*) AS n, any_value(a) AS a, median(b) AS m, list(b) AS bs FROM l GROUP BY 1)
SELECT block, n >= 3 AS tabbed, (CASE WHEN n >= 3 THEN n ELSE 0 END)::INT AS run, 'left ' || a || ', ' || CASE WHEN n = 1 OR len(list_filter(bs, lambda v: abs(v - m) > 3)) > 0 THEN 'right 500.0' ELSE 'left ' || m END AS stops FROM g""")
def tab_stops(spark, sf_dir):
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").where(n <= 7).select(key.alias("block"), n.cast("double").alias("y")).distinct()
    second = 250 + F.when(F.col("y") % 4 == 3, F.col("block") % 2 * 9).otherwise(F.col("y") % 2)
    lines = lines.select("block", "y", F.lit(60.0).alias("x0"), F.lit(500.0).alias("x1"), F.array((100 + F.col("block") % 3).cast("double"), second.cast("double")).alias("stops"), F.lit(10.0).alias("body"))
    text = F.array_join(F.transform("stops", lambda s: F.concat_ws(" ", s["type"], s["pos"].cast("string"))), ", ")
    return paragraphs.tab_stops(lines, ["block"]).select("block", "tabbed", "run", text.alias("stops"))


@query("q_P30_tree_paths", """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS parent, CASE c_custkey % 5 WHEN 0 THEN 'a' ELSE 'b' END AS role FROM customer),
p AS (SELECT id, id::VARCHAR AS path, 1 AS depth, NULL::BIGINT AS above, role FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.path || '/' || n.id, p.depth + 1, CASE WHEN p.role = 'a' THEN p.id ELSE p.above END, n.role FROM p JOIN n ON n.parent = p.id)
SELECT id, path, depth::INT AS depth, above FROM p""")
def tree_paths(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    nodes = table(spark, sf_dir, "customer").select(F.lit(1).alias("tree"), key.alias("id"), F.when(key > 0, F.expr("cast(c_custkey div 3 as long)")).alias("parent"), (key % 3).alias("ord"), F.when(key % 5 == 0, "a").otherwise("b").alias("role"))
    paths = trees.tree_paths(nodes, ["tree"], scratch(spark))
    return paths.select("id", F.array_join(F.transform("path", lambda n: n["id"].cast("string")), "/").alias("path"), F.size("path").alias("depth"), trees.nearest(F.col("path"), ["a"], itself=False).alias("above"))


@query("q_J11_P05_P06_tagged_tables", f"""WITH {_FILLED}, m AS (SELECT doc, max(cols) AS most FROM z GROUP BY 1), g AS (SELECT DISTINCT z.doc, page, r, c FROM z JOIN m USING (doc), unnest(range(rows)) AS u(r), unnest(range(most)) AS v(c))
SELECT g.doc, 1 AS "table", g.page, g.r::INT AS "row", string_agg(coalesce(text, ''), '|' ORDER BY g.c) AS cells FROM g LEFT JOIN t ON t.doc = g.doc AND t.page = g.page AND t.r = g.r AND t.c = g.c GROUP BY 1, 3, 4""")
def tagged(spark, sf_dir):
    """A tree a page: a document, its table, rows in a group, cells; the texts in them carry the marks of their cells."""
    until = lambda n: F.explode(F.sequence(F.lit(0), n))
    node = lambda rows, id_, parent, ord_, role: rows.select("doc", "page", id_.cast("long").alias("id"), parent.cast("long").alias("parent"), ord_.cast("int").alias("ord"), F.lit(role).alias("role"))
    sizes, r, c = _sizes(spark, sf_dir), F.col("r"), F.col("c")
    rows = sizes.withColumn("r", until(F.col("rows") - 1))
    cells = rows.withColumn("c", until(F.col("cols") - 1))
    zero = F.lit(0)
    nodes = node(sizes, zero, F.lit(None), zero, "Document")
    for more in (node(sizes, zero + 1, zero, zero, "Table"), node(sizes, zero + 2, zero + 1, zero, "TBody"), node(rows, 10 + r, zero + 2, r, "TR"), node(cells, 1000 + r * 10 + c, 10 + r, c, "TD")):
        nodes = nodes.unionByName(more)
    marks = cells.select("doc", "page", F.concat_ws(".", r, c).alias("mark"), (1000 + r * 10 + c).cast("long").alias("node"))
    spans = _grid_spans(spark, sf_dir).withColumn("mark", F.concat_ws(".", F.floor(F.col("seq") / 1000), F.floor(F.col("seq") % 1000 / 10)))
    return trees.tagged_tables(spans, nodes, marks, ["doc"], "body", scratch(spark)).select("doc", "table", "page", "row", F.array_join("cells", "|").alias("cells"))


#: Sheets: the lines of statements, their header on each page, as tables.
@query("q_P13_P14_P15_S69_W35_sheets", f"""WITH i AS MATERIALIZED ({_ITEMS}), n AS (SELECT doc, page, k, a, b, c, d, row_number() OVER (PARTITION BY doc ORDER BY page, k) + 1 AS record FROM i)
SELECT doc, 1 AS record, true AS is_header, 'Date|Details|Paid|Balance' AS cells, 'text text text text' AS kinds, '' AS reasons, '0' AS sources FROM (SELECT DISTINCT doc FROM i)
UNION ALL SELECT doc, record::INT, false, a || '|' || b || CASE WHEN k % 5 = 3 THEN ' and more of it' ELSE '' END || '|' || c || '|' || CASE WHEN k = 7 THEN 'none' ELSE d END, 'date text number ' || CASE WHEN k = 7 THEN 'text' ELSE 'number' END, CASE WHEN k = 7 THEN 'Something here isn’t a number' ELSE '' END,
(page * 1000 + k * 10 + 10) || CASE WHEN k % 5 = 3 THEN ',' || (page * 1000 + k * 10 + 11) ELSE '' END FROM n""")
def made_sheets(spark, sf_dir):
    items = _items(spark, sf_dir)
    line = lambda row, *cells: F.array(F.struct(row.cast("long").alias("row"), F.array(*cells).alias("cells")))
    at, none = F.col("page") * 1000 + F.col("k") * 10 + 10, F.lit("")
    own = line(at, F.col("a"), F.col("b"), F.col("c"), F.when(F.col("k") == 7, "none").otherwise(F.col("d")))
    more = line(at + 1, none, F.lit("and more of it"), none, none)
    head = line(F.col("page") * 1000, F.lit("Date"), F.lit(" Details"), F.lit("Paid"), F.lit("Balance"))
    every = F.concat(own, _some(F.col("k") % 5 == 3, more), _some(F.col("k") == 0, head))
    lines = items.select("doc", "page", F.explode(every).alias("l")).select("doc", "l.row", "page", "l.cells")
    made = sheets.sheets(lines, ["doc"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return made.rows.select("doc", F.col("record").cast("int").alias("record"), "is_header", F.array_join("cells", "|").alias("cells"), F.array_join(F.transform("typed", lambda x: x["kind"]), " ").alias("kinds"), "reasons", text("sources").alias("sources"))


@query("q_S69_A23_sheet_summaries", f"""WITH i AS MATERIALIZED ({_ITEMS}) SELECT doc, count(*) + 1 AS "rows", count(DISTINCT page) - 1 AS dropped, 1 - count(*) FILTER (k = 7) / (count(*) + 1)::DOUBLE AS confidence FROM i GROUP BY 1""")
def sheet_summaries(spark, sf_dir):
    items = _items(spark, sf_dir)
    line = lambda row, *cells: F.array(F.struct(row.cast("long").alias("row"), F.array(*cells).alias("cells")))
    own = line(F.col("page") * 100 + F.col("k") + 1, F.col("a"), F.col("b"), F.col("c"), F.when(F.col("k") == 7, "none").otherwise(F.col("d")))
    head = line(F.col("page") * 100, F.lit("Date"), F.lit("Details"), F.lit("Paid"), F.lit("Balance"))
    lines = items.select("doc", "page", F.explode(F.concat(own, _some(F.col("k") == 0, head))).alias("l")).select("doc", "l.row", "page", "l.cells")
    return sheets.sheets(lines, ["doc"]).sheets.select("doc", "rows", "dropped", "confidence")


_FLAT = r"trim(regexp_replace(regexp_replace(text, '([^ \t\n\r\f\v]{30})', '\1 ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query("q_N36_N39_wrapped", rf"WITH l AS (SELECT doc_id, list_transform(regexp_extract_all({_FLAT}, '([^ ].{{0,39}})( |$)', 1), lambda x: rtrim(x, ' ')) AS l FROM documents WHERE text IS NOT NULL AND {_FLAT} <> '') SELECT doc_id, len(l)::INT AS lines, md5(array_to_string(l, chr(10))) AS digest FROM l")
def wrapped(spark, sf_dir):
    """Whole texts in lines of forty letters of one width; words beyond thirty are parted first."""
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", r"([^ \t\n\r\f\x0b]{30})", "$1 "), r"[ \t\n\r\f\x0b]+", " "))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", flat.alias("t")).where("t <> ''").select("doc_id", wrap.wrapped(F.col("t"), 200.0, 10.0, {}, 500).alias("l"))
    return rows.select("doc_id", F.size("l").alias("lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("q_F58_F59_folded", """WITH d AS (SELECT doc_id, length(text) AS n, regexp_replace(text, '[^ -~¡-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(t || CASE doc_id % 3 WHEN 0 THEN ' Lódz -> cas' WHEN 1 THEN '  <=' ELSE '' END) AS digest, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS simplified, CASE doc_id % 3 WHEN 1 THEN 6 ELSE 0 END::BIGINT + n - length(t) AS dropped FROM d""")
def folded(spark, sf_dir):
    """Whole texts with a few letters more that the code page hasn't."""
    key = F.col("doc_id") % 3
    text = F.concat("text", F.when(key == 0, " Łódź → čas").when(key == 1, " Привет ≤").otherwise(""))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fold.folded(text).alias("f"))
    return rows.select("doc_id", F.md5("f.text").alias("digest"), "f.simplified", "f.dropped")
