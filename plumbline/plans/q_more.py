"""More queries: whole texts line by line, small number functions, loose clusters, placed copies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.functions import text as t
from plumbline.operators import tally
from plumbline.plans.base import query, table
from plumbline.plans.q_tables import _NEAR


@query("q_W33_blank_lines", "SELECT doc_id, regexp_replace(raw, '((?:^|\\n)(?:[ \\t]*\\r?\\n){1})(?:[ \\t]*\\r?\\n)+', '\\1', 'g') AS out FROM (SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || ' ' || chr(10) ELSE chr(10) END) AS raw FROM documents)")
def blank_lines(spark, sf_dir):
    raw = F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 4 == 0, "\n\n \n").otherwise("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", t.collapse_blank_lines(raw).alias("out"))


@query("q_F13_expand_tabs", "SELECT o_orderkey, rpad(o_orderstatus, 4, ' ') || rpad(o_orderpriority, ((len(o_orderpriority) // 4 + 1) * 4)::INT, ' ') || o_orderkey AS out FROM orders")
def tabs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", t.expand_tabs(F.concat_ws("\t", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))).alias("out"))


@query("q_F42_F43_jwt", "SELECT event_id, '{\"alg\":\"none\"}' AS header, props AS claims FROM events")
def tokens(spark, sf_dir):
    made = F.concat_ws(".", t.base64_text(F.lit('{"alg":"none"}'), True), t.base64_text(F.col("props"), True), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", made.alias("jwt")).select("event_id", t.jwt_part(F.col("jwt"), 0).alias("header"), t.jwt_part(F.col("jwt"), 1).alias("claims"))


@query("q_F71_F72_positions", "SELECT doc_id, strlen(text)::BIGINT AS bytes, (len(b) - len(replace(b, chr(10), '')) + 1)::BIGINT AS line, (len(regexp_extract(b, '([^\\n]*)\\z', 1)) + 1)::BIGINT AS col FROM (SELECT doc_id, text, substr(text, 1, len(text) // 2) AS b FROM documents)")
def positions(spark, sf_dir):
    at = t.line_and_column(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), at.alias("p")).select("doc_id", "bytes", "p.line", F.col("p.column").alias("col"))


@query("q_N10_percent_change", "SELECT o_orderkey, CASE WHEN b > 0 THEN floor((o_totalprice - b) / b * 100 + 0.5) ELSE 0 END::BIGINT AS change FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)")
def percents(spark, sf_dir):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("b", before).select("o_orderkey", F.coalesce(numbers.percent_change(F.col("b"), F.col("o_totalprice")), F.lit(0)).alias("change"))


_FORMS = "CASE c_custkey % 6 WHEN 0 THEN concat('(', n, ')') WHEN 1 THEN concat('$', n, '.50') WHEN 2 THEN concat(n, '%') WHEN 3 THEN concat(n, ',5') WHEN 4 THEN concat('1.', lpad(n, 3, '0'), ',25') ELSE c_mktsegment END"


@query("q_N01_N02_numbers", f"SELECT c_custkey, v, CASE c_custkey % 6 WHEN 0 THEN -x WHEN 1 THEN x + 0.5 WHEN 2 THEN x WHEN 3 THEN x + 0.5 WHEN 4 THEN 1000 + x + 0.25 END AS number, CASE c_custkey % 6 WHEN 5 THEN 'text' ELSE 'number' END AS kind FROM (SELECT *, {_FORMS} AS v, n::DOUBLE AS x FROM (SELECT c_custkey, c_mktsegment, (c_custkey % 1000)::VARCHAR AS n FROM customer))")
def read_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 1000).cast("string").alias("n")).select("c_custkey", F.expr(_FORMS).alias("v"))
    return rows.select("c_custkey", "v", numbers.spreadsheet_number(F.col("v")).alias("number"), numbers.value_kind(F.col("v")).alias("kind"))


@query("q_N19_N21_capacity", "SELECT p_partkey, (greatest(0, floor((210 - 10 + 2) / (p_size + 2.0::DOUBLE) + 1e-9)) * greatest(0, floor((297 - 10 + 2) / (p_size * 1.25::DOUBLE + 2.0) + 1e-9)))::INT AS copies FROM part")
def capacity(spark, sf_dir):
    size, gap = F.col("p_size").cast("double"), F.lit(2.0)
    return table(spark, sf_dir, "part").select("p_partkey", (numbers.count_across(F.lit(200.0), size, gap) * numbers.count_across(F.lit(287.0), size * 1.25, gap)).alias("copies"))


@query("q_F69_letters", "SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr((96 + p_size)::INT) ELSE chr((96 + (p_size - 1) // 26)::INT) || chr((97 + (p_size - 1) % 26)::INT) END AS out FROM part")
def lettered(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.letters(F.col("p_size")).alias("out"))


@query("q_A18_A28_moments", "SELECT l_returnflag, median(l_quantity) AS median, round(stddev_pop(l_quantity), 9) AS deviation FROM lineitem GROUP BY 1")
def moments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"), F.round(F.stddev_pop("l_quantity"), 9).alias("deviation"))


@query("q_W31_groups", "SELECT l_orderkey, g::BIGINT AS piece, min(l_linenumber) AS low, max(l_linenumber) AS high FROM (SELECT *, sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING) AS g FROM lineitem) GROUP BY 1, 2")
def pieces(spark, sf_dir):
    upto = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").withColumn("piece", F.sum((F.col("l_returnflag") == "R").cast("int")).over(upto))
    return rows.groupBy("l_orderkey", "piece").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))


@query("q_C03_loose_clusters", f"""WITH RECURSIVE c AS (SELECT value, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN p_name || 's' WHEN p_partkey % 7 = 0 THEN replace(p_name, 'e', 'ee') ELSE p_name END AS value FROM part) GROUP BY 1),
{_NEAR}, d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM d UNION SELECT r.x, d.b FROM r JOIN d ON r.y = d.a),
g AS (SELECT x, min(y) AS cluster FROM r GROUP BY 1),
f AS (SELECT cluster, sum(n)::BIGINT AS total, max(n) AS top, arg_min(value, (-n, value)) AS suggested FROM g JOIN c ON c.value = g.x GROUP BY 1)
SELECT cluster, suggested, total, (total - top)::BIGINT AS rows_affected, value, n AS count FROM f JOIN g USING (cluster) JOIN c ON c.value = g.x""")
def loose(spark, sf_dir):
    key = F.col("p_partkey")
    value = F.when(key % 9 == 0, F.concat("p_name", F.lit("s"))).when(key % 7 == 0, F.replace("p_name", F.lit("e"), F.lit("ee"))).otherwise(F.col("p_name"))
    return tally.loose_clusters(table(spark, sf_dir, "part").groupBy(value.alias("value")).agg(F.count("*").alias("count")))
