"""Queries of the cleaner, of semi-structured columns and of diffs, over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import diff
from plumbline.operators import clean as c
from plumbline.operators import geometry, semi
from plumbline.plans.base import DIRTIED, dirtied, query, sql_scrub, table

_ALL = c.CleanOptions(header_row=None, collapse_spaces=True, flatten_newlines=True, remove_invisible=True, blank_sentinels=True, normalise_dates=False)
_WORKED = f"SELECT doc_id AS _row, raw, {sql_scrub('raw')} AS v FROM (SELECT doc_id, {DIRTIED} AS raw FROM documents)"
_JUDGED = f"SELECT _row, raw, v, CASE WHEN v = '' THEN 'blank' WHEN min(_row) OVER (PARTITION BY v) <> _row THEN 'duplicate' END AS reason, CASE WHEN v <> '' AND min(_row) OVER (PARTITION BY v) <> _row THEN min(_row) OVER (PARTITION BY v) END AS twin FROM ({_WORKED})"


def _cleaned(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row"), dirtied(F.col("text"), F.col("doc_id")).alias("text"))
    return c.clean(rows, _ALL)


@query("q_S51_clean_rows", f"SELECT _row, v AS text FROM ({_JUDGED}) WHERE reason IS NULL")
def clean_rows(spark, sf_dir):
    return _cleaned(spark, sf_dir).rows


@query("q_S61_removed", f"SELECT _row, reason, twin AS duplicate_of FROM ({_JUDGED}) WHERE reason IS NOT NULL")
def removed(spark, sf_dir):
    return _cleaned(spark, sf_dir).removed


@query("q_S63_reasons", f"SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS count, sum(_row)::BIGINT AS row_sum FROM ({_JUDGED}) GROUP BY 1")
def reasons(spark, sf_dir):
    found = _cleaned(spark, sf_dir)
    tagged = found.rows.select("_row", F.lit("kept").alias("reason")).unionByName(found.removed.select("_row", "reason"))
    return tagged.groupBy("reason").agg(F.count("_row").alias("count"), F.sum("_row").alias("row_sum"))


@query("q_J04_changes", f"SELECT _row, raw AS before, v AS after FROM ({_JUDGED}) WHERE reason IS NULL AND raw <> v")
def changes(spark, sf_dir):
    return _cleaned(spark, sf_dir).changes.select("_row", "before", "after")


@query("q_A07_stats", f"SELECT count(*)::BIGINT AS source_rows, count(*) FILTER (reason = 'blank')::BIGINT AS blank_rows, count(*) FILTER (reason = 'duplicate')::BIGINT AS duplicate_rows, count(*) FILTER (reason IS NULL)::BIGINT AS rows_after, count(*) FILTER (reason IS NULL AND raw <> v)::BIGINT AS changed_rows FROM ({_JUDGED})")
def stats(spark, sf_dir):
    return _cleaned(spark, sf_dir).stats.select("source_rows", "blank_rows", "duplicate_rows", "rows_after", "changed_rows")


_ORDER_DATE = "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"


@query("q_S51_clean_dates", "SELECT o_orderkey AS _row, strftime(o_orderdate, '%Y-%m-%d') AS joined, o_orderpriority AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def clean_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), F.expr(_ORDER_DATE).alias("joined"), F.col("o_orderpriority").alias("priority"))
    return c.clean(rows, c.CleanOptions(header_row=None)).rows


@query("q_M01_flatten", "SELECT event_id, 0 AS record, 0 AS place, 'k' AS path, (props::JSON->>'k') AS value FROM events UNION ALL SELECT event_id, 0, 1, 'user.id', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 0, 2, 'user.type', event_type FROM events")
def flattened(spark, sf_dir):
    nested = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("type")).alias("user")))
    return semi.flatten_json(table(spark, sf_dir, "events").select("event_id", nested.alias("json")), "event_id", "json")


@query("q_M01_to_table", "SELECT event_id, 0 AS record, (props::JSON->>'k') AS k FROM events")
def tabled(spark, sf_dir):
    return semi.to_table(semi.flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props"), "event_id")


@query("q_M07_unflatten", "SELECT event_id, 0 AS record, '{\"k\": \"' || (props::JSON->>'k') || '\"}' AS json FROM events")
def nested(spark, sf_dir):
    return semi.unflatten_json(semi.flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props"), "event_id")


@query("q_M12_detect", "SELECT event_id, 'json' AS format, 'high' AS confidence FROM events")
def detected(spark, sf_dir):
    return semi.detect(table(spark, sf_dir, "events"), "event_id", "props")


@query("q_C09_diff_turns")
def diffs(spark, sf_dir):
    """Words that stay, go and come from each turn of a conversation to the next."""

    @F.pandas_udf("same long, deleted long, inserted long")
    def counted(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([diff.stats(a or "", b or "", "words") for a, b in zip(before, after, strict=True)], columns=["same", "deleted", "inserted"])

    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return turns.select("conv_id", "turn", counted("before", "text").alias("d")).select("conv_id", "turn", "d.*")


# ---- geometry: joins by place

_BANDS = "(0, 10), (10, 25), (25, 40), (40, 51)"


@query("q_J08_J10_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END::INT AS band FROM lineitem")
def bucketed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.bucket(F.col("l_quantity"), [10, 25, 40]).alias("band"))


@query("q_J09_slots", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 0 WHEN l_quantity BETWEEN 12 AND 25 THEN 1 WHEN l_quantity BETWEEN 30 AND 50 THEN 2 END::INT AS slot FROM lineitem")
def slotted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.slot(F.col("l_quantity"), [(0, 10), (12, 25), (30, 50)]).alias("slot"))


@query("q_J12_nearest", "SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 WHEN p_size < 11 THEN CASE WHEN p_size - 5 <= 11 - p_size THEN 0 ELSE 1 END WHEN p_size <= 20 THEN 1 WHEN p_size < 40 THEN CASE WHEN p_size - 20 <= 40 - p_size THEN 1 ELSE 2 END ELSE 2 END::INT AS band FROM part")
def nearest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geometry.nearest(F.col("p_size"), [(1, 5), (11, 20), (40, 60)]).alias("band"))


@query("q_A24_gutters", "WITH c AS (SELECT l_suppkey, b, count(*) AS n FROM (SELECT l_suppkey, unnest(range(l_partkey // 4, (l_partkey + l_quantity::INT) // 4 + 1)) AS b FROM lineitem) GROUP BY 1, 2), a AS (SELECT l_suppkey, b, b - row_number() OVER (PARTITION BY l_suppkey ORDER BY b) AS i FROM c WHERE n > 2), s AS (SELECT l_suppkey, min(b) AS lo, max(b) AS hi FROM a GROUP BY l_suppkey, i), g AS (SELECT l_suppkey, lag(hi) OVER (PARTITION BY l_suppkey ORDER BY lo) + 1 AS low, lo - 1 AS high FROM s) SELECT l_suppkey, low, high FROM g WHERE low IS NOT NULL AND high - low + 1 >= 3")
def gutters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr("l_partkey div 4").alias("a"), F.expr("(l_partkey + cast(l_quantity as int)) div 4").alias("b"))
    return geometry.gutters(rows, ["l_suppkey"], "a", "b", most=2, least_width=3)


@query("q_J07_furniture", "SELECT shape, count(DISTINCT l_suppkey)::BIGINT AS pages FROM (SELECT l_suppkey, regexp_replace(l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber, '[0-9]+', '#', 'g') AS shape, l_quantity AS y FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= greatest(2, 0.5 * (SELECT count(DISTINCT l_suppkey) FROM lineitem)) AND stddev_pop(y) <= 30")
def furniture(spark, sf_dir):
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), text.alias("text"), F.col("l_quantity").alias("y"))
    return geometry.furniture(rows, "page", "text", "y", 30.0).select("shape", "pages")


@query("q_J22_overlap", "SELECT l_orderkey, l_linenumber, CASE WHEN u > 0 THEN i / u ELSE 0 END AS iou FROM (SELECT *, aw * ah + bw * bh - i AS u FROM (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS i FROM (SELECT l_orderkey, l_linenumber, l_quantity AS ax, l_quantity AS ay, 10.0::DOUBLE AS aw, 5.0::DOUBLE AS ah, l_linenumber::DOUBLE * 5 AS bx, l_quantity + 1 AS b_y, 12.0::DOUBLE AS bw, 6.0::DOUBLE AS bh FROM lineitem)))")
def overlaps(spark, sf_dir):
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    a, b = box(F.col("l_quantity"), F.col("l_quantity"), F.lit(10), F.lit(5)), box(F.col("l_linenumber") * 5, F.col("l_quantity") + 1, F.lit(12), F.lit(6))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b")).select("l_orderkey", "l_linenumber", geometry.overlap("a", "b").alias("iou"))


@query("q_A20_type_columns", "SELECT name, count(*)::BIGINT AS samples, CASE WHEN name = 'priority' THEN 'text' WHEN name = 'price' THEN 'money' ELSE 'date' END AS kind FROM (SELECT 'priority' AS name FROM orders UNION ALL SELECT 'price' FROM orders UNION ALL SELECT 'day' FROM orders) GROUP BY 1")
def typed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("priority"), F.format_string("$%,.2f", F.col("o_totalprice")).alias("price"), F.date_format("o_orderdate", "d MMM yyyy").alias("day"),
    )
    return geometry.column_kinds(rows, "row", ["priority", "price", "day"]).select("name", "samples", "kind")
