"""Queries of dates, numbers, tallies, clusters and sequences, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dates, numbers
from plumbline.functions import text as t
from plumbline.operators import clean, sequences, tally
from plumbline.plans.base import DIRTIED, S, dirtied, keyed, query, quote, sql_scrub, sql_trim, table

# ---- dates

_DATE = """CASE o_orderkey % 7 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 3 THEN date_format(o_orderdate, 'd MMM yyyy')
WHEN 4 THEN date_format(o_orderdate, 'yyyy.M.d HH:mm') WHEN 5 THEN date_format(o_orderdate, 'dd-MM-yy') ELSE o_orderpriority END"""
_DATE_SQL = """CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%-d %b %Y')
WHEN 4 THEN strftime(o_orderdate, '%Y.%-m.%-d %H:%M') WHEN 5 THEN strftime(o_orderdate, '%d-%m-%y') ELSE o_orderpriority END"""
_D = "extract(day FROM o_orderdate)"
_M = "extract(month FROM o_orderdate)"
#: What each rendering above means, from the date it was made of.
_KIND_SQL = f"CASE WHEN o_orderkey % 7 IN (0, 3, 4) THEN 'fixed' WHEN o_orderkey % 7 = 6 THEN 'not-a-date' WHEN {_D} <= 12 THEN 'ambiguous' ELSE 'ordered' END"
_ORDER_SQL = f"CASE WHEN o_orderkey % 7 IN (1, 5) AND {_D} > 12 THEN 'dmy' WHEN o_orderkey % 7 = 2 AND {_D} > 12 THEN 'mdy' END"


def _dated(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATE).alias("v"))


@query("q_D01_inspect_date", f"SELECT o_orderkey, {_DATE_SQL} AS v, {_KIND_SQL} AS kind, {_ORDER_SQL} AS \"order\", CASE WHEN o_orderkey % 7 <> 6 THEN extract(year FROM o_orderdate)::INT END AS y, CASE WHEN o_orderkey % 7 = 4 THEN strftime(o_orderdate, '%H:%M') ELSE '' END AS \"time\" FROM orders")
def inspect_dates(spark, sf_dir):
    return _dated(spark, sf_dir).withColumn("i", dates.inspect(F.col("v"))).select("o_orderkey", "v", "i.kind", "i.order", "i.y", "i.time")


@query("q_D02_D03_normalise_date", f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') WHEN 2 THEN CASE WHEN {_D} <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') END AS us FROM orders")
def normalise_dates(spark, sf_dir):
    us = F.when(F.col("o_orderkey") % 7 == 0, dates.normalise(F.col("v"), "dmy", "us"))
    return _dated(spark, sf_dir).select("o_orderkey", dates.normalise(F.col("v"), "dmy").alias("iso"), us.alias("us"))


@query("q_A11_date_votes", f"SELECT count(*)::BIGINT AS \"values\", count(*) FILTER (kind <> 'not-a-date')::BIGINT AS dates, count(*) FILTER (o = 'dmy')::BIGINT AS dmy, count(*) FILTER (o = 'mdy')::BIGINT AS mdy, count(*) FILTER (kind = 'ambiguous')::BIGINT AS ambiguous, 'ask' AS status, NULL::VARCHAR AS \"order\" FROM (SELECT {_KIND_SQL} AS kind, {_ORDER_SQL} AS o FROM orders)")
def date_votes(spark, sf_dir):
    rows = _dated(spark, sf_dir).select(F.col("o_orderkey").alias("_row"), "v")
    return clean.date_votes(rows, ["v"]).select("values", "dates", "dmy", "mdy", "ambiguous", "status", "order")


@query("q_D10_serial", "SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 25569)::INT AS serial FROM orders")
def serials(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.spreadsheet_serial(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("int").alias("serial"))


# ---- numbers

_CENTS = "cast(round(l_extendedprice * 100) as bigint)"
_AMOUNT = """CASE l_orderkey % 8 WHEN 0 THEN concat('(', w, '.', f, ')') WHEN 1 THEN concat('$', w, '.', f) WHEN 2 THEN concat(replace(w, ',', '.'), ',', f) WHEN 3 THEN concat(w, '.', f, ' DR') WHEN 4 THEN concat('EUR ', w) WHEN 5 THEN concat(w, '.', f, '-') WHEN 6 THEN concat(replace(w, ',', ''), '.', f, ' CR') ELSE concat(w, '.', f, 'x') END"""
_AMOUNT_SQL = _AMOUNT
_PRICED_SQL = f"SELECT l_orderkey, l_linenumber, c, {_AMOUNT_SQL} AS v FROM (SELECT *, format('{{:,}}', c // 100) AS w, lpad((c % 100)::VARCHAR, 2, '0') AS f FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem))"


def _priced(spark, sf_dir):
    cents = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CENTS).alias("c"))
    parts = cents.select("l_orderkey", "l_linenumber", "c", F.format_number(F.expr("c div 100"), 0).alias("w"), F.lpad((F.col("c") % 100).cast("string"), 2, "0").alias("f"))
    return parts.select("l_orderkey", "l_linenumber", "c", F.expr(_AMOUNT).alias("v"))


@query("q_N04_amount", f"""SELECT l_orderkey, l_linenumber, v, CASE k WHEN 7 THEN NULL WHEN 4 THEN (c // 100)::DOUBLE WHEN 0 THEN -x WHEN 3 THEN -x WHEN 5 THEN -x ELSE x END AS value, CASE k WHEN 1 THEN '$' WHEN 4 THEN 'EUR' END AS currency, CASE k WHEN 3 THEN 'DR' WHEN 6 THEN 'CR' END AS marker,
CASE WHEN k = 7 THEN NULL WHEN k = 6 THEN 'none' WHEN c < 100000 THEN CASE WHEN k = 2 THEN 'european' ELSE 'none' END WHEN k = 2 THEN 'european' ELSE 'plain' END AS grouping, CASE k WHEN 7 THEN NULL WHEN 4 THEN 0 ELSE 2 END::INT AS decimals
FROM (SELECT *, l_orderkey % 8 AS k, CAST(((c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0')) AS DOUBLE) AS x FROM ({_PRICED_SQL}))""")
def amounts(spark, sf_dir):
    return _priced(spark, sf_dir).withColumn("a", numbers.amount(F.col("v"))).select("l_orderkey", "l_linenumber", "v", "a.value", "a.currency", "a.marker", "a.grouping", "a.decimals")


@query("q_N06_minor_units", "SELECT c_custkey, floor(c_acctbal * 100.0::DOUBLE + 0.5)::BIGINT AS minor FROM customer")
def minor(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.minor_units(F.col("c_acctbal")).alias("minor"))


_MIXED = "CASE event_id % 9 WHEN 0 THEN '007' WHEN 1 THEN cast(event_id as string) WHEN 2 THEN concat('9007199254740', cast(event_id % 1000 + 1000 as string)) WHEN 3 THEN 'TRUE' WHEN 4 THEN 'Null' WHEN 5 THEN concat(cast(event_id as string), 'e3') WHEN 6 THEN '{}' WHEN 7 THEN ' ' ELSE event_type END"


@query("q_N08_coerce", f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'number' WHEN 2 THEN 'text' WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN 'number' WHEN 6 THEN 'object' WHEN 7 THEN 'blank' ELSE 'text' END AS kind FROM events""")
def coerced(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.coerced_kind(F.expr(_MIXED)).alias("kind"))


@query("q_F68_roman", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 3999 THEN (['', 'x', 'xx', 'xxx', 'xl', 'l'])[p_size // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[p_size % 10 + 1] END AS roman FROM part")
def romans(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.roman(F.col("p_size")).alias("roman"))


# ---- tallies, verdicts, checks, clusters


@query("q_A01_tally", "SELECT p_type AS value, count(*)::BIGINT AS count, min(p_partkey) AS first_row FROM part GROUP BY 1")
def tallies(spark, sf_dir):
    return tally.tally(table(spark, sf_dir, "part").withColumnRenamed("p_type", "value"), "value", "p_partkey")


_PART = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_LONG_PART = " UNION ALL ".join(f"SELECT p_partkey AS row, '{c}' AS name, {c}::VARCHAR AS value FROM part" for c in _PART)


@query("q_A03_assess", f"""WITH d AS (SELECT name, value, count(*) AS n FROM ({_LONG_PART}) GROUP BY 1, 2), b AS (SELECT name, sum(n)::BIGINT AS v, count(*)::BIGINT AS dv, avg(regexp_matches(value, {quote(tally.PLAIN_NUMBER)})::INT) AS nu, avg((regexp_matches(value, {quote(tally.ID_SHAPE)}) AND regexp_matches(value, '^[\\p{{L}}\\p{{N}}]'))::INT) AS ids FROM d GROUP BY 1)
SELECT name, v AS "values", dv AS distinct_values, dv::DOUBLE / v AS ratio, CASE WHEN v < 6 THEN 'too-few-values' WHEN nu >= 0.8 THEN 'looks-numeric' WHEN ids >= 0.8 THEN 'looks-like-a-reference' WHEN dv::DOUBLE / v >= 0.5 THEN 'too-varied' END AS reason FROM b""")
def assessed(spark, sf_dir):
    return tally.assess(tally.cells(table(spark, sf_dir, "part"), "p_partkey", _PART))


@query("q_A10_invisible_tally", f"SELECT ord(ch)::BIGINT AS code, CASE WHEN regexp_matches(ch, {quote(t.ODD_SPACE)}) THEN 'replace' ELSE 'delete' END AS action, count(*)::BIGINT AS count FROM (SELECT unnest(regexp_extract_all(raw, {quote(f'({t.INVISIBLE}|{t.ODD_SPACE})')})) AS ch FROM (SELECT {DIRTIED} AS raw FROM documents)) GROUP BY 1, 2")
def invisibles(spark, sf_dir):
    return tally.invisible_tally(table(spark, sf_dir, "documents").select(dirtied(F.col("text"), F.col("doc_id")).alias("raw")), "raw")


@query("q_A13_checks", f"""WITH c AS (SELECT doc_id AS row, 'text' AS name, {DIRTIED} AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'code', CASE WHEN doc_id % 4 = 0 THEN '0' || doc_id WHEN doc_id % 13 = 0 THEN ' #ref! ' ELSE lang END FROM documents)
SELECT name, 'leading-zeros' AS kind, count(*)::BIGINT AS cells, count(DISTINCT row)::BIGINT AS rows FROM c WHERE len(value) >= 2 AND regexp_matches(value, '^0\\d+$') GROUP BY 1 UNION ALL
SELECT name, 'excel-error-cells', count(*), count(DISTINCT row) FROM c WHERE upper({sql_trim('value')}) IN ({', '.join(map(quote, tally.ERRORS))}) GROUP BY 1 UNION ALL
SELECT name, 'invisible-characters', count(*), count(DISTINCT row) FROM c WHERE regexp_matches(value, {quote(f'{t.INVISIBLE}|{t.ODD_SPACE}')}) GROUP BY 1""")
def checked(spark, sf_dir):
    key = F.col("doc_id")
    code = F.when(key % 4 == 0, F.concat(F.lit("0"), key.cast("string"))).when(key % 13 == 0, " #ref! ").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", dirtied(F.col("text"), key).alias("text"), "source", code.alias("code"))
    return tally.checks(tally.cells(rows, "doc_id", ["text", "source", "code"]))


#: Spellings, and the amounts that each form states.
_SPELT = (
    ("p_type", "''"), ("lower(p_type)", "''"), ("concat(p_type, ' ', p_brand)", "substr(p_brand, 7)"), ("concat(p_brand, ', ', p_type)", "substr(p_brand, 7)"), ("concat(p_type, '-', p_brand)", "substr(p_brand, 7)"),
    ("concat('Caf\u00e9  ', p_size)", "p_size"), ("concat('cafe ', p_size, '%')", "concat(p_size, '%')"), ("concat('Caf\u00e9 -', p_size)", "concat('-', p_size)"), ("concat('cafe (', p_size, ')')", "concat('(', p_size, ')')"),
    ("concat('CAFE ', p_size)", "p_size"), ("concat(p_size, ' %, caf\u00e9')", "concat('%|', p_size)"), ("concat('caf\u00e9 - ', p_size)", "concat('-', p_size)"), ("concat('$ ', p_size, ',500.25 + 3 cafe')", "concat('$', p_size, ',500.25|+3')"),
)
_SPELLING = "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {form}" for k, (form, _) in enumerate(_SPELT)) + " END"
_SIGNED = "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {amounts}::VARCHAR" for k, (_, amounts) in enumerate(_SPELT)) + " END"
_WS = r"list_filter(string_split_regex(strip_accents(lower(value)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("q_C06_F29_amount_signature", f"SELECT p_partkey, {_SPELLING} AS value, CASE WHEN p_partkey % 13 = 12 THEN '$' || p_size || ',500.25|+3' WHEN p_partkey % 13 = 10 THEN '%|' || p_size ELSE {_SIGNED} END AS amounts FROM part".replace("'$' || p_size || ',500.25|+3'", "list_aggregate(list_sort(['$' || p_size || ',500.25', '+3']), 'string_agg', '|')").replace("'%|' || p_size", "list_aggregate(list_sort(['%', p_size::VARCHAR]), 'string_agg', '|')"))
def signatures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPELLING).alias("value")).withColumn("amounts", t.amount_signature(F.col("value")))


@query("q_C01_clusters", f"""WITH c AS (SELECT {_SPELLING} AS value, {_SIGNED} AS amounts, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT value, amounts, n, array_to_string(list_sort({_WS}), ' ') AS key, array_to_string({_WS}, ' ') AS ordered, lower(value) AS low, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS sq FROM c),
s AS (SELECT *, ordered || CASE WHEN min(amounts) OVER w <> max(amounts) OVER w THEN '#' || amounts ELSE '' END AS cluster FROM k WINDOW w AS (PARTITION BY ordered)),
o AS (SELECT *, key || CASE WHEN min(amounts) OVER w <> max(amounts) OVER w THEN '#' || amounts ELSE '' END AS cluster FROM k WINDOW w AS (PARTITION BY key)),
sf AS (SELECT cluster, sum(n)::BIGINT AS total, arg_min(value, (-n, value)) AS suggested, max(n) AS top, CASE WHEN count(DISTINCT low) = 1 THEN 'case' WHEN count(DISTINCT sq) = 1 THEN 'whitespace' WHEN count(DISTINCT strip_accents(sq)) = 1 THEN 'accents' ELSE 'punctuation' END AS reason FROM s GROUP BY cluster, ordered, amounts HAVING count(*) > 1),
wf AS (SELECT cluster, sum(n)::BIGINT AS total, arg_min(value, (-n, value)) AS suggested, max(n) AS top, 'word-order' AS reason FROM o GROUP BY cluster, key, amounts HAVING count(DISTINCT ordered) > 1)
SELECT cluster, reason, suggested, total, (total - top)::BIGINT AS rows_affected, value, n AS count FROM sf JOIN s USING (cluster) UNION ALL SELECT cluster, reason, suggested, total, (total - top)::BIGINT, value, n FROM wf JOIN o USING (cluster)""")
def clustered(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.expr(_SPELLING).alias("value")).agg(F.count("*").alias("count"))
    return tally.clusters(counts)


_NEAR = r"""v AS (SELECT *, regexp_replace(s, '[^\p{L}\p{N}]+', '', 'g') AS k, CASE WHEN len(s) < 5 THEN 0 WHEN len(s) < 10 THEN 1 ELSE 2 END AS m FROM (SELECT value AS v, trim(regexp_replace(lower(value), '\s+', ' ', 'g')) AS s FROM c)),
e AS (SELECT a.v AS a, b.v AS b, levenshtein(a.s, b.s)::INT AS distance FROM v a JOIN v b ON a.v < b.v AND abs(len(a.k) - len(b.k)) <= 2 WHERE len(a.k) >= 4 AND len(b.k) >= 4 AND levenshtein(a.s, b.s) <= least(a.m, b.m) AND regexp_replace(a.s, '\d+', '', 'g') <> regexp_replace(b.s, '\d+', '', 'g')
AND len(list_intersect(list_transform(range(1, len(a.k) - 2), lambda i: substr(a.k, i, 4)), list_transform(range(1, len(b.k) - 2), lambda i: substr(b.k, i, 4)))) > 0)"""


@query("q_J05_near_spellings", f"WITH c AS (SELECT DISTINCT p_name AS value FROM part UNION SELECT DISTINCT p_name || 's' FROM part UNION SELECT replace(p_name, ' ', '') FROM part), {_NEAR} SELECT a, b, distance FROM e")
def near(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return tally.near_spellings(names.union(names.select(F.concat("p_name", F.lit("s")))).union(names.select(F.replace("p_name", F.lit(" "), F.lit("")))), "p_name")


# ---- sequences


@query("q_W01_J02_first_occurrences", "SELECT doc_id, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def firsts(spark, sf_dir):
    return sequences.first_occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"]).select("doc_id", "duplicate_of")


_ORDERS = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END END AS balance, c AS delta FROM (SELECT o_custkey, o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)"


@query("q_W02_balance", f"SELECT o_custkey, count(*)::BIGINT AS rows, count(*) FILTER (b IS NOT NULL AND balance IS NOT NULL)::BIGINT AS transitions, count(*) FILTER (b + delta <> balance)::BIGINT AS breaks FROM (SELECT *, lag(balance) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM ({_ORDERS})) GROUP BY 1")
def balances(spark, sf_dir):
    cents = F.expr("cast(round(o_totalprice * 100) as bigint)")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents.alias("c"))
    from pyspark.sql import Window

    running = F.sum("c").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    balance = F.when(F.col("o_orderkey") % 19 != 0, running + F.when(F.col("o_orderkey") % 23 == 0, 1).otherwise(0))
    rows = orders.withColumn("balance", balance)
    found = sequences.reconciled(rows, ["o_custkey"], "o_orderkey", F.col("c").cast("double"), F.col("balance").cast("double"), 0)
    return found.groupBy("o_custkey").agg(F.count("*").alias("rows"), F.count_if("tested").alias("transitions"), F.count_if("broken").alias("breaks"))


@query("q_W07_running_total", "SELECT l_orderkey, l_linenumber, s AS total_before, coalesce(n >= 2 AND z AND abs(l_quantity - s) <= greatest(0.01, abs(s) * 1e-9), false) AS is_total FROM (SELECT *, sum(l_quantity) OVER w AS s, count(l_quantity) OVER w AS n, bool_or(l_quantity <> 0) OVER w AS z FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def running(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    return sequences.running_totals(rows, ["l_orderkey"], "l_linenumber", F.col("l_quantity")).drop("l_quantity")


@query("q_W05_group_records", "SELECT conv_id, record, min(turn) AS first_row, count(*)::BIGINT AS rows, string_agg(text, ' ' ORDER BY turn) FILTER (text <> '') AS text FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS record FROM conversations) GROUP BY 1, 2")
def grouped(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return sequences.records(rows, ["conv_id"], "turn", F.col("role") == "user", ["text"])


@query("q_W30_ranges", "SELECT l_orderkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM (SELECT l_orderkey, min(n) AS lo, max(n) AS hi FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i FROM (SELECT DISTINCT l_orderkey, l_quantity::INT AS n FROM lineitem)) GROUP BY l_orderkey, i) GROUP BY 1")
def page_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("n"))
    return sequences.ranges(rows, ["l_orderkey"], "n")


@query("q_A29_A30_intervals", "SELECT l_returnflag, min(a) AS low, max(b) AS high, count(*)::BIGINT AS parts FROM (SELECT *, sum(st) OVER (PARTITION BY l_returnflag, g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_returnflag, g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS st FROM (SELECT l_returnflag, l_suppkey AS g, l_partkey AS a, l_partkey + l_quantity::INT AS b FROM lineitem))) GROUP BY l_returnflag, g, i")
def intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("b"))
    return sequences.merged_intervals(rows, ["l_returnflag", "g"], "a", "b", 5).drop("g")


@query("q_A25_chains", "SELECT l_suppkey, cluster::BIGINT AS cluster, round(avg(pos), 6) AS mean, count(*)::BIGINT AS size FROM (SELECT *, sum(st) OVER (PARTITION BY l_suppkey ORDER BY pos, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY l_suppkey ORDER BY pos, l_orderkey, l_linenumber) <= 20 THEN 0 ELSE 1 END AS st FROM (SELECT l_suppkey, l_partkey AS pos, l_orderkey, l_linenumber FROM lineitem))) GROUP BY 1, 2")
def chains(spark, sf_dir):
    rows = keyed(spark, sf_dir, "lineitem", "l_suppkey").select("l_suppkey", F.col("l_partkey").alias("at"))
    return sequences.chained(rows, ["l_suppkey"], "at", 20).withColumn("mean", F.round("mean", 6))


@query("q_A33_A34_weighted", "WITH s AS (SELECT l_shipmode_key AS g, q, sum(w) AS w FROM (SELECT l_suppkey AS l_shipmode_key, l_quantity::INT AS q, l_linenumber AS w FROM lineitem) GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY q) AS upto, sum(w) OVER (PARTITION BY g) AS every FROM s) SELECT g, min(q) FILTER (2 * upto >= every) AS median, arg_max(q, (w, q)) AS mode FROM u GROUP BY 1")
def weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").alias("w"))
    return sequences.weighted_median(rows, ["g"], "q", "w").join(sequences.modal(rows, ["g"], "q", "w"), "g")


@query("q_W34_context", "SELECT conv_id, turn, coalesce(max(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1, false) AS shown FROM (SELECT *, (text LIKE '%###%' OR len(text) > 400)::INT AS c FROM conversations)")
def context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    changed = F.col("text").contains("###") | (F.length("text") > 400)
    return sequences.unchanged_gaps(rows, ["conv_id"], "turn", changed, 1).select("conv_id", "turn", "shown")
