"""Queries of findings, balances, structure, ranges, rescued rows, notes and sources, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.functions import text as t
from plumbline.operators import clean, findings, semi, sequences, structure, tally
from plumbline.plans.base import DIRTIED, dirtied, query, quote, sql_scrub, table
from plumbline.session import scratch
from plumbline.sources import delimited, records

# ---- findings

_CODE = "CASE WHEN doc_id % 4 = 0 THEN '0' || doc_id WHEN doc_id % 13 = 0 THEN ' #REF! ' WHEN doc_id % 29 = 0 THEN '' ELSE lang END"
_SHEET = f"SELECT doc_id AS _row, doc_id::VARCHAR AS n, CASE WHEN doc_id % 50 = 7 THEN '' ELSE {DIRTIED} END AS text, CASE WHEN doc_id % 50 = 7 THEN ' ' ELSE source END AS source, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE {_CODE} END AS code FROM documents"


def _sheet(spark, sf_dir):
    key = F.col("doc_id")
    code = F.when(key % 4 == 0, F.concat(F.lit("0"), key.cast("string"))).when(key % 13 == 0, " #REF! ").when(key % 29 == 0, "").otherwise(F.col("lang"))
    bare = key % 50 == 7
    return table(spark, sf_dir, "documents").select(
        key.alias("_row"), key.cast("string").alias("n"), F.when(bare, "").otherwise(dirtied(F.col("text"), key)).alias("text"), F.when(bare, " ").otherwise(F.col("source")).alias("source"),
        F.when(~bare, code).alias("code"),
    )


_TRIMMED = "SELECT _row, name, regexp_replace(coalesce(v, ''), {s}, '', 'g') AS v FROM (SELECT _row, 'n' AS name, n AS v FROM s UNION ALL SELECT _row, 'text', text FROM s UNION ALL SELECT _row, 'source', source FROM s UNION ALL SELECT _row, 'code', code FROM s)".format(s=quote(f"^[{t.SPACE}]+|[{t.SPACE}]+$"))
_KINDS = f"""WITH s AS ({_SHEET}), c AS ({_TRIMMED}), k AS (SELECT * FROM c WHERE v <> ''), h AS (SELECT name, _row, 'leading-zeros' AS kind FROM k WHERE len(v) >= 2 AND regexp_matches(v, '^0\\d+$|^\\d{{16,}}$') UNION ALL
SELECT name, _row, 'excel-error-cells' FROM k WHERE v = '#REF!' UNION ALL SELECT name, _row, 'invisible-characters' FROM k WHERE regexp_matches(v, {quote(f'{t.INVISIBLE}|{t.ODD_SPACE}')})),
n AS (SELECT name, count(*) AS seen FROM k GROUP BY 1), w AS (SELECT name, kind, count(*)::BIGINT AS cells, any_value(seen)::BIGINT AS seen FROM h JOIN n USING (name) GROUP BY 1, 2 HAVING kind <> 'leading-zeros' OR count(*) >= 3 OR count(*) >= any_value(seen) * 0.01)"""


@query("q_A13_column_troubles", f"{_KINDS} SELECT name, kind, cells, seen FROM w")
def troubles(spark, sf_dir):
    return findings.column_troubles(tally.cells(_sheet(spark, sf_dir), "_row", ["n", "text", "source", "code"]))


@query("q_A14_A15_A50_T05_findings", f"""{_KINDS}, f AS (SELECT kind, 'warning' AS severity, 1 AS r, sum(cells)::BIGINT AS count, count(*)::BIGINT AS columns, arg_max(name, (cells, name)) AS worst, (SELECT min(_row) FROM h JOIN w x USING (name, kind) WHERE kind = w.kind) AS first FROM w GROUP BY kind
UNION ALL SELECT 'index-only-rows', 'info', 2, count(*), 0, NULL, min(_row) FROM s WHERE _row % 50 = 7 UNION ALL SELECT 'unclosed-quote', 'serious', 0, count(*), 0, NULL, min(doc_id) FROM documents WHERE doc_id % 31 = 0
UNION ALL SELECT 'duplicate-headers', 'warning', 1, 1, 2, 'Source Id', NULL) SELECT row_number() OVER (ORDER BY r, count DESC, kind)::INT AS place, kind, severity, count, columns, worst, first FROM f WHERE count > 0""")
def found(spark, sf_dir):
    rows = _sheet(spark, sf_dir)
    unclosed = table(spark, sf_dir, "documents").where("doc_id % 31 = 0").select(F.col("doc_id").alias("_row"))
    out = findings.report(rows, ["n", "text", "source", "code"], ["", "Source Id", "source_id", "Code"], "n", unclosed=unclosed)
    return out.select("place", "kind", "severity", "count", "columns", "worst", F.get("rows", F.lit(0)).alias("first"))


@query("q_J06_ragged", "SELECT conv_id AS _row FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) WHERE n <> (SELECT arg_max(n, (c, n)) FROM (SELECT n, count(*) AS c FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1)) AND conv_id >= 3 AND conv_id % 10 <> 0")
def ragged(spark, sf_dir):
    grid = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_row")).agg(F.collect_list("role").alias("cells"))
    return findings.ragged(grid, 3, grid.where("_row % 10 = 0"))


# ---- balances, totals, structure

_CENTS = "round(o_totalprice * 100)::BIGINT"
_STATED = f"SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN c END AS credit, CASE WHEN o_orderkey % 2 = 1 THEN c END AS debit, CASE WHEN o_orderkey % 19 <> 0 THEN sum(CASE WHEN o_orderkey % 2 = 0 THEN c ELSE -c END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END END AS b FROM (SELECT o_custkey, o_orderkey, {_CENTS} AS c FROM orders)"


@query("q_W03_W04_balance_shapes", f"""WITH s AS ({_STATED}), l AS (SELECT *, lag(b) OVER w AS p FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT o_custkey, count(*) AS a, count(b) AS n, count(*) FILTER (b IS NOT NULL AND p IS NOT NULL) AS t, count(*) FILTER (p + coalesce(credit, 0) - coalesce(debit, 0) <> b) AS b1, count(*) FILTER (p + coalesce(credit, 0) <> b) AS b2 FROM l GROUP BY 1)
SELECT o_custkey, CASE WHEN b2 < b1 THEN 'signed' ELSE 'debit-credit' END AS shape, t::BIGINT AS transitions, least(b1, b2)::BIGINT AS breaks, t > 0 AND least(b1, b2) <= 0.2 * t AS usable FROM c WHERE n >= 0.8 * a""")
def shapes(spark, sf_dir):
    from pyspark.sql import Window

    key, cents = F.col("o_orderkey"), F.expr("cast(round(o_totalprice * 100) as bigint)")
    change = F.when(key % 2 == 0, F.col("c")).otherwise(-F.col("c"))
    balance = F.sum(change).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)) + F.when(key % 23 == 0, 1).otherwise(0)
    shown = lambda c: F.format_string("%.2f", c / 100.0)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents.alias("c")).select(
        "o_custkey", "o_orderkey", F.when(key % 2 == 1, shown(F.col("c"))).otherwise("").alias("debit"), F.when(key % 2 == 0, shown(F.col("c"))).otherwise(" ").alias("credit"),
        F.when(key % 19 == 0, "n/a").otherwise(shown(balance)).alias("balance"),
    )
    return sequences.balance_usable(sequences.balance_shapes(rows, ["o_custkey"], "o_orderkey", "balance", ["debit", "credit"]))


@query("q_W08_W13_structure", "SELECT 1 AS header_row, 0 AS index_column, (count(*) + 2)::BIGINT AS footer, 'total-word' AS reason FROM orders WHERE o_orderkey <= 2000")
def sheet_structure(spark, sf_dir):
    """A sheet made of orders: a title, a header without a name for the row numbers, the orders, and a total."""
    from pyspark.sql import Window

    cents = F.expr("cast(round(o_totalprice * 100) as bigint)")
    orders = table(spark, sf_dir, "orders").where("o_orderkey <= 2000").select(F.row_number().over(Window.orderBy("o_orderkey")).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", cents.alias("c"))
    shown = lambda c: F.format_string("%.2f", c / 100.0)
    body = orders.select((F.col("k") + 1).cast("long").alias("_row"), (F.col("k") - 1).cast("string").alias("c0"), F.col("day").alias("c1"), F.col("o_orderpriority").alias("c2"), shown(F.col("c")).alias("c3"))
    total = orders.agg((F.count("k") + 2).alias("_row"), F.lit("").alias("c0"), F.lit("Total").alias("c1"), F.lit("").alias("c2"), shown(F.sum("c")).alias("c3"))
    head = spark.createDataFrame([(0, "Orders of the year", "", "", ""), (1, "", "Day", "Priority", "Price")], "_row long, c0 string, c1 string, c2 string, c3 string")
    found = structure.analyse(head.unionByName(body).unionByName(total))
    return spark.createDataFrame([(found.header_row, found.index_column, at, reason) for at, reason in found.footers.items()], "header_row int, index_column int, footer long, reason string")


@query("q_A19_A23_columns", "SELECT 'o_totalprice' AS name, true AS numeric, 1 - count(*) FILTER (o_orderkey % 9 = 0)::DOUBLE / count(*) AS confidence FROM orders UNION ALL SELECT 'o_orderpriority', false, 1 - count(*) FILTER (o_orderkey % 9 = 0)::DOUBLE / count(*) FROM orders")
def number_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    top = rows.orderBy("o_orderkey").limit(12)
    long = tally.cells(top.select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), "o_orderpriority"), "o_orderkey", ["o_totalprice", "o_orderpriority"]).where("value <> ''")
    number = numbers.spreadsheet_number(F.col("value")).isNotNull()
    named = long.groupBy("name").agg(((F.count("value") >= 2) & F.min(number)).alias("numeric"))
    return named.crossJoin(rows.agg(F.coalesce(F.avg((F.col("o_orderkey") % 9 != 0).cast("double")), F.lit(1.0)).alias("confidence")))  # one row


# ---- the cleaner's rows taken back

_OPTIONS = clean.CleanOptions(header_row=None, collapse_spaces=True, flatten_newlines=True, remove_invisible=True, blank_sentinels=True, normalise_dates=False)
_JUDGED = f"SELECT _row, v, CASE WHEN v = '' THEN 'blank' WHEN min(_row) OVER (PARTITION BY v) <> _row THEN 'duplicate' END AS reason FROM (SELECT doc_id AS _row, {sql_scrub('raw')} AS v FROM (SELECT doc_id, {DIRTIED} AS raw FROM documents))"


def _rescued(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row"), dirtied(F.col("text"), F.col("doc_id")).alias("text"))
    cleaned = clean.clean(rows, _OPTIONS)
    return clean.rescued(cleaned, rows.where("_row % 3 = 0").select("_row"))


@query("q_J03_rescued", f"SELECT _row, v AS text FROM ({_JUDGED}) WHERE reason IS NULL OR _row % 3 = 0")
def rescued(spark, sf_dir):
    return _rescued(spark, sf_dir).rows


@query("q_U04_except_rescued", f"SELECT _row, reason FROM ({_JUDGED}) WHERE reason IS NOT NULL AND _row % 3 <> 0")
def except_rescued(spark, sf_dir):
    return _rescued(spark, sf_dir).removed.select("_row", "reason")


@query("q_M26_changed_nothing", "SELECT count(DISTINCT (c_custkey, c_name)) = count(*) AS unchanged FROM customer")
def unchanged(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row"), "c_name", F.col("c_custkey").cast("string").alias("key"))
    return clean.changed_nothing(clean.clean(rows, clean.CleanOptions(header_row=None)).stats)


# ---- tops, scans, previews


@query("q_T03_entries_within", "SELECT p_brand || p_size AS value, count(*)::BIGINT AS count, min(p_partkey) AS first_row FROM part GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 40")
def entries(spark, sf_dir):
    counts = tally.tally(table(spark, sf_dir, "part").select(F.concat("p_brand", "p_size").alias("value"), "p_partkey"), "value", "p_partkey")
    return tally.entries_within(counts, 40)


@query("q_T06_scanned", "SELECT p_partkey, p_brand, (SELECT max(p_partkey) FROM part) >= 160 AS sampled FROM part WHERE p_partkey BETWEEN 10 AND 159")
def scanned(spark, sf_dir):
    return tally.scanned(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", 10, 150)


@query("q_T08_M16_M17_M18_texts", """SELECT doc_id, substr(text, 1, 120) AS preview, CASE WHEN len(text) <= 200 THEN text WHEN contains(substr(text, 1, 200), chr(10)) THEN regexp_replace(substr(text, 1, 200), '[^\\n]*$', '') ELSE substr(text, 1, 200) END AS sample,
source <> '' AND len(source) <= 64 AND NOT regexp_matches(source, '\\s') AS lone, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'yaml' WHEN 2 THEN 'json' END AS hint FROM documents""")
def previews(spark, sf_dir):
    key = F.col("doc_id") % 4
    extension = F.when(key == 0, "TSV").when(key == 1, "yml").when(key == 2, "json").otherwise("doc")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 120).alias("preview"), t.sample_lines(F.col("text"), 200).alias("sample"), t.lone_header(F.col("source")).alias("lone"), t.hinted_format(extension).alias("hint"))


# ---- ranges, counters, notes, JSON records

_RANGES = "CASE p_partkey % 8 WHEN 0 THEN concat('9-4, 2, ', 11 + p_size % 5, '-') WHEN 1 THEN concat(p_size % 12 + 1, '–', p_size % 20 + 1, '；3、3') WHEN 2 THEN '-4' WHEN 3 THEN 'x-3' WHEN 4 THEN '-' WHEN 5 THEN concat('0,', p_size) WHEN 6 THEN '1, 99' ELSE ' ' END"


@query("q_U06_F66_F67_T09_pages", """WITH p AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN list_sort(list_distinct(list_concat([2, 4, 5, 6, 7, 8, 9], range(11 + p_size % 5, 26)))) WHEN 1 THEN list_sort(list_distinct(list_concat([3], range(least(p_size % 12 + 1, p_size % 20 + 1), greatest(p_size % 12 + 1, p_size % 20 + 1) + 1)))) WHEN 2 THEN [1, 2, 3, 4] WHEN 7 THEN []::BIGINT[] END AS pages FROM part),
i AS (SELECT p_partkey, n, n - row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS g FROM (SELECT p_partkey, unnest(pages) AS n FROM p)), r AS (SELECT p_partkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM (SELECT p_partkey, g, min(n) AS lo, max(n) AS hi FROM i GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey, CASE WHEN pages IS NOT NULL THEN coalesce(ranges, '') END AS ranges, CASE p_partkey % 8 WHEN 3 THEN 'unreadable' WHEN 4 THEN 'no-numbers' WHEN 5 THEN 'below-1' WHEN 6 THEN 'beyond' END AS fault,
CASE WHEN pages IS NULL THEN NULL WHEN len(pages) = 0 THEN 'no pages' WHEN len(pages) = 1 THEN 'page ' || ranges WHEN len('pages ' || ranges) > 16 THEN len(pages) || ' pages' ELSE 'pages ' || ranges END AS label FROM p LEFT JOIN r USING (p_partkey)""")
def pages(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", t.parsed_pages(F.expr(_RANGES), F.lit(25)).alias("p"))
    told = rows.select("p_partkey", "p.fault", "p.pages", t.page_ranges(F.col("p.pages")).alias("ranges"))
    return told.select("p_partkey", "ranges", "fault", t.described_pages(F.col("ranges"), F.size("pages"), 16).alias("label"))


@query("q_W29_counters", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size WHEN 1 THEN l WHEN 2 THEN upper(l) WHEN 3 THEN upper((['', 'x', 'xx', 'xxx', 'xl', 'l'])[p_size // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[p_size % 10 + 1]) ELSE p_size::VARCHAR END AS counter
FROM (SELECT *, CASE WHEN p_size <= 26 THEN chr((96 + p_size)::INT) ELSE chr((96 + (p_size - 1) // 26)::INT) || chr((97 + (p_size - 1) % 26)::INT) END AS l FROM part)""")
def counters(spark, sf_dir):
    key = F.col("p_partkey") % 5
    form = F.when(key == 0, "decimalZero").when(key == 1, "lowerLetter").when(key == 2, "upperLetter").when(key == 3, "upperRoman").otherwise("decimal")
    return table(spark, sf_dir, "part").select("p_partkey", t.counter_text(F.col("p_size"), form).alias("counter"))


@query("q_U01_A46_M04_notes", "SELECT event_id, array_to_string(list_distinct(['a', event_type, 'b']), '|') AS n, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS records FROM events WHERE event_type NOT IN ('a', 'b') AND false UNION ALL SELECT event_id, 'a|' || event_type || '|b', CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT FROM events")
def merged_notes(spark, sf_dir):
    key = F.col("event_id") % 3
    body = F.when(key == 0, F.col("props")).when(key == 1, F.concat(F.lit("["), "props", F.lit(", 1]"))).otherwise("[]")
    notes = t.merged_lists(F.array(F.lit("a"), F.col("event_type")), F.array(F.lit("a"), F.lit("b"), F.col("event_type")))
    records = F.coalesce(F.json_array_length(body), F.lit(1)).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(notes, "|").alias("n"), records.alias("records"))


@query("q_F54_titles", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Page ' || page_id WHEN 1 THEN 'Set ' || page_id WHEN 2 THEN 'Document' ELSE 'After ' || page_id END AS title FROM pages")
def titles(spark, sf_dir):
    key, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    text = F.when(key == 0, F.concat(F.lit("intro\n## two\n# **Page** `"), n, F.lit("` #\n# Later"))).when(key == 1, F.concat(F.lit("Set ["), n, F.lit("](x)\n====\n# Later"))).when(key == 2, F.lit("```\n# no\n```\n#no\n")).otherwise(F.concat(F.lit("~~~\n# no\n```\n# no\n~~~\n\n# After "), n))
    return table(spark, sf_dir, "pages").select("page_id", t.document_title(text).alias("title"))


@query("q_A43_A45_counts", "SELECT o_orderstatus AS kind, o_orderpriority AS reason, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def page_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))


# ---- sources and sinks


@query("q_S01_S02_S24_written_and_read", "SELECT p_partkey::VARCHAR AS c0, CASE WHEN p_partkey % 7 = 0 THEN '''=SUM(' || p_size || ')' WHEN p_partkey % 7 = 1 THEN p_name || ', \"' || p_brand || '\"' ELSE p_name END AS c1, p_size::VARCHAR AS c2 FROM part UNION ALL SELECT 'key', 'name', 'size'")
def written(spark, sf_dir):
    """A table written as delimited text, formulas made harmless, and read again by rows."""
    key = F.col("p_partkey") % 7
    name = F.when(key == 0, F.concat(F.lit("=SUM("), F.col("p_size").cast("string"), F.lit(")"))).when(key == 1, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    folder = scratch(spark)
    delimited.write_csv(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), name.alias("name"), F.col("p_size").alias("size")).coalesce(1), f"{folder}/out")
    return delimited.read_rows(spark, f"{folder}/out", 3, folder=f"{folder}/rows").select("c0", "c1", "c2")


@query("q_S02_numbered_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _row, p_name AS c0, '' AS c1 FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT row_number() OVER (ORDER BY p_partkey) - 1, c0, '' FROM (SELECT p_partkey, '' AS c0 FROM part) WHERE false")
def numbered(spark, sf_dir):
    """Places of rows in a file that is read in parts."""
    folder = scratch(spark)
    table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select("p_partkey", "p_name").orderBy("p_partkey").select(F.concat(F.col("p_name"), F.lit(","))).coalesce(1).write.text(f"{folder}/lines")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = delimited.read_rows(spark, f"{folder}/lines", 2, folder=f"{folder}/rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return rows.select("_row", "c0", "c1")


@query("q_S02_S10_quoted_lines", """SELECT doc_id::VARCHAR AS c0, replace(replace(text, '. ', '. ' || chr(10)), ', ', '", ') AS c1, 2 + doc_id % 3 AS cells, false AS unclosed FROM documents WHERE text IS NOT NULL""")
def quoted_lines(spark, sf_dir):
    """Whole texts with quotes, separators and line ends, rows of two to four cells, written and read in splits of 64 KiB; no value ends where a split does."""
    folder = scratch(spark)
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(". \n")), F.lit(", "), F.lit('", '))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.array_repeat(F.lit(" x"), (F.col("doc_id") % 3).cast("int")))
    table(spark, sf_dir, "documents").where("text is not null").select(line).coalesce(4).write.text(f"{folder}/lines")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = records.read_records(spark, f"{folder}/lines", ",", "utf-8", folder=f"{folder}/rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return rows.select(F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"), F.size("cells").cast("long").alias("cells"), "unclosed")


# ---- formats, nesting, reference headers

_FORMAT = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN concat('a,b\\n', event_id, ',2\\n3,4') WHEN 2 THEN concat('name: ', event_type, '\\nid: 3\\n- x') WHEN 3 THEN event_type WHEN 4 THEN concat('{"k": ', event_id)
WHEN 5 THEN concat('{"k" ', event_id, '}') WHEN 6 THEN concat('a;b\\n1;2\\n3;4\\n', event_id, '\\n7;8\\n9;9') ELSE concat('[', event_id, ', {"x": null}]') END"""


@query("q_M12_M15_mixed_formats", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'yaml' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'json' WHEN 6 THEN 'csv' ELSE 'json' END AS format, CASE event_id % 8 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'low' WHEN 5 THEN 'medium' WHEN 6 THEN 'medium' ELSE 'high' END AS confidence FROM events")
def formats(spark, sf_dir):
    return semi.detect(table(spark, sf_dir, "events").select("event_id", F.expr(_FORMAT).alias("v")), "event_id", "v")


_NESTED = """concat('{"a":{"b":[', event_id, ',{"c.d":"', event_type, '"}],"e":{}},"0":null,"f":[', event_id % 3 = 0, ',1.50]}')"""
_LEAVES = """SELECT event_id, 0 AS record, 0 AS place, 'a.b.0' AS path, event_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, 0, 1, 'a.b.1.c\\.d', event_type FROM events UNION ALL SELECT event_id, 0, 2, 'a.e', '{}' FROM events
UNION ALL SELECT event_id, 0, 3, '\\0', 'null' FROM events UNION ALL SELECT event_id, 0, 4, 'f.0', (event_id % 3 = 0)::VARCHAR FROM events UNION ALL SELECT event_id, 0, 5, 'f.1', '1.5' FROM events"""


@query("q_M02_M05_nested_leaves", _LEAVES)
def leaves(spark, sf_dir):
    return semi.flatten_json(table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED).alias("v")), "event_id", "v")


@query("q_M06_M08_nested_again", """SELECT event_id, 0 AS record, '{"a": {"b": ["' || event_id || '", {"c.d": "' || event_type || '"}], "e": "{}"}, "0": "null", "f": ["' || (event_id % 3 = 0) || '", "1.5"]}' AS json FROM events""")
def nested_again(spark, sf_dir):
    return semi.unflatten_json(leaves(spark, sf_dir), "event_id")


@query("q_A03_F30_reference_headers", "WITH c AS (SELECT 'Product Code' AS name, p_brand AS value FROM part UNION ALL SELECT 'encoded', p_brand FROM part UNION ALL SELECT 'Account No.', p_size::VARCHAR FROM part UNION ALL SELECT 'label', p_brand || '/' || p_size FROM part), d AS (SELECT name, value, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT name, sum(n)::BIGINT AS v, count(*)::BIGINT AS dv FROM d GROUP BY 1) SELECT name, v AS \"values\", dv AS distinct_values, CASE WHEN name = 'Account No.' THEN 'looks-numeric' WHEN name = 'Product Code' THEN 'looks-like-a-reference' WHEN name = 'label' AND dv::DOUBLE / v >= 0.5 THEN 'too-varied' END AS reason FROM b")
def reference_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("Product Code"), F.col("p_brand").alias("encoded"), F.col("p_size").alias("Account No."), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("label"))
    long = rows.select(F.col("p_partkey").alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns[1:]])).alias("c")).select("row", "c.*")
    return tally.assess(long).select("name", "values", "distinct_values", "reason")


@query("q_M10_M19_normalised", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 90 <= 64 THEN repeat('[', (event_id % 90)::INT) || event_id || repeat(']', (event_id % 90)::INT) ELSE repeat('[', 64) || 'null' || repeat(']', 64) END AS json,
CASE WHEN event_id % 7 = 0 THEN 'Expecting value (line 2, column ' || ((event_id % 90)::INT + 1) || ')' END AS fault, event_id % 7 <> 0 AND event_id % 90 > 64 AS trimmed FROM events""")
def normalised(spark, sf_dir):
    """Lists in lists, deeper than the ceiling in some, and broken in others."""
    n = (F.col("event_id") % 90).cast("int")
    value = F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string"))
    text = F.concat(F.repeat(F.lit("["), n), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("\n"), F.repeat(F.lit(" "), n))).otherwise(""), value, F.repeat(F.lit("]"), n))
    return semi.normalised(table(spark, sf_dir, "events").select("event_id", text.alias("v")), "event_id", "v")
