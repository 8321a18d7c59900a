"""The rest of the library: equal to SQL over the smallest tables, and examples worked out by hand."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, diff, numbers, paths, words
from plumbline.functions import text as t
from plumbline.operators import clean as cleaner
from plumbline.operators import headers, sequences
from plumbline.plans import catalogue
from plumbline.operators import semi
from plumbline.sources import delimited
from plumbline.streaming import clean as streaming

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equal_to_sql(spark, con, name):
    wanted = con.sql(catalogue.ORACLES[name])
    columns = sorted(wanted.columns)
    frame = catalogue.QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(map(plain, r)) for r in frame.select(columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def values(spark, function, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r[1] for r in sorted(rows.select("i", function(F.col("v"))).collect())]


@pytest.mark.parametrize(
    "function, cases",
    [
        (words.title_case, {"the lord of the rings": "The Lord of the Rings", "XMLHttpRequest is here": "Xml Http Request Is Here", "to be or not\nto be": "To Be or Not\nTo Be", "": ""}),
        (words.sentence_case, {"HELLO world. bye NOW! ok": "Hello world. Bye now! Ok", "(what)\nTHEN": "(What)\nThen"}),
        (t.camel_case, {"XMLHttpRequest": "xmlHttpRequest", "  hello big_world": "  helloBigWorld"}),
        (t.snake_case, {"helloWorld 2x": "hello_world_2x", "a\r\nbC\rd": "a\r\nb_c\rd"}),
        (t.toggle_case, {"aBc1": "AbC1"}),
        (lambda c: t.base64_text(c, True), {"hé": "aMOp"}),
        (t.base64_plain, {"aMOp": "hé", "aGk": "hi", "%%": None}),
        (t.html_unescape, {"&#233;&#xE9;&amp;lt;&nope;&copy;": "éé&lt;&nope;©"}),
        (t.url_component, {"a b+c~!'()*é": "a%20b%2Bc~!'()*%C3%A9"}),
        (t.would_spreadsheet_change, {"007": True, "1E5": True, "MAR1": True, "3-4": True, "1" * 16: True, "13-14": False, "7": False}),
        (t.needs_formula_escape, {"=1+1": True, "@x": True, "-cmd": True, "-42": False, "+1.5e3": False}),
        (t.essence, {"First_Name-x": "firstnamex"}),
        (t.safe_filename, {"a/b:c?.txt": "a-b-c-.txt"}),
        (lambda c: dates.normalise(c, "dmy"), {"2024-3-4 09:30": "2024-03-04 09:30", "4 Mar 24": "2024-03-04", "Mar 4, 2024": "2024-03-04", "13-12-2024": "2024-12-13", "12-13-2024": "2024-12-13", "01/02/69": "1969-02-01", "1.2.3": None, "31/04/2024": None, "2024/02/30": None, "N/A": None}),
        (lambda c: dates.inspect(c)["kind"], {"01/02/69": "ambiguous", "13-12-2024": "ordered", "2024-02-29": "fixed", "2023-02-29": "not-a-date"}),
        (lambda c: numbers.amount(c)["value"], {"(1,234.50)": -1234.5, "1.234,50": 1234.5, "1,23,456.78": 123456.78, "1,234": 1234.0, "1.234": None, "£12.30": 12.3, "500 DR": -500.0, "1 234 567,89": 1234567.89, "x": None, "": None}),
        (lambda c: numbers.amount(c)["grouping"], {"1.234,50": "european", "1,23,456.78": "indian", "1,234": "plain", "12.30": "none", "1 234": "space"}),
        (numbers.coerced_kind, {"007": "text", "1.50": "number", "9007199254740993": "text", "TRUE": "true", "Null": "null", "1e5": "number", "{}": "object", "": "blank"}),
        (lambda c: numbers.roman(c.cast("int")), {"4": "iv", "1994": "mcmxciv", "0": None}),
        (lambda c: numbers.human_bytes(c.cast("double")), {"999": "999 B", "2048": "2.0 KB", "52428800": "50 MB"}),
    ],
    ids=range(20),
)
def test_scalar(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_loose_clusters_and_merge_plans(spark):
    from plumbline.operators import tally

    counts = spark.createDataFrame([("Birmingham", 9), ("Birmingam", 2), ("Birminghamm", 1), ("Leeds", 4), ("10000", 3), ("10001", 3)], "value string, count long")
    got = tally.loose_clusters(counts).collect()
    assert sorted((r.value, r.total, r.suggested, r.rows_affected) for r in got) == [("Birmingam", 12, "Birmingham", 3), ("Birmingham", 12, "Birmingham", 3), ("Birminghamm", 12, "Birmingham", 3)]
    assert tally.merge_plan([("B", ["A", "B"]), ("C", ["B", "C"]), ("A", ["D"])]) == {"A": "C", "B": "C", "D": "C"}
    assert tally.merge_plan([("B", ["A"]), ("A", ["B"])]) == {"A": "B", "B": "A"}


def test_clusters_keep_amounts_and_orders_apart(spark):
    from plumbline.operators import tally

    counts = [("New York", 5), ("new york", 2), ("York, New", 1), ("New-York", 1), ("-5", 4), ("5", 9), ("5%", 2), ("+ 5", 1), ("(5)", 1), ("Caf\u00e9", 3), ("cafe", 4), ("Rent 1,000", 2), ("rent 1.000", 1), ("a  b", 1), ("A b", 2)]
    rows = tally.clusters(spark.createDataFrame(counts, "value string, count long")).collect()
    got = {}
    for r in rows:
        got.setdefault((r.reason, r.suggested, r.total, r.rows_affected), set()).add(r.value)
    assert got == {
        ("punctuation", "New York", 8, 3): {"New York", "new york", "New-York"}, ("word-order", "New York", 9, 4): {"New York", "new york", "New-York", "York, New"},
        ("accents", "cafe", 7, 3): {"Caf\u00e9", "cafe"}, ("whitespace", "A b", 3, 1): {"a  b", "A b"},
    }


@pytest.mark.parametrize(
    "text, amounts",
    [
        ("-5", "-5"), ("5", "5"), ("5%", "5%"), ("+ 5", "+5"), ("(5)", "(5)"), ("$ 1,234.50 CR", "$1,234.50"), ("500-", "500-"), ("5 - 3", "-3|5"), ("v1.2.3", "1.2.3"), ("no digits - here %", ""), ("12\u00a0000 \u20ac", "12,000|\u20ac"), ("\u22125 and 7", "-5|7"),
        ("Q1-Q2", "1-|2"), ("", ""),
    ],
)
def test_amount_signature(spark, text, amounts):
    assert values(spark, t.amount_signature, [text]) == [amounts]


def test_near_spellings_against_all_pairs(spark):
    """Every pair within the distance that shares a 4-gram, whatever grams are common."""
    from plumbline.operators import tally

    r = random.Random(4)
    base = ["customer service " + "".join(r.choices("abcde", k=6)) for _ in range(12)]
    words = set(base)
    for w in base * 4:
        k = r.randrange(len(w))
        words |= {w[:k] + r.choice(["", "x", w[k] * 2]) + w[k + 1 :], "aaaaaaaa" + w[-2:], w.replace(" ", "")}
    words |= {"uk", "us", "10000", "10001", "2018 q1", "2019 q1"}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
        return row[-1]

    import re

    wanted = set()
    bare = {w: re.sub(r"\W", "", w) for w in words}
    grams = {w: {bare[w][i : i + 4] for i in range(len(bare[w]) - 3)} for w in words}
    most = lambda w: 0 if len(w) < 5 else 1 if len(w) < 10 else 2
    for a in words:
        for b in words:
            if a < b and grams[a] & grams[b] and lev(a, b) <= min(most(a), most(b)) and re.sub(r"\d", "", a) != re.sub(r"\d", "", b) and not (a.isdigit() or b.isdigit()):
                wanted.add((a, b))
    got = {(x.a, x.b) for x in tally.near_spellings(spark.createDataFrame([(w,) for w in words], "value string")).collect()}
    assert got == wanted and len(wanted) > 50


def test_diff_rows_and_spans():
    rows, counts = diff.line_diff("a\nthe old line here\nc", "a\nthe new line here\nc\nd")
    assert diff.as_text(rows) == " a\n-the old line here\n+the new line here\n c\n+d" and counts == {"same": 2, "deleted": 0, "inserted": 1, "modified": 1}
    r = random.Random(3)
    for _ in range(300):
        a, b = (" ".join(r.choices(["x", "yy", "z,", "Q"], k=r.randrange(9))) for _ in range(2))
        assert diff.rebuilds(diff.spans(a, b), a, b)
    assert diff.alike(diff.spans("abc def ghi", "abc def xyz"), "abc def ghi", "abc def xyz") and not diff.alike(diff.spans("aaa", "bbb"), "aaa", "bbb")
    assert diff.beyond_limit("x" * 20_000, "y" * 20_000, "chars") == 30_000 and diff.beyond_limit("x", "y", "lines") is None


@pytest.mark.parametrize(
    "text, encoding",
    [
        ("na\u00efve caf\u00e9 \u20ac12 \u2018quoted\u2019 text with accents \u00e9\u00e8\u00e0", "cp1252"), ("\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440, \u044d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0440\u0443\u0441\u0441\u043a\u043e\u043c", "cp1251"),
        ("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059\u3002\u3053\u308c\u306f\u8a66\u9a13", "shift_jis"), ("plain", "utf-8"),
    ],
)
def test_encoding(text, encoding):
    assert delimited.sniff_encoding(text.encode(encoding)) == (encoding, 0)


def test_mojibake():
    broken = "Caf\u00e9 \u20ac5".encode().decode("cp1252")
    assert delimited.undo_mojibake(broken) == "Caf\u00e9 \u20ac5" and delimited.undo_mojibake("Caf\u00e9") is None and delimited.undo_mojibake("plain") is None
    assert delimited.mojibake_examples(broken, "Caf\u00e9 \u20ac5") == [(broken.split()[0], "Caf\u00e9"), (broken.split()[1], "\u20ac5")]
    assert delimited.western_bytes("a\u20ac\u4e00") == b"a\x80?"


def test_headers():
    assert headers.standardise(["Price ($)", "Price (£)", "", ""]) == headers.Headers(["Price $", "Price £", "Column 3", "Column 4"], 2, 0, 2, 0)
    assert headers.standardise(["firstName", "HTTPServer", "first_name"], snake_case=True).names == ["first_name", "http_server", "first_name_2"]
    kept = headers.standardise(["Total (net)", "Total net"])
    assert kept.names == ["Total (net)", "Total net"] and kept.kept_distinct == 2 and kept.renamed == 0


GRID = [
    (0, "Quarterly report", "", ""), (1, "Name", "Joined", "Amount ($)"), (2, " Ada ", "03/04/2024", "1,200"), (3, "Ada", "3/4/2024", "1,200"), (4, "", "", ""), (5, "Bob", "25/12/2023", "N/A"), (6, "Total", "", "2,400"),
]


def test_clean_example(spark):
    rows = spark.createDataFrame(GRID, "_row long, c0 string, c1 string, c2 string")
    out = cleaner.clean(rows, cleaner.CleanOptions(header_row=1))
    assert out.rows.columns == ["_row", "Name", "Joined", "Amount $"] and out.date_orders == {"c1": "dmy"}
    assert sorted(map(tuple, out.rows.collect())) == [(2, "Ada", "2024-04-03", "1,200"), (5, "Bob", "2023-12-25", "N/A"), (6, "Total", "", "2,400")]
    assert sorted((r._row, r.reason, r.duplicate_of) for r in out.removed.collect()) == [(0, "preamble", None), (1, "header", None), (3, "duplicate", 2), (4, "blank", None)]
    s = out.stats.first()
    assert (s.source_rows, s.preamble_rows, s.rows_after, s.duplicate_rows, s.blank_rows, s.trimmed_cells, s.date_cells, s.date_columns, s.renamed_headers, s.changed_rows) == (7, 1, 3, 1, 1, 1, 2, 1, 1, 2)
    assert {(r._row, r.column): (r.after, r.reasons) for r in out.changes.collect()}[2, "c0"] == ("Ada", ["trimmed"])
    blanked = cleaner.clean(rows, cleaner.CleanOptions(header_row=1, blank_sentinels=True, footer_rows=[6]))
    assert blanked.stats.first().sentinel_cells == 1 and blanked.removed.where("reason = 'footer'").count() == 1


def test_structure(spark):
    from plumbline.operators import structure

    rows = spark.createDataFrame(GRID, "_row long, c0 string, c1 string, c2 string")
    found = structure.analyse(rows)
    assert found.header_row == 1 and found.footers == {6: "total-word"} and found.index_column is None
    body = [(i + 2, str(i), f"name {i}", str(10 * i), "2024-01-0%d" % (i + 1)) for i in range(8)]
    sheet = [(0, "List of things", "", "", ""), (1, "", "Name", "Price", "Day"), *body, (10, "8", "", "280", ""), (11, "a note about all of this", "", "", "")]
    found = structure.analyse(spark.createDataFrame(sheet, "_row long, a string, b string, c string, d string"))
    assert found.header_row == 1 and found.footers[10] == "fewer-values" and found.footers[11] == "trailing-note"
    plain = [(i, str(i), f"{i * i}.5", "2024-01-01") for i in range(5)]
    found = structure.analyse(spark.createDataFrame(plain, "_row long, a string, b string, c string"))
    assert found.header_row is None and found.index_column == 0
    assert structure.header([]) == (None, "low", {})


def test_clean_edges(spark):
    rows = spark.createDataFrame([(0, "1", ""), (1, "2", ""), (2, None, "x"), (3, None, None)], "_row long, c0 string, c1 string")
    out = cleaner.clean(rows, cleaner.CleanOptions(header_row=None, index_column="c0"))
    assert sorted((r._row, r.reason) for r in out.removed.collect()) == [(0, "index-only"), (1, "index-only"), (3, "blank")]
    assert cleaner.clean(rows.limit(0), cleaner.CleanOptions(header_row=None)).rows.collect() == []


def test_records_and_ranges(spark):
    rows = spark.createDataFrame([(0, "1 Jan", "Shop", "5.00"), (1, "", "Branch 7", ""), (2, "2 Jan", "Rent", "9.00")], "r int, a string, b string, c string").withColumn("s", F.lit(1))
    out = sequences.records(rows, ["s"], "r", (F.col("a") != "") | (F.col("c") != ""), ["a", "b", "c"]).orderBy("record").collect()
    assert [(x.a, x.b, x.c) for x in out] == [("1 Jan", "Shop Branch 7", "5.00"), ("2 Jan", "Rent", "9.00")]
    balance = spark.createDataFrame([(1, 0.0, 100.0), (2, -30.0, 70.0), (3, 20.0, 95.0)], "r int, d double, b double").withColumn("s", F.lit(1))
    got = sequences.reconciled(balance, ["s"], "r", F.col("d"), F.col("b")).orderBy("r").collect()
    assert [(x.tested, x.broken) for x in got] == [(False, False), (True, False), (True, True)]


def longest_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_diff_counts_of_unlike_texts():
    """Counts equal a shortest script's; unlike texts of thousands of words take no square of their edits in Python steps."""
    import time

    rng = random.Random(3)
    for n in [0, 1, 7, 30] * 40:
        a, b = ("".join(rng.choice("ab c\n") for _ in range(rng.randint(0, n))) for _ in range(2))
        for mode in ("lines", "words", "chars"):
            steps = diff.script(diff.pieces(a, mode), diff.pieces(b, mode))
            assert diff.stats(a, b, mode) == tuple(sum(k for kind, k, _ in steps if kind == one) for one in ("same", "delete", "insert"))
    a, b = ([rng.randint(0, 900) for _ in range(4000)] for _ in range(2))
    began = time.process_time()
    assert 0 < diff.staying(a, b) < 4000
    assert time.process_time() - began < 2
    changed = [-1, *a, *a[:3000], -2, *a]
    assert diff.staying(["x", *a, *a, *a], ["y", *a, *a[:3990], *a]) == 11990
    assert diff.staying(changed, [-3, *changed[1:]]) == len(changed) - 1


def test_invisible_places_far_into_a_text(spark):
    """Places equal a plain loop's, also behind many characters, line ends and letters of two units."""
    odd, rng = "\u200b\u00a0\u00ad\x07\u3000\x7f", random.Random(5)
    rows = [(k, "".join(rng.choice("ab\n\r\U0001f600" + odd * (k % 3)) for _ in range(rng.randint(0, 90)))) for k in range(60)] + [(60, "x" * 500_000 + "\n" + "\u200by" * 30), (61, "")]
    got = {r.k: [(p.line, p.column, p.code) for p in r.p] for r in spark.createDataFrame(rows, "k long, v string").select("k", t.invisible_places(F.col("v")).alias("p")).collect()}
    for k, text in rows:
        want = []
        for i, c in enumerate(text):
            if c in odd and len(want) < 20:
                want.append((text[:i].count("\n") + 1, len(text[:i].rpartition("\n")[2].replace("\r", "")) + 1, f"U+{ord(c):04X}"))
        assert got[k] == want, k


def test_diff_is_minimal_and_rebuilds():
    r = random.Random(1)
    for _ in range(500):
        a, b = r.choices("abc", k=r.randrange(9)), r.choices("abc", k=r.randrange(9))
        steps = diff.script(a, b)
        assert [x for k, n, i in steps if k != "delete" for x in (b if k == "insert" else a)[i : i + n]] == b
        assert sum(n for k, n, _ in steps if k == "same") == longest_common(a, b)


def test_paths():
    value = {"a.b": {"0": 1, "x": [1, {"y": None}], "e": [], "o": {}}, "t": "z"}
    flat = paths.flatten(value)
    assert flat[0] == ("a\\.b.\\0", 1) and paths.unflatten(dict(flat)) == value
    assert paths.split_path("a\\.b.0") == ["a.b", 0]
    assert [paths.detect_format(x)[0] for x in ('{"a": 1}', "a,b\n1,2\n3,4", "a: 1\nb: 2", "words")] == ["json", "csv", "yaml", "text"]
    assert paths.json_fault('{"a" 1}')[:2] == (1, 6) and paths.json_fault("[1]") is None


def test_json_that_is_odd(spark):
    """Half characters, names that are no JSON, and depth: no row ends the job."""
    deep = lambda n: "[" * n + "1" + "]" * n
    rows = [(1, '{"b":"\\ud800","\\udc00":1}'), (2, "[NaN]"), (3, deep(64)), (4, deep(65)), (5, deep(100_000)), (6, None), (7, "1" * 5000), (8, '{"a":{"b":[{"c":-Infinity}]}}')]
    docs = spark.createDataFrame(rows, "k long, v string")
    got = {}
    for r in semi.flatten_json(docs, "k", "v").orderBy("k", "record", "place").collect():
        got.setdefault(r.k, []).append((r.path, r.value))
    assert got[1] == [("b", "\ufffd"), ("\ufffd", "1")] and got[2][0][0] is None and got[8][0][0] is None
    assert got[3] == [(".".join(["0"] * 63), "1")] and got[4] == [(".".join(["0"] * 63), "null")]
    assert got[5][0][0] is None and got[6][0][0] is None and got[7][0][0] is None
    told = {r.k: r for r in semi.normalised(docs, "k", "v").collect()}
    assert told[4].trimmed and not told[3].trimmed and told[4].json == "[" * 64 + "null" + "]" * 64 and told[2].json is None and "NaN" in told[2].fault
    with pytest.raises(ValueError, match="paths"):
        semi.COLUMNS, before = 1, semi.COLUMNS
        try:
            semi.to_table(semi.flatten_json(docs, "k", "v"), "k")
        finally:
            semi.COLUMNS = before


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_delimited_files(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes('Name;Größe €\n"Zoë; x";"1\n2"\nB'.encode(encoding))
    grid = delimited.read_grid(spark, f"file://{tmp_path}/a.csv")
    assert [r.cells for r in grid.orderBy("_row").collect()] == [["Name", "Größe €"], ["Zoë; x", "1\n2"], ["B"]]
    assert [tuple(r) for r in delimited.widened(grid, 2).orderBy("_row").collect()][2] == (2, "B", "")
    told = delimited.report(spark, f"file://{tmp_path}/a.csv").first()
    assert (told.separator, told.columns, told.rows, told.ragged) == (";", 2, 3, 1)


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 'say "x",\ny'), ("-4", "")], "a string, b string")
    delimited.write_csv(rows, f"file://{tmp_path}/out")
    back = delimited.read_large(spark, f"file://{tmp_path}/out", ["a", "b"], multiline=True)
    assert sorted(map(tuple, back.collect())) == [("'=1+1", 'say "x",\ny'), ("-4", "")]


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, " a  b "), (1, "a b"), (2, "n/a"), (3, "c")], "m int, v string").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = streaming.without_duplicates(streaming.scrub(stream, ["v"]), "ts", ["v"])
    query = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.v for r in spark.table("cleaned").collect()) == ["a b", "c"]
