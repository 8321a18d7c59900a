"""Sheets of found tables: lineage, types, flags."""

import random

from plumbline.operators import sheets

LINES = "doc long, row int, page int, cells array<string>, overflow boolean"


def one(spark, rows, **more):
    table = spark.createDataFrame([(1, k, *r) if len(r) == 3 else (1, k, *r, False) for k, r in enumerate(rows)], LINES)
    return sheets.sheets(table, ["doc"], **more)


def test_statement(spark):
    made = one(spark, [
        (1, ["Date", "Details", "Paid", ""]), (1, ["01/02/2024", "a", "1.50", ""]), (1, ["", "goes on", "", ""], True), (1, ["15/02/2024", "b", "(2.50)", "x"]), (2, ["", " and on", "", ""]), (2, ["Date", " Details ", "Paid", ""]), (2, ["", "", "", ""]),
        (2, ["20/02/2024", "c", "n/a", "y"]), (2, ["25/02/2024", "", "", ""]), (3, ["03/04/2024", "d", "£3", ""]),
    ])
    rows = made.rows.orderBy("record").collect()
    assert [(r.is_header, r.cells, r.sources) for r in rows] == [
        (True, ["Date", "Details", "Paid", ""], [0]), (False, ["01/02/2024", "a goes on", "1.50", ""], [1, 2]), (False, ["15/02/2024", "b and on", "(2.50)", "x"], [3, 4]), (False, ["20/02/2024", "c", "n/a", "y"], [7]), (False, ["25/02/2024", "", "", ""], [8]), (False, ["03/04/2024", "d", "£3", ""], [9]),
    ]
    assert [(r.sources, r.reason) for r in made.removed.collect()] == [([5, 6], "header-repeated")]
    assert [(r.col, r.header, r.kind, r.decimals, r.order, r.ambiguous) for r in made.columns.orderBy("col").collect()] == [(0, "Date", "date", 0, "dmy", True), (1, "Details", "text", 0, None, False), (2, "Paid", "money", 2, None, False), (3, "", "text", 0, None, False)]
    assert [r.flags for r in rows] == [[], ["overflow"], ["pageBreak"], ["type"], ["sparse"], []]
    assert [r.reasons for r in rows][1:5] == ["Text wider than its column", "Split across pages 1 and 2", "Something here isn’t a number", "Almost nothing on this row"]
    assert [c.iso or c.number or c.text for c in rows[2].typed] == ["2024-02-15", "b and on", -2.5, "x"] and rows[3].typed[2].off_type
    whole = made.sheets.first()
    assert (whole.rows, whole.dropped, whole.pages, whole.ambiguous) == (6, 1, [1, 2, 3], True) and whole.confidence == 2 / 6
    out = sheets.laid_out(made, ["doc"]).orderBy("record").collect()
    assert out[0].values == ["Date", "Details", "Paid", "Column 4", "Page", "Check"] and out[2].values == ["15/02/2024", "b and on", "(2.50)", "x", "1", "Split across pages 1 and 2"]


def test_no_line_is_lost(spark):
    """Each line is a source of one record, kept or removed, whatever the tables hold; and records are those of a plain loop."""
    rng, rows, wanted = random.Random(2), [], {}
    for doc in range(30):
        records = []
        for k in range(rng.randint(0, 25)):
            cells = [rng.choice(["", "", "a", "b", "Head"]), rng.choice(["", "x", "y z"]), rng.choice(["", "", "1.50", "2"])]
            rows.append((doc, k, k // 7, cells, False))
            if not records or cells[0] or cells[2]:
                records.append([])
            records[-1].append((k, cells))
        wanted[doc] = [([k for k, _ in r], [" ".join(c[i] for _, c in r if c[i]) for i in range(3)]) for r in records]
    money = spark.createDataFrame([(d, [2]) for d in range(30)], "doc long, cols array<int>")
    made = sheets.sheets(spark.createDataFrame(rows, LINES).repartition(4), ["doc"], money)
    kept, gone = {}, {}
    for r in made.rows.orderBy("record").collect():
        kept.setdefault(r.doc, []).append((r.sources, r.cells))
    for r in made.removed.collect():
        gone.setdefault(r.doc, []).append((r.sources, r.reason))
    for doc, records in wanted.items():
        filled = [r for r in records if any(r[1])]
        head = "".join(filled[0][1]) if filled else None
        assert kept.get(doc, []) == [r for i, r in enumerate(filled) if i == 0 or "".join(r[1]) != head]
        assert sorted(k for s, _ in [*kept.get(doc, []), *gone.get(doc, [])] for k in s) == [r[1] for r in rows if r[0] == doc]


def test_types_tell_money(spark):
    """Without money columns given, those that all lines show."""
    made = one(spark, [(1, ["", "a", "1.00"]), (1, ["", "b", "2.00"]), (1, ["", "more", ""]), (1, ["", "c", "3.00"])])
    assert [r.cells[1] for r in made.rows.orderBy("record").collect()] == ["a", "b more", "c"]


def test_nothing(spark):
    made = one(spark, [])
    assert made.rows.collect() == [] and made.sheets.collect() == [] and sheets.laid_out(made, ["doc"]).collect() == []


def test_types_of_columns_are_one_aggregate(spark):
    """Cells are read once: no second look at them for columns that are all blank, and no join."""
    rows = spark.createDataFrame([(1, ["12.50", "", "01/02/2024"]), (1, ["-3.00", " ", "13/02/2024"]), (1, ["7.25", "", "14/02/2024"])], "doc int, cells array<string>")
    types = sheets.column_types(rows, ["doc"])
    assert "Join" not in types._jdf.queryExecution().optimizedPlan().toString()
    told = {r["col"]: (r["kind"], r["decimals"], r["order"], r["samples"], r["ambiguous"]) for r in types.collect()}
    assert told == {0: ("money", 2, None, 3, False), 1: ("text", 0, None, 0, False), 2: ("date", 0, "dmy", 3, True)}


def test_short_ways_of_amounts_and_dates(spark):
    """Digits alone and texts that can't be amounts are told at once, as the long way tells them; no text is no date."""
    from pyspark.sql import functions as F

    from plumbline.functions.dates import placed_date
    from plumbline.functions.numbers import amount

    rows = spark.createDataFrame([("7",), ("-0.5",), ("12.345",), ("+7.50",), ("7-",), ("£7.50",), ("part 7",), ("7 CR",), ("1/2",), ("1.",), (None,)], "v string")
    told = {r["v"]: (r["a"] and (r["a"]["value"], r["a"]["negative"], r["a"]["grouping"], r["a"]["decimals"]), r["d"]) for r in rows.select("v", amount(F.col("v")).alias("a"), placed_date(F.col("v")).alias("d")).collect()}
    assert told == {
        "7": ((7.0, False, "none", 0), None), "-0.5": ((-0.5, True, "none", 1), None), "12.345": (None, None), "+7.50": ((7.5, False, "none", 2), None), "7-": ((-7.0, True, "none", 0), None),
        "£7.50": ((7.5, False, "none", 2), None), "part 7": (None, None), "7 CR": ((7.0, False, "none", 0), None), "1/2": (None, None), "1.": (None, None), None: (None, None),
    }


def test_cells_are_read_once(spark, monkeypatch, tmp_path):
    """Amounts and dates were sought in each cell three times: for its table's money, its column's type and its own."""
    rows = [(1, k, 0, ["Date", "Details", "Paid"] if k % 9 == 0 else [f"{k % 28 + 1:02}/03/2024", "", "x" if k == 5 else f"{k}.50"] if k % 4 else ["", "goes on", ""], False) for k in range(60)]
    plans, settled = {}, sheets.settled
    monkeypatch.setattr(sheets, "settled", lambda frame, folder, name: (plans.update({name: frame._jdf.queryExecution().optimizedPlan().toString()}), settled(frame, folder, name))[1])
    made = sheets.sheets(spark.createDataFrame(rows, LINES), ["doc"], folder=f"file://{tmp_path}/once")
    patterns = {name for name, plan in plans.items() if "RLIKE" in plan.upper()}
    assert patterns == {"rows", "records"} and set(plans) == {"rows", "records", "columns"}
    assert "regexp_replace" not in made.sheets._jdf.queryExecution().optimizedPlan().toString()
    kept = made.rows.orderBy("record").collect()
    assert kept[1].typed[0].iso == "2024-03-02" and [r.flags for r in kept].count(["type"]) == 2  # one is a header that a line below goes on
    assert made.sheets.first().rows == len(kept)


def test_what_is_read_is_what_is_typed(spark):
    """A cell that was read is typed in any column as its amount and date say."""
    from pyspark.sql import functions as F

    from plumbline.functions import dates, numbers

    texts = ["", "7", "-0.5", "12.345", "+7.50", "−5.00", "£7.50", "(3.20)", "(x)", "7 CR", "1,234.00", "part 7", "1/2", "01/02/2024", "13/02/2024", "02/13/2024", "13/13/2024", "31/02/2024", "0/5/2024", "2024-02-30", "2024-02-29", "3 Mar 99", "3\u00a0March\u00a02001", "Mar 3, 24", "1.2.70", "1.2.7", "12-11-10", "1 2 3", "none", None]
    rows = spark.createDataFrame([(v, k, o) for v in texts for k in ("date", "money", "number", "text") for o in ("dmy", "mdy", None)], "v string, k string, o string")
    v, k, o = F.col("v"), F.col("k"), F.col("o")
    r = numbers.reading(v)
    a, d = numbers.amount(v), dates.placed_date(v)
    rich = F.coalesce(a.isNotNull() & (a["currency"].isNotNull() | a["marker"].isNotNull() | (a["decimals"] >= 2) | v.rlike(r"^\(.*\)$")), F.lit(False))
    iso, number = F.when(k == "date", dates.placed_date(v, o)["iso"]), F.when(k.isin("money", "number"), a["value"])
    got = rows.select(
        "v", "k", "o", F.struct(r["value"], r["decimals"], F.coalesce(r["rich"], F.lit(False)), r["order"], r["ambiguous"], r["y"].isNotNull()).alias("r"), F.struct(a["value"], a["decimals"], rich, d["order"], d["ambiguous"], d.isNotNull()).alias("rw"),
        F.struct(numbers.typed_cell(v, k, o)["iso"], numbers.typed_cell(v, k, o)["number"], numbers.fits(r, k, o) | (k == "text")).alias("t"), F.struct(iso, number, iso.isNotNull() | number.isNotNull() | (k == "text")).alias("tw"),
    ).collect()
    assert len(got) == 12 * len(texts)
    for x in got:
        assert tuple(x.r) == tuple(x.rw) and tuple(x.t) == tuple(x.tw), x
