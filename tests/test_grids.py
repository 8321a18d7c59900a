"""Grids of rules against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import grids

RULES = "doc long, page int, id long, axis string, at double, low double, high double, thickness double"
SPANS = "doc long, page int, seq long, text string, x double, y double, w double, size double, body double"
PAGE = ["doc", "page"]


def drawn(rng, xs, ys, missing):
    """The edges of a grid, one rule an edge, some missing, with a little jitter."""
    out = []
    jitter = lambda: rng.choice([-0.4, 0.0, 0.4])
    for k, y in enumerate(ys):
        out += [("h", y + jitter(), a, b) for a, b in zip(xs, xs[1:], strict=False) if not (0 < k < len(ys) - 1 and rng.random() < missing)]
    for k, x in enumerate(xs):
        out += [("v", x + jitter(), a, b) for a, b in zip(ys, ys[1:], strict=False) if not (0 < k < len(xs) - 1 and rng.random() < missing)]
    return out


def test_joined_rules(spark):
    rows = [(1, 0, 0, "h", 10.0, 0.0, 50.0, 1.0), (1, 0, 0, "h", 10.5, 53.0, 90.0, 2.0), (1, 0, 0, "h", 10.0, 100.0, 120.0, 1.0), (1, 0, 0, "h", 30.0, 0.0, 50.0, 1.0), (1, 0, 0, "v", 10.0, 0.0, 50.0, 1.0), (1, 1, 0, "h", 10.0, 51.0, 60.0, 1.0)]
    got = grids.joined_rules(spark.createDataFrame(rows, RULES), PAGE, 4.0).orderBy("page", "id").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, "h", 10.0, 0.0, 90.0, 2.0), (0, 2, "h", 10.0, 100.0, 120.0, 1.0), (0, 3, "h", 30.0, 0.0, 50.0, 1.0), (0, 4, "v", 10.0, 0.0, 50.0, 1.0), (1, 1, "h", 10.0, 51.0, 60.0, 1.0)]


@pytest.fixture(scope="module")
def pages():
    """Pages with two grids each, one below the other, and the groups of rules that hang together with their grid lines."""
    rng, rules, wanted = random.Random(8), [], {}
    for page in range(14):
        own = []
        for part in range(2):
            xs = [50.0 + 40 * k for k in range(rng.randint(2, 6))]
            ys = [60.0 + 300 * part + 20 * k for k in range(rng.randint(2, 7))]
            own += drawn(rng, xs, ys, [0, 0.1, 0.3][page % 3])
        own.append(("h", 900.0, 0.0, 300.0))  # a line alone
        rng.shuffle(own)
        rules += [(1, page, k, *r, 1.0) for k, r in enumerate(own)]
        group = list(range(len(own)))
        meets = lambda a, b: a[0] != b[0] and b[2] - 4 <= a[1] <= b[3] + 4 and a[2] - 4 <= b[1] <= a[3] + 4
        for _ in own:
            for i, a in enumerate(own):
                group[i] = min([group[i], *(group[j] for j, b in enumerate(own) if meets(a, b))])
        for least in set(group):
            some = [r for r, g in zip(own, group, strict=True) if g == least]
            xs, ys = (sorted({round(r[1] / 10) * 10.0 for r in some if r[0] == axis}) for axis in "vh")
            if len(xs) > 1 and len(ys) > 1:
                wanted[page, least] = (xs, ys, some)
    return rules, wanted


def test_grids_equal_plain_loops(spark, pages, tmp_path):
    rules, wanted = pages
    found = grids.grids(spark.createDataFrame(rules, RULES).repartition(4), PAGE, folder=f"file://{tmp_path}/grids")
    got = {(r.page, r.grid): r for r in found.collect()}
    assert set(got) == set(wanted)
    for key, (xs, ys, own) in wanted.items():
        r = got[key]
        mean = lambda axis, at: sum(v := [p[1] for p in own if p[0] == axis and abs(p[1] - at) < 1]) / len(v)  # noqa: B023, E731
        assert r.xs == pytest.approx([mean("v", x) for x in xs]) and r.ys == pytest.approx([mean("h", y) for y in ys])
        edges = (len(xs) - 1) * len(ys) + (len(ys) - 1) * len(xs)
        has = lambda axis, at, low, high: any(a == axis and abs(p - at) < 1 and lo <= low and hi >= high for a, p, lo, hi in own)  # noqa: B023, E731
        whole = sum(has("h", y, a, b) for y in ys for a, b in zip(xs, xs[1:], strict=False)) + sum(has("v", x, a, b) for x in xs for a, b in zip(ys, ys[1:], strict=False))
        assert (r.cols, r.rows) == (len(xs) - 1, len(ys) - 1) and r.closed == pytest.approx(whole / edges)
    tables = grids.whole_grids(found)
    assert {(r.page, r.grid) for r in tables.collect()} == {k for k, r in got.items() if r.cols > 1 and r.rows > 1 and r.closed >= 0.75}
    assert {(r.page, r.grid) for r in grids.boxes(found).collect()} == {k for k, r in got.items() if r.cols == r.rows == 1}


def test_cells_cover_their_grid(spark, pages, tmp_path):
    """Each place of a grid is in one cell or, where two merged cells meet, in several; no drawn edge lies inside the row a cell begins in."""
    rules, wanted = pages
    found = grids.grids(spark.createDataFrame(rules, RULES), PAGE, folder=f"file://{tmp_path}/grids")
    cells = {}
    for r in grids.grid_cells(found, PAGE).collect():
        cells.setdefault((r.page, r.grid), []).append(r)
    for key, (xs, ys, own) in wanted.items():
        has = lambda axis, at, low, high: any(a == axis and abs(p - at) < 1 and lo <= low and hi >= high for a, p, lo, hi in own)  # noqa: B023, E731
        covered = {(r.row + i, r.col + j) for r in cells[key] for i in range(r.row_span) for j in range(r.col_span)}
        assert covered == {(i, j) for i in range(len(ys) - 1) for j in range(len(xs) - 1)}
        for r in cells[key]:
            assert not any(has("v", xs[r.col + j], ys[r.row], ys[r.row + 1]) for j in range(1, r.col_span))
            assert not any(has("h", ys[r.row + i], xs[r.col], xs[r.col + r.col_span]) for i in range(1, r.row_span))
            assert r.w == pytest.approx(xs[r.col + r.col_span] - xs[r.col], abs=1) and r.h == pytest.approx(ys[r.row + r.row_span] - ys[r.row], abs=1)


def test_spans_of_knocked_out_edges():
    xs, ys = [0.0, 10.0, 20.0, 30.0], [0.0, 10.0, 20.0, 30.0]
    every = [("h", y, a, a + 10) for y in ys for a in xs[:3]] + [("v", x, a, a + 10) for x in xs for a in ys[:3]]
    cells = lambda *gone: grids.spanned(xs, ys, [e for e in every if e not in gone])
    ones = [(r, c, 1, 1) for r in range(3) for c in range(3)]
    assert cells() == ones
    assert cells(("v", 10.0, 0.0, 10.0)) == [(0, 0, 1, 2), *ones[2:]]
    assert cells(("h", 10.0, 10.0, 20.0)) == [(0, 0, 1, 1), (0, 1, 2, 1), (0, 2, 1, 1), (1, 0, 1, 1), *ones[5:]]
    block = (("v", 10.0, 0.0, 10.0), ("v", 10.0, 10.0, 20.0), ("h", 10.0, 0.0, 10.0), ("h", 10.0, 10.0, 20.0))
    assert cells(*block) == [(0, 0, 2, 2), (0, 2, 1, 1), (1, 2, 1, 1), *ones[6:]]
    assert cells(*[e for e in every if 0 < e[1] < 30]) == [(0, 0, 3, 3)]
    # A cell as wide as two grows down only where both are open.
    assert cells(("v", 10.0, 0.0, 10.0), ("h", 10.0, 0.0, 10.0)) == [(0, 0, 1, 2), *ones[2:]]
    # Ink on part of an edge keeps it.
    assert grids.spanned(xs, ys, [e for e in every if e != ("v", 10.0, 0.0, 10.0)] + [("v", 10.0, 4.0, 7.0)]) == ones


def test_tables_of_rules(spark, tmp_path):
    """Cells with their shades; a table without a line in it is none."""
    rng = random.Random(1)
    rules = [(1, 0, k, *r, 1.0) for k, r in enumerate(r for r in drawn(rng, [50.0, 100.0, 150.0], [60.0, 80.0, 100.0], 0) if not (r[0] == "v" and abs(r[1] - 100) < 1 and r[2] == 80.0))]
    rules += [(1, 0, len(rules) + k, *r, 1.0) for k, r in enumerate(drawn(rng, [50.0, 100.0, 150.0], [360.0, 380.0, 400.0], 0))]
    lines = spark.createDataFrame([(1, 0, 52.0, 75.0), (1, 0, 110.0, 75.0), (1, 0, 60.0, 95.0), (1, 0, 60.0, 97.0), (1, 0, 10.0, 500.0)], "doc long, page int, x0 double, y double")
    fills = spark.createDataFrame([(1, 0, "#ccc", 50.0, 60.0, 50.0, 20.0), (1, 0, "#eee", 0.0, 0.0, 600.0, 800.0), (1, 0, "#ddd", 49.0, 59.0, 102.0, 22.0), (1, 0, "#ffffff", 50.0, 80.0, 100.0, 20.0)], "doc long, page int, colour string, x double, y double, w double, h double")
    got = grids.tables_of_rules(spark.createDataFrame(rules, RULES), lines, PAGE, fills, f"file://{tmp_path}/tables").orderBy("row", "col").collect()
    assert [(r.row, r.col, r.row_span, r.col_span, r.colour, r.header, r.lines) for r in got] == [(0, 0, 1, 1, "#ccc", True, 1), (0, 1, 1, 1, "#ddd", True, 1), (1, 0, 1, 2, None, False, 2)]


def ruled_page(doc, page, rng, xs, ys, words, seq):
    rules = [(doc, page, k, *r, 1.0) for k, r in enumerate(drawn(rng, xs, ys, 0))]
    spans, cells = [], []
    for r, y in enumerate(ys[:-1]):
        row = []
        for c, x in enumerate(xs[:-1]):
            text = words(r, c)
            for k, word in enumerate(text.split()):
                spans.append((doc, page, seq + len(spans), word, x + 3 + 12.0 * (k % 2), y + 8 + 9.0 * (k // 2), 9.0, 8.0, 8.0))
            row.append(text)
        cells.append(row)
    return rules, spans, cells


def test_ruled_tables_and_ladder(spark, tmp_path):
    rng, rules, spans, wanted = random.Random(3), [], [], {}
    xs, ys = [50.0, 100.0, 150.0, 200.0], [60.0, 90.0, 120.0]
    for page in range(3):
        made = ruled_page(7, page, rng, xs, ys, lambda r, c, page=page: "ab cd ef" if (r, c) == (1, 1) else f"p{page} {r}{c}" if c else "", len(spans))
        rules, spans = rules + made[0], spans + made[1]
        wanted[page] = made[2]
    made = ruled_page(7, 5, rng, xs[:3], ys, lambda r, c: f"q{r}{c}", len(spans))
    rules, spans = rules + made[0], spans + made[1]
    wanted[5] = made[2]
    rules += [(7, 6, k, "h", 100.0 + k, 0.0, 300.0, 1.0) for k in range(3)]  # no grid
    rules_, spans_ = spark.createDataFrame(rules, RULES), spark.createDataFrame(spans, SPANS)
    tables, rows = grids.ruled_tables(spans_, rules_, PAGE, "body", f"file://{tmp_path}/ruled")
    got = {}
    for r in rows.orderBy("page", "row").collect():
        got.setdefault(r.page, []).append(r.cells)
    assert got == wanted
    told = {r.page: r for r in tables.collect()}
    assert told[0].key == "ruled-3-50,100,150,200" and told[0].missing == 1 and told[5].missing == 0
    whole = {r.page: r.table for r in grids.stitched(tables, ["doc"]).collect()}
    assert whole == {0: 1, 1: 1, 2: 1, 5: 2}
    # The ladder: tags claim page 1, so the grids of pages 0 and 2 are two tables.
    from test_columns import statement

    more, cells = statement(8, 3, 12, 0, 1000)
    prose = [(9, 0, 5000, "nothing here", 10.0, 10.0, 50.0, 10.0, 10.0)]
    tagged = spark.createDataFrame([(7, 1, 1, 0, ["t", "u"]), (7, 1, 1, 1, ["v", "w"])], "doc long, table long, page int, row int, cells array<string>")
    out, pages = grids.detected_tables(spark.createDataFrame(spans + more + prose, SPANS), rules_, ["doc"], "body", tagged, f"file://{tmp_path}/ladder")
    found = {}
    for r in out.orderBy("doc", "path", "table", "row").collect():
        found.setdefault((r.doc, r.path, r.table), []).append((r.page, r.cells))
    assert found == {
        (7, "tagged", 1): [(1, ["t", "u"]), (1, ["v", "w"])], (7, "ruled", 1): [(0, r) for r in wanted[0]], (7, "ruled", 2): [(2, r) for r in wanted[2]], (7, "ruled", 3): [(5, r) for r in wanted[5]], (8, "columns", 1): cells,
    }
    assert {(r.doc, r.page): r.path for r in pages.collect()} == {(7, 0): "ruled", (7, 1): "tagged", (7, 2): "ruled", (7, 5): "ruled", (8, 0): "columns", (8, 1): "columns", (8, 2): "columns", (9, 0): None}


def test_pages_without_rules_are_left(spark, tmp_path, monkeypatch):
    """Spans of pages without a rule went through all the steps of grids."""
    rules, spans, wanted = ruled_page(7, 1, random.Random(5), [50.0, 100.0, 150.0], [60.0, 90.0, 120.0], lambda r, c: f"p{r} {c}", 0)
    plain = [(7, 2, 100 + k, "words", 50.0, 60.0 + 12 * k, 20.0, 8.0, 8.0) for k in range(50)]
    sizes, settled = {}, grids.settled
    monkeypatch.setattr(grids, "settled", lambda frame, folder, name: sizes.setdefault(name, settled(frame, folder, name)))
    tables, rows = grids.ruled_tables(spark.createDataFrame(spans + plain, SPANS), spark.createDataFrame(rules, RULES), PAGE, "body", f"file://{tmp_path}/left")
    assert [r.cells for r in rows.orderBy("row").collect()] == wanted and [(r.page, r.missing) for r in tables.collect()] == [(1, 0)]
    assert sizes["spans"].count() == sizes["runs"].count() == len(spans)


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], RULES)
    assert grids.grids(none, PAGE, folder=f"file://{tmp_path}/none").collect() == []
    out, pages = grids.detected_tables(spark.createDataFrame([], SPANS), none, ["doc"], "body", None, f"file://{tmp_path}/empty")
    assert out.collect() == [] and pages.where(F.col("path").isNotNull()).collect() == []


def test_crowded_pages_and_folded_ones_agree(spark, pages, tmp_path, monkeypatch):
    """Groups of rules are the same told a page at a time or by joins, and no step of grids joins or broadcasts what it settled."""
    from plumbline.operators import layout

    rules, wanted = pages
    frame = spark.createDataFrame(rules, RULES)
    told = lambda folder: sorted((r.page, r.id, r.component) for r in layout.rule_groups(frame, PAGE, 4.0, f"file://{tmp_path}/{folder}").collect())
    folded = told("a")
    monkeypatch.setattr(layout, "CROWDED", 40)
    assert told("b") == folded
    monkeypatch.setattr(layout, "CELLS", 7)
    assert told("c") == folded
    assert {(p, c) for p, _, c in folded} >= set(wanted)
    monkeypatch.undo()
    plan = layout.rule_groups(frame, PAGE, 4.0)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_numbers_of_all_rows_take_no_single_task(spark, tmp_path):
    """Numbers follow one order over all rows, ties and empty parts too, and no window without parts reads the rows."""
    from plumbline.operators.sequences import numbered

    rows = spark.range(3000).select(((F.col("id") * 7919) % 1000).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("c")).repartition(7)
    got = numbered(rows, ["a", "b"], "id", f"file://{tmp_path}/numbered")
    found = sorted((r.id, r.a, r.b) for r in got.collect())
    assert [f[0] for f in found] == list(range(1, 3001)) and [f[1:] for f in found] == sorted((r.a, r.b) for r in rows.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [_part")
    assert numbered(rows.where("a < 0"), ["a", "b"], "id", f"file://{tmp_path}/none").collect() == []
