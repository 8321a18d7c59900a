"""Paragraphs and tab stops against plain loops."""

import random
import re
import statistics

from plumbline.operators import paragraphs

SHAPE = "page long, col int, y double, x0 double, x1 double, size double, text string, stops array<double>, marker_x double, text_x double, bold boolean, left double, right double, body double, leading double"


def plain_segments(rows):
    """rows: y, x0, x1, size, marker_x, text_x; the number of each one's paragraph."""
    out, history, group = [], [], []
    for i, (y, x0, x1, size, marker, _) in enumerate(rows):
        if i:
            py, px0, px1, psize, _, ptext = rows[i - 1]
            recent = [g for s, g in history if abs(s - size) <= 0.6][-5:]
            usual = max(sorted(recent)[(len(recent) - 1) // 2] if recent else 0, 1.15 * size)
            start = ptext if ptext is not None else px0
            breaks = y - py > 1.3 * usual or abs(psize - size) > 0.6 or abs(x0 - start) > (0.5 * max(psize, size) if start == px0 else 2) or marker is not None
            breaks = breaks or len(group) >= 2 and max(group) - px1 > 2.5 * max(psize, size)
            if breaks:
                group = []
            if y > py:
                history.append((size, y - py))
            out.append(out[-1] + breaks)
        else:
            out.append(0)
        group.append(x1)
    return out


def page(rng):
    y, rows = 50.0, []
    for _ in range(rng.randint(1, 8)):
        kind = rng.choice(["text", "text", "list", "head", "centre"])
        size = {"head": rng.choice([14.0, 18.0]), "text": 10.0, "list": 10.0, "centre": 10.0}[kind]
        y += rng.choice([12.0, 20.0, 26.0])
        for k in range(1 if kind == "head" else rng.randint(1, 6)):
            x0, x1 = (80.0, 480.0) if kind != "centre" else (200.0 - 10 * k, 360.0 + 10 * k)
            marker = 60.0 if kind == "list" and k == 0 else None
            x0 = 60.0 if marker else x0
            x1 -= rng.choice([0, 0, 1, 60]) if kind == "text" else 0
            x0 += rng.choice([0, 0, 0, 8]) if kind == "text" and k == 0 else 0
            rows.append((y, x0, x1, size, marker, 80.0 if marker else None))
            y += rng.choice([12.0, 12.0, 12.5, 15.5]) * size / 10
    return rows


def frame(spark, pages):
    rows = [(p, 0, y, x0, x1, s, f"line {k}", [], m, tx, False, 60.0, 500.0, 10.0, 12.0) for p, some in enumerate(pages) for k, (y, x0, x1, s, m, tx) in enumerate(some)]
    return spark.createDataFrame(rows, SHAPE)


def test_segments_equal_plain_loops(spark):
    rng = random.Random(9)
    pages = [page(rng) for _ in range(60)]
    got = {}
    for r in paragraphs.segmented(frame(spark, pages).repartition(4), ["page", "col"]).orderBy("page", "y").collect():
        got.setdefault(r.page, []).append(r.para)
    assert got == {k: plain_segments(p) for k, p in enumerate(pages)}
    assert max(max(p) for p in got.values()) > 4


def plain_alignment(rows, left, right, em):
    width, middle = max(1, right - left), (left + right) / 2
    tol = max(0.02 * width, 0.15 * em)
    centred = sum(abs((a + b) / 2 - middle) <= tol for a, b in rows) / len(rows)
    share = lambda values: max(sum(abs(v - w) <= 1.5 for w in values) for v in values) / len(values)
    if len(rows) == 1:
        return "center" if centred >= 1 and rows[0][1] - rows[0][0] < 0.8 * width else "left"
    if len(rows) >= 3 and share([b for _, b in rows[:-1]]) >= 0.8 and share([a for a, _ in rows[:-1]]) >= 0.8:
        return "justify"
    varies = max(a for a, _ in rows) - min(a for a, _ in rows) > 3
    return "center" if centred >= 0.7 and varies else "right" if share([b for _, b in rows]) >= 0.7 and varies else "left"


def test_alignment_equals_plain_loops(spark):
    rng, rows = random.Random(4), []
    for _ in range(300):
        kind, n = rng.choice(["c", "l", "r", "j", "x"]), rng.randint(1, 7)
        some = []
        for _ in range(n):
            w, wobble = rng.choice([100.0, 180.0, 300.0]), rng.choice([0.0, 1.0])
            some.append({"c": (250 - w / 2 + wobble, 250 + w / 2), "l": (50.0 + wobble, 50 + w), "r": (450 - w, 450.0 + wobble), "j": (50.0, 450.0 - wobble), "x": (50 + rng.random() * 90, 300 + rng.random() * 90)}[kind])
        rows.append(some)
    F = paragraphs.F
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, l array<struct<x0:double,x1:double>>")
    got = {r.k: r.a for r in table.select("k", paragraphs.alignment(F.col("l"), F.lit(50.0), F.lit(450.0), F.lit(10.0)).alias("a")).collect()}
    wanted = {k: plain_alignment(r, 50, 450, 10) for k, r in enumerate(rows)}
    assert got == wanted and set(wanted.values()) == {"left", "right", "center", "justify"}


def test_joined_lines(spark):
    rows = [["It is a hyph-", "enated word"], ["the well-", "Known one"], ["a - ", "b"], ["page 1-", "2"], ["soft­", "Hyphen and co­op"], ["ends ", "here"], [" - 1 -", "next"], ["X-", "ray"], []]
    got = [r.t for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, l array<string>").orderBy("k").select(paragraphs.joined_lines(paragraphs.F.col("l")).alias("t")).collect()]
    assert got == ["It is a hyphenated word", "the well-Known one", "a - b", "page 1-2", "softHyphen and coop", "ends here", "- 1 - next", "X-ray", ""]


def test_paragraphs_of_a_page(spark):
    line = lambda y, x0, x1, text, size=10.0, marker=None, bold=False: (1, 0, y, x0, x1, size, text, [], marker, 78.0 if marker else None, bold, 60.0, 500.0, 10.0, 12.0)
    rows = [
        line(50.0, 60.0, 200.0, "The Title", 20.0), line(80.0, 60.0, 260.0, "A section", 14.0), line(105.0, 64.0, 498.0, "First line of a para-"), line(117.0, 60.0, 500.0, "graph that goes on"), line(129.0, 60.0, 300.0, "to here."),
        line(150.0, 60.0, 400.0, "One item", marker=60.0), line(162.0, 78.0, 380.0, "which goes on"), line(174.0, 60.0, 200.0, "Another", marker=60.0), line(200.0, 60.0, 180.0, "SMALL CAPS HERE", bold=True), line(226.0, 60.0, 500.0, "A sentence that ends.", 18.0),
    ]
    got = paragraphs.paragraphs(spark.createDataFrame(rows, SHAPE), ["page"]).orderBy("top").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [
        ("heading", 1, "The Title"), ("heading", 2, "A section"), ("paragraph", None, "First line of a paragraph that goes on to here."), ("listItem", None, "One item which goes on"), ("listItem", None, "Another"), ("heading", 3, "SMALL CAPS HERE"), ("paragraph", None, "A sentence that ends."),
    ]
    assert (got[2].first_line, got[2].indent_left, got[2].leading, got[2].lines) == (4.0, 0.0, 12.0, 3)
    assert (got[3].hanging, got[3].indent_left, got[3].before) == (18.0, 18.0, 9.0)


def plain_run(rows):
    """The longest run of lines that share stops."""
    runs, now = [], None
    for i, stops in enumerate(rows):
        merged = []
        if now:
            for column in now[2]:
                hit = next((s for s in stops if abs(s - statistics.median(column)) <= 3), None)
                if hit is not None:
                    merged.append([*column, hit])
        if merged:
            now = (now[0], now[1] + 1, merged)
            continue
        runs.append(now)
        now = (i, 1, [[s] for s in stops]) if stops else None
    runs = [r for r in [*runs, now] if r and r[1] >= 3]
    return max(runs, key=lambda r: r[1]) if runs else None


def plain_shared(rows):
    run, shared = 0, []
    for stops in rows:
        shared = stops if run == 0 else [s for s in shared if any(abs(s - o) <= 3 for o in stops)]
        run = run + 1 if shared else 0
        if run >= 3:
            return True
    return False


def plain_stops(lines, em):
    rows, found = [s for s, _ in lines], plain_run([s for s, _ in lines])
    some = lines[found[0] : found[0] + found[1]] if found else lines
    rows = [s for s, _ in some]
    if rows[0] and all(len(r) == len(rows[0]) for r in rows):
        columns = [list(c) for c in zip(*rows, strict=True)]
    elif found:
        columns = found[2]
    else:
        return None
    right, out = max(x for _, x in some), []
    flush = all(right - x <= 0.5 * em for _, x in some)
    for i, column in enumerate(columns):
        agrees = all(abs(v - statistics.median(column)) <= 3 for v in column)
        if i == len(columns) - 1 and flush and (not agrees or len(some) == 1):
            out.append(("right", right))
        elif agrees:
            out.append(("left", statistics.median(column)))
        else:
            return None
    return out


def test_tab_stops_equal_plain_loops(spark):
    rng, blocks = random.Random(7), []
    for _ in range(200):
        base = [120.0, 200.0, 300.0][: rng.randint(1, 3)]
        lines = []
        for _ in range(rng.randint(1, 9)):
            stops = [] if rng.random() < 0.12 else [s + rng.choice([0.0, 1.0, 2.5, 0.0, 7.0]) for s in base if rng.random() < 0.9]
            lines.append((stops, rng.choice([500.0, 500.0, 498.0, 470.0])))
        blocks.append(lines)
    rows = [(b, 0, float(k), 60.0, x1, 10.0, "a\tb", stops, None, None, False, 60.0, 500.0, 10.0, 12.0) for b, lines in enumerate(blocks) for k, (stops, x1) in enumerate(lines)]
    table = spark.createDataFrame(rows, SHAPE)
    got = {r.page: r for r in paragraphs.tab_stops(table, ["page"]).collect()}
    for b, lines in enumerate(blocks):
        stops, run = [s for s, _ in lines], plain_run([s for s, _ in lines])
        assert got[b].tabbed == plain_shared(stops), stops
        assert got[b].run == (run[1] if run else 0), stops
        found = got[b].stops
        assert (None if found is None else [(s.type, s.pos) for s in found]) == plain_stops(lines, 10), lines


def test_untabbed(spark):
    rows = [(1, 0, float(k), 60.0, 500.0, 10.0, "a \tb\tc", [100.0 + 40 * k], None, None, False, 60.0, 500.0, 10.0, 12.0) for k in range(4)] + [(2, 0, float(k), 60.0, 500.0, 10.0, "a\tb", [100.0], None, None, False, 60.0, 500.0, 10.0, 12.0) for k in range(4)]
    got = {(r.page, r.justified, re.sub("\t", "<tab>", r.text), len(r.stops)) for r in paragraphs.untabbed(spark.createDataFrame(rows, SHAPE), ["page"]).collect()}
    assert got == {(1, True, "a b c", 0), (2, False, "a<tab>b", 1)}


def test_body_metrics(spark):
    spans = spark.createDataFrame([(1, "x" * 50, 10.0, "Serif"), (1, "y" * 20, 10.3, "Sans"), (1, "z" * 60, 10.3, "Sans"), (1, "title", 20.0, "Display"), (2, "  ", 9.0, "Sans")], "doc long, text string, size double, family string")
    lines = spark.createDataFrame([(1, 1, 10.0 + 12 * k, 0.0, 10.0) for k in range(4)] + [(1, 1, 60.0, 0.0, 10.0), (1, 1, 90.0, 0.0, 10.0), (1, 2, 10.0, 0.0, 10.0), (1, 2, 24.0, 0.0, 10.0)], "doc long, page int, y double, x0 double, size double")
    assert [tuple(r) for r in paragraphs.body_metrics(spans, lines, ["doc"]).collect()] == [(1, 10.3, "Sans", 14.0)]
