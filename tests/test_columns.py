"""Columns and tables of pages against plain loops."""

import math
import random

import pytest

from plumbline.operators import columns

SHAPE = "doc long, page int, seq long, text string, x double, y double, w double, size double, body double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def plain_profile(runs, share):
    """The columns of a document's runs (page, line, x, w), by counting places one by one."""
    many = len({r[:2] for r in runs})
    lo, hi = min(r[2] for r in runs), max(r[2] + r[3] for r in runs)
    cover = [0] * (math.ceil((hi - lo) / 0.5) + 1)
    for _, _, x, w in runs:
        for k in range(max(0, math.floor((x - lo) / 0.5)), min(len(cover) - 1, math.ceil((x + w - lo) / 0.5)) + 1):
            cover[k] += 1
    thick = [n > math.floor(share * many) for n in cover]
    gutters, k = [], 0
    while k < len(thick):
        end = k
        while end < len(thick) and not thick[end]:
            end += 1
        if k < end < len(thick) and (end - k) * 0.5 >= max(4, 0.7 * 10):
            gutters.append((lo + k * 0.5, lo + end * 0.5))
        k = max(end, k + 1)
    ends = [lo, *[e for g in gutters for e in g], hi]
    out = []
    for x0, x1 in zip(ends[::2], ends[1::2], strict=True):
        mine = [r for r in runs if x0 <= r[2] + r[3] / 2 <= x1]
        if x1 - x0 <= 0.01 or not mine:
            continue

        def cluster(values):
            values = sorted(values)
            groups = [[values[0]]]
            for v in values[1:]:
                groups[-1].append(v) if v - groups[-1][-1] <= 3 else groups.append([v])
            best = max(groups, key=len)
            return len(best) / len(values), sum(best) / len(best)

        (ls, left), (rs, right) = cluster([r[2] for r in mine]), cluster([r[2] + r[3] for r in mine])
        align = "right" if rs >= ls and rs >= 0.8 else "left" if ls > rs and ls >= 0.8 else "ragged"
        out.append([x0, x1, align, right if align == "right" else left, ls, rs, len(mine)])
    for a, b in zip(out, [*out[1:], None], strict=True):
        a.append((a[1] + b[0]) / 2 if b else None)
    return out


@pytest.mark.parametrize("share", [0.0, 0.08, 0.3])
def test_profile_equals_plain_loops(spark, share):
    rng = random.Random(int(share * 100))
    rows = []
    for doc in range(6):
        for line in range(rng.choice([1, 9, 60])):
            page, y = line // 25, 40 + 12 * (line % 25)
            for c in range(doc + 1):
                if rng.random() < 0.85:
                    w = rng.choice([12, 20, 33.5])
                    x = 50 + 70 * c + (40 - w if c % 2 else rng.choice([0, 0.5, 11]))
                    rows.append((doc, page, len(rows), "t", float(x), float(y), float(w), 10.0, 10.0))
            if rng.random() < 0.1:
                rows.append((doc, page, len(rows), "wide", 45.0, float(y), 200.0, 10.0, 10.0))
    runs = columns.runs_of(frame(spark, rows), ["doc", "page"], "body")
    got = {}
    for r in columns.profile(runs, ["doc"], "body", share).orderBy("doc", "col").collect():
        assert r.col == len(got.get(r.doc, []))
        got.setdefault(r.doc, []).append([r.x0, r.x1, r.align, r.anchor, r.left_share, r.right_share, r.support, r.until])
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[5], r[4], r[6]))
    assert set(got) == set(by)
    for doc, runs_ in by.items():
        wanted = plain_profile(runs_, share)
        assert len(got[doc]) == len(wanted)
        for a, b in zip(got[doc], wanted, strict=True):
            assert a[2] == b[2] and a[:2] + a[3:] == pytest.approx(b[:2] + b[3:])


def test_joined_spans(spark):
    """Gaps of a quarter of the type's size are spaces; where there is no size, of the body's."""
    spans = "array<struct<x:double,w:double,size:double,text:string>>"
    rows = [[(0, 10, 10, "a"), (12, 5, 10, "b"), (20, 5, 10, " c  d"), (60, 5, 10, "e")], [(0, 10, 0, "a"), (12.4, 5, 0, "b"), (20, 5, 0, "c")], []]
    rows = [([(*map(float, r[:3]), r[3]) for r in row],) for row in rows]
    got = spark.createDataFrame(rows, f"s {spans}").select(columns.joined(columns.F.col("s"), columns.F.lit(10.0)).alias("t")).collect()
    assert [r.t for r in got] == ["ab c d e", "ab c", ""]


def statement(doc, pages, rows, start=0, seq=0):
    """Spans of a statement, and the cells of the lines that are its table."""
    out, wanted = [], []

    def put(page, y, *texts):
        for x, text, right in texts:
            w = 5.0 * len(text)
            out.append((doc, page, seq + len(out), text, x - w if right else x, float(y), w, 10.0, 10.0))

    for page in range(start, start + pages):
        put(page, 30, (50.0, "Running head of all pages", False))
        put(page, 60, (50.0, f"Dear customer {'abc'[page % 3]}, this line of prose crosses every gutter there is", False))
        top = 100 + 17 * page  # at one height on all pages, it would run
        put(page, top, (50.0, "Date", False), (120.0, "Details", False), (400.0, "Paid", True), (480.0, "Balance", True))
        wanted.append((page, ["Date", "Details", "Paid", "Balance"]))
        y = top + 12
        for k in range(rows):
            cells = [f"{k % 28 + 1:02}/03/2024", "item " + "abcdefghij"[(7 * k + 3 * page) % 10] * (1 + k % 3), f"{k}.50", f"{1000 - k}.00"]
            put(page, y, (50.0, cells[0], False), (120.0, cells[1], False), (400.0, cells[2], True), (480.0, cells[3], True))
            wanted.append((page, cells))
            y += 12
            if k % 4 == 3:
                put(page, y, (120.0, "and more of it", False))
                wanted.append((page, ["", "and more of it", "", ""]))
                y += 12
        put(page, y + 40, (120.0, "Thank you", False))
        put(page, 780, (50.0, f"Page {page + 1} of {pages}", False))
    return out, wanted


def test_column_tables(spark, tmp_path):
    rows, wanted = [], {}
    for doc, (pages, lines, start) in enumerate([(3, 20, 0), (5, 9, 2), (1, 12, 0), (1, 2, 0)]):
        made, cells = statement(doc, pages, lines, start, len(rows))
        rows += made
        wanted[doc] = cells
    rows.append((9, 0, len(rows), "lonely", 10.0, 10.0, 30.0, 10.0, 10.0))
    tables, pages = columns.column_tables(frame(spark, rows).repartition(4), ["doc"], "body", f"file://{tmp_path}/tables")
    got = {}
    for r in tables.orderBy("doc", "page", "line").collect():
        got.setdefault(r.doc, []).append((r.page, r.cells))
    assert got == {0: wanted[0], 1: wanted[1], 2: wanted[2]}  # two rows on one page are no table
    claimed = {(r.doc, r.page): r.claimed for r in pages.collect()}
    assert claimed == {**{(0, p): True for p in range(3)}, **{(1, p): True for p in range(2, 7)}, (2, 0): True, (3, 0): False, (9, 0): False}


def test_misfit(spark):
    """Runs in the gutters of their document: none on page 0, half of those on page 1."""
    gutters = "array<struct<low:double,high:double>>"
    made = spark.createDataFrame([(1, 0, [(100.0, 120.0), (200.0, 230.0)])], f"doc long, col int, gutters {gutters}")
    runs = spark.createDataFrame([(1, 0, 50.0, 40.0), (1, 0, 90.0, 20.0), (1, 0, 95.0, 10.5), (1, 1, 100.0, 20.0), (1, 1, 300.0, 9.0)], "doc long, page int, x double, w double")
    got = {r.page: r.inside for r in columns.misfit(runs, made, ["doc"]).collect()}
    assert got == {0: 0.0, 1: 0.5}


def test_nothing(spark, tmp_path):
    tables, pages = columns.column_tables(frame(spark, []), ["doc"], "body", f"file://{tmp_path}/none")
    assert tables.collect() == [] and pages.collect() == []


# ---- text columns


def plain_lines(spans):
    spans = sorted(spans, key=lambda s: (s[1], s[0]))
    groups = []
    for s in spans:
        if groups and s[1] - groups[-1][0][1] <= 3:
            groups[-1].append(s)
        else:
            groups.append([s])
    out = []
    for g in groups:
        g = sorted(g, key=lambda s: s[1])
        weight, upto = sum(s[3] for s in g), 0
        for s in g:
            upto += s[3]
            if 2 * upto >= weight:
                break
        out.append((s[1], min(s[0] for s in g), max(s[0] + s[2] for s in g)))
    return out


def plain_columns(spans, width):
    """spans: x, y, w, characters; the split as a recursion."""
    extent = lambda some: (min(s[0] for s in some), max(s[0] + s[2] for s in some))
    if len(spans) < 40:
        return [extent(spans)]
    cover = [0] * width
    for x, _, w, _ in spans:
        low = max(0, min(width - 1, math.floor(x)))
        for k in range(low, min(width, max(low + 1, math.ceil(x + w)))):
            cover[k] += 1
    thick = [n > math.ceil(0.06 * len(spans)) for n in cover]

    def set_as_text(some):
        lines = plain_lines(some)
        if len(lines) < 6:
            return None
        widest = max(b - a for _, a, b in lines)
        if widest <= 0 or sum(b - a >= 0.92 * widest for _, a, b in lines) / len(lines) < 0.6:
            return None
        gaps = sorted(b[0] - a[0] for a, b in zip(lines, lines[1:], strict=False) if b[0] > a[0])
        return gaps[len(gaps) // 2] if gaps else None

    def divide(some, depth):
        if depth >= 2 or len(some) < 40:
            return [extent(some)]
        x0, x1 = extent(some)
        places = [k for k in range(max(0, math.floor(x0)), min(width, math.ceil(x1))) if thick[k]]
        gaps = [(a + 1, b) for a, b in zip(places, places[1:], strict=False) if b - a - 1 >= 10]
        for low, high in sorted(gaps, key=lambda g: (g[0] - g[1], abs((g[0] + g[1] - x0 - x1) / 2))):
            left, right = [s for s in some if s[0] + s[2] <= low], [s for s in some if s[0] >= high]
            a, b = set_as_text(left), set_as_text(right)
            if a is not None and b is not None and abs(a - b) <= 1 and a <= 18:
                return divide(left, depth + 1) + divide(right, depth + 1)
        return [extent(some)]

    found = divide(spans, 0)
    return found if len(found) <= 3 else [extent(spans)]


def test_text_columns_equal_plain_recursion(spark, tmp_path):
    rng, rows = random.Random(4), []
    for page in range(24):
        cols = [1, 2, 3, 4, 2, 3][page % 6]
        measure = (500 - 20 * (cols - 1)) / cols
        for c in range(cols):
            for line in range(rng.choice([5, 14, 30])):
                x, y = 50 + c * (measure + 20), 60 + line * (12 if page % 5 or c else 14)
                w = measure * (1 if rng.random() < (0.4 if page % 7 == 6 else 0.9) else 0.5)
                parts = rng.choice([1, 2, 3])
                for k in range(parts):
                    rows.append((1, page, len(rows), "words", float(x) + k * w / parts, float(y + rng.choice([0, 0.5])), w / parts - 1, 10.0, 10.0))
        if page % 2:
            rows.append((1, page, len(rows), "a masthead over all columns", 50.0, 30.0, 500.0, 20.0, 10.0))
    rows += [(2, 0, len(rows), "few", 10.0, 10.0, 20.0, 10.0, 10.0), (3, 0, len(rows), " ", 10.0, 10.0, 20.0, 10.0, 10.0)]
    spans = frame(spark, rows).withColumn("width", columns.F.lit(600.0))
    got = {}
    for r in columns.text_columns(spans, ["doc", "page"], "body", "width", f"file://{tmp_path}/columns").orderBy("doc", "page", "col").collect():
        got.setdefault((r.doc, r.page), []).append((r.x0, r.x1))
    by = {}
    for r in rows[:-1]:
        by.setdefault(r[:2], []).append((r[4], r[5], r[6], len(r[3])))
    wanted = {key: plain_columns(some, 600) for key, some in by.items()}
    assert {len(v) for v in wanted.values()} >= {1, 2, 3}
    assert set(got) == set(wanted)
    for key, some in wanted.items():
        assert [x for pair in got[key] for x in pair] == pytest.approx([x for pair in some for x in pair]), key


def test_spans_are_gathered_once(spark, tmp_path, monkeypatch):
    """All looks at lines are at one gathering of their spans."""
    made, _ = statement(0, 3, 20, 0, 0)
    calls, real = [], columns._spans
    monkeypatch.setattr(columns, "_spans", lambda: calls.append(1) or real())
    tables, _ = columns.column_tables(frame(spark, made), ["doc"], "body", f"file://{tmp_path}/once")
    assert tables.count() > 0 and len(calls) == 1


def test_rows_are_told_anew_where_columns_change(spark, tmp_path, monkeypatch):
    """All rows were told three times over; now those of documents whose final columns are others than the first."""
    same, wanted = statement(0, 3, 9, 0, 0)
    other, cells = statement(1, 3, 9, 0, 1000)
    same, other = ([r for r in rows if not r[3].startswith(("Dear", "Thank"))] for rows in (same, other))  # by prose the first columns are others
    long = next(i for i, r in enumerate(other) if r[3].startswith("item"))
    other[long] = (*other[long][:3], "item " + "z" * 30, *other[long][4:6], 175.0, 10.0, 10.0)
    cells = [(p, [*c[:1], "item " + "z" * 30, *c[2:]]) if k == 1 else (p, c) for k, (p, c) in enumerate(cells)]
    told, real, names, settled = [], columns._rows, [], columns.settled
    monkeypatch.setattr(columns, "_rows", lambda *a: told.append(1) or real(*a))
    monkeypatch.setattr(columns, "settled", lambda frame, folder, name: names.append(name) or settled(frame, folder, name))
    for k, (rows, want) in enumerate(((same, {0: wanted}), (same + other, {0: wanted, 1: cells}))):
        told.clear(), names.clear()
        tables, _ = columns.column_tables(frame(spark, rows).repartition(4), ["doc"], "body", f"file://{tmp_path}/anew{k}")
        got = {}
        for r in tables.orderBy("doc", "page", "line").collect():
            got.setdefault(r.doc, []).append((r.page, r.cells))
        assert got == want and len(told) == 1 + k and ("second" in names) == bool(k)


def test_plain_texts_and_amounts_at_once(spark):
    """What is told without patterns is what the patterns tell."""
    from pyspark.sql import functions as F

    from plumbline.functions import numbers
    from plumbline.functions import text as t

    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a\tb", "a\nb", "\n", "\u00a0", "a\u00a0b", "\u3000é", "é", "\ufeff", "\u200b", "12", "-3.50", " 4 ", "1,234.00", "−5", "£2", "x", "1" * 400, "1.234", None]
    rows = spark.createDataFrame([(v,) for v in texts], "v string")
    c = F.col("v")
    got = rows.select(t.is_squashed(c), c == t.squash(c), F.coalesce(t.has_ink(c), F.lit(False)), F.coalesce(F.length(t.js_trim(c)) > 0, F.lit(False)), numbers.is_amount(c), F.coalesce((c != "") & numbers.amount(c)["value"].isNotNull(), F.lit(False))).collect()
    assert all(tuple(r[::2]) == tuple(r[1::2]) for r in got) and all({True, False} <= {r[k] for r in got} for k in (0, 2, 4))


def test_median_and_mode_of_like_values(spark):
    """One value of all spans is both; else the weights tell, as they did."""
    from pyspark.sql import functions as F

    from plumbline.operators.layout import median_of, mode_of

    rows = spark.createDataFrame([(0, [(5.005, 1.0), (5.005, 3.0)]), (1, [(9.0, 1.0), (2.0, 1.0), (4.0, 5.0)]), (2, [(7.0, 2.0), (1.0, 2.0)])], "k int, s array<struct<y:double,weight:double>>")
    got = {r.k: (r.m, r.o) for r in rows.select("k", median_of("s", "y").alias("m"), mode_of("s", "y").alias("o")).collect()}
    assert got == {0: (5.005, got[0][1]), 1: (4.0, 4.0), 2: (1.0, 7.0)} and abs(got[0][1] - 5.005) <= 0.0051
