"""Running heads and margins against plain loops."""

import math
import random
import re

from plumbline.operators import running

LINES = "doc long, page int, y double, x0 double, x1 double, top double, bottom double, text string, artifact boolean"
PAGES = "doc long, page int, width double, height double"


def plain(lines, pages):
    """Heads of one document: (zone, nth) -> y, text, pages, fields; and the members."""
    heads, members = {}, []
    for zone in ("header", "footer"):
        def picked(page, tagged, zone=zone):
            some = []
            for r in sorted((r for r in lines if r[0] == page), key=lambda r: r[1]):
                if tagged:
                    inside = r[7] and (r[1] < 400 if zone == "header" else r[1] >= 400)
                else:
                    inside = r[1] <= 72 if zone == "header" else r[1] >= 720
                if inside and r[6].strip():
                    some.append(r)
            return some if len(some) <= 3 else []

        tagged = any(picked(p, True) for p in pages)
        need = 2 if len(pages) <= 3 else math.ceil(0.6 * len(pages))
        need = min(need, len(pages)) if tagged else need
        rows = []
        for page in pages:
            for r in picked(page, tagged):
                key = re.sub(r"\d+", "#", r[6]).strip()
                row = next((row for row in rows if abs(row[0] - r[1]) <= 3), None)
                if row is None:
                    row = (r[1], {})
                    rows.append(row)
                group = row[1].setdefault(key, [])
                if all(q[0] != page for q in group):
                    group.append(r)
        nth = 0
        for y, variants in sorted(rows, key=lambda row: row[0]):
            group = max(variants.values(), key=len)
            if len(group) < need or nth == 3:
                continue
            nth += 1
            digits = [re.findall(r"\d+", r[6]) for r in group]
            fields = {}
            if len(group) > 1 and len({len(d) for d in digits}) == 1:
                for slot in range(len(digits[0])):
                    values = [int(d[slot]) for d in digits]
                    if values == [r[0] for r in group]:
                        fields[slot] = "page"
                    elif fields and set(values) == {len(pages)}:
                        fields[slot] = "pages"
            heads[zone, nth] = (y, group[0][6], len(group), fields)
            members += [(zone, nth, r[0], r[1]) for r in group]
    return heads, sorted(members)


def document(rng, pages):
    lines = []
    tags = rng.random() < 0.3
    for page in range(1, pages + 1):
        put = lambda y, text, artifact=False, page=page: lines.append((page, y, 72.0, 500.0, y - 9, y + 2, text, artifact))
        if rng.random() < 0.8:
            put(30.0 + rng.choice([0, 1, 2.5]), rng.choice(["Report", "Report", "Draft"]) + f" {page} of {pages}", tags)
        if rng.random() < 0.7:
            put(50.0 + 0.5 * (page % 3), "Chapter 7", tags and rng.random() < 0.9)
        for k in range(rng.choice([0, 1, 5])):
            put(60.0 + 2 * k, f"text {k}")
        put(300.0, f"body {page}")
        if rng.random() < 0.9:
            put(760.0, f"{page}", tags)
        if rng.random() < 0.5:
            put(770.0, " ")
    return lines


def test_running_equals_plain_loops(spark, tmp_path):
    rng, lines, pages, wanted = random.Random(5), [], [], {}
    for doc in range(40):
        n = rng.choice([1, 2, 3, 5, 12])
        own = document(rng, n)
        lines += [(doc, *r) for r in own]
        pages += [(doc, p, 600.0, 800.0) for p in range(1, n + 1)]
        wanted[doc] = plain(own, range(1, n + 1))
    heads, members = running.running(spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(pages, PAGES), ["doc"], f"file://{tmp_path}/running")
    got = {}
    for r in heads.collect():
        got.setdefault(r.doc, {})[r.zone, r.nth] = (r.y, r.text, r.pages, dict(r.fields))
        numbers = iter(range(99))
        assert r.template == re.sub(r"\d+", lambda m, r=r, n=numbers: (lambda s: "{" + r.fields[s] + "}" if s in r.fields else m[0])(next(n)), r.text)
    assert got == {d: h for d, (h, _) in wanted.items() if h}
    some = {}
    for r in members.collect():
        some.setdefault(r.doc, []).append((r.zone, r.nth, r.page, r.y))
    assert {d: sorted(v) for d, v in some.items()} == {d: m for d, (_, m) in wanted.items() if m}


def test_margins(spark, tmp_path):
    page = lambda n: [(1, n, 30.0, 200.0, 400.0, 21.0, 32.0, f"Head {n}", False), (1, n, 81.0, 73.0, 300.0, 71.0, 83.0, f"a{n}", False), (1, n, 700.0, 90.0, 527.0, 690.0, 702.0, f"b{n}", False), (1, n, 5.0, 0.0, 600.0, 1.0, 7.0, "mark", True)]
    lines = spark.createDataFrame([r for n in (1, 2, 3) for r in page(n)] + [(2, 1, 400.0, 10.0, 590.0, 391.0, 402.0, "wide", False)], LINES)
    pages = spark.createDataFrame([(1, n, 600.0, 800.0) for n in (1, 2, 3)] + [(2, 1, 600.0, 800.0), (3, 1, 600.0, 800.0)], PAGES)
    heads, members = running.running(lines.where("not artifact"), pages, ["doc"], f"file://{tmp_path}/running")
    assert [(r.zone, r.template, r.align) for r in heads.collect()] == [("header", "Head {page}", "center")]
    got = {r.doc: tuple(r)[1:] for r in running.margins(lines, pages, members, ["doc"]).collect()}
    assert got == {1: (72.0, 72.0, 72.0, 72.0, 21.0, 36.0), 2: (360.0, 10.0, 360.0, 10.0, 36.0, 36.0), 3: (72.0, 72.0, 72.0, 72.0, 36.0, 36.0)}
