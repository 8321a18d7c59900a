import random

import numpy as np
import pytest

from plumbline.llm import integers, negatives, vacodes
from plumbline.llm.integers import LIMIT

SHAPE = "vec_id long, embedding array<double>, label int, error string, row long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], SHAPE)


def numbers(v):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [max(-LIMIT, min(LIMIT, int(np.floor(256 * x)))) for x in v]


def vectors(n, size=8, labels=3, seed=1):
    """Clusters, copies, a label of a third of all rows, nulls and odd values."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.5) for _ in range(size)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([0, 0, *range(labels), None])) for i in range(n)]
    rows += [(3, None, 1), (4, [None] * size, 1), (8, [float("nan")] * size, 0), (9, [float("inf")] * size, 0), (None, [0.1] * size, 0), (None, [0.1] * size, 2)]
    rows += [(100, [0.3] * size, 1)] * 3 + [(200 + k, [0.3] * size, k % 3) for k in range(40)] + [(12, [1e300, -1e300] * (size // 2), 2), (14, [0.5] * (size + 2), 2), (15, [], 2)]
    rng.shuffle(rows)
    return rows


# ---- op12


def coded(rows, parts, entries, rounds):
    """The codes by plain loops."""
    usable = [(i, numbers(v), label) for i, v, label in rows if numbers(v) is not None]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    width = -(-len(usable[0][1]) // parts)
    cut = [[(w + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)] for _, w, _ in usable]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        moved = [list(b) for b in books]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == k]
                if own:
                    moved[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
        books = moved
    best = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = {}
    for (_, _, label), b in zip(usable, best, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in b)
    return books, sorted((repr(i), bytes(k for _, k in b), sum(d for d, _ in b), errors[label]) for (i, _, label), b in zip(usable, best, strict=True))


@pytest.mark.parametrize(("size", "parts", "entries"), [(8, 4, 16), (6, 4, 300), (8, 8, 5)])
def test_codes_equal_plain_loops(spark, size, parts, entries, monkeypatch):
    monkeypatch.setattr(vacodes, "ROWS", 50)
    rows = vectors(230, size)
    entries = min(entries, 256)
    books, wanted = coded(rows, parts, entries, 2)
    given = frame(spark, rows).repartition(3)
    got = vacodes.fit(given, parts, entries, 2)
    assert got.entries.tolist() == books
    table = vacodes.encode(given, got)
    for few in (vacodes.FEW, 0):
        monkeypatch.setattr(vacodes, "FEW", few)
        found = vacodes.with_label_errors(table).collect()
        assert sorted((repr(r.vec_id), bytes(r.code), r.error, r.label_error) for r in found) == wanted


def test_bounds_hold_and_sieve():
    rng = np.random.default_rng(2)
    entries, x = rng.integers(-60, 60, (64, 4)), rng.integers(-60, 60, (500, 4))
    cells = vacodes.Cells.of(entries)
    exact = ((x[:, None] - entries) ** 2).sum(axis=2)
    least, most = cells.bounds(x)
    assert (least <= exact).all() and (exact <= most).all()
    entry, distance, refined = cells.nearest(x)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert refined.min() >= 1 and refined.mean() < 24
    same = vacodes.Cells.of(np.zeros((7, 4), np.int64))  # ties go to the first
    assert same.nearest(x)[0].tolist() == [0] * 500 and same.nearest(x[:0])[0].tolist() == []


def test_decoded_codes_are_near(spark):
    rows = [(i, [random.Random(i).gauss(0, 0.1) for _ in range(16)], 0) for i in range(40)]
    books = vacodes.fit(frame(spark, rows), 16, 64)
    got = {r.vec_id: r.embedding for r in vacodes.decode(vacodes.encode(frame(spark, rows), books), books).collect()}
    for i, v, _ in rows:
        assert got[i] == pytest.approx(v, abs=1 / 256)


def test_codes_of_nothing(spark, tmp_path):
    assert vacodes.fit(frame(spark, [(1, None, 0), (2, [float("nan")], 1)])) is None
    frame(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vacodes.op12_va_codes(spark, str(tmp_path)).collect() == []


# ---- op13


def mined(rows, k=5):
    usable = []
    for i, v, label in rows:
        if label is not None and numbers(v) is not None:
            usable.append((i, numbers(v), label))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for a, (anchor, x, label) in enumerate(usable):
        if anchor is None or anchor % 10:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), i, m) for b, (i, y, m) in enumerate(usable) if b != a and len(x) == len(y)]
        for s, positive, _ in sorted((r for r in scored if r[2] == label), key=order)[:k]:
            inside = sorted((r for r in scored if r[2] != label and 80 * s <= 100 * r[0] <= 100 * s), key=order)[:k]
            out += [(anchor, positive, n, i, s, t) for n, (t, i, _) in enumerate(inside, 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("small", [True, False])
def test_negatives_equal_plain_loops(spark, monkeypatch, tmp_path, small):
    if small:
        for name, value in (("ROWS", 40), ("ANCHORS", 7), ("TILE", 3), ("FEW", 0)):
            monkeypatch.setattr(negatives, name, value)
    rows = vectors(260)
    got = negatives.mine(frame(spark, rows).repartition(3), negatives.F.col("vec_id") % 10 == 0, folder=f"file://{tmp_path}/mine").collect()
    assert sorted(repr(tuple(r)) for r in got) == mined(rows)
    assert got


@pytest.mark.parametrize("high", [3, 200, 1 << 24])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_search_equals_products(high, k):
    """Without and with windows; scores beyond what doubles hold; more wanted than there are."""
    rng = np.random.default_rng(high + k)
    anchors, rows = rng.integers(-high, high, (9, 16)), rng.integers(-high, high, (300, 16))
    rows[50:90] = rows[50]
    allowed = rng.random((9, 300)) < 0.7
    scores = np.array([[sum(int(p) * int(q) for p, q in zip(a, r, strict=True)) for r in rows] for a in anchors])
    far = np.full((9, 1), negatives.END)
    ends = np.sort(rng.integers(scores.min(), scores.max() + 1, (9, 3, 2)), axis=2)
    for low, top in ((-far, far), (ends[:, :, 0], ends[:, :, 1])):
        seen = []
        anchor, row, score = negatives.search(anchors, rows, allowed, low, top, k, seen)
        assert (score == scores[anchor, row]).all() and allowed[anchor, row].all()
        found = set(zip(anchor.tolist(), row.tolist(), strict=True))
        for a in range(9):
            for w in range(low.shape[1]):
                inside = [(int(scores[a, r]), r) for r in np.flatnonzero(allowed[a]) if low[a, w] <= scores[a, r] <= top[a, w]]
                least = sorted(inside, reverse=True)[:k][-1][0] if inside else 0
                assert {(a, r) for s, r in inside if s >= least} <= found
        assert seen == sorted(seen, reverse=True)


def test_candidates_drop_before_the_last_plane():
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, (1000, 64))
    anchors = rows[:4] + rng.integers(-3, 3, (4, 64))
    best = (anchors * rows[:4]).sum(axis=1)[:, None]
    seen = []
    negatives.search(anchors, rows, np.ones((4, 1000), bool), best * 4 // 5, best, 5, seen)
    assert seen[-3] < 0.05 * 4000


def test_planes():
    x = np.array([[-128, 127, 0, -1, 5]])
    assert sum(w * b.astype(int) for w, b in negatives.planes(x)).tolist() == x.tolist()
    assert [w for w, _ in negatives.planes(x)] == [-128, 64, 32, 16, 8, 4, 2, 1]


def test_negatives_of_nothing(spark, tmp_path):
    assert negatives.mine(frame(spark, []), negatives.F.col("vec_id") == 1, folder=f"file://{tmp_path}/mine").collect() == []


@pytest.mark.parametrize(("query", "sql"), [(vacodes.op12_va_codes, vacodes.ORACLE), (negatives.op13_bit_sliced_negatives, negatives.ORACLE)])
def test_queries_equal_sql(spark, small, same_as_sql, query, sql):
    same_as_sql(spark, small, query, sql)


def test_whole(spark):
    got = spark.createDataFrame([([0.5, -0.001, 1e20],), (None,), ([None],), ([float("nan")],), ([],)], "v array<double>").select(integers.whole("v").alias("w")).collect()
    assert [r.w for r in got] == [[128, -1, LIMIT], None, None, None, []]
