"""Where a sheet's header, footer and index column are.

A header shows at the top of a sheet, so its score needs the first 60 rows only, which are taken to
the driver; whether a footer row adds its columns up is asked of all rows in one aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import mean, median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.operators import tally

#: Rows looked at, margins, and what each sign of a header weighs; the last four count against it.
SCANNED, BODY, TAIL, INDEX_ROWS = 20, 20, 5, 50
CLOSE, MOVE, TYPICAL = 0.4, 0.5, 2.2
WEIGHT = {"filled": 1.0, "label": 1.2, "distinct": 0.6, "short": 0.4, "contrast": 1.5, "repeats": 1.0, "narrower": 1.2, "title": 1.0, "depth": 0.03}
AGAINST = ("repeats", "narrower", "title", "depth")
#: How numbers, times, codes, totals and nameless columns look.
NUMBER = re.compile(r"[-+(]?\s*[£$€¥]?\s*(?:\d{1,3}(?:[ .,]\d{3})+|\d+)(?:[.,]\d+)?\s*[)%]?")
TIME = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\.?)?", re.I)
DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[T\s].*)?|\d{1,2}([-/.])\d{1,2}\1(?:\d{2}|\d{4})|\d{1,2}(?:st|nd|rd|th)?[\s/-]+[A-Za-z]{3,9}\.?,?[\s/-]+\d{2,4}|[A-Za-z]{3,9}\.?[\s/-]+\d{1,2}(?:st|nd|rd|th)?,?[\s/-]+\d{2,4}")
CODE = re.compile(r"\d{1,6}")
TOTAL = re.compile(r"(?:grand\s+)?(?:total|subtotal|sum)\b", re.I)
BARE_TOTAL = re.compile(r"(?:grand\s+)?(?:total|subtotal|sum)s?\b[\s:.,\-–—]*", re.I)
UNNAMED = re.compile(r"unnamed:?\s*\d*", re.I)


@dataclass(frozen=True)
class Structure:
    header_row: int | None
    #: high, medium or low
    confidence: str
    scores: dict[int, float]
    index_column: int | None
    #: row and reason: total-word, fewer-values, trailing-note, mostly-blank
    footers: dict[int, str] = field(default_factory=dict)


def kind(cell: str) -> str:
    if not cell:
        return "blank"
    if NUMBER.fullmatch(cell):
        return "number"
    return "date" if TIME.fullmatch(cell) or DATE.fullmatch(cell) else "text"


def is_label(cell: str) -> bool:
    return kind(cell) == "text" and len(cell) <= 60 and any(c.isalpha() for c in cell)


def row_score(rows: Sequence[Sequence[str]], at: int) -> float:
    """How much a row looks like a header over those below: higher is likelier."""
    width, row, body = len(rows[at]), rows[at], rows[at + 1 : at + 1 + BODY]
    filled = [(c, v) for c, v in enumerate(row) if v]
    share = lambda n: n / len(filled) if filled else 0.0
    full = len(filled) / width
    below = mean(sum(map(bool, r)) / width for r in body) if body else full
    settled = []
    for c, v in filled:
        kinds = [kind(r[c]) for r in body if r[c]]
        if kinds:  # text above a column that isn't
            settled.append(kind(v) == "text" and sum(k != "text" for k in kinds) >= 0.6 * len(kinds))
    signs = {
        "filled": full, "label": share(sum(is_label(v) for _, v in filled)), "distinct": share(len({v.lower() for _, v in filled})), "short": share(sum(len(v) <= 40 for _, v in filled)),
        "contrast": sum(settled) / len(settled) if settled else 0.0, "repeats": share(sum(any(r[c].lower() == v.lower() for r in rows[at + 1 :]) for c, v in filled)),
        "narrower": max(0.0, below - full), "title": float(len(filled) == 1 and width >= 3),
    }
    return sum((-1 if k in AGAINST else 1) * WEIGHT[k] * v for k, v in signs.items())


def reads_as_names(row: Sequence[str]) -> bool:
    filled = [v for v in row if v]
    if len(filled) < min(2, len(row)) or len({v.lower() for v in filled}) < 0.5 * len(filled):
        return False
    labels = [v for v in filled if is_label(v)]
    return len(labels) >= 0.5 * len(filled) or bool(labels) and all(is_label(v) or CODE.fullmatch(v) for v in filled)


def index_column(rows: Sequence[Sequence[str]], header: int | None) -> int | None:
    """A nameless column that counts up by one from 0 or 1."""
    body = rows[0 if header is None else header + 1 :][:INDEX_ROWS]
    width = len(rows[0]) if rows else 0
    for c in range(width if header is not None else min(width, 1)):
        name = "" if header is None else rows[header][c]
        if width < 2 or name and not UNNAMED.fullmatch(name):
            continue
        cells = [r[c] for r in body]
        if len(cells) >= 3 and all(re.fullmatch(r"\d{1,9}", v) for v in cells):
            values = [int(v) for v in cells]
            if values[0] <= 1 and all(b == a + 1 for a, b in zip(values, values[1:])):  # noqa: B905
                return c
    return None


def header(rows: Sequence[Sequence[str]]) -> tuple[int | None, str, dict[int, float]]:
    """Row, confidence and scores, for the first rows of a sheet, trimmed.

    Row 0 keeps the job unless another beats it clearly, as what lies above a header is dropped.
    """
    if not rows:
        return None, "low", {}
    raw = {r: row_score(rows, r) for r in range(min(len(rows), SCANNED))}
    scores = {r: s - WEIGHT["depth"] * r for r, s in raw.items()}
    best = max(scores, key=lambda r: (scores[r], -r))
    if best and reads_as_names(rows[0]) and scores[best] - scores[0] < MOVE:
        best = 0
    if not reads_as_names(rows[best]):
        return None, "medium", scores
    body = [row_score(rows, r) for r in range(best + 1, min(len(rows), best + 1 + BODY))]
    standout = raw[best] - (median(body) if len(body) >= 2 else TYPICAL)
    top = sorted(scores.values(), reverse=True)
    margin = top[0] - top[1] if len(top) > 1 else float("inf")
    confidence = "high" if standout >= 0.9 and margin >= 0.5 else "medium" if standout >= 0.6 and margin >= CLOSE else "low"
    return best, confidence, scores


def _adding_up(sheet: DataFrame, columns: list[str], start: int, rows: list[int]) -> set[tuple[int, int]]:
    """(row, column) where a cell is the sum of those above it, at least two and not all zero, none of them unreadable."""
    if not rows or not columns:
        return set()
    long = tally.cells(sheet, "_row", columns).where(F.trim(F.coalesce("value", F.lit(""))) != "").select("row", "name", numbers.spreadsheet_number(F.col("value")).alias("n"))
    asked = F.explode(F.array(*[F.lit(r) for r in rows]))
    each = long.where(F.col("row") >= start).withColumn("asked", asked).where(F.col("row") <= F.col("asked"))
    above = F.col("row") < F.col("asked")
    by = each.groupBy("asked", "name").agg(
        F.sum(F.when(above, F.col("n"))).alias("total"), F.max(F.when(~above, F.col("n"))).alias("own"), F.count_if(above).alias("filled"), F.count_if(above & F.col("n").isNull()).alias("unread"),
        F.max(F.when(above, F.abs("n"))).alias("most"),
    )
    found = by.where((F.col("filled") >= 2) & (F.col("unread") == 0) & (F.col("most") > 0) & numbers.sums_match(F.col("own"), F.col("total"))).select("asked", "name").collect()  # a few rows
    return {(r["asked"], columns.index(r["name"])) for r in found}


def analyse(sheet: DataFrame) -> Structure:
    """sheet: _row and text columns."""
    columns = [c for c in sheet.columns if c != "_row"]
    texts = lambda part: [[(v or "").strip() for v in r[1:]] for r in part]
    top = texts(sheet.select("_row", *columns).orderBy("_row").limit(SCANNED + 2 * BODY).collect())
    found, confidence, scores = header(top)
    skip = index_column(top, found)
    start = 0 if found is None else found + 1
    tail = sheet.select("_row", *columns).orderBy(F.desc("_row")).limit(TAIL).collect()
    usual = [n for n in (sum(bool(v) for c, v in enumerate(r) if c != skip) for r in top[start : start + 50]) if n]
    if not usual or not tail or max(r["_row"] for r in tail) - start < 2:
        return Structure(found, confidence, scores, skip)
    rows = {r["_row"]: texts([r])[0] for r in tail if r["_row"] >= start + 2}
    filled = {at: [(c, v) for c, v in enumerate(row) if v and c != skip] for at, row in rows.items()}
    few = max(1, int(median(usual) * 0.6))
    asked = [at for at, cells in filled.items() if cells and (len(cells) <= few or any(BARE_TOTAL.fullmatch(v) for _, v in cells))]
    sums = _adding_up(sheet, [c for i, c in enumerate(columns) if i != skip], start, asked)
    kept = [i for i in range(len(columns)) if i != skip]
    adds = {at: {kept[c] for r, c in sums if r == at} for at in asked}
    body = top[start : start + 12]
    counted = [c for c in kept if sum(bool(r[c]) for r in body) >= 2 and all(NUMBER.fullmatch(r[c]) for r in body if r[c])]
    footers = {}
    for at, cells in sorted(filled.items()):
        if not cells:
            continue
        word, bare = any(TOTAL.match(v) for _, v in cells), any(BARE_TOTAL.fullmatch(v) for _, v in cells)
        alone = len(cells) == 1 and len(columns) >= 3
        if word and (bare or adds.get(at)):
            footers[at] = "total-word"
        elif adds.get(at) and all(rows[at][c] for c in counted):
            footers[at] = "fewer-values"
        elif alone:
            footers[at] = "trailing-note" if len(cells[0][1]) >= 25 or re.search(r"\s\S+\s", cells[0][1]) else "mostly-blank"
    return Structure(found, confidence, scores, skip, footers)
