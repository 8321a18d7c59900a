"""Minimal edit scripts by Myers' algorithm in linear space, for one pair of texts at a time; rows, blocks and spans of them."""

from __future__ import annotations

import re
from collections.abc import Sequence


def script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """(same, delete or insert; length; start in a, or in b for an insert): as few deletions and insertions as possible."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    steps = [("same", i, i) for i in range(start)]
    steps += [(kind, i + start, j + start) for kind, i, j in _middle(x, y)]
    steps += [("same", len(a) - end + k, len(b) - end + k) for k in range(end)]
    out: list[list] = []
    for kind, i, j in steps:
        if out and out[-1][0] == kind:
            out[-1][1] += 1
        else:
            out.append([kind, 1, j if kind == "insert" else i])
    return [tuple(o) for o in out]


def _middle(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """Steps from a to b, in memory that grows with the lengths and not with the edits: a box is cut where paths from both of its ends meet."""
    out: list[tuple[str, int, int]] = []
    boxes = [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(("same", a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        if a0 == a1 or b0 == b1:
            out += [("delete", i, b0) for i in range(a0, a1)] + [("insert", a1, j) for j in range(b0, b1)]
            continue
        x, y = _meeting(a, b, a0, a1, b0, b1)
        boxes += [(x, a1, y, b1), (a0, x, b0, y)]
    return out


def _meeting(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int]:
    """A point on a shortest path through a box that begins with a difference; both parts are smaller than the box."""
    n, m = a1 - a0, b1 - b0
    skew = n - m

    def further(far: dict[int, int], k: int, d: int, same) -> tuple[int, int]:
        """Where the furthest run of equal pieces on diagonal k begins and ends after d edits; -1 if none leads there."""
        left, down = far.get(k - 1, -1), far.get(k + 1, -1)
        x = start = 0 if d == 0 else max(left + 1 if 0 <= left < n else -1, down if down - k <= m else -1)
        while 0 <= x < n and x - k < m and same(x, x - k):
            x += 1
        return start, x

    # The end of a run lies on a shortest path; where it is a corner of the box, its beginning does and is none.
    ahead: dict[int, int] = {}
    back: dict[int, int] = {}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            start, x = further(ahead, k, d, lambda i, j: a[a0 + i] == b[b0 + j])
            ahead[k] = x
            if skew % 2 and abs(skew - k) <= d - 1 and x >= 0 and back[skew - k] >= 0 and x + back[skew - k] >= n:
                x = start if (x, x - k) == (n, m) else x
                return a0 + x, b0 + x - k
        for k in range(-d, d + 1, 2):
            start, x = further(back, k, d, lambda i, j: a[a1 - 1 - i] == b[b1 - 1 - j])
            back[k] = x
            if skew % 2 == 0 and abs(skew - k) <= d and x >= 0 and ahead[skew - k] >= 0 and x + ahead[skew - k] >= n:
                x = start if (x, x - k) == (n, m) else x
                return a1 - x, b1 - x + k
    raise AssertionError("paths always meet")


def pieces(text: str, mode: str) -> list[str]:
    """A text as lines (with their ends), words and what is between them, or characters."""
    if mode == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"\w+|\s+|[^\w\s]", text) if mode == "words" else list(text)


#: Pieces from which on a script of few edits is tried first, and how many those are.
LONG, FEW = 5_000, 100


def _edits(a: Sequence, b: Sequence, most: int) -> int | None:
    """How many deletions and insertions lead from a to b, if no more than `most`."""
    far = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            if x >= len(a) and x - k >= len(b):
                return d
            far[k] = x
    return None


def staying(a: Sequence, b: Sequence) -> int:
    """How many pieces a shortest script keeps: the longest common subsequence's length, a row of bits a piece, so unlike texts cost no more than like ones."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = sorted((a[start : len(a) - end], b[start : len(b) - end]), key=len)
    if len(x) > LONG and (edits := _edits(x, y, FEW)) is not None:
        return start + end + (len(x) + len(y) - edits) // 2
    at: dict = {}
    for i, piece in enumerate(x):
        at.setdefault(piece, []).append(i)
    masks = {piece: sum(1 << i for i in places) for piece, places in at.items()}
    every = (1 << len(x)) - 1
    bits = every
    for piece in y:
        mask = masks.get(piece)
        if mask is not None:
            hit = bits & mask
            bits = ((bits + hit) | (bits ^ hit)) & every
    return start + end + len(x) - bits.bit_count()


def stats(a: str, b: str, mode: str = "lines", ignore_case: bool = False, ignore_space: bool = False) -> tuple[int, int, int]:
    """Pieces that stay, go and come."""

    def key(p: str) -> str:
        p = p.lower() if ignore_case else p
        return re.sub(r"\s+", " ", p).strip() if ignore_space else p

    x, y = [key(p) for p in pieces(a, mode)], [key(p) for p in pieces(b, mode)]
    same = staying(x, y)
    return same, len(x) - same, len(y) - same


#: Characters of both sides beyond which a comparison is refused, by mode; the share of characters that makes lines alike; lines and pairs looked into.
LIMITS = {"lines": 400_000, "words": 150_000, "chars": 30_000}
ALIKE, LONGEST, PAIRS = 0.25, 3000, 600


def beyond_limit(a: str, b: str, mode: str) -> int | None:
    """The limit that two texts exceed together, if they do."""
    return LIMITS[mode] if len(a) + len(b) > LIMITS[mode] else None


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text) if text else []


def blocks(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int]]:
    """(same, delete or insert; start in a; start in b; length), in order, deletions before insertions in one place."""
    out, x, y = [], 0, 0
    for kind, n, _ in script(a, b):
        out.append((kind, x, y, n))
        x, y = x + n * (kind != "insert"), y + n * (kind != "delete")
    return out


def spans(before: str, after: str) -> list[tuple[str, str]]:
    """(same, delete or insert; text) by words: what stays, goes and comes; the sides can be read back from them."""
    a, b = pieces(before, "words"), pieces(after, "words")
    return [(kind, "".join(b[y : y + n] if kind == "insert" else a[x : x + n])) for kind, x, y, n in blocks(a, b)]


def rebuilds(parts: Sequence[tuple[str, str]], before: str, after: str) -> bool:
    return "".join(t for k, t in parts if k != "insert") == before and "".join(t for k, t in parts if k != "delete") == after


def alike(parts: Sequence[tuple[str, str]], before: str, after: str) -> bool:
    """A quarter of the longer side's characters stay, at least."""
    longest = max(len(before.strip()), len(after.strip()))
    return longest == 0 or sum(len(t.strip()) for k, t in parts if k == "same") / longest >= ALIKE


def line_diff(before: str, after: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Rows (same, delete, insert; line) and counts: same, deleted, inserted, and of these last two pairs that are one line changed."""
    a, b = lines_of(before), lines_of(after)
    found, rows, budget = blocks(a, b), [], PAIRS
    counts = {"same": 0, "deleted": 0, "inserted": 0, "modified": 0}
    for i, (kind, x, y, n) in enumerate(found):
        rows += [(kind, line) for line in (b[y : y + n] if kind == "insert" else a[x : x + n])]
        if kind == "same":
            counts["same"] += n
            continue
        counts["deleted" if kind == "delete" else "inserted"] += n
        if kind == "delete" and i + 1 < len(found) and found[i + 1][0] == "insert":
            for old, new in zip(a[x : x + n], b[found[i + 1][2] : found[i + 1][2] + found[i + 1][3]], strict=False):
                short = len(old) <= LONGEST and len(new) <= LONGEST and budget > 0
                budget -= short
                counts["modified"] += not short or alike(spans(old, new), old, new)
    counts["deleted"] -= counts["modified"]
    counts["inserted"] -= counts["modified"]
    return rows, counts


def as_text(rows: Sequence[tuple[str, str]]) -> str:
    return "\n".join({"same": " ", "delete": "-", "insert": "+"}[kind] + line for kind, line in rows)
