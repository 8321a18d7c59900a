"""Text wrapped to a width that its letters measure, by prefix sums of their widths."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (fixed values).
_SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_TOKEN = re.compile(f"[{_SPACES}]+|[^{_SPACES}]+")


def fitting(upto: np.ndarray, start: int, room: int) -> int:
    """How many letters from start on fit into a room, one at least; upto are the sums of the widths before each letter."""
    return max(1, int(np.searchsorted(upto, upto[start] + room, "right")) - 1 - start)


def wrap(text: str, room: int, widths: Mapping[str, int], other: int, most: int | None = None) -> list[str]:
    """The lines of a text: each as many words as fit, a word that is wider than the room cut where it must be; blank lines stay, line ends stay ends. most bounds the lines."""
    out: list[str] = []
    room = max(1, room)
    for part in text.split("\n"):
        upto = np.concatenate([[0], np.cumsum([widths.get(c, other) for c in part], dtype=np.int64)]) if part else np.zeros(1, np.int64)
        if upto[-1] <= room:
            out.append(part)
            continue
        start = 0
        for token in _TOKEN.finditer(part):
            a, b = token.span()
            if upto[b] - upto[start] <= room:
                continue
            if part[start:a].strip(_SPACES):
                out.append(part[start:a].rstrip(_SPACES))
            start = a if not token[0][0] in _SPACES else b
            while start < b and upto[b] - upto[start] > room:
                n = fitting(upto, start, room)
                out.append(part[start : start + n])
                start += n
        if part[start:].strip(_SPACES):
            out.append(part[start:].rstrip(_SPACES))
    return (out or [""])[:most]


def wrapped(text: Column, width: float, size: float, widths: Mapping[str, int], other: int = 500, most: int | None = None) -> Column:
    """The lines of a text set in a size (points) to a width (points); widths are those of letters in thousandths of the size, `other` of those not named. A null text is one blank line."""
    room = int(width * 1000 / size)

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wrap(t or "", room, widths, other, most))

    return lines(text)
