"""Texts with those letters only that the Western code page can draw: others by a plain stand-in, or left out, and an account of both."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The printable characters of the code page from 0x80 to 0x9F.
HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Letters that have no accent to take off.
LETTERS = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŀ": "l", "Ŀ": "L", "ŉ": "n", "ŧ": "t", "Ŧ": "T", "ſ": "s", "ȷ": "j", "ŋ": "ng", "Ŋ": "NG", "ĳ": "ij", "Ĳ": "IJ"}
#: Signs and spaces with a plain stand-in; of these, spaces and hyphens that nobody needs to be told of.
SIGNS = {
    " ": " ", " ": " ", " ": " ", " ": " ", "​": "", "﻿": "", "‐": "-", "‑": "-", "‒": "-", "―": "-", "−": "-", "⁃": "-", "′": "'", "″": '"', "‵": "'", "‶": '"', "ʼ": "'", "⁄": "/", "∕": "/", "∖": "\\",
    "․": ".", "‥": "..", "‧": ".", "∙": "·", "●": "·", "▪": "·", "■": "·", "○": "o", "◦": "o", "‣": ">", "→": "->", "←": "<-", "↔": "<->", "⇒": "=>", "⇔": "<=>", "≠": "!=", "≤": "<=", "≥": ">=", "≈": "~", "✓": "v", "✔": "v", "✗": "x", "✘": "x", "★": "*", "☆": "*",
    "₹": "Rs.", "₽": "RUB", "₩": "KRW", "₦": "NGN", "₺": "TRY", "℠": "(SM)", "℗": "(P)", "Ω": "Ohm",
}
SILENT = frozenset("    ​﻿‐‑")
#: Names of scripts by their first and last code points; the first that fits.
SCRIPTS = (
    (0x0400, 0x052F, "Cyrillic"), (0x0370, 0x03FF, "Greek"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x0DFF, "an Indian script"), (0x0E00, 0x0E7F, "Thai"), (0x3040, 0x30FF, "Japanese"),
    (0x1100, 0x11FF, "Korean"), (0xAC00, 0xD7AF, "Korean"), (0x3400, 0x9FFF, "Chinese, Japanese or Korean"), (0x1F000, 0x10FFFF, "emoji"), (0x0100, 0x024F, "accented Latin"),
)
_ODD = re.compile(f"[^ -~\xa1-\xff{re.escape(HIGH)}]")


def script_of(char: str) -> str:
    return next((name for low, high, name in SCRIPTS if low <= ord(char) <= high), "symbols")


def bare(char: str) -> str | None:
    """A letter without its accents, if that can be drawn."""
    plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c)[0] != "M")
    return plain if plain and plain != char and not _ODD.search(plain) else None


class _StandIns(dict):
    """By code point, for str.translate; each is found once."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = char if not _ODD.match(char) else SIGNS.get(char, LETTERS.get(char)) if char in SIGNS or char in LETTERS else bare(char) or ""
        return self[code]


_STAND_INS = _StandIns()


def fold(text: str) -> tuple[str, int, int, list[str]]:
    """The text, how many letters got a stand-in, how many were left out, and of which scripts those were, the commonest first."""
    odd = _ODD.findall(text)
    if not odd:
        return text, 0, 0, []
    known = [c in SIGNS or c in LETTERS or bare(c) is not None for c in odd]
    gone = Counter(script_of(c) for c, k in zip(odd, known, strict=True) if not k)
    return text.translate(_STAND_INS), sum(k and c not in SILENT for c, k in zip(odd, known, strict=True)), sum(gone.values()), [s for s, _ in gone.most_common()]


def folded(text: Column) -> Column:
    """text, simplified, dropped and scripts of a text (see `fold`); a null text is the empty one."""

    @F.pandas_udf("text string, simplified long, dropped long, scripts array<string>")
    def made(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fold(t or "") for t in texts], columns=["text", "simplified", "dropped", "scripts"])

    return made(text)


def folding(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """by, simplified, dropped, texts (with either) over all rows, where column is what `folded` made."""
    f = lambda name: F.col(f"{column}.{name}")
    return rows.groupBy(*by).agg(F.sum(f("simplified")).alias("simplified"), F.sum(f("dropped")).alias("dropped"), F.count_if((f("simplified") > 0) | (f("dropped") > 0)).alias("texts"))
