"""Title and sentence case: word-wise rewriting, in Python on Arrow batches.

SQL's higher-order functions can say this, but run it interpreted, many times slower.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import SMALL_WORDS
from plumbline.session import small_batches

_WORD = regex.compile(r"[\p{L}\p{N}_'’]+")
_LINE_END = regex.compile(r"(\r\n|\n|\r)")
_SENTENCE = regex.compile(r"([.!?…][\"'’”)\]]*\s+)")
_IDENTIFIER = regex.compile(r"_|[\p{Ll}\p{N}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}")
_ACRONYM, _CAMEL, _OTHER = regex.compile(r"(\p{Lu}|\p{N})(\p{Lu}\p{Ll})"), regex.compile(r"(\p{Ll}|\p{N})(\p{Lu})"), regex.compile(r"[^\p{L}\p{N}]+")
_LETTER = regex.compile(r"\p{L}")
_SMALL = frozenset(SMALL_WORDS)


def _expanded(word: str) -> list[str]:
    if not _IDENTIFIER.search(word):
        return [word]
    parts = [p for p in _OTHER.split(_CAMEL.sub(r"\1 \2", _ACRONYM.sub(r"\1 \2", word))) if p]
    return parts or [word]


def _capital(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def _by_line(text: str, change: Callable[[str], str]) -> str:
    return "".join(part if i % 2 else change(part) for i, part in enumerate(_LINE_END.split(text)))


def _title_line(line: str) -> str:
    found = [(m.start(), m.end(), _expanded(m[0])) for m in _WORD.finditer(line)]
    last = sum(len(parts) for _, _, parts in found) - 1
    out, at, n = [], 0, 0
    for start, end, parts in found:
        made = []
        for word in parts:
            low = word.lower()
            made.append(low if 0 < n < last and low in _SMALL else _capital(word))
            n += 1
        out += [line[at:start], " ".join(made)]
        at = end
    return "".join([*out, line[at:]])


def _sentence_line(line: str) -> str:
    low = _WORD.sub(lambda m: " ".join(_expanded(m[0])).lower(), line)

    def first_up(part: str) -> str:
        m = _LETTER.search(part)
        return part if m is None else part[: m.start()] + m[0].upper() + part[m.end() :]

    return "".join(part if i % 2 else first_up(part) for i, part in enumerate(_SENTENCE.split(low)))


def _titled(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _by_line(t, _title_line))


def _sentenced(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _by_line(t, _sentence_line))


def _batched(function: Callable[[pd.Series], pd.Series], c: Column) -> Column:
    """function on batches of few texts, as each is held several times over; made where it is used, as making it needs a session."""
    small_batches(SparkSession.active())
    return F.pandas_udf(function, "string")(c)


def title_case(c: Column) -> Column:
    """Words capitalised, small words kept small but at a line's edges; punctuation and spacing stay."""
    return _batched(_titled, c)


def sentence_case(c: Column) -> Column:
    """Lower case, but for the first letter of each line and after . ! ? and an ellipsis."""
    return _batched(_sentenced, c)
