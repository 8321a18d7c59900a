"""Header names: tidied, kept apart, made unique. A header is one row, so this is plain Python."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass

_SPACE = "\\s﻿"


@dataclass(frozen=True)
class Headers:
    names: list[str]
    renamed: int = 0
    deduped: int = 0
    named_blank: int = 0
    kept_distinct: int = 0


def _is(c: str, *groups: str) -> bool:
    return unicodedata.category(c).startswith(groups)


def strip_special(name: str) -> str:
    """Runs of punctuation become one space; units (currency, %, °) stay."""
    out, gap = [], False
    for c in name:
        if _is(c, "L", "N", "Sc") or c in "%° _-":
            out.append(c)
            gap = False
        elif not gap:
            out.append(" ")
            gap = True
    return "".join(out)


def snake(name: str) -> str:
    """first_name from firstName, http_server from HTTPServer."""
    parts = []
    for i, c in enumerate(name):
        before, after = name[i - 1 : i], name[i + 1 : i + 2]
        if before and _is(c, "Lu") and (_is(before, "Ll", "N") or _is(before, "Lu") and after and _is(after, "Ll")):
            parts.append(" ")
        parts.append(c)
    words = re.split(rf"[{_SPACE}_-]+", "".join(parts))
    return "_".join(w for w in words if w).lower()


def essence(name: str) -> str:
    return re.sub(rf"[{_SPACE}_-]+", "", name.removeprefix("﻿").lower())


def same_names(names: list[str]) -> list[list[str]]:
    """Groups of names that differ in case, spaces, underscores and hyphens only; blank ones never clash."""
    groups: dict[str, list[str]] = defaultdict(list)
    for name in names:
        if _trimmed(name):
            groups[essence(_trimmed(name))].append(_trimmed(name))
    return [g for g in groups.values() if len(g) > 1]


def _trimmed(name: str) -> str:
    return re.sub(rf"^[{_SPACE}]+|[{_SPACE}]+$", "", name)


def standardise(names: list[str], tidy: bool = True, lower: bool = False, snake_case: bool = False) -> Headers:
    """Names for the columns, in order.

    Blank names become 'Column N'. A tidied name that would make two different headers one is
    given up: both keep their own text. What is then still equal, and not already so in the file,
    gets _2, _3, …, but never a name that another column has.
    """

    def clean(name: str) -> str:
        out = _trimmed(name.removeprefix("﻿"))
        if tidy:
            out = _trimmed(re.sub(rf"[{_SPACE}]+", " ", strip_special(out)))
        return snake(out) if snake_case else out.lower() if lower else out

    def unnamed(place: int) -> str:
        name = f"column_{place + 1}" if snake_case else f"Column {place + 1}"
        return name.lower() if lower else name

    touching = tidy or lower or snake_case
    sources = defaultdict(set)
    for name in names:
        if touching and clean(name):
            sources[clean(name)].add(essence(name))
    clashing = {name for name, found in sources.items() if len(found) > 1}
    blank = [_trimmed(n) == "" for n in names]
    bases = [(unnamed(i) if blank[i] else clean(n) if touching else n) or unnamed(i) for i, n in enumerate(names)]
    reserved, taken, out = set(bases), set(), []
    renamed = deduped = kept = 0
    for i, name in enumerate(names):
        base = bases[i]
        if not blank[i] and touching and base in clashing:
            base = _trimmed(name)
            kept += 1
        final, n = base, 2
        if base in taken and (touching or blank[i]):
            while (final := f"{base}_{n}") in taken or final in reserved:
                n += 1
            deduped += 1
        taken.add(final)
        renamed += not blank[i] and base != name
        out.append(final)
    return Headers(out, renamed, deduped, sum(blank), kept)
