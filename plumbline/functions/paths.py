"""Nested values as flat rows of dotted paths, and back. Small helpers for one document at a time."""

from __future__ import annotations

import json
import re
from typing import Any

MAX_DEPTH, MAX_INDEX = 64, 100_000


def escape_segment(key: str, of_object: bool = True) -> str:
    """Backslashes and dots get a backslash; so does a key of digits, which isn't a place in a list."""
    out = key.replace("\\", "\\\\").replace(".", "\\.")
    return "\\" + out if of_object and re.fullmatch(r"\d+", key) else out


def split_path(path: str) -> list[str | int]:
    """The segments of a path: text keys, and places in lists as numbers."""
    out: list[str | int] = []
    for raw in re.findall(r"(?:^|\.)((?:\\.|[^.\\]|\\$)*)", path, re.S):
        key = re.sub(r"\\(.)", r"\1", raw, flags=re.S)
        number = re.fullmatch(r"0|[1-9]\d*", raw)
        out.append(int(raw) if number and int(raw) <= MAX_INDEX else key)
    return out


_LONE = re.compile("[\ud800-\udfff]")


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is no JSON value")


def read_json(text: str) -> tuple[Any, tuple[int, int, str] | None, bool]:
    """The value of a JSON text, else its first fault (line, column, message); and whether something in it lay deeper than MAX_DEPTH, which becomes null.

    Halves of characters are replaced, so what comes out is text; names as NaN are faults.
    """
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except json.JSONDecodeError as e:
        return None, (e.lineno, e.colno, e.msg), False
    except RecursionError:
        return None, (1, 1, "nested too deeply"), False
    except ValueError as e:  # a number of more digits than Python reads, or a name
        return None, (1, 1, str(e).partition(";")[0]), False
    deep = []

    def whole(v: Any, depth: int) -> Any:
        if isinstance(v, str):
            return _LONE.sub("\ufffd", v)
        if not isinstance(v, dict | list):
            return v
        if depth >= MAX_DEPTH:
            deep.append(True)
            return None
        return {_LONE.sub("\ufffd", k): whole(x, depth + 1) for k, x in v.items()} if isinstance(v, dict) else [whole(x, depth + 1) for x in v]

    return whole(value, 0), None, bool(deep)


def flatten(value: Any, prefix: str = "", depth: int = 0) -> list[tuple[str, Any]]:
    """(path, leaf) in document order; empty objects and lists are leaves, as is what lies too deep."""
    if isinstance(value, dict) and value and depth < MAX_DEPTH:
        parts = [(escape_segment(k), v) for k, v in value.items()]
    elif isinstance(value, list) and value and depth < MAX_DEPTH:
        parts = [(str(i), v) for i, v in enumerate(value)]
    else:
        return [(prefix, value)]
    return [leaf for key, v in parts for leaf in flatten(v, f"{prefix}.{key}" if prefix or depth else key, depth + 1)]


def unflatten(cells: dict[str, Any]) -> Any:
    """Paths put together again. Where paths disagree, a list becomes an object and a leaf gives way."""
    root: dict = {}
    for path, value in cells.items():
        node = root
        segments = split_path(path)
        for here in segments[:-1]:
            child = node.get(here)
            if not isinstance(child, dict):
                child = node[here] = {}
            node = child
        node[segments[-1]] = value
    return _lists(root) if root else {}


def _lists(node: Any) -> Any:
    """Objects whose keys are the places 0, 1, … become lists."""
    if not isinstance(node, dict):
        return node
    if node and all(isinstance(k, int) for k in node) and sorted(node) == list(range(len(node))):
        return [_lists(node[i]) for i in range(len(node))]
    return {str(k): _lists(v) for k, v in node.items()}


def leaf_text(value: Any) -> str:
    """A leaf as a cell: null, true and false by name, whole floats without a point."""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def detect_format(text: str, extension: str = "") -> tuple[str, str]:
    """(json, csv, yaml or text; high, medium or low): what a text is, the extension breaking ties."""
    body = text.strip().removeprefix("﻿")
    if body[:1] + body[-1:] in ("{}", "[]"):
        if read_json(body)[1] is None:
            return "json", "high"
        if re.match(r"[{\[]\s*[\"{\[\]}\d]", body):
            return "json", "medium"
    lines = [x for x in body.split("\n")[:40] if x.strip()]
    for mark in (",", "\t", ";", "|"):
        widths = [x.count(mark) + 1 for x in lines[:25]]
        if len(widths) > 1 and max(widths) > 1:
            usual = max(set(widths), key=widths.count)
            if usual > 1 and widths.count(usual) >= 0.8 * len(widths):
                return "csv", "high" if len(set(widths)) == 1 else "medium"
    keyed = sum(bool(re.match(r"\s*(?:-\s|[\w\"' .-]+:(?:\s|$)|#|---)", x)) for x in lines)
    if lines and keyed >= 0.8 * len(lines):
        return "yaml", "medium"
    hints = {"json": "json", "csv": "csv", "tsv": "csv", "yaml": "yaml", "yml": "yaml"}
    return (hints[extension.lower()], "low") if extension.lower() in hints else ("text", "low")


def json_fault(text: str) -> tuple[int, int, str] | None:
    """Line, column (from 1) and message of the first fault of a JSON text; None if it has none."""
    return read_json(text)[1]


def fault_text(fault: tuple[int, int, str] | None) -> str:
    """A fault as a sentence's end: what, and where."""
    return "" if fault is None else f"{fault[2]} (line {fault[0]}, column {fault[1]})"


def ends_with_index(path: str) -> bool:
    """True if a path's last segment is a place in a list."""
    return isinstance(split_path(path)[-1], int)
