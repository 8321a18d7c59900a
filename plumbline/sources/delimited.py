"""Delimited files of unknown encoding and separator, and writing them safely.

Sniffing reads the first 64 KiB of a file. `read_rows` lets Spark split large files and still numbers rows as they stand in the file
(`records`). `read_grid` parses whole small files, one task each, as those in UTF-16 must be; `read_large` lets Spark split a
file whose form is known, without places.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import needs_formula_escape
SNIFF = 64 * 1024
#: Marks at a file's start, encodings tried without one, separators tried.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Encodings tried without a mark, by how likely they are before any text is read; separators and their order.
PRIORS = {"utf-8": 1.0, "cp1252": 1.0, "iso-8859-15": 0.97, "cp1251": 0.95, "iso-8859-2": 0.93, "iso-8859-7": 0.93, "shift_jis": 0.9, "gb18030": 0.88, "big5": 0.85, "euc_kr": 0.85, "mac_roman": 0.7}
SEPARATORS = (",", ";", "\t", "|", "\x1f")
#: Scripts, their vowels, and the slots in which two Western encodings differ.
LATIN, CYRILLIC, GREEK, CJK = "\u00c0-\u024f\u1e00-\u1eff", "\u0400-\u04ff", "\u0370-\u03ff", "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff"
SLOTS = "\u00a4\u00a6\u00a8\u00b4\u00b8\u00bc\u00bd\u00be"
LATIN_VOWELS = "aeiouyAEIOUY\u00c0-\u00c6\u00c8-\u00cf\u00d2-\u00d6\u00d8-\u00dd\u00e0-\u00e6\u00e8-\u00ef\u00f2-\u00f6\u00f8-\u00fd\u00ff"
CYRILLIC_VOWELS, GREEK_VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ", "αεηιουωάέήίόύώϊϋΐΰΑΕΗΙΟΥΩΆΈΉΊΌΎΏ"


def sniff_encoding(head: bytes) -> tuple[str, int]:
    """An encoding, and the length of the mark before the text."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name, len(mark)
    pairs = min(len(head), 4096) // 2
    odd, even = head[1 : 2 * pairs : 2].count(0), head[0 : 2 * pairs : 2].count(0)
    if pairs >= 8 and odd + even >= 0.25 * 2 * pairs and max(odd, even) > 3 * min(odd, even):
        return ("utf-16-le" if odd > even else "utf-16-be"), 0
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "utf-8", 0
    except UnicodeDecodeError:
        return max((n for n in PRIORS if n != "utf-8"), key=lambda n: reading_score(decoded(head, n), PRIORS[n])), 0


#: The high characters of the Western code page; the bytes without one are controls, as browsers read them.
_HIGH = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0))


def decoded(data: bytes, encoding: str) -> str:
    return data.decode("latin-1").translate({0x80 + i: c for i, c in enumerate(_HIGH)}) if encoding == "cp1252" else data.decode(encoding, "replace")


def western_bytes(text: str, strict: bool = False) -> bytes:
    """The text in the Western code page; what it hasn't becomes a question mark, or raises ValueError."""
    table = {c: 0x80 + i for i, c in enumerate(_HIGH)}
    out = [table.get(c, ord(c) if ord(c) < 0x80 or 0xA0 <= ord(c) <= 0xFF else -1) for c in text]
    if strict and -1 in out:
        raise ValueError("not in the Western code page")
    return bytes(0x3F if b < 0 else b for b in out)


def undo_mojibake(text: str) -> str | None:
    """A text that was UTF-8 and read as Western, as it was meant; None if it wasn't."""
    try:
        repaired = western_bytes(text, strict=True).decode("utf-8")
    except ValueError:
        return None
    return None if repaired == text else repaired


def mojibake_examples(before: str, after: str, most: int = 3) -> list[tuple[str, str]]:
    """The first distinct words that a repair changes."""
    pairs = dict.fromkeys((a, b) for a, b in zip(before.split(), after.split(), strict=False) if a != b)
    return list(pairs)[:most]


def reading_score(text: str, prior: float) -> float:
    """How well a text reads: its prior less what is strange in it, as controls, signs within words, scripts side by side, too few vowels."""
    count = lambda pattern: len(regex.findall(pattern, text))
    high = f"[^\\x00-\\x9f{LATIN}{CYRILLIC}{GREEK}{CJK}\ufffd]"
    scripts = {s: count(f"[{s}]") for s in (LATIN, CYRILLIC, GREEK, CJK)}
    plain, most = count("[A-Za-z]"), max(scripts.values())
    letters, foreign = plain + sum(scripts.values()), sum(scripts.values())
    beside = f"(?:(?<=[A-Za-z])[{CYRILLIC}{GREEK}{CJK}]|[{CYRILLIC}{GREEK}{CJK}](?=[A-Za-z]))"
    signs = f"(?:(?<=\\p{{L}})(?=[\\p{{S}}\\p{{N}}]){high}|(?=[\\p{{S}}\\p{{N}}]){high}(?=\\p{{L}}))"
    if most and most == scripts[CYRILLIC]:
        n, vowels = most, count(f"[{CYRILLIC_VOWELS}]")
    elif most and most == scripts[GREEK]:
        n, vowels = most, count(f"[{GREEK_VOWELS}]")
    else:
        n, vowels = (0 if scripts[CJK] else plain + scripts[LATIN]), count(f"[{LATIN_VOWELS}]")
    size = max(len(text), 1)
    strange = (
        12 * count("\ufffd") / size + 10 * count("[\x80-\x9f]") / size + 10 * count(signs) / size + 10 * count(beside) / size + 12 * count(f"[{SLOTS}]") / size
        + 1.5 * max(0.0, (scripts[LATIN] / letters if letters else 0.0) - 0.35) / 0.65 + (1 - most / foreign if foreign else 0.0) + (6 * max(0.0, 0.22 - vowels / n) if n >= 12 else 0.0)
    )
    return prior * max(0.0, 1 - strange)


def sniff_separator(text: str) -> str:
    """The separator that cuts most lines into one number of cells, more than one."""
    said = re.match(r"sep=(.)\r?\n", text)
    if said:
        return said[1]
    lines = [x for x in text.splitlines()[:200] if x.strip()]

    def rank(mark: str) -> tuple[float, int]:
        widths = [len(row) for row in csv.reader(lines, delimiter=mark)]
        usual = max(set(widths), key=widths.count) if widths else 1
        return (widths.count(usual) / len(widths) if usual > 1 else 0.0, usual)

    return max(SEPARATORS, key=lambda m: (rank(m)[0] > 0.8, *rank(m)[::-1]))


def parse(data: bytes) -> tuple[list[list[str]], str, str]:
    """Rows of texts, encoding and separator of a file; an end of line at the end is no row."""
    encoding, skip = sniff_encoding(data[:SNIFF])
    text = decoded(data[skip:], encoding)
    mark = sniff_separator(text[:SNIFF])
    text = re.sub(r"\Asep=.\r?\n", "", text)
    rows = [row or [""] for row in csv.reader(io.StringIO(text, newline=""), delimiter=mark)]
    return rows, encoding, mark


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """path, _row, cells of each row of the files at a path, which may hold wildcards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = parse(data)[0]
                for start in range(0, len(rows), 10_000):
                    part = rows[start : start + 10_000]
                    yield pd.DataFrame({"path": name, "_row": range(start, start + len(part)), "cells": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, _row long, cells array<string>")


def report(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, separator, columns, rows, ragged rows of each file."""
    shape = T.StructType.fromDDL("encoding string, separator string, columns int, rows long, ragged long")

    @F.pandas_udf(shape)
    def told(contents: pd.Series) -> pd.DataFrame:
        out = []
        for data in contents:
            rows, encoding, mark = parse(data)
            width = max(map(len, rows), default=0)
            out.append((encoding, mark, width, len(rows), sum(len(r) != width for r in rows)))
        return pd.DataFrame(out, columns=shape.names)

    return spark.read.format("binaryFile").load(path).select("path", told("content").alias("r")).select("path", "r.*")


def widened(grid: DataFrame, width: int) -> DataFrame:
    """_row, c0 … of a grid: shorter rows are filled up with blanks."""
    return grid.select("_row", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)])


def read_large(spark: SparkSession, path: str, columns: list[str], separator: str = ",", encoding: str = "utf-8", multiline: bool = False) -> DataFrame:
    """All columns as texts, read in parallel; multiline files can't be split."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    read = spark.read.schema(schema).csv(path, header=True, sep=separator, encoding=encoding, multiLine=multiline, quote='"', escape='"')
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])  # a blank is a blank, not null


def read_rows(spark: SparkSession, path: str, width: int, separator: str | None = ",", folder: str | None = None, encoding: str | None = "utf-8") -> DataFrame:
    """path, _row, c0 …, more of files that Spark splits: missing cells are blank, those beyond the width are in `more`. See `records.read_records`."""
    from plumbline.sources.records import read_records

    rows = read_records(spark, path, separator, encoding, folder=folder)
    beyond = F.slice("cells", width + 1, F.greatest(F.lit(0), F.size("cells") - width))
    return rows.select("path", "_row", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)], beyond.alias("more"))


def formula_safe(c: Column) -> Column:
    """Texts that a spreadsheet would run get an apostrophe before them."""
    return F.when(needs_formula_escape(c), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(rows: DataFrame, path: str, separator: str = ",", escape_formulas: bool = True) -> None:
    """One folder of files, each with a header, quotes doubled."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    out = rows.withColumns({c: formula_safe(F.col(c)) for c in texts}) if escape_formulas and texts else rows
    out.write.csv(path, header=True, sep=separator, quote='"', escape='"', emptyValue="")


def write_json(rows: DataFrame, path: str, keep_null: bool = True) -> None:
    """One JSON object a line."""
    rows.write.json(path, ignoreNullFields=not keep_null)
