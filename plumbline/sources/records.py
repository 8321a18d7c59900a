"""Records of delimited files that Spark splits, with nothing lost: quoted values may hold separators and line ends, rows any number of cells.

A line alone doesn't tell whether it begins inside a quoted value. So each task reads its block under both suppositions, that the block begins outside and inside one, and
notes for every line the state before and after it and the count of records so far. Where each block begins then follows from the ends of the blocks before it, a row a block.
Lines that are a record of their own, nearly all, stay where they were read; only lines of longer records are gathered by their record.

Quotes count at the start of a value only; such a value ends at a quote before a separator or the end of a line, spaces aside; two quotes stand for one. Blank lines are records of one
blank cell, the line end at the end of a file begins none. Encoding and separator, if not given, are told from the first 64 KiB of each file; a mark at its start and a line `sep=;` are taken off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import scratch, settled
from plumbline.sources.delimited import SNIFF, decoded, sniff_encoding, sniff_separator

#: Files at most whose form is told apart; for more, name the form. A line `sep=;` before the records.
FILES, SAID = 20_000, re.compile(r"sep=(.)\r?", re.IGNORECASE)
#: Bytes of text that are worth a task.
TASK = 16 << 20


@cache
def _close(mark: str) -> re.Pattern:
    """From inside a quoted value on: its end, the quote included."""
    return re.compile(rf'(?:[^"]|""|"(?! *(?:{re.escape(mark)}|\r?\Z)))*+"')


def ends_inside(line: str, mark: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line, by whether one was at its start."""
    if '"' not in line:
        return inside
    at, close = 0, _close(mark)
    while True:
        if inside:
            found = close.match(line, at)
            if not found:
                return True
            at = found.end()
        at = line.find(mark, at) if inside or not line.startswith('"', at) else at
        if at < 0:
            return False
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
            continue
        inside, at = False, at + len(mark)


def cells(record: str, mark: str) -> tuple[list[str], bool]:
    """The values of a record, and whether its last one is a quoted one that never ends."""
    record = record.removesuffix("\r")
    if '"' not in record:
        return record.split(mark), False
    out, at, close = [], 0, _close(mark)
    while True:
        if record.startswith('"', at):
            found = close.match(record, at + 1)
            if not found:
                return [*out, record[at + 1 :].replace('""', '"')], True
            out.append(record[at + 1 : found.end() - 1].replace('""', '"'))
            at = record.find(mark, found.end())
        else:
            end = record.find(mark, at)
            out.append(record[at:] if end < 0 else record[at:end])
            at = end
        if at < 0:
            return out, False
        at += len(mark)


def _forms(raw: DataFrame) -> dict[str, tuple[str, str]]:
    """Encoding and separator by file, from the lines at its start."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, bytearray] = {}
        for batch in batches:
            for path, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block == 0 and len(head := found.setdefault(path, bytearray())) < SNIFF:
                    head += value[:SNIFF] + b"\n"
        told = []
        for path, head in found.items():
            encoding, skip = sniff_encoding(bytes(head[:SNIFF]))
            told.append((path, encoding, sniff_separator(decoded(bytes(head[skip:SNIFF]), encoding))))
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], pa.string()) for k in range(3)], names=["path", "encoding", "separator"])

    rows = raw.where("_block = 0").mapInArrow(heads, "path string, encoding string, separator string").limit(FILES + 1).collect()
    if len(rows) > FILES:
        raise ValueError(f"more than {FILES} files: name their encoding and separator")
    return {r["path"]: (r["encoding"], r["separator"]) for r in rows}


def read_records(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None, line_end: str = "\n", folder: str | None = None) -> DataFrame:
    """path, _row (from 0, as records stand in the file), cells, unclosed (a quoted value never ends), swallowed (line ends that such a value took in) of each record.

    Files in UTF-16 and UTF-32 can't be split by lines: `read_grid` reads those whole. The value of an unclosed record holds the rest of its file.
    """
    folder = folder or scratch(spark)
    text = spark.read.option("lineSep", line_end).text(path)
    # Blocks may be much smaller than what is worth a task or a file of its own; a task reads several, each from its own start.
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // TASK))
    raw = text.coalesce(tasks).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").cast("binary").alias("_b"))
    forms = None if separator and encoding else _forms(raw)
    if any(e.startswith(("utf-16", "utf-32")) for e in ([encoding] if forms is None else [f[0] for f in forms.values()])):
        raise ValueError("files of wide characters can't be split by lines: use read_grid")
    shared = spark.sparkContext.broadcast(forms)  # a row a file, FILES at most

    def form(name: str) -> tuple[str, str]:
        own = (shared.value or {}).get(name, ("utf-8", ","))
        return encoding or own[0], separator or own[1]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each line the states before and after it (1: inside a quoted value), and how many records began up to it, if its block begins outside (0) or inside (1) one."""
        here, nth, states, counts, how = None, 0, (False, True), (0, 0), ("utf-8", ",")
        for batch in batches:
            out = []
            for name, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if here != (name, block):
                    here, nth, states, counts, how = (name, block), 0, (False, True), (0, 0), form(name)
                if block == 0 and nth == 0 and not counts[0]:
                    value = value[sniff_encoding(value[:4] + b"\n")[1] :] if how[0] == "utf-8" else value
                line = decoded(value, how[0])
                if block == 0 and nth == 0 and SAID.fullmatch(line):
                    continue
                counts = tuple(n + (not s) for n, s in zip(counts, states, strict=True))
                after = states if '"' not in line else (ends_inside(line, how[1], states[0]), ends_inside(line, how[1], states[1]))
                out.append((name, block, nth, line, states[0], states[1], after[0], after[1], *counts))
                nth, states = nth + 1, after
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    shape = "path string, _block long, _nth long, _line string, _in0 boolean, _in1 boolean, _out0 boolean, _out1 boolean, _r0 long, _r1 long"
    names = [x.split()[0] for x in shape.split(", ")]
    lines = settled(raw.mapInArrow(told, shape), folder, "lines")
    last = F.max_by(F.struct("_out0", "_out1", "_r0", "_r1"), "_nth").alias("_last")
    blocks = settled(lines.coalesce(tasks).groupBy("path", "_block").agg(last).select("path", "_block", "_last.*"), folder, "blocks")  # a row a block
    order = Window.partitionBy("path").orderBy("_block")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # A block whose end is the same either way settles the state; one whose end differs as its start does keeps it or, if turned round, flips it.
    fixed, flips = F.col("_out0") == F.col("_out1"), (F.col("_out0") & ~F.col("_out1")).cast("int")
    flipped = blocks.withColumn("_flips", F.sum(flips).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    settled_at = F.last(F.when(fixed, F.struct(F.col("_out0").alias("s"), F.col("_flips").alias("f"))), ignorenulls=True).over(upto)
    flips_before = F.coalesce(F.sum(flips).over(upto), F.lit(0))
    state = (F.coalesce(settled_at["s"].cast("int"), F.lit(0)) + flips_before - F.coalesce(settled_at["f"], F.lit(0))) % 2 == 1
    begun = flipped.withColumn("_inside", state).withColumn("_count", F.when(F.col("_inside"), F.col("_r1")).otherwise(F.col("_r0")))
    begun = begun.withColumn("_before", F.coalesce(F.sum("_count").over(upto), F.lit(0))).select("path", "_block", "_inside", "_before")
    pick = lambda name: F.when(F.col("_inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = lines.join(begun, ["path", "_block"]).select("path", "_block", "_nth", "_line", (F.col("_before") + pick("_r") - 1).alias("_row"), pick("_in").alias("_in"), pick("_out").alias("_out"))
    alone = placed.where(~F.col("_in") & ~F.col("_out")).select("path", "_row", F.col("_line").alias("_text"))
    longer = placed.where(F.col("_in") | F.col("_out")).groupBy("path", "_row").agg(F.array_sort(F.collect_list(F.struct("_block", "_nth", "_line"))).alias("_l"))
    joined = longer.select("path", "_row", F.array_join(F.transform("_l", lambda x: x["_line"]), line_end).alias("_text"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells(text, form(name)[1]) for name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            lost = [sum(c.count("\n") for c in row) if still else 0 for row, still in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found]), pa.array(lost, pa.int64())], names=["path", "_row", "cells", "unclosed", "swallowed"])

    return alone.unionByName(joined).mapInArrow(parsed, "path string, _row long, cells array<string>, unclosed boolean, swallowed long")


def without_blank_end(records: DataFrame) -> DataFrame:
    """records without the rows of blank cells at the end of each file."""
    filled = F.exists("cells", lambda c: F.trim(c) != "")
    last = records.where(filled).groupBy("path").agg(F.max("_row").alias("_last"))
    return records.join(last, "path").where(F.col("_row") <= F.col("_last")).drop("_last")


def ragged(records: DataFrame) -> DataFrame:
    """path, columns, rows, ragged (rows of fewer cells than the widest), unclosed, swallowed of each file."""
    sizes = records.groupBy("path", F.size("cells").alias("_w")).agg(F.count("*").alias("_n"), F.count_if("unclosed").alias("_u"), F.sum("swallowed").alias("_s"))  # a row a width
    widest = F.max("_w").over(Window.partitionBy("path"))
    return sizes.withColumn("_widest", widest).groupBy("path").agg(
        F.max("_widest").alias("columns"), F.sum("_n").alias("rows"), F.sum(F.when(F.col("_w") < F.col("_widest"), F.col("_n")).otherwise(0)).alias("ragged"), F.sum("_u").alias("unclosed"), F.sum("_s").alias("swallowed"),
    )
