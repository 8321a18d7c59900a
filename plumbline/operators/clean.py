"""The cleaner: one declarative pass over a table of texts that says what happened to each row and cell.

Rows come as `_row` (their place in the file, from the source) and text columns. The table is read and
scrubbed once, into a settled table with each cell's value, its text before where that differs, the steps that changed it and what it
says if read as a date; and rows that repeat earlier ones, found by digests, into another. Rows, removals, changes and counters are
derived from these two. Only the options and the votes on date columns, one row a column, are known to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import dates
from plumbline.functions import text as t
from plumbline.operators import headers, sequences, tally
from plumbline.session import scratch, settled

ROW = "_row"


@dataclass(frozen=True)
class CleanOptions:
    """What to do. Column decisions are keyed by the column's name in the input."""

    header_row: int | None = 0
    footer_rows: Sequence[int] = ()
    dedupe: bool = True
    remove_blank_rows: bool = True
    remove_blank_columns: bool = True
    index_column: str | None = None
    trim: bool = True
    collapse_spaces: bool = False
    flatten_newlines: bool = False
    remove_invisible: bool = False
    blank_sentinels: bool = False
    sentinels: Sequence[str] = t.SENTINELS
    column_sentinels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    standardise_headers: bool = True
    lowercase_headers: bool = False
    snake_case_headers: bool = False
    normalise_dates: bool = True
    date_style: str = "iso"
    #: dmy, mdy or skip
    date_columns: Mapping[str, str] = field(default_factory=dict)
    merges: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Cleaned:
    #: _row and the kept columns under their new names
    rows: DataFrame
    #: _row, reason, duplicate_of
    removed: DataFrame
    #: _row, column, before, after, reasons
    changes: DataFrame
    #: one row of counters
    stats: DataFrame
    names: dict[str, str]
    date_orders: dict[str, str]
    #: _row and the kept columns of all rows but preamble, header and footer, removed or not
    every: DataFrame


def scrub_steps(column: str, o: CleanOptions) -> list[tuple[str, object]]:
    """The steps that the options ask of a column, by reason, in their fixed order."""
    steps: list[tuple[str, object]] = []
    if o.remove_invisible:
        steps.append(("invisible", t.drop_invisible))
    if o.collapse_spaces:
        steps.append(("collapsed", t.collapse_spaces))
    if o.flatten_newlines:
        steps.append(("flattened", t.flatten_newlines))
    if o.trim:
        steps.append(("trimmed", t.js_trim))
    if o.blank_sentinels:
        words = o.column_sentinels.get(column, o.sentinels)
        steps.append(("sentinel", lambda c: t.blank_sentinels(c, words)))
    if o.merges.get(column):
        steps.append(("merged", lambda c: t.merge_spellings(c, dict(o.merges[column]))))
    return steps


def scrubbed(rows: DataFrame, columns: list[str], o: CleanOptions, kept: Sequence[str] = ()) -> DataFrame:
    """rows with each column as (value, reasons, before): before is its text where a step changed it. Columns to keep come along.

    Each step is a projection of its own over the texts before it, as an expression that
    holds the step before it twice would double with each step.
    """
    out = rows.select(ROW, *kept, *[F.coalesce(F.col(c), F.lit("")).alias(f"_raw_{i}") for i, c in enumerate(columns)])
    last = [f"_raw_{i}" for i in range(len(columns))]
    seen: list[list[tuple[str, str, str]]] = [[] for _ in columns]
    steps = [scrub_steps(c, o) for c in columns]
    for k in range(max(map(len, steps), default=0)):
        made = {}
        for i in range(len(columns)):
            if k < len(steps[i]):
                reason, step = steps[i][k]
                name = f"_step_{k}_{i}"
                made[name] = step(F.col(last[i]))
                seen[i].append((reason, last[i], name))
                last[i] = name
        out = out.withColumns(made)
    none = F.expr("cast(array() as array<string>)")
    cells = [
        F.struct(
            F.col(last[i]).alias("value"),
            (F.array_compact(F.array(*[F.when(F.col(after) != F.col(before), F.lit(reason)) for reason, before, after in seen[i]])) if seen[i] else none).alias("reasons"),
            F.when(F.col(last[i]) != F.col(f"_raw_{i}"), F.col(f"_raw_{i}")).alias("before"),
        ).alias(c)
        for i, c in enumerate(columns)
    ]
    return out.select(ROW, *kept, *cells)


def _votes(said: DataFrame) -> DataFrame:
    """Votes over rows of name and i, an inspected value: see date_votes."""
    voted = lambda order: F.count_if(F.coalesce(F.col("i.order") == order, F.lit(False)))
    votes = said.groupBy("name").agg(
        F.count("i").alias("values"), F.count_if(F.col("i.kind") != "not-a-date").alias("dates"), voted("dmy").alias("dmy"), voted("mdy").alias("mdy"),
        F.count_if(F.col("i.kind") == "ambiguous").alias("ambiguous"),
    )
    dated = F.col("dates") >= 0.7 * F.col("values")
    order = F.when((F.col("dmy") > 0) & (F.col("mdy") == 0), "dmy").when((F.col("mdy") > 0) & (F.col("dmy") == 0), "mdy")
    ask = (F.col("dmy") > 0) & (F.col("mdy") > 0) | ((F.col("dmy") + F.col("mdy") == 0) & (F.col("ambiguous") > 0))
    return votes.withColumn("status", F.when(~dated, "not-dates").when(ask, "ask").otherwise("auto")).withColumn("order", F.when(dated & ~ask, order))


def date_votes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, values, dates, dmy, mdy, ambiguous, status, order of each column.

    A column whose values are dates by 70 % at least is one of dates. Its order is the one that unambiguous
    dates vote for; if they disagree, or none votes and some are ambiguous, someone has to be asked.
    """
    long = tally.cells(rows, ROW, columns).where(~t.is_blank(F.coalesce("value", F.lit(""))))
    return _votes(long.select("name", dates.inspect(F.col("value")).alias("i")))


def clean(rows: DataFrame, options: CleanOptions | None = None, folder: str | None = None) -> Cleaned:
    """rows: _row and text columns, the header still among the rows if options.header_row says so."""
    o = options or CleanOptions()
    folder = folder or scratch(rows.sparkSession)
    columns = [c for c in rows.columns if c != ROW]
    header = [""] * len(columns)
    if o.header_row is not None:
        found = rows.where(F.col(ROW) == o.header_row).select(*columns).first()  # one row
        header = [x or "" for x in found] if found else header
    above = F.lit(False) if o.header_row is None else F.col(ROW) < o.header_row
    at_header = F.lit(False) if o.header_row is None else F.col(ROW) == o.header_row
    footer = F.col(ROW).isin(list(o.footer_rows)) if o.footer_rows else F.lit(False)
    outside = F.when(above, "preamble").when(at_header, "header").when(footer, "footer")

    # One pass over the input. A column without any value changes no verdict on rows, so those are reached here already.
    auto = [c for c in columns if c not in o.date_columns] if o.normalise_dates else []
    asked = {c: d for c, d in o.date_columns.items() if d != "skip"} if o.normalise_dates else {}
    filled = lambda cs: reduce(lambda a, b: a | b, [F.col(c)["value"] != "" for c in cs], F.lit(False))
    blank = ~filled([c for c in columns if c != o.index_column])
    reason = F.when(blank & filled(columns), "index-only").when(blank, "blank") if o.remove_blank_rows else F.lit(None).cast("string")
    said = {c: F.when(F.col(c)["value"] != "", dates.inspect(F.col(c)["value"])) for c in [*auto, *asked]}
    tidy = settled(
        scrubbed(rows.withColumn("_outside", outside), columns, o, ["_outside"]).select(
            ROW, F.coalesce("_outside", reason).alias("_reason"), F.col("_outside").isNull().alias("_body"), *columns, *[x.alias(f"_said_{columns.index(c)}") for c, x in said.items()],
        ),
        folder, "scrubbed",
    )
    body = tidy.where("_body")
    orders: dict[str, str] = dict(asked)
    if auto:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_said_{columns.index(c)}").alias("i")) for c in auto]))
        voted = _votes(body.select(cells.alias("cell")).select("cell.*").where("i is not null"))
        orders |= {r["name"]: r["order"] or "dmy" for r in voted.where("status = 'auto'").collect()}  # one row a column

    def dated(c: str) -> Column:
        cell = F.col(c)
        if c not in orders:
            return cell.alias(c)
        made = F.coalesce(dates.written(F.col(f"_said_{columns.index(c)}"), orders[c], o.date_style), cell["value"])
        changed = made != cell["value"]
        return F.struct(
            made.alias("value"), F.when(changed, F.array_append(cell["reasons"], F.lit("date"))).otherwise(cell["reasons"]).alias("reasons"),
            F.when(changed, F.coalesce(cell["before"], cell["value"])).otherwise(cell["before"]).alias("before"),
        ).alias(c)

    kept_columns = columns
    nameless = [c for c, name in zip(columns, header, strict=True) if t_blank(name)] if o.header_row is not None else []
    if o.remove_blank_columns and nameless:
        used = body.agg(*[F.max((F.col(c)["value"] != "").cast("int")).alias(f"u{i}") for i, c in enumerate(nameless)]).first()
        kept_columns = [c for c in columns if c not in nameless or used[f"u{nameless.index(c)}"]]
    full = tidy.where("_reason is null").select(ROW, *[dated(c) for c in kept_columns])
    values = full.select(ROW, *[F.col(c)["value"].alias(f"_v{i}") for i, c in enumerate(kept_columns)])
    twins = sequences.duplicates(values, ROW, sequences.row_digest([f"_v{i}" for i in range(len(kept_columns))]))
    twins = settled(twins if o.dedupe else twins.limit(0), folder, "duplicates")
    named = headers.standardise([header[columns.index(c)] for c in kept_columns], o.standardise_headers, o.lowercase_headers, o.snake_case_headers) if o.header_row is not None else headers.Headers(kept_columns)
    names = dict(zip(kept_columns, named.names, strict=True)) if o.header_row is not None else {c: c for c in kept_columns}
    stays = full.join(twins, ROW, "left_anti")
    out = stays.select(ROW, *[F.col(c)["value"].alias(names[c]) for c in kept_columns])
    gone = tidy.where("_reason is not null").select(ROW, F.col("_reason").alias("reason"), F.lit(None).cast("long").alias("duplicate_of"))
    removed = gone.unionByName(twins.select(ROW, F.lit("duplicate").alias("reason"), F.col("duplicate_of").cast("long").alias("duplicate_of")))
    changed = F.filter(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["before"].alias("before"), F.col(c)["value"].alias("after"), F.col(c)["reasons"].alias("reasons")) for c in kept_columns]),
        lambda x: x["before"].isNotNull(),
    )
    changes = stays.select(ROW, F.explode(changed).alias("c")).select(ROW, "c.*").where("before <> after")
    stats = _stats(tidy, body, twins, changes, kept_columns, named, orders)
    every = body.select(ROW, *[dated(c) for c in kept_columns]).select(ROW, *[F.col(c)["value"].alias(names[c]) for c in kept_columns])
    return Cleaned(out, removed, changes, stats, names, orders, every)


#: What a row was removed for that it can be taken back from.
RESCUABLE = ("blank", "index-only", "duplicate")


def rescued(cleaned: Cleaned, wanted: DataFrame) -> Cleaned:
    """cleaned with some removed rows (_row) taken back, if their reason allows it."""
    back = cleaned.removed.where(F.col("reason").isin(*RESCUABLE)).join(wanted.select(ROW), ROW, "left_semi").select(ROW)
    rows = cleaned.rows.unionByName(cleaned.every.join(back, ROW, "left_semi"))
    return replace(cleaned, rows=rows, removed=cleaned.removed.join(back, ROW, "left_anti"))


def changed_nothing(stats: DataFrame) -> DataFrame:
    """unchanged: true if no counter of the stats tells of a change."""
    told = [c for c in stats.columns if c not in ("source_rows", "rows_after", "header_rows", "date_columns")]
    return stats.select(reduce(lambda a, b: a & b, [F.col(c) == 0 for c in told]).alias("unchanged"))


def t_blank(name: str) -> bool:
    return not name.strip(" \t\r\n ﻿")


def _stats(tidy, body, twins, changes, columns, named, orders) -> DataFrame:
    """One row of counters. Cells are counted before duplicates and blank rows go, dates and changed rows after."""
    rows = tidy.agg(F.count(ROW).alias("source_rows"), *[F.count_if(F.coalesce(F.col("_reason") == r, F.lit(False))).alias(r.replace("-", "_") + "_rows") for r in ("preamble", "header", "footer", "blank", "index-only")])
    counted = body.agg(*[
        reduce(lambda a, b: a + b, [F.count_if(F.array_contains(F.col(c)["reasons"], r)) for c in columns]).alias(f"{r}_cells")
        for r in ("invisible", "collapsed", "flattened", "trimmed", "sentinel", "merged")
    ])
    after = changes.agg(F.count_if(F.array_contains("reasons", "date")).alias("date_cells"), F.count_distinct(ROW).alias("changed_rows"))
    one = rows.crossJoin(twins.agg(F.count(ROW).alias("duplicate_rows"))).crossJoin(counted).crossJoin(after)  # four single rows
    return one.withColumn("rows_after", F.col("source_rows") - sum((F.col(f"{r}_rows") for r in ("header", "footer", "blank", "index_only", "duplicate")), F.col("preamble_rows"))).select(
        "*", F.lit(len(orders)).alias("date_columns"), F.lit(named.renamed).alias("renamed_headers"), F.lit(named.deduped).alias("deduped_headers"), F.lit(named.named_blank).alias("named_blank_headers"),
    )
