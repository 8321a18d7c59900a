"""The cleaner's steps on streams: scrubbing is stateless; duplicates are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as t


def scrub(stream: DataFrame, columns: list[str], sentinels=t.SENTINELS) -> DataFrame:
    """Texts scrubbed as the cleaner does; rows that end up blank go."""
    out = stream
    for step in (t.drop_invisible, t.collapse_spaces, t.flatten_newlines, t.js_trim, lambda c: t.blank_sentinels(c, sentinels)):
        out = out.withColumns({c: step(F.coalesce(F.col(c), F.lit(""))) for c in columns})
    return out.where(F.greatest(*[F.length(c) for c in columns], F.lit(0)) > 0)


def without_duplicates(stream: DataFrame, at: str, columns: list[str], delay: str = "1 hour") -> DataFrame:
    """The first of equal rows that come within the delay of one another; state older than that is forgotten."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(columns)


def tally(stream: DataFrame, at: str, column: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """start, value, count in each window of time."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, window), F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return counted.select(F.col("window.start").alias("start"), "value", "count")
