"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Bytes of a table's files that one task orders, some 200,000 line items.
PART = 4 << 20


def keyed(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table dealt by keys in parts of a few megabytes, so that a larger one makes more tasks, not larger ones."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(max(spark.sparkContext.defaultParallelism, -(-size // PART)), *keys)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dirtied(text: Column, key: Column) -> Column:
    """A text with odd spaces, invisible characters, placeholders and doubled spaces put in by its key."""
    padded = F.when(key % 3 == 0, F.concat(F.lit("  \t"), text, F.lit("  　"))).otherwise(text)
    hidden = F.when(key % 5 == 0, F.concat(F.lit("​"), F.replace(padded, F.lit(" the "), F.lit("  the­ "))))
    return F.when(key % 17 == 0, F.lit(" n/a ")).otherwise(F.coalesce(hidden, padded))


DIRTIED = (
    "CASE WHEN doc_id % 17 = 0 THEN ' n/a ' WHEN doc_id % 5 = 0 THEN chr(8203) || replace({p}, ' the ', '  the' || chr(173) || ' ') ELSE {p} END"
).format(p="(CASE WHEN doc_id % 3 = 0 THEN chr(160) || ' ' || chr(9) || text || '  ' || chr(12288) ELSE text END)")

S, L = t.SPACE, t.SPACE_IN_LINE


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {quote(f'^[{S}]+|[{S}]+$')}, '', 'g')"


def sql_scrub(x: str) -> str:
    """All scrub steps: invisible, collapse, flatten, trim, placeholders."""
    x = f"regexp_replace(regexp_replace({x}, {quote(t.INVISIBLE)}, '', 'g'), {quote(t.ODD_SPACE)}, ' ', 'g')"
    x = f"regexp_replace({x}, {quote(f'[{L}]+')}, ' ', 'g')"
    x = sql_trim("regexp_replace(" + x + ", " + quote(f"[{L}]*[\\r\\n][{S}]*") + ", ' ', 'g')")
    names = ", ".join(quote(s.lower()) for s in t.SENTINELS)
    return f"(SELECT CASE WHEN lower(v) IN ({names}) THEN '' ELSE v END FROM (SELECT {x} AS v))"
