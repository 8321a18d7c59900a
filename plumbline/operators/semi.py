"""Semi-structured columns: JSON to rows of paths, to tables, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import paths


#: Columns of a table at most.
COLUMNS = 16_384


def normalised(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, json, fault, trimmed of each text: the value written anew without spaces, with null for what lies deeper than `paths.MAX_DEPTH` (trimmed tells); or the fault."""

    @F.pandas_udf("json string, fault string, trimmed boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            value, fault, trimmed = paths.read_json(text or "")
            out.append((None if fault else json.dumps(value, ensure_ascii=False, separators=(",", ":")), paths.fault_text(fault) or None, trimmed))
        return pd.DataFrame(out, columns=["json", "fault", "trimmed"])

    return docs.select(key, told(F.col(column)).alias("n")).select(key, "n.*")


def flatten_json(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, record, place, path, value: a row for each leaf; a list at the top is one record an element.

    Texts that aren't JSON give one leaf with the path null and the fault as value; what lies deeper than `paths.MAX_DEPTH` is null.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch["_json"], strict=True):
                value, fault, _ = paths.read_json(text or "")
                if fault:
                    out.append((k, 0, 0, None, f"{fault[0]}:{fault[1]} {fault[2]}"))
                    continue
                for r, record in enumerate(value if isinstance(value, list) else [value]):
                    out += [(k, r, i, p, paths.leaf_text(v)) for i, (p, v) in enumerate(paths.flatten(record))]
            yield pd.DataFrame(out, columns=["key", "record", "place", "path", "value"]).rename(columns={"key": key})

    shape = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("record int, place int, path string, value string").fields])
    return docs.select(key, F.col(column).alias("_json")).mapInPandas(run, shape)


def to_table(leaves: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """key, record and a column for each path, paths in the order in which they come first."""
    if fields is None:
        first = leaves.where("path is not null").groupBy("path").agg(F.min(F.struct(key, "record", "place")).alias("at"))
        fields = [r["path"] for r in first.orderBy("at").select("path").limit(COLUMNS + 1).collect()]
        if len(fields) > COLUMNS:
            raise ValueError(f"more than {COLUMNS} paths make no table: name the fields, or keep the rows of paths")
    return leaves.groupBy(key, "record").agg(*[F.max(F.when(F.col("path") == f, F.col("value"))).alias(f) for f in fields])


def unflatten_json(leaves: DataFrame, key: str) -> DataFrame:
    """key, record, json: the leaves of each record put together again, all values as texts."""
    grouped = leaves.where("path is not null").groupBy(key, "record").agg(F.array_sort(F.collect_list(F.struct("place", "path", "value"))).alias("cells"))

    @F.pandas_udf("string")
    def built(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: json.dumps(paths.unflatten({x["path"]: x["value"] for x in c}), ensure_ascii=False))

    return grouped.select(key, "record", built("cells").alias("json"))


def detect(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, format, confidence of each text."""

    @F.pandas_udf("format string, confidence string")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([paths.detect_format(t or "") for t in texts], columns=["format", "confidence"])

    return docs.select(key, found(F.col(column)).alias("f")).select(key, "f.*")
