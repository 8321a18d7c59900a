"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import ROWS, scratch, settled, small_batches, spread

__all__ = ["WORD", "held_out", "scratch", "settled", "slices", "small_batches", "table", "with_results"]

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the texts of at most ROWS rows that a Python worker makes objects of at a time.
BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one in one piece is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Where a batch is parted: at so many rows, or where its values come to so many bytes. Spark bounds the batch itself."""
    sizes = pc.fill_null(pc.binary_length(values), 0) if pa.types.is_string(values.type) or pa.types.is_binary(values.type) else None
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) if sizes is not None else np.zeros(len(values), np.int64)
    start = 0
    while start < len(values):
        before = int(upto[start - 1]) if start else 0
        end = min(start + ROWS, max(start + 1, int(np.searchsorted(upto, before + BYTES, "right"))))
        yield start, min(end, len(values))
        start = end


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no model learns from: crc32 of the id's text divides by 5."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_results(docs: DataFrame, results: Callable[[list[str | None]], list[pa.Array]], added: str, column: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without its texts, unless keep_text) and the columns `added`, which results() makes from a batch of texts.

    The other columns stay Arrow arrays on the way, so nulls and 64-bit ids keep their values. An added
    column takes the place of one of its name.
    """
    new = T.StructType.fromDDL(added)
    taken = {f.name for f in new} | (set() if keep_text else {column})
    kept = [f for f in docs.schema.fields if f.name not in taken]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, end in slices(whole.column(len(names))):
                batch = whole.slice(start, end - start)
                made = results(batch.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=[*names, *new.names])

    small_batches(docs.sparkSession)
    given = "_given"
    while given in names:
        given += "_"
    quoted = [F.col(f"`{n}`") for n in names]
    return docs.select(*quoted, F.col(column).alias(given)).mapInArrow(run, T.StructType([*kept, *new]))
