"""Codes of vectors by product quantisation, the nearest entries found by a VA-file filter.

1. A vector's components become whole numbers (`integers.whole`) and are cut into `PARTS` parts. The codebook of a part starts as that
   part of the `ENTRIES` rows of least vec_id; in each of `ROUNDS` rounds it is moved to the floor of the mean of the parts
   that are nearest to each entry. A task sums its rows, so what is summed up has a row an entry and component.
2. The nearest entry of a part: each coordinate of the entries is quantised to `BITS` bits, its cell, which knows the least and
   greatest coordinate in it. A vector's look-up table has, for each coordinate and cell, the least and greatest squared
   distance to what may lie there; their sums over the entry's cells bound its distance from below and above. Entries whose
   lower bound exceeds the least upper bound are out; the others are refined with exact distances of whole numbers.
3. Errors are summed by label before a join, so a label of a third of all rows is no hot key.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are those whose vector
isn't as long as that of the least vec_id (null ids last); lengths that PARTS doesn't divide are filled up with zeros; components beyond
65,536 count as that; fewer rows than ENTRIES give as many entries; repeated rows and ids are rows of their own; null labels form
one group; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import scratch, settled
from plumbline.llm.integers import kept, matrix

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 3
#: Rows whose bounds are held at once; labels whose sums at most are sent to all tasks; shares of a label's rows beyond that.
ROWS, FEW, SALTS = 2048, 10_000, 32


@dataclass(frozen=True)
class Cells:
    """The entries of a part's codebook, and the cell of each of their coordinates."""

    entries: np.ndarray  # entry x coordinate
    cell: np.ndarray  # coordinate x entry
    low: np.ndarray  # coordinate x cell
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        """Cells of about as many entries each; equal coordinates share a cell."""
        n, width = entries.shape
        cell, low, high = np.zeros((width, n), np.int64), np.zeros((width, 1 << bits), np.int64), np.zeros((width, 1 << bits), np.int64)
        for d in range(width):
            values = np.sort(entries[:, d])
            edges = np.unique(values[np.arange(1 << bits) * n >> bits])
            cell[d] = np.searchsorted(edges, entries[:, d], "right") - 1
            for c in range(len(edges)):
                inside = entries[cell[d] == c, d]
                low[d, c], high[d, c] = inside.min(), inside.max()
        return cls(entries, cell, low, high)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the squared distance of each row of x to each entry: a lower and an upper bound, from the tables of each row."""
        least = np.zeros((len(x), len(self.entries)), np.int64)
        most = least.copy()
        for d in range(x.shape[1]):
            under, over = self.low[d] - x[:, d, None], x[:, d, None] - self.high[d]
            least += (np.maximum(np.maximum(under, over), 0) ** 2)[:, self.cell[d]]
            most += (np.maximum(np.abs(under), np.abs(over)) ** 2)[:, self.cell[d]]
        return least, most

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of x its nearest entry (of equals the first), the squared distance, and how many entries were refined."""
        if not x.shape[1]:
            none = np.zeros(len(x), np.int64)
            return none, none, none
        least, most = self.bounds(x)
        row, entry = np.nonzero(least <= most.min(axis=1, keepdims=True))
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(distance, first) if len(x) else distance
        hit = np.flatnonzero(distance == best[row])
        chosen = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[chosen], best, np.bincount(row, minlength=len(x))


def _parts(lists: pa.Array, size: int, width: int, parts: int) -> np.ndarray:
    """Rows x parts x width, filled up with zeros."""
    x = matrix(lists, size)
    return np.pad(x, ((0, 0), (0, parts * width - size))).reshape(len(x), parts, width)


@dataclass(frozen=True)
class Books:
    """Codebooks: parts x entries x width, for vectors of a size."""

    entries: np.ndarray
    size: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _assigned(books: Books, batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of a batch: where they start, their parts, and by row and part the entry, the squared distance and the entries refined."""
    parts, _, width = books.entries.shape
    cells = [Cells.of(e) for e in books.entries]
    for start in range(0, batch.num_rows, ROWS):
        x = _parts(batch.column(column).slice(start, ROWS), books.size, width, parts)
        found = [cells[p].nearest(x[:, p]) for p in range(parts)]
        yield start, x, *(np.stack([f[k] for f in found], axis=1) for k in range(3))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books | None:
    """The codebooks of a table's usable vectors; None if there are none."""
    spark, rows = vectors.sparkSession, kept(vectors, "vec_id")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()  # ENTRIES rows
    if not start:
        return None
    size = start[0]["size"]
    same = rows.where(F.col("size") == size)
    if any(r["size"] != size for r in start):
        start = same.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    width = -(-size // parts)
    books = Books(np.ascontiguousarray(_parts(pa.array([r["whole"] for r in start], pa.list_(pa.int32())), size, width, parts).swapaxes(0, 1)), size)
    for _ in range(rounds if width else 0):
        shared = spark.sparkContext.broadcast(books)  # a fixed number of entries

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """A task's sums: a row for each part, entry and position that it met."""
            books = shared.value
            parts, n, width = books.entries.shape
            count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
            for batch in batches:
                for _, x, entry, _, _ in _assigned(books, batch, 0):
                    for p in range(parts):
                        np.add.at(total[p], entry[:, p], x[:, p])
                        count[p] += np.bincount(entry[:, p], minlength=n)
            part, k = np.nonzero(count)
            at = np.repeat(np.arange(len(part)), width)
            place = np.tile(np.arange(width), len(part))
            columns = [part[at], k[at], place, count[part, k][at], total[part[at], k[at], place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "count", "total"])

        sums = same.select("whole").mapInArrow(summed, "part long, entry long, place long, count long, total long")
        moved = books.entries.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("total").alias("total")).collect():  # a row a component of the codebooks
            moved[r["part"], r["entry"], r["place"]] = r["total"] // r["count"]
        books = Books(moved, size)
    return books


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (a byte a part), error (squared distance to what the code stands for), refined (distances computed) of each usable vector of the books' size."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x, entry, distance, refined in _assigned(shared.value, batch, 2):
                own = batch.slice(start, len(x))
                codes = pa.array([bytes(c) for c in entry.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), codes, pa.array(distance.sum(axis=1)), pa.array(refined.sum(axis=1))], names=["vec_id", "label", "code", "error", "refined"])

    rows = kept(vectors, "vec_id", "label").where(F.col("size") == books.size).select("vec_id", "label", "whole")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("code binary, error long, refined long").fields]))


def decode(codes: DataFrame, books: Books, scale: int = 256) -> DataFrame:
    """codes with `embedding`: the middle of what each code stands for, as doubles, instead of `code`."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def values(column):
        entries = shared.value.entries
        at = np.arange(entries.shape[0])
        return column.map(lambda c: None if c is None else ((entries[at, np.frombuffer(c, np.uint8)].reshape(-1)[: shared.value.size] + 0.5) / scale).tolist())

    return codes.withColumn("embedding", values("code")).drop("code")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (settled) with label_error, the sum of the errors of equal labels, nulls together."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= FEW:
        return coded.join(F.broadcast(sums), same).drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return own.join(salted, same & (F.col("_own") == F.col("_salt"))).drop("_label", "_own", "_salt")


def op12_va_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors, and their errors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = fit(vectors)
    shape = "code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return spark.createDataFrame([], T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL(shape).fields]))
    coded = settled(encode(vectors, books), scratch(spark), "coded")
    return with_label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"),
    )


_NEAREST = "SELECT c.p, c.k, any_value(c.v) AS v, min({{'d': list_sum(list_transform(range(1, 5), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i]))), 'e': b.e}}) AS m FROM cut c JOIN {books} b USING (p) GROUP BY c.p, c.k"
_MEANS = "[" + ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in (1, 2, 3, 4)) + "]"
_MOVED = "SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM {books} b LEFT JOIN (SELECT p, m.e AS e, " + _MEANS + " AS v FROM {near} GROUP BY p, m.e) u USING (p, e)"
#: For vectors of 64 components.
ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, row_number() OVER (ORDER BY vec_id) - 1 AS k
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (SELECT k, p, w[p * 4 + 1 : p * 4 + 4] AS v FROM kept, range(16) t(p)
), b0 AS MATERIALIZED (SELECT p, k AS e, v FROM cut WHERE k < 64
), n0 AS MATERIALIZED ({_NEAREST.format(books="b0")}
), b1 AS MATERIALIZED ({_MOVED.format(books="b0", near="n0")}
), n1 AS MATERIALIZED ({_NEAREST.format(books="b1")}
), b2 AS MATERIALIZED ({_MOVED.format(books="b1", near="n1")}
), n2 AS MATERIALIZED ({_NEAREST.format(books="b2")}
), coded AS (
    SELECT k, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n2 GROUP BY k
), books AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), books
"""
