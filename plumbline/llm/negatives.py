"""Hard negatives by bit-sliced integer products.

1. Vectors become whole numbers (`integers.whole`). Anchors and rows are dealt to blocks of bounded size; a task gets a block of
   anchors and a block of rows, so no label, id or group of copies makes a task larger, and no pair leaves it that isn't
   among its best.
2. In a task, the rows' components are two's complement numbers, read a bit-plane at a time, the most significant first. A plane adds its
   weight times the anchor's sum over its set bits to each score; the planes to come can add no less than the
   anchor's negative and no more than its positive components times what those planes hold. So each pair has an interval that
   narrows from plane to plane.
3. A pair is dropped once its interval lies outside all windows of scores that its anchor asks for, or below
   the k-th greatest lower end of pairs that are surely inside. While most pairs live, planes are products of
   matrices; then they are summed for living pairs alone.
4. The best of each block meet in one ranking an anchor and window. Positives are the best of the same label (one window
   without bounds); each distinct score of a positive is a window for the negatives.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; components
beyond 65,536 count as that; vectors are compared with those of their own length only; a null vec_id is no anchor and comes last among
equal scores; rows that share a vec_id or are equal are rows of their own, and so are anchors; other columns are left out, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import scratch, settled
from plumbline.llm.integers import kept, matrix

#: Rows and anchors a block, anchors at a time, the share of living pairs below which only those are summed, and groups of blocks that are sent to all tasks at most.
ROWS, ANCHORS, TILE, SPARSE, FEW = 1024, 2048, 256, 1 / 16, 20_000
#: Beyond all scores.
END = 1 << 62


def planes(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The bit-planes of two's complement numbers with their weights, the most significant first."""
    top = max(int(x.max(initial=0)), -1 - int(x.min(initial=0))).bit_length()
    return [(-1 << top, x < 0), *((1 << k, (x >> k & 1).astype(bool)) for k in range(top - 1, -1, -1))]


def _kth(score: np.ndarray, anchor: np.ndarray, k: int, anchors: int) -> np.ndarray:
    """For each anchor the k-th greatest of its scores, if it has so many."""
    out = np.full(anchors, -END, score.dtype)
    order = np.lexsort((-score, anchor))
    anchor, score = anchor[order], score[order]
    at = np.searchsorted(anchor, np.arange(anchors)) + k - 1
    has = (at < len(anchor)) & (np.append(anchor, -1)[np.minimum(at, len(anchor))] == np.arange(anchors))
    out[has] = score[at[has]]
    return out


def search(anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, score), of those allowed, that may be among the k best of a window of their anchor in these rows: all
    pairs of a window that score as the k-th or better. low and high: anchor x window. seen gets the living pairs after each plane."""
    exact = float(np.abs(anchors).sum(axis=1).max(initial=0)) * max(float(np.abs(rows).max(initial=0)), 1) < 1 << 53
    a = anchors.astype(np.float64 if exact else np.int64)
    more, less = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    todo = planes(rows)
    unbounded = low.shape[1] == 1 and (low <= -END).all() and (high >= END).all()
    under, over = low.min(axis=1, initial=END), high.max(axis=1, initial=-END)
    score, live, done = np.zeros(allowed.shape, a.dtype), allowed.copy(), 0
    for done, (weight, bits) in enumerate(todo, 1):
        score += weight * (a @ bits.T.astype(a.dtype))
        rest = abs(weight) - 1  # what the planes to come hold
        least, most = score + (less * rest)[:, None], score + (more * rest)[:, None]
        live &= (most >= under[:, None]) & (least <= over[:, None])
        if unbounded and k <= live.shape[1]:
            live &= most >= np.partition(np.where(live, least, -END), -k, axis=1)[:, -k, None]
        if seen is not None:
            seen.append(int(live.sum()))
        if live.sum() <= SPARSE * live.size:
            break
    anchor, row = np.nonzero(live)
    score = score[anchor, row]
    for weight, bits in [(0, None), *todo[done:]]:  # first what the windows say of the planes read so far
        rest = abs(weight or todo[done - 1][0]) - 1
        if weight:
            score = score + weight * (a[anchor] * bits[row]).sum(axis=1)
        least, most = score + less[anchor] * rest, score + more[anchor] * rest
        alive = np.zeros(len(anchor), bool)
        for w in range(low.shape[1]):
            bottom, top = low[anchor, w], high[anchor, w]
            sure = (least >= bottom) & (most <= top)
            alive |= (most >= bottom) & (least <= top) & (most >= _kth(least[sure], anchor[sure], k, len(a))[anchor])
        anchor, row, score = anchor[alive], row[alive], score[alive]
        if seen is not None and weight:
            seen.append(len(anchor))
    return anchor, row, score.astype(np.int64)


def _blocks(rows: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """rows and anchors of a group (equal `by`), each block of one with each block of the other: by, i, j, anchor (true or false), and their columns."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n")).join(anchors.groupBy(*by).agg(F.count("*").alias("_a")), by)
    groups = counts.select(*by, F.ceil(F.col("_n") / ROWS).cast("int").alias("_rows"), F.ceil(F.col("_a") / ANCHORS).cast("int").alias("_anchors"))
    hint = F.broadcast if groups.count() <= FEW else (lambda x: x)
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    each = rows.join(hint(groups), by).withColumn("i", own("_rows")).withColumn("j", every("_anchors")).withColumn("anchor", F.lit(False))
    asked = anchors.join(hint(groups), by).withColumn("j", own("_anchors")).withColumn("i", every("_rows")).withColumn("anchor", F.lit(True))
    return each.unionByName(asked).drop("_rows", "_anchors")


def _best(rows: DataFrame, anchors: DataFrame, by: list[str], k: int, same: bool) -> DataFrame:
    """row (the anchor's), window, other (a row), vec_id (its id), score, rank: for each window of an anchor the k best rows of the same label, or of others."""

    shape = T.StructType([*T.StructType.fromDDL("row long, window long, other long").fields, rows.schema["vec_id"], T.StructField("score", T.LongType())])

    def compared(table: pa.Table) -> pa.Table:
        asks = table.filter(table["anchor"])
        rest = table.filter(pc.invert(table["anchor"]))
        size = table["size"][0].as_py()
        x, own, ids, labels = matrix(rest["whole"], size), rest["row"].to_numpy(), rest["vec_id"].combine_chunks(), rest["label"].to_numpy()
        rank = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy()
        found = []
        for start in range(0, len(asks) if len(rest) else 0, TILE):
            part = asks.slice(start, TILE)
            windows = part["windows"].to_pylist()
            low, high = np.full((len(part), max(map(len, windows))), END, np.int64), np.full((len(part), max(map(len, windows))), -END, np.int64)
            for r, spans in enumerate(windows):
                for w, span in enumerate(spans):
                    low[r, w], high[r, w] = span["low"], span["high"]
            equal = part["label"].to_numpy()[:, None] == labels
            allowed = equal & (part["row"].to_numpy()[:, None] != own) if same else ~equal
            anchor, row, score = search(matrix(part["whole"], size), x, allowed, low, high, k)
            names = part["row"].to_numpy()
            for w in range(low.shape[1]):
                inside = np.flatnonzero((score >= low[anchor, w]) & (score <= high[anchor, w]))
                inside = inside[np.lexsort((own[row[inside]], rank[row[inside]], -score[inside], anchor[inside]))]
                nth = np.arange(len(inside)) - np.searchsorted(anchor[inside], anchor[inside])
                inside = inside[nth < k]
                found.append(pa.table([pa.array(names[anchor[inside]]), pa.array(high[anchor[inside], w]), pa.array(own[row[inside]]), ids.take(pa.array(row[inside])), pa.array(score[inside])], names=shape.names))
        return pa.concat_tables(found) if found else pa.table([*[pa.array([], pa.int64())] * 3, ids[:0], pa.array([], pa.int64())], names=shape.names)

    found = _blocks(rows, anchors, by).groupBy(*by, "i", "j").applyInArrow(compared, shape)
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5), folder: str | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of vectors (vec_id, embedding, label) that is an
    anchor, and each of its best rows of the same label, the best rows of other labels that score from least[0] / least[1] of the positive's score up to it."""
    folder = folder or scratch(vectors.sparkSession)
    named = vectors.withColumn("_label", F.col(label) if isinstance(label, str) else label).withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    usable = kept(named.where(F.col("_label").isNotNull()), "vec_id", F.col("_label").cast("long").alias("label"), "_anchor").withColumn("row", F.monotonically_increasing_id())
    span = "array<struct<low: long, high: long>>"
    rows = settled(usable.withColumn("windows", F.lit(None).cast(span)), folder, "rows")
    anchors, rows = rows.where("_anchor").drop("_anchor"), rows.drop("_anchor")
    everything = F.array(F.struct(F.lit(-END).alias("low"), F.lit(END).alias("high"))).cast(span)
    near = settled(
        _best(rows, anchors.withColumn("windows", everything), ["size", "label"], positives, True).select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("window"), F.col("rank").alias("_nth")),
        folder, "positives",
    )
    # A positive's score is the upper end of its window; below zero no window has a score.
    up, down = least
    spans = near.where("window >= 0").select("row", "window").distinct().groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(F.expr(f"({up} * window + {down - 1}) div {down}").alias("low"), F.col("window").alias("high")))).cast(span).alias("windows"),
    )
    asked = settled(anchors.drop("windows").join(spans, "row").select(*rows.columns), folder, "anchors")
    hard = settled(_best(rows, asked, ["size"], negatives, False).select("row", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), folder, "negatives")
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return near.join(hard, ["row", "window"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", F.col("window").alias("positive_score"), "negative_score")


def op13_bit_sliced_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives for every row whose vec_id divides by 100; labels of every seventh id are turned first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, turned)


ORACLE = """
WITH kept AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w, row_number() OVER () AS r
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), near AS MATERIALIZED (
    SELECT a.r, a.vec_id AS anchor_id, a.label, a.w, b.vec_id AS positive_id, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS positive_score
    FROM kept a JOIN kept b ON a.label = b.label AND a.r <> b.r WHERE a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY positive_score DESC, positive_id, b.r) <= 5
), hard AS (
    SELECT n.r, anchor_id, positive_id, positive_score, b.r AS other, b.vec_id AS negative_id, CAST(list_dot_product(n.w, b.w) AS BIGINT) AS negative_score
    FROM near n JOIN kept b ON b.label <> n.label
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY r, positive_id ORDER BY negative_score DESC, negative_id, other) AS INT) AS rank, negative_id, positive_score, negative_score
FROM hard WHERE 80 * positive_score <= 100 * negative_score AND negative_score <= positive_score
QUALIFY rank <= 5
"""
