"""Near duplicates of embeddings by a forest of random-projection trees.

1. Vectors are packed: bytes in their own precision, and a digest. Equal vectors of a label are one class (a
   partial minimum and count on the digest), so a group of copies is one row from there on.
2. Forest: each label gets `TREES` trees. A node splits along a random direction at a quantile of a
   bounded sample (`SAMPLE` vectors in all for the first levels), by preference the median, and vectors within
   `SPILL` of the sample around it go to both sides. A cut that would part more than `LOSS` of the
   links in the sample is not made: another place or direction is tried, and a node that has none,
   as a large group of near copies, stays one leaf. A label is split until its leaves have
   about `LEAF` classes. Leaves beyond that, where the first sample was too thin, are split on by samples of
   their own, each in a task of its own, in rounds; so neither the driver nor a broadcast grows with the table. Every class is indexed.
3. Leaves are compared by matrix products in double precision; a leaf that is larger than a
   block is cut into blocks, each pair of which is a task of its own, so nothing is capped. A
   pair that meets in several trees is counted in the first: each row carries its leaves of the trees before. A
   leaf returns a row for each class, with its links and the least class it hangs together
   with, never its pairs.
4. Links are summed; components follow from the leaves' rows.

Defined results: ids are whole numbers; vectors that are null, empty, zero or hold null or non-finite numbers, and those with a
null label, link with nothing; so do vectors of different lengths; a null vec_id gets no component
and is kept false; rows that share a vec_id count apart as links and together as a node; of equal vectors the least
vec_id stands for all; columns besides the three are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import scratch, settled
from plumbline.operators.graph import components

THRESHOLD, TREES, LEAF, SPILL, SAMPLE = 0.93, 5, 150, 0.06, 16_000
#: Sampled vectors that a node needs to be split, classes a block, and a leaf's own sample.
FEWEST, BLOCK, OWN = 16, 1000, 1500
#: Leaves larger than this many times LEAF are split on; so many of those beyond a block, or being split, at most are sent to all tasks.
FULL, FEW = 4, 20_000
#: Of a node's sample, the vectors whose links are tried; directions tried, where in the sample they are cut, and the mean share of a
#: vector's links that a cut may part (the other trees find those). Levels at most.
PEERS, TURNS, MIDDLES, LOSS, DEEPEST = 1000, 8, (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8), 0.03, 30

Bounds = dict[int, tuple[int, float, float]]


def _unpacked(packed, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of packed ones."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    return _unit(x)


def _direction(seed: int, tree: int, node: int, turn: int, size: int) -> np.ndarray:
    return np.random.default_rng((seed, tree, node, turn)).standard_normal(size)


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cut(x: np.ndarray, spill: float, seed: int, tree: int, node: int) -> tuple[int, float, float] | None:
    """The first direction and bounds that part few links of a node's sample; None if all do, as within a group of near copies."""
    some = np.arange(len(x))
    if len(x) > PEERS:
        some = np.random.default_rng((seed, tree, node)).choice(len(x), PEERS, replace=False)
    near = (x[some] @ x[some].T >= THRESHOLD).astype(np.float32)
    np.fill_diagonal(near, 0)
    own = near.any(axis=1)
    near = near[own] / near[own].sum(axis=1, keepdims=True)
    for turn in range(TURNS):
        p = x @ _direction(seed, tree, node, turn, x.shape[1])
        q = p[some]
        for middle in MIDDLES:
            low, high = (float(v) for v in np.quantile(p, [middle - spill / 2, middle + spill / 2]))
            left, right = q < low, q > high
            parted = np.where(left[own], near @ right, np.where(right[own], near @ left, 0))
            if low < high and parted.sum() <= LOSS * len(parted):
                return turn, low, high
    return None


def split(sample: np.ndarray, enough: float, tree: int, root: int = 1, spill: float = SPILL, seed: int = 9) -> Bounds:
    """A tree over a sample, as cuts by node (children 2n and 2n + 1): below the upper bound left, above the lower one right."""
    bounds: Bounds = {}
    todo = [(root, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if node.bit_length() >= DEEPEST or len(rows) <= enough:
            continue
        cut = _cut(sample[rows], spill, seed, tree, node)
        if cut is None:
            continue
        bounds[node] = cut
        turn, low, high = cut
        p = sample[rows] @ _direction(seed, tree, node, turn, sample.shape[1])
        todo += [(2 * node, rows[p <= high]), (2 * node + 1, rows[p >= low])]
    return bounds


def grow(sample: np.ndarray, count: int, trees: int = TREES) -> list[Bounds]:
    """The trees of a label of count classes, as far as the sample allows."""
    return [split(sample, max(FEWEST - 1, LEAF * len(sample) / count), tree) for tree in range(trees)]


def descend(vectors: np.ndarray, bounds: Bounds, tree: int, root: int = 1, seed: int = 9) -> list[list[int]]:
    """For each vector its leaves below a node, rising."""
    found: list[list[int]] = [[] for _ in range(len(vectors))]
    todo = [(root, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in bounds:
            for r in rows.tolist():
                found[r].append(node)
            continue
        turn, low, high = bounds[node]
        p = vectors[rows] @ _direction(seed, tree, node, turn, vectors.shape[1])
        todo += [(2 * node, rows[p <= high]), (2 * node + 1, rows[p >= low])]
    return [sorted(f) for f in found]


def _code(tree: int, node: int) -> int:
    return tree << 40 | node


def _compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A pair of blocks of a leaf: each class's links that no earlier tree has, and its least class reached."""
    vectors = _unpacked(group["packed"].tolist(), group["kind"].iloc[0])
    near = vectors @ vectors.T >= THRESHOLD
    np.fill_diagonal(near, False)
    part = group["part"].to_numpy()
    if (part != part[0]).any():  # two blocks: pairs inside one are compared where it meets itself
        near &= part[:, None] != part[None, :]
    touched = np.flatnonzero(near.any(axis=1))
    if not len(touched):
        return pd.DataFrame({"label": [], "size": [], "node": [], "links": [], "low": []}, dtype="int64").astype({"label": group["label"].dtype})
    near = near[np.ix_(touched, touched)]
    group = group.iloc[touched]
    earlier = [np.asarray(codes, np.int64) for codes in group["earlier"]]
    names, place = np.unique(np.concatenate(earlier), return_inverse=True)
    has = np.zeros((len(group), max(1, len(names))), np.float32)
    has[np.repeat(np.arange(len(group)), [len(e) for e in earlier]), place] = 1
    new = near & (has @ has.T == 0)
    links = new @ group["copies"].to_numpy().astype(np.float64)
    nodes = group["node"].to_numpy()
    low = nodes.copy()
    while True:  # least label within the leaf
        better = np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        better = np.minimum(low, better)
        if (better == low).all():
            break
        low = better
    return pd.DataFrame({"label": group["label"], "size": group["size"], "node": nodes, "links": links.astype(np.int64), "low": low})


def _packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, size, kind, digest, packed: bytes of each usable vector; null for the others."""
    double = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32

    def run(batches):
        for batch in batches:
            out = []
            for label, values in zip(batch["label"], batch["embedding"], strict=True):
                x = None if values is None or label is None or pd.isna(label) else np.asarray([np.nan if v is None else v for v in values] if values.dtype == object else values, kind)
                out.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x.tobytes())
            yield pd.DataFrame({
                "vec_id": batch["vec_id"], "label": batch["label"], "size": [0 if p is None else len(p) for p in out], "kind": np.dtype(kind).str,
                "digest": [None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in out], "packed": out,
            })

    shape = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], *T.StructType.fromDDL("size int, kind string, digest binary, packed binary").fields])
    # Nulls would make floats of ids in pandas: they pass as texts and are cast back.
    texts = T.StructType([T.StructField("vec_id", T.StringType()), T.StructField("label", T.StringType()), *shape.fields[2:]])
    slim = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    return slim.mapInPandas(run, texts).withColumn("vec_id", F.col("vec_id").cast(shape["vec_id"].dataType))


_LEAF = ["label", "size", "tree", "leaf"]


def _split_on(entered: DataFrame, folder: str, trees: int) -> DataFrame:
    """entered (classes by tree and leaf) with leaves that hold far more than LEAF classes split by samples of their own, round by round, until what is left can't be split."""
    spark = entered.sparkSession
    for k in range(DEEPEST):
        sizes = entered.where("open").groupBy(*_LEAF).agg(F.count("node").alias("n")).where(F.col("n") > FULL * LEAF)
        full = settled(sizes, folder, f"full{k}")
        many = full.count()
        if not many:
            return entered
        hint = F.broadcast if many <= FEW else (lambda x: x)
        share = F.pmod(F.xxhash64("node", "tree", F.lit(k)), F.lit(1_000_003)) < F.least(F.lit(1.0), OWN / F.col("n")) * 1_000_003

        def subtree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            sample = _unpacked(group["packed"].tolist(), group["kind"].iloc[0])
            bounds = split(sample, max(FEWEST - 1, LEAF * len(sample) / int(group["n"].iloc[0])), int(key[2]), int(key[3]))
            rows = [(*key, node, *cut) for node, cut in bounds.items()]
            return pd.DataFrame(rows, columns=[*_LEAF, "cut", "turn", "low", "high"])

        kinds = ", ".join(f"{f} {entered.schema[f].dataType.simpleString()}" for f in _LEAF)
        drawn = entered.join(hint(full), _LEAF).where(share)
        cuts = drawn.groupBy(*_LEAF).applyInPandas(subtree, f"{kinds}, cut long, turn int, low double, high double")
        subtrees = settled(cuts.groupBy(*_LEAF).agg(F.collect_list(F.struct("cut", "turn", "low", "high")).alias("cuts")), folder, f"subtrees{k}")  # OWN / FEWEST cuts at most

        def lower(batches):
            for batch in batches:
                made = []
                for (tree, leaf), group in batch.groupby(["tree", "leaf"]):
                    for _, same in group.groupby(["label", "size"]):
                        bounds = {c["cut"]: (c["turn"], c["low"], c["high"]) for c in same["cuts"].iloc[0]}
                        found = descend(_unpacked(same["packed"].tolist(), same["kind"].iloc[0]), bounds, int(tree), int(leaf))
                        made.append(same.drop(columns=["cuts"]).assign(leaf=found).explode("leaf"))
                yield pd.concat(made) if made else batch.drop(columns=["cuts"])

        # Leaves that were tried and can't be split are closed.
        tried = entered.join(hint(full.select(*_LEAF)), _LEAF, "left_semi")
        deeper = tried.join(hint(subtrees), _LEAF).select(*entered.columns, "cuts").mapInPandas(lower, entered.schema)
        closed = tried.join(hint(subtrees.select(*_LEAF)), _LEAF, "left_anti").withColumn("open", F.lit(False))
        rest = entered.join(hint(full.select(*_LEAF)), _LEAF, "left_anti")
        entered = settled(rest.unionByName(closed.select(*entered.columns)).unionByName(deeper), folder, f"entered{k}")
    return entered


def forest_links(vectors: DataFrame, folder: str | None = None, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    folder = folder or scratch(spark)
    packed = settled(_packed(vectors.select("vec_id", "embedding", "label")), folder, "packed")
    usable = F.col("packed").isNotNull() & F.col("vec_id").isNotNull()
    by = ["label", "size", "digest"]
    classes = settled(packed.where(usable).groupBy(*by).agg(F.min("vec_id").alias("node"), F.count("vec_id").alias("copies"), F.first("kind").alias("kind"), F.first("packed").alias("packed")), folder, "classes")
    many = classes.groupBy("label", "size").agg(F.count("node").alias("n")).where(F.col("n") > LEAF)  # others are one leaf
    every = classes.count()
    picked = F.pmod(F.xxhash64("node", F.lit("forest")), F.lit(1_000_003)) < min(1.0, SAMPLE / max(every, 1)) * 1_000_003
    drawn = classes.where(picked).join(many, ["label", "size"]).select("label", "size", "n", "kind", "packed").toPandas()  # SAMPLE rows
    forests = {}
    for (label, size), group in drawn.groupby(["label", "size"]):
        forests[label, size] = grow(_unpacked(group["packed"].tolist(), group["kind"].iloc[0]), int(group["n"].iloc[0]), trees)
    shared = spark.sparkContext.broadcast(forests)

    def indexed(batches):
        for batch in batches:
            made = []
            for (label, size), group in batch.groupby(["label", "size"]):
                unit, forest = _unpacked(group["packed"].tolist(), group["kind"].iloc[0]), shared.value.get((label, size), [{}])
                codes = [descend(unit, bounds, tree) for tree, bounds in enumerate(forest)]
                made.append(group.assign(leaves=[[_code(tree, n) for tree, c in enumerate(codes) for n in c[i]] for i in range(len(group))]))
            yield pd.concat(made) if made else batch.assign(leaves=[])

    slim = classes.drop("digest")
    shape = T.StructType([*slim.schema.fields, T.StructField("leaves", T.ArrayType(T.LongType()))])
    placed = settled(slim.mapInPandas(indexed, shape), folder, "leaves")
    tree, leaf = F.shiftright("code", 40).cast("int"), F.col("code").bitwiseAND(F.lit((1 << 40) - 1))
    each = placed.select("label", "size", "node", "copies", "kind", "packed", "leaves", F.explode("leaves").alias("code")).withColumn("tree", tree).withColumn("leaf", leaf)
    if not each.groupBy(*_LEAF).agg(F.count("node").alias("n")).where(F.col("n") > FULL * LEAF).isEmpty():
        entered = _split_on(settled(each.drop("leaves", "code").withColumn("open", F.lit(True)), folder, "entered"), folder, trees)
        own = ["label", "size", "node"]  # an id may occur in several labels, whose leaves are others
        codes = entered.select(*own, F.shiftleft(F.col("tree").cast("long"), 40).bitwiseOR(F.col("leaf")).alias("code"))
        each = entered.drop("open").join(codes.groupBy(*own).agg(F.array_sort(F.collect_list("code")).alias("leaves")), own).withColumn("code", F.shiftleft(F.col("tree").cast("long"), 40).bitwiseOR(F.col("leaf")))
    first = F.shiftleft(F.col("tree").cast("long"), 40)
    each = each.withColumn("earlier", F.filter("leaves", lambda c: c < first))
    within = F.filter("leaves", lambda c: (c >= first) & (c < F.col("code")))  # of one tree, a pair counts in the first leaf that both are in
    each = each.withColumn("earlier", F.concat("earlier", within)).drop("leaves", "code")
    sizes = settled(each.groupBy(*_LEAF).agg(F.count("node").alias("n")).where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), folder, "large")
    hint = F.broadcast if sizes.count() <= FEW else (lambda x: x)
    dealt = (
        each.join(hint(sizes), _LEAF, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*_LEAF, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "copies", "kind", "packed", "earlier")
    )
    found = settled(dealt.groupBy(*_LEAF, "i", "j").applyInPandas(_compare, f"label {dealt.schema['label'].dataType.simpleString()}, size int, node long, links long, low long"), folder, "found")
    links = found.groupBy("label", "size", "node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), f"{folder}/components")
    facts = classes.select(*by, "node", "copies").join(links, ["label", "size", "node"], "left").join(joined, "node", "left").select(
        *by, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"),
    )
    rows = packed.select("vec_id", "label", "size", F.when(usable, F.col("digest")).alias("digest"))
    return rows.join(facts, by, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_projection_forest(spark, sf_dir: str) -> DataFrame:
    return forest_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
