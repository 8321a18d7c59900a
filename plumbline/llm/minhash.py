"""Near duplicates by a multi-index Hamming join of minwise signatures.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a digest of that set, and
   a signature of 24 minwise hashes of 16 bits (b-bit minwise hashing). Texts with one
   digest are one class, found by a partial minimum, and go on as its smallest doc_id.
2. Multi-index: the signature is cut into 6 chunks of 4 symbols. Two signatures that
   differ in at most 11 symbols have, by the pigeonhole principle, a chunk with at most
   one error, so each chunk is entered under its 4 keys with one symbol left out: 24 exact
   keys of 48 bits a class. All pairs at distance 11 or less share a key; of texts at
   similarity 0.75 a share of 0.0003 shares none (each chunk fails with 0.26).
3. Links are confirmed on full sets. Round 1 compares each class with the pivot (the first)
   of the bucket family it shares most keys with: one pair a class at most, and a
   group of copies becomes one component at once. Round 2 takes the buckets whose members
   still lie in several components, cuts each into blocks and compares, block by block,
   all pairs across components whose signatures are within `DISTANCE`. No step emits all pairs
   of a bucket, and none is capped or sampled.

A link is lost only if its texts share no key (a share of 0.0003 at similarity 0.75, 0.00004 at 0.80, less above) or, in round 2, lie beyond `DISTANCE`
(1e-5 at 0.75; none with SYMBOLS).

Defined results: null texts and texts without words have no shingles and link with nothing;
texts of fewer than five words are one shingle, their whole sequence; ids are of any type that has an order; a null doc_id links with
nothing (component null, kept false); rows that share a doc_id are documents of their own, linked by their texts only; columns besides the id, the text and those to keep
are left out, whatever their names; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, settled, table, with_results
from plumbline.operators.graph import components

SHINGLE, CHUNKS, PER_CHUNK = 5, 6, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: Signature distance up to which a pair's full sets are compared in round 2; a pair at similarity 0.75 lies beyond it with 1e-5. SYMBOLS compares all.
DISTANCE = 15
#: Classes a block.
BLOCK = 300

_random = np.random.default_rng(5)
_MULTIPLY = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**64, SYMBOLS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower and bytes.split know A-Z and ASCII white space only, as the contract does."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    rolled = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - n + 1 + k])
    return np.unique(rolled)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minwise hashes of 16 bits, packed by fours into CHUNKS longs."""
    if len(hashes) <= 2048:
        least = (hashes[:, None] * _MULTIPLY + _ADD).min(axis=0)
    else:
        least = np.array([(hashes * m + a).min() for m, a in zip(_MULTIPLY, _ADD, strict=True)], np.uint64)
    return (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def _features(texts: list[str | None]) -> list[pa.Array]:
    sets = [shingles(t) for t in texts]
    return [
        pa.array([len(x) for x in sets], pa.int64()),
        pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
        pa.array([signature(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
    ]


def _keys() -> list:
    """The 24 keys of a class: the chunk's number and symbol left out, and the other three symbols."""
    out = []
    for chunk in range(CHUNKS):
        c = F.col("signature")[chunk]
        for j in range(PER_CHUNK):
            low = c.bitwiseAND(F.lit((1 << 16 * j) - 1))
            high = F.lit(0).cast("long") if j == 3 else F.shiftleft(F.shiftrightunsigned(c, 16 * (j + 1)), 16 * j)
            out.append(high.bitwiseOR(low).bitwiseOR(F.lit((chunk * PER_CHUNK + j) << 48)))
    return out


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with both texts, those of a pivot mostly in a row: links only."""
    pivot, known = None, np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if a != pivot:
                pivot, known = a, shingles(text_a)
            keep.append(_similar(known, shingles(text_b)))
        yield batch.loc[keep, ["a", "b"]]


def _pairs(group: pd.DataFrame, most: int = DISTANCE) -> np.ndarray:
    """Pairs of places in a block pair that lie in different components and are near in signature and size."""
    marks = np.stack([np.asarray(s, np.int64) for s in group["signature"]]).view(np.uint16)
    n = group["n_shingles"].to_numpy()
    distance = np.zeros((len(group), len(group)), np.uint8)
    for k in range(SYMBOLS):
        distance += marks[:, k, None] != marks[None, :, k]
    component = group["component"].to_numpy()
    near = (distance <= most) & (component[:, None] < component[None, :])
    near &= 100 * np.minimum(n[:, None], n[None, :]) >= 75 * np.maximum(n[:, None], n[None, :])
    part = group["part"].to_numpy()
    if (part != part[0]).any():  # two blocks: pairs inside one are compared where it meets itself
        near &= part[:, None] != part[None, :]
    return np.argwhere(near)


def _open_nodes(group: pd.DataFrame, most: int = DISTANCE) -> pd.DataFrame:
    """The members of a block pair that have a pair to compare: only their texts are fetched."""
    return group.iloc[np.unique(_pairs(group, most))]


def _across(group: pd.DataFrame, most: int = DISTANCE) -> pd.DataFrame:
    """Confirmed links of a block pair, without those that join what already hangs together."""
    sets = [shingles(t) for t in group["text"]]
    nodes, component = group["node"].to_numpy(), group["component"].to_numpy()
    root = {c: c for c in component}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for i, j in _pairs(group, most):
        a, b = find(component[i]), find(component[j])
        if a != b and _similar(sets[i], sets[j]):
            root[max(a, b)] = min(a, b)
            found.append((nodes[i], nodes[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, folder: str | None = None, keep: Sequence[str] = (), distance: int = DISTANCE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the columns to keep, for each row of docs (doc_id, text).

    A smaller distance compares fewer full sets; SYMBOLS compares those of all pairs that share a key.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    hashed = F.xxhash64("text")
    features = settled(
        with_results(docs.select("doc_id", *keep, "text", hashed.alias("_hash")), _features, "n_shingles long, digest binary, signature array<bigint>"), folder, "features",
    )
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    # A class goes by a number of its own, as an id may be shared; its text is that of one of its rows.
    classes = settled(
        features.where(usable).groupBy("digest").agg(F.min(F.struct("doc_id", "_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()), folder, "classes",
    )
    entered = classes.select("node", F.explode(F.array(*_keys())).alias("key"))
    buckets = entered.groupBy("key").agg(F.count("node").alias("many"), F.min("node").alias("pivot")).where("many > 1")
    members = settled(entered.join(buckets, "key"), folder, "members")
    spoken = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "least.doc_id", "least._hash")
    texts = settled(docs.select("doc_id", "text", hashed.alias("_hash")).join(spoken, ["doc_id", "_hash"]).groupBy("doc_id", "_hash", "node").agg(F.first("text").alias("text")).select("node", "text"), folder, "texts")

    votes = members.where("node <> pivot").groupBy("node", "pivot").agg(F.count("key").alias("hits"))
    first = votes.groupBy("node").agg(F.max_by("pivot", F.struct("hits", -F.col("pivot"))).alias("pivot"))
    sided = (
        first.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    )
    links = settled(sided.mapInPandas(_confirmed, "a long, b long"), folder, "round1")
    joined = components(links, f"{folder}/components1")

    placed = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("many").alias("many"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("same"))
        .where("low < high")
        .groupBy("many", "same").agg(F.min("key").alias("key"))  # buckets with the same members are compared once
        .select("key")
    )
    opened = settled(
        placed.join(mixed, "key", "left_semi").join(classes.select("node", "n_shingles", "signature"), "node").select("key", "many", "node", "component", "n_shingles", "signature"), folder, "mixed",
    )
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt = (
        opened.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component", "n_shingles", "signature")
    )
    by = ["key", "i", "j"]
    shape = dealt.schema
    # Dealt out by number, as the work is in comparing and not in bytes, by which partitions would be merged; and by range, as hashing puts several block pairs in one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = settled(dealt.repartitionByRange(tasks, *by).groupBy(*by).applyInPandas(lambda g: _open_nodes(g, distance), shape), folder, "open")
    across = wanted.join(texts, "node").repartition(tasks, *by).groupBy(*by).applyInPandas(lambda g: _across(g, distance), "a long, b long")
    more = settled(across.distinct(), folder, "round2")

    whole = joined
    if not more.isEmpty():
        whole = components(links.unionByName(more), f"{folder}/components2")
    placed = settled(classes.join(whole, "node", "left").select("digest", F.col("least.doc_id").alias("_id"), F.coalesce("component", "node").alias("component")), folder, "placed")
    group = placed.join(placed.groupBy("component").agg(F.min("_id").alias("_least")), "component").select("digest", "_least")
    return features.join(group, "digest", "left").select(
        "doc_id", *keep, "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op2_hamming_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
