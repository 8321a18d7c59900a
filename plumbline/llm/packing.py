"""Harmonic packing: documents as sequences of a fixed number of tokens, with little padding.

1. A document's ids, an end id after them, are cut into pieces of the whole capacity and a rest. The rest is cut by a plan
   that depends on its length alone: a piece of length l belongs to class j = capacity div l, j of its kind fill a
   sequence and leave capacity / j - l tokens of padding each; the plan has the least sum of padding and of `PRICE` tokens a cut.
2. Each worker fills the sequences of a class with j pieces as they come, independently of all others and of their lengths.
   What its last, unfilled sequences hold (fewer than j pieces a class, so a bounded number) stays open.
3. Open pieces are dealt by class to buckets of a bounded size, each of which fills sequences in the same way, until a
   class has one bucket. The last unfilled sequence of each class is left; these few dozen share sequences by first fit.

So a piece is settled where it was made, and only lengths of open pieces pass a shuffle when their ids were left out before.
Ids are packed as 32-bit unsigned little-endian numbers, as token files hold them; `unpacked()` makes an array of them.

Encoding uses the rank-based encoder of the installed libraries with the tokens of the byte-level file given, which gives that file's ids.

Defined results: a null text is the empty text, which has the end id only; repeated rows are documents of their own; an
empty table gives an empty result; texts pass whole, a batch holds ids of a few megabytes of text or of one document; columns
of the names of the new ones give way to them, as does `_place`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import byte_letters, public_path
from plumbline.llm.common import scratch, settled, slices, table

CAPACITY, PRICE, END = 1024, 16, 0
#: Open pieces a bucket, by number and by sequences of their class.
BUCKET, FILLED = 2048, 8
#: The pattern of a byte-level file's words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ADDED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, _place long"


@cache
def plan(capacity: int = CAPACITY, price: float = PRICE) -> list[int]:
    """For each rest, the first piece to cut from it: least padding and price of the cuts in all (pieces in falling order where that is free)."""
    padding = np.array([0.0] + [capacity / (capacity // n) - n for n in range(1, capacity + 1)])
    least, first = np.zeros(capacity + 1), list(range(capacity + 1))
    for rest in range(1, capacity + 1):
        least[rest] = padding[rest]
        if rest > 1:
            cost = padding[rest - 1 : 0 : -1] + least[1:rest] + price  # the longest first piece first
            k = int(np.argmin(cost))
            if cost[k] < least[rest]:
                least[rest], first[rest] = cost[k], rest - 1 - k
    return first


def cut(tokens: int, capacity: int = CAPACITY, price: float = PRICE) -> list[int]:
    """The lengths of a document's pieces, in order."""
    first, out = plan(capacity, price), [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        out.append(first[rest])
        rest -= first[rest]
    return out


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence (numbered from 0; -1: it stays open) and its place there. A sequence takes as many pieces as its class says, in their order."""
    wanted = capacity // np.maximum(lengths, 1)
    order = np.argsort(wanted, kind="stable")
    j, sizes = wanted[order], lengths[order]
    _, at, counts = np.unique(j, return_index=True, return_counts=True)
    rank, n = np.arange(len(j)) - np.repeat(at, counts), np.repeat(counts, counts)
    full = rank < n // j * j
    first = full & (rank % j == 0)
    sequence = np.where(full, np.cumsum(first) - 1, -1)
    before = np.cumsum(sizes) - sizes
    offset = np.where(full, before - (before[first][sequence] if first.any() else 0), 0)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return sequence[back], offset[back]


_ENCODINGS: dict = {}


def _encoding(shared: Broadcast):
    """One encoder a worker and file."""
    import tiktoken

    key, text = shared.value
    if key not in _ENCODINGS:
        file = json.loads(text)
        before = file["pre_tokenizer"]
        if file["model"]["type"] != "BPE" or file["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("a plain byte-level BPE is needed")
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[key]


def filled(docs: DataFrame, path: str, capacity: int = CAPACITY, price: float = PRICE, column: str = "text") -> DataFrame:
    """A row a piece: the columns of its document but the text, and ADDED. sequence_id and offset are null for pieces that stay open."""
    new = T.StructType.fromDDL(ADDED)
    kept = [f for f in docs.schema.fields if f.name != column and f.name not in new.names]
    names = [f.name for f in kept]
    with open(path, encoding="utf-8") as file:
        text = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = _encoding(shared).encode, TaskContext.get().partitionId()
        shape = None
        held, sequences, places = None, worker << 38, worker << 38

        def dealt(rows: pa.Table, final: bool = False) -> tuple[pa.Table, pa.Table]:
            """The rows of filled sequences (all, if final), and those that stay open."""
            nonlocal sequences
            sequence, offset = fill(rows["length"].to_numpy(), capacity)
            full = sequence >= 0
            at = rows.schema.get_field_index("sequence_id")
            rows = rows.set_column(at, "sequence_id", pa.array(sequence + sequences, pa.int64(), mask=~full)).set_column(at + 1, "offset", pa.array(offset, pa.int64(), mask=~full))
            sequences += int(sequence.max(initial=-1)) + 1
            return (rows, rows.slice(0, 0)) if final else (rows.filter(pa.array(full)), rows.filter(pa.array(~full)))

        for whole in batches:
            for start, end in slices(whole.column(len(names))):
                batch = whole.slice(start, end - start)
                at, starts, lengths, blobs, tokens = [], [], [], [], []
                for i, value in enumerate(batch.column(len(names)).to_pylist()):
                    ids = np.array([*encode(value or "", allowed_special="all"), END], "<u4")
                    packed, begun = ids.tobytes(), 0
                    for length in cut(len(ids), capacity, price):
                        at.append(i)
                        starts.append(begun)
                        lengths.append(length)
                        blobs.append(packed[4 * begun : 4 * (begun + length)])
                        tokens.append(len(ids))
                        begun += length
                number = pa.int64()
                none = pa.nulls(len(at), number)
                own = pa.Table.from_batches([batch]).select(range(len(names))).take(pa.array(at, number))
                rows = pa.Table.from_arrays(
                    [*own.columns, pa.array(starts, number), pa.array(lengths, number), pa.array(blobs, pa.binary()), pa.array(tokens, number), none, none, pa.array(range(places, places + len(at)), number)],
                    names=[*names, *new.names],
                )
                shape, places = rows.schema, places + len(at)
                out, held = dealt(pa.concat_tables([held, rows.cast(held.schema)]) if held is not None else rows)
                yield from out.combine_chunks().to_batches()
                held = held.combine_chunks()
        if shape is not None and len(held):
            yield from dealt(held, final=True)[0].combine_chunks().to_batches()

    given = "_given"
    while given in names:
        given += "_"
    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{column}`").alias(given)).mapInArrow(run, T.StructType([*kept, *new]))


def _by_class(values: dict[int, int], of: Column) -> Column:
    """The value of a class, of which there are few."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), of)


def first_fit(sizes: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[int, int]]:
    """For each of a few things the sequence that it shares with others, and its place there: the largest first, each where it fits first."""
    used: list[int] = []
    out = {}
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = next((k for k, u in enumerate(used) if u + size <= capacity), len(used))
        if k == len(used):
            used.append(0)
        out[key] = (k, used[k])
        used[k] += size
    return out


def finished(pieces: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """pieces (of `filled`, some columns perhaps replaced) with a sequence and a place for all, without `_place`.

    A sequence_id is unique, not gapless: it tells the round, and the worker or the class and bucket, that filled the sequence.
    """
    pieces = settled(pieces, folder, "pieces")
    done, waiting = [pieces.where(F.col("sequence_id").isNotNull())], pieces.where(F.col("sequence_id").isNull())
    kind = F.expr(f"cast({capacity} div length as int)")
    for turn in range(1, 8):
        counts = {r["kind"]: r["n"] for r in waiting.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}  # a row a class
        if not counts:
            break
        buckets = {j: -(-n // max(BUCKET, FILLED * j)) for j, n in counts.items()}
        names = {j: k for k, j in enumerate(sorted(counts))}
        group = [F.col("_kind"), F.col("_bucket")]
        nth, bin_ = F.row_number().over(Window.partitionBy(*group).orderBy("_place")) - 1, F.expr("_nth div _kind")
        within = Window.partitionBy(*group, "_bin").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        dealt = (
            waiting.withColumn("_kind", kind).withColumn("_bucket", F.pmod(F.xxhash64("_place", F.lit(turn)), _by_class(buckets, F.col("_kind"))))
            .withColumn("_nth", nth).withColumn("_n", F.count("*").over(Window.partitionBy(*group))).withColumn("_bin", bin_)
            .withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
        )
        number = F.shiftleft(F.lit(turn).cast("long"), 60) + F.shiftleft(_by_class(names, F.col("_kind")).cast("long"), 50) + F.shiftleft(F.col("_bucket").cast("long"), 24) + F.col("_bin")
        full = F.col("_bin") < F.expr("_n div _kind")
        dealt = settled(dealt.withColumn("sequence_id", F.when(full, number)).drop("_nth", "_n", "_bin", "_bucket"), folder, f"round{turn}")
        done.append(dealt.where(F.col("sequence_id").isNotNull()).drop("_kind"))
        waiting = dealt.where(F.col("sequence_id").isNull())
        if max(buckets.values()) == 1:  # what is left is less than a sequence a class
            sizes = {r["_kind"]: r["n"] for r in waiting.groupBy("_kind").agg(F.sum("length").alias("n")).collect()}
            if sizes:
                shared = first_fit(sizes, capacity)
                last = F.shiftleft(F.lit(turn).cast("long"), 60) + F.shiftleft(F.lit(1023).cast("long"), 50) + _by_class({j: s for j, (s, _) in shared.items()}, F.col("_kind"))
                done.append(waiting.withColumn("sequence_id", last).withColumn("offset", F.col("offset") + _by_class({j: o for j, (_, o) in shared.items()}, F.col("_kind"))).drop("_kind"))
            break
        waiting = waiting.drop("_kind").withColumn("offset", F.lit(None).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more.select(*out.columns))
    return out.drop("_place")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, price: float = PRICE, column: str = "text", folder: str | None = None) -> DataFrame:
    """A row a piece: the columns of its document but the text; start, length, ids, doc_tokens; sequence_id, offset."""
    return finished(filled(docs, path, capacity, price, column), folder or scratch(docs.sparkSession), capacity)


def unpacked(ids: Column | str) -> Column:
    """An array of the numbers that are packed as 32 bits each, the lowest byte first."""
    text = F.hex(ids)
    at = F.sequence(F.lit(1), F.length(text) - 7, F.lit(8))
    pair = lambda p, k: F.substr(text, p + 2 * k, F.lit(2))
    return F.when(F.length(text) > 0, F.transform(at, lambda p: F.conv(F.concat(*[pair(p, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row a sequence of `pack`: sequence_id, ids (packed, of all pieces in their order), lengths (where attention ends), padding (none at a power of two)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"), F.col("parts.length").alias("lengths"),
    )
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("padding", F.when(total.bitwiseAND(total - 1) == 0, F.lit(0).cast("long")).otherwise(F.lit(capacity) - total))


def op11_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    pieces = filled(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("byte_bpe_50k.json"))
    slim = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "_place")
    return finished(slim, scratch(spark))
