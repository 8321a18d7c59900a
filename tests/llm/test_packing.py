import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing

PATH = packing.public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids():
    library = Tokenizer.from_file(PATH)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


def whole(rows, capacity):
    """Checks that each sequence is filled gaplessly within its capacity, and gives the pieces by sequence."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by


def padding(by, capacity):
    totals = [sum(n for _, n in parts) for parts in by.values()]
    return sum(capacity - t for t in totals if t & (t - 1)) / sum(totals)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1024])
def test_plan_is_least(capacity):
    pad = lambda n: capacity / (capacity // n) - n
    least = [0.0]
    for rest in range(1, min(capacity, 130) + 1):
        least.append(min([pad(rest), *(pad(n) + least[rest - n] + packing.PRICE for n in range(1, rest))]))
        lengths = packing.cut(rest, capacity)
        assert sum(lengths) == rest and min(lengths) > 0
        assert sum(map(pad, lengths)) + packing.PRICE * (len(lengths) - 1) == pytest.approx(least[rest])
    assert packing.cut(3 * capacity, capacity) == [capacity] * 3


def test_fill_takes_a_fixed_number():
    lengths = np.random.default_rng(1).integers(1, 1025, 5000)
    sequence, offset = packing.fill(lengths)
    for s in set(sequence[sequence >= 0].tolist()):
        rows = np.flatnonzero(sequence == s)
        assert len(rows) == 1024 // lengths[rows[0]] and len(set(1024 // lengths[rows])) == 1
        assert (offset[rows] == np.cumsum(lengths[rows]) - lengths[rows]).all() and lengths[rows].sum() <= 1024
    for j in set((1024 // lengths).tolist()):
        assert ((1024 // lengths[sequence < 0]) == j).sum() == (1024 // lengths == j).sum() % j
    assert len(packing.fill(np.array([], np.int64))[0]) == 0


def test_first_fit():
    shared = packing.first_fit({1: 1000, 2: 500, 3: 400, 4: 24, 5: 100})
    assert shared == {1: (0, 0), 2: (1, 0), 3: (1, 500), 5: (1, 900), 4: (0, 1000)}


CASES = ["", None, "a", "it's  a\n\n test 123 <|endoftext|> x", "don't  <|endoftext|>", "é日本語 🙂 \x00\x85 　", " " * 3000, "word " * 5000, "a" * 4000, "x\n" * 2000, "^!" * 1500]


def test_equals_the_library(spark, docs, ids, tmp_path):
    rows = [(i % 9, t) for i, t in enumerate(CASES * 3)] + [(None, "no id"), (3, "no id")]
    frame = docs(rows).withColumnRenamed("n_chars", "offset")  # a clashing name
    got = packing.pack(frame, PATH, folder=f"file://{tmp_path}/pack").collect()
    by = whole(got, 1024)
    assert sum(r.length for r in got) == sum(len(ids(t)) for _, t in rows)
    wanted = sorted((repr(i), s, n, tuple(p)) for i, t in rows for p, s, n in [(ids(t)[s : s + n], s, n) for s, n in zip(np.cumsum([0, *packing.cut(len(ids(t)))]).tolist(), packing.cut(len(ids(t))), strict=False)])
    assert sorted((repr(r.doc_id), r.start, r.length, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == wanted
    assert {"doc_id", "lang", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"} == set(got[0].asDict())
    assert len(by) >= 1


def test_many_open_pieces(spark, docs, tmp_path, monkeypatch):
    """Several rounds of buckets; a third of all rows has one id and text."""
    monkeypatch.setattr(packing, "BUCKET", 16)
    monkeypatch.setattr(packing, "FILLED", 1)
    rows = [(7, "same words here")] * 300 + [(i, "w " * (i * 37 % 1500)) for i in range(600)]
    got = packing.pack(docs(rows).repartition(8), PATH, folder=f"file://{tmp_path}/pack").drop("ids").collect()
    by = whole(got, 1024)
    assert padding(by, 1024) < 0.03
    assert len(by) < 1.03 * sum(r.length for r in got) / 1024 + 2
    turns = {r.sequence_id >> 60 for r in got}
    assert {1, 2} <= turns or {0, 1, 2} <= turns


def test_sequences(spark, docs, tmp_path):
    pieces = packing.pack(docs([(i, "a b c " * i) for i in range(60)]), PATH, 256, folder=f"file://{tmp_path}/pack")
    rows = packing.sequences(pieces, 256).withColumn("numbers", packing.unpacked("ids")).collect()
    held = {}
    for r in pieces.collect():
        held.setdefault(r.sequence_id, []).append((r.offset, np.frombuffer(r.ids, "<u4").tolist()))
    assert len(rows) == len(held)
    for r in rows:
        wanted = [i for _, part in sorted(held[r.sequence_id]) for i in part]
        assert r.numbers == wanted and sum(r.lengths) == len(wanted)
        n = len(wanted)
        assert r.padding == (0 if n & (n - 1) == 0 else 256 - n)


def test_empty(spark, docs, tmp_path):
    assert packing.pack(docs([]), PATH, folder=f"file://{tmp_path}/pack").collect() == []


def test_query(spark, small, ids):
    got = packing.op11_harmonic_packing(spark, small).collect()
    by = whole(got, 1024)
    assert padding(by, 1024) < 0.02
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        wanted, at = ids(d.text), 0
        for r in sorted(parts.pop(d.doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(wanted)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(wanted[r.start : at], "<u4").tobytes())
        assert at == len(wanted)
    assert not parts
