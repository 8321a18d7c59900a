"""Language, toxicity and near duplicates: brute force, held-out accuracy, defined results."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import langid, minhash, toxicity


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = langid.op1_mixture_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert found.count() > 150
    assert found.where(F.col("lang_pred") == F.col("lang")).count() >= 0.98 * found.count()
    assert found.where("not score between 0 and 1").count() == 0


def test_language_edges(spark, docs, small):
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    texts = [None, "", "123 !!", "the and of", "the and of", "die und der nicht " * 60_000, "日本語"]
    table = docs([(i, t) for i, t in enumerate(texts)]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    out = sorted(langid.identify(table, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and [r.score for r in out[:3]] == [0.0] * 3
    assert out[3].lang_pred == out[4].lang_pred == "en" and out[5].lang_pred == "de"
    assert langid.identify(table.limit(0), model).collect() == []
    nothing = langid.fit(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(table, nothing).collect()} == {"und"}


def test_mixture_of_two_languages(spark, small):
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    by = {r.lang: r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 2000").select("lang", "text").collect()}
    best, score = langid.infer(model, [by["en"][:1500] + " " + by["de"][:700], by["en"][:1500]])
    assert model.languages[best[0]] == "en" and 0.55 < score[0] < 0.85 and score[1] > 0.98


def test_mixture_against_brute_force(spark, small):
    """Expectation-maximisation and the choice of the set, text by text and word by word; and the same piece by piece."""
    import math

    import numpy as np

    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    n = len(model.languages)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) between 30 and 1500").select("text").limit(14).collect()]
    texts += [texts[0][:400] + " " + texts[5][:300], texts[1] + " " + texts[7] + " " + texts[9]]
    got = langid.infer(model, texts)

    def expected(text):
        rows = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            keys = langid._trigrams([word])[0]
            logs = [sum(float(model.scores[k, j]) for k in keys) for j in range(n)]
            rows.append([math.exp(max(x - max(logs), -40)) for x in logs])

        def em(allowed):
            pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(n)]
            for _ in range(langid.ROUNDS):
                total = [0.0] * n
                for r in rows:
                    weight = sum(r[j] * pi[j] for j in range(n))
                    total = [t + r[j] * pi[j] / weight for j, t in enumerate(total)]
                pi = [t / len(rows) for t in total]
            return pi, sum(math.log(sum(r[j] * pi[j] for j in range(n)) + 1e-38) for r in rows)

        ranked = sorted(range(n), key=lambda j: -em(range(n))[0][j])
        sets = [(sum(math.log(r[ranked[0]]) for r in rows), ranked[0], 1.0)]
        for k in range(2, n + 1):
            pi, fit = em(ranked[:k])
            sets.append((fit - langid.PENALTY * (k - 1) * math.log(len(rows) + 1), max(range(n), key=lambda j: pi[j]), max(pi)))
        return max(sets, key=lambda s: s[0])

    for k, text in enumerate(texts):
        _, best, share = expected(text)
        assert got[0][k] == best and got[1][k] == pytest.approx(share, abs=2e-3)
        long_best, long_share = langid.infer_long(model, text)
        assert long_best == best and long_share == pytest.approx(got[1][k], abs=1e-4)
    assert np.unique(got[1]).size > 1


def test_long_texts_in_pieces(spark, docs, small, monkeypatch):
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    text = next(r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 3000").collect())
    whole = langid.infer(model, [text])
    monkeypatch.setattr(langid, "CHUNK", 500)
    best, share = langid.infer_long(model, text)
    assert best == whole[0][0] and share == pytest.approx(whole[1][0], abs=1e-3)
    assert langid.infer_long(model, "1 2 3") == (-1, 0.0)


def recursive_segments(scores, offset=0):
    """Ruzzo and Tompa's definition: the best part, then the same left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    n, i = -best[1], -best[2]
    return recursive_segments(scores[:i], offset) + [(offset + i, offset + i + n - 1)] + recursive_segments(scores[i + n :], offset + i + n)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([None, None, None, 1.03, 2.21, 0.57, 3.9]), max_size=18))
def test_segments(values):
    drift = 0.7
    found = toxicity.segments([(i, v) for i, v in enumerate(values) if v], drift)
    assert [(a, b) for a, b, _ in found] == recursive_segments([v or -drift for v in values])
    for a, b, s in found:
        assert s == pytest.approx(sum(v or -drift for v in values[a : b + 1]))


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = toxicity.op4_segment_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("score", "toxic", "predicted").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.93
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(clean)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_edges(spark, docs):
    bad, good = "you stupid {} fool and stupid {} liar", "a calm {} day by {} the sea"
    rows = [(i, (bad if i % 4 == 0 else good).format(i * 7, i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, None), (None, 1), (9999, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    table = docs([(1, None), (2, ""), (3, "stupid stupid fool"), (3, "stupid stupid fool"), (4, "the sea"), (5, "calm " * 100_000)]).withColumn("score", F.lit("x"))
    out = toxicity.score(table, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[3].predicted == 1 and by[3].passages
    assert all(by[i].predicted == 0 for i in (1, 2, 4, 5)) and by[1].n_tokens == 0 and by[5].n_tokens == 100_000
    assert toxicity.score(table.limit(0), model).collect() == []
    one_label = toxicity.fit(docs(rows), labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(table, one_label).collect()} == {0.0}


def components(rows):
    """Brute force over the words themselves."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_of_the_tables(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op2_hamming_join(spark, small).collect()}
    assert got == components(rows)


def test_near_duplicates_of_hot_groups(spark, docs, monkeypatch):
    """Near copies in two families that hang together by a chain, more of them than a block holds."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    r = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    base = r.choices(words, k=120)
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, " ".join(base) + "\n")]
    for k in range(3, 90):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            copy[r.randrange(120)] = r.choice(words)
        rows.append((k, "\t ".join(copy)))
    rows += [(k, " ".join(r.choices(words, k=r.choice([1, 3, 5, 6, 40])))) for k in range(90, 130)]
    rows += [(130, "a b c"), (131, "A  b\tc"), (132, "a b c d"), (133, None), (134, ""), (135, " \n"), (136, "a b c")]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs(rows)).collect()}
    assert got == components(rows)


def test_near_duplicates_edges(spark, docs):
    table = docs([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (8, "x y " * 100_000)]).withColumn("node", F.lit("n")).withColumn("key", F.lit(0))
    out = minhash.near_duplicates(table).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out if r.doc_id) == [(7, 7, True), (7, 7, True), (8, 8, True), (9, 7, False)]
    assert [(r.component_id, r.kept, r.n_shingles) for r in out if r.doc_id is None] == [(None, False, 2)]
    assert minhash.near_duplicates(table.limit(0)).collect() == []


def test_signatures_within_the_guaranteed_distance_share_a_key():
    r = random.Random(3)
    for _ in range(300):
        a = [r.randrange(1 << 16) for _ in range(minhash.SYMBOLS)]
        b = list(a)
        for k in r.sample(range(minhash.SYMBOLS), 11):
            b[k] ^= 1 + r.randrange(65535)
        keys = lambda s: {(c, j, tuple(s[4 * c + i] for i in range(4) if i != j)) for c in range(6) for j in range(4)}
        assert keys(a) & keys(b)


def test_held_out_is_crc32(spark):
    from plumbline.llm.common import held_out

    got = {r.id: r.h for r in spark.range(50).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
