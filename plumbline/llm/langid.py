"""Language identification by multilingual mixture inference.

A document is a mixture: each word comes from language l with proportion pi_l, and the
likelihood of a word is that of its letter trigrams, edges included. Expectation-maximisation
estimates the proportions. The set of languages is selected by penalised likelihood: of the
nested sets of the k likeliest languages the one with the greatest

    log-likelihood - PENALTY * (k - 1) * ln(words)

wins; the prediction is the set's largest proportion, which is also the score.

The trigram tables are learned from at most `SAMPLE` rows a language (a documented bound; drawn by a
hash of the id over all rows, so the share is the same everywhere), counted in tasks and
summed by key; the model has BUCKETS numbers a language, whatever the input's size.

Defined results: `und` with score 0 for a null text, a text without a letter, and for all
texts if there is nothing to learn from; rows with a null language teach nothing; repeated
rows are scored alike; equal proportions go to the first language by name; an empty
table gives an empty result; columns named lang_pred or score give way to the new ones. Whole texts are scored, short ones
together; a text beyond `LONG` characters is read in pieces in each round of expectation-maximisation, so
memory stays bounded whatever its length (a word longer than a piece counts as several).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, small_batches, table, with_results

BUCKETS = 1 << 16
SAMPLE = 2000
#: Pseudo-counts a trigram, rounds of expectation-maximisation, price of one more language, characters held at a time, and of a text that is read in pieces.
PRIOR, ROUNDS, PENALTY, CHUNK, LONG = 0.5, 12, 2.0, 1 << 20, 1 << 22


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: (BUCKETS, languages) log-probabilities
    scores: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words of the texts, where each word's begin, and the text each word is in."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    letter = _letters()[codes]
    at = np.flatnonzero(letter)  # a trigram around each letter; lone spaces have none
    a = np.where(letter[at - 1], codes[at - 1], 32)
    c = np.where(letter[at + 1], codes[at + 1], 32)
    key = (codes[at] * np.uint32(0x9E3779B1)) ^ (a * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    key = ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    begins = np.flatnonzero(a == 32)  # letters before which there is no letter
    owner = np.searchsorted(np.cumsum(lengths), at[begins] - 1, side="right")
    return key.astype(np.int64), begins, owner


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            texts = [piece for text in group["text"] for piece in (_pieces(text) if len(text) > LONG else (text,))]
            for i, j in _chunks(texts):
                keys = _trigrams(texts[i:j])[0]
                totals[lang] = totals.get(lang, 0) + np.bincount(keys, minlength=BUCKETS)
    for lang, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": seen, "n": counts[seen]})


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from docs (doc_id, text, lang), without the held-out rows."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))]), F.col("lang"))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003
    counted = (
        labelled.where(picked & F.col("text").isNotNull()).select("lang", "text").mapInPandas(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = tuple(sorted(sizes))
    counts = np.zeros((BUCKETS, len(languages)))
    counts[counted["bucket"].to_numpy(), counted["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()] = counted["n"]
    scores = np.log((counts + PRIOR) / (counts.sum(axis=0) + PRIOR * BUCKETS))
    return Model(languages, scores.astype(np.float32))


def _proportions(likelihood: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over all texts of a chunk at once: each one's proportions and log-likelihood, over its allowed languages."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(ROUNDS):
        share = likelihood * pi.astype(np.float32)[owner]
        share /= share.sum(axis=1, keepdims=True)
        pi = np.add.reduceat(share, starts, axis=0, dtype=np.float64) / sizes[:, None]
    fit_ = np.log((likelihood * pi.astype(np.float32)[owner]).sum(axis=1) + 1e-38)
    return pi, np.add.reduceat(fit_, starts, dtype=np.float64)


def _likelihoods(model: Model, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each word's likelihoods, scaled so that its best language has 1; kept above 1e-18 so that no share vanishes."""
    words = np.add.reduceat(model.scores[keys], begins, axis=0)
    return np.exp(np.maximum(words - words.max(axis=1, keepdims=True), -40))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end at white space where there is some."""
    start = 0
    while start < len(text):
        end = start + CHUNK
        space = text.find(" ", end, end + CHUNK)
        end = len(text) if end >= len(text) else end if space < 0 else space
        yield text[start:end]
        start = end


def infer_long(model: Model, text: str) -> tuple[int, float]:
    """The same for one text, piece by piece: its language (-1: none) and proportion."""
    n = len(model.languages)

    def rows() -> Iterator[np.ndarray]:
        for piece in _pieces(text):
            keys, begins, _ = _trigrams([piece])
            if len(begins):
                yield _likelihoods(model, keys, begins)

    size = sum(len(r) for r in rows()) if n else 0
    if not size:
        return -1, 0.0

    def proportions(allowed: np.ndarray) -> tuple[np.ndarray, float]:
        pi = allowed / allowed.sum()
        for _ in range(ROUNDS):
            total = np.zeros(n)
            for r in rows():
                share = r * pi.astype(np.float32)
                total += (share / share.sum(axis=1, keepdims=True)).sum(axis=0, dtype=np.float64)
            pi = total / size
        return pi, sum(float(np.log((r * pi.astype(np.float32)).sum(axis=1) + 1e-38).sum(dtype=np.float64)) for r in rows())

    price = PENALTY * np.log(size + 1)
    pi, full = proportions(np.ones(n))
    ranked = np.argsort(-pi, kind="stable")
    value = sum(float(np.log(r[:, ranked[0]]).sum(dtype=np.float64)) for r in rows())
    best, score = int(ranked[0]), 1.0
    for k in range(2, n + 1):
        if full - price * (k - 1) <= value:
            break
        allowed = np.zeros(n)
        allowed[ranked[:k]] = 1
        p, got = proportions(allowed)
        if got - price * (k - 1) > value:
            value, best, score = got - price * (k - 1), int(p.argmax()), float(p.max())
    return best, score


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its language (-1: none) and that language's proportion."""
    n = len(model.languages)
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    keys, begins, owner = _trigrams(texts)
    if not len(begins) or not n:
        return best, score
    likelihood = _likelihoods(model, keys, begins)
    docs, starts, sizes = np.unique(owner, return_index=True, return_counts=True)
    price = PENALTY * np.log(sizes + 1)
    pi, full = _proportions(likelihood, starts, sizes, np.ones((len(docs), n)))
    ranked = np.argsort(-pi, axis=1, kind="stable")
    logs = np.log(likelihood)
    top = ranked[:, 0]
    one = np.add.reduceat(logs[np.arange(len(logs)), np.repeat(top, sizes)], starts, dtype=np.float64)
    chosen, share, value = top.copy(), np.ones(len(docs)), one.copy()
    # No set does better than all languages: where those don't pay for one more, one language it is.
    for k in range(2, n + 1):
        still = np.flatnonzero(full - price * (k - 1) > value)
        if not len(still):
            break
        allowed = np.zeros((len(still), n))
        np.put_along_axis(allowed, ranked[still, :k], 1, axis=1)
        part = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in still])
        begin = np.concatenate(([0], np.cumsum(sizes[still])[:-1]))
        p, got = _proportions(likelihood[part], begin, sizes[still], allowed)
        got = got - price[still] * (k - 1)
        better = got > value[still]
        at = still[better]
        value[at], chosen[at], share[at] = got[better], p[better].argmax(axis=1), p[better].max(axis=1)
    best[docs], score[docs] = chosen, share
    return best, score


def identify(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs (without texts, unless keep_text) with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scored(batch: list[str | None]) -> list[pa.Array]:
        model, texts = shared.value, [t or "" for t in batch]
        names = np.array([*model.languages, "und"], object)
        short = [t if len(t) <= LONG else "" for t in texts]
        parts = [infer(model, short[i:j]) for i, j in _chunks(short)]
        pred, score = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, int) for k in (0, 1))
        for k, text in enumerate(texts):
            if len(text) > LONG:
                pred[k], score[k] = infer_long(model, text)
        return [pa.array(names[pred], pa.string()), pa.array(score, pa.float64())]

    return with_results(docs, scored, "lang_pred string, score double", keep_text=keep_text)


def op1_mixture_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
