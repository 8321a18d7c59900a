"""Toxic passages by maximum-scoring segments of token log-odds.

Features are tokens (runs of letters, lower case) and their stems of 4 to 7 letters. A
feature's log-odds compare its rate in toxic and in clean texts, under a Dirichlet prior, less
`CAUTION` standard errors, which count texts and not tokens, as words come in clusters. A token
scores its best feature; tokens without a positive one are neutral and score -DRIFT. Ruzzo and Tompa's scan finds all maximal
segments of a text in linear time. By Karlin and Altschul, the best of n neutral tokens
exceeds S with 1 - exp(-K n exp(-lambda S)): lambda solves sum p exp(lambda s) = 1 over the
clean texts' tokens, and K is its maximum-likelihood value over clean texts' best
segments. A segment is significant if lambda S > ln(K n); the excesses of all of these
make the text's evidence (less ln r! for r of them), and a logistic curve turns it into a score.

Learned from at most `SAMPLE` labelled rows of either label (a documented bound, drawn by a
hash of the id from all rows), without the held-out ones. Near copies among these, told by
their least shingle, share the weight of one text. The curve is fitted on texts whose own half
of the sample was left out of the log-odds.

Defined results: null and empty texts have no tokens and the least evidence; labels that
are null, or whose document is missing, teach nothing, and a document with several labels counts as
toxic if one says so; with only one label to learn from every score is 0; repeated rows
and equal texts are scored alike; of features with one score the longer is as good; columns named as the new ones give way to
them; an empty table gives an empty result. Whole texts are scanned, of any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, scratch, settled, table, with_results
from plumbline.llm.minhash import shingles

SAMPLE = 8000
#: Prior tokens and texts a feature and label, standard errors taken off, score of a neutral token, least texts of a feature.
PRIOR, CAUTION, DRIFT, LEAST = 0.5, 2.0, 0.05, 2.5
STEMS = (4, 5, 6, 7)
#: Tokens whose scores a worker remembers; it forgets all and goes on at that number.
MEMORY = 500_000
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    rate: float = 1.0
    k: float = 1.0
    drift: float = DRIFT
    #: The curve: 1 / (1 + exp(-(a + b * evidence))); a of minus infinity scores everything 0.
    a: float = -math.inf
    b: float = 0.0


def segments(scored: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal segments (first token, last token, score), given the places and scores of the positive tokens.

    A run of neutral tokens is one negative number, so the scan takes a step for each positive token.
    """
    # Each candidate: first, last, the cumulative sum before it and after it.
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, None
    for place, score in scored:
        if at is not None:
            total -= drift * (place - at - 1)
        first, left, right = place, total, total + score
        at, total = place, right
        last = place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, left, right))
    return [(first, last, right - left) for first, last, left, right in stack]


class Scorer:
    """The score of a token's best feature, 0 if none is known; remembers a bounded number of tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.memory = scores, {}

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Places and scores of the tokens that aren't neutral."""
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        for token in set(tokens).difference(memory):
            memory[token] = max((self.scores.get(f, 0.0) for f in features(token)), default=0.0)
        return [(i, s) for i, s in enumerate(map(memory.__getitem__, tokens)) if s]


def features(token: str) -> list[str]:
    return [token, *(f"{token[:k]}-" for k in STEMS if len(token) >= k)]


def passages(model: Model, text: str | None, scorer: Scorer | None = None) -> tuple[int, float, list[tuple[int, int, float]]]:
    """Tokens, evidence, and the significant passages by token places, best first."""
    tokens = TOKEN.findall((text or "").lower())
    found = segments((scorer or Scorer(model.scores)).hits(tokens), model.drift)
    bar = math.log(max(model.k * len(tokens), 1e-300))
    over = sorted(((model.rate * s - bar, a, b) for a, b, s in found), reverse=True)
    good = [x for x in over if x[0] > 0]
    if good:
        evidence = max(sum(x[0] for x in good[:r]) - math.lgamma(r + 1) for r in range(1, len(good) + 1))
    else:
        evidence = over[0][0] if over else -max(bar, 0.0)
    return len(tokens), evidence, [(a, b, x) for x, a, b in good]


def chance(model: Model, evidence: float) -> float:
    if model.a == -math.inf:
        return 0.0
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, model.a + model.b * evidence))))


#: Sums a feature: tokens and texts, by half of the sample and label.
SUMS = ("t00", "t01", "t10", "t11", "d00", "d01", "d10", "d11")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, and the weighted numbers of its tokens and texts; the feature '' stands for all tokens."""
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(8))

    def out() -> pd.DataFrame:
        made = pd.DataFrame(np.stack(list(totals.values())), columns=SUMS)
        made.insert(0, "feature", list(totals))
        totals.clear()
        return made

    for batch in batches:
        for text, column, weight in zip(batch["text"], batch["half"] * 2 + batch["toxic"], batch["weight"], strict=True):
            tokens = Counter(TOKEN.findall(text.lower()))
            found: Counter[str] = Counter()
            for token, n in tokens.items():
                for feature in features(token):
                    found[feature] += n
            every = 0.0
            for feature, n in found.items():
                row = totals[feature]
                n = 1 + math.log(n)  # a word repeated over and over says little more
                every += n * (feature in tokens)
                row[column] += weight * n
                row[column + 4] += weight
            totals[""][[column, column + 4]] += weight * every, weight
        if len(totals) > 200_000:
            yield out()
    if totals:
        yield out()


def _log_odds(tokens: np.ndarray, texts: np.ndarray, every: np.ndarray) -> np.ndarray:
    """For (features, 2) numbers by label: caution taken off."""
    rates = np.log((tokens + PRIOR) / (every + 1))
    return rates[:, 1] - rates[:, 0] - CAUTION * np.sqrt((1 / (texts + PRIOR)).sum(axis=1))


def _model(names: list[str], sums: np.ndarray) -> Model:
    """Log-odds, drift and lambda from sums of (features, tokens or texts, label)."""
    whole = names.index("") if "" in names else None
    if whole is None:
        return Model({})
    every = sums[whole, 0]
    odds = _log_odds(sums[:, 0], sums[:, 1], every)
    good = [i for i in np.flatnonzero((odds > 0) & (sums[:, 1, 1] >= LEAST)) if i != whole]
    scores = odds[good]
    shares = (sums[good, 0, 0] + PRIOR) / (every[0] + 1)
    words = np.array([not names[i].endswith("-") for i in good], bool)  # stems count their words again
    drift = max(DRIFT, 2 * float((scores * shares)[words].sum()))
    return Model({names[i]: float(odds[i]) for i in good}, _rate(scores, shares, drift) if len(good) else 1.0, 1.0, drift)


def _rate(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """lambda of Karlin and Altschul, by bisection; shares: of each feature among the clean texts' tokens."""
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        grown = float((shares * (np.exp(mid * scores) - 1)).sum()) + math.exp(-mid * drift)
        low, high = (mid, high) if grown < 1 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folder: str | None = None) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({})
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) < share * 1_000_003)
    # At most about 2 * sample ids: small enough to send to all tasks, so that no text is shuffled to be picked.
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def least(batch: list[str | None]) -> list[pa.Array]:
        return [pa.array([int(x[0] >> np.uint64(1)) if len(x := shingles(t)) else 0 for t in batch], pa.int64())]

    drawn = settled(with_results(texts, least, "family long", keep_text=True), folder, "sample")
    families = drawn.groupBy("family").agg(F.count("doc_id").alias("many"))
    weighed = drawn.join(F.broadcast(families), "family").select(
        "text", "toxic", (F.col("family") % 2).cast("int").alias("half"), (1.0 / F.col("many")).alias("weight"),
    )
    counted = (
        weighed.mapInPandas(_counts, "feature string, " + ", ".join(f"{c} double" for c in SUMS))
        .groupBy("feature").agg(*[F.sum(c).alias(c) for c in SUMS])
        .where(F.col("d01") + F.col("d11") >= LEAST).toPandas()
    )
    names, sums = counted["feature"].tolist(), counted[list(SUMS)].to_numpy().reshape(-1, 2, 2, 2)  # tokens or texts, half, label
    whole = _model(names, sums.sum(axis=2))
    halves = [_model(names, sums[:, :, 1]), _model(names, sums[:, :, 0])]  # each half by the other's log-odds
    shared = spark.sparkContext.broadcast(halves)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(h.scores) for h in shared.value]
        for batch in batches:
            rows = []
            for text, half in zip(batch["text"], batch["half"], strict=True):
                found = TOKEN.findall(text.lower())
                rows.append((len(found), [s for _, _, s in segments(scorers[half].hits(found), shared.value[half].drift)]))
            yield pd.DataFrame({"n": [r[0] for r in rows], "parts": [r[1] for r in rows], "half": batch["half"], "toxic": batch["toxic"], "weight": batch["weight"]})

    seen = weighed.mapInPandas(best, "n long, parts array<double>, half int, toxic int, weight double").toPandas()  # one row for each of the sample
    top = np.array([max(p, default=0.0) for p in seen["parts"]])
    rates = np.array([h.rate for h in halves])[seen["half"]]
    clean = (seen["toxic"] == 0).to_numpy() & (seen["n"] > 0).to_numpy()
    weight = seen["weight"].to_numpy()
    k = float(weight[clean].sum() / max((weight * seen["n"] * np.exp(-rates * top))[clean].sum(), 1e-12)) if clean.any() else 1.0
    evidence = []
    for tokens_, parts, rate in zip(seen["n"], seen["parts"], rates, strict=True):
        bar = math.log(max(k * tokens_, 1e-300))
        over = sorted((rate * s - bar for s in parts), reverse=True)
        good = [x for x in over if x > 0]
        evidence.append(max((sum(good[:r]) - math.lgamma(r + 1) for r in range(1, len(good) + 1)), default=over[0] if over else -max(bar, 0.0)))
    toxic = seen["toxic"].to_numpy()
    true = [sizes[t] / max(weight[toxic == t].sum(), 1e-9) for t in (0, 1)]
    a, b = _curve(np.array(evidence), toxic, weight, true[1], true[0])
    return Model(whole.scores, whole.rate, k, whole.drift, a, b)


def _curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray, up: float, down: float) -> tuple[float, float]:
    """Logistic regression by Newton's method, weighed back to the labels' true shares; evidence beyond 30 says no more."""
    x = np.clip(evidence, -30, 30)
    w = weight * np.where(toxic == 1, up, down)
    w = w / w.sum() * len(w)
    a, b = 0.0, 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (toxic - p)).sum(), (w * (toxic - p) * x).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-9, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 1e-6))


def _damped(evidence: float) -> float:
    """Beyond what the curve was fitted on evidence grows by its logarithm, so that stronger texts still score higher."""
    return evidence if evidence <= 30 else 30 + math.log1p(evidence - 30)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs with score, predicted, n_tokens and passages (first and last token, bits over the bar)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept: dict[str, Scorer] = {}
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("excess", pa.float64())]))

    def scored(texts: list[str | None]) -> list[pa.Array]:
        model = shared.value
        scorer = kept.setdefault("scorer", Scorer(model.scores))  # one for all batches of a task
        found = [passages(model, t, scorer) for t in texts]
        chances = [chance(model, _damped(e)) for _, e, _ in found]
        return [
            pa.array(chances, pa.float64()),
            pa.array([int(c >= 0.5) for c in chances], pa.int32()),
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([[{"first": a, "last": b, "excess": x} for a, b, x in p] for _, _, p in found], spans),
        ]

    return with_results(docs, scored, "score double, predicted int, n_tokens long, passages array<struct<first: long, last: long, excess: double>>", keep_text=keep_text)


def op4_segment_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_tokens", F.size("passages").cast("long").alias("n_passages"))
