"""Toxicity: a factorization machine over hashed terms.

A document's terms are the beginnings of its words and how dense they are in it. Besides a weight for
every term the machine learns a short vector for each, whose inner products score pairs of terms, such
as an insult next to the mention of a group."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import forget, stored

EDGES = ".,;:!?\"'()[]{}<>|*#$%&@~`^_+=/\\-"
CACHE_WORDS = 300_000
#: Shares of a document's words from which a term counts as dense, each a term of its own.
DENSE = (1 / 512, 1 / 128, 1 / 32)
LEVELS = len(DENSE) + 1


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # hashed terms in use, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    n_buckets: int


def held_out(column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms(word: str, n_buckets: int) -> tuple[int, ...]:
    """First buckets of a word as written between blanks: the word without outer punctuation, in lower
    case, and its first 4 to 7 letters, so that inflections share evidence. The LEVELS - 1 buckets after
    each are for its densities."""
    word = word.strip(EDGES)
    if not word:
        return ()
    names = {f"w:{word}", *(f"p:{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n)}
    return tuple(xxhash.xxh3_64_intdigest(x) % (n_buckets // LEVELS) * LEVELS for x in names)


class _Buckets(dict):
    """Buckets of words; where wanted is given, only those of which it names a level."""

    def __init__(self, n_buckets: int, wanted: dict[int, int] | None = None):
        super().__init__()
        self.n_buckets, self.wanted = n_buckets, wanted
        self.first = None if wanted is None else {b - b % LEVELS for b in wanted}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = terms(word, self.n_buckets)
        if self.first is not None:
            found = tuple(b for b in found if b in self.first)
        self[word] = found
        return found


def _document_terms(text: str | None, buckets: _Buckets) -> list[int]:
    """The document's buckets, or where some are wanted their places among those, in order."""
    words, counts = (text or "").lower().split(), Counter()
    for word, n in Counter(words).items():
        for b in buckets[word]:
            counts[b] += n
    out = [b + level for b, n in counts.items() for level in range(LEVELS) if not level or n >= DENSE[level - 1] * len(words)]
    return sorted(out if buckets.wanted is None else (buckets.wanted[b] for b in out if b in buckets.wanted))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    n_buckets: int = 1 << 22,
    max_terms: int = 8_192,
    min_gain: float = 10.0,
    rank: int = 8,
    visits: int = 120_000,
    seed: int = 7,
) -> Model:
    """Fit on at most max_rows labelled documents (those whose id hashes lowest) that aren't held out.

    Terms are kept if their log-likelihood gain over independence from the label reaches min_gain, the
    best max_terms of them among all documents and again among the documents that hold one of those
    that speak for toxicity: so a term that matters only in company is kept too. What reaches the driver
    is bounded by max_rows * max_terms. Scores are calibrated on learned rows, each by a machine that did
    not learn from it. Rows are gone through 6 to 40 times, so that there are about `visits` in all.

    Labels or ids that are null and documents without a label teach nothing; of repeated labels the
    largest counts. Without learned rows of both kinds nothing can be told apart, and the model scores 0 everywhere."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def read(batches):
        buckets = _Buckets(n_buckets)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "terms": [_document_terms(t, buckets) for t in batch["text"]]})

    train = stored(
        docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text").mapInPandas(read, "toxic int, terms array<int>"),
        "toxic-train",
    )
    n, pos = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not pos or pos == n:
        return Model(np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, rank)), n_buckets)
    known_terms = _telling(train, n, pos, min_gain, max_terms)
    speaking = np.sort([t for t, share in known_terms if share > pos / n])
    if len(speaking):

        def in_company(batches):
            for batch in batches:
                yield batch[[bool(np.isin(t, speaking).any()) for t in batch["terms"]]]

        near = train.mapInPandas(in_company, "toxic int, terms array<int>")
        n_near, pos_near = near.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if 0 < pos_near < n_near:
            known_terms += _telling(near, n_near, pos_near, min_gain, max_terms)
    buckets = np.unique(np.array([t for t, _ in known_terms], dtype=np.int64))

    def narrow(batches):
        for batch in batches:
            kept = [np.searchsorted(buckets, t[np.isin(t, buckets)]) for t in map(np.asarray, batch["terms"])]
            yield pd.DataFrame({"toxic": batch["toxic"], "terms": kept})

    rows = train.mapInPandas(narrow, "toxic int, terms array<int>").toPandas()  # at most max_rows rows
    forget(train)
    # the same rows in the same order, however they were read
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (len(rows["terms"].iat[i]), tuple(rows["terms"].iat[i]), rows["toxic"].iat[i]))]
    y, lists = rows["toxic"].to_numpy(float), [np.asarray(t, dtype=np.int64) for t in rows["terms"]]
    epochs = max(6, min(40, visits // len(y)))
    learned, own, fold = [], np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        if 0 < y[inside].sum() < len(inside):
            machine = _descend([lists[i] for i in inside], y[inside], len(buckets), rank, epochs, seed)
            own[fold == k] = [_margin(*machine, lists[i]) for i in np.flatnonzero(fold == k)]
            learned.append(fold == k)
    slope, shift = _calibrate(own[np.any(learned, axis=0)], y[np.any(learned, axis=0)]) if learned else (1.0, 0.0)
    bias, weights, factors = _descend(lists, y, len(buckets), rank, epochs, seed)
    # the slope goes into the parameters, so that a score is the machine's own
    return Model(buckets, slope * bias + shift, slope * weights, np.sqrt(slope) * factors, n_buckets)


FOLDS = 3


def _telling(rows: DataFrame, n: int, pos: int, min_gain: float, max_terms: int) -> list[tuple[int, float]]:
    """The at most max_terms terms of rows(toxic, terms) with the largest gain, and the toxic share of each."""
    seen = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    share = pos / n
    gain = 2 * (
        part(F.col("p"), F.col("n") * share)
        + part(F.col("n") - F.col("p"), F.col("n") * (1 - share))
        + part(pos - F.col("p"), (n - F.col("n")) * share)
        + part(n - F.col("n") - pos + F.col("p"), (n - F.col("n")) * (1 - share))
    )
    best = seen.withColumn("gain", F.round(gain, 6)).where(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "term").limit(max_terms)
    return [(r.term, r.p / r.n) for r in best.collect()]


def _margin(bias: float, weights: np.ndarray, factors: np.ndarray, at: np.ndarray) -> float:
    own = factors[at]
    return bias + weights[at].sum() + 0.5 * ((own.sum(0) ** 2).sum() - (own**2).sum())


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels, by Newton's method."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * margins).sum() + 1e-3 * (slope - 1), (p - y).sum()])
        curve = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(curve + 1e-6 * np.eye(2), grad)
        slope, shift = max(slope - np.clip(step[0], -1, 1), 0.05), shift - np.clip(step[1], -3, 3)
    return float(slope), float(shift)


def _descend(lists: list[np.ndarray], y: np.ndarray, n_terms: int, rank: int, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) by AdaGrad on the logistic loss, in batches."""
    rng = np.random.default_rng(seed)
    bias, weights, factors = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, rank))
    sum_w, sum_v, sum_b = np.full(n_terms, 1e-2), np.full((n_terms, rank), 1e-2), 1e-2
    size = min(256, max(16, len(y) // 16))

    def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, k], minlength=n) for k in range(rank)], 1)

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            own = order[at : at + size]
            flat = np.concatenate([lists[i] for i in own]).astype(np.int64)
            doc = np.repeat(np.arange(len(own)), [len(lists[i]) for i in own])
            total = summed(doc, factors[flat], len(own))
            squares = np.bincount(doc, (factors[flat] ** 2).sum(1), minlength=len(own))
            margin = bias + np.bincount(doc, weights[flat], minlength=len(own)) + 0.5 * ((total**2).sum(1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
            grad_w = np.bincount(flat, slope[doc], minlength=n_terms) + 1e-3 * weights * len(own) / len(y)
            grad_v = summed(flat, slope[doc, None] * (total[doc] - factors[flat]), n_terms) + 1e-4 * factors
            sum_w += grad_w**2
            sum_v += grad_v**2
            sum_b += slope.sum() ** 2
            weights -= 0.1 * grad_w / np.sqrt(sum_w)
            factors -= 0.05 * grad_v / np.sqrt(sum_v)
            bias -= 0.1 * slope.sum() / np.sqrt(sum_b)
    return bias, weights, factors


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 if score >= threshold).

    Only the text is read. Null and empty texts get the score of a text without known terms; extra
    columns are kept, score and predicted replaced; empty tables give no rows."""

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        known = _cache(model)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            out[i] = _margin(model.bias, model.weights, model.factors, np.array(_document_terms(text, known), dtype=np.int64))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    scored = docs.drop("score", "predicted").withColumn("score", margin(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_CACHES: dict[bytes, _Buckets] = {}


def _cache(model: Model) -> _Buckets:
    """The word cache of this worker process for the model."""
    key = model.buckets.tobytes()
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = _Buckets(model.n_buckets, {int(b): i for i, b in enumerate(model.buckets)})
    return _CACHES[key]
