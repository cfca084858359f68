"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.labelled import held_out, teaching_ids, texts_of
from tallyline.llm.quality import sigmoid

U64 = np.uint64
BITS = 20  # hashed words and word beginnings
PREFIXES = (4, 5, 6)  # bytes of word beginnings that count beside whole words
RATES = (1 / 200, 1 / 100, 1 / 50)  # shares of a text's words from which a word has further features
LEVELS = len(RATES) + 1
RARE, SURE = 5, 5.0  # confirmed texts a feature must occur in, and standard errors by which it must be more frequent there
MODELS, STEPS, RATE = 3, 400, 0.05
DECAY = 1e-5


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of all words and word beginnings, in any order and with repeats, and the number of words by row."""
    low = T.LOWER[data]
    hashes, starts, firsts = T.words(data, offsets, T.ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(firsts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    up, down = T.powers(len(data))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(T.BYTE_CODES[low] * up)])
    outside = np.append(~T.ALNUM[low], True)
    stops = np.flatnonzero(outside)
    ends = np.minimum(stops[np.searchsorted(stops, starts)], offsets[1:][row])
    rows, found = [row], [hashes]
    for size in PREFIXES:
        at = np.flatnonzero(ends - starts >= size)
        s = starts[at]
        rows.append(row[at])
        found.append(T.mix((sums[s + size] - sums[s]) * down[s] + U64(size)))
    return np.concatenate(rows), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64), np.diff(firsts)


def graded(row: np.ndarray, word: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature: one for each distinct word of a row, and one more for each rate its share of the row reaches."""
    pairs, counts = np.unique((row << BITS) | word, return_counts=True)
    row, word = pairs >> BITS, pairs & ((1 << BITS) - 1)
    share = counts / n_words[row]
    at = [np.arange(len(pairs)), *(np.flatnonzero(share >= rate) for rate in RATES)]
    return np.concatenate([row[i] for i in at]), np.concatenate([word[i] * LEVELS + level for level, i in enumerate(at)])


@dataclass
class ToxicityModel:
    features: np.ndarray  # those with a weight, ascending
    weights: np.ndarray
    bias: float

    def score_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, word, n_words = words_of(data, offsets)
        known = np.zeros(1 << BITS, dtype=bool)
        known[self.features // LEVELS] = True
        kept = known[word]
        row, feature = graded(row[kept], word[kept], n_words)
        at = np.searchsorted(self.features, feature)
        found = np.append(self.features, -1)[at] == feature
        return sigmoid(np.bincount(row[found], weights=self.weights[at[found]], minlength=len(offsets) - 1) + self.bias)


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """The features that get a weight, from the numbers of positive and unlabelled texts that have each.

    A feature's share among negatives is its share in unlabelled text less what the positives in there account for.
    """
    share_p, share_u = in_p / max(n_p, 1), in_u / max(n_u, 1)
    share_n = np.maximum((share_u - prior * share_p) / (1 - prior), 0)
    error = np.maximum(share_p * (1 - share_p), 1 / max(n_p, 1)) / max(n_p, 1) + np.maximum(share_n * (1 - share_n), 1 / max(n_u, 1)) / max(n_u, 1)
    return np.flatnonzero((in_p >= RARE) & (share_p - share_n >= SURE * np.sqrt(error)))


def fit_nnpu(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, n_features: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier with the non-negative risk estimator under the logistic loss.

    The risk of unlabelled text as negatives, less the positives' share in it, estimates the negatives' risk. Where that
    falls below zero the model has begun to learn the unlabelled sample by heart, and the step goes back instead.
    Each model leaves out a random fifth of the unlabelled rows.
    """
    rng = np.random.default_rng(seed)
    unlabelled = ~positive & (rng.random(len(positive)) >= 0.2)
    n_p, n_u = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, STEPS + 1):
        p = sigmoid(np.bincount(row, weights=w[feature], minlength=len(positive)) + b)
        risk_u = -np.log(1 - p[unlabelled] + 1e-12).mean() if unlabelled.any() else 0.0
        risk_p = -np.log(1 - p[positive] + 1e-12).mean()
        negative = np.where(unlabelled, p / n_u, 0) - prior * np.where(positive, p / n_p, 0)
        if risk_u - prior * risk_p >= 0:
            error = negative - prior * np.where(positive, (1 - p) / n_p, 0)
        else:
            error = -negative
        g = np.append(np.bincount(feature, weights=error[row], minlength=n_features) + DECAY * w, error.sum())
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def sample_features(rows: DataFrame) -> pa.Table:
    """The label and the features (a list) of a bounded sample (label, text)."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(1)):
                row, feature = graded(*words_of(data, offsets))
                by = np.argsort(row, kind="stable")
                counts = np.bincount(row, minlength=last - first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(feature[by].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["label", "x"])

    return rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, x array<int>").orderBy(F.xxhash64("x"), "label").toArrow()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 3_000, unlabelled: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``positives`` confirmed rows and ``unlabelled`` documents whose labels are not looked at.

    Both samples are the first in the order of the ids' hashes, outside the held-out fold. The class prior is the share
    of label 1 among all labelled rows outside that fold. Without a confirmed text every text scores next to 0.
    """
    rows = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label).isNotNull())
    prior = rows.agg(F.avg((F.col(label) == 1).cast("double")).alias("prior")).first()["prior"]
    known = teaching_ids(labels, label, positives, id_col, value=1)
    others = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col).orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(unlabelled)
    both = texts_of(docs, known, id_col, text_col).union(texts_of(docs, others.withColumn("label", F.lit(0)), id_col, text_col))
    sample = sample_features(both)
    positive = sample.column("label").to_numpy() == 1
    if not prior or not positive.any():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -10.0)
    prior = min(max(prior, 0.001), 0.9)
    counts = np.zeros((2, LEVELS << BITS), dtype=np.int64)
    parts, at = [], 0
    for chunk in sample.column("x").chunks:
        sizes, feature = np.diff(chunk.offsets.to_numpy()), chunk.flatten().to_numpy()
        row = np.repeat(np.arange(at, at + len(chunk), dtype=np.int32), sizes)
        for kind in (0, 1):
            counts[kind] += np.bincount(feature[positive[row] == kind], minlength=LEVELS << BITS)
        parts.append((row, feature))
        at += len(chunk)
    used = telling(counts[1], counts[0], int(positive.sum()), int((~positive).sum()), prior)
    number = np.full(LEVELS << BITS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    pairs = [(row[k], number[feature[k]]) for row, feature in parts for k in [number[feature] >= 0]]
    row, feature = (np.concatenate([p[i] for p in pairs]).astype(np.int64) for i in (0, 1))
    models = [fit_nnpu(row, feature, positive, prior, len(used), seed) for seed in range(MODELS)]
    return ToxicityModel(used, np.mean([w for w, _ in models], axis=0), float(np.mean([b for _, b in models])))
