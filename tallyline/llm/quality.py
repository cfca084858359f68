"""Document quality: random-indexing word vectors, pooled, and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.labelled import held_out, teaching_ids, texts_of

U64 = np.uint64
BUCKETS, DIMS, SPOTS = 1 << 14, 32, 4  # word buckets, vector length, non-zero places of an index vector
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 256, 0.01
FEATURES = 2 * DIMS + 4
SPACE = T.byte_table((0x09, 0x0D), (0x20, 0x20))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and runs of other signs in order, and each row's first one (n + 1 values)."""
    low = T.LOWER[data]
    kind = np.where(T.ALNUM[low], 2, 1).astype(np.int8)
    kind[SPACE[low]] = 0
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    rows = offsets[:-1]
    rows = rows[rows < offsets[1:]]
    begins[rows] = kind[rows] > 0
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), firsts
    up, down = T.powers(len(data))
    codes = np.where(kind > 0, T.BYTE_CODES[low], U64(0)) * up
    return (T.mix(np.add.reduceat(codes, starts) * down[starts]) >> U64(64 - 14)).astype(np.int64), firsts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The non-zero places of every bucket's index vector and their signs (buckets x SPOTS)."""
    draws = T.mix(T.seeds(BUCKETS * SPOTS, 101)).reshape(BUCKETS, SPOTS)
    return (draws % U64(DIMS)).astype(np.int64), np.where(draws >> U64(63), 1, -1).astype(np.int8)


def context_sums(batches):
    """For each bucket met in this task the sum of the index vectors of the words beside it."""
    spots, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIMS, dtype=np.int64)
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in T.slices(batch.column(0)):
            buckets, firsts = tokens(data, offsets)
            if not len(buckets):
                continue
            seen += np.bincount(buckets, minlength=BUCKETS)
            beside = np.ones(len(buckets) - 1, dtype=bool)
            inner = firsts[(firsts > 0) & (firsts < len(buckets))]
            beside[inner - 1] = False
            left, right = buckets[:-1][beside], buckets[1:][beside]
            for a, b in ((left, right), (right, left)):
                for k in range(SPOTS):
                    sums += np.bincount(a * DIMS + spots[b, k], weights=signs[b, k], minlength=BUCKETS * DIMS).astype(np.int64)
    met = np.flatnonzero(seen)
    columns = [pa.array(met.astype(np.int32)), pa.array(seen[met])] + [pa.array(c) for c in sums.reshape(BUCKETS, DIMS)[met].T]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", *(f"v{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of all word buckets (BUCKETS x DIMS), summed over every document.

    The sums are integers, so they do not depend on the order; their number is fixed, whatever the corpus.
    """
    names = [f"v{i}" for i in range(DIMS)]
    parts = docs.select(text_col).mapInArrow(context_sums, "bucket int, n long, " + ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((BUCKETS, DIMS))
    out[found.column("bucket").to_numpy()] = np.stack([found.column(n).to_numpy() for n in names], axis=1) if found.num_rows else 0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features by row: mean vector, mean absolute vector, likeness and equality of neighbours, length, share of distinct words."""
    buckets, firsts = tokens(data, offsets)
    n = np.diff(firsts)
    out = np.zeros((len(n), FEATURES), dtype=np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    begins, count = firsts[:-1][full], n[full][:, None]
    words = vectors[buckets]
    out[full, :DIMS] = np.add.reduceat(words, begins, axis=0) / count
    like = np.zeros(len(buckets), dtype=np.float32)
    same = np.zeros(len(buckets), dtype=np.float32)
    like[:-1] = np.einsum("ij,ij->i", words[:-1], words[1:])
    same[:-1] = buckets[:-1] == buckets[1:]
    ends = firsts[1:][full] - 1
    like[ends] = same[ends] = 0
    out[full, DIMS : 2 * DIMS] = np.add.reduceat(np.abs(words), begins, axis=0) / count
    out[full, 2 * DIMS] = np.add.reduceat(like, begins) / count[:, 0]
    out[full, 2 * DIMS + 1] = np.add.reduceat(same, begins) / count[:, 0]
    out[full, 2 * DIMS + 2] = np.log1p(count[:, 0]) / 5
    row = np.repeat(np.arange(len(full)), count[:, 0])
    distinct = np.unique(row * BUCKETS + buckets) // BUCKETS
    # A text of many words repeats some by chance, so the share is taken against the square root of the length.
    out[full, 2 * DIMS + 3] = np.bincount(distinct, minlength=len(full)) / np.sqrt(count[:, 0]) / 10
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Two layers, inputs standardised; the temperature divides the output before it becomes a probability."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adam on four fifths of the rows and set the temperature on the rest."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    if len(y) < 20 or y.min() == y.max():
        return net
    net.w2 = rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN)
    order = rng.permutation(len(y))
    check, learn = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for a in range(0, len(learn), BATCH):
            rows = learn[a : a + BATCH]
            before = z[rows] @ params[0] + params[1]
            hidden = np.maximum(before, 0)
            error = (sigmoid(hidden @ params[2] + params[3][0]) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (before > 0)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(params[3][0])
    logits = net.logits(x[check])
    # The temperature with the least log loss on rows the weights have not seen.
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [-np.mean(np.log(np.where(y[check] == 1, p, 1 - p) + 1e-12)) for p in (sigmoid(logits / g) for g in grid)]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.network.score(pooled(data, offsets, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors from all documents and a network from at most ``bound`` labelled texts outside the held-out fold.

    Without labels of both kinds every text scores the smoothed share of label 1.
    """
    vectors = word_vectors(docs, text_col)

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(1)):
                x = pooled(data, offsets, vectors)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["label", "x"])

    rows = texts_of(docs, teaching_ids(labels, label, bound, id_col), id_col, text_col)
    got = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, x array<float>").toArrow()
    y = got.column("label").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(float) if len(y) else np.zeros((0, FEATURES))
    by = np.lexsort([x[:, 0], x[:, 1], y]) if len(y) else np.zeros(0, int)  # rows arrive in any order
    return QualityModel(vectors, train(x[by], y[by]))


def score(docs: DataFrame, model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    Null texts score like empty ones. Null and repeated ids are rows of their own; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(1)):
                scores = model.score_rows(data, offsets).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(scores)], names=["id", "score"])

    out = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(at)):
                yield batch.slice(first, last - first).filter(pa.array(model.score_rows(data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
