from __future__ import annotations

import numpy as np
import pytest

from tallyline.llm import ann

ASKS = "vec_id % 20 = 0"


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort([ids, -scores]) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), scores[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(folder, spark):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    return df, [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_small_tables_are_exact(spark):
    df, rows = vectors("sf0.001", spark)
    got, want = found(ann.nearest(df, ASKS)), brute(rows, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("block", [40_000, 700])
def test_recall_where_the_forest_chooses(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    df, rows = vectors("sf0.1", spark)
    got, want = found(ann.nearest(df, ASKS, wanted=200)), brute(rows, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_odd_vectors_and_a_hot_one(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=6).tolist()) for i in range(1, 90)] + [(1000 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0]) for i in range(150)]
    odd = [(500, None), (520, []), (540, [0.0] * 6), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (580, [float("nan")] * 6), (600, [float("inf")] * 6), (620, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + odd], "vec_id long, embedding array<double>, cid string, block int")
    got, want = found(ann.nearest(df, ASKS, k=20)), brute(good, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert ann.nearest(df.where("false"), ASKS).count() == 0
    few = df.where("vec_id between 19 and 22")
    assert [len(v) for v in found(ann.nearest(few, ASKS, k=20)).values()] == [3]
