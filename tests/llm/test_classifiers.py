from __future__ import annotations

import zlib

import numpy as np
import pytest

from tallyline.llm import quality, toxicity
from tests.llm.conftest import ODD

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


@pytest.mark.parametrize(("fit", "label", "threshold"), [(quality.fit, "quality", 0.3), (toxicity.fit, "toxic", 0.5)])
def test_held_out_accuracy(big, fit, label, threshold):
    docs, labels = big
    out = quality.score(docs, fit(docs, labels), threshold)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    for kind in (0, 1):
        mine = [r["predicted"] == kind for r in rows if r[label] == kind]
        # Some labels do not follow from the text: their documents hold no word that others of the label share.
        assert np.mean(mine) > 0.92
    assert np.mean([r["predicted"] == r[label] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    fold = {r["doc_id"]: r["held_out"] for r in out.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in fold.items())


@pytest.mark.parametrize("fit", [quality.fit, toxicity.fit])
def test_held_out_labels_are_not_read(spark, documents, labels, fit):
    flipped = labels.selectExpr(
        "doc_id", *(f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic"))
    )
    a, b = (sorted(map(tuple, quality.score(documents, fit(documents, x), 0.5).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("fit", [quality.fit, toxicity.fit])
def test_odd_rows_and_labels(spark, odd, fit):
    strange = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 1), (2, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (strange, strange.where("false")):
        got = quality.score(odd, fit(odd, labels), 0.3).collect()
        assert len(got) == len(ODD)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert quality.score(odd.where("false"), fit(odd.where("false"), strange), 0.3).count() == 0


def test_rejected_documents_go(documents, labels):
    model = quality.fit(documents, labels)
    kept = quality.accepted(documents, model, 0.3)
    assert kept.columns == documents.columns
    want = {r["doc_id"] for r in quality.score(documents, model, 0.3).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_nnpu_finds_positives_among_unlabelled():
    rng = np.random.default_rng(0)
    n, positive = 3000, np.arange(3000) < 300
    hidden = positive | (rng.random(n) < 0.1)
    x = rng.random((n, 40)) < 0.2
    x[:, 0] = hidden & (rng.random(n) < 0.9)
    x[:, 1] = hidden & (rng.random(n) < 0.9)
    row, feature = np.nonzero(x)
    w, b = toxicity.fit_nnpu(row, feature, positive, 0.1, 40, 0)
    found = x @ w + b > 0
    assert found[hidden].mean() > 0.9 and found[~hidden].mean() < 0.05
