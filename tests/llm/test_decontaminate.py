from __future__ import annotations

import hashlib
import re

import pytest

from tallyline.llm import decontaminate as D
from tests.llm.conftest import ODD, lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def expected(docs, items, window):
    found = {}
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(len(w) - window + 1, 1)):
                windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = sorted({len(p) for p in windows})
    for d, t in docs:
        w, ids = words(t), set()
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    ids |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        found[d] = (len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit))
    return found


def digest(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.contamination(df).collect()}


def test_documents(documents, benchmark_items, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark_items.collect()]
    want = expected(docs, items, 10)
    assert any(v[4] for v in want.values())
    assert digest(D.find_matches(documents, benchmark_items)) == want
    clean = D.without_matches(documents, benchmark_items)
    assert clean.columns == documents.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, v in want.items() if not v[4]}
    # A benchmark beyond one block takes several passes, many small shards give the same as a few.
    monkeypatch.setattr(D, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(D, "SHARD_WORDS", 700)
    assert digest(D.find_matches(documents, benchmark_items)) == want
    assert {r["doc_id"] for r in D.without_matches(documents, benchmark_items).collect()} == {r["doc_id"] for r in clean.collect()}


ITEMS = [(1, "fox jumps over the"), (2, "Été5"), (3, None), (4, ""), (5, "a b c d e f g h i j k l"), (None, "one"), (6, "b c d e f g h i j k l m n o p zz"), (7, "two words"), (7, "one")]


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(D.find_matches(odd, items)).collect()
    want = expected(ODD, ITEMS, 10)
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]], r["doc_id"]
    assert D.find_matches(odd.where("false"), items).count() == 0
    assert D.contamination(D.find_matches(odd, items.where("false"))).where("contaminated").count() == 0


def test_longest_matches_and_places(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + text + " z " + " ".join(f"w{i}" for i in range(5, 17)))], "doc_id long, text string")
    items = spark.createDataFrame([("q", "start " + text + " end")], "item_id string, text string")
    r = D.find_matches(docs, items).first()
    assert [tuple(m) for m in r["matches"]] == [("q", 1, 2, 40), ("q", 6, 43, 12)]
    assert [tuple(s) for s in r["spans"]] == [(2, 42), (43, 55)]


def test_match_does_not_run_on_into_the_next_document(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contamination(D.find_matches(docs, items)).where("contaminated").count() == 0


@pytest.mark.parametrize("repeat", [1, 400])
def test_very_frequent_passage(spark, repeat):
    docs = spark.createDataFrame([(i, "n" + str(i) + " " + "p q r s t u v w x y z " * repeat) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "p q r s t u v w x y z")], "item_id long, text string")
    got = D.contamination(D.find_matches(docs, items)).collect()
    assert {r["n_hit"] for r in got} == {11 * repeat}
