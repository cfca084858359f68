from __future__ import annotations

import random

import numpy as np
import pytest

from tallyline.llm import jaccard_join as J
from tests.llm.conftest import ODD
from tests.llm.test_near_dedup import expected


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def brute(rows, size, percent):
    return {i: (n, c) for i, (n, c, _) in expected(rows, size, percent).items()}


@pytest.mark.parametrize("size, percent", [(4, 85)])
def test_documents(documents, size, percent):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    assert result(J.jaccard_components(documents, size=size, percent=percent)) == brute(rows, size, percent)


def near_copies(rng, n):
    """Short and long texts with copies that differ in a few words, and texts that share most of a passage."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [word()]
        else:
            w = [word() for _ in range(rng.choice([1, 5, 9, 14, 30, 200]))]
        rows.append((i, " ".join(w)))
    return rows


def test_near_copies(spark, monkeypatch):
    """Against all pairs, with trees of a few points, so that large blocks are cut into tiles."""
    rows = near_copies(random.Random(7), 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(J.jaccard_components(df, size=4, percent=85)) == brute(rows, 4, 85)
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "CHUNK", 50)
    assert result(J.jaccard_components(df, size=3, percent=80)) == brute(rows, 3, 80)


def test_linked_sets_share_a_key():
    """Any two sets that reach the similarity agree in a whole group, those with many empty groups too."""
    rng = np.random.default_rng(4)
    classes = J.SizeClasses(85)
    for _ in range(400):
        n = int(rng.choice([3, 7, 8, 13, 20, 40, 300, 2000]))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        if rng.random() < 0.3:
            base &= np.uint64(0x3FFFFFFFFFFFFFFF)  # a crowded part of the range leaves groups empty
        other = base.copy()
        out = int(rng.integers(0, n * 15 // 185 + 1))
        other[:out] = rng.integers(0, 2**64, out, dtype=np.uint64)
        sets = [np.unique(base), np.unique(other[: len(other) - int(rng.integers(0, 2))])]
        both, either = len(np.intersect1d(*sets)), len(np.union1d(*sets))
        if 100 * both < 85 * either or both == either:
            continue
        counts = np.array([len(s) for s in sets])
        keys = [set(), set()]
        for row, key in J.agreement_keys(np.concatenate(sets), counts, classes):
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                keys[r].add(k)
        assert keys[0] & keys[1]


def test_search_finds_what_the_bound_lets_pass():
    rng = np.random.default_rng(1)
    points = rng.poisson(1, (300, J.GROUPS)).astype("<u4")
    points[150:] = points[:150] + (rng.random((150, J.GROUPS)) < 0.02)
    sizes, roots, tree = points.sum(axis=1).astype(np.int64), rng.integers(0, 200, 300), np.repeat([0, 2, 3], 100)
    forest = J.Forest(tree, points, sizes, roots, 85)
    i, j, _ = forest.search(np.array([0, 1]), np.array([0, 2]))
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for a in range(300):
        for b in range(a + 1, 300):
            meet = (tree[a], tree[b]) in ((0, 0), (2, 3))
            if meet and roots[a] != roots[b] and np.minimum(points[a], points[b]).sum() * 185 >= 85 * (sizes[a] + sizes[b]) and 85 * max(sizes[a], sizes[b]) <= 100 * min(sizes[a], sizes[b]):
                want.add((a, b))
    assert got == want and want


def test_odd_rows(odd):
    got = J.jaccard_components(odd, size=3, percent=85).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 4, 5, 6, 7, 8, 9, 10)] == [1, 1, 4, 5, 6, 7, 7, 9, 10]
    assert [by[i]["n_shingles"] for i in (4, 5, 6, 7, 9, 10)] == [0, 0, 0, 1, 1, 0]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert J.jaccard_components(odd.where("false")).count() == 0


def test_components_take_few_tables(spark, monkeypatch):
    """A chain of near texts: the edges between them are united in one go, not in rounds."""
    from tallyline.llm import components as C

    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k : k + 200])) for k in range(150)]
    tables = []
    monkeypatch.setattr(C, "saved", lambda df, purpose, keep=C.saved: tables.append(purpose) or keep(df, purpose))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), size=3, percent=85).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 150
    # Two for the blocks, two for each merging of links, which also writes its labels.
    assert tables.count("edges") <= 2 + 2 * (tables.count("labels") + 1)


def test_blocks_are_the_members_of_a_key_not_chains_of_keys(spark):
    chain = [(i + k, i) for i in range(100) for k in (0, 1)]
    same = [(i, key) for i in (500, 501, 502) for key in (1000, 1001)]
    one = [(600, 2000), (601, 2000), (601, 2000), (None, 3000)]
    agreeing = spark.createDataFrame([*chain, *same, *one], "id long, key long")
    labels = spark.createDataFrame([(601, 600), (1, 0)], "node long, root long")
    blocks = J.open_blocks(agreeing, labels).groupBy("block").count().collect()
    # 0 and 1 are one component, as are 600 and 601; two keys with the same three members are one block.
    assert sorted((r["block"], r["count"]) for r in blocks) == [*((i, 2) for i in range(1, 100)), (1000, 3)]
