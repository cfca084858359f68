from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import components as C
from tallyline.llm import near_dedup as N
from tallyline.llm.components import components
from tallyline.llm.near_dedup import near_duplicates
from tests.llm.conftest import ODD, groups, spaced_words


def shingles(text, size):
    w = spaced_words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def expected(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)

    return {rows[i][0]: (len(sets[i]), rows[g][0], i == g) for i, g in enumerate(groups(len(rows), linked))}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_all_pairs(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    for size, percent in ((3, 85), (5, 80)):
        assert result(near_duplicates(documents, size=size, percent=percent)) == expected(rows, size, percent)


def test_odd_rows(odd):
    got = near_duplicates(odd, size=3, percent=85).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] in ([(0, None, True), (2, None, True)], [(2, None, True), (0, None, True)])
    assert [by[i]["component_id"] for i in (1, 2, 4, 5, 6, 7, 8, 9, 10)] == [1, 1, 4, 5, 6, 7, 7, 9, 10]
    assert [by[i]["n_shingles"] for i in (4, 5, 6, 7, 9, 10)] == [0, 0, 0, 1, 1, 0]
    assert sum(r["doc_id"] == 11 for r in got) == 2


def test_no_rows(odd):
    assert near_duplicates(odd.where("false")).count() == 0


def test_groups_of_copies_and_a_common_passage(spark):
    """A large group of near copies and many texts that share most of a passage, against all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, shared = [word() for _ in range(200)], [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 4, 8])):
            w[rng.randrange(200)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(shared + [word() for _ in range(rng.choice([2, 20, 40]))])) for i in range(120, 240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(near_duplicates(df, size=3, percent=85)) == expected(rows, 3, 85)


def test_components_of_paths_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (300, None), (301, 302), (302, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 160)}, 302: 301}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_one_round(spark, monkeypatch):
    """A path of 3,000 nodes is united where it is read; more edges than a task takes give the same in rounds."""
    edges = [(i, i + 1) for i in range(1, 3000)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    tables = []
    monkeypatch.setattr(C, "saved", lambda df, purpose, keep=C.saved: tables.append(purpose) or keep(df, purpose))
    assert {tuple(r) for r in components(df).collect()} == {(i, 1) for i in range(2, 3001)}
    assert len(tables) == 2
    monkeypatch.setattr(C, "EDGES", 700)
    assert {tuple(r) for r in components(df).collect()} == {(i, 1) for i in range(2, 3001)}
    named = df.selectExpr("concat('n', a) as a", "concat('n', b) as b")
    assert {tuple(r) for r in components(named).collect()} == {(f"n{i}", "n1") for i in range(2, 3001)}


def test_stars_of_edges():
    lo, hi = C.stars(np.array([5, 3, 9, 7, 20]), np.array([9, 5, 11, 8, 20]))
    assert sorted(zip(hi.tolist(), lo.tolist(), strict=True)) == [(5, 3), (8, 7), (9, 3), (11, 3)]


def test_whole_texts_count(spark):
    """Texts that differ only far behind are told apart."""
    head = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, head + " " + " ".join(f"a{i}" for i in range(4000))), (2, head + " " + " ".join(f"b{i}" for i in range(4000)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where(F.col("doc_id") != F.col("component_id")).count() == 0


def test_few_rounds_of_hubs(spark, monkeypatch):
    """A bucket of 400 unlike texts and one copy is done in five rounds, not one for each power of four."""
    rows = [(i, [*range(20), *range(1000 * i + 1000, 1000 * i + 1040)]) for i in range(400)]
    rows.append((400, rows[0][1][:59]))
    bodies = spark.createDataFrame(rows, "id long, body array<long>").withColumn("n", F.size("body").cast("long"))
    bucket = lambda ids, *cols: ids.select(F.lit(7).cast("long").alias("key"), "id", *cols)
    tables = []
    monkeypatch.setattr(N, "rare_buckets", lambda members, items, percent: bucket(members, "n", F.lit(0).cast("long").alias("pos"), "root"))
    monkeypatch.setattr(N, "saved", lambda df, purpose, keep=N.saved: tables.append(purpose) or keep(df, purpose))
    got = N.link_components(bucket(bodies), N.Sets(lambda ids: bodies.join(ids, "id"), 80))
    assert [tuple(r) for r in got.collect()] == [(400, 0)]
    assert tables.count("hubs") <= 5


def test_buckets_with_the_same_members_count_once(spark):
    """Texts that share a passage of ten items, and these alone, meet in the first of its buckets, at their least places."""
    rows = [(i, [*range(10), *range(100 * i + 100, 100 * i + 110)]) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, items array<long>")
    members = items.select("id", F.size("items").cast("long").alias("n"), F.col("id").alias("root"))
    got = N.rare_buckets(members, items, 40).collect()
    assert len(got) == 40 and {(r["key"], r["pos"]) for r in got} == {(0, 10)}


def test_a_small_bucket_is_done_in_the_first_round_that_has_a_hub_for_each_member(spark):
    rows = [(1, i, 20, 0, i, 0, 16) for i in range(16)] + [(2, i, 20, 0, i, 0, 17) for i in range(17)]
    active = spark.createDataFrame(rows, "key long, id long, n long, pos long, root long, least long, members long")
    found = [r["key"] for r in N.hubs_of(active, 1).collect()]
    assert found.count(1) == 16 and found.count(2) < 16
