from __future__ import annotations

import corpus_pipeline
from tallyline.llm import quality
from tallyline.llm.decontaminate import contamination, find_matches
from tallyline.llm.queries import QUERIES
from tests.llm import test_line_dedup, test_near_dedup
from tests.llm.conftest import DATA, ODD


def test_every_stage_on_its_input(spark, documents, labels, benchmark_items):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents.where("doc_id < 80")
    good = stages["quality"](spark, docs, DATA)
    want = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels), 0.3).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == want
    rows = sorted((r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect())
    lined = stages["line_dedup"](spark, good, DATA)
    left = [(i, t) for i, t in test_line_dedup.expected(rows) if t.strip() or not dict(rows)[i].strip()]
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == left
    single = stages["near_dedup"](spark, good, DATA)
    kept = {i for i, v in test_near_dedup.expected(rows, 5, 80).items() if v[2]}
    assert {r["doc_id"] for r in single.collect()} == kept and len(kept) < len(rows)
    clean = stages["decontamination"](spark, good, DATA)
    bad = {r["doc_id"] for r in contamination(find_matches(good, benchmark_items)).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - bad
    for stage in (good, lined, single, clean):
        assert stage.columns == documents.columns


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_odd_rows_pass_every_stage(spark, odd):
    for rows in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            n = stage(spark, rows, DATA).count()
            assert n <= len(ODD) + 20 * (name == "packing") * 100, name


def test_queries_are_registered():
    import __spark_entry__

    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    # 7 and 12 hold a copy and another text; 9 is repeated whole; a null id stays.
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (11, d), (12, d + " more"), (12, e), (13, None), (13, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.unique_documents(spark, docs.repartition(3), DATA)
    assert got.columns == docs.columns
    want = [(3, a), (7, b), (9, c), (11, d), (12, e), (13, None), (None, a), (None, a)]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)
