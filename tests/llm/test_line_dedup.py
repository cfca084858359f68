from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyline.llm import near_dedup as N
from tallyline.llm.bitmap import Bitmap
from tallyline.llm.line_dedup import AT_ONCE, DEALT, GATHERED, PARTS, SMALL, LineSets, gatherer, line_reader, signer, without_repeated_lines
from tests.llm.conftest import ODD, groups, lower

BLANK = " \t\r\n\x0b\x0c"


def expected(rows):
    """(id, text) with one line of each component of fuzzy equal lines; rows in ascending order of ids."""
    lines = [(r, n, lower(x)) for r, (_, t) in enumerate(rows) if t is not None for n, x in enumerate(t.split("\n")) if x.strip(BLANK)]
    sets = [frozenset(x[i : i + 8] for i in range(max(len(x) - 7, 1))) for _, _, x in lines]

    def linked(i, j):
        a, b = sets[i], sets[j]
        if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
            return False
        return 100 * len(a & b) >= 80 * len(a | b)

    gone = {lines[i][:2] for i, g in enumerate(groups(len(lines), linked)) if i != g}
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (r, n) not in gone)) for r, (i, t) in enumerate(rows)]


def test_against_all_pairs_of_lines(documents):
    docs = documents.where("doc_id < 60")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = without_repeated_lines(docs)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == expected(rows)
    assert got.columns == [*documents.columns, "n_lines", "n_kept"]


def test_odd_rows(odd):
    got = without_repeated_lines(odd).collect()
    assert len(got) == len(ODD)
    rows = sorted({(i, t) for i, t in ODD if i is not None}, key=lambda r: r[0])
    # The null id sorts first; its line is repeated by none.
    assert {(r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None} == set(expected(rows))
    assert {(r["text"], r["n_lines"], r["n_kept"]) for r in got if r["doc_id"] is None} == {("text without an id", 1, 1), (None, 0, 0)}
    assert {r["cut"] for r in got} == {None} and {r["key"] for r in got} == {"k"}
    assert without_repeated_lines(odd.where("false")).count() == 0


def test_hot_line(spark):
    rows = [(i, f"This line stands in every one of the documents.\nUnique text {i * 7919} of number {i * 104729} here") for i in range(300)]
    got = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in got if r["n_kept"] == 2) == [0]
    assert sum(r["n_kept"] for r in got) == 301


def test_pairs_at_the_threshold_meet(spark):
    """Each pair shares 16 of 20 runs and has no second path."""
    rnd = random.Random(1)
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for i in range(4000):
        common = letters(23)
        rows += [(2 * i, common + letters(2)), (2 * i + 1, common + letters(2))]
    sets = [{t[k : k + 8] for k in range(len(t) - 7)} for _, t in rows]
    assert all(5 * len(a & b) >= 4 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in got if r["n_kept"]) == [2 * i for i in range(4000)]


def test_sets_of_many_short_lines(spark):
    """Sizes and pairs of sets made in slices of more lines than are told apart at once."""
    texts = [f"{i:05d} is the number of this line" for i in range(3 * AT_ONCE)]
    ids = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "id long, f long, text string").coalesce(1)
    wanted = spark.sparkContext.broadcast(Bitmap(ids.select(F.col("f").alias("key"))))
    got = ids.mapInArrow(line_reader(8, wanted), "id long, f long, line int, body string, n long").collect()
    assert {(r["id"], r["line"], r["body"], r["n"]) for r in got} == {(i, 0, x, len({x[k : k + 8] for k in range(len(x) - 7)})) for i, x in enumerate(texts)}
    both = spark.createDataFrame([(i, i + 1, x, y) for i, (x, y) in enumerate(zip(texts, texts[1:]))], "a long, b long, x string, y string").coalesce(1)
    links = {(r["a"], r["b"]) for r in LineSets(None, 80, 8).linked(both).collect()}
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in texts]
    assert links == {(i, i + 1) for i in range(len(texts) - 1) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}


def test_a_task_packs_its_lines_by_part(spark):
    """One row a part leaves the task; pairs come of small band keys, rows of large ones only, and every place once."""
    rows = [(i, "\n".join(f"{i} {j} a line like others here" for j in range(40))) for i in range(50)]
    given = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("f"), "text").coalesce(1)
    parts = given.mapInArrow(signer(8, 22, 4), DEALT)
    assert parts.count() <= PARTS
    found = parts.groupBy("part").applyInArrow(gatherer, GATHERED)
    assert found.where("id is not null").count() == found.where("first").count() == 2000
    assert found.where("other is not null").select("h1", "other").where("h1 >= other").count() == 0
    large = found.where("key is not null").groupBy("key").count()
    assert large.where(f"count <= {SMALL}").count() == 0 and large.count() > 0


def test_a_group_of_near_copies_is_not_squared(spark, monkeypatch):
    """300 lines of one family, many similar and many not: components as from all pairs, at a quarter of the comparisons."""
    rnd = random.Random(8)
    base = rnd.choices("abcdefghijklmnopqrstuvwxyz", k=400)
    lines = []
    for _ in range(300):
        edited = list(base)
        for at in rnd.sample(range(400), rnd.randrange(1, 8)):
            edited[at] = rnd.choice("0123456789")
        lines.append("".join(edited))
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    want = groups(len(lines), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    bodies = spark.createDataFrame([(i, x, len(s)) for i, (x, s) in enumerate(zip(lines, sets, strict=True))], "id long, body string, n long")
    made = []
    monkeypatch.setattr(N, "saved", lambda df, purpose, keep=N.saved: made.append((purpose, keep(df, purpose))) or made[-1][1])
    monkeypatch.setattr(N, "dropped", lambda *tables: None)
    got = N.link_components(bodies.select(F.lit(1).cast("long").alias("key"), "id"), LineSets(None, 80, 8), bodies)
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert [roots.get(i, i) for i in range(len(lines))] == want
    compared = sum(df.count() for purpose, df in made if purpose == "pairs")
    assert compared < len(lines) * (len(lines) - 1) / 8


def test_repeats_leave_a_part_without_their_hash(spark):
    """Equal lines stand once with a hash; the others are places to cut, and nothing but a place."""
    given = spark.createDataFrame([(i, "one line on every page here") for i in range(9)], "id long, text string")
    given = given.select("id", F.xxhash64("text").alias("f"), "text").coalesce(1).mapInArrow(signer(8, 22, 4), DEALT)
    found = given.groupBy("part").applyInArrow(gatherer, GATHERED).where("id is not null").orderBy("id").collect()
    assert [(r["id"], r["first"], r["h1"] is None) for r in found] == [(i, i == 0, i > 0) for i in range(9)]
