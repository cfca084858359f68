from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tallyline.llm.spelling import near_of_pairs, spelling_variants
from tests.llm.conftest import ODD, lower


def edits(a: str, b: str) -> int:
    """Levenshtein distance by the usual table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(rows, min_length=7, min_count=2, ratio=10, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    # Words one edit apart share a word that is left of each without at most one letter.
    left = defaultdict(set)
    for w in n:
        for short in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            left[short].add(w)
    near = {w: {v for k in range(-1, len(w)) for v in left[w if k < 0 else w[:k] + w[k + 1 :]] if v != w and edits(v, w) == 1} for w in n}
    form = {w: best for w, v in near.items() if v and n[best := min(v, key=lambda x: (-n[x], x))] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(60).collect()]
    few = documents.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(spelling_variants(few)) == expected(rows)


def test_small_words(spark):
    """Words over few letters: runs of equal letters, many neighbours, chains of forms, every third run changed."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        words = ["".join(rng.choice("ab\u00e9") for _ in range(rng.choice([2, 3, 4, 5, 7, 8, 9]))) for _ in range(30)]
        rows.append((i, " ".join(words + ["aaaa"] * (i % 20) + ["AAAAA\u00c0"] * (i % 3) + ["aabbaabb"] * 9)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for length, ratio in ((3, 2), (7, 10)):
        got = result(spelling_variants(df, min_length=length, ratio=ratio, every=3))
        assert got == expected(rows, min_length=length, ratio=ratio, every=3)
        assert any(r[1] for r in got)


def test_odd_rows(odd):
    assert result(spelling_variants(odd)) == expected(ODD)
    assert spelling_variants(odd.where("false")).count() == 0


def test_very_long_run(spark):
    rows = [(i, "x" * 100_000 + " " + "y" * 7) for i in (1, 1, 2)]
    got = result(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40))
    assert got == {("x" * 100_000, None, "x" * 100_000, 3, 0, None), ("y" * 7, None, "y" * 7, 3, 0, None)}


def test_one_group_of_a_pair():
    """Two words lacking one letter and the word cut there: each is near the others, the best of them first."""
    same = np.zeros(3, dtype=np.int64)
    got = near_of_pairs(same, same, np.array([5, 3, 9]), np.array([8, 8, 2]), np.array([2, 0, 1]))
    assert [x.tolist() for x in got] == [[5, 3, 9], [2, 1, 1], [8, 8, 8], [3, 5, 5]]
