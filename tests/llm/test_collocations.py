from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tallyline.llm.collocations import collocations
from tests.llm.conftest import ODD, lower


def expected(rows, min_count, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if len(p) > 2 and c >= min_count}
    longer = Counter()
    for q, b in often.items():
        for i in range(1, len(q)):
            for j in range(i + 2, len(q) + 1):
                if j - i < len(q) - 1:
                    longer[(q[0], *q[i:j])] = max(longer[(q[0], *q[i:j])], b)
    scored = []
    for p, a in often.items():
        lang, w = p[0], p[1:]
        if longer[p] < a:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("min_count, longest, top", [(5, 5, 2000), (3, 4, 7), (8, 6, 30)])
def test_all_phrases(spark, min_count, longest, top):
    rng = random.Random(min_count)
    rows = []
    for i in range(300):
        words = [rng.choice(["New", "york", "City", "a", "b", "c\u00e9", "x"]) for _ in range(rng.choice([0, 1, 3, 12]))]
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", ". in the end of it", "; one two three four five six seven", "\x0bx"])))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = result(collocations(df, min_count, longest, top))
    assert got == expected(rows, min_count, longest, top) and got


def test_documents(documents):
    rows = [(r["lang"], r["text"]) for r in documents.select("lang", "text").collect()]
    assert result(collocations(documents, 12, 5, 40)) == expected(rows, 12, 5, 40)


def test_odd_rows(odd):
    rows = [("en", t) for _, t in ODD]
    assert result(collocations(odd, 2, 5, 500)) == expected(rows, 2, 5, 500)
    assert collocations(odd.where("false")).count() == 0


def test_products_past_64_bits(spark):
    """floor(1000 a n / (l r)) with a, n, l and r near 2 ** 40."""
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**13, 3 * 10**13, 2 * 10**13, 10**13 + 7)], "a long, n long, l long, r long")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    got = row.select(F.expr(f"(cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")).first()[0]
    assert got == 1000 * 10**13 * 3 * 10**13 // (2 * 10**13 * (10**13 + 7))
