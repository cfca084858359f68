from __future__ import annotations

import re

import pytest

DATA = "/root/testdata/sf0.001"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def groups(n: int, linked) -> list[int]:
    """The least number reachable from each of 0..n-1 over the pairs for which linked(i, j) holds."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if root(i) != root(j) and linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


LONG = " ".join(f"word{i % 977} Été{i}" for i in range(30_000))
# (doc_id, text): nulls, empty and blank texts, repeats, copies, near copies, odd characters, one long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away into the deep dark wood today\nSecond line here\n\nlast"),
    (2, "The quick brown fox jumps over the lazy dog and runs away into the deep dark wood today\nSecond line here\n\nlast"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away into the deep dark wood today!\r\nSecond  line here\nlast"),
    (4, None), (5, ""), (6, "   \n\t\n"), (7, "one"), (8, "One"), (9, "two words"), (10, "\n"),
    (11, LONG), (11, LONG), (12, "naïve café 中文 字 😀 <|endoftext|> ok\x1c end\u0085x"), (None, "text without an id"), (None, None),
    (13, "a b c d e f g h i j k l m n o p"), (14, "A B C D E F G H I J K L M N O Q"), (15, "x" * 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with more columns whose names the operators use themselves."""
    rows = [(i, t, None, "en", 1, "k", 2, None, 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, lang string, n long, key string, root long, cut string, score double")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")
