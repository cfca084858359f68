from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyline.llm.sharding import shard, shard_starts
from tests.llm.conftest import ODD


def minimax(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)

    def cut(c):
        out, n, fill = [], 0, 0
        for s in sizes:
            if fill + s > c:
                n, fill = n + 1, 0
            fill += s
            out.append(n)
        return out

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if cut(mid)[-1] < shards else (mid + 1, high)
    return low, cut(low)


def test_many_groups(spark):
    """Hundreds of prefixes stay open at once; they are looked up as a set."""
    rng = random.Random(3)
    rows = sorted((hashlib.sha256(str(i).encode()).hexdigest(), int(rng.paretovariate(1.2) * 200)) for i in range(120_000))
    groups = spark.createDataFrame(rows, "key string, bytes long")
    capacity, starts = shard_starts(groups, 40)
    low, cuts = minimax([b for _, b in rows], 40)
    assert capacity == low
    assert starts == [next((rows[i][0][: len(s)] for i in range(len(rows)) if cuts[i] > k), "g") for k, s in enumerate(starts)]


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity_and_cuts(spark, seed):
    rng = random.Random(seed)
    n, shards = rng.choice([3, 60, 600]), rng.choice([2, 7, 40])
    rows = sorted((hashlib.sha256(str(i).encode()).hexdigest(), rng.choice([16, 17, 90, 4000 if seed % 2 else 30])) for i in range(n))
    groups = spark.createDataFrame(rows, "key string, bytes long")
    for digits in (1, 2, 4):
        capacity, starts = shard_starts(groups, shards, digits)
        assert (capacity, [sum(s <= k for s in starts) for k, _ in rows]) == minimax([b for _, b in rows], shards)


def check(rows, got, shards):
    texts = defaultdict(int)
    for _, t in rows:
        texts[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 16
    _, place = minimax([texts[k] for k in sorted(texts)], shards)
    where = dict(zip(sorted(texts), place, strict=True))
    want = sorted(((i is None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), where[hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(documents):
    check([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()], shard(documents).collect(), 40)


def test_odd_rows_and_no_rows(odd):
    check(ODD, shard(odd, shards=5).collect(), 5)
    assert shard(odd.where("false")).count() == 0


def test_plan_is_native(documents):
    text = shard(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
