from __future__ import annotations

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyline.llm.packing import best_fit, cutter, pack
from tallyline.llm.queries import vocabulary
from tallyline.llm.token_store import decode, encode, read_ids, stored_tokens, write_tokens
from tallyline.llm.tokens import Encoder
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def ids_of():
    model = Tokenizer.from_file(vocabulary())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = [t for _, t in ODD] + [" ", "  a", "a  ", "a   b", "　y  z", "\n\n a\n", "don't I'll've 's", "\r\n\r\n x\t\ty", "ÿ ͸ q", "a\u0085 b", "  a", "é  è"]


def test_chunks_give_the_ids_of_whole_texts(documents, ids_of):
    texts = TEXTS + [r["text"] for r in documents.select("text").limit(100).collect()]
    encoder = Encoder(vocabulary())
    for _ in range(2):  # the second time all chunks are known
        for first, last, ids, counts in encoder.column(pa.array(texts)):
            at = np.cumsum(counts) - counts
            assert [ids[a : a + n].tolist() for a, n in zip(at, counts, strict=True)] == [ids_of(t) for t in texts[first:last]]


@pytest.mark.parametrize("high", [1, 2, 300, 1 << 16, 1 << 31, 1 << 60, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 1024, 5000])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64) if n else np.zeros(0, np.uint64)
    values[n // 3 : n // 3 + 300] = 1
    block = encode(values)
    assert np.array_equal(decode(block), values)
    for a, b in ((0, n), (n // 2, n // 2 + 700), (n, n + 5), (1030, 1031)):
        assert np.array_equal(decode(block, a, b), values[a:b])


def test_small_values_share_words():
    assert len(encode(np.ones(60_000, np.uint64))) < 60_000 / 60 * 8 * 1.2


def stored(rows, got, ids_of):
    assert len(got) == len(rows)
    at = 0
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append([*ids_of(t), 2])
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        mine = next(x for x in texts[r["doc_id"]] if len(x) == r["n_tokens"] and crc(x) == r["ids_crc32"])
        texts[r["doc_id"]].remove(mine)
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_token_files(documents, odd, ids_of):
    stored([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()], stored_tokens(documents, vocabulary(), 2).collect(), ids_of)
    stored(ODD, stored_tokens(odd, vocabulary(), 2).collect(), ids_of)
    assert stored_tokens(odd.where("false"), vocabulary(), 2).count() == 0


def test_ids_come_back(spark, documents, ids_of, tmp_path):
    write_tokens(documents, str(tmp_path / "t"), vocabulary(), 2)
    got = {r["doc_id"]: r["ids"] for r in read_ids(spark, str(tmp_path / "t")).collect()}
    assert got == {r["doc_id"]: [*ids_of(r["text"]), 2] for r in documents.select("doc_id", "text").collect()}


def test_blocks_stay_small(spark, tmp_path):
    """Texts of 4 MB that one task writes: no block holds more than about 1 MB of them."""
    rows = [(i, " ".join(f"w{(i * 31 + k) % 977}" for k in range(2000))) for i in range(400)]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "t"), vocabulary(), 2)
    size = {i: len(t) for i, t in rows}
    blocks = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sum(b["n_docs"] for b in blocks) == len(rows)
    assert max(sum(size[i] for i in decode(b["doc_ids"]).tolist()) for b in blocks) <= 1 << 20


def test_best_fit():
    where, n = best_fit(np.array([5, 6, 4, 5, 10, 1, 9]), 10)
    assert n == 4 and np.bincount(where, weights=[5, 6, 4, 5, 10, 1, 9]).tolist() == [10.0, 10.0, 10.0, 10.0]


def check_packing(rows, got, ids_of, capacity):
    tokens = [[*ids_of(t), 0] for _, t in rows]
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = defaultdict(list)
    for (i, _), t in zip(rows, tokens, strict=True):
        n = -(-len(t) // capacity)
        head = len(t) - (n - 1) * capacity
        for k in range(n):
            a = 0 if k == 0 else head + (k - 1) * capacity
            part = t[a : head + k * capacity]
            want[i].append((k, a, len(part), crc(part)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences), -(-sum(map(len, tokens)) // capacity)


def test_packing(documents, odd, ids_of):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    n, least = check_packing(rows, pack(documents.repartition(9), vocabulary(), batch_items=20).collect(), ids_of, 2048)
    assert n <= least + 1
    check_packing(ODD, pack(odd, vocabulary(), capacity=64).collect(), ids_of, 64)
    assert pack(odd.where("false"), vocabulary()).count() == 0


def test_items_that_do_not_fit_together_end(spark, ids_of):
    rows = [(i, "a b c d e f g") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n, _ = check_packing(rows, pack(df, vocabulary(), capacity=10, batch_items=50).collect(), ids_of, 10)
    assert n == 500


def test_texts_of_special_tokens(spark, ids_of):
    """Strings of added tokens give the ids the library gives, at chunk ends and between letters too."""
    rows = [(1, "ok <|endoftext|> end"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|> b\n<|endoftext|>\n"), (4, "<|endoftext| > <|endoftext|")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert any(50256 in ids_of(t) for _, t in rows)
    stored(rows, stored_tokens(df, vocabulary(), 2).collect(), ids_of)
    check_packing(rows, pack(df, vocabulary(), capacity=16).collect(), ids_of, 16)


def test_many_flushes_of_one_task(spark, ids_of):
    """A task that packs hundreds of times gives every bin a number of its own."""
    rows = [(i, "x " * (i % 5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check_packing(rows, pack(df, vocabulary(), capacity=9, batch_items=4, patience=1).collect(), ids_of, 9)


def test_packing_takes_a_megabyte_at_once():
    """A task's arrays hold one slice of 1 MB and what belongs to it, whatever the batch."""
    texts = pa.array([f"{i} words of a text that is like the others " * 25 for i in range(6000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), texts], names=["doc_id", "text"])
    run = cutter(vocabulary(), 0, 2048, 0, 200_000)
    list(run([batch.slice(0, 10)]))
    tracemalloc.start()
    list(run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
