"""Token files in Simple-8b coding: written in id order, read back in blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.shared import new_path
from tallyline.llm.tokens import Encoder, with_end

U64 = np.uint64
# Fixed values of the coding: how many values a word holds and in how many bits each, by selector. The selector takes
# the low four bits; selector 0 marks an escape, whose 60 bits number an entry of the exception list.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
LANE = 1024  # values between two word offsets
BLOCK_BYTES = 1 << 20  # bytes of text of a block: its ids and their coding take some 60 times that while it is written
HEADER = 4  # uint32 numbers: values, words, exceptions, values in a lane


def _choices(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The densest selector whose word can start at each value; left is the number of values up to the lane's end.

    A selector that fits also fits with fewer and wider places, so each one is tried only where the one before fits.
    """
    choice = np.zeros(len(values), dtype=np.uint8)
    at = np.flatnonzero(values < U64(1 << 60))
    choice[at] = len(COUNTS) - 1
    for s in range(len(COUNTS) - 2, 0, -1):
        if not len(at):
            break
        n = COUNTS[s]
        at = at[left[at] >= n]
        wide = values >= U64(1 << WIDTHS[s])
        if wide.any():
            so_far = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
            at = at[so_far[at + n] == so_far[at]]
        choice[at] = s
    return choice


def encode(values: np.ndarray, lane: int = LANE) -> bytes:
    """Unsigned 64-bit values as one block: header, word offset of every lane, words, exceptions."""
    values = values.astype(U64)
    n = len(values)
    lanes = -(-n // lane)
    ends = np.minimum((np.arange(lanes) + 1) * lane, n)
    choice = _choices(values, np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n))
    steps = np.array(COUNTS)[choice]
    now, open_lanes = np.arange(lanes) * lane, np.arange(lanes)
    begins = []
    # All lanes advance together, one word a turn.
    while len(open_lanes):
        begins.append(now)
        now = now + steps[now]
        going = now < ends[open_lanes]
        now, open_lanes = now[going], open_lanes[going]
    begins = np.sort(np.concatenate(begins)) if begins else np.zeros(0, np.int64)
    selectors = choice[begins]
    words = selectors.astype(U64)
    for s in range(1, len(COUNTS)):
        at = np.flatnonzero(selectors == s)
        if len(at):
            first, sums = begins[at], words[at]
            for j in range(COUNTS[s]):
                sums |= values[first + j] << U64(4 + WIDTHS[s] * j)
            words[at] = sums
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=U64) << U64(4)
    offsets = np.searchsorted(begins, np.arange(lanes) * lane).astype("<u4")
    header = np.array([n, len(words), len(escaped), lane], dtype="<u4")
    return header.tobytes() + offsets.tobytes() + words.astype("<u8").tobytes() + values[begins[escaped]].astype("<u8").tobytes()


def decode(block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of a block, or those from ``first`` up to ``last``: only the lanes that hold them are read."""
    n, n_words, n_escaped, lane = np.frombuffer(block, "<u4", HEADER).tolist()
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, U64)
    lanes = -(-n // lane)
    offsets = np.append(np.frombuffer(block, "<u4", lanes, 4 * HEADER).astype(np.int64), n_words)
    body = 4 * (HEADER + lanes)
    low, high = first // lane, -(-last // lane)
    words = np.frombuffer(block, "<u8", int(offsets[high] - offsets[low]), body + 8 * int(offsets[low])).astype(U64)
    spare = np.frombuffer(block, "<u8", n_escaped, body + 8 * n_words)
    selectors, payload = (words & U64(15)).astype(np.uint8), words >> U64(4)
    counts = np.array(COUNTS)[selectors]
    begins = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=U64)
    for s in range(len(COUNTS)):
        at = np.flatnonzero(selectors == s)
        if not len(at):
            continue
        first_place, bits = begins[at], payload[at]
        if s == 0:
            out[first_place] = spare[bits.astype(np.int64)]
            continue
        mask = U64((1 << WIDTHS[s]) - 1)
        for j in range(COUNTS[s]):
            out[first_place + j] = (bits >> U64(WIDTHS[s] * j)) & mask
    return out[first - low * lane : last - low * lane]


# One row of a token file: the documents of a block in order, their number of ids and the ids themselves. A document is
# never split; null document ids come first and are only counted.
BLOCK = "part int, block long, before long, n_docs int, n_null int, n_ids long, doc_ids binary, counts binary, ids binary"


def writer(path: str, end_id: int):
    def run(batches):
        encoder = Encoder.shared(path)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first, last, ids, counts in encoder.column(batch.column(1), BLOCK_BYTES):
                ids, counts = with_end(ids, counts, end_id)
                docs = batch.column(0).slice(first, last - first)
                known = docs.drop_null().to_numpy()
                row = [part, block, before, len(docs), docs.null_count, len(ids)]
                row += [encode(known.view(U64)), encode(counts), encode(ids)]
                yield pa.RecordBatch.from_pydict({name: [v] for name, v in zip([c.split()[0] for c in BLOCK.split(", ")], row, strict=True)}, schema=BLOCK_ARROW)
                block, before = block + 1, before + len(ids)

    return run


BLOCK_ARROW = pa.schema(
    [(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in BLOCK.split(", "))]
)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end_id``, into token files under ``path``.

    Documents lie in ascending id order across files and blocks (a null id first, equal ids in any order); a null text
    is empty and has the end id alone. A block holds the documents of about 1 MB of text, so no row grows with the
    table; one longer text is one block. Other columns are ignored, no rows give no blocks.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(writer(vocabulary, end_id), BLOCK).write.parquet(path)


def reader(batches):
    for batch in batches:
        for row in batch.to_pylist():
            known, counts = decode(row["doc_ids"]).view(np.int64), decode(row["counts"]).astype(np.int64)
            ids = decode(row["ids"]).astype("<u4")
            begins = np.cumsum(counts) - counts
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begins.tolist(), counts.tolist(), strict=True)]
            docs = pa.concat_arrays([pa.nulls(row["n_null"], pa.int64()), pa.array(known)])
            yield pa.RecordBatch.from_arrays([docs, pa.array(begins + row["start"]), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks under ``path`` with ``start``, the number of ids in all blocks before. One total per file is summed up, not the blocks."""
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # One row per file: no more than there are shuffle partitions.
    return stored.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("before"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids of every document, decoded from the files."""
    return blocks(spark, path).select("start", "n_null", "doc_ids", "counts", "ids").mapInArrow(reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids as an array, decoded from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known, counts = decode(row["doc_ids"]).view(np.int64), decode(row["counts"]).astype(np.int64)
                docs = pa.concat_arrays([pa.nulls(row["n_null"], pa.int64()), pa.array(known)])
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(decode(row["ids"]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([docs, ids], names=["doc_id", "ids"])

    return spark.read.parquet(path).select("n_null", "doc_ids", "counts", "ids").mapInArrow(run, "doc_id long, ids array<long>")


def stored_tokens(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files into the shared folder and return their index, read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col)
    return read_index(docs.sparkSession, path)
