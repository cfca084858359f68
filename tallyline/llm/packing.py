"""Best-fit packing of token sequences by hierarchical residual rounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import saved
from tallyline.llm.tokens import Encoder, with_end

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "fill int, closed boolean, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of every item and the number of bins: largest items first, each into the fullest bin with room.

    Bins are found by their room: a bit is set for every room that some bin has.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0
    out = np.empty(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            at, room = n, capacity
            n += 1
        out[item] = at
        room -= size
        if room:
            rooms[room].append(at)
            free |= 1 << room
    return out, n


def packed(items: pa.ListArray, sizes: np.ndarray, capacity: int, slack: int) -> pa.RecordBatch:
    """One row per bin over items that are lists of pieces. A bin with at most ``slack`` places left is closed."""
    where, n = best_fit(sizes, capacity)
    order = np.argsort(where, kind="stable")
    members = items.take(pa.array(order))
    counts = np.bincount(where, weights=np.diff(items.offsets.to_numpy()), minlength=n).astype(np.int64)
    fills = np.bincount(where, weights=sizes, minlength=n).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), members.flatten())
    return pa.RecordBatch.from_arrays(
        [pa.array(fills), pa.array(fills >= capacity - slack), lists], names=["fill", "closed", "pieces"]
    )


def pieces_of(docs: pa.Array, counts: np.ndarray, ids: np.ndarray, capacity: int) -> tuple[pa.ListArray, np.ndarray]:
    """The pieces of the documents, one list each, and their lengths: a first one of the remainder, then full ones."""
    n = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = counts - (n - 1) * capacity
    length = np.where(piece == 0, head[doc], capacity)
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    at = (np.cumsum(counts) - counts)[doc] + start
    crc = [zlib.crc32(ids[a : a + size]) for a, size in zip(at.tolist(), length.tolist(), strict=True)]
    fields = [docs.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
    rows = pa.StructArray.from_arrays(fields, names=[f.name for f in PIECE])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32)), rows), length


def cutter(path: str, end_id: int, capacity: int, slack: int, batch_items: int):
    def run(batches):
        encoder = Encoder.shared(path)
        held, sizes = [], []

        def emit():
            return packed(pa.concat_arrays(held), np.concatenate(sizes), capacity, slack)

        for batch in batches:
            for first, last, ids, counts in encoder.column(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                items, lengths = pieces_of(batch.column(0).slice(first, last - first), counts, ids.astype("<u4"), capacity)
                held.append(items)
                sizes.append(lengths)
                if sum(map(len, sizes)) >= batch_items:
                    yield emit()
                    held, sizes = [], []
        if held:
            yield emit()

    return run


def loosened(items: pa.ListArray, sizes: np.ndarray, below: float) -> tuple[pa.ListArray, np.ndarray]:
    """The items of at least a size as they are, the pieces of the others each by itself."""
    loose = pa.array(sizes < below)
    pieces = items.filter(loose).flatten()
    kept = items.filter(pc.invert(loose))
    single = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), pieces)
    return pa.concat_arrays([kept, single.cast(kept.type)]), np.concatenate([sizes[sizes >= below], pieces.field("length").to_numpy()])


def repacker(capacity: int, slack: int):
    """Packs bins as items; where that needs fewer bins, the emptier half, or all, are taken apart."""

    def run(batches):
        held = [(b.column(0), b.column(1).to_numpy()) for b in batches if len(b)]
        if held:
            items, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]).astype(np.int64)
            ways = [(items, sizes), *(loosened(items, sizes, below) for below in (np.median(sizes), capacity + 1))]
            yield min((packed(*way, capacity, slack) for way in ways), key=len)

    return run


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    slack: int = 0, fan_in: int = 8, batch_items: int = 200_000, patience: int = 8,
) -> DataFrame:
    """Pack the token ids of all texts into sequences of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id; only one longer than ``capacity`` is cut, into full pieces after a first one
    that may be shorter. Every task packs its pieces best-fit and closes the bins with at most ``slack`` ids of room.
    The others become items of the next round, the emptier ones in pieces where that saves bins, where ``fan_in`` times fewer tasks pack what several tasks left over,
    until one task has packed all that was left. Where that is more than a task may hold, bins are dealt anew until
    ``patience`` rounds on end have saved less than one bin in a thousand: then those left do not fit together. A task packs at most ``batch_items`` items at once, so no task's memory grows with the table.

    Null and empty texts have the end id alone; rows with a null or repeated id are packed like others. No rows give no
    pieces; other columns are ignored.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks, base = given.rdd.getNumPartitions(), 0

    def numbered(bins: DataFrame) -> DataFrame:
        """Rounds have ranges of numbers of their own, tasks too."""
        return saved(bins.withColumn("bin", F.monotonically_increasing_id() + F.lit(base)), "bins")

    bins = numbered(given.mapInArrow(cutter(vocabulary, end_id, capacity, slack, batch_items), BINS))
    done = bins.where("closed")
    rest = bins.where("not closed")
    step, left, fruitless = 0, rest.count(), 0
    while left > 1:
        before, wider, step, base = left, tasks, step + 1, base + (tasks << 33)
        tasks = max(-(-tasks // fan_in), -(-left // batch_items))
        # Which bins meet changes from round to round: by chance, or those as far above half full as others are below.
        chance = F.xxhash64("bin", F.lit(step))
        if step % 2 or tasks == 1:
            dealt = rest.repartition(tasks, chance)
        else:
            dealt = rest.repartitionByRange(tasks, F.abs(2 * F.col("fill") - capacity), chance)
        bins = numbered(dealt.select("pieces", "fill").mapInArrow(repacker(capacity, slack), BINS))
        done = done.union(bins.where("closed"))
        rest = bins.where("not closed")
        left = rest.count()
        fruitless = fruitless + 1 if tasks >= wider and before - left < before / 1000 else 0
        if tasks == 1 or fruitless >= patience:
            break
    every = done.union(rest)
    rows = every.select(F.col("bin").alias("sequence_id"), "pieces", F.posexplode("pieces").alias("at", "p"))
    offset = F.expr("aggregate(slice(pieces, 1, at), 0L, (s, x) -> s + x.length)")
    return rows.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", offset.alias("offset")).withColumnRenamed("doc_id", id_col)
