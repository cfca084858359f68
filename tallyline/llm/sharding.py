"""Shards of near-equal bytes by minimax contiguous partition, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.shared import saved

OVERHEAD = 16  # bytes of a row besides its text
SLOT_BUCKETS = 3  # hex digits of the id's digest that share out a shard's slots


class Summary:
    """Ordered groups, summed by key prefix: (prefix, bytes, groups, largest group). Prefixes cover the whole order."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = rows
        self.ends = list(accumulate(r[1] for r in rows))
        self.total = self.ends[-1] if rows else 0

    def cut(self, start: int, capacity: int, divisible: bool) -> int:
        """How far a shard of that capacity reaches from ``start``. A prefix of several groups is taken whole or, if divisible, in any part."""
        limit = start + capacity
        if limit >= self.total:
            return self.total
        i = bisect_right(self.ends, limit)
        if divisible and self.rows[i][2] > 1:
            return limit
        return self.ends[i - 1] if i else 0

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """The greedy ends of the shards."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, self.cut(at, capacity, divisible))
            out.append(at)
        return out

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest capacity at which the greedy cuts reach the end."""
        low = max(-(-self.total // shards), max((r[3] for r in self.rows), default=0))
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, divisible)[-1] == self.total:
                high = mid
            else:
                low = mid + 1
        return high

    def open_prefixes(self, low: int, high: int, shards: int) -> list[int]:
        """Numbers of the prefixes of several groups in which a cut may lie while the capacity is from low to high."""
        found = {i for i, r in enumerate(self.rows) if r[2] > 1 and r[1] > low}
        for a, b in zip(self.cuts(low, shards, False), self.cuts(high, shards, True), strict=True):
            first, last = bisect_right(self.ends, a), bisect_left(self.ends, b)
            found |= {i for i in range(first, min(last, len(self.rows) - 1) + 1) if self.rows[i][2] > 1}
        return sorted(found)


def _sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    rows = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most")
    )
    return sorted((r["prefix"], r["bytes"], r["n"], r["most"]) for r in rows.collect())


def shard_starts(groups: DataFrame, shards: int, digits: int = 4) -> tuple[int, list[str]]:
    """The smallest capacity that ``shards`` contiguous runs of whole groups need, and the key prefixes at which shards 1, 2, ... begin.

    groups has ``key`` (hex) and ``bytes``; its order is that of the keys. Bounds on the capacity come from sums over
    key prefixes (at most 16 to the power ``digits`` rows): prefixes taken whole give an upper bound, prefixes that can
    be cut anywhere a lower one, each by binary search over greedy checks. Only the few prefixes in which a cut can
    still lie are split by one more digit, in one job over just their keys, until both bounds meet at group boundaries.
    Shards left over when there are few groups stay empty: they begin after every key.
    """
    summary = Summary(_sums(groups, digits))
    while True:
        low, high = summary.smallest(shards, True), summary.smallest(shards, False)
        unclear = summary.open_prefixes(low, high, shards)
        if not unclear:
            break
        digits += 1
        prefixes = [summary.rows[i][0] for i in unclear]
        # One set look-up for each length of prefix, however many there are.
        wanted = F.lit(False)
        for n in sorted({len(p) for p in prefixes}):
            wanted = wanted | F.substring("key", 1, n).isin([p for p in prefixes if len(p) == n])
        finer = _sums(groups.where(wanted), digits)
        split = set(prefixes)
        summary = Summary(sorted([r for r in summary.rows if r[0] not in split] + finer))
    starts = []
    for end in summary.cuts(high, shards, False)[:-1]:
        i = bisect_right(summary.ends, end) if end else 0
        starts.append(summary.rows[i][0] if i < len(summary.rows) else "g")
    return high, starts


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every document.

    Documents of equal text stay together. Groups lie in the order of their texts' SHA-256; shards are contiguous runs
    of groups, cut greedily at the smallest capacity for which ``shards`` runs suffice. Slots of a shard are gapless from 0, in the order of
    the ids' MD5 beginnings, then ids: each beginning is numbered on its own and shifted by the count of those before,
    so no task holds a shard.

    A null text counts as empty (size 16, crc 0). Null and repeated ids have slots of their own. No rows give no rows;
    other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, SLOT_BUCKETS).alias("part"),
    )
    rows = saved(rows, "sizes")
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, starts = shard_starts(groups, shards)
    if starts:
        where = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("key")))
    else:
        where = F.lit(0)
    placed = rows.withColumn("shard", where.cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    out = placed.withColumn("own", own).join(bases, ["shard", "part"])
    return out.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("own")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
