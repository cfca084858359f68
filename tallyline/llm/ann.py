"""Nearest neighbours by inner product from a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.shared import saved

TREES, BITS = 64, 32
BLOCK, CHUNK = 40_000, 500  # distinct vectors in one forest, queries that visit it together


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One string of BITS bits per tree and vector (trees x vectors): the sides of the tree's random planes."""
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    out = np.empty((TREES, len(x)), dtype=np.uint64)
    for t in range(TREES):
        out[t] = ((x @ planes[t] > 0) * weights).sum(axis=1, dtype=np.uint64)
    return out


class Forest:
    """Sorted arrays of hash strings, one per tree, over a block of vectors.

    For the inner product each vector gets one more component that brings all of a block to the same length; a
    query has 0 there, so the largest product is the smallest angle.
    """

    def __init__(self, x: np.ndarray):
        norms = (x * x).sum(axis=1)
        level = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.planes = np.random.default_rng(2024).normal(size=(TREES, x.shape[1] + 1, BITS))
        strings = hash_strings(np.column_stack([x, level]), self.planes)
        self.order = np.argsort(strings, axis=1)
        self.strings = np.take_along_axis(strings, self.order, axis=1)
        self.x = x

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per tree, prefix length and query the run of strings that share so long a prefix (trees x BITS + 1 x queries)."""
        strings = hash_strings(np.column_stack([queries, np.zeros(len(queries))]), self.planes)
        low = np.empty((TREES, BITS + 1, len(queries)), dtype=np.int32)
        high = np.empty_like(low)
        for length in range(BITS + 1):
            free = np.uint64((1 << (BITS - length)) - 1)
            for t in range(TREES):
                low[t, length] = np.searchsorted(self.strings[t], strings[t] & ~free, "left")
                high[t, length] = np.searchsorted(self.strings[t], strings[t] | free, "right")
        return low, high

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the members met once all trees together yield ``wanted``.

        Every tree is entered at its longest match; all trees then ascend together, one bit at a time.
        """
        low, high = self.ranges(queries)
        sizes = (high - low).sum(axis=0)
        met = np.zeros(len(self.x), dtype=bool)
        for q in range(len(queries)):
            # Fewer strings than wanted members cannot hold them all.
            length = int(np.flatnonzero(sizes[:, q] >= min(wanted, len(self.x)))[-1])
            met[:] = False
            while True:
                for t in range(TREES):
                    met[self.order[t, low[t, length, q] : high[t, length, q]]] = True
                if length == 0 or np.count_nonzero(met) >= wanted:
                    break
                length -= 1
            yield np.flatnonzero(met)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def searcher(k: int, wanted: int, share: float):
    """Cogroup function: the best k + 1 ids of a block for every query that visits it."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"cid": [], "vec_id": [], "score": []}
        if members.num_rows and queries.num_rows:
            members = members.sort_by("cid")
            x, ids = matrix(members.column("embedding")), members.column("ids").combine_chunks()
            starts, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
            forest = Forest(x)
            y, cids = matrix(queries.column("embedding")), queries.column("cid").to_numpy()
            for q, found in enumerate(forest.candidates(y, max(wanted, int(np.ceil(share * len(x)))))):
                scores = (x[found] * y[q]).sum(axis=1)
                # Members are in the order of their least ids, so equal scores stay in that order.
                best = np.argsort(-scores, kind="stable")[: k + 1]
                for i in best.tolist():
                    own = flat[starts[found[i]] : starts[found[i] + 1]]
                    out["cid"].append(np.full(len(own), cids[q]))
                    out["vec_id"].append(own)
                    out["score"].append(np.full(len(own), scores[i]))
        return pa.table(
            {n: np.concatenate(v) if v else np.zeros(0, t) for (n, v), t in zip(out.items(), (np.int64, np.int64, np.float64), strict=True)}
        )

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 20, wanted: int = 5_000, share: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product for every row that ``queries``, a SQL condition, selects.

    Equal vectors form one class with its k + 1 least ids: more of them cannot be among the k nearest. Classes are
    dealt to blocks of about BLOCK, and the queries visit every block in groups of about CHUNK. In a block the trees
    yield at least ``wanted`` and at least ``share`` of its classes; these are scored in double precision on the
    original vectors. A query never meets itself, ties go to the smaller id. ``share`` decides the recall, and keeps it
    as the table grows; the README gives it against brute force.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those of another
    length than most vectors have, nor rows without id; a repeated id counts with each of its vectors. No rows give no
    rows; other columns are ignored.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    given = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0))
    given = given.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"), F.coalesce(F.expr(queries), F.lit(False)).alias("asks"))
    width = given.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    given = given.where(F.size("embedding") == (width["w"] if width else 0))
    least = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = given.withColumn("r", least).where(F.col("r") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = saved(few.select(F.col("ids")[0].alias("cid"), "ids", "embedding"), "classes")
    asking = saved(given.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").join(classes.select("cid", "embedding"), "embedding").select("query_id", "cid"), "queries")
    starters = saved(classes.join(asking.select("cid").distinct(), "cid", "left_semi").select("cid", "embedding"), "starters")
    blocks, chunks = max(1, -(-classes.count() // BLOCK)), max(1, -(-starters.count() // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    members = classes.select("cid", "ids", "embedding", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"))
    visits = starters.select("cid", "embedding", every(blocks).alias("block"), F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))
    found = members.groupBy("block", "chunk").cogroup(visits.groupBy("block", "chunk")).applyInArrow(searcher(k, wanted, share), "cid long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id"))
    found = saved(found.withColumn("r", best).where(F.col("r") <= k + 1).select("cid", "vec_id", "score"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = asking.join(found, "cid").where("vec_id <> query_id").withColumn("rank", rank)
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
