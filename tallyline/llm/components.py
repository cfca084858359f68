"""Connected components by distributed union-find over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tallyline.llm.shared import dropped, saved

EDGES = 1 << 19  # edges a task unites by itself


def stars(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (least node, node) of the stars that join the same nodes as the edges (lo, hi)."""
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b = at[: len(lo)], at[len(lo) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[below]], nodes[below]


def _united(edges: DataFrame, n: int) -> DataFrame:
    """The n edges, those of a task as stars. A task holds about ``EDGES`` of them, so the tasks grow with the edges."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size >= 2 * EDGES:
                yield result(held)
                held, size = [], 0
        if held:
            yield result(held)

    def result(held):
        found = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in found], names=["lo", "hi"])

    kind = pa.int64() if isinstance(edges.schema["lo"].dataType, K.LongType) else pa.string()
    return edges.coalesce(-(-n // EDGES)).mapInArrow(run, edges.schema)


def _hook(edges: DataFrame) -> DataFrame:
    """Join every neighbour above a node to the least node of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _shorten(edges: DataFrame) -> DataFrame:
    """Join every node and its lower neighbours to the least of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    lower = edges.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return lower.union(least.select(F.col("m").alias("lo"), "hi")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node it can reach, itself left out if it is that root.

    A task unites the edges it reads, up to ``EDGES`` of them (numbers and strings). Where there are more, hooking and
    shortening alternate with that until the edges are stars; the number of rounds grows with the logarithm of the
    number of nodes. Minima are combined before each shuffle, so a hub's many edges do not meet in one task. a and b
    may have any type with an order. Edges with a null end, loops and repeated edges count as absent or once; no edges
    give no rows.
    """
    now = saved(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("a is not null and b is not null and a <> b").distinct(),
        "edges",
    )
    plain = isinstance(now.schema["lo"].dataType, (K.LongType, K.StringType))
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state["n"] == 0:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        alone = plain and state["n"] <= EDGES
        part = _united(now, state["n"]) if plain else now
        seen, before, now = state, now, saved(part if alone else _shorten(_hook(part)), "edges")
        dropped(before)
        if alone:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (node, root) after more links (a, b): only the roots the links meet are united; the old table goes."""
    if labels is None:
        return components(links)
    of = lambda end: labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    up = components(met.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    up = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    joined = up.select(F.col("root").alias("node"), F.col("top").alias("root")).join(labels.select("node"), "node", "left_anti")
    out = saved(moved.union(joined), "labels")
    dropped(labels)
    return out
