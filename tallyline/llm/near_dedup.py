"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.components import merged
from tallyline.llm.shared import dropped, saved

U32 = np.uint32


def permute(x: np.ndarray, spare: np.ndarray, factors: tuple[int, int]) -> None:
    """A permutation of the 32-bit numbers, in place."""
    for shift, factor in zip((16, 15), factors, strict=True):
        np.right_shift(x, U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, U32(factor), out=x)
    np.right_shift(x, U32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


# Odd factors of the two permutations: the first deals the shingles over the circle, the second is the one that is shifted.
DEAL, SHIFTED = (0x21F0AAAD, 0xD35A2D97), (0x7FEB352D, 0x846CA68B)


def circulant_minhash(items: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash coordinates (coordinates x rows) of the rows whose 64-bit items start at ``begins``; no row may be empty.

    Two permutations serve for all coordinates: coordinate k takes the minimum of the second one, shifted k places
    round the circle of 32-bit numbers, over the places the first one gave to the items.
    """
    placed = (items ^ (items >> T.U64(32))).astype(U32)
    work, spare = np.empty_like(placed), np.empty_like(placed)
    permute(placed, spare, DEAL)
    out = np.empty((coordinates, len(begins)), dtype=U32)
    for k in range(coordinates):
        np.add(placed, U32(k), out=work)
        permute(work, spare, SHIFTED)
        out[k] = np.minimum.reduceat(work, begins)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each row and band (rows x bands); keys of different bands differ."""
    rows = signature.shape[0] // bands
    parts = signature.reshape(bands, rows, -1).astype(T.U64)
    factors = T.seeds(rows, 71)
    sums = (parts * factors[None, :, None]).sum(axis=1, dtype=T.U64)
    return T.mix(T.mix(sums) + T.seeds(bands, 73)[:, None]).T


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def shingle_sets(column: pa.Array, size: int):
    """First and last row, the sorted distinct shingles of these rows one after another, and how many each row has."""
    for first, last, data, offsets in T.slices(column):
        hashes, _, firsts = T.words(data, offsets, T.SPACED)
        items, begins = T.shingles(hashes, firsts, size)
        sets = [np.unique(items[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
        yield first, last, np.concatenate(sets), np.array([len(s) for s in sets], dtype=np.int64)


SIGNED = "id long, n long, f1 long, f2 long, bands array<long>"


def signer(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for first, last, items, counts in shingle_sets(batch.column(1), size):
                full = np.flatnonzero(counts)
                prints = np.zeros((2, len(counts)), dtype=T.U64)
                keys = np.zeros((0, bands), dtype=T.U64)
                if len(full):
                    begins = (np.cumsum(counts) - counts)[full]
                    for i, seed in enumerate(T.seeds(2, 79)):
                        prints[i, full] = np.add.reduceat(T.mix(items * seed), begins)
                    keys = band_keys(circulant_minhash(items, begins, bands * rows), bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts), *(pa.array(p.view(np.int64)) for p in prints), lists(keys, (counts > 0) * bands)],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    return run


def set_reader(size: int):
    def run(batches):
        for batch in batches:
            for first, last, items, counts in shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists(items, counts)], names=["id", "items"])

    return run


class Sets:
    """How the full sets of ids are fetched and compared: here as arrays of 64-bit items."""

    few = 0  # members up to which a bucket goes on as it is instead of by rare items

    def __init__(self, fetch, percent: int):
        self.fetch = fetch  # from a frame of ids to (id, body, n), n being the size of the set
        self.percent = percent

    def linked(self, both: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach ``percent`` hundredths of Jaccard similarity, from (a, b, x, y) with their bodies."""
        common = F.size(F.array_intersect("x", "y"))
        return both.where(100 * common >= self.percent * (F.size("x") + F.size("y") - common)).select("a", "b")

    def items(self, bodies: DataFrame) -> DataFrame:
        """(id, items) from (id, body)."""
        return bodies.select("id", F.col("body").alias("items"))


GROWTH = 4  # log2 of how many times more hubs each round has
BUCKET = ("key", "id", "n", "pos", "root", "least", "members")
ANY_HUB = 2  # the last round in which members of a bucket's first component are hubs too


def several_roots(buckets: DataFrame) -> DataFrame:
    """The rows of buckets whose members lie in more than one component, with the least root and the number of members."""
    keys = buckets.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members")).where("least < most")
    return buckets.drop("least", "members").join(keys.drop("most"), "key")


def unlike_buckets(buckets: DataFrame, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """The rows of buckets with several components; of those with the same members only the first by ``order``.

    Members are the same where their number and two 64-bit sums agree. ``order`` holds columns that depend on the key
    alone. A bucket with the same members as another would only bring the same pairs again.
    """
    sums = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"sum_{i}") for i in range(2)]
    roots = [F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members")]
    keys = buckets.groupBy(*dict.fromkeys((*order, "key"))).agg(*sums, *roots).where("least < most")
    single = keys.groupBy("members", "sum_0", "sum_1").agg(F.min(F.struct(*dict.fromkeys((*order, "key")))).alias("k")).select("k.key")
    return buckets.join(single, "key")


def hubs_of(active: DataFrame, step: int) -> DataFrame:
    """(key, hub_id, hub_n, hub_pos, hub_root): 16 ** step hubs of each bucket at most, one of each part of its members.

    A bucket of no more members has all of them as hubs and is done with this round. The first rounds take them from all members, so that texts with many links join at a few comparisons each. Later the
    members of the component with the least root, mostly the largest, are no hubs: a pair between components has an end
    outside it, so the others meet all members and the large component is not compared with them hub by hub.
    """
    if step > ANY_HUB:
        active = active.where("root > least")
    parts = F.lit(1 << min(GROWTH * step, 62))
    part = F.pmod(F.xxhash64("id", F.lit(step)), parts)
    if step:
        part = F.when(F.col("members") <= parts, F.col("id")).otherwise(part)
    hub = F.min(F.struct(F.xxhash64("id").alias("rank"), *(F.col(c).alias(f"hub_{c}") for c in ("id", "n", "pos", "root")))).alias("h")
    return active.groupBy("key", part.alias("part")).agg(hub).select("key", "h.*").drop("rank")


def rare_buckets(members: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Buckets (key, id, n, pos, root) by rare items, such that every pair that reaches ``percent`` shares one.

    Two sets of that similarity agree in at least that part of either, so they share one of the first
    n - ceil(n * percent / 100) + 1 items of each, in any fixed order. Rarest first, the items that only one member has
    fill these places before common passages do, and texts that differ too much meet in no bucket. Of buckets with the
    same members the first in that order stays: there their places are the least, so it brings every pair of the others.
    """
    tokens = saved(items.join(members, "id").select("id", "n", "root", F.explode("items").alias("key")), "tokens")
    often = tokens.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # Sorted by a window: a list of each member's items would be gathered and sorted twice.
    own = Window.partitionBy("id").orderBy("c", "key")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = tokens.join(often.hint("shuffle_hash"), "key").select("key", "id", "n", "root", "c", F.row_number().over(own).alias("at"), F.count("*").over(whole).alias("m"))
    # A member's other n - m items stand before the shared ones.
    kept = shared.where(f"at <= n - ceil(n * {percent} / 100.0) + 1 - (n - m)")
    kept = saved(kept.select("key", "id", "n", (F.col("n") - F.col("m") + F.col("at") - 1).alias("pos"), "root", "c"), "kept")
    rare = saved(unlike_buckets(kept, ("c", "key")).select("key", "id", "n", "pos", "root"), "rare")
    dropped(tokens, kept)
    return rare


def link_components(buckets: DataFrame, sets: Sets, bodies: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components over the links between ids that share a bucket, from rows (key, id).

    First every member is compared with one hub of each of its buckets. That joins groups of similar texts at one
    comparison a member. Members of buckets that still hold several components meet again by their rare items
    (``rare_buckets``) and are compared with hubs, more of them each round (``hubs_of``), until each bucket's members
    that have not been hubs are in one component: no pair of different components is left out, yet a group of similar texts is not squared. Buckets
    of at most ``sets.few`` members skip the rare items: comparing these members costs less than dealing out all items.

    bodies are the sets of at least these ids, if they are there already; labels are components known so far.
    """
    percent = sets.percent
    table = saved(buckets, "buckets")
    bodies = saved(sets.fetch(table.select("id").distinct()), "sets") if bodies is None else bodies
    active = table.join(bodies.select("id", "n"), "id").select("key", "id", "n", F.lit(0).cast("long").alias("pos"))
    if labels is None:
        active = active.withColumn("root", F.col("id"))
    else:
        known = active.join(labels.withColumnRenamed("node", "id"), "id", "left")
        known = saved(known.select("key", "id", "n", "pos", F.coalesce("root", "id").alias("root")), "known")
        active = several_roots(known).select("key", "id", "n", "pos", "root")
    before, table = table, saved(active, "buckets")
    dropped(before)
    active = table
    step = 0
    while True:
        hubs = saved(hubs_of(active, step), "hubs")
        close = F.least(F.expr("n - pos"), F.expr("hub_n - hub_pos")) * (100 + percent) >= percent * (F.col("n") + F.col("hub_n"))
        pairs = active.join(hubs, "key").where((F.col("root") != F.col("hub_root")) & close)
        pairs = pairs.select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b")).distinct()
        pairs = saved(pairs, "pairs")
        both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("x")), "a")
        both = both.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
        found = saved(sets.linked(both), "links")
        if not found.isEmpty():
            labels = merged(labels, found)
        now = active
        if labels is not None:
            now = now.drop("root").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        # Buckets that became one component are done, with hubs and all.
        now = several_roots(now).drop("least", "members").join(hubs.select("key", F.col("hub_id").alias("id")), ["key", "id"], "left_anti")
        left = saved(now.select("key", "id", "n", "pos", "root"), "rest")
        rest = several_roots(left)
        members = everyone = rare = many = None
        if not step:
            # What was compared with the only other member of its buckets is done.
            rest = many = saved(rest.select(*BUCKET), "rest")
            small, large = None, rest
            if sets.few:
                small, large = (rest.where(c) for c in (F.col("members") <= sets.few, F.col("members") > sets.few))
            members = saved(large.select("id", "n", "root").distinct(), "members")
            wanted = members.select("id") if small is None else members.select("id").union(small.select("id")).distinct()
            everyone, bodies = bodies, saved(bodies.join(wanted, "id", "left_semi"), "sets")
            rare = rare_buckets(members, sets.items(bodies.join(members.select("id"), "id", "left_semi")), percent)
            rest = several_roots(rare).select(*BUCKET)
            if small is not None:
                rest = rest.union(small.select(*BUCKET))
        before, table = table, saved(rest.select(*BUCKET), "buckets")
        active = table
        dropped(before, hubs, pairs, found, left, many, members, everyone, rare)
        step += 1
        if active.isEmpty():
            return active.select(F.col("id").alias("node"), "root") if labels is None else labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = 20, rows: int = 5) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``size`` lower-cased words (a shorter text is one shingle). Texts
    are linked from ``percent`` hundredths of Jaccard similarity on; component_id is the smallest id reachable and
    kept marks that document. 20 bands of 5 rows miss a link of similarity 0.85 once in 120,000 pairs, one of 0.8 once
    in 2,400. Equal sets (128-bit sums over all shingles) form one class before banding, so a group of
    copies costs one row per band however large it is.

    Null or empty texts and texts without words have no shingles, are their own component and kept. A row without an
    id is returned with a null component and kept. Rows that share an id are judged each by its text. No
    rows give no rows; other columns are ignored.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = saved(given.mapInArrow(signer(size, bands, rows), SIGNED), "signatures")
    cls = ["n", "f1", "f2"]
    classes = saved(signed.where("n > 0 and id is not null").groupBy(*cls).agg(F.min("id").alias("rep")), "classes")
    members = saved(
        signed.where("n > 0 and id is not null").join(classes, cls).select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "members"
    )
    buckets = members.where("bands is not null").select(F.explode("bands").alias("key"), "id")
    shared = buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = buckets.join(shared, "key").select("key", "id")

    def fetch(ids: DataFrame) -> DataFrame:
        found = given.join(ids, "id", "left_semi").mapInArrow(set_reader(size), "id long, items array<long>")
        return found.select("id", F.col("items").alias("body"), F.size("items").cast("long").alias("n"))

    roots = link_components(buckets, Sets(fetch, percent))
    found = members.select("id", "n", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    found = found.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
    alone = signed.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    out = found.union(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
