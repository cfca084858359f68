"""Jaccard join of n-gram sets: tokens hashed into groups, R-trees over the group counts, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.bitmap import Bitmap
from tallyline.llm.components import merged
from tallyline.llm.near_dedup import lists, shingle_sets
from tallyline.llm.shared import saved

GROUPS = 256  # coordinates of a point
FANOUT = 16  # entries of a node
TILE = 2048  # points of one tree
CHUNK = 4_000  # pairs of nodes looked at together
SEED = 101


class SizeClasses:
    """Ranges of set sizes such that linked sets lie in one range or in neighbouring ones, and how finely a range groups its tokens.

    Two sets of the range (or one of it and one of the range below) that are linked differ in at most t tokens. Dealt
    into more than t groups, they agree in all of some group; ``spare`` more groups make sure that one which is not empty is among
    them, unless a set leaves more than ``spare`` groups empty.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.first, self.groups, self.spare = [1], [], []

    def reach(self, size: int) -> None:
        """Know the range of a size and the one above."""
        while len(self.first) < 3 or self.first[-2] <= size:
            last = self.first[-1] * 100 // self.percent
            t = 2 * last * (100 - self.percent) // (100 + self.percent)
            self.spare.append(1 + (t + 1) // 20 if t else 0)
            # Equal sets are one class before; they need no group.
            self.groups.append(t + 1 + self.spare[-1] if t else 0)
            self.first.append(last + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.first), sizes, side="right") - 1


def agreement_keys(items: np.ndarray, counts: np.ndarray, classes: SizeClasses) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) such that linked rows share a key. Each row's items are sorted; a key is the whole content of one group of a row."""
    own = classes.of(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    for above in (0, 1):
        level = own + above
        groups = np.where(counts > 0, np.array(classes.groups, dtype=T.U64)[level], T.U64(0))
        spare = np.array(classes.spare)[level]
        part = ((items >> T.U64(32)) * groups[row]) >> T.U64(32)
        used = np.flatnonzero(groups[row] > 0)
        if not len(used):
            continue
        r, p = row[used], part[used]
        starts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
        sums = np.add.reduceat(T.mix(items[used] * T.seeds(1, SEED)[0]), starts)
        places = T.mix(level[r[starts]].astype(T.U64) * T.U64(T.BASE) + p[starts])
        yield r[starts], T.mix(sums + places)
        filled = np.bincount(r[starts], minlength=len(counts))
        for i in np.flatnonzero(groups.astype(np.int64) - filled > np.where(groups > 0, spare, np.iinfo(np.int64).max)):
            empty = np.setdiff1d(np.arange(int(groups[i]), dtype=T.U64), p[r == i])
            yield np.full(len(empty), i), T.mix(T.mix(T.U64(int(level[i]) * T.BASE % (1 << 64)) + empty) + T.U64(1))


def group_counts(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many items of each row fall into each of ``GROUPS`` groups (rows x groups)."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = row * GROUPS + (items & T.U64(GROUPS - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(counts) * GROUPS).reshape(-1, GROUPS).astype("<u4")


def set_signer(size: int):
    """(id, n, f1, f2): the size of every set and two sums over all its items."""

    def run(batches):
        for batch in batches:
            for first, last, items, counts in shingle_sets(batch.column(1), size):
                full = np.flatnonzero(counts)
                prints = np.zeros((2, len(counts)), dtype=T.U64)
                if len(full):
                    begins = (np.cumsum(counts) - counts)[full]
                    for i, seed in enumerate(T.seeds(2, SEED + 1)):
                        prints[i, full] = np.add.reduceat(T.mix(items * seed), begins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts), *(pa.array(p.view(np.int64)) for p in prints)], names=["id", "n", "f1", "f2"]
                )

    return run


def key_reader(size: int, percent: int, chosen=iter):
    """(id, key) of the rows (id, text) that ``chosen`` lets pass."""

    def run(batches):
        classes = SizeClasses(percent)
        for batch in chosen(batches):
            for first, last, items, counts in shingle_sets(batch.column(1), size):
                ids = batch.column(0).slice(first, last - first)
                for row, keys in agreement_keys(items, counts, classes):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(keys.view(np.int64))], names=["id", "key"])

    return run


def point_reader(size: int, percent: int, chosen=iter):
    """(id, n, cls, point, items) of the rows that ``chosen`` lets pass: their sets' size and its class, their group counts and their items."""

    def run(batches):
        classes = SizeClasses(percent)
        for batch in chosen(batches):
            for first, last, items, counts in shingle_sets(batch.column(1), size):
                points = [row.tobytes() for row in group_counts(items, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts), pa.array(classes.of(counts)), pa.array(points, pa.binary()), lists(items, counts)],
                    names=["id", "n", "cls", "point", "items"],
                )

    return run


def expand(a: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the pairs of nodes; of a node with itself, each pair once."""
    na, nb = end[a] - begin[a], end[b] - begin[b]
    total = na * nb
    which = np.repeat(np.arange(len(a)), total)
    at = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    left, right = begin[a][which] + at // nb[which], begin[b][which] + at % nb[which]
    once = (a != b)[which] | (left <= right)
    return left[once], right[once]


class Forest:
    """R-trees over count vectors, bulk-loaded in the order of sizes and first coordinates; all trees are searched together.

    A node knows the greatest count in each group, the range of sizes and the range of components below it. No set below one node shares
    more items with a set below another than the sum of the smaller of their counts.
    """

    def __init__(self, tree: np.ndarray, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], sizes, tree))
        tree = tree[self.order]
        top, small, large, least, most = (x[self.order] for x in (points, sizes, sizes, roots, roots))
        self.levels = [(top, small, large, least, most)]
        self.children = [(None, None)]
        while True:
            starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            if len(starts) == len(tree) and len(self.levels) > 1:
                break
            rank = np.arange(len(tree)) - np.repeat(starts, np.diff(np.append(starts, len(tree))))
            begin = np.flatnonzero(rank % FANOUT == 0)
            self.children.append((begin, np.append(begin[1:], len(tree))))
            tree = tree[begin]
            top, large, most = (np.maximum.reduceat(x, begin) for x in (top, large, most))
            small, least = (np.minimum.reduceat(x, begin) for x in (small, least))
            self.levels.append((top, small, large, least, most))
        self.trees = tree  # one node each at the last level

    def near(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of nodes may hold links between different components, and the bound on what their sets share."""
        top, small, large, least, most = self.levels[level]
        p = self.percent
        fits = (large[a] * 100 >= p * small[b]) & (large[b] * 100 >= p * small[a])
        fits &= (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        a, b = a[fits], b[fits]
        shared = np.minimum(top[a], top[b]).sum(axis=1, dtype=np.int64)
        fits[fits] = shared * (100 + p) >= p * (small[a] + small[b])
        return fits, shared[(shared * (100 + p) >= p * (small[a] + small[b]))]

    def search(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound) of all points of the pairs of trees (a, b) that may be linked and lie in different components."""
        found = []
        stack = [(len(self.levels) - 1, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > CHUNK:
                stack += [(level, a[CHUNK:], b[CHUNK:]), (level, a[:CHUNK], b[:CHUNK])]
                continue
            fits, shared = self.near(level, a, b)
            a, b = a[fits], b[fits]
            if not len(a):
                continue
            if level:
                stack.append((level - 1, *expand(a, b, *self.children[level])))
            else:
                found.append((self.order[a], self.order[b], shared))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def best_pairs(i: np.ndarray, j: np.ndarray, score: np.ndarray, want: int) -> np.ndarray:
    """Which pairs are among the ``want`` best of one of their ends."""
    if not len(i):
        return np.zeros(0, dtype=bool)
    ends, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-score[pair], ends))
    ends, pair = ends[order], pair[order]
    starts = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
    rank = np.arange(len(ends)) - np.repeat(starts, np.diff(np.append(starts, len(ends))))
    keep = np.zeros(len(i), dtype=bool)
    keep[pair[rank < want]] = True
    return keep


CANDIDATES = "block long, a long, b long"


def tree_search(percent: int, want: int):
    """Candidate pairs from rows (job, side, block, id, root, n, point) sorted by job and side.

    The points of one side of a job are one tree; the two trees of a job meet, a single one meets itself. Only the ``want`` best
    partners of a point are put out; a row without a pair says that the block has more.
    """

    def result(columns):
        job, side, block, ids, roots, sizes, points = columns
        points = np.frombuffer(b"".join(points), dtype="<u4").reshape(-1, GROUPS)
        _, job = np.unique(job, return_inverse=True)
        tree = job * 2 + side
        forest = Forest(tree, points, sizes, roots, percent)
        first = np.flatnonzero(np.append(True, forest.trees[1:] // 2 != forest.trees[:-1] // 2))
        last = np.append(first[1:], len(forest.trees)) - 1
        i, j, shared = forest.search(first, last)
        score = shared / (sizes[i] + sizes[j])
        keep = best_pairs(i, j, score, want)
        more = np.unique(block[i[~keep]])
        i, j = i[keep], j[keep]
        out = [np.concatenate([block[i], more])]
        for end in (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])):
            out.append(pa.concat_arrays([pa.array(end, pa.int64()), pa.nulls(len(more), pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(out[0]), *out[1:]], names=["block", "a", "b"])

    def task(batches):
        held, size = [], 0
        for batch in batches:
            for first in range(0, len(batch), TILE):
                part = batch.slice(first, TILE)
                held.append([c.to_numpy() for c in part.columns[:-1]] + [np.array(part.column(6).to_pylist(), dtype=object)])
                size += len(part)
                if size < TILE:
                    continue
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                # The last job may go on; it has at most two tiles.
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                if cut:
                    yield result([c[:cut] for c in columns])
                held, size = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if size:
            yield result([np.concatenate(c) for c in zip(*held, strict=True)])

    return task


def tile_jobs(active: DataFrame, local: bool) -> DataFrame:
    """Rows (job, side, block, id, root, n, point): which trees meet.

    A block of at most ``TILE`` points is one tree. A larger one is cut into tiles by size class, by whether a point
    belongs to the block's largest component, and by hash. ``local`` lets every tile meet itself alone; otherwise tiles of the same
    class or neighbouring ones meet, but for those that hold the same single component.
    """
    per_root = active.groupBy("block", "root").agg(F.count("*").alias("c"))
    blocks = per_root.groupBy("block").agg(F.sum("c").alias("m"), F.max_by("root", F.struct("c", "root")).alias("main"))
    rows = active.join(blocks, "block")
    big = F.col("m") > TILE
    cell = ["block", "cls", "core"]
    rows = rows.withColumn("cls", F.when(big, F.col("cls")).otherwise(0)).withColumn("core", big & (F.col("root") == F.col("main")))
    cells = rows.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    rows = rows.join(cells, cell).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    named = [*cell, "tile"]
    tiles = rows.groupBy(*named).agg(F.min("root").alias("least"), F.max("root").alias("most"))
    tiles = tiles.withColumn("t", F.struct("cls", "core", "tile"))
    one = tiles.select("block", F.col("t").alias("x"), F.col("least").alias("l1"), F.col("most").alias("m1"))
    two = tiles.select("block", F.col("t").alias("y"), F.col("least").alias("l2"), F.col("most").alias("m2"))
    if local:
        meets = one.withColumn("y", F.col("x")).where("l1 < m1")
    else:
        same = (F.col("l1") == F.col("m1")) & (F.col("l2") == F.col("m2")) & (F.col("l1") == F.col("l2"))
        meets = one.join(two, "block").where((F.col("x") <= F.col("y")) & (F.col("y.cls") - F.col("x.cls") <= 1) & ~same)
    job = F.xxhash64("block", "x", "y").alias("job")
    ends = meets.select(job, "block", F.explode(F.expr("if(x = y, array(struct(x as t, 0L as side)), array(struct(x as t, 0L as side), struct(y as t, 1L as side)))")).alias("e"))
    ends = ends.select("job", "block", "e.t.*", "e.side")
    return rows.join(ends, named).select("job", "side", "block", "id", "root", "n", "point")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Only the sets of the pairs travel."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    met = sets.select("id", "items").join(saved(ids, "ids"), "id", "left_semi")
    both = pairs.join(met.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(met.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return saved(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def with_roots(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (id) with the root of each."""
    if labels is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def several_roots(rows: DataFrame, group: str) -> DataFrame:
    """The groups that hold several components."""
    return rows.groupBy(group).agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l < m").select(group)


def open_blocks(agreeing: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(id, block): the members of the keys (id, key) that hold several components. Keys with the same members are one block.

    A block is a key's members, not whatever hangs together over keys: few unlike sets agree in one group, but chains of them
    run through most of a large corpus.
    """
    agreeing = agreeing.select("id", "key").distinct()
    several = several_roots(with_roots(agreeing, labels), "key")
    members = saved(agreeing.join(several, "key", "left_semi"), "members")
    per = members.groupBy("key").agg(F.count("*").alias("c"), *[F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)])
    first = per.groupBy("c", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    return members.join(first, "key", "left_semi").select("id", F.col("key").alias("block"))


def linked_components(blocks: DataFrame, sets: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame | None:
    """(node, root) over all links within blocks (id, block) and the labels known, from sets (id, n, cls, point, items); None without links.

    In every round each point finds its best partners in other components, the pairs are verified and the components
    merged. Blocks whose points still have untried partners in other components go on, with sixteen times as many partners
    a point, until none is left untried.
    """
    active = saved(with_roots(sets.select("id", "n", "cls", "point").join(blocks, "id"), labels), "points")
    want, local = 4, True
    while not active.isEmpty():
        jobs = tile_jobs(active, local).repartition("job").sortWithinPartitions("job", "side")
        found = saved(jobs.mapInArrow(tree_search(percent, want), CANDIDATES), "candidates")
        links = verified(saved(found.where("a is not null").select("a", "b").distinct(), "pairs"), sets, percent)
        if not links.isEmpty():
            labels = merged(labels, links)
        more = found.where("a is null").select("block").distinct()
        if local:
            large = active.groupBy("block").agg(F.count("*").alias("m")).where(F.col("m") > TILE).select("block")
            more = more.union(large).distinct()
        rest = with_roots(active.drop("root").join(more, "block", "left_semi"), labels)
        several = several_roots(rest, "block")
        active = saved(rest.join(several, "block", "left_semi").select("id", "n", "cls", "point", "block", "root"), "points")
        want, local = want * 16, False
    return labels


def only(known: Bitmap, held: bool):
    """The rows whose id the bitmap holds, or those whose id it does not hold."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy().view(T.U64)
            rows = np.flatnonzero(known.holds(T.mix(ids * T.U64(T.BASE))) == held)
            if len(rows):
                yield batch.take(pa.array(rows))

    return run


def id_bitmap(ids: DataFrame) -> Bitmap:
    """A bitmap of ids as ``only`` looks them up."""
    keys = ids.select("id").mapInArrow(_mixed, "key long")
    return Bitmap(keys)


def _mixed(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy().view(T.U64)
        yield pa.RecordBatch.from_arrays([pa.array(T.mix(ids * T.U64(T.BASE)).view(np.int64))], names=["key"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, the smallest id reachable over links.

    A document's set holds its distinct shingles of ``size`` lower-cased words (a shorter text is one shingle). Documents
    are linked from ``percent`` hundredths of Jaccard similarity on; every such link counts.

    Equal sets become one class. The tokens of a set are hashed into groups: linked sets agree in the whole of a group
    (``SizeClasses``), so they share a key. Every member of a key is compared with its least one; the members of a key that then
    lie in several components form a block (``open_blocks``). The counts of 256 coarser groups are a set's point. Blocks are searched with R-trees of points (``Forest``), where the sum of the smaller counts bounds what two sets share, and the
    surviving pairs are verified on whole sets.

    Null or empty texts and texts without words have no shingles and are their own component. A row without an id is
    returned with a null component. Rows that share an id share what they are linked with. No rows give no rows; other columns are ignored.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = saved(given.mapInArrow(set_signer(size), "id long, n long, f1 long, f2 long"), "sizes")
    cls = ["n", "f1", "f2"]
    usable = (F.col("n") > 0) & F.col("id").isNotNull()
    members = saved(signed.where(usable).join(signed.where(usable).groupBy(*cls).agg(F.min("id").alias("rep")), cls).select("id", "n", "rep"), "members")
    # Texts whose id a bitmap of fixed size tells apart are read in place; only the others are joined.
    copies = id_bitmap(members.where("id <> rep"))
    fields, key_fields = "id long, text string", "id long, key long"
    known = given.where("id is not null")
    maybe = known.mapInArrow(only(copies, True), fields)
    reps = maybe.join(members.where("id = rep").select("id").distinct(), "id", "left_semi")
    keys = known.mapInArrow(key_reader(size, percent, only(copies, False)), key_fields).union(reps.mapInArrow(key_reader(size, percent), key_fields))
    ends = Window.partitionBy("key")
    agreeing = keys.withColumns({"hub": F.min("id").over(ends), "last": F.max("id").over(ends)}).where("hub < last")
    agreeing = saved(agreeing.select("id", "key", "hub"), "agreeing")
    point_fields = "id long, n long, cls long, point binary, items array<long>"
    met = saved(agreeing.select("id").distinct(), "met")
    points = known.mapInArrow(point_reader(size, percent, only(id_bitmap(met), True)), point_fields).join(met, "id", "left_semi")
    sets = saved(points, "sets")
    # Every member of a key meets its least one; what is then one component needs no search.
    stars = saved(agreeing.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = verified(stars, sets, percent)
    labels = None if links.isEmpty() else merged(None, links)
    roots = linked_components(saved(open_blocks(agreeing, labels), "blocks"), sets, percent, labels)
    out = members.withColumn("component_id", F.col("rep"))
    if roots is not None:
        out = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    alone = signed.where(~usable | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"))
    return out.select("id", "n", "component_id").union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
