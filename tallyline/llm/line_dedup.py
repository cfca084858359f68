"""Fuzzy duplicate lines by MinHash over characters; one line of each component stays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.bitmap import Bitmap
from tallyline.llm.components import components
from tallyline.llm.near_dedup import Sets, band_keys, link_components, lists
from tallyline.llm.shared import saved

U64 = np.uint64
COMMON = 1 << 10  # code points whose hashes are looked up
NO_ID = -(1 << 63)
SEEN = 1 << 18  # lines a task remembers to have met
SLICE = 1 << 18  # bytes of text at once: their arrays stay in the processor's cache
FACTORS = T.seeds(128, 997).astype(np.uint32) | np.uint32(1)


def bounds(at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number in the row of every line, from the rows' offsets and the places of line breaks."""
    ends = np.concatenate([at[1:], breaks])
    # A row's end comes before a line break that stands first in the next row.
    order = np.lexsort([np.arange(len(ends)) >= len(at) - 1, ends])
    is_break = order >= len(at) - 1
    ends = ends[order]
    starts = np.concatenate([[0], (ends + is_break)[:-1]]) if len(ends) else np.zeros(0, np.int64)
    rows = np.concatenate([[0], np.cumsum(~is_break)[:-1]]) if len(ends) else np.zeros(0, np.int64)
    return starts, ends, rows, np.arange(len(ends)) - np.searchsorted(rows, rows)


def _common() -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the common code points: which are white space, and the hashes under each seed, A-Z lowered."""
    low = np.arange(COMMON, dtype=U64)
    low[65:91] += U64(32)
    return (low == 32) | ((low >= 9) & (low <= 13)), [T.mix(low * seed) for seed in T.seeds(2, 131)]


BLANK, CODES = _common()


class Lines:
    """The lines of some rows as code points: bounds, row and number in the row of every line, and prefix sums of hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, prints: int = 2):
        """prints: how many hashes of a line are wanted."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        self.points = points
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        self.starts, self.ends, self.rows, self.numbers = bounds(at, np.flatnonzero(points == 10))
        at = np.minimum(points, COMMON - 1).astype(np.intp)
        rare = np.flatnonzero(points >= COMMON)
        blank = BLANK[at]
        self.solid = np.diff(np.concatenate([[0], np.cumsum(~blank)])[np.stack([self.starts, self.ends])], axis=0)[0]
        self.up, self.down = T.powers(len(points) + 1)
        self.sums = []
        for codes, seed in zip(CODES[:prints], T.seeds(2, 131), strict=False):
            hashes = codes[at]
            hashes[rare] = T.mix(points[rare].astype(U64) * seed)
            hashes *= self.up[:-1]
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(hashes)]))

    def take(self, kept: np.ndarray) -> None:
        self.starts, self.ends, self.rows, self.numbers = (a[kept] for a in (self.starts, self.ends, self.rows, self.numbers))

    def prints(self) -> list[np.ndarray]:
        """Two independent hashes of every line."""
        return [T.mix((s[self.ends] - s[self.starts]) * self.down[self.starts] + (self.ends - self.starts).astype(U64)) for s in self.sums]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive characters by line, a shorter line as one, and each line's first."""
        length = self.ends - self.starts
        n = np.maximum(length - size + 1, 1)
        begins = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.starts - begins, n)
        to = at + np.repeat(np.minimum(length, size), n)
        return T.mix((self.sums[0][to] - self.sums[0][at]) * self.down[at]), begins


class Recent:
    """Hashes a task has met, each in the place its last bits name: one may be forgotten, none is taken for met that was not."""

    def __init__(self):
        self.slots = np.arange(SEEN, dtype=U64) ^ U64(1)

    def fresh(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash that is not remembered stands first; from now on it is."""
        codes, first = np.unique(hashes, return_index=True)
        at = (codes & U64(SEEN - 1)).astype(np.int64)
        new = self.slots[at] != codes
        self.slots[at] = codes
        return np.sort(first[new])


def line_minhash(items: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash coordinates (coordinates x lines); no line may be empty.

    The shingles are mixed hashes, so the product with a fixed odd number deals them over the 32-bit numbers anew.
    """
    placed = (items >> U64(32)).astype(np.uint32)
    work = np.empty_like(placed)
    out = np.empty((coordinates, len(begins)), dtype=np.uint32)
    for k in range(coordinates):
        np.multiply(placed, FACTORS[k], out=work)
        np.minimum.reduceat(work, begins, out=out[k])
    return out


PARTS = 1 << 10  # groups the hashes are dealt into, by their first ten bits
HELD = 1 << 21  # band keys a task holds before it passes them on
KEY = np.dtype([("key", "<u4"), ("h1", "<u8")])
PLACE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("f", "<i8"), ("line", "<i4")])
DEALT = "part int, keys binary, places binary"


def records(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, values in zip(kind.names, columns, strict=True):
        out[name] = values
    return out


def dealt(hashes: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The records of each part as one binary value."""
    part = (hashes >> U64(54)).astype(np.uint16)
    ends = np.cumsum(np.bincount(part, minlength=PARTS)) * rows.itemsize
    # Rows of a plain table are taken several times as fast as records.
    rows = np.take(rows.view(np.uint32).reshape(len(rows), -1), np.argsort(part, kind="stable"), axis=0)
    return pa.Array.from_buffers(pa.binary(), PARTS, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(rows)])


def signer(size: int, bands: int, rows: int):
    """Every line's hashes and place, and its band keys where the task meets it first, dealt into parts."""

    def packed(places, keys, nodes):
        places, keys, nodes = (np.concatenate(x) for x in (places, keys, nodes))
        found = [dealt(keys, records(KEY, (keys >> U64(22)).astype(np.uint32), nodes)), dealt(places["h1"], places)]
        out = pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), *found], names=["part", "keys", "places"])
        return out.filter(pa.compute.greater(pa.compute.add(*(pa.compute.binary_length(x) for x in found)), 0))

    def run(batches):
        recent, held = Recent(), ([], [], [])
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(2), SLICE):
                lines = Lines(data, offsets)
                lines.take(lines.solid > 0)
                if not len(lines.starts):
                    continue
                own = [batch.column(i).slice(first, last - first).to_numpy()[lines.rows] for i in (0, 1)]
                prints = lines.prints()
                held[0].append(records(PLACE, *prints, *own, lines.numbers))
                lines.take(fresh := recent.fresh(prints[0]))
                if len(fresh):
                    held[1].append(band_keys(line_minhash(*lines.shingles(size), bands * rows), bands).ravel())
                    held[2].append(np.repeat(prints[0][fresh], bands))
                if sum(map(len, held[1])) + sum(map(len, held[0])) > HELD:
                    yield packed(*held)
                    held = ([], [], [])
        if held[0]:
            yield packed(held[0], held[1] or [np.zeros(0, U64)], held[2] or [np.zeros(0, U64)])

    return run


SMALL = 32  # lines up to which all pairs of a band key are compared
GATHERED = "key long, h1 long, other long, id long, f long, line int, first boolean"


def met(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band key, line and number of lines for the lines of each band key that two or more have."""
    keys = keys[np.argsort(keys["key"])]
    same = keys["key"][1:] == keys["key"][:-1]
    keys = keys[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(keys) else keys
    keys = keys[np.lexsort([keys["h1"], keys["key"]])]
    keys = unrepeated(keys)
    _, at, n = np.unique(keys["key"], return_inverse=True, return_counts=True)
    several = n[at] > 1
    return keys["key"][several], keys["h1"][several].view(np.int64), n[at][several]


def all_pairs(node: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The distinct pairs (n x 2) of the lines of each small band key, from lines in the order of band keys."""
    out = []
    for size in np.unique(m[m <= SMALL]):
        one, two = np.triu_indices(size, 1)
        rows = np.sort(node[m == size].reshape(-1, size), axis=1)
        out.append(np.stack([rows[:, one].ravel(), rows[:, two].ravel()], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    found = found[np.lexsort([found[:, 1], found[:, 0]])]
    return found[np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)])[: len(found)]]


def gatherer(group: pa.Table) -> pa.Table:
    """Of one part: pairs (h1, other) of lines that share a band key, (key, h1) where more than SMALL do, and all places.

    first marks the least place of equal lines; the others are repeats and need no hash.
    """
    part = group.column("part")[0].as_py()
    keys, places = (np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x), kind) for c, kind in (("keys", KEY), ("places", PLACE)))
    key, node, m = met(keys)
    pairs = all_pairs(node, m)
    places = places[np.lexsort([places[c] for c in ("line", "f", "id", "h2", "h1")])]
    # Rows that share an id and a text have the same places.
    places = unrepeated(places)
    first = np.ones(len(places), bool)
    first[1:] = (places["h1"][1:] != places["h1"][:-1]) | (places["h2"][1:] != places["h2"][:-1])
    large = m > SMALL
    place = lambda some: {**{c: places[c][some] for c in ("id", "f", "line")}, "first": first[some]}
    found = [
        {"h1": pairs[:, 0], "other": pairs[:, 1]},
        {"key": (key[large].astype(np.int64) << 10) | part, "h1": node[large]},
        {"h1": places["h1"][first].view(np.int64), **place(first)},
        place(~first),
    ]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [(c, kinds[k]) for c, k in (x.split() for x in GATHERED.split(", "))]
    return pa.concat_tables([pa.table({c: pa.array(rows[c], k) if c in rows else pa.nulls(len(next(iter(rows.values()))), k) for c, k in fields}) for rows in found])


SPREAD = 1640531527  # odd, and small enough that its product with a line's number fits 64 bits


def line_reader(size: int, wanted):
    """(id, f, line, body, n) of each line whose place the bitmap may hold, from rows (id, f, text)."""

    def run(batches):
        bitmap = wanted.value
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(2), SLICE):
                starts, ends, rows, numbers = bounds(offsets, np.flatnonzero(data == 10))
                f = batch.column(1).slice(first, last - first).to_numpy()
                held = np.flatnonzero(bitmap.holds((f[rows] ^ (numbers * SPREAD)).view(U64)))
                if not len(held):
                    continue
                text, at = data.tobytes(), pa.array(rows[held] + first)
                bodies = pa.array([text[a:b].decode() for a, b in zip(starts[held].tolist(), ends[held].tolist(), strict=True)], pa.string())
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers[held].astype(np.int32)), bodies]
                n = np.concatenate([distinct(bodies.slice(i, AT_ONCE), size)[1] for i in range(0, len(held), AT_ONCE)])
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n)], names=["id", "f", "line", "body", "n"])

    return run


AT_ONCE = 1 << 10  # lines whose sets are made at once: their numbers and 54 bits of each item's hash fill 64 bits


def unrepeated(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once; np.unique would hash them, which takes ten times as long here."""
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def distinct(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of at most AT_ONCE texts that are one line each, one after another in ascending order, and their sizes."""
    data, offsets = T.column_bytes(column)
    lines = Lines(data[offsets[0] : offsets[-1]], offsets - offsets[0], 1)
    items, begins = lines.shingles(size)
    row = np.repeat(lines.rows.astype(U64), np.diff(np.append(begins, len(items))))
    found = unrepeated(np.sort((row << U64(54)) | (items >> U64(10))))
    return found, np.bincount((found >> U64(54)).astype(np.int64), minlength=len(column))


def sets_of(columns: list[pa.Array], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``distinct`` of each column; a line that stands in several rows is cut into runs once."""
    coded = pa.concat_arrays(columns).dictionary_encode()
    made = [distinct(coded.dictionary.slice(i, AT_ONCE), size) for i in range(0, len(coded.dictionary), AT_ONCE)]
    items = np.concatenate([x for x, _ in made]) & U64((1 << 54) - 1)
    sizes = np.concatenate([n for _, n in made])
    begins = np.cumsum(sizes) - sizes
    out = []
    for rows in np.split(coded.indices.to_numpy(), len(columns)):
        n = sizes[rows]
        at = np.arange(int(n.sum())) + np.repeat(begins[rows] - (np.cumsum(n) - n), n)
        out.append((items[at] | np.repeat(np.arange(len(rows), dtype=U64) << U64(54), n), n))
    return out


class LineSets(Sets):
    """Lines travel as text, an eighth of their sets; the sets are made where they are compared."""

    few = 16

    def __init__(self, fetch, percent: int, size: int):
        super().__init__(fetch, percent)
        self.size = size

    def linked(self, both: DataFrame) -> DataFrame:
        size, percent = self.size, self.percent

        def run(batches):
            for batch in batches:
                for part in few_lines(batch, (2, 3)):
                    (x, n), (y, m) = sets_of([part.column(i) for i in (2, 3)], size)
                    all_items = np.sort(np.concatenate([x, y]))
                    shared = all_items[1:][all_items[1:] == all_items[:-1]]
                    common = np.bincount((shared >> U64(54)).astype(np.int64), minlength=part.num_rows)
                    kept = pa.array(100 * common >= percent * (n + m - common))
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(kept), part.column(1).filter(kept)], names=["a", "b"])

        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def items(self, bodies: DataFrame) -> DataFrame:
        size = self.size

        def run(batches):
            for batch in batches:
                for part in few_lines(batch, (1,)):
                    found, n = distinct(part.column(1), size)
                    yield pa.RecordBatch.from_arrays([part.column(0), lists(found & U64((1 << 54) - 1), n)], names=["id", "items"])

        return bodies.select("id", "body").mapInArrow(run, "id long, items array<long>")


def few_lines(batch: pa.RecordBatch, columns: tuple[int, ...]):
    """The batch in parts of at most AT_ONCE rows and about 128 KB in these columns, whose sets stay in the processor's cache."""
    for begin in range(0, batch.num_rows, AT_ONCE):
        some = batch.slice(begin, AT_ONCE)
        for first, last in T.row_slices(sum(T.column_bytes(some.column(i))[1] for i in columns), 1 << 17):
            yield some.slice(first, last - first)


def cutter(text_at: int, cut_at: int):
    """Rows without the lines whose numbers the cut column lists, that column replaced by two counts."""

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(text_at), batch.column(cut_at)
            counts = pa.compute.fill_null(pa.compute.add(pa.compute.count_substring(texts, "\n"), 1), 0).to_numpy()
            texts, kept = texts.to_pylist() if cuts.null_count < len(cuts) else texts, counts.astype(np.int64)
            for row in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)):
                gone = set(cuts[row].as_py())
                texts[row] = "\n".join(x for i, x in enumerate(texts[row].split("\n")) if i not in gone)
                kept[row] -= len(gone)
            out = batch.set_column(text_at, batch.schema.field(text_at), texts if isinstance(texts, pa.Array) else pa.array(texts, batch.schema.field(text_at).type))
            out = out.remove_column(cut_at)
            yield out.append_column("n_lines", pa.array(counts, pa.int64())).append_column("n_kept", pa.array(kept, pa.int64()))

    return run


def linked_lines(pairs: DataFrame, large: DataFrame, sets: LineSets) -> DataFrame:
    """(node, root) of the components over the links among pairs (a, b) and among the ids that share a key of ``large`` (key, id)."""
    pairs = saved(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct()
    bodies = saved(sets.fetch(ids), "sets")
    of = lambda end, body: bodies.select(F.col("id").alias(end), F.col("body").alias(body), F.col("n").alias(f"n_{end}"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * sets.percent
    both = pairs.join(of("a", "x").drop("x"), "a").join(of("b", "y"), "b").where(near).drop("n_a", "n_b").join(of("a", "x"), "a")
    links = saved(sets.linked(both), "links")
    labels = components(links)
    return labels if large.isEmpty() else link_components(large, sets, bodies, labels)


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 8, percent: int = 80, bands: int = 22, rows: int = 4
) -> DataFrame:
    """The documents with all their columns, the text without repeated lines, and n_lines and n_kept.

    A line's set holds its distinct runs of ``size`` characters, A-Z lowered (a shorter line is one run). Lines are
    linked from ``percent`` hundredths of Jaccard similarity on, within a document or across documents; of each
    component of links the line of the least id stays, the first one there. 22 bands of 4 rows miss a link of
    similarity 0.8 once in 108,000, one of 0.85 once in 11 million; similar lines have more than one chance, as any path
    of links joins them. Equal lines (two 64-bit hashes) are one class and one node, so a line on a
    third of all documents costs a task one row per band.

    Lines of white space alone always stay. A document whose lines all go keeps its row with an empty text; a null text
    stays null with no lines. Rows that share an id and a text count as one document, a null id sorts first. No rows
    give no rows. Columns named n_lines or n_kept are replaced.
    """
    docs = docs.drop("n_lines", "n_kept")
    names = docs.columns
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("f")]
    given = docs.select(*own, F.col(text_col).alias("text")).where("text is not null")
    spark = docs.sparkSession
    signed = saved(given.mapInArrow(signer(size, bands, rows), DEALT).groupBy("part").applyInArrow(gatherer, GATHERED), "signed")
    # A line's first hash is its node. Only bands that two different lines share matter for the links.
    pairs = signed.where("other is not null").select(F.col("h1").alias("a"), F.col("other").alias("b"))
    large = signed.where("key is not null").select("key", F.col("h1").alias("id"))
    places = signed.where("id is not null").select("id", "f", "line", "first", "h1")

    def fetch(ids: DataFrame) -> DataFrame:
        # The lines asked for are few beside all places: their hash table spares sorting these.
        known = places.where("first").join(ids.withColumnRenamed("id", "h1").hint("shuffle_hash"), "h1", "left_semi").groupBy("h1").agg(F.min(F.struct("id", "f", "line")).alias("p"))
        known = saved(known.select("h1", "p.*"), "known")
        code = F.col("f").bitwiseXOR(F.col("line").cast("long") * SPREAD)
        wanted = spark.sparkContext.broadcast(Bitmap(known.select(code.alias("key"))))
        found = given.mapInArrow(line_reader(size, wanted), "id long, f long, line int, body string, n long")
        return found.join(known, ["id", "f", "line"]).select(F.col("h1").alias("id"), "body", "n").dropDuplicates(["id"])

    roots = linked_lines(pairs, large, LineSets(fetch, percent, size))
    nodes = roots.select(F.col("node").alias("h1"), "root").union(roots.select("root", "root").distinct())
    pos = F.struct("id", "f", "line")
    touched = saved(places.where("first").join(nodes.hint("shuffle_hash"), "h1").select("root", "id", "f", "line"), "touched")
    keeper = touched.groupBy("root").agg(F.min(pos).alias("keeper"))
    # A keeper is the first of its equal lines, so every repeat goes.
    gone = places.where("not first").select("id", "f", "line").union(touched.join(keeper, "root").where(pos != F.col("keeper")).select("id", "f", "line"))
    gone = gone.groupBy("id", "f").agg(F.collect_set("line").alias("cut"))
    here = [F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.xxhash64(docs[text_col])]
    marked = docs.join(gone.hint("shuffle_hash"), (here[0] == gone["id"]) & (here[1] == gone["f"]), "left").select(*[docs[c] for c in names], gone["cut"].alias(f"cut_{uuid.uuid4().hex}"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.mapInArrow(cutter(names.index(text_col), len(names)), f"{kinds}, n_lines long, n_kept long")
