"""Benchmark passages in training text, found by binary search in suffix arrays over training shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import text as T

U64 = np.uint64
SHARD_WORDS = 2_000_000  # words of training text in one suffix array, or one longer document
BLOCK_BYTES = 32 << 20  # benchmark text that is searched for at once
STEP = 4  # words of 16 bits each in one 64-bit key


@dataclass
class Patterns:
    """Distinct windows of benchmark items and the items they stand in."""

    words: np.ndarray  # hashes, windows one after another padded to the same width
    lengths: np.ndarray
    owners: np.ndarray  # item numbers, sorted by window
    offsets: np.ndarray  # each window's first owner
    places: np.ndarray  # the word of the owner at which the window starts
    items: list[str]


def codes(hashes: np.ndarray) -> np.ndarray:
    """The 16 high bits of each word, 0 left for the end of a text. Words are ordered by them."""
    return np.maximum(hashes >> U64(48), U64(1))


def packed_keys(words: np.ndarray) -> np.ndarray:
    """For each place the codes of STEP words from there on, as one number that sorts like them."""
    padded = np.concatenate([words, np.zeros(STEP, U64)])
    n = len(words)
    keys = np.zeros(n, U64)
    for j in range(STEP):
        keys |= padded[j : j + n] << U64(16 * (STEP - 1 - j))
    return keys


def suffix_array(keys: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text, ordered by the packed keys of ``depth`` words from there on."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(tied):
        places = order[tied]
        padded = np.concatenate([keys, np.zeros(depth, U64)])
        later = [padded[places + j] for j in range((depth - 1) // STEP * STEP, 0, -STEP)]
        order[tied] = places[np.lexsort([*later, ordered[tied]])]
    return order


def search(keys: np.ndarray, order: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in the suffix array of the suffixes that begin with each pattern's codes."""
    width = patterns.words.shape[1]
    pattern = np.where(np.arange(width) < patterns.lengths[:, None], codes(patterns.words), U64(0))
    low, high = np.zeros(len(pattern), np.int64), np.full(len(pattern), len(order), np.int64)
    padded = np.concatenate([keys, np.zeros(width + STEP, U64)])
    first = keys[order]
    for j in range(0, width, STEP):
        at = np.flatnonzero((patterns.lengths > j) & (low < high))
        if not len(at):
            break
        part = np.zeros((len(at), STEP), U64)
        part[:, : pattern[:, j : j + STEP].shape[1]] = pattern[at, j : j + STEP]
        least = np.zeros(len(at), U64)
        for i in range(STEP):
            least |= part[:, i] << U64(16 * (STEP - 1 - i))
        # A pattern that ends within the key leaves its low bits free.
        free = (STEP - np.minimum(patterns.lengths[at] - j, STEP)) * 16
        most = least | ((U64(1) << free.astype(U64)) - U64(1))
        if j == 0:
            low[at], high[at] = np.searchsorted(first, least, "left"), np.searchsorted(first, most, "right")
            continue
        for bound, target, right in ((low, least, False), (high, most, True)):
            a, b = low[at].copy(), high[at].copy()
            while (a < b).any():
                mid = (a + b) // 2
                value = padded[order[np.minimum(mid, len(order) - 1)] + j]
                up = (value <= target if right else value < target) & (a < b)
                a, b = np.where(up, mid + 1, a), np.where(up | (a >= b), b, mid)
            if right:
                ends = a
            else:
                begins = a
        low[at], high[at] = begins, ends
    return low, high


def patterns_of(texts: pa.Array, ids: list[str], window: int) -> Patterns:
    """The windows of the items: ``window`` consecutive words, or a shorter item whole."""
    data, offsets = T.column_bytes(texts)
    low = int(offsets[0]) if len(offsets) else 0
    hashes, _, firsts = T.words(data[low : int(offsets[-1])], offsets - low, T.ALNUM)
    counts = np.diff(firsts)
    n = np.where(counts >= window, counts - window + 1, (counts > 0).astype(np.int64))
    item = np.repeat(np.arange(len(counts)), n)
    place = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(counts, window)[item]
    at = (firsts[:-1][item] + place)[:, None] + np.arange(window)
    padded = np.concatenate([hashes, np.zeros(window, U64)])
    words = np.where(np.arange(window) < length[:, None], padded[at], U64(0))
    distinct, which = np.unique(words, axis=0, return_inverse=True) if len(words) else (words, np.zeros(0, np.int64))
    which = which.ravel()
    lengths = np.zeros(len(distinct), np.int64)
    lengths[which] = length
    by = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[by], np.arange(len(distinct) + 1))
    return Patterns(distinct, lengths, item[by], begins, place[by], ids)


def occurrences(words: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, place) of every occurrence in a shard's word hashes, where 0 ends a text."""
    if not len(words) or not len(patterns.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = packed_keys(np.where(words == 0, U64(0), codes(words)))
    order = suffix_array(keys, patterns.words.shape[1])
    low, high = search(keys, order, patterns)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    place = order[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
    # Equal codes are not yet equal words.
    padded = np.concatenate([words, np.zeros(patterns.words.shape[1], U64)])
    same = np.ones(len(which), dtype=bool)
    for j in range(patterns.words.shape[1]):
        same &= (patterns.lengths[which] <= j) | (padded[place + j] == patterns.words[which, j])
    return which[same], place[same]


FOUND = "n_words long, spans array<struct<first:long,last:long>>, matches array<struct<item_id:string,item_word:long,doc_word:long,words:long>>"
SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])


def _lists(owner: np.ndarray, n: int, kind: pa.StructType, columns: list) -> pa.ListArray:
    values = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def shard_matches(firsts: np.ndarray, hashes: np.ndarray, patterns: Patterns) -> list[pa.Array]:
    """n_words, covered spans and longest matches for the documents whose words start at ``firsts``."""
    n = len(firsts) - 1
    counts = np.diff(firsts)
    # A zero after each document keeps matches from running on into the next one.
    words = np.insert(np.maximum(hashes, U64(1)), firsts[1:], U64(0))
    begins = firsts[:-1] + np.arange(n)
    which, place = occurrences(words, patterns)
    size = patterns.lengths[which]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size, -1)
    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    first = np.flatnonzero(covered[1:] & ~covered[:-1])
    last = np.flatnonzero(covered[:-1] & ~covered[1:])
    doc = np.searchsorted(begins, first, side="right") - 1
    spans = _lists(doc, n, SPAN, [first - begins[doc], last - begins[doc]])
    # An item's windows that follow each other in both texts make one longest match.
    owners = patterns.offsets[which + 1] - patterns.offsets[which]
    at = np.arange(int(owners.sum())) + np.repeat(patterns.offsets[which] - (np.cumsum(owners) - owners), owners)
    item, item_word, doc_word, length = patterns.owners[at], patterns.places[at], np.repeat(place, owners), np.repeat(size, owners)
    by = np.lexsort([doc_word, doc_word - item_word, item])
    item, item_word, doc_word, length = item[by], item_word[by], doc_word[by], length[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(doc_word - item_word) != 0) | (np.diff(doc_word) != 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(by))[: len(start)] - 1
    item, item_word, doc_word, length = item[start], item_word[start], doc_word[start], (doc_word[end] + length[end] - doc_word[start])
    doc = np.searchsorted(begins, doc_word, side="right") - 1
    by = np.lexsort([item_word, doc_word, item, doc])
    names = pa.array(patterns.items, pa.string()).take(pa.array(item[by]))
    matches = _lists(doc[by], n, MATCH, [names, item_word[by], (doc_word - begins[doc])[by], length[by]])
    return [pa.array(counts), spans, matches]


def matcher(shared, text_at: int, keep_found: bool, shard_words: int):
    """mapInArrow function: rows with their findings, or the rows without any and nothing added."""

    def flush(held, patterns):
        rows = pa.Table.from_batches([h[0] for h in held])
        hashes = np.concatenate([h[1] for h in held])
        counts = np.concatenate([np.diff(h[2]) for h in held])
        found = shard_matches(np.append(0, np.cumsum(counts)), hashes, patterns)
        if keep_found:
            for name, column in zip(("n_words", "spans", "matches"), found, strict=True):
                rows = rows.append_column(name, column)
        else:
            clean = np.diff(found[1].offsets.to_numpy()) == 0
            rows = rows.filter(pa.array(clean))
        yield from rows.to_batches()

    def run(batches):
        patterns = shared.value
        held, size = [], 0
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column(text_at)):
                hashes, _, firsts = T.words(data, offsets, T.ALNUM)
                rows = batch.slice(first, last - first)
                held.append((rows.drop_columns([batch.schema.names[text_at]]) if keep_found else rows, hashes, firsts))
                size += len(hashes)
                if size >= shard_words:
                    yield from flush(held, patterns)
                    held, size = [], 0
        if held:
            yield from flush(held, patterns)

    return run


def blocks(items: DataFrame, item_col: str, text_col: str, window: int):
    """The windows of the benchmark in broadcast blocks of at most ``BLOCK_BYTES`` of text, one longer item excepted.

    A benchmark beyond one block is dealt out by the items' digest, and each block has a pass of its own.
    """
    spark = items.sparkSession
    given = items.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    size = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-size // (BLOCK_BYTES // 2)) if size > BLOCK_BYTES else 1
    for part in range(parts):
        rows = given if parts == 1 else given.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        found = rows.toArrow()
        yield spark.sparkContext.broadcast(patterns_of(found.column("text"), found.column("id").to_pylist(), window))


def find_matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans, matches.

    Both texts are words of letters, digits and non-ASCII characters, A-Z lowered. Every task builds suffix arrays over
    its documents' words and looks up each suffix of the benchmark items by binary search: ``window`` words of it, or a
    shorter item whole. ``matches`` lists the longest verbatim matches (item_id, first word in the item, first word in
    the document, words), ``spans`` the covered word ranges (first, after last). Whole documents are searched in one
    array, so nothing is shuffled; a benchmark over one block takes one pass per block and a sum by document.

    Null and empty texts have no words and no match; an item without id, text or words is left out; repeated ids are
    rows of their own while the benchmark is one block. No rows give no rows; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    passes = [given.mapInArrow(matcher(b, 1, True, SHARD_WORDS), f"id {kind}, {FOUND}") for b in blocks(items, item_col, item_text_col, window)]
    out = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            out = out.union(more)
        out = out.groupBy("id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")
        )
        out = out.withColumn("spans", F.expr(UNITED))
    return out.withColumnRenamed("id", id_col)


# Sorted spans with those that touch or overlap united.
UNITED = """aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (s, x) ->
    if(size(s) > 0 and element_at(s, -1).last >= x.first,
       concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'last', greatest(element_at(s, -1).last, x.last)))),
       concat(s, array(x))))"""


def without_matches(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    out = docs
    for block in blocks(items, item_col, item_text_col, window):
        out = out.mapInArrow(matcher(block, docs.columns.index(text_col), False, SHARD_WORDS), docs.schema)
    return out


def contamination(found: DataFrame) -> DataFrame:
    """The digest of ``find_matches``: n_words, n_hit, n_items, items_sha256 (their sorted ids, comma-joined) and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    rest = [c for c in found.columns if c not in ("n_words", "spans", "matches")]
    return found.select(
        *rest, "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )
