"""Spelling variants: words one edit apart, found as equal pairs of trie nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import saved

LETTER = rb"(?:[a-z]|\xC3[\x80-\xBF])"  # a-z and U+00C0 to U+00FF in UTF-8
HELD = 200_000  # distinct words, or occurrences, a task holds at once


def word_counter(min_length: int, every: int):
    """(word, n) of the runs of letters in rows (id, text), summed over many rows.

    A run whose hash with the row's id is divisible by ``every`` loses one letter, as the hash says.
    """
    run = re.compile(LETTER + b"{%d,}+" % min_length)

    def changed(word: bytes, start: int) -> bytes | None:
        h = zlib.crc32(word, start)
        if h % every:
            return word
        letters = word.decode()
        if len(letters) <= min_length:
            return None
        at = h % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()

    def batch_of(counts: dict) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def task(batches):
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                matches = run.finditer(text.as_py().lower())
                while found := Counter(m.group() for m in islice(matches, HELD)):
                    for word, n in found.items():
                        word = changed(word, start)
                        if word is not None:
                            counts[word] += n
                    if len(counts) >= HELD:
                        yield batch_of(counts)
                        counts = Counter()
        if counts:
            yield batch_of(counts)

    return task


SHALLOW = 6  # levels of a trie above the subtrees that are numbered apart
BASE = 91  # one more than there are letters
DEEP = 1 << 62


class Trie:
    """Numbers the nodes of a trie whose words come in sorted order within subtrees ``SHALLOW`` levels deep.

    Above and at that level a node's number is its path in base 91. Deeper nodes are numbered as they appear: a word
    shares with the one before it the nodes of their common beginning, so the path of one word is all that is held.
    """

    def __init__(self):
        self.next = DEEP + (TaskContext.get().partitionId() << 40)
        self.word, self.path = [], [0]

    def nodes(self, codes: list[int]) -> list[int]:
        """The nodes of the beginnings of a word, from the empty one to the whole; codes number its letters from 1."""
        common, limit = 0, min(len(codes), len(self.word))
        while common < limit and codes[common] == self.word[common]:
            common += 1
        path = self.path[: common + 1]
        for depth in range(common, len(codes)):
            if depth < SHALLOW:
                path.append(path[-1] * BASE + codes[depth])
            else:
                path.append(self.next)
                self.next += 1
        self.word, self.path = codes, path
        return path


def codes_of(word: str) -> list[int]:
    """a-z as 1 to 26 and U+00C0 to U+00FF as 27 to 90."""
    return [c - 96 if c < 128 else c - 165 for c in map(ord, word)]


def prefix_nodes(batches):
    """(id, n, word, nodes) from sorted (id, n, word)."""
    trie = Trie()
    for batch in batches:
        for first in range(0, len(batch), 5000):
            part = batch.slice(first, 5000)
            nodes = [trie.nodes(codes_of(w)) for w in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.list_(pa.int64()))], names=["id", "n", "word", "nodes"])


# What a pair of nodes stands for: a word cut in two, or a word without the letter between; the last kind marks the first letter of a run of equal ones.
CUT, SKIP, FIRST_SKIP = 0, 1, 2
PAIRS = "p long, s long, id long, n long, kind int"


def node_pairs(batches):
    """Rows (prefix node, suffix node, id, n, kind) from (id, n, word, prefix nodes) sorted by the reversed word."""
    trie = Trie()

    def batch_of(rows):
        prefix = np.concatenate([np.array(r[3], dtype=np.int64) for r in rows])
        suffix = np.concatenate([np.array(r[2][::-1], dtype=np.int64) for r in rows])
        sizes = np.array([len(r[3]) for r in rows])
        ids, ns = (np.repeat(np.array([r[k] for r in rows], dtype=np.int64), sizes) for k in (0, 1))
        # The letter after each place; a word's last place has none.
        letters = np.concatenate([np.array([*r[4], 0]) for r in rows])
        skip = np.flatnonzero(letters > 0)
        first = letters != np.append(0, letters[:-1])
        first[np.cumsum(sizes) - sizes] = True
        kind = np.where(first[skip], FIRST_SKIP, SKIP)
        columns = [
            np.concatenate([prefix, prefix[skip]]), np.concatenate([suffix, suffix[skip + 1]]), np.concatenate([ids, ids[skip]]),
            np.concatenate([ns, ns[skip]]), np.concatenate([np.full(len(prefix), CUT), kind]).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "s", "id", "n", "kind"])

    held, size = [], 0
    for batch in batches:
        for i, n, word, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = codes_of(word)
            held.append((i, n, trie.nodes(codes[::-1]), nodes, codes))
            size += len(nodes)
            if size >= 50_000:
                yield batch_of(held)
                held, size = [], 0
    if held:
        yield batch_of(held)


def near_of_pairs(p: np.ndarray, s: np.ndarray, ids: np.ndarray, ns: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, near words, n of the best, id of the best) within each pair of nodes; rows are sorted by pair, n falling, id.

    The words that lack one letter at a place (skips) differ from each other in that letter. A word cut at that place
    is each of them without it; where equal letters stand side by side only the first counts, so no pair comes twice.
    """
    new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1]))
    group = np.cumsum(new) - 1
    several = (np.bincount(group) > 1)[group]
    ids, ns, kind, group = ids[several], ns[several], kind[several], group[several]
    if not len(ids):
        return ids, ids, ns, ids
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    place, none = np.arange(len(ids)), len(ids)
    first_of = lambda which: np.minimum.reduceat(np.where(which, place, none), starts)[group]
    count_of = lambda which: np.add.reduceat(which.astype(np.int64), starts)[group]
    skip, main, cut = kind != CUT, kind == FIRST_SKIP, kind == CUT
    lead = first_of(skip)
    second = first_of(skip & (place != lead))
    other = np.where(place == lead, second, lead)
    cut_at = np.where(main, first_of(cut), none)
    near = np.where(skip, count_of(skip) - 1 + (cut_at < none), count_of(main))
    # Rows are in order of preference, so the earlier of two candidates is the better.
    best = np.where(skip, np.minimum(other, cut_at), first_of(main))
    some = near > 0
    return ids[some], near[some], ns[best[some]], ids[best[some]]


def near_words(batches):
    """Runs ``near_of_pairs`` over sorted rows; a pair of nodes that goes on in the next batch waits for it (it has at most 91 rows)."""
    held = None

    def result(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in near_of_pairs(*columns)], names=["id", "near", "best_n", "best"])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield result([c[:cut] for c in columns])
    if held is not None and len(held[0]):
        yield result(held)


def followed(forms: DataFrame) -> DataFrame:
    """(id, root): where the forms (id, form) lead in the end. Each round doubles the steps; every step grows n, so none returns."""
    now = saved(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("top"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = saved(now.join(on, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31
) -> DataFrame:
    """Words with the more usual word they vary from: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, of at least ``min_length``
    letters and ``min_count`` occurrences (n) in all texts. A run whose CRC-32 of ``<id>:<run>`` is divisible by
    ``every`` loses the letter at that number modulo its length. Near words differ by one inserted, deleted or replaced letter;
    n_near counts them. form is the near word with the largest n (the least of equal ones) if that is ``ratio`` times the word's n
    or more, root where the forms lead in the end (the word itself without a form).

    Nodes of the trie of the words and of the trie of the reversed words are numbered. A word cut at a place, or with
    one letter skipped there, is a pair of numbers; equal pairs are near words, exactly and without comparing any two.
    A pair has at most one word for each letter and one cut word, so no group grows with the data.

    A null text has no words, the id of a row without one reads as empty. Repeated rows count each. Empty texts and no
    rows give no words; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = given.mapInArrow(word_counter(min_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts.where(F.col("n") >= min_count), "counts")
    # Ids rise with the words.
    words = saved(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "n", "word"), "dictionary")
    head = words.repartition(F.substring("word", 1, SHALLOW)).sortWithinPartitions("word")
    prefixes = saved(head.mapInArrow(prefix_nodes, "id long, n long, word string, nodes array<long>"), "prefixes")
    tail = prefixes.repartition(F.substring(F.reverse("word"), 1, SHALLOW)).sortWithinPartitions(F.reverse("word"))
    pairs = tail.mapInArrow(node_pairs, PAIRS).repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "id")
    near = pairs.mapInArrow(near_words, "id long, near long, best_n long, best long").groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("b")
    )
    near = saved(near.select("id", "n_near", F.col("b.best_n").alias("form_n"), (-F.col("b.best")).alias("form")), "near")
    named = words.join(near, "id", "left")
    usual = F.col("form_n") >= ratio * F.col("n")
    named = saved(named.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(usual, F.col(c)).alias(c) for c in ("form", "form_n"))), "named")
    roots = followed(named.where("form is not null").select("id", "form"))
    spelt = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    links = named.where("form is not null").select("id", "form").join(roots, "id").join(spelt("form"), "form").join(spelt("root"), "root")
    out = named.drop("form").join(links.select("id", "form_word", "root_word"), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")

