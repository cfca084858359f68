"""Phrase collocations: counts of padded longest windows, from which ROLLUP sums the counts of all shorter phrases."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import text as T
from tallyline.llm.bitmap import Bitmap
from tallyline.llm.shared import saved

# Bytes that end a piece, and bytes between words.
ENDS = T.byte_table((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x0A, 0x0D))
WORD = ~(ENDS | T.byte_table((0x09, 0x09), (0x20, 0x20)))
NO_LANG = "und"
LEVELS = 3  # lengths up to which rare phrases are looked up before windows are counted


def lang_codes(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=T.U64)


class Slice:
    """The words of some rows: 64-bit keys within their language, rows, and which word goes on in the piece of the one before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data = T.LOWER[data]
        hashes, self.starts, firsts = T.words(data, offsets, WORD)
        self.row = np.repeat(np.arange(len(langs)), np.diff(firsts))
        self.keys = T.mix(hashes + lang_codes(langs)[self.row]) if len(hashes) else hashes
        before = np.cumsum(ENDS[data])[self.starts] if len(hashes) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(hashes), dtype=bool)
        self.joined[1:] = (before[1:] == before[:-1]) & (self.row[1:] == self.row[:-1])

    def grams(self, known: list[Bitmap]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For lengths 1, 2, ... up to one more than ``known`` has: keys of the phrases that end at each word, and whether
        such a phrase lies in one piece and may be frequent, as far as the shorter ones say."""
        keys, ok = [self.keys], [np.ones(len(self.keys), dtype=bool)]
        for bitmap in known:
            held = ok[-1] & bitmap.holds(keys[-1])
            ok[-1] = held
            longer, both = np.zeros_like(self.keys), np.zeros_like(held)
            longer[1:] = T.mix(keys[-1][:-1] * T.U64(T.BASE) + self.keys[1:])
            both[1:] = held[1:] & held[:-1] & self.joined[1:]
            keys.append(longer)
            ok.append(both)
        return keys, ok

    def texts(self, words: np.ndarray) -> pa.Array:
        """The words at these places."""
        inside = np.append(WORD[self.data], False)
        rows_end = np.append(self.starts[1:], len(self.data))
        raw, out = self.data.tobytes(), []
        gaps = np.flatnonzero(~inside)
        ends = np.minimum(gaps[np.searchsorted(gaps, self.starts[words])], rows_end[words])
        for a, b in zip(self.starts[words].tolist(), ends.tolist(), strict=True):
            out.append(raw[a:b])
        return pa.array(out, pa.binary()).cast(pa.string())


def slices(batches):
    """The words of all rows (lang, text), slice by slice, with the languages of the rows."""
    for batch in batches:
        langs = batch.column(0)
        for first, last, data, offsets in T.slices(batch.column(1)):
            own = langs.slice(first, last - first)
            yield Slice(data, offsets, own.to_pylist()), own


COUNTED = "lang string, slot int, n long"
SLOTS = 30  # phrases are counted in 2 ** 30 slots; two that share one are counted as one, so no frequent one is missed


def _counted(keys: np.ndarray, langs: pa.Array | None = None, rows: np.ndarray | None = None) -> pa.RecordBatch:
    """(null, slot, n) for the phrases with these keys, or (lang, null, n) for the words of the rows."""
    if rows is not None:
        found, at, n = np.unique(keys, return_index=True, return_counts=True)
        columns = [langs.take(pa.array(rows[at])), pa.nulls(len(found), pa.int32()), pa.array(n)]
    else:
        found, n = np.unique((keys & T.U64((1 << SLOTS) - 1)).astype(np.int32), return_counts=True)
        columns = [pa.nulls(len(found), pa.string()), pa.array(found), pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "slot", "n"])


def gram_counter(known: list[Bitmap]):
    """How often phrases one word longer than those of the last bitmap occur; with none, words and the words of each language."""

    def run(batches):
        for s, langs in slices(batches):
            keys, ok = s.grams(known)
            if ok[-1].any():
                yield _counted(keys[-1][ok[-1]])
            if not known and len(s.keys):
                yield _counted(lang_codes(langs.to_pylist())[s.row], langs, s.row)

    return run


def window_counter(known: list[Bitmap], longest: int):
    """Distinct windows of ``longest`` words as lead columns w1, w2, ... with their counts, by slice.

    A window begins at every frequent word and is padded with nulls from the first word on that lies in another piece
    or ends a phrase within the window that is too rare.
    """

    def run(batches):
        for s, langs in slices(batches):
            _, ok = s.grams(known)
            begin = np.flatnonzero(ok[0])
            if not len(begin):
                continue
            pad = np.zeros(longest, dtype=bool)
            ok = [np.append(x, pad) for x in ok[: len(known)]]
            found, which = np.unique(s.keys, return_inverse=True)
            which = np.append(which, pad.astype(which.dtype))
            alive = np.ones(len(begin), dtype=bool)
            columns, mark = [], T.U64(0)
            for k in range(longest):
                alive = alive & ok[min(k, len(ok) - 1)][begin + k]
                columns.append(np.where(alive, which[begin + k], -1))
                mark = T.mix(mark * T.U64(T.BASE) + (columns[-1] + 1).astype(T.U64))
            _, at, n = np.unique(mark, return_index=True, return_counts=True)
            used, place = np.unique(np.concatenate([c[at] for c in columns]), return_inverse=True)
            shift = int(used[0] < 0)  # the pad comes first
            first = np.empty(len(found), dtype=np.int64)
            first[which[: len(s.keys)][::-1]] = np.arange(len(s.keys))[::-1]
            words = s.texts(first[used[shift:]])
            place = place.reshape(longest, -1) - shift
            out = [words.take(pa.array(np.maximum(p, 0), mask=p < 0)) for p in place]
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(s.row[begin[at]])), *out, pa.array(n)], names=["lang", *(f"w{k}" for k in range(1, longest + 1)), "n"]
            )

    return run


def phrase_counts(docs: DataFrame, min_count: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words that occur ``min_count`` times, and (lang, n) of all words.

    docs has lang and text, without nulls in lang.
    """
    known: list[Bitmap] = []
    for _ in range(min(longest, LEVELS)):
        found = docs.mapInArrow(gram_counter(known), COUNTED).groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        if not known:
            found = saved(found, "words")
            totals = found.where("slot is null").select("lang", "n")
        known.append(Bitmap(found.where((F.col("n") >= min_count) & F.col("slot").isNotNull()).select(F.col("slot").alias("key"))))
    names = [f"w{k}" for k in range(1, longest + 1)]
    fields = ", ".join(["lang string", *(f"{w} string" for w in names), "n long"])
    windows = docs.mapInArrow(window_counter(known, longest), fields).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    windows = saved(windows, "windows")
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled")).where(F.col("f") >= min_count)
    # A sum over the first k columns counts a phrase if its k-th word is not padding.
    whole = F.lit(False)
    for k, w in enumerate(names, 1):
        whole = whole | ((F.col("rolled") == (1 << (longest - k)) - 1) & F.col(w).isNotNull())
    phrases = sums.where(whole).select("lang", F.array_compact(F.array(*names)).alias("words"), F.concat_ws(" ", *names).alias("phrase"), "f")
    return saved(phrases, "phrases"), totals


def collocations(
    docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The phrases that hold together best, by language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and
    tabs. Candidates are phrases of 2 to ``longest`` words that occur a >= ``min_count`` times. A cut into two parts
    that occur l and r times scores floor(1000 * a * n / (l * r)), n being all words of the language; the cut with the
    lowest score counts, the first of equal ones. A candidate that never occurs outside a longer one is dropped. Each
    language's first ``top`` by score, a and phrase are returned.

    Only windows of the longest length are counted. A window is padded from where a phrase of up to three words in it
    occurs less than ``min_count`` times: no candidate goes on there. Which are rare is looked up in bitmaps of a fixed
    size; what they let through too much is counted and dropped by its exact count, so they never change the result.

    A null text has no words, a null language is ``und``. Repeated rows count each. No rows, or no phrase often enough,
    give no rows; other columns are ignored.
    """
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    phrases, totals = phrase_counts(given, min_count, longest)
    several = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = several.select("lang", "words", "phrase", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumns(
        {"left": F.expr("array_join(slice(words, 1, k), ' ')"), "right": F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')")}
    )
    part = lambda side, f: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best"))
    scored = scored.select("lang", "phrase", "best.*")
    sizes = F.explode(F.expr("sequence(2, size(words) - 1)")).alias("size")
    inner = several.where(F.size("words") > 2).select("lang", "a", "words", sizes)
    inner = inner.select("lang", "a", "words", "size", F.explode(F.expr("sequence(1, size(words) - size + 1)")).alias("at"))
    inner = inner.select("lang", F.expr("array_join(slice(words, at, size), ' ')").alias("phrase"), "a").distinct()
    kept = scored.join(inner, ["lang", "phrase", "a"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
