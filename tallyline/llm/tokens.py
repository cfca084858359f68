"""Token ids of whole text columns: each distinct chunk of text is encoded once."""

from __future__ import annotations

import itertools
import os
import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa

from tallyline.llm import text as T

# Text bytes taken at once, and distinct chunks kept between slices.
SLICE = 1 << 20
KEPT = 1_500_000


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which a text can be cut without changing its ids, row starts included.

    A byte-level pre-tokenizer never joins a character and white space after it. Cuts go before a blank, tab or line
    end that follows a printable ASCII character or a two-byte letter; other places, such as next to wide spaces, stay
    whole.
    """
    blank = T.byte_table((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20))[data]
    solid = T.byte_table((0x21, 0x7E))[data]
    lead = T.byte_table((0xC3, 0xDF))[data]
    solid[1:] |= lead[:-1]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = blank[1:] & solid[:-1]
    rows = offsets[:-1]
    cut[rows[rows < offsets[1:]]] = True
    return np.flatnonzero(cut)


def worker_state() -> dict:
    """What a Python worker keeps between its tasks. Functions sent by value have globals of their own, so it is a module."""
    return vars(sys.modules.setdefault("tallyline_worker_state", types.ModuleType("tallyline_worker_state")))


class Encoder:
    """Ids of the ``tokenizers`` library for a column of texts; strings of added tokens give their ids, as they do there.

    A text is cut into chunks at ``chunk_starts`` and every distinct chunk is encoded once. The encoder keeps up to
    ``KEPT`` chunks with their ids in sorted arrays; beyond that it starts anew with those of the current slice.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for word, i in vocabulary.items():  # one character stands for one byte
            self.bytes_of[i] = len(word)
        added = self.model.get_added_tokens_decoder()
        self.bytes_of = np.append(self.bytes_of, np.zeros(max(max(added, default=0) + 1 - len(self.bytes_of), 0), dtype=np.int64))
        for i, token in added.items():
            self.bytes_of[i] = len(token.content.encode())
        # An added token that holds or takes white space could lie across a cut.
        self.cuts = not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added.values())
        self._forget()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """This worker's encoder for a vocabulary."""
        state = worker_state()
        if path not in state:
            state[path] = cls(path)
        return state[path]

    def _forget(self) -> None:
        self.keys = np.zeros(0, T.U64)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and their number by chunk. Chunks that may stand side by side are encoded as one text."""
        texts, size = [], 0
        for c in chunks:
            # A text goes on where it could be cut again.
            if size and size < 400 and c[0] in b" \n" and 0x21 <= texts[-1][-1][-1] <= 0x7E:
                texts[-1].append(c)
                size += len(c)
            else:
                texts.append([c])
                size = len(c)
        found = self.model.encode_batch_fast([b"".join(t).decode() for t in texts], add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(f.ids for f in found), dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(c) for c in chunks])) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        ids, sizes = self._encode(chunks)
        begins = np.cumsum(sizes) - sizes + len(self.flat)
        self.flat = np.concatenate([self.flat, ids])
        order = np.argsort(keys)
        # The known ones are in order: the new ones are put between them.
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.begins = np.insert(self.begins, at, begins[order])
        self.sizes = np.insert(self.sizes, at, sizes[order].astype(np.int32))

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and their number by row."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = chunk_starts(data, offsets) if self.cuts else np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        ends = np.append(starts[1:], len(data))
        up, down = T.powers(len(data))
        hashes = T.mix(np.add.reduceat(T.BYTE_CODES[data] * up, starts) * down[starts] + (ends - starts).astype(T.U64))
        which, keys = pd.factorize(hashes)
        new = self._missing(keys)
        if len(new):
            if len(self.keys) + len(new) > KEPT:
                self._forget()
                new = np.arange(len(keys))
            at = np.empty(len(keys), dtype=np.int64)
            at[which[::-1]] = np.arange(len(which))[::-1]
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)
        n = self.sizes[at][which].astype(np.int64)
        place = np.cumsum(n) - n
        out = self.flat[np.arange(int(n.sum())) + np.repeat(self.begins[at][which] - place, n)]
        of_row = np.append(place, len(out))[np.searchsorted(starts, offsets)]
        return out, np.diff(of_row)

    def column(self, column: pa.Array, limit: int = SLICE):
        """First and last row, ids and counts of each slice of a text column, of ``limit`` bytes or one longer text; null reads as empty."""
        for first, last, data, offsets in T.slices(column, limit):
            yield first, last, *self.slice_ids(data, offsets)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each row."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
