"""Token ids of Arrow text columns by a public tokenizer; a helper inside tasks.

A text is cut before each ASCII blank that follows something else. The vocabulary's own splitting always cuts there
too, so the ids of a text are those of its segments one after the other, and each distinct segment is encoded once.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from .text import BLANK, BYTE_CODES, SLICE, mix64, rows_of_strings, slices, span_sums

#: Distinct segments that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 20


def default_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_sign():
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_encoding(path):
    """The byte-level vocabulary file as a tiktoken encoding, which gives the same ids several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    signs = byte_of_sign()
    ranks = {bytes(signs[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Encodes byte arrays of texts, remembering segments it has met."""

    def __init__(self, path, remembered=REMEMBERED):
        self.encoding = merge_encoding(path)
        self.special = [t.encode() for t in self.encoding.special_tokens_set]
        self.remembered = remembered
        self._forget()

    def _forget(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16 if self.encoding.n_vocab <= 1 << 16 else np.uint32)

    def _learn(self, keys, data, starts, ends):
        raw = data.tobytes()
        strings = rows_of_strings(data, starts, ends)
        if any(t in raw for t in self.special):
            found = [self.encoding.encode(s, allowed_special="all") for s in strings]
        else:
            found = list(map(self.encoding.encode_ordinary, strings))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), self.pool.dtype, int(counts.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, at << 32 | counts)

    def _new(self, keys):
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def _looked_up(self, data, offsets):
        """Starts, ends and row of the segments, and for each the place of its ids in the pool and their number."""
        starts, ends, row = segments(data, offsets)
        if not len(starts):
            return starts, ends, row, starts, starts
        hashes = mix64(span_sums(data, starts, ends, BYTE_CODES) + (ends - starts).astype(np.uint64))
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (new := self._new(keys)).any():
            if len(self.keys) + int(new.sum()) > self.remembered:
                self._forget()
                new[:] = True
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
        known = self.at[np.searchsorted(self.keys, keys)][which]
        return starts, ends, row, known >> 32, known & 0xFFFFFFFF

    def encode(self, data, offsets):
        """Ids of all rows one after the other, and the offsets of the rows in them."""
        rows = len(offsets) - 1
        starts, _, row, at, counts = self._looked_up(data, offsets)
        if not len(starts):
            return np.zeros(0, self.pool.dtype), np.zeros(rows + 1, np.int64)
        ends_at = np.cumsum(counts)
        ids = self.pool[np.repeat(at - (ends_at - counts), counts) + np.arange(int(ends_at[-1]))]
        bounds = np.concatenate([[0], ends_at])
        return ids, bounds[np.searchsorted(row, np.arange(rows + 1))]

    def segment_counts(self, data, offsets):
        """Starts, ends and row of the segments, and the number of tokens of each."""
        starts, ends, row, _, counts = self._looked_up(data, offsets)
        return starts, ends, row, counts

    def count(self, text):
        """Tokens of one short text."""
        return len(self.encoding.encode(text, allowed_special="all"))


def segments(data, offsets):
    """Starts, ends and row of the segments of each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    # after a byte that may end a blank outside ASCII there is no cut
    cut[1:-1] &= (data[:-1] < 0x80) | _letter_end(data)[:-1]
    cut[offsets] = True
    cut[n] = True
    bounds = np.flatnonzero(cut)
    starts, ends = bounds[:-1], bounds[1:]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _letter_end(data):
    """True at the second byte of a two-byte character led by C3 to DF; none of these is a blank."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path):
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_slices(column, path):
    """(first row, ids, offsets) of consecutive rows."""
    own = encoder(path)
    for lo, data, offsets in slices(column, 2 * SLICE):
        yield lo, *own.encode(data, offsets)
