"""Words, hashes and shingles of Arrow text columns as numpy arrays; a helper inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer document is handled alone.
SLICE = 1 << 20

# the default pool keeps what it has once got, which adds up over the workers of an executor
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def mix64(x):
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * _ODD)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[_LOWER]

#: Values whose sums are taken at once, so that a text needs no array of eight bytes for each of its own.
STRIPE = 1 << 15


def powers(base, n):
    """The first ``n`` powers of a number modulo 2^64."""
    out = np.full(n, base, U64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_UP, _DOWN = powers(_STEP, STRIPE), powers(_BACK, STRIPE)


def span_sums(values, starts, ends, codes=None):
    """For each span the sum of values[i] * STEP^(i - start) modulo 2^64: a hash that does not depend on the place.

    ``starts`` and ``ends`` ascend; with ``codes`` the values are their codes.
    """
    first, last, down = (np.empty(len(starts), U64) for _ in range(3))
    total, before, up, back = np.zeros(STRIPE + 1, U64), 0, 1, 1
    stripes = range(0, len(values) + 1, STRIPE)
    edges = np.append(stripes, len(values) + 1)
    of_start, of_end = np.searchsorted(starts, edges), np.searchsorted(ends, edges)
    for k, lo in enumerate(stripes):
        own = values[lo : lo + STRIPE]
        own = own if codes is None else codes[own]
        np.cumsum(own * _UP[: len(own)], out=total[1 : len(own) + 1])
        at, to = slice(*of_start[k : k + 2]), slice(*of_end[k : k + 2])
        first[at] = total[starts[at] - lo] * U64(up) + U64(before)
        last[to] = total[ends[to] - lo] * U64(up) + U64(before)
        down[at] = _DOWN[starts[at] - lo] * U64(back)
        before = (before + up * int(total[len(own)])) % (1 << 64)
        up, back = up * pow(_STEP, STRIPE, 1 << 64) % (1 << 64), back * pow(_BACK, STRIPE, 1 << 64) % (1 << 64)
    return (last - first) * down


def text_bytes(column):
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, limit=SLICE):
    """(first row, bytes, offsets) of consecutive rows with at most ``limit`` bytes, or one longer row."""
    data, offsets = text_bytes(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data, offsets):
    """Starts, ends and row of the words of each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data, starts, ends, lower):
    return mix64(span_sums(data, starts, ends, LOWER_CODES if lower else BYTE_CODES) + (ends - starts).astype(U64))


def row_starts(row, rows):
    """Where each row's entries begin in a sorted ``row`` array; one more for the end."""
    return np.searchsorted(row, np.arange(rows + 1))


def shingles(words, row, rows, width):
    """Hash and row of each run of ``width`` words of a row; a row with fewer words has its whole sequence as one run."""
    at = row_starts(row, rows)
    count = np.diff(at)
    n = len(words)
    starts = np.arange(n)
    left = at[1:][row] - starts
    starts = starts[(left >= width) | (starts == at[:-1][row])]
    ends = np.minimum(starts + width, at[1:][row[starts]])
    out = mix64(span_sums(words, starts, ends) + (ends - starts).astype(U64) * _ODD)
    return out, row[starts], count


def rows_of_strings(data, starts, ends):
    """The spans as Python strings."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
