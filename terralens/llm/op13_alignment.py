"""Alignment of two tokenizers' tokens by the byte ranges they cover, and how often ids are linked in the corpus.

Both tokenizers cut the same bytes, a space and the text. All tokens of both, sorted by their start, fall into groups:
a new one begins where a start reaches the greatest end so far. Inside a group overlapping tokens of both sides are
expanded; those that end together are links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .op5_topk import packed, unpacked
from .shared import bounded_batches, written
from .text import BYTE_CODES, SLICE, mix64, slices, span_sums
from .tokens import Encoder, default_vocabulary, merge_encoding, segments

CAT = Catalogue()

SPACE, MARK = 0x20, "▁"
LINE = "\n"


def default_pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A sentencepiece vocabulary with byte fallback, read one segment at a time.

    No piece has a space behind something else, and none a line end, so nothing merges over a segment's start, and a line
    end put before it keeps the library from adding a space or taking one away.
    """

    special_tokens_set = frozenset()

    def __init__(self, path):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_vocab = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.n_vocab)]
        if any(MARK in p.lstrip(MARK) or LINE in p for p in pieces):
            raise ValueError(f"{path}: its pieces reach over spaces")
        self.head = len(self.model.encode(LINE))
        self.token_bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]

    def _bytes(self, i, piece):
        if self.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(MARK, " ").encode()

    def encode_ordinary(self, text):
        return self.model.encode(LINE + text)[self.head :]


class Tokens(Encoder):
    """An encoder for which special tokens' strings are plain text, with the bytes of each id.

    Its segments begin at spaces alone, as pieces may hold other blanks.
    """

    def __init__(self, encoding, token_bytes):
        self.encoding, self.special, self.remembered = encoding, [], 1 << 19
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self._forget()

    def _looked_up(self, data, offsets):
        starts, ends, row = segments(data, offsets)
        if not len(starts):
            return starts, ends, row, starts, starts
        cut = data[starts] == SPACE
        cut[1:] |= row[1:] != row[:-1]
        cut[0] = True
        starts, row = starts[cut], row[cut]
        ends = np.append(starts[1:], ends[-1])
        hashes = mix64(span_sums(data, starts, ends, BYTE_CODES) + (ends - starts).astype(np.uint64))
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (new := self._new(keys)).any():
            if len(self.keys) + int(new.sum()) > self.remembered:
                self._forget()
                new[:] = True
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
        known = self.at[np.searchsorted(self.keys, keys)][which]
        return starts, ends, row, known >> 32, known & 0xFFFFFFFF

    def bytes_of(self, ids):
        """The bytes of all ids, one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[ids] - (ends - n), n) + np.arange(int(n.sum()))]


def signs(path):
    """The byte-level vocabulary file."""
    encoding = merge_encoding(path)
    by_id = [b""] * encoding.n_vocab
    for token in encoding.token_byte_values():
        by_id[encoding.encode_single_token(token)] = token
    return Tokens(encoding, by_id)


def pieces(path):
    """The sentencepiece model."""
    model = PieceModel(path)
    return Tokens(model, model.token_bytes)


_tokens: dict[tuple, Tokens] = {}


def _kept(make, path):
    if (make, path) not in _tokens:
        _tokens[make, path] = make(path)
    return _tokens[make, path]


def spaced(data, offsets):
    """Bytes and offsets of the rows with a space before each that is not empty."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.insert(data, offsets[:-1][full], SPACE)
    more = np.zeros(len(offsets), np.int64)
    more[full + 1] = 1
    return out, offsets + np.cumsum(more)


def exact_rows(own, ids, at, data, offsets):
    """Which rows' tokens join to the rows' bytes."""
    sizes = np.concatenate([[0], np.cumsum(own.lengths[ids])])[at]
    same = np.diff(sizes) == np.diff(offsets)
    if same.all() and len(data):
        differs = own.bytes_of(ids) != data
        if not differs.any():
            return same
    joined = own.bytes_of(ids)
    for row in np.flatnonzero(same).tolist():
        same[row] = np.array_equal(joined[sizes[row] : sizes[row + 1]], data[offsets[row] : offsets[row + 1]])
    return same


def only_rows(ids, at, rows):
    """Ids and offsets with the tokens of other rows taken away."""
    counts = np.diff(at)
    return ids[np.repeat(rows, counts)], np.concatenate([[0], np.cumsum(np.where(rows, counts, 0))])


def coalesced(start_a, end_a, start_b, end_b):
    """The group of each A and of each B token: connected overlaps of the two rows of intervals."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.zeros(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return group[: len(start_a)], group[len(start_a) :]


def ending_together(start_a, end_a, start_b, end_b):
    """Places of the A and B tokens whose ranges end together, among all that overlap."""
    lo = np.searchsorted(end_b, start_a, "right")
    count = np.searchsorted(start_b, end_a, "left") - lo
    a = np.repeat(np.arange(len(start_a)), count)
    ends = np.cumsum(count)
    b = np.repeat(lo - (ends - count), count) + np.arange(len(a))
    same = end_a[a] == end_b[b]
    return a[same], b[same]


def told_groups(ids_a, group_a, ids_b, group_b, group_row, rows):
    """``a1,a2|b1;a3|b2,b3`` of each row, as bytes and offsets."""
    groups = len(group_row)
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    n = len(ids_a) + len(ids_b)
    ids, group, kind = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int8)
    for place, own, of, side in (
        (np.arange(len(ids_a)) + before_b[group_a], ids_a, group_a, 0),
        (np.arange(len(ids_b)) + (before_a + n_a)[group_b], ids_b, group_b, 1),
    ):
        ids[place], group[place], kind[place] = own, of, side
    digits = np.zeros((n, 11), np.uint8)
    shown = np.zeros((n, 11), bool)
    left, place = ids.copy(), 9
    while place >= 0 and (place == 9 or left.any()):
        shown[:, place] = (left > 0) | (place == 9)
        digits[:, place] = left % 10 + 48
        left //= 10
        place -= 1
    row = group_row[group]
    if n:
        follows = np.full(n, ord(","), np.uint8)
        follows[:-1][kind[1:] != kind[:-1]] = ord("|")
        follows[:-1][group[1:] != group[:-1]] = ord(";")
        digits[:, 10] = follows
        shown[:-1, 10] = row[1:] == row[:-1]
    sizes = np.bincount(row, weights=shown.sum(1), minlength=rows).astype(np.int64)
    return digits[shown].tobytes(), np.concatenate([[0], np.cumsum(sizes)])


def _aligned_slice(data, offsets, a, b):
    """What ``_align`` tells of the rows of one slice, without ids of documents."""
    rows = len(offsets) - 1
    data, offsets = spaced(data, offsets)
    (ids_a, at_a), (ids_b, at_b) = a.encode(data, offsets), b.encode(data, offsets)
    fit = exact_rows(a, ids_a, at_a, data, offsets) & exact_rows(b, ids_b, at_b, data, offsets)
    (ids_a, at_a), (ids_b, at_b) = only_rows(ids_a, at_a, fit), only_rows(ids_b, at_b, fit)
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    start_a, start_b = end_a - a.lengths[ids_a], end_b - b.lengths[ids_b]
    group_a, group_b = coalesced(start_a, end_a, start_b, end_b)
    row_a = np.repeat(np.arange(rows), np.diff(at_a))
    group_row = np.zeros(int(group_a.max(initial=-1)) + 1, np.int64)
    group_row[group_a] = row_a
    link_a, link_b = ending_together(start_a, end_a, start_b, end_b)
    raw, cuts = told_groups(ids_a, group_a, ids_b, group_b, group_row, rows)
    shas = [hashlib.sha256(raw[lo:hi]).hexdigest() if hi > lo else "" for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    pair = ids_a[link_a] << 32 | ids_b[link_b]
    row = row_a[link_a]
    # entries: each distinct pair of each row with its number of links
    known, which = np.unique(pair, return_inverse=True)
    entry, times = np.unique(row * max(len(known), 1) + which, return_counts=True)
    entry_row, entry_pair = entry // max(len(known), 1), entry % max(len(known), 1)
    totals = np.bincount(which, minlength=len(known)).astype(np.int64)
    per_row = [np.diff(at_a), np.diff(at_b), np.bincount(group_row, minlength=rows), np.bincount(row, minlength=rows)]
    blobs = [packed(x.astype(np.int64)) for x in (np.searchsorted(entry_row, np.arange(rows + 1)), entry_pair, times)]
    return per_row, shas, known, totals, blobs


ALIGNED = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, totals array<long>, entry_at binary, entry_pair binary, entry_times binary"
)


def _align(docs, path_a, path_b):
    """One row for each slice of about a megabyte of text: columns of its documents, its distinct id pairs with their
    numbers of links, and which document holds which pair how often."""

    def align(batches):
        a, b = _kept(signs, path_a), _kept(pieces, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for lo, data, offsets in slices(batch.column(1), SLICE):
                per_row, shas, known, totals, blobs = _aligned_slice(data, offsets, a, b)
                own = ids.slice(lo, len(offsets) - 1).to_pylist()
                columns = [pa.array([own], pa.list_(pa.int64())), *(pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in per_row)]
                columns += [pa.array([shas], pa.list_(pa.string())), *(pa.array([x], pa.list_(pa.int64())) for x in (known, totals))]
                columns += [pa.array([x], pa.binary()) for x in blobs]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *columns], [f.split()[0] for f in ALIGNED.split(", ")])
                chunk += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, ALIGNED)


def pair_counts(aligned):
    """(pair, links, best): the links of each A-B id pair in all documents, and whether no A id has more with its B id.

    A B id has at most as many pairs as there are A ids, so the window is bounded.
    """
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("links"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    return counts.withColumn("best", F.col("links") == F.max("links").over(W.partitionBy(b)))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs, path_a=None, path_b=None):
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the table of pair counts.

    A text is encoded with a space before it, once by the byte-level vocabulary ``path_a`` and once by the sentencepiece
    model ``path_b``; special tokens' strings are plain text. Null and empty texts, and those whose tokens do not join to
    the same bytes, have no tokens: zeros and an empty digest. Every row is a document of its own, also those that repeat
    an id or have none, and all count in the corpus; ties for the best are all best; an empty table gives empty tables.
    Only doc_id and text are read. Documents are encoded once; a megabyte of text asks for each of its id pairs once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    aligned = written(_align(docs, path_a or default_vocabulary(), path_b or default_pieces()), "aligned")
    counts = written(pair_counts(aligned), "pairs")
    asked = aligned.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = (
        asked.join(counts, "pair")
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(F.struct("place", "links", "best"))).alias("told"))
        .select("chunk", F.col("told.links").alias("links"), F.col("told.best").alias("best"))
    )

    def sums(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                at, which, times = (unpacked(one[n].as_py()).astype(np.int64) for n in ("entry_at", "entry_pair", "entry_times"))
                if one["links"].is_valid:
                    links, best = one["links"].values.to_numpy(), one["best"].values.to_numpy(zero_copy_only=False)
                else:
                    links, best = np.zeros(0, np.int64), np.zeros(0, bool)
                total = np.concatenate([[0], np.cumsum(times * links[which])])
                good = np.concatenate([[0], np.cumsum(times * best[which])])
                own = [one[n].values for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.diff(good[at])), pa.array(np.diff(total[at])), one["groups_sha256"].values], [f.split()[0] for f in RESULT.split(", ")]
                )

    rows = aligned.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entry_at", "entry_pair", "entry_times")
    return rows.join(told, "chunk", "left").drop("chunk").mapInArrow(sums, RESULT), counts


@CAT.add("op13_alignment")
def alignment(spark, sf):
    return align(table(spark, sf, "documents"))[0]
