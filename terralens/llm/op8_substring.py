"""Removing repeated passages by relative Lempel-Ziv parsing against the 50-word blocks of earlier documents.

Every run of 50 words is a reference block with one place: the first document (and word in it) that has it. Blocks are
indexed by an anchor, the least hash of the shorter runs inside, so equal blocks meet wherever they stand, and are equal
when 128 bits agree. Pieces of a document whose source and place in it advance together are one match, however many tasks
they were found in; the parse takes at each block the match that reaches furthest, and asks again for the first block that
reaches over the factor's end, so that no block at a boundary is missed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .shared import bounded_batches, gathered, shuffle_partitions
from .text import mix64, slices, span_sums, text_bytes, word_hashes, word_spans

CAT = Catalogue()

#: Words of a block, and of the runs whose least hash is its anchor.
WINDOW, RUN = 50, 8
#: Bits of the filter that tells shared anchors from others, cut into at least so many parts, more with more tasks.
FILTER_BITS, PARTS = 1 << 26, 256
PART_BITS = FILTER_BITS // PARTS
MOST_PARTS = 1 << 16
#: Blocks that a task settles among themselves before it asks others.
SETTLED = 1 << 20

U64 = np.uint64
SECOND = U64(0xA0761D6478BD642F)


def blocks(data, offsets, window=WINDOW, run=RUN):
    """Two hashes, anchor, row and first word of each run of ``window`` words."""
    starts, ends, row = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, False)
    at = np.arange(len(words) - window + 1) if len(words) >= window else np.zeros(0, np.int64)
    at = at[row[at] == row[at + window - 1]]
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64), at, at
    n = len(words)
    runs = np.arange(n - run + 1)
    least = mix64(span_sums(words, runs, runs + run))
    wide, reach = window - run + 1, 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: -(wide - reach)], least[wide - reach :])
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    second = span_sums(mix64(words + SECOND), at, at + window)
    return mix64(span_sums(words, at, at + window)), second, least[at], row[at], at - first[row[at]]


def part_of(anchors, parts=PARTS):
    """The part of an anchor, ``parts`` being a power of two; mixed anew, as the least of many hashes lies near zero."""
    return (mix64(anchors) >> U64(65 - parts.bit_length())).astype(np.int64)


def place_of(anchors):
    """The bit of an anchor in the filter; each part has a range of them."""
    return (mix64(anchors) >> U64(65 - FILTER_BITS.bit_length())).astype(np.int64)


def cut_by(part, parts):
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return order, [(i, bounds[i], bounds[i + 1]) for i in np.flatnonzero(np.diff(bounds)).tolist()]


def shared_anchors(docs, window, run):
    """The filter as bytes: a bit for each anchor of several documents; some others share their bits.

    Its size is fixed. With ever more anchors it passes more blocks that are not shared, which costs shuffle and
    changes no result.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    parts = min(max(PARTS, 1 << (partitions - 1).bit_length()), MOST_PARTS)
    part_bits = FILTER_BITS // parts

    def anchored(batch):
        for _, data, offsets in slices(batch.column(0)):
            _, _, anchors, row, _ = blocks(data, offsets, window, run)
            order = np.lexsort((row, anchors))
            anchors, row = anchors[order], row[order]
            new = np.ones(len(row), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
            values, times = np.unique(anchors[new], return_counts=True)
            yield values, values[times > 1]

    def pack(batches):
        for got in gathered(batches, anchored, lambda x: len(x[0]), SETTLED):
            own, several = zip(*got)
            values, times = np.unique(np.concatenate([*own, np.zeros(0, U64)]), return_counts=True)
            known = np.unique(np.concatenate([values[times > 1], *several]))
            for shared, found in ((1, known), (0, np.setdiff1d(values, known, assume_unique=True))):
                order, cuts = cut_by(part_of(found, parts), parts)
                found = found[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in cuts], pa.int64()),
                        pa.array([shared] * len(cuts), pa.int32()),
                        pa.array([found[a:b].tobytes() for _, a, b in cuts], pa.binary()),
                    ],
                    ["part", "shared", "anchors"],
                )

    def bits(part, known, single):
        values, times = np.unique(np.concatenate([*single, np.unique(np.concatenate([*known, np.zeros(0, U64)])), np.zeros(0, U64)]), return_counts=True)
        shared = np.unique(np.concatenate([values[times > 1], *known]))
        on = np.zeros(part_bits, bool)
        on[place_of(shared) - part * part_bits] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["part", "bits"])

    def meet(batches):
        part, known, single = None, [], []
        for batch in batches:
            for p, shared, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if part is not None:
                        yield bits(part, known, single)
                    part, known, single = p, [], []
                (known if shared else single).append(np.frombuffer(blob, U64))
        if part is not None:
            yield bits(part, known, single)

    found = (
        docs.where(F.col("doc_id").isNotNull())
        .select("text")
        .mapInArrow(pack, "part long, shared int, anchors binary")
        .repartition(min(parts, partitions), "part")
        .sortWithinPartitions("part")
        .mapInArrow(meet, "part long, bits binary")
    )
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    size = part_bits // 8
    for row in found.toLocalIterator():
        whole[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return whole


def reference_places(hashes, second, doc, version, first):
    """For each block the number of the entry that is its place in the reference: of equal ones the smallest document,
    there the first word."""
    order = np.lexsort((first, version, doc, second, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (second[order][1:] != second[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = order[new][np.cumsum(new) - 1]
    return place


def pieces_of(place, doc, version, first, window):
    """Rows PIECE of neighbouring blocks whose places in an earlier document advance with them."""
    keep = np.flatnonzero(doc > doc[place])
    keep = keep[np.lexsort((first[keep], version[keep], doc[keep]))]
    own = place[keep]
    doc, version, first, source, source_version, at = doc[keep], version[keep], first[keep], doc[own], version[own], first[own]
    new = np.ones(len(doc) + 1, bool)
    if len(doc):
        same = first[1:] - first[:-1] <= 1
        for x in (doc, version, source, source_version, at - first):
            same &= x[1:] == x[:-1]
        new[1:-1] = ~same
    edge = np.flatnonzero(new)
    lo, hi = edge[:-1], edge[1:] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (doc[lo], version[lo], source[lo], source_version[lo], at[lo], first[lo], first[hi] + window)], PIECE
    )


def parse(pieces, window):
    """The greedy parse of one document: ``pieces`` and factors are (first, last, source, source_version, at), the words
    from first up to last being those of the source from at on.

    Pieces of one source at one distance that touch are one match. A factor starts at the first block not yet in one and
    is the match that reaches furthest, with ties to the smallest source; the next may begin inside its last window.
    """
    matches = []
    for first, last, source, source_version, at in sorted(pieces, key=lambda x: (x[2], x[3], x[4] - x[0], x[0], x[1])):
        key = (source, source_version, at - first)
        if matches and matches[-1][2] == key and first <= matches[-1][1]:
            matches[-1][1] = max(matches[-1][1], last)
        else:
            matches.append([first, last, key])
    matches.sort(key=lambda x: (x[0], -x[1], x[2]))
    out, best, block, i = [], None, 0, 0
    while i < len(matches) or (best and best[1] - window >= block):
        if not best or best[1] - window < block:
            block = max(block, matches[i][0])
        while i < len(matches) and matches[i][0] <= block:
            if not best or (-matches[i][1], matches[i][2]) < (-best[1], best[2]):
                best = matches[i]
            i += 1
        if best[1] - window >= block:
            out.append((block, best[1], *best[2][:2], block + best[2][2]))
            block = best[1] - window + 1
    return out


def found_pieces(docs, window, run):
    """Rows PIECE; each repeated block stands in one of them.

    Among the next documents of a task the first place of a block answers for the others, so a block that any share of
    all documents has sends few entries to the task where its holders meet.
    """
    spark = docs.sparkSession
    filter_of = spark.sparkContext.broadcast(shared_anchors(docs, window, run))
    parts = 4 * shuffle_partitions(spark)

    def shared(batch):
        bits = filter_of.value
        ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, data, offsets in slices(batch.column(2)):
            hashes, second, anchors, row, first = blocks(data, offsets, window, run)
            place = place_of(anchors)
            on = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
            yield hashes[on], second[on], anchors[on], ids[lo + row[on]], versions[lo + row[on]], first[on]

    def pack(batches):
        for got in gathered(batches, shared, lambda x: len(x[0]), SETTLED):
            hashes, second, anchors, doc, version, first = (np.concatenate(x) for x in zip(*got))
            got.clear()
            if not len(hashes):
                continue
            place = reference_places(hashes, second, doc, version, first)
            local = pieces_of(place, doc, version, first, window)
            ask = np.flatnonzero(doc <= doc[place])
            order, cuts = cut_by((mix64(anchors[ask]) % U64(parts)).astype(np.int64), parts)
            ask = ask[order]
            step = np.diff(first[ask], prepend=0)
            blobs, where = [], []
            for p, a, b in cuts:
                moves = step[a:b].copy()
                moves[0] = first[ask[a]]
                own = ask[a:b]
                fields = (hashes[own].view(np.int64), second[own].view(np.int64), doc[own], version[own], moves)
                blobs.append(b"".join(x.astype("<i8").tobytes() for x in fields))
                where.append(p)
            none = pa.nulls(len(where), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary()), *[none] * len(PIECE)], NAMES)
            # what these documents have settled themselves goes on, dealt by document
            own = pa.array(local.column(0).to_numpy() % parts)
            yield pa.RecordBatch.from_arrays([own, pa.nulls(local.num_rows, pa.binary()), *local.columns], NAMES)

    def settle(blobs):
        fields = [np.frombuffer(b, "<i8").reshape(5, -1) for b in blobs]
        hashes, second, doc, version = (np.concatenate([f[i] for f in fields]) for i in range(4))
        first = np.concatenate([np.cumsum(f[4]) for f in fields])
        return pieces_of(reference_places(hashes, second, doc, version, first), doc, version, first, window)

    def meet(batches):
        part, held = None, []
        for batch in batches:
            batch_parts, blobs = batch.column(0).to_pylist(), batch.column(1)
            settled = batch.filter(pa.compute.is_null(blobs))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays(settled.columns[2:], PIECE)
            for p, blob in zip(batch_parts, blobs.to_pylist()):
                if blob is None:
                    continue
                if p != part and held:
                    yield settle(held)
                    held = []
                part = p
                held.append(blob)
        if held:
            yield settle(held)

    row = ", ".join(f"{name} long" for name in PIECE)
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", "version", "text")
        .mapInArrow(pack, f"part long, entries binary, {row}")
        .repartition(shuffle_partitions(spark), "part")
        .sortWithinPartitions("part")
        .mapInArrow(meet, row)
    )


PIECE = ["doc_id", "version", "source", "source_version", "at", "first", "last"]
NAMES = ["part", "entries", *PIECE]
FACTOR = ["first", "last", "source", "source_version", "at"]


def factors(docs, window=WINDOW, run=RUN):
    """Per text with repeats: doc_id, version and its factors (first, last, source, source_version, at) in order.

    The words of a factor, from first up to last, are those from ``at`` on of ``source``, a document with a smaller id;
    versions tell texts of one id apart. ``docs`` has doc_id, version and text. Every repeated block lies in a factor,
    and a factor holds at least one that the ones before it do not.
    """
    found = found_pieces(docs, window, run).groupBy("doc_id", "version").agg(F.collect_set(F.struct(*FACTOR)).alias("pieces"))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in FACTOR]))

    def parsed(batches):
        for batch in batches:
            out = [[dict(zip(FACTOR, f)) for f in parse([tuple(p.values()) for p in own], window)] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "version", "factors"])

    return found.mapInArrow(parsed, f"doc_id long, version long, factors array<struct<{', '.join(f'{name}: bigint' for name in FACTOR)}>>")


def without_repeats(docs, window=WINDOW, run=RUN):
    """Per row of ``docs``: doc_id, n_words, n_removed and kept, the words that stay joined by one blank.

    A word goes if a run of ``window`` words around it also starts in a document with a smaller doc_id; runs are judged
    on the texts as given. Null texts have no words; rows that repeat an id never remove each other's words, as neither
    id is smaller; a row without an id keeps its words and removes none. Only doc_id and text are read.
    """
    bounded_batches(docs.sparkSession)
    told = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    spans = factors(told, window, run).select("doc_id", "version", F.transform("factors", lambda f: F.struct(f["first"], f["last"])).alias("spans"))

    def keep(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            out = []
            for i, found in enumerate(batch.column(2).to_pylist()):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n = len(words)
                if found:
                    gone = np.zeros(n + 1, np.int32)
                    for span in found:
                        gone[span["first"]] += 1
                        gone[span["last"]] -= 1
                    words = list(compress(words, np.cumsum(gone[:-1]) == 0))
                out.append((n, n - len(words), b" ".join(words).decode("utf-8", "replace")))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return told.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans").mapInArrow(
        keep, "doc_id long, n_words long, n_removed long, kept string"
    )


@CAT.add("op8_substring")
def substring(spark, sf):
    kept = without_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

