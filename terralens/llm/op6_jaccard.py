"""Joining documents by the Jaccard similarity of their word shingles with adaptive multi-match prefixes.

All documents order their shingles alike: those known to be frequent come last, the others by hash. Two sets of similarity s or more share a shingle among the first
n - ceil(s n) + 1 of each, and with k more of them on either side they share k + 1. Each document's prefix is
lengthened by the shingles in it that are too costly (held by many groups of documents), which are then skipped, and
by a fixed reserve; pairs are verified only if they share as many shingles as the lengthened prefixes ask for. Before
any prefix is stored, the shingles of whole texts that no other document holds are counted: they bound what a document can
share, and those that cannot be similar to any take no part in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .components import components
from .shared import bounded_batches, gathered, settled, shuffle_partitions, written
from .text import mix64, shingles, slices, word_hashes, word_spans

CAT = Catalogue()

WIDTH, PERCENT = 4, 85
#: Shingles stored beyond the plain prefix: a share of it, and at least so many.
RESERVE_SHARE, RESERVE = 3, 8
#: A shingle held by more groups of documents than this is skipped in favour of later ones.
COSTLY = 32
#: A shingle's level is how many of these numbers of documents are seen to hold it; bits for each level.
LEVELS, LEVEL_BITS = (8, 128, 2048), 1 << 25
#: Parts in which the driver fetches the bit maps, 12 MB in all.
MAP_READS = 4
#: Shingles that a task counts together, and entries (60 bytes, copied several times) that it packs together.
COUNTED, PACKED = 1 << 19, 1 << 17
#: Columns of a set's bit signature, 64 bits each, and of the wider one that is kept once for each node.
SIGNATURE = ["s0", "s1", "s2", "s3"]
WIDE = [f"w{i}" for i in range(16)]
#: A row counts for at least so many shingles, so that a block has fewer than 65536 rows.
BLOCK_SHARE = 64
#: Parts in which copies of one set meet first, and partners of a document that one task compares.
SALTS, PARTNERS = 8, 64
#: Bits of the filter that keeps documents without a candidate out of the verification's shuffle.
FILTER_BITS = 1 << 24


def row_sets(data, offsets, width):
    """Sorted distinct shingles of all rows one after the other, with their row; rows without words have none."""
    starts, ends, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    found, owner, _ = shingles(word_hashes(data, starts, ends, True), row, rows, width)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[fresh], owner[fresh]


def prefix_length(n, percent):
    return n - (percent * n + 99) // 100 + 1


def parities(found, owner, rows):
    """Per row WIDE words: a bit is set if an odd number of the row's shingles falls on it.

    The bits in which two rows differ are at most as many as the shingles that only one of them has.
    """
    width = 64 * len(WIDE)
    bits = np.bincount(owner * width + ((found >> np.uint64(24)) % np.uint64(width)).astype(np.int64), minlength=rows * width)
    bits &= 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(rows, len(WIDE))


def folded(wide):
    """The SIGNATURE words of WIDE ones, as if the shingles had fallen on so many bits at once."""
    return np.bitwise_xor.reduce(wide.reshape(len(wide), -1, len(SIGNATURE)), axis=1)


def set_digests(found, at):
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(found + np.uint64(k)))]) for k in (1, 2)]
    return [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]


def holdings(docs, width, parts):
    """For each row of ``docs`` its doc_id, n (set size), two digests of the set and ``lone``, a lower bound of how many
    of its shingles no different set holds; and the bit maps of LEVELS (see `level_maps`). Both come from one table.

    Every shingle of every text is counted. A task sends those that one set of its block holds as 32 bits and the number
    of the holder in the block, those that several hold once with their count, to the part that a hash names; that part
    sums the counts and answers each block with the number of lone shingles of each of its rows. Shingles whose bits
    agree, and copies of a set in other blocks, only make ``lone`` smaller, so what follows from it excludes no link. An
    answer names its block by the digest of what the block holds: a block that a lost task makes anew in another way
    misses some answers, which again only makes ``lone`` smaller.
    """

    def sets(batch):
        for lo, data, offsets in slices(batch.column(1)):
            rows = len(offsets) - 1
            found, owner = row_sets(data, offsets, width)
            at = np.searchsorted(owner, np.arange(rows + 1))
            yield batch.column(0).slice(lo, rows), found, owner.astype(np.int32), np.diff(at), *set_digests(found, at)

    def pack(batches):
        for got in gathered(batches, sets, lambda x: max(len(x[1]), BLOCK_SHARE * len(x[3])), COUNTED):
            ids = pa.concat_arrays([g[0] for g in got])
            base = np.cumsum([0] + [len(g[3]) for g in got])
            n, d1, d2 = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
            found = np.concatenate([g[1] for g in got])
            owner = np.concatenate([(g[2] + lo).astype(np.uint16) for g, lo in zip(got, base)])
            got.clear()
            # of equal sets in a block one speaks for all
            pairs = np.rec.fromarrays([d1, d2])
            _, first, which = np.unique(pairs, return_index=True, return_inverse=True)
            speaker = first[which].astype(np.int32)
            speaks = (speaker == np.arange(len(n)))[owner]
            found, owner = found[speaks], owner[speaks]
            order = np.argsort(found)
            found, owner = found[order], owner[order]
            del speaks, order
            new = np.ones(len(found) + 1, bool)
            new[1:-1] = found[1:] != found[:-1]
            at = np.flatnonzero(new)
            found, owner, times = found[at[:-1]], owner[at[:-1]], np.diff(at).astype(np.int32)
            del new, at
            part = (found % np.uint64(parts)).astype(np.int32)
            order = np.argsort(2 * part + (times > 1), kind="stable")
            value = (found[order] >> np.uint64(32)).astype(np.uint32)
            del found
            part, times, owner = part[order], times[order], owner[order]
            del order
            bounds = np.searchsorted(part, np.arange(parts + 1))
            block = int((mix64(d1 + n) ^ mix64(d2)).sum(dtype=np.uint64).view(np.int64))
            missing = ids.is_null().to_numpy(False).astype(np.uint8)
            rows = [(block, block % parts, len(n), None, [ids.fill_null(0).to_numpy().astype(np.int64), missing, n.astype(np.int64), d1, d2, speaker])]
            for i in np.flatnonzero(np.diff(bounds)):
                lo, hi = bounds[i], bounds[i + 1]
                mid = lo + int((times[lo:hi] == 1).sum())
                rows.append((block, int(i), len(n), mid - lo, [value[lo:hi], owner[lo:mid], np.minimum(times[mid:hi], 65535).astype(np.uint16)]))
            yield pa.RecordBatch.from_pylist(
                [{"block": b, "part": p, "docs": d, "singles": k, "data": b"".join(x.tobytes() for x in arrays)} for b, p, d, k, arrays in rows],
                pa.schema([("block", pa.int64()), ("part", pa.int64()), ("docs", pa.int32()), ("singles", pa.int32()), ("data", pa.binary())]),
            )

    told = pa.schema([("block", pa.int64()), ("docs", pa.int32()), ("own", pa.bool_()), ("data", pa.binary()), ("bits", pa.list_(pa.int64()))])

    def counted(held):
        """The answers to the blocks of one part, and the bits of its frequent shingles."""
        values, weights, owners = [], [], []
        for _, _, singles, blob in held:
            size = singles + (len(blob) - 6 * singles) // 6
            values.append(np.frombuffer(blob, np.uint32, size))
            owners.append(np.frombuffer(blob, np.uint16, singles, 4 * size))
            weight = np.ones(size, np.int64)
            weight[singles:] = np.frombuffer(blob, np.uint16, size - singles, 4 * size + 2 * singles)
            weights.append(weight)
        value = np.concatenate(values)
        order = np.argsort(value)
        value = value[order]
        new = np.ones(len(value) + 1, bool)
        new[1:-1] = value[1:] != value[:-1]
        at = np.flatnonzero(new)
        times = np.add.reduceat(np.concatenate(weights)[order], at[:-1])
        lone = np.zeros(len(value), bool)
        lone[order[at[:-1][times == 1]]] = True
        out, lo = [], 0
        for (block, docs, singles, _), owner, v in zip(held, owners, values):
            found = np.bincount(owner[lone[lo : lo + singles]], minlength=docs)
            lo += len(v)
            if found.any():
                out.append({"block": block, "docs": docs, "own": False, "data": found.astype(np.uint8 if found.max() < 256 else np.uint32).tobytes(), "bits": []})
        bits = [(value[at[:-1][times >= least]] % np.uint32(LEVEL_BITS)).astype(np.int64) + i * LEVEL_BITS for i, least in enumerate(LEVELS)]
        out.append({"block": 0, "docs": 0, "own": False, "data": None, "bits": np.unique(np.concatenate(bits)).tolist()})
        return pa.RecordBatch.from_pylist(out, told)

    def count(batches):
        part, held = None, []
        for batch in batches:
            for block, own, docs, singles, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if singles is None:
                    yield pa.RecordBatch.from_pylist([{"block": block, "docs": docs, "own": True, "data": blob, "bits": []}], told)
                    continue
                if own != part and held:
                    yield counted(held)
                    held = []
                part = own
                held.append((block, docs, singles, blob))
        if held:
            yield counted(held)

    partitions = shuffle_partitions(docs.sparkSession)
    answers = written(
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(pack, "block long, part long, docs int, singles int, data binary")
        .repartition(partitions, "part")
        .sortWithinPartitions("part")
        .mapInArrow(count, "block long, docs int, own boolean, data binary, bits array<long>"),
        "answers",
    )

    def described(own, lone):
        docs, blob = own
        at, out = 0, []
        for kind in (np.int64, np.uint8, np.int64, np.int64, np.int64, np.int32):
            out.append(np.frombuffer(blob, kind, docs, at))
            at += docs * np.dtype(kind).itemsize
        ids, missing, n, d1, d2, speaker = out
        arrays = [pa.array(ids, mask=missing.astype(bool)), *map(pa.array, (n, d1, d2, lone[speaker]))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "d1", "d2", "lone"])

    def total(batches):
        key, owns, lone = None, [], None
        for batch in batches:
            for block, docs, own, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    yield from (described(o, lone) for o in owns)
                    key, owns, lone = block, [], np.zeros(docs, np.int64)
                if own:
                    owns.append((docs, blob))
                else:
                    lone += np.frombuffer(blob, np.uint8 if len(blob) == docs else np.uint32)
        yield from (described(o, lone) for o in owns)

    rows = (
        answers.where("data IS NOT NULL")
        .select("block", "docs", "own", "data")
        .repartition(partitions, "block")
        .sortWithinPartitions("block", F.col("own").desc())
        .mapInArrow(total, "doc_id long, n long, d1 long, d2 long, lone long")
    )
    return rows, answers


def level_maps(answers):
    """One bit map for each of LEVELS: the shingles that at least so many documents hold.

    The maps have a fixed size and only decide the order of the shingles, in which any function of the shingle is right:
    more shingles than bits cost candidates, never links. They are made by all tasks and fetched in MAP_READS parts: an
    iterator runs a job for each partition, and the driver keeps what it knows of a job.
    """
    bit = answers.select(F.explode("bits").alias("bit")).select((F.col("bit") + 1).alias("bit"))
    maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(len(LEVELS) * LEVEL_BITS // 8, np.uint8)
    for row in written(maps, "maps").coalesce(MAP_READS).toLocalIterator():
        whole[(row["no"] - 1) * 4096 : row["no"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return whole


def level_of(found, maps):
    level = np.zeros(len(found), np.int8)
    for i in range(len(LEVELS)):
        bit = ((found >> np.uint64(32)) % np.uint64(LEVEL_BITS)).astype(np.int64) + i * LEVEL_BITS
        level += maps[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
    return level


def sketches(nodes, docs, maps, width, percent):
    """Per node (doc_id, n, d1, d2, lone): rid, n, lone, SIGNATURE, WIDE and its first shingles, the prefix and its
    reserve."""
    maps = docs.sparkSession.sparkContext.broadcast(maps)

    def sketch(batches):
        for batch in batches:
            for lo, data, offsets in slices(batch.column(5)):
                rows = len(offsets) - 1
                found, owner = row_sets(data, offsets, width)
                at = np.searchsorted(owner, np.arange(rows + 1))
                n = np.diff(at)
                same = np.ones(rows, bool)  # a repeated doc_id has other texts as well
                for k, digest in enumerate(set_digests(found, at)):
                    same &= digest == batch.column(2 + k).slice(lo, rows).to_numpy()
                wide = parities(found, owner, rows)
                found = found[np.lexsort((found, level_of(found, maps.value), owner))]
                p = prefix_length(n, percent)
                kept = np.minimum(n, p + np.maximum(p // RESERVE_SHARE, RESERVE)) * same
                stored = found[np.arange(len(found)) - at[owner] < kept[owner]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, rows),
                        pa.array(n, pa.int64()),
                        batch.column(4).slice(lo, rows),
                        *(pa.array(np.ascontiguousarray(column)) for column in (*folded(wide).T, *wide.T)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(stored)),
                    ],
                    ["rid", "n", "lone", *SIGNATURE, *WIDE, "stored"],
                )

    columns = ", ".join(f"{s} long" for s in SIGNATURE + WIDE)
    texts = with_texts(docs, nodes).select("doc_id", "n", "d1", "d2", "lone", "text")
    return texts.mapInArrow(sketch, f"rid long, n long, lone long, {columns}, stored array<long>").where("size(stored) > 0")


ENTRY = np.dtype([("tok", "<i8"), ("rid", "<i8"), ("n", "<i4"), ("lone", "<i4"), ("pos", "<i4"), *((s, "<i8") for s in SIGNATURE)])


def shared_shingles(nodes, parts):
    """Rows (tok, rid, n, lone, pos, SIGNATURE) of the stored shingles that more than one node holds.

    Entries travel as byte blocks by shingle. A shingle that several nodes in one block hold is known to be shared: its
    entries go on spread by node, and one mark goes where its other holders meet, so no task gathers all holders.
    """

    def listed(batch):
        lists = batch.column("stored")
        counts = np.diff(lists.offsets.to_numpy())
        entries = np.empty(int(counts.sum()), ENTRY)
        entries["tok"] = lists.flatten().to_numpy()
        entries["rid"] = np.repeat(batch.column(0).to_numpy(), counts)
        entries["n"] = np.repeat(batch.column(1).to_numpy(), counts)
        entries["lone"] = np.repeat(batch.column(2).to_numpy(), counts)
        entries["pos"] = np.arange(len(entries)) - np.repeat(np.cumsum(counts) - counts, counts)
        for name in SIGNATURE:
            entries[name] = np.repeat(batch.column(name).to_numpy(), counts)
        yield entries

    def pack(batches):
        for got in gathered(batches, listed, len, PACKED):
            entries = np.concatenate(got)
            _, first, which, times = np.unique(entries["tok"], return_index=True, return_inverse=True, return_counts=True)
            several = times[which] > 1
            marks = entries[first[times > 1]].copy()
            marks["pos"] = -1
            unshared = np.concatenate([entries[~several], marks])
            for direct, block, by in ((0, unshared, unshared["tok"]), (1, entries[several], entries["rid"][several])):
                part = (mix64(by.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                block, bounds = block[order], np.searchsorted(part[order], np.arange(parts + 1))
                own = np.flatnonzero(np.diff(bounds))
                blobs = [np.ascontiguousarray(block[bounds[i] : bounds[i + 1]]) for i in own]
                blobs = [b"".join(b[f].tobytes() for f in ENTRY.names) for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(np.full(len(own), direct), pa.int32()), pa.array(blobs, pa.binary())],
                    ["part", "direct", "entries"],
                )

    def unpacked(blob):
        n = len(blob) // ENTRY.itemsize
        out, at = np.empty(n, ENTRY), 0
        for f in ENTRY.names:
            kind = ENTRY[f]
            out[f] = np.frombuffer(blob, kind, n, at)
            at += n * kind.itemsize
        return out

    def rows(entries):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(entries[f])) for f in ENTRY.names], list(ENTRY.names))

    def met(blocks):
        entries = np.concatenate(blocks)
        entries = entries[np.argsort(entries["tok"], kind="stable")]
        same = np.zeros(len(entries) + 1, bool)
        same[1:-1] = entries["tok"][1:] == entries["tok"][:-1]
        return entries[(same[1:] | same[:-1]) & (entries["pos"] >= 0)]

    def unpack(batches):
        part, held = None, []
        for batch in batches:
            for own, direct, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if direct:
                    yield rows(unpacked(blob))
                    continue
                if own != part and held:
                    yield rows(met(held))
                    held = []
                part = own
                held.append(unpacked(blob))
        if held:
            yield rows(met(held))

    return (
        nodes.mapInArrow(pack, "part long, direct int, entries binary")
        .repartition(shuffle_partitions(nodes.sparkSession), "part")
        .sortWithinPartitions("part")
        .mapInArrow(unpack, "tok long, rid long, n int, lone int, pos int, " + ", ".join(f"{s} long" for s in SIGNATURE))
    )


def with_texts(docs, wanted):
    """``wanted`` (doc_id, ...) with the texts; a bit filter of fixed size (2 MB) spares most other documents the join."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits")
    )
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    passed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumns({"__no": F.bitmap_bucket_number(bit), "__at": F.bitmap_bit_position(bit)})
        .join(F.broadcast(bits), "__no")
        .where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0)
        .select("doc_id", "text")
    )
    return wanted.join(passed, "doc_id")


def verified(pairs, docs, width, percent):
    """The rows (a, b) of ``pairs`` whose whole texts are similar enough.

    One task holds the set of ``a`` and compares at most about PARTNERS partners of it, one after the other.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    settled(docs.sparkSession)
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shares"))
    partners = pairs.join(shares, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), "b")
    owners = shares.select(
        F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b")
    )
    meeting = with_texts(docs, written(partners.unionByName(owners), "meetings")).select("a", "share", "b", "text")

    def compare(batches):
        key, sets = None, []
        for batch in batches:
            a, share, b = (c.to_pylist() for c in batch.columns[:3])
            out = []
            for lo, data, offsets in slices(batch.column(3)):
                found, owner = row_sets(data, offsets, width)
                at = np.searchsorted(owner, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own, r = found[at[i] : at[i + 1]], lo + i
                    if (a[r], share[r]) != key:
                        key, sets = (a[r], share[r]), []
                    if b[r] is None:
                        sets.append(own.copy())
                    elif any(similar(s, own, percent) for s in sets):
                        out.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64())), batch.column(2).take(pa.array(out, pa.int64()))], ["a", "b"])

    return (
        meeting.repartition(shuffle_partitions(docs.sparkSession), "a", "share")
        .sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
        .mapInArrow(compare, "a long, b long")
        .distinct()
    )


def similar(x, y, percent):
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def prefix_sql(n, percent):
    return f"({n} - ({percent} * {n} + 99) div 100 + 1)"


def stored_length(n, percent):
    p = prefix_sql(n, percent)
    return f"least({n}, {p} + greatest({p} div {RESERVE_SHARE}, {RESERVE}))"


def near(x, y, percent, words):
    """What the signatures of two nodes allow."""
    apart = " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in words)
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({x}.n + {y}.n)"


def may_link(x, y, percent):
    """What the sizes, the lone shingles and the signatures of two nodes allow.

    Shingles that are not lone bound what two nodes can share; signatures bound from below what only one of them has,
    which must not be more than (100 - percent) / (100 + percent) of both sizes together.
    """
    enough = f"{100 + percent} * ({{0}}.n - {{0}}.lone) >= {percent} * ({x}.n + {y}.n)"
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND {enough.format(x)} AND {enough.format(y)} AND {near(x, y, percent, SIGNATURE)}"


def leader_pairs(shared, percent):
    """For each node one pair with the holder that leads most of its shared shingles: the one with the fewest lone
    shingles, so the likeliest original of a large group.

    These pairs only join obvious groups early, so that large groups count as one holder afterwards.
    """
    leaders = shared.groupBy("tok").agg(F.min(F.struct("lone", "rid", "n", *SIGNATURE)).alias("y"))
    votes = (
        shared.alias("x")
        .join(leaders, "tok")
        .where(f"x.rid != y.rid AND {may_link('x', 'y', percent)}")
        .withColumn("least", F.expr("least(x.n, y.n)"))
        .select("x.rid", F.col("y.rid").alias("a"), F.expr(f"{stored_length('least', percent)} - {prefix_sql('least', percent)}").alias("spare"))
        .groupBy("rid", "a", "spare")
        .agg(F.count(F.lit(1)).alias("votes"))
        .where("2 * votes > spare")
    )
    best = votes.groupBy("rid").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a"))
    return best.select("a", F.col("rid").alias("b"))


def candidate_pairs(shared, comps, nodes, percent, costly):
    """Pairs (a, b) of nodes in different groups that share as many stored shingles as their prefixes ask for.

    Nodes whose reserve does not make up for their costly shingles meet all holders of these. The WIDE signatures in
    ``nodes`` (rid, WIDE), which only these meetings carry, keep all but the nearly similar of such pairs from being made.
    """
    with_group = written(
        shared.join(comps, shared.rid == comps.node, "left").select("tok", "rid", "n", "lone", "pos", *SIGNATURE, F.coalesce("root", "rid").alias("grp")), "entries"
    )
    holders = with_group.select("tok", "grp").distinct().groupBy("tok").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")
    entries = with_group.join(holders, "tok").withColumns(
        {
            "costly": F.col("groups") > costly,
            "p": F.expr(prefix_sql("n", percent)),
            "kept": F.expr(stored_length("n", percent)),
        }
    )
    # a window holds the stored shingles of one document
    skipped = F.count_if("costly").over(W.partitionBy("rid"))
    entries = written(entries.withColumn("spare", F.col("kept") - skipped - F.col("p")), "entries")
    fit = f"x.grp != y.grp AND {may_link('x', 'y', percent)}"

    def meet(left, right, where, spare):
        met = left.alias("x").join(right.alias("y"), F.expr(f"x.tok = y.tok AND {fit} AND {where}"))
        return (
            met.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b"), F.expr(spare).alias("spare"))
            .groupBy("a", "b")
            .agg(F.count(F.lit(1)).alias("shared"), F.first("spare").alias("spare"))
            .where("shared > spare")
            .select("a", "b")
        )

    covered = entries.where("NOT costly AND spare >= 0")
    usual = meet(covered, covered, "x.rid < y.rid", "least(x.spare, y.spare)")
    # where the reserve does not make up for the costly shingles, these count too, for the document and its partners
    lacking = written(entries.where("spare < 0").join(nodes.select("rid", *WIDE), "rid"), "lacking")
    holding = entries.join(lacking.select("tok").distinct(), "tok", "left_semi").join(nodes.select("rid", *WIDE), "rid")
    short = meet(lacking, holding, f"{near('x', 'y', percent, WIDE)} AND (x.rid < y.rid OR y.spare >= 0)", "least(x.kept - x.p, y.kept - y.p)")
    return usual.unionByName(short)


def similar_groups(docs, width=WIDTH, percent=PERCENT, costly=COSTLY):
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Texts are lower-cased (A-Z) and split at white space; the set is that of all runs of ``width`` words, or the whole
    sequence of fewer words. Two documents link if 100 * shared >= percent * (size of the union). Null, empty and blank
    texts have no shingles and are linked with nothing. Rows that repeat a doc_id belong to one document: they share
    their component. Rows without a doc_id take part in no link and have a null component. Only doc_id and text are
    read, so further columns of any name do not matter; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, answers = holdings(docs, width, 4 * shuffle_partitions(spark))
    sketch = written(rows, "sketches").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    key = ["d1", "d2", "n"]
    copies = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(copies.groupBy(*key, "salt").agg(F.min("doc_id").alias("rid"), F.max("lone").alias("lone")), "classes")
    least = written(classes.groupBy(*key).agg(F.min("rid").alias("b"), F.max("lone").alias("lone")), "least")
    # one node for each distinct set that shares enough with others to be similar to any
    nodes = written(least.where(f"100 * (n - lone) >= {percent} * n").select(F.col("b").alias("doc_id"), "n", "d1", "d2", "lone"), "nodes")
    # written, so that no task runs two Python workers at once
    stored = written(sketches(nodes, docs, level_maps(answers), width, percent), "stored")
    settled(spark)
    shared = written(shared_shingles(stored.drop(*WIDE), 4 * shuffle_partitions(spark)), "shared")
    least = least.drop("lone")
    links = classes.drop("lone").join(least, key).where("rid != b").select(F.col("rid").alias("a"), "b")
    early = links.unionByName(written(verified(leader_pairs(shared, percent), docs, width, percent), "early"))
    groups = written(components(early), "groups")
    late = verified(candidate_pairs(shared, groups, stored, percent, costly), docs, width, percent)
    final = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    of_class = classes.join(final, classes.rid == final.node, "left").select(*key, "salt", F.coalesce("root", "rid").alias("component"))
    return sketch.join(of_class, [*key, "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs, width=5, percent=80):
    """The rows of ``docs`` that stay when one document of each group of similar ones does: the one with the smallest id."""
    groups = written(similar_groups(docs, width, percent), "similar")
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id == gone["__gone"], "left_anti")


@CAT.add("op6_jaccard")
def jaccard(spark, sf):
    return similar_groups(table(spark, sf, "documents"))
