"""Training-order materialisation: token sequences in the order of a keyed permutation, in shards of fixed stride."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .shared import bounded_batches, shared_folder
from .text import mix64
from .tokens import default_vocabulary, encoded_slices

CAT = Catalogue()

#: Ids of a sequence, key of the order, and bytes of a shard about.
LENGTH, KEY, SHARD_BYTES = 256, 20260101, 8 << 20
#: Shards whose places are broadcast to a reader at most, and records that it parses at once.
BROADCAST_SHARDS, STRIPE = 50_000, 4096
END = 0
ROUNDS = 4
#: What stands before the ids of a record: doc_id, place of its first id in the document, number of its ids.
HEAD = np.dtype([("doc_id", "<i8"), ("start", "<u4"), ("length", "<u2")])
#: Bytes of text for one byte of ids, about; it only sets how many shards there are.
BYTES_PER_ID = 2.5


def record_type(length):
    return np.dtype([*((n, HEAD[n]) for n in HEAD.names), ("ids", "<u2", (length,))])


def stride(length):
    """Bytes from one record to the next: the record and the line end that Spark's writer puts after it."""
    return record_type(length).itemsize + 1


def permuted(x, size, key=KEY):
    """The keyed permutation of range(size): a balanced Feistel network over the next even power of two, walked along
    its cycle until it comes back into the range."""
    half = max(1, (max(int(size) - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            round_key = mix64(np.array([(key + r * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))
            left, right = right, left ^ (mix64(right + round_key) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def may_hold(text, length):
    """Sequences that a text gives at most: no token is shorter than a byte, and one id ends it."""
    return F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) + 1) / length).cast("long")


def write_shards(docs, folder, path=None, length=LENGTH, key=KEY, shard_bytes=SHARD_BYTES, end=END, text="text"):
    """Writes all sequences of ``docs`` to ``folder`` and returns the manifest: shard, file, records, first_slot.

    A document's ids and ``end`` are cut after each ``length``; the last sequence is filled with zeros. Each sequence
    has a number below the sum of what the texts may hold, by input partition and row, which the permutation turns into
    its place in the order. Shards are ranges of places, sorted by place, written as records of equal size; a
    sequence's slot, without gaps, is the number of sequences in earlier places. One pass over the text finds the
    numbers, the second encodes; nothing but shards and one shuffle of records is stored. ``docs`` must give the same
    rows in the same partitions twice, as a table scan does; otherwise the write fails.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # one row for each input partition
    held = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(may_hold(F.col("text"), length)).alias("n")).collect()
    before, size = {}, 0
    for row in sorted(held):
        before[row["part"]] = (size, row["n"])
        size += row["n"]
    shards = max(1, round(size / BYTES_PER_ID * stride(length) / shard_bytes))
    places = -(-size // shards)
    record = record_type(length)
    offsets = spark.sparkContext.broadcast(before)

    def sequences(batches):
        base, most = offsets.value.get(TaskContext.get().partitionId(), (0, 0))
        used = 0
        for batch in batches:
            ids_of = batch.column(0).fill_null(-1).to_numpy()
            held = batch.column(2).to_numpy()
            for lo, ids, at in encoded_slices(batch.column(1), path):
                counts = np.diff(at) + 1
                many = -(-counts // length)
                room = held[lo : lo + len(counts)]
                row = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                number = base + used + (np.cumsum(room) - room)[row] + piece
                used += int(room.sum())
                out = np.zeros(len(row), record)
                out["doc_id"], out["start"] = ids_of[lo + row], piece * length
                out["length"] = np.minimum(counts[row] - piece * length, length)
                ids = np.insert(ids, at[1:], end)
                of = np.repeat(np.arange(len(row)), out["length"])
                first = np.cumsum(out["length"], dtype=np.int64) - out["length"]
                out["ids"][of, np.arange(len(ids)) - first[of]] = ids
                place = permuted(number, size, key)
                raw = out.tobytes()
                blobs = [raw[i : i + record.itemsize] for i in range(0, len(raw), record.itemsize)]
                yield pa.RecordBatch.from_arrays([pa.array((place // places).astype(np.int32)), pa.array(place), pa.array(blobs, pa.binary())], ["shard", "place", "record"])
        if used != most:
            raise ValueError("the documents changed between two passes over them")

    (
        docs.withColumn("held", may_hold(F.col("text"), length))
        .mapInArrow(sequences, "shard int, place long, record binary")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "place")
        .select("shard", F.col("record").cast("string").alias("value"))
        .write.partitionBy("shard")
        .text(folder)
    )
    return manifest(spark, folder, length)


def shard_files(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("int"))


def manifest(spark, folder, length=LENGTH):
    """One row per shard: shard, path, records, first_slot. Only file sizes are read."""
    found = shard_files(spark, folder).select("shard", "path", (F.col("length") / stride(length)).cast("long").alias("records"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("first_slot", F.coalesce(F.sum("records").over(before), F.lit(0)))


def read_slots(spark, folder, first=0, last=None, length=LENGTH, ids=True):
    """The sequences of slots ``first`` up to ``last``: slot, shard, position (bytes), doc_id, start, length and ids, or
    the checksum ids_crc32 (of little-endian 32-bit ids) in their place.

    Only shards that hold such slots are read, so a reader goes on where it stopped. A null doc_id comes back as -1.
    """
    bounded_batches(spark)
    held = manifest(spark, folder, length).where(F.col("first_slot") + F.col("records") > first)
    if last is not None:
        held = held.where(F.col("first_slot") < last)
    # few rows, one for each shard; beyond the limit they meet the files by a shuffle
    few = held.count() <= BROADCAST_SHARDS
    held = held.select("shard", "first_slot")
    record, step = record_type(length), stride(length)
    names = ["slot", "shard", "position", "doc_id", "start", "length", "ids" if ids else "ids_crc32"]

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, slot = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                content = batch.column(2)[i].as_buffer()
                n = content.size // step
                lo, hi = max(0, first - slot), n if last is None else min(n, last - slot)
                for at in range(lo, hi, STRIPE):
                    many = min(STRIPE, hi - at)
                    yield records(shard, slot + at, at, np.ndarray(many, record, content, at * step, (step,)))

    def records(shard, slot, at, rows):
        size = rows["length"].astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat = rows["ids"][np.arange(length) < size[:, None]]
        if ids:
            last_column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
        else:
            wide = flat.astype("<u4")
            last_column = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64())
        here = np.arange(len(rows))
        columns = [slot + here, np.full(len(rows), shard, np.int32), (at + here) * step]
        columns += [rows[n].astype(np.int64) for n in ("doc_id", "start", "length")]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), last_column], names)

    files = shard_files(spark, folder).select("shard", "content").join(F.broadcast(held) if few else held, "shard")
    kind = "ids array<int>" if ids else "ids_crc32 long"
    return files.select("shard", "first_slot", "content").mapInArrow(
        parse, f"slot long, shard int, position long, doc_id long, start long, length long, {kind}"
    )


@CAT.add("op1_training_order")
def training_order(spark, sf):
    folder = shared_folder(spark, "shards")
    write_shards(table(spark, sf, "documents"), folder)
    return read_slots(spark, folder, ids=False)
