"""Packing of documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralens.plans.common import Catalogue, table

from .shared import bounded_batches, written
from .tokens import default_vocabulary, encoded_slices

CAT = Catalogue()

#: Tokens of a sequence, and of one step of the length histogram: a piece counts by its length in whole steps.
LENGTH, GRAIN = 1024, 8
END = 0
#: Pieces that are ranked together.
RANKED = 20_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs, path, length=LENGTH, end=END, text="text"):
    """One row per piece: every document's ids and ``end``, cut after each ``length`` of them."""
    kind = T._parse_datatype_string(f"doc_id {dict(docs.dtypes)['doc_id']}, {PIECES}")

    def pieces(batches):
        for batch in batches:
            for lo, ids, offsets in encoded_slices(batch.column(1), path):
                counts = np.diff(offsets) + 1
                pieces_of = -(-counts // length)
                row = np.repeat(np.arange(len(counts)), pieces_of)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)) * length
                size = np.minimum(counts[row] - start, length)
                ids = np.insert(ids, offsets[1:], end).astype("<u4")
                at = (offsets[:-1] + np.arange(len(counts)))[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + size).tolist())]
                owner = batch.column(0).take(pa.array(lo + row))
                yield pa.RecordBatch.from_arrays(
                    [owner, *(pa.array(x, pa.int64()) for x in (start, size, crc, counts[row]))], kind.names
                )

    return docs.select("doc_id", text).mapInArrow(pieces, kind)


def priced(prices, capacity):
    """The pattern of sizes 1 to ``capacity`` worth most under ``prices``, by dynamic programming over the capacity."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gains = value[c - 1 :: -1][:c] + prices[1 : c + 1]
        best = int(gains.argmax())
        if gains[best] > value[c - 1] + 1e-12:
            value[c], choice[c] = gains[best], best + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(capacity + 1), capacity
    while c:
        if choice[c]:
            pattern[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return value[capacity], pattern


def patterns(histogram, capacity):
    """Rounded optimum of the cutting-stock program: rows (pattern by size, copies) that cover ``histogram`` (by size).

    Columns enter the linear program (revised simplex) as long as the knapsack finds a pattern worth more than its one
    sequence; the optimum is rounded down and the few pieces left over are packed first-fit by decreasing size.
    """
    demand = np.asarray(histogram, np.int64)
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    m, total = len(sizes), demand.sum()
    need = demand[sizes] / total
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(m)
    for _ in range(50 * m):
        duals = np.linalg.solve(basis.T, cost)
        if (low := int(duals.argmin())) >= 0 and duals[low] < -1e-9:
            column, price = np.zeros(m), 0.0  # a surplus of that size
            column[low] = -1
        else:
            prices = np.zeros(capacity + 1)
            prices[sizes] = np.maximum(duals, 0)
            worth, found = priced(prices, capacity)
            if worth <= 1 + 1e-7:
                break
            column, price = found[sizes], 1.0
        now, way = np.linalg.solve(basis, np.stack([need, column], 1)).T
        steps = np.where(way > 1e-11, np.maximum(now, 0) / np.where(way > 1e-11, way, 1), np.inf)
        if not np.isfinite(steps.min()):
            break
        out = int(steps.argmin())
        basis[:, out], cost[out] = column, price
    copies = np.floor(np.maximum(np.linalg.solve(basis, need), 0) * total + 1e-6).astype(np.int64)
    chosen = [(basis[:, i].round().astype(np.int64), int(copies[i])) for i in range(m) if cost[i] and copies[i] > 0]
    left = demand[sizes] - sum((p * n for p, n in chosen), np.zeros(m, np.int64))
    left = np.maximum(left, 0)
    while left.any():
        room, pattern = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= pattern * n
        chosen.append((pattern, n))
    out = []
    for p, n in chosen:
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = p
        out.append((full, n))
    return out


def slots(histogram, capacity):
    """Rows (size, first rank, last rank, pieces in a sequence, first sequence): which ranks of a size go where."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, copies in patterns(histogram, capacity):
        for size in np.flatnonzero(pattern):
            rows.append((int(size), int(taken[size]), int(taken[size] + pattern[size] * copies - 1), int(pattern[size]), sequence))
        taken += pattern * copies
        sequence += copies
    return rows


def ranked(pieces, ranked_together=RANKED):
    """``pieces`` with their rank among those of the same size, from 0; one size may have any share of all pieces."""
    count = pieces.count()
    salts = max(1, -(-count // ranked_together))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sums = W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    before = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "size", "salt", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before")
    )
    order = W.partitionBy("size", "salt").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return salted.withColumn("own", F.row_number().over(order) - 1).join(before, ["size", "salt"]).withColumn(
        "rank", F.col("before") + F.col("own")
    )


def pack(docs, path=None, length=LENGTH, grain=GRAIN, end=END, text="text"):
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Documents are cut into pieces of ``length`` tokens and a rest. The histogram of the pieces' lengths (``length /
    grain`` numbers at any input size) goes to the driver, where column generation finds the patterns; the pieces of a
    size are ranked and take the places of the patterns in turn. A sequence holds at most ``length`` tokens, without
    gaps. A null or empty text is the one token ``end``; rows that repeat an id are packed each on its own; an empty
    table gives no pieces.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    capacity = length // grain
    pieces = written(
        cut(docs, path or default_vocabulary(), length, end, text).withColumn("size", F.ceil(F.col("length") / grain).cast("int")), "pieces"
    )
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("size").count().collect():
        histogram[size] = n
    # at most one row for each size and pattern, whatever the input
    places = spark.createDataFrame(slots(histogram, capacity), "size int, lo long, hi long, each long, first long")
    found = (
        ranked(pieces)
        .join(F.broadcast(places), "size")
        .where("rank BETWEEN lo AND hi")
        .withColumn("sequence_id", F.expr("first + (rank - lo) div each"))
    )
    order = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32", "doc_tokens")
    sums = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0))
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (sums - F.col("length")).alias("offset")
    )


@CAT.add("op4_packing")
def packing(spark, sf):
    return pack(table(spark, sf, "documents"))
