"""Exact top-k by integer inner product: vectors by descending length, pruned by Cauchy-Schwarz bounds.

Vectors are turned into the basis of the right singular vectors of all of them (the eigenvectors of their second moments), so most of an
inner product lies in the first coordinates; the rest is at most the product of the lengths of what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .shared import shuffle_partitions, written

CAT = Catalogue()

TOP, SCALE, EVERY = 5, 256, 50
#: Vectors of a block, queries of a block, and rotated coordinates of the first bound.
BLOCK, QUERIES, LEAD = 2048, 1024, 24
#: Below this the sums of products are exact in doubles; above, Python integers are used.
SAFE = 1 << 53
LONG = np.iinfo(np.int64)


def whole_vectors(vectors, scale=SCALE):
    """(vec_id, ints, norm2): floor(scale * x) of every usable vector, and the squared length as a double.

    A vector takes no part if it, its id or a component is null, or a component is not finite.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    ints = F.transform(x, lambda v: F.floor(v * scale * 1.0).cast("double"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(usable)
        .select("vec_id", ints.alias("ints"))
        .withColumn("norm2", F.aggregate("ints", F.lit(0.0), lambda s, v: s + v * v))
    )


def matrix(lists, width=None):
    """Rows of a list column as a matrix; shorter ones are filled with zeros."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    counts = np.diff(offsets)
    width = max(int(counts.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(counts), width))
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], counts)] = flat
    return out


def rotation(vectors, width):
    """The right singular vectors of all vectors, leading first: width x width, from sums of products over the tasks."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0), width)
            m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["i", "v"])

    rows = vectors.select("ints").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(width * width)
    total[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def blocked(vectors, size, width):
    """Rows (block, ids, ints, most): at most ``size`` vectors of neighbouring length as byte blocks, longest first.

    The blocks follow the range partitions of the squared length, so no task sorts all vectors.
    """

    def block(batches):
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            held_ids = np.concatenate([held_ids, batch.column(0).to_numpy()])
            held = np.concatenate([held, matrix(batch.column(1), width)])
            while len(held) >= size:
                yield row(held_ids[:size], held[:size])
                held_ids, held = held_ids[size:], held[size:]
        if len(held):
            yield row(held_ids, held)

    def row(ids, ints):
        most = float(np.sqrt((ints * ints).sum(1).max()))
        return pa.RecordBatch.from_arrays([pa.array([packed(ids)], pa.binary()), pa.array([packed(ints)], pa.binary()), pa.array([most])], ["ids", "ints", "most"])

    count = shuffle_partitions(vectors.sparkSession)
    return (
        vectors.repartitionByRange(count, F.desc("norm2"), "vec_id")
        .sortWithinPartitions(F.desc("norm2"), "vec_id")
        .select("vec_id", "ints")
        .mapInArrow(block, "ids binary, ints binary, most double")
    )


def query_blocks(asked, blocks, width):
    """Rows (block, ids, ints): the queries dealt by hash into ``blocks`` blocks, numbered from 0."""

    def block(batches):
        own, ids, ints = None, [], []
        for batch in batches:
            no = batch.column(0).to_numpy()
            for b in np.unique(no):
                at = np.flatnonzero(no == b)
                if own is not None and b != own:
                    yield row(own, ids, ints)
                    ids, ints = [], []
                own = b
                ids.append(batch.column(1).to_numpy()[at])
                ints.append(matrix(batch.column(2).take(pa.array(at)), width))
        if own is not None:
            yield row(own, ids, ints)

    def row(no, ids, ints):
        blobs = [packed(np.concatenate(x)) for x in (ids, ints)]
        return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["block", "ids", "ints"])

    return (
        asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "ints")
        .repartition(shuffle_partitions(asked.sparkSession), "block")
        .sortWithinPartitions("block", "vec_id")
        .mapInArrow(block, "block int, ids binary, ints binary")
    )


def packed(values):
    """Whole numbers as bytes of the narrowest of three types, named by the first byte."""
    most = np.abs(values).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8" if values.dtype.kind == "i" else "<f8"
    return kind[1:].encode() + values.astype(kind).tobytes()


def unpacked(blob):
    return np.frombuffer(blob, "<" + blob[:2].decode(), offset=2)


class Best:
    """The ``top`` best candidates of each query met so far."""

    def __init__(self, ids, ints, turn, top):
        self.ids, self.ints, self.top = ids, ints, top
        self.turned = ints @ turn
        self.lead = min(LEAD, turn.shape[1])
        self.length = np.sqrt((ints * ints).sum(1))
        self.rest = np.sqrt((self.turned[:, self.lead :] ** 2).sum(1))
        self.turn = turn
        self.score = np.full((len(ids), top), LONG.min)
        self.who = np.full((len(ids), top), LONG.max)
        self.own = np.zeros((len(ids), top), bool)
        self.filled = np.zeros(len(ids), np.int64)

    def bar(self):
        """A candidate below this score cannot enter."""
        return np.where(self.filled >= self.top, self.score[:, -1].astype(float), -np.inf)

    def meet(self, ids, ints, most, own=True):
        """``own`` says whether these candidates are this task's to report; others only raise the bar."""
        slack = 1e-9
        bar = self.bar()
        live = np.flatnonzero(self.length * most * (1 + slack) + 1 >= bar)
        if not len(live):
            return
        turned = ints @ self.turn
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        length = np.sqrt((ints * ints).sum(1))
        bound = self.turned[live, : self.lead] @ turned[:, : self.lead].T + self.rest[live, None] * rest
        bound += slack * self.length[live, None] * length + 1
        open_ = bound >= bar[live, None]
        rows = live[open_.any(1)]
        columns = np.flatnonzero(open_.any(0))
        if not len(rows):
            return
        exact = products(self.ints[rows], ints[columns])
        who = ids[columns]
        for r, scores in zip(rows.tolist(), exact):
            floor = self.score[r, -1] if self.filled[r] >= self.top else LONG.min
            pick = np.flatnonzero((scores >= floor) & (who != self.ids[r]))
            if not len(pick):
                continue
            have = min(int(self.filled[r]), self.top)
            s, w = np.concatenate([self.score[r, :have], scores[pick]]), np.concatenate([self.who[r, :have], who[pick]])
            mine = np.concatenate([self.own[r, :have], np.full(len(pick), own)])
            order = np.lexsort((w, ~s))[: self.top]
            self.filled[r] = len(order)
            self.own[r, : len(order)] = mine[order]
            self.score[r, : len(order)], self.who[r, : len(order)] = s[order], w[order]


def products(x, y):
    """Integer inner products as longs; beyond the range of a long they stop at its ends."""
    if not x.size or not y.size or np.abs(x).max() * np.abs(y).max() * x.shape[1] < SAFE:
        return (x @ y.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in r] for r in m], dtype=object) for m in (x, y))
    exact = a @ b.T
    return np.array([[min(max(v, LONG.min), LONG.max) for v in r] for r in exact], dtype=np.int64).reshape(exact.shape)


def top_products(vectors, every=EVERY, top=TOP, scale=SCALE):
    """Per query (vec_id divisible by ``every``) its ``top`` candidates: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Vectors of other lengths count as filled with zeros; null and empty tables give an
    empty one; rows that repeat a vec_id are candidates each, but never of their own id, and a repeated query id is
    answered for the least of its vectors. Only vec_id and embedding are read. Query blocks meet candidate blocks in a
    grid of tasks; a task sees its candidates by descending length and leaves off where no bound can be beaten. What
    the longest candidates give bounds every task from the start.
    """
    spark = vectors.sparkSession
    whole = written(whole_vectors(vectors, scale), "vectors")
    sizes = whole.agg(F.max(F.size("ints")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = max(sizes["width"] or 0, 1)
    turn = spark.sparkContext.broadcast(rotation(whole, width))
    asked = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("ints").alias("ints"))
    count = max(1, -(-asked.count() // QUERIES))
    queries = query_blocks(asked, count, width)
    blocks = written(blocked(whole, BLOCK, width).withColumn("no", F.monotonically_increasing_id()), "blocks")
    # the block of the longest vectors goes to all tasks
    first = blocks.orderBy(F.desc("most"), "no").limit(1).select("no", "ids", "ints", "most").collect()
    longest = spark.sparkContext.broadcast([tuple(r) for r in first])
    groups = max(1, min(shuffle_partitions(spark), -(-sizes["n"] // BLOCK)))

    def search(batches):
        best, done = None, {no for no, *_ in longest.value}
        for batch in batches:
            for part, kind, no, ids, ints, most in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if best is not None:
                        yield told(best)
                    best = Best(unpacked(ids).astype(np.int64), unpacked(ints).reshape(-1, width).astype(float), turn.value, top)
                    for _, a, b, m in longest.value:
                        best.meet(unpacked(a).astype(np.int64), unpacked(b).reshape(-1, width).astype(float), m, part == 0)
                elif best is not None and no not in done:
                    best.meet(unpacked(ids).astype(np.int64), unpacked(ints).reshape(-1, width).astype(float), most)
        if best is not None:
            yield told(best)

    def told(best):
        have = (np.arange(top) < np.minimum(best.filled, top)[:, None]) & best.own
        row = np.nonzero(have)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(best.ids[row]), pa.array(best.who[have]), pa.array(best.score[have])], ["query_id", "vec_id", "score"]
        )

    # the grid of blocks: each block of queries meets each block of candidates in one of its tasks
    part = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asking = queries.select("block", part.alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("no"), "ids", "ints", F.lit(0.0).alias("most"))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(groups)).cast("int"))
    offered = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), "part", F.lit(1).alias("kind"), "no", "ids", "ints", "most")
    found = (
        asking.unionByName(offered)
        .repartition(shuffle_partitions(spark), "block", "part")
        .sortWithinPartitions("block", "part", "kind", F.desc("most"), "no")
        .select("part", "kind", "no", "ids", "ints", "most")
        .mapInArrow(search, "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


@CAT.add(
    "op5_topk",
    """
WITH v AS (SELECT vec_id, [floor(256 * x) for x in embedding::DOUBLE[]] AS ints FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding::DOUBLE[] if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.ints, c.ints)::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def topk(spark, sf):
    return top_products(table(spark, sf, "embeddings"))
