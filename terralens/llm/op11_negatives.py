"""Hard negatives by lists that anchors of one cluster share.

Anchors are clustered by direction. For a cluster every row has one bound on its score with any member: its length times
the cosine of its angle to the cluster's centre less the widest angle of a member. The rows are sorted by that bound
once; each member walks the list, first for its positives, then for its negatives, until the bound of what is left is
below all it could still use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .op5_topk import matrix, packed, products, unpacked
from .shared import bounded_batches, shuffle_partitions, written

CAT = Catalogue()

EVERY, POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 100, 5, 10, 30, 90, 256
#: Anchors that the centres are learned from, anchors a cluster and clusters at most (each has a list of all rows).
SAMPLE, PER_CLUSTER, CLUSTERS = 8192, 256, 32
#: Rows of a piece of a list, anchors that walk it together, pieces that all of them read before any bound is known,
#: pieces that a task should get for a block of anchors.
PIECE, MEMBERS, HEAD, TOGETHER = 1024, 1024, 4, 8
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SLACK = 1e-6


def usable(vectors, scale=SCALE):
    """(vec_id, label, ints): rows with an id, a label and a whole vector, floor(scale * x) of each component."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    whole &= F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
        .where(whole)
        .select("vec_id", "label", F.transform(x, lambda v: F.floor(v * scale * 1.0).cast("double")).alias("ints"))
    )


def directions(m):
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def learned_centres(anchors, count, width):
    """Centres of at most CLUSTERS clusters by spherical k-means over at most SAMPLE anchors, taken by a hash of their id."""
    rows = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("ints").toArrow().combine_chunks()
    m = matrix(rows.column(0).combine_chunks(), width) if rows.num_rows else np.zeros((1, width))
    m = directions(m)
    centres = m[: max(1, min(CLUSTERS, -(-count // PER_CLUSTER), len(m)))].copy()
    for _ in range(10):
        of = (m @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, of, m)
        held = np.bincount(of, minlength=len(centres)) > 0
        centres[held] = directions(total[held])
    return centres


def angles(m, centres):
    """Angle of each row to each centre; a vector of zeros has a right angle to all."""
    return np.arccos(np.clip(directions(m) @ centres.T, -1, 1))


def assigned(anchors, centres, width):
    """(cluster, angle, vec_id, label, ints) of the anchors, ints as bytes."""

    def assign(batches):
        for batch in batches:
            m = matrix(batch.column(2), width)
            to = angles(m, centres.value)
            of = to.argmin(1)
            blobs = pa.array([packed(r) for r in m], pa.binary())
            columns = [pa.array(of), pa.array(to[np.arange(len(of)), of]), batch.column(0), batch.column(1), blobs]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "angle", "vec_id", "label", "ints"])

    return anchors.select("vec_id", "label", "ints").mapInArrow(assign, "cluster long, angle double, vec_id long, label long, ints binary")


def bounds(length, to_centre, widest):
    """Upper bound of the score with a vector of length one within ``widest`` of the centre."""
    return length * np.cos(np.maximum(to_centre - widest, 0))


PIECES = "cluster long, most double, ids binary, labels binary, ints binary"


def sorted_lists(rows, centres, widest, width):
    """The list of each cluster in pieces (cluster, no, most, ids, labels, ints); ``most`` is the bound of the first row."""

    def bound(batches):
        for batch in batches:
            m = matrix(batch.column(2), width)
            length, to = np.sqrt((m * m).sum(1)), angles(m, centres.value)
            blobs = pa.array([packed(r) for r in m], pa.binary())
            for c, angle in widest.value.items():
                columns = [pa.array(np.full(len(m), c)), pa.array(bounds(length, to[:, c], angle)), batch.column(0), batch.column(1), blobs]
                yield pa.RecordBatch.from_arrays(columns, ["cluster", "bound", "vec_id", "label", "ints"])

    def cut(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            done = 0
            cluster = held.column(0).to_numpy()
            while done < len(cluster):
                end = min(done + PIECE, int(np.searchsorted(cluster, cluster[done], "right")))
                if end == len(cluster) and end - done < PIECE:
                    break
                yield piece(held.slice(done, end - done))
                done = end
            held = held.slice(done) if done < held.num_rows else None
        if held is not None:
            yield piece(held)

    def piece(part):
        ints = np.stack([unpacked(b) for b in part.column(4).to_pylist()])
        blobs = [packed(part.column(2).to_numpy()), packed(part.column(3).to_numpy()), packed(ints)]
        columns = [part.column(0).slice(0, 1), part.column(1).slice(0, 1), *(pa.array([b], pa.binary()) for b in blobs)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

    count = shuffle_partitions(rows.sparkSession)
    return (
        rows.mapInArrow(bound, "cluster long, bound double, vec_id long, label long, ints binary")
        .repartitionByRange(count, "cluster", F.desc("bound"), "vec_id")
        .sortWithinPartitions("cluster", F.desc("bound"), "vec_id")
        .mapInArrow(cut, PIECES)
        .withColumn("no", F.monotonically_increasing_id())
    )


MEMBER = "cluster long, need double, ids binary, labels binary, ints binary, angles binary, lows binary, highs binary, bars binary, slots int"


def walkers(members):
    """Blocks of anchors of one cluster, neighbours by label: columns of MEMBER and ``block``.

    ``members`` has cluster, angle, vec_id, label, ints, and lists lows, highs and bars: for each thing a member looks
    for, the least and greatest score that fit and the least that may still count. ``need`` is the least bound that any
    of them can use, for a vector of length one.
    """

    def block(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            cluster = held.column(0).to_numpy()
            done = 0
            while done < len(cluster):
                end = min(done + MEMBERS, int(np.searchsorted(cluster, cluster[done], "right")))
                if end == len(cluster) and end - done < MEMBERS:
                    break
                yield one(held.slice(done, end - done))
                done = end
            held = held.slice(done) if done < held.num_rows else None
        if held is not None:
            yield one(held)

    def one(part):
        column = {n: part.column(n) for n in part.schema.names}
        ints = np.stack([unpacked(b) for b in column["ints"].to_pylist()]).astype(float)
        sizes = np.diff(column["lows"].offsets.to_numpy())
        slots = int(sizes.max(initial=0))
        windows = []
        for name, empty in (("lows", MOST), ("highs", NONE), ("bars", MOST)):
            w = np.full((len(ints), slots), empty)
            w[np.arange(slots) < sizes[:, None]] = column[name].flatten().to_numpy()
            windows.append(w)
        need = needed(ints, np.maximum(windows[0], windows[2]))
        blobs = [packed(column["vec_id"].to_numpy()), packed(column["label"].to_numpy()), packed(ints), b"f8" + column["angle"].to_numpy().astype("<f8").tobytes()]
        blobs += [b"i8" + w.astype("<i8").tobytes() for w in windows]
        columns = [column["cluster"].slice(0, 1), pa.array([need]), *(pa.array([b], pa.binary()) for b in blobs), pa.array([slots], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in MEMBER.split(", ")])

    return (
        members.select("cluster", "angle", "vec_id", "label", "ints", "lows", "highs", "bars")
        .repartitionByRange(shuffle_partitions(members.sparkSession), "cluster", "label", "vec_id")
        .sortWithinPartitions("cluster", "label", "vec_id")
        .mapInArrow(block, MEMBER)
        .withColumn("block", F.monotonically_increasing_id())
    )


def needed(ints, floors):
    """The least bound for length one that some member can use, given the scores below which it has no use for any row."""
    if not floors.size:
        return float("inf")
    least = floors.min(1).astype(float)
    length = np.sqrt((ints * ints).sum(1))
    ratio = np.where(length > 0, (least - 1) / np.maximum(length, 1e-300), np.where(least <= 0, -np.inf, np.inf))
    return float(np.where(least >= MOST, np.inf, ratio).min())


class Walk:
    """The best rows that a block's members have met, for each thing they look for."""

    def __init__(self, row, centre, same, top):
        self.ids, self.labels = (unpacked(row[n]).astype(np.int64) for n in ("ids", "labels"))
        self.ints = unpacked(row["ints"]).reshape(len(self.ids), -1).astype(float)
        self.lows, self.highs, self.bars = (unpacked(row[n]).reshape(len(self.ids), row["slots"]) for n in ("lows", "highs", "bars"))
        self.slots, self.centre, self.same, self.top = row["slots"], centre, same, top
        self.angle = unpacked(row["angles"])
        self.length = np.sqrt((self.ints * self.ints).sum(1))
        self.floor = np.maximum(self.lows, self.bars)
        self.key, self.score, self.who = (np.zeros(0, np.int64) for _ in range(3))
        self.need = needed(self.ints, self.floor)

    def over(self, most):
        """Whether rows with bounds up to ``most`` are of no use to any member."""
        return most + SLACK * abs(most) < self.need

    def meet(self, ids, labels, ints):
        length = np.sqrt((ints * ints).sum(1))
        to = angles(ints, self.centre[None])[:, 0]
        # the member's own angle bounds tighter than the cluster's widest
        best = bounds(length[None], to[None], self.angle[:, None]) * self.length[:, None]
        best += SLACK * length[None] * self.length[:, None] + 1
        open_ = best >= self.floor.min(1, initial=MOST).astype(float)[:, None]
        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            return
        scores = products(self.ints[rows], ints[columns])
        fit = (labels[columns][None] == self.labels[rows, None]) == self.same
        fit &= ids[columns][None] != self.ids[rows, None]
        for slot in range(self.slots):
            low, high = self.floor[rows, slot], self.highs[rows, slot]
            r, c = np.nonzero(fit & (scores >= low[:, None]) & (scores <= high[:, None]))
            self.key = np.concatenate([self.key, rows[r] * self.slots + slot])
            self.score = np.concatenate([self.score, scores[r, c]])
            self.who = np.concatenate([self.who, ids[columns[c]]])
        self._keep()

    def _keep(self):
        order = np.lexsort((self.who, ~self.score, self.key))
        key = self.key[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        order = order[rank < self.top]
        self.key, self.score, self.who = self.key[order], self.score[order], self.who[order]
        last = rank[rank < self.top] == self.top - 1
        floor = self.floor.reshape(-1)
        floor[self.key[last]] = np.maximum(floor[self.key[last]], self.score[last])
        self.need = needed(self.ints, self.floor)

    def told(self):
        row, slot = np.divmod(self.key, max(self.slots, 1))
        columns = [pa.array(self.ids[row]), pa.array(slot), pa.array(self.who), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "slot", "vec_id", "score"])


def walked(members, lists, centres, width, same, top):
    """(anchor_id, slot, vec_id, score) of the rows that may be among a member's ``top``, from all pieces its bound lets in.

    A block's pieces are dealt to several tasks, each of which walks its own by descending bound until it is over.
    """
    spark = members.sparkSession
    blocks = written(walkers(members), "walkers")
    most = lists.groupBy("cluster").count().agg(F.max("count").alias("n")).first()["n"] or 1
    parts = max(1, min(shuffle_partitions(spark), -(-most // TOGETHER)))
    walk_no = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    blobs = [f.split()[0] for f in MEMBER.split(", ")]
    empty = {n: F.lit(None).cast("binary").alias(n) for n in ("angles", "lows", "highs", "bars")}
    asking = blocks.select("block", walk_no, F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("no"), F.lit(0.0).alias("most"), *blobs)
    let_in = F.col("most") + SLACK * F.abs("most") >= F.col("need")
    offered = (
        lists.join(blocks.select("cluster", "block", "need"), "cluster")
        .where(let_in)
        .select(
            "block", F.pmod("no", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "no", "most",
            "cluster", "need", "ids", "labels", "ints", *empty.values(), F.lit(0).alias("slots"),
        )
    )

    def walk(batches):
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now is not None and len(now.key):
                        yield now.told()
                    now = Walk(row, centres.value[row["cluster"]], same, top)
                elif not now.over(row["most"]):
                    ids, labels = (unpacked(row[n]).astype(np.int64) for n in ("ids", "labels"))
                    now.meet(ids, labels, unpacked(row["ints"]).reshape(len(ids), width).astype(float))
        if now is not None and len(now.key):
            yield now.told()

    return (
        asking.unionByName(offered)
        .repartition(shuffle_partitions(spark), "block", "part")
        .sortWithinPartitions("block", "part", "kind", F.desc("most"), "no")
        .mapInArrow(walk, "anchor_id long, slot long, vec_id long, score long")
    )


def best(found, top):
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def both_walks(members, head, rest, centres, width, same, top, name):
    """The ``top`` best rows of each (anchor, slot): the heads of the lists tell bounds for the walk over the rest."""
    first = written(walked(members, head, centres, width, same, top), name)
    known = best(first, top).where(F.col("rank") == top).select("anchor_id", "slot", "score")
    known = known.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("known"))
    bar = lambda old, slot: F.greatest(old, F.coalesce(F.col("known")[slot.cast("long")], old))
    told = members.join(known, members["vec_id"] == known["anchor_id"], "left").withColumn("bars", F.transform("bars", bar))
    return written(best(first.unionByName(walked(told, rest, centres, width, same, top)), top), name)


def mined(vectors, every=EVERY, positives=POSITIVES, negatives=NEGATIVES, low=LOW, high=HIGH, scale=SCALE):
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of the integer vectors; higher first, ties by the smaller vec_id. Anchors are rows whose
    vec_id is divisible by ``every``, positives their first ``positives`` other rows of the same label, negatives the first
    ``negatives`` rows of another label with a score from ``low`` to ``high`` percent of the positive's, so a positive with a
    score below zero has none. Rows without id or label or with a vector that is not whole take no part. Vectors of other
    lengths count as filled with zeros. Rows that repeat a vec_id are candidates each, but never of their own id, and an
    anchor id that repeats is answered for the least of its rows. An empty table gives an empty one; only vec_id, label
    and embedding are read. Nothing is left out: what a walk does not read has bounds below all that could count.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = written(usable(vectors, scale), "usable")
    width = max(rows.agg(F.max(F.size("ints")).alias("w")).first()["w"] or 0, 1)
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("r")).select("vec_id", "r.*")
    centres = spark.sparkContext.broadcast(learned_centres(anchors, anchors.count(), width))
    members = written(assigned(anchors, centres, width), "anchors")
    widest = spark.sparkContext.broadcast({r["cluster"]: r["angle"] for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect()})
    lists = written(sorted_lists(rows.select("vec_id", "label", "ints"), centres, widest, width), "lists")
    heads = lists.select("cluster", "no", "most").withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("most"), "no")))
    heads = written(heads.where(F.col("place") <= HEAD).select("no"), "heads")
    head, rest = lists.join(heads, "no", "left_semi"), lists.join(heads, "no", "left_anti")

    one = lambda v: F.array(F.lit(int(v)).cast("long"))
    asking = members.withColumns({"lows": one(NONE), "highs": one(MOST), "bars": one(NONE)})
    found = both_walks(asking, head, rest, centres, width, True, positives, "positives")
    found = found.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    listed = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    of = lambda percent, cut: F.transform("p", lambda x: cut(x["positive_score"].cast("decimal(20,0)") * percent / 100).cast("long"))
    asking = (
        members.join(listed, members["vec_id"] == listed["anchor_id"])
        .withColumns({"lows": of(low, F.ceil), "highs": of(high, F.floor), "bars": F.transform("p", lambda x: F.lit(int(NONE)).cast("long"))})
        .select(*members.columns, "lows", "highs", "bars")
    )
    told = both_walks(asking, head, rest, centres, width, False, negatives, "negatives")
    return told.join(found, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


@CAT.add(
    "op11_negatives",
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x) for x in embedding::DOUBLE[]] AS ints
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding::DOUBLE[] if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.ints, c.ints)::BIGINT AS score
      FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
)
def hard_negatives(spark, sf):
    moved = (F.col("label") + 1) % 10
    vectors = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")))
    return mined(vectors)
