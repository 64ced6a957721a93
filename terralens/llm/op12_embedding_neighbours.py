"""Near-duplicate embeddings by product quantisation: coarse lists, residual codes, table lookups, exact cosines.

Unit vectors go to the list of their nearest centre; what is left is cut into subspaces, each coded by its nearest word.
A coded vector is known up to the length of its coding error, so a looked-up distance beyond the threshold by more than
that error excludes it for certain. A list is probed unless its centre proves that it holds nothing near enough. All
that is left is compared by its cosine in double precision, so no link is lost and none is wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .components import components
from .op5_topk import matrix, packed, unpacked
from .shared import bounded_batches, shuffle_partitions, written

CAT = Catalogue()

LEAST = 0.93
#: Vectors that centres and words are learned from, vectors that a label's list should hold, lists at most, subspaces, words of each.
SAMPLE, PER_LIST, LISTS, SUBSPACES, WORDS = 8192, 1024, 256, 8, 256
#: Vectors of a block; a longer list has several. Listed blocks that a task should get for an asking one.
BLOCK, TOGETHER = 1024, 8
#: Parts that the copies of one vector are counted in.
SALTS = 32
SLACK = 1e-6
#: What looked-up distances in single precision may be off by.
LOOKUP = 1e-3


def usable():
    """Whether a row can link: it has an id, a label and a whole vector that is not zero."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    whole &= F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return whole & F.exists(x, lambda v: v != 0)


def units(m):
    """Rows of length one; the greatest component is taken out first, so no square leaves the range of a double."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def squares(x, y):
    """Squared distances of all rows of x to all of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1), 0)


def nearest_means(m, count, rounds=10):
    """k-means from the first rows."""
    means = m[: max(1, min(count, len(m)))].copy()
    for _ in range(rounds):
        of = squares(m, means).argmin(1)
        total = np.zeros_like(means)
        np.add.at(total, of, m)
        held = np.bincount(of, minlength=len(means))
        means[held > 0] = total[held > 0] / held[held > 0, None]
    return means


class Quantiser:
    """Centres, and for each subspace its components and its words."""

    def __init__(self, sample, lists):
        self.centres = nearest_means(sample, lists)
        left = sample - self.centres[squares(sample, self.centres).argmin(1)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [nearest_means(left[:, cut], WORDS) for cut in self.cuts]
        gap = np.sqrt(squares(self.centres, self.centres))
        self.gap = np.maximum(gap, 1e-300)

    def code(self, u):
        """List, code and coding error of each unit vector."""
        of = squares(u, self.centres).argmin(1)
        left = u - self.centres[of]
        codes = np.stack([squares(left[:, cut], words).argmin(1) for cut, words in zip(self.cuts, self.words)], 1)
        error = sum(((left[:, cut] - words[codes[:, i]]) ** 2).sum(1) for i, (cut, words) in enumerate(zip(self.cuts, self.words)))
        return of, codes.astype(np.uint8), np.sqrt(error)

    def reach(self, u, of, radius, within):
        """Which lists may hold something within a distance of each vector.

        A vector nearer to another centre lies beyond the plane half way to it, and none of a list is farther from its
        centre than the list's radius.
        """
        to = squares(u, self.centres)
        own = to[np.arange(len(u)), of][:, None]
        plane = (to - own) / (2 * self.gap[of])
        plane[np.arange(len(u)), of] = 0
        return (plane <= within + SLACK) & (np.sqrt(to) - radius <= within + SLACK)

    def lookups(self, u, cell):
        """Squared distances of what a list's centre leaves of each vector to each word, per subspace."""
        left = u - self.centres[cell]
        return [squares(left[:, cut], words).astype(np.float32) for cut, words in zip(self.cuts, self.words)]


def distances(tables, codes):
    """Looked-up distances of all queries to all coded vectors."""
    total = tables[0][:, codes[:, 0]]
    for i, t in enumerate(tables[1:], 1):
        total += t[:, codes[:, i]]
    return np.sqrt(np.maximum(total, 0))


def exact_bytes(m):
    """A matrix as bytes of single precision where that loses nothing."""
    short = m.astype("<f4")
    return b"f4" + short.tobytes() if (short == m).all() else b"f8" + m.astype("<f8").tobytes()


def coded(nodes, quantiser, width):
    """(no, label, cell, weight, far, x, code, error) of distinct vectors; ``far`` is the distance to the centre."""

    def code(batches):
        for batch in batches:
            m = matrix(batch.column(3), width)
            u, q = units(m), quantiser.value
            of, codes, error = q.code(u)
            far = np.sqrt(((u - q.centres[of]) ** 2).sum(1))
            blobs = [pa.array([exact_bytes(r) for r in m], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary())]
            columns = [batch.column(0), batch.column(1), pa.array(of), batch.column(2), pa.array(far), *blobs, pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["no", "label", "cell", "weight", "far", "x", "code", "error"])

    kind = "no long, label long, cell long, weight long, far double, x binary, code binary, error double"
    return nodes.select("no", "label", "weight", "x").mapInArrow(code, kind)


BLOCKED = "label long, cell long, reached array<long>, nos binary, weights binary, xs binary, codes binary, errors binary"


def blocked(rows, quantiser, radius, within, width):
    """Blocks of at most BLOCK vectors of one label and list, with the lists that any of them has to probe."""

    def block(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = np.stack([held.column(0).to_numpy(), held.column(1).to_numpy()])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            done = 0
            while done < held.num_rows:
                later = new[np.searchsorted(new, done, "right") :]
                end = min(done + BLOCK, int(later[0]) if len(later) else held.num_rows)
                if end == held.num_rows and end - done < BLOCK:
                    break
                yield one(held.slice(done, end - done))
                done = end
            held = held.slice(done) if done < held.num_rows else None
        if held is not None:
            yield one(held)

    def one(part):
        column = {n: part.column(n) for n in part.schema.names}
        m = np.stack([unpacked(b) for b in column["x"].to_pylist()]).astype(float)
        cell = column["cell"][0].as_py()
        reached = quantiser.value.reach(units(m), np.full(len(m), cell), radius.value, within).any(0)
        codes = b"".join(column["code"].to_pylist())
        blobs = [packed(column["no"].to_numpy()), packed(column["weight"].to_numpy()), exact_bytes(m), codes, column["error"].to_numpy().astype("<f8").tobytes()]
        columns = [column["label"].slice(0, 1), column["cell"].slice(0, 1), pa.array([np.flatnonzero(reached)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], [f.split()[0] for f in BLOCKED.split(", ")])

    return (
        rows.select("label", "cell", "no", "weight", "x", "code", "error")
        .repartitionByRange(shuffle_partitions(rows.sparkSession), "label", "cell", "no")
        .sortWithinPartitions("label", "cell", "no")
        .mapInArrow(block, BLOCKED)
        .withColumn("block", F.monotonically_increasing_id())
    )


class Block:
    def __init__(self, row, width):
        self.nos, self.weights = (unpacked(row[n]).astype(np.int64) for n in ("nos", "weights"))
        self.u = units(unpacked(row["xs"]).reshape(len(self.nos), width).astype(float))
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.nos), -1)
        self.errors = np.frombuffer(row["errors"], "<f8")
        self.cell = row["cell"]


def linked(asking, listed, quantiser, radius, least, within, same):
    """Rows of ``asking`` and of ``listed`` and which of them link, by table lookups and then by their cosines."""
    of = np.full(len(asking.u), asking.cell)
    rows = np.flatnonzero(quantiser.reach(asking.u, of, radius, within)[:, listed.cell])
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, np.zeros((0, 0), bool)
    near = distances(quantiser.lookups(asking.u[rows], listed.cell), listed.codes) <= within + listed.errors + LOOKUP
    if same:
        near[np.arange(len(rows)), rows] = False
    some, columns = near.any(1), np.flatnonzero(near.any(0))
    rows = rows[some]
    found = near[some][:, columns]
    if len(rows):
        found &= asking.u[rows] @ listed.u[columns].T >= least
    return rows, columns, found


def least_reached(a, b, found):
    """For the nodes of both sides the least node that they reach over these links."""
    top = np.iinfo(np.int64).max
    a, b = a.copy(), b.copy()
    while True:
        by_a = np.minimum(a, np.where(found, b[None], top).min(1, initial=top))
        by_b = np.minimum(b, np.where(found, by_a[:, None], top).min(0, initial=top))
        if (by_a == a).all() and (by_b == b).all():
            return a, b
        a, b = by_a, by_b


def found_links(blocks, quantiser, radius, least, within, width):
    """(no, links, root): per pair of blocks, the vectors with links in it, their number and a smaller node they reach.

    A pair of blocks is compared once, in one of the tasks that its asking block is dealt to. No pairs are emitted.
    """
    spark = blocks.sparkSession
    most = blocks.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 1
    parts = max(1, min(shuffle_partitions(spark), -(-most // TOGETHER)))
    names = ["label", "cell", "nos", "weights", "xs", "codes", "errors"]
    asking = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.col("block").alias("listed"), *names)
    wanted = blocks.select(F.col("block").alias("asking"), "label", F.explode("reached").alias("cell"))
    offered = (
        blocks.join(wanted, ["label", "cell"])
        .where(F.col("asking") <= F.col("block"))
        .select(F.col("asking").alias("block"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("block").alias("listed"), *names)
    )

    def compare(batches):
        own, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                other = Block(row, width)
                if row["kind"] == 0:
                    own, now = row["listed"], other
                    continue
                same = row["listed"] == own
                rows, columns, found = linked(now, other, quantiser.value, radius.value, least, within, same)
                if not found.any():
                    continue
                a, b = now.nos[rows], other.nos[columns]
                root_a, root_b = least_reached(a, b, found)
                by_a = found @ other.weights[columns]
                nos, links, roots = a, by_a, root_a
                if not same:
                    nos, links, roots = (np.concatenate(x) for x in ((a, b), (by_a, now.weights[rows] @ found), (root_a, root_b)))
                has = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[has].astype(np.int64)) for x in (nos, links, roots)], ["no", "links", "root"])

    return (
        asking.unionByName(offered)
        .repartition(shuffle_partitions(spark), "block", "part")
        .sortWithinPartitions("block", "part", "kind", "listed")
        .select("kind", "listed", *names)
        .mapInArrow(compare, "no long, links long, root long")
    )


def neighbours(vectors, least=LEAST):
    """Per row: vec_id, n_links, component_id, kept.

    Two rows link when their labels are equal and the cosine of their vectors is at least ``least``. Rows without id or
    label, and those whose vector is null, zero or holds null or non-finite components, link with nothing and are
    their own component (a row without id has none and is not kept). Rows that repeat an id are vectors of their own, each
    counted and returned; vectors of other lengths count as filled with zeros; an empty table gives an empty one. Only
    vec_id, label and embedding are read. Equal vectors of a label are compared once, with their number; a component is
    told by its smallest vec_id. ``least`` must be positive.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    own = own.withColumn("salt", F.when(usable(), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))))
    salted = own.where("salt IS NOT NULL").groupBy("label", "embedding", "salt").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    salted = written(salted, "salted")
    nodes = salted.groupBy("label", "embedding").agg(F.min("first").alias("first"), F.sum("n").alias("weight"))
    nodes = written(nodes.withColumn("x", F.col("embedding").cast("array<double>")).withColumn("no", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    width = max(sizes["width"] or 0, 1)
    lists = min(LISTS, -(-sizes["n"] // (PER_LIST * max(sizes["labels"], 1))))
    sample = nodes.orderBy(F.xxhash64("label", "first"), "no").limit(SAMPLE).select("x").toArrow().combine_chunks()
    sample = units(matrix(sample.column(0).combine_chunks(), width)) if sizes["n"] else np.ones((1, width))
    quantiser = spark.sparkContext.broadcast(Quantiser(sample, lists))
    rows = written(coded(nodes, quantiser, width), "coded")
    far = np.zeros(len(quantiser.value.centres))
    for r in rows.groupBy("cell").agg(F.max("far").alias("far")).collect():
        far[r["cell"]] = r["far"]
    radius = spark.sparkContext.broadcast(far)
    within = float(np.sqrt(max(2 - 2 * least, 0)))
    blocks = written(blocked(rows, quantiser, radius, within, width), "blocks")
    links = written(found_links(blocks, quantiser, radius, least, within, width), "links")
    counted = links.groupBy("no").agg(F.sum("links").alias("links"))
    root = components(links.select(F.col("no").alias("a"), F.col("root").alias("b")))
    told = nodes.select("no", "label", "embedding", "first", "weight").join(counted, "no", "left").join(root, F.col("no") == F.col("node"), "left")
    told = written(told.select("label", "embedding", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "no").alias("root")), "told")
    least_id = told.groupBy("root").agg(F.min("first").alias("component_id"))
    told = told.join(least_id, "root").select("label", "embedding", "n_links", "component_id")
    by_salt = salted.select("label", "embedding", "salt").join(told, ["label", "embedding"])
    return own.join(by_salt, ["label", "embedding", "salt"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


@CAT.add(
    "op12_embedding_neighbours",
    """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([c for c in embedding::DOUBLE[] if c IS NULL OR NOT isfinite(c)]) = 0
             AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(vec_id, least), vec_id) AS component_id,
       vec_id = coalesce(least(vec_id, least), vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
)
def embedding_neighbours(spark, sf):
    return neighbours(table(spark, sf, "embeddings"))
