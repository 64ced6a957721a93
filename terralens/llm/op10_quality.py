"""Quality of documents by a small convolutional network over their bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralens.plans.common import Catalogue, table

from .shared import bounded_batches
from .text import text_bytes

CAT = Catalogue()

#: Bytes that a filter sees, filters, and bytes of a block; a chunk is two neighbouring blocks, so chunks overlap by one.
WIDTH, FILTERS, BLOCK = 4, 8, 128
#: Labelled documents that the network learns from, each with its whole text, and bytes of all of them; the only bounded sample.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
ROUNDS, BATCH, RATE, SEED = 12, 64, 0.02, 11
#: Blocks convolved at once; the responses of a stripe (2 or 4 MB) stay below what the allocator keeps after use.
STRIPE = 512
ACCEPT = 0.3


@dataclass
class Network:
    """Filters over one-hot bytes (WIDTH x 256 x FILTERS), their offsets, and the weights of the pooled filters.

    Where nothing could be learned, ``weights`` are zero and every text scores the base rate in ``bias``.
    """

    filters: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    bias: float

    def pair_tables(self):
        """Filter responses by two neighbouring bytes: a position then needs WIDTH / 2 look-ups."""
        f = self.filters
        return [(f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, WIDTH, 2)]


def block_rows(data, offsets):
    """Start of each block, end of its text, and the first block of each text; an empty text has one block."""
    lengths = np.diff(offsets)
    count = np.maximum(-(-lengths // BLOCK), 1)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(lengths)), count)
    start = offsets[text] + (np.arange(int(count.sum())) - first[text]) * BLOCK
    return start, offsets[text + 1], first, count


def block_bytes(data, start, end, extra):
    """A row of bytes for each block, ``extra`` bytes beyond it, zero after the text's end."""
    at = start[:, None] + np.arange(BLOCK + extra)
    inside = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0)


def block_maxima(data, start, end, tables):
    out = np.empty((len(start), tables[0].shape[1]), np.float32)
    for lo in range(0, len(start), STRIPE):
        rows = block_bytes(data, start[lo : lo + STRIPE], end[lo : lo + STRIPE], WIDTH).astype(np.int32)
        pairs = rows[:, :-1] << 8 | rows[:, 1:]
        total = tables[0][pairs[:, :BLOCK]]
        for k in range(1, len(tables)):
            total += tables[k][pairs[:, 2 * k : 2 * k + BLOCK]]
        out[lo : lo + STRIPE] = total.max(axis=1)
    return out


def scores(column, network):
    """Probability of each text: filters pooled by maximum in each chunk, chunks averaged, one logistic unit."""
    if not len(column):
        return np.zeros(0)
    data, offsets = text_bytes(column)
    start, end, first, count = block_rows(data, offsets)
    best = block_maxima(data, start, end, network.pair_tables())
    chunk = np.maximum(best[:-1], best[1:])
    last = first + count - 1
    # a text of one block has that block as its chunk; otherwise its last block only ends a chunk
    chunk = np.concatenate([chunk, best[-1:]])
    chunk[last[count == 1]] = best[last[count == 1]]
    on = np.maximum(chunk + network.offsets, 0).astype(np.float64)
    on[last[count > 1]] = 0
    mean = np.add.reduceat(on, first, axis=0) / np.maximum(count - 1, 1)[:, None]
    return 1 / (1 + np.exp(-(mean @ network.weights + network.bias)))


def chunk_maxima(data, start, end, filters):
    """For each chunk and filter the largest response, and the WIDTH bytes it was found at."""
    high = np.empty((len(start), FILTERS), np.float32)
    seen = np.empty((WIDTH, len(start), FILTERS), np.uint8)
    for lo in range(0, len(start), STRIPE):
        hi = lo + STRIPE
        rows = block_bytes(data, start[lo:hi], end[lo:hi], BLOCK + WIDTH - 1)
        total = filters[0][rows[:, : 2 * BLOCK]]
        for k in range(1, WIDTH):
            total += filters[k][rows[:, k : k + 2 * BLOCK]]
        at = total.argmax(axis=1)
        high[lo:hi] = np.take_along_axis(total, at[:, None, :], 1)[:, 0]
        for k in range(WIDTH):
            seen[k, lo:hi] = np.take_along_axis(rows, at + k, 1)
    return high, seen


def fit(texts, labels, seed=SEED, rounds=ROUNDS):
    """Learns the network from all chunks of whole texts: ``texts`` holds arrays of bytes, ``labels`` values 0 to 1."""
    labels = np.asarray(labels, np.float64)
    rate = float((labels.sum() + 1) / (len(labels) + 2))
    rng = np.random.default_rng(seed)
    filters = rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32)
    offsets = np.zeros(FILTERS, np.float32)
    bias = float(np.log(rate / (1 - rate)))
    if len(labels) < 2 or labels.min() == labels.max():
        return Network(filters, offsets, np.zeros(FILTERS), bias)
    parts = [filters, offsets, rng.normal(0, 0.3, FILTERS), np.array([bias])]
    speed, size = [np.zeros(p.shape) for p in parts], [np.zeros(p.shape) for p in parts]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            data = np.concatenate([texts[i] for i in own])
            start, end, first, count = block_rows(data, np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]))
            # a text's last block only ends a chunk, unless it is the text's only one
            many = np.maximum(count - 1, 1)
            owner = np.repeat(np.arange(len(own)), many)
            pick = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            f, b, w, c = parts
            high, seen = chunk_maxima(data, start[pick], end[pick], f)
            on = np.maximum(high + b, 0)
            share = 1 / many
            mean = np.add.reduceat(on, np.cumsum(many) - many, axis=0, dtype=np.float64) * share[:, None]
            p = 1 / (1 + np.exp(-(mean @ w + c[0])))
            off = (p - labels[own]) / len(own)
            back = (off * share)[owner][:, None] * w * (on > 0)
            grad_f = np.zeros(f.shape)
            for k in range(WIDTH):
                for unit in range(FILTERS):
                    grad_f[k, :, unit] = np.bincount(seen[k, :, unit], back[:, unit], 256)
            step += 1
            for i, g in enumerate((grad_f, back.sum(0), mean.T @ off + 1e-4 * w, np.array([off.sum()]))):
                speed[i] = 0.9 * speed[i] + 0.1 * g
                size[i] = 0.99 * size[i] + 0.01 * g * g
                move = speed[i] / (1 - 0.9**step) / (np.sqrt(size[i] / (1 - 0.99**step)) + 1e-8)
                parts[i] = parts[i] - (RATE * move).astype(parts[i].dtype)
    f, b, w, c = parts
    return Network(f.astype(np.float32), b.astype(np.float32), w, float(c[0]))


def is_held_out(doc_id, folds=5):
    """Rows that the network never learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def learn(docs, labels, label="quality", sample=SAMPLE, sample_bytes=SAMPLE_BYTES):
    """The network learned from the whole texts of at most ``sample`` labelled rows of ``docs`` outside the held-out fold.

    Labels come from ``labels`` (doc_id, label) alone; null labels and ids are passed over, repeated labels of a
    document are averaged, and repeated rows (id and text) count once. Rows are drawn by hash; one that no longer fits
    ``sample_bytes`` is passed over, so the driver holds that many bytes of text at any input size.
    """
    bounded_batches(docs.sparkSession)
    spark, turn = docs.sparkSession, F.xxhash64("doc_id", F.lit(SEED))
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.avg(label).cast("double").alias("label"))
        .orderBy(turn, "doc_id")
        .limit(sample)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("version"), F.octet_length(text).cast("long").alias("size"))
    sizes = (
        rows.drop("text").join(F.broadcast(chosen), "doc_id").distinct().orderBy(turn, "doc_id", "version").limit(sample).collect()
    )
    taken, left = [], sample_bytes
    for r in sizes:
        if r["size"] <= left:
            taken.append((r["doc_id"], r["version"], r["label"]))
            left -= r["size"]
    kind = dict(docs.dtypes)["doc_id"]
    found = (
        rows.join(F.broadcast(spark.createDataFrame(taken, f"doc_id {kind}, version long, label double")), ["doc_id", "version"])
        .groupBy("doc_id", "version", "label")
        .agg(F.min("text").alias("text"))
        .orderBy(turn, "doc_id", "version")
        .collect()
    )
    return fit([np.frombuffer(r["text"].encode(), np.uint8) for r in found], [r["label"] for r in found])


def classify(docs, network, accept=ACCEPT):
    """``docs`` with score (0 to 1) and predicted (1 from ``accept`` on).

    The whole text is scored, whatever its length; null counts as empty, and an empty text gets the score of a block
    without bytes. Columns of ``docs`` named score or predicted are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    place = docs.columns.index("text")

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores(batch.column(place), network), pa.float64())], [*batch.schema.names, "score"]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(add, schema).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs, network, accept=ACCEPT):
    """The rows of ``docs`` that the network does not reject, with their columns as they were."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c in ("score", "predicted")}
    found = classify(docs.withColumnsRenamed(names), network, accept).where("predicted = 1").drop("score", "predicted")
    return found.withColumnsRenamed({v: k for k, v in names.items()})


@CAT.add("op10_quality")
def quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    network = learn(docs, table(spark, sf, "labels"))
    return classify(docs, network).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
