"""Pluggable batch encoders and text steps; the models themselves are the caller's."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_encoder(items):
    """Two features per text: space-separated words and characters."""
    return [[float(len(t.split(" "))), float(len(t))] for t in items]


def hashing_encoder(dim=64):
    """A model-free text encoder: hashed word counts."""

    def encode_batch(items):
        out = np.zeros((len(items), dim))
        for row, text in enumerate(items):
            for word in text.split():
                digest = hashlib.md5(word.encode()).digest()
                out[row, int.from_bytes(digest[:4], "big") % dim] += 1.0
        return out

    return encode_batch


def encode(df: DataFrame, id_col, item_col, encoder=None, batch_size=256) -> DataFrame:
    """Feature vector of every item from an arbitrary batch encoder; the id travels with it."""
    encoder = encoder or hashing_encoder()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                part = batch.slice(lo, batch_size)
                rows = [np.asarray(r, float).tolist() for r in encoder(part.column("item").to_pylist())]
                yield pa.RecordBatch.from_pydict(
                    {id_col: part.column(id_col), "embedding": pa.array(rows, pa.list_(pa.float64()))}
                )

    source = df.select(id_col, F.col(item_col).alias("item"))
    return source.mapInArrow(run, f"`{id_col}` {id_type}, embedding array<double>")


@dataclass
class ProjectionWeights:
    """Linear, batch-norm (stored mean and variance), ReLU, linear."""

    w1: list
    b1: list
    mean: list
    var: list
    gamma: list
    beta: list
    w2: list
    b2: list
    eps: float = 1e-5


def project_codes(df: DataFrame, vec, weights: ProjectionWeights, decimals=9) -> DataFrame:
    """Add ``code``: the sign of tanh of the two-layer projection. Weights have model size, not data size."""
    w = {k: np.asarray(v, float) for k, v in weights.__dict__.items()}
    shared = df.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("array<tinyint>")
    def project(column):
        import pandas as pd

        p = shared.value
        if len(column) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(column.to_numpy())
        h = x @ p["w1"].T + p["b1"]
        h = (h - p["mean"]) / np.sqrt(p["var"] + p["eps"]) * p["gamma"] + p["beta"]
        y = np.tanh(np.maximum(h, 0.0) @ p["w2"].T + p["b2"])
        return pd.Series(list(np.sign(np.round(y, decimals)).astype(np.int8)))

    return df.withColumn("code", project(F.col(vec).cast("array<double>")))


def chain_steps(df: DataFrame, id_col, text_col, steps, folder) -> DataFrame:
    """Run text steps ``[(name, fn)]`` one after another, one parquet table per step.

    A step whose table already exists under ``folder`` is read, not run again, so
    a long chain resumes after a failure.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    id_type = df.schema[id_col].dataType.simpleString()
    current = df.select(id_col, F.col(text_col).alias("text"))
    for name, fn in steps:
        path = f"{folder}/{name}"
        done = hadoop.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):

            def run(batches, fn=fn):
                for batch in batches:
                    texts = fn(batch.column("text").to_pylist())
                    yield pa.RecordBatch.from_pydict(
                        {id_col: batch.column(id_col), "text": pa.array(texts, pa.string())}
                    )

            out = current.mapInArrow(run, f"`{id_col}` {id_type}, text string")
            out.write.mode("overwrite").parquet(path)
        current = spark.read.parquet(path)
    return current
