"""Diagnostics over stored pairs of embeddings or codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def quantisation_error(df: DataFrame, a, b) -> DataFrame:
    """Σ(B − x)² with B the sign of the paired mean, and with B the own sign of ``a``."""
    mean_sign = F.zip_with(a, b, lambda x, y: F.signum(0.5 * (x + y)))

    def err(code, v):
        return A.total(F.zip_with(code, v, lambda s, x: (s - x) * (s - x)))

    own = A.total(F.transform(a, lambda x: (F.signum(x) - x) * (F.signum(x) - x)))
    return df.agg(
        F.sum(err(mean_sign, a) + err(mean_sign, b)).alias("paired"), F.sum(own).alias("single")
    )


def bit_balance(df: DataFrame, *codes) -> DataFrame:
    """Σ over rows and codes of the squared sum of bits."""
    row = sum(A.total(F.col(c)) * A.total(F.col(c)) for c in codes)
    return df.agg(F.sum(row).alias("bit_balance"))


def paired_similarity(df: DataFrame, a, b) -> DataFrame:
    return df.agg(F.avg(F.log(1 + F.exp(A.cosine(F.col(a), F.col(b))))).alias("paired_similarity"))


def class_code_distance(df: DataFrame, code, target) -> DataFrame:
    """Mean absolute distance of a code to the constant code of its class."""
    return df.agg(F.avg(A.total(F.transform(code, lambda x: F.abs(target - x)))).alias("class_code_distance"))


def unified_code(codes):
    """Sign of the component-wise mean of several codes."""
    n = len(codes)
    return F.transform(A.add_arrays(codes), lambda x: F.signum(x / n).cast("tinyint"))


def cross_entropy(df: DataFrame, logits, targets) -> DataFrame:
    """Mean binary cross-entropy with logits over all entries, overflow-safe."""
    per = F.zip_with(
        logits, targets, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    )
    return df.agg((F.sum(A.total(per)) / F.sum(F.size(logits))).alias("cross_entropy"))


def _unit(column):
    flat = column.combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _batches(df, batch, id_col, *vectors):
    return df.select(
        F.col(batch).cast("bigint").alias("batch"),
        F.col(id_col).cast("bigint").alias("id"),
        *[F.col(v).cast("array<double>").alias(f"v{i}") for i, v in enumerate(vectors)],
    )


def contrastive_loss(df: DataFrame, batch, id_col, a, b, temperature=0.07, eps=1e-6) -> DataFrame:
    """NT-Xent per training batch: mean form, sum form with e removed, cross-modal sum form.

    A batch is a bounded training batch (a few hundred pairs); its similarity
    matrix lives inside one task and only the three sums leave it.
    """

    def losses(t: pa.Table) -> pa.Table:
        x, y = _unit(t.column("v0")), _unit(t.column("v1"))
        z, partner = np.vstack([x, y]), np.vstack([y, x])
        sim = np.exp(z @ z.T / temperature)
        pos = np.exp((z * partner).sum(1) / temperature)
        total = sim.sum(1)
        n = len(x)
        cross = np.concatenate([sim[:n, n:].sum(1), sim[n:, :n].sum(1)])
        return pa.table(
            {
                "batch": [t.column("batch")[0].as_py()],
                "mean_loss": [float(np.mean(-np.log(pos / (total - np.diag(sim)))))],
                "sum_loss": [float(-np.log(pos / (np.maximum(total - math.e, eps) + eps)).sum())],
                "cross_loss": [float(-np.log(pos / (cross + eps)).sum())],
            }
        )

    schema = "batch bigint, mean_loss double, sum_loss double, cross_loss double"
    return _batches(df, batch, id_col, a, b).groupBy("batch").applyInArrow(losses, schema)


def nearest_cosine(df: DataFrame, batch, id_col, a, decimals=6) -> DataFrame:
    """Mean cosine of each unit vector to its nearest other one in the batch, ties by id."""

    def near(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        z = _unit(t.column("v0"))
        cos = z @ z.T
        d = np.round(np.maximum(2.0 - 2.0 * cos, 0.0), decimals)
        np.fill_diagonal(d, np.inf)
        best = d.argmin(1)
        value = float(cos[np.arange(len(z)), best].mean()) if len(z) > 1 else None
        return pa.table({"batch": [t.column("batch")[0].as_py()], "nearest_cosine": pa.array([value], pa.float64())})

    return _batches(df, batch, id_col, a).groupBy("batch").applyInArrow(near, "batch bigint, nearest_cosine double")
