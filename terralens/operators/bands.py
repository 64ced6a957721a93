"""Band arrays of image patches and relevance maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

# fixed values: band combinations by name; each is also known by its number of bands
S1_BANDS = ["VH", "VV"]
S2_BANDS = ["B02", "B03", "B04", "B08", "B05", "B06", "B07", "B11", "B12", "B8A"]
RGB_BANDS = ["B04", "B03", "B02"]
COMBINATIONS = {
    "S1": S1_BANDS,
    "S2": S2_BANDS,
    "10m20m": S2_BANDS + S1_BANDS,
    "RGB": RGB_BANDS,
    "RGB-IR": RGB_BANDS + ["B08"],
}
# fixed values: bands outside every combination
OTHER_BANDS = ["B01", "B09"]
KNOWN_BANDS = sorted({b for names in COMBINATIONS.values() for b in names} | set(OTHER_BANDS))


def resolve(bands):
    """Band names of a combination's name, its number of bands, or a list of names; a ValueError for anything else."""
    by_key = COMBINATIONS | {len(names): names for names in COMBINATIONS.values()}
    chosen = by_key.get(bands, [bands]) if isinstance(bands, (str, int)) else list(bands)
    if not set(chosen) <= set(KNOWN_BANDS):
        raise ValueError(f"no bands or combination of bands: {bands!r}")
    return list(chosen)


def select_bands(patch_map, bands):
    """Band arrays of ``MAP<STRING, ARRAY>`` in the order of the combination."""
    return F.array(*[patch_map[b] for b in resolve(bands)])


def standardise(patches: DataFrame, key, patch_map, stats: DataFrame, bands) -> DataFrame:
    """``(x − mean) / std`` per band. ``stats(band, mean, std)`` has one row per band name, so at most 14."""
    names = resolve(bands)
    rows = stats.filter(F.col("band").isin(names)).limit(len(KNOWN_BANDS) + 1).collect()
    value = {r["band"]: (r["mean"], r["std"]) for r in rows}
    if len(value) != len(rows) or set(value) != set(names):
        raise ValueError("stats must hold exactly one row per band")
    scaled = F.array(*[A.standardise(F.col(patch_map)[b], *map(F.lit, value[b])) for b in names])
    return patches.select(key, scaled.alias("bands"))


def nonzero_images(patches: DataFrame, bands) -> DataFrame:
    """Images with at least one non-zero pixel."""
    return patches.filter(F.exists(F.col(bands), A.any_nonzero))


def average_pool(pixels, height, width, stride):
    """Mean over ``stride`` squares of a row-major map; incomplete borders are dropped."""
    rows, cols = height // stride, width // stride

    def cell(i):
        r, c = F.floor(i / cols).cast("int"), (i % cols).cast("int")
        parts = [F.slice(pixels, (r * stride + k) * width + c * stride + 1, stride) for k in range(stride)]
        return A.total(F.concat(*parts)) / (stride * stride)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), cell)


def mean_map(maps: DataFrame, key, pixels) -> DataFrame:
    """Mean of several maps per key and pixel: ``(key, pos, value)``; partial sums combine before the shuffle."""
    each = maps.select(key, F.posexplode(pixels).alias("pos", "x"))
    return each.groupBy(key, "pos").agg(F.avg("x").alias("value"))


def joint_relevance(pairs: DataFrame, key, left, right) -> DataFrame:
    """``R[i, j] = Σ_d A[d, i] · B[d, j]`` over flattened map cells: ``(key, i, j, r)``.

    ``left`` and ``right`` are ``ARRAY<ARRAY<DOUBLE>>`` (dimension, cell) of one image pair; both
    have the model's fixed size, so a row holds them.
    """

    @F.pandas_udf("array<array<double>>")
    def contract(a, b):
        import pandas as pd

        out = [np.stack(x).T @ np.stack(y) for x, y in zip(a, b)]
        return pd.Series([m.tolist() for m in out], dtype=object)

    rows = pairs.select(key, F.posexplode(contract(F.col(left), F.col(right))).alias("i", "row"))
    return rows.select(key, "i", F.posexplode("row").alias("j", "r"))
