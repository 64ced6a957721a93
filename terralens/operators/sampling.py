"""Splits, samples, orders and caption pairs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import numbering


def stratified_split(df: DataFrame, ids, stratum, fraction=0.33, seed=42, rows_per_bucket=numbering.ROWS_PER_BUCKET) -> DataFrame:
    """``split`` = archive for ``floor(fraction · n)`` rows of each stratum without replacement, query for the rest."""
    placed = numbering.number_by_seed(
        df, ids, seed, name="_place", group=[stratum], start=1, total="_n", rows_per_bucket=rows_per_bucket
    )
    inside = F.col("_place") <= F.floor(F.lit(fraction) * F.col("_n"))
    return placed.withColumn("split", F.when(inside, "archive").otherwise("query")).drop("_place", "_n")


def sample_groups(df: DataFrame, index, n, m, seed=42) -> DataFrame:
    """n of every m rows that follow each other in the order of ``index``; ``list_no`` 0…n−1 tells the n lists apart.

    Groups count rows, not index values, so gaps in the index change nothing. The last group is not used if it is
    short. A group has at most m rows.
    """
    keyed = numbering.number_by_id(df, index, name="_row").withColumn("_g", F.floor(F.col("_row") / m))
    order = Window.partitionBy("_g").orderBy(numbering.seeded_key(seed, index), index)
    picked = keyed.withColumn("list_no", F.row_number().over(order) - 1)
    picked = picked.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("_g")))
    return picked.filter((F.col("_m") == m) & (F.col("list_no") < n)).drop("_g", "_m", "_row")


def shuffled(df: DataFrame, ids, seed=42, name="place") -> DataFrame:
    """Seeded shuffle as a column; ordering by the id restores the original order."""
    return numbering.number_by_seed(df, ids, seed, name=name)


def first_sorted(df: DataFrame, column, limit=None) -> DataFrame:
    """Rows sorted by ``column``, cut at ``limit``; None or −1 means all."""
    ordered = df.orderBy(column)
    return ordered if limit in (None, -1) else ordered.limit(limit)


def keep_listed(df: DataFrame, listed: DataFrame, key) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_anti")


def assign_splits(images: DataFrame, train: DataFrame, query: DataFrame, archive: DataFrame, key, excluded=()) -> DataFrame:
    """``(key, split)`` from three lists; ``excluded`` query entries are left out. An image may be in several splits."""
    query = query.filter(~F.col(key).isin(*excluded)) if excluded else query
    lists = [(train, "train"), (query, "query"), (archive, "archive")]
    marked = None
    for listed, name in lists:
        part = listed.select(key, F.lit(name).alias("split"))
        marked = part if marked is None else marked.unionByName(part)
    return images.select(key).join(marked.distinct(), key)


def with_objects(images: DataFrame, annotations: DataFrame, key) -> DataFrame:
    """Images with their annotations; an image without an entry is an error."""
    joined = images.join(annotations.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no annotation for "), F.col(key).cast("string")))
    return joined.filter(F.when(F.col("_there"), True).otherwise(missing.cast("boolean"))).drop("_there")


def remainder(all_rows: DataFrame, taken: DataFrame, key) -> DataFrame:
    """Rows not taken: a stratum without its sample."""
    return all_rows.join(taken.select(key), key, "left_anti")


def image_captions(captions: DataFrame, m=4, n=None, seed=42) -> DataFrame:
    """Image–caption pairs: all m captions, or n sampled ones. ``captions(image_id, sentence_id, …)``."""
    return captions if n is None else sample_groups(captions, "sentence_id", n, m, seed)


def caption_positions(images: DataFrame, index="idx", m=4) -> DataFrame:
    """Image index → the positions ``idx·m + i`` of its captions."""
    spots = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.col(index) * m + i)
    return images.withColumn("sentence_id", F.explode(spots))


def caption_triplets(images: DataFrame, captions="captions", m=4) -> DataFrame:
    """Image with every 2-combination of its m captions, taken inside the row."""
    pairs = [
        F.struct(F.lit(i).alias("pos1"), F.lit(j).alias("pos2"), F.get(captions, i).alias("first"), F.get(captions, j).alias("second"))
        for i, j in itertools.combinations(range(m), 2)
    ]
    kept = F.filter(F.array(*pairs), lambda p: p["second"].isNotNull())
    return images.select("image_id", F.inline(kept))


def two_captions(captions: DataFrame, m=4, seed=42) -> DataFrame:
    """Image with two sampled captions: ``(image_id, first, second)``."""
    picked = sample_groups(captions, "sentence_id", 2, m, seed)
    return picked.groupBy("image_id").agg(
        F.max(F.when(F.col("list_no") == 0, F.col("text"))).alias("first"),
        F.max(F.when(F.col("list_no") == 1, F.col("text"))).alias("second"),
    )


def quadruplets(images: DataFrame, augmented_images: DataFrame, captions: DataFrame, augmented_captions: DataFrame) -> DataFrame:
    """Image, augmented image, caption, augmented caption, matched by ids.

    The few captions of an image meet by image and are matched there: tables that already lie by image are not moved again.
    """
    other = augmented_captions.withColumnRenamed("sentence_id", "_other")
    # no equation, which would ask for tables laid out by both ids
    met = captions.join(other, "image_id").where("sentence_id >= _other AND sentence_id <= _other").drop("_other")
    return met.join(images, "image_id").join(augmented_images, "image_id")
