"""Exact row numbers without a single-task window.

A plain ``row_number`` over a whole table, or over one group that holds a
third of it, sorts everything in one task. Here rows first fall into buckets
whose order agrees with the wanted order; numbers are taken inside a bucket
and shifted by the number of rows in the buckets before it. Only the bucket
sizes, never the rows, meet in one window.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 100_000


def seeded_key(seed, *ids):
    """md5 of ``seed:id[:id…]``: a repeatable random order, equal on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def unit_interval(key):
    """First 32 bits of an md5 hex string as a DOUBLE in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bucket_count(df, rows_per_bucket=ROWS_PER_BUCKET):
    return max(1, math.ceil(df.count() / rows_per_bucket))


def _only_bucket(column):
    """0 for every row, yet a column: joins and windows on a literal lose their key."""
    return F.pmod(F.xxhash64(column), F.lit(1)).cast("int")


def range_bucket(df: DataFrame, column, buckets, name="_bucket") -> DataFrame:
    """Add a bucket number that grows with a numeric column, buckets of similar size."""
    if buckets <= 1:
        return df.withColumn(name, _only_bucket(column))
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(column, probabilities, 0.25 / buckets)))
    if not cuts:
        return df.withColumn(name, _only_bucket(column))
    splits = [-math.inf, *cuts, math.inf]
    keyed = df.withColumn("_cut", F.col(column).cast("double"))
    model = Bucketizer(splits=splits, inputCol="_cut", outputCol=name)
    return model.transform(keyed).drop("_cut").withColumn(name, F.col(name).cast("int"))


def number_in_buckets(df, bucket, order, name="row", group=(), start=0, total=None) -> DataFrame:
    """Number rows by ``(bucket, order)`` inside ``group``; ``bucket`` names existing columns."""
    group, bucket = list(group), list(bucket)
    # text keys without nulls, so window and join share one hash partitioning
    named = {g: f"_g_{g}" for g in group}
    keyed = df.withColumns({k: F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g, k in named.items()}) if group else df
    keys = list(named.values()) + bucket
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    of_group = Window.partitionBy(*named.values())
    before = of_group.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_size").over(of_group))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = keyed.withColumn("_local", local).join(sizes.drop("_size"), keys)
    return joined.withColumn(name, F.col("_before") + F.col("_local") + F.lit(start - 1)).drop(
        "_before", "_local", *keys
    )


def number_by_id(df, id_col, name="row", start=0, rows_per_bucket=ROWS_PER_BUCKET) -> DataFrame:
    """0-based (or ``start``-based) position of each row in ascending numeric id order."""
    parts = range_bucket(df, id_col, bucket_count(df, rows_per_bucket))
    return number_in_buckets(parts, ["_bucket"], [id_col], name=name, start=start)


def number_by_seed(
    df, ids, seed, name="row", group=(), start=0, total=None, rows_per_bucket=ROWS_PER_BUCKET
) -> DataFrame:
    """Position of each row of a group in a seeded random order."""
    buckets = bucket_count(df, rows_per_bucket)
    keyed = df.withColumn("_seeded", seeded_key(seed, *ids)).withColumn(
        "_bucket", F.floor(unit_interval(F.col("_seeded")) * buckets).cast("int")
    )
    return number_in_buckets(
        keyed, ["_bucket"], ["_seeded", *ids], name=name, group=group, start=start, total=total
    ).drop("_seeded")


def number_lines(df, name="row", start=0) -> DataFrame:
    """Number the lines read by ``sources.readers.text_lines`` in file order.

    File splits are the buckets, so no line moves further than its split.
    """
    return number_in_buckets(df, ["file_path", "file_block"], ["line_no"], name=name, start=start)


def every_nth(df, id_col, n, offset=0) -> DataFrame:
    """Every n-th row in id order (undo an n-fold replication)."""
    return number_by_id(df, id_col, name="_row").filter(F.col("_row") % n == offset).drop("_row")


def blocks_of(df, id_col, size, name="block") -> DataFrame:
    """Consecutive blocks of ``size`` rows in id order."""
    numbered = number_by_id(df, id_col, name="_row")
    return numbered.withColumn(name, F.floor(F.col("_row") / size)).drop("_row")
