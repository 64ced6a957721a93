"""Multi-label sets: histograms, overlap counts, dataset enrichment, object counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the 19 land-cover classes, alphabetical
LAND_COVER_19 = [
    "Agro-forestry areas",
    "Arable land",
    "Beaches, dunes, sands",
    "Broad-leaved forest",
    "Coastal wetlands",
    "Complex cultivation patterns",
    "Coniferous forest",
    "Industrial or commercial units",
    "Inland waters",
    "Inland wetlands",
    "Land principally occupied by agriculture, with significant areas of natural vegetation",
    "Marine waters",
    "Mixed forest",
    "Moors, heathland and sclerophyllous vegetation",
    "Natural grassland and sparsely vegetated areas",
    "Pastures",
    "Permanent crops",
    "Transitional woodland, shrub",
    "Urban fabric",
]


def class_dimension(spark, classes):
    kind = "int" if isinstance(classes[0], int) else "string"
    return spark.createDataFrame([(c,) for c in classes], f"label {kind}")


def histogram(df: DataFrame, labels, classes) -> DataFrame:
    """Rows per class, 0 for classes that do not occur."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    dim = class_dimension(df.sparkSession, classes)
    return dim.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def enrichment_histogram(base: DataFrame, archive: DataFrame, hits: DataFrame, id_col, labels, classes) -> DataFrame:
    """Class histogram of the base and of base plus the distinct retrieved archive rows."""
    added = archive.join(hits.select(id_col).distinct(), id_col, "left_semi")
    both = base.select(labels, F.lit(1).alias("old")).unionByName(added.select(labels, F.lit(0).alias("old")))
    counts = (
        both.select("old", F.explode(labels).alias("label"))
        .groupBy("label")
        .agg(F.sum("old").alias("before"), F.count(F.lit(1)).alias("after"))
    )
    dim = class_dimension(base.sparkSession, classes)
    return dim.join(counts, "label", "left").select(
        "label", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")
    )


def overlap_counts(queries: DataFrame, archive: DataFrame) -> DataFrame:
    """Archive rows sharing at least one label with each query, ``(qid, relevant)``.

    Rows are first counted per distinct label set, so only sets meet, not rows.
    """
    a_sets = archive.groupBy(F.array_sort(F.array_distinct("labels")).alias("a_set")).agg(F.count(F.lit(1)).alias("n"))
    q = queries.select("qid", F.array_sort(F.array_distinct("labels")).alias("q_set"))
    q_sets = q.select("q_set").distinct()
    by_label = a_sets.select("a_set", "n", F.explode("a_set").alias("label"))
    pairs = q_sets.select("q_set", F.explode("q_set").alias("label")).join(by_label, "label")
    # a pair of sets meets once per shared label; keep it under the smallest one
    first = F.col("label") == F.array_min(F.array_intersect("q_set", "a_set"))
    totals = pairs.filter(first).groupBy("q_set").agg(F.sum("n").alias("relevant"))
    return q.join(totals, "q_set").select("qid", "relevant")


def object_counts(images: DataFrame, objects: DataFrame, key) -> DataFrame:
    """Objects per image, 0 for images without any."""
    counts = objects.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return images.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def count_stratum(n, bounds=(1, 15)):
    """Stratum of an object count: 0 below the first bound, 1 below the second, and so on."""
    return reduce(lambda acc, b: acc + (n >= b).cast("int"), bounds, F.lit(0))


def presence(n, limit=142):
    """1 when an image holds an object; a count at or above ``limit`` is an error."""
    return F.when(n < limit, (n > 0).cast("int")).otherwise(F.raise_error(F.concat(F.lit("object count "), n.cast("string"))).cast("int"))
