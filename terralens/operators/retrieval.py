"""Retrieval quality: multi-label precision and recall, mAP, precision by radius and at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def multilabel_scores(hits: DataFrame, query_labels: DataFrame, archive_labels: DataFrame) -> DataFrame:
    """Mean precision and recall over the k hits, then over queries, and the F1 of the means.

    ``hits(qid, aid)``, ``query_labels(qid, q_labels)``, ``archive_labels(aid, a_labels)``.
    """
    pairs = hits.join(archive_labels, "aid").join(query_labels, "qid")
    overlap = F.size(F.array_intersect("q_labels", "a_labels")).cast("double")
    per_query = pairs.groupBy("qid").agg(
        F.avg(overlap / F.size("a_labels")).alias("p"), F.avg(overlap / F.size("q_labels")).alias("r")
    )
    means = per_query.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"))
    f1 = F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return means.withColumn("f1", f1)


def relevant_ranks(profile: DataFrame) -> DataFrame:
    """Rank and running number of every kept relevant row: ``(grp, qid, rank, nth)``."""
    before = (
        Window.partitionBy("grp", "qid").orderBy("dist", "ab").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = profile.withColumn("_all", F.coalesce(F.sum("n_all").over(before), F.lit(0))).withColumn(
        "_rel", F.coalesce(F.sum("n_rel").over(before), F.lit(0))
    )
    return placed.select("grp", "qid", "_all", "_rel", F.posexplode("rel_pos").alias("i", "place")).select(
        "grp",
        "qid",
        (F.col("_all") + F.col("place")).alias("rank"),
        (F.col("_rel") + F.col("i") + 1).alias("nth"),
    )


def mean_average_precision(profile: DataFrame, k, depth_k=False) -> DataFrame:
    """mAP per group. ``k`` caps the relevant rows counted; ``depth_k`` caps the rank depth instead.

    Queries without a relevant row count as 0. ``k=None`` takes every relevant row.
    """
    ranks = relevant_ranks(profile)
    if k is not None:
        ranks = ranks.filter((F.col("rank") if depth_k else F.col("nth")) <= k)
    ap = ranks.groupBy("grp", "qid").agg(F.avg(F.col("nth") / F.col("rank")).alias("ap"))
    queries = profile.select("grp", "qid").distinct()
    scored = queries.join(ap, ["grp", "qid"], "left")
    return scored.groupBy("grp").agg(
        F.avg(F.coalesce("ap", F.lit(0.0))).alias("map"), F.count(F.lit(1)).alias("n_queries")
    )


def radius_curve(profile: DataFrame, bits) -> DataFrame:
    """Mean precision and recall over queries at every Hamming radius 0…bits.

    An empty ball gives precision 0, as does a query without relevant rows.
    """
    classes = profile.groupBy("grp", "qid", "dist").agg(
        F.sum("n_all").alias("n_all"), F.sum("n_rel").alias("n_rel")
    )
    # one row per query with the two cumulative count arrays over the full radius grid
    per_query = classes.groupBy("grp", "qid").agg(
        F.map_from_entries(F.collect_list(F.struct("dist", "n_all"))).alias("all_at"),
        F.map_from_entries(F.collect_list(F.struct("dist", "n_rel"))).alias("rel_at"),
        F.sum("n_rel").alias("relevant"),
    )
    grid = F.sequence(F.lit(0), F.lit(bits))

    def running(counts):
        return F.aggregate(
            grid,
            F.array().cast("array<bigint>"),
            lambda acc, r: F.array_append(
                acc,
                F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.coalesce(counts[r], F.lit(0)),
            ),
        )

    zipped = F.arrays_zip(grid.alias("radius"), running(F.col("all_at")).alias("inside"), running(F.col("rel_at")).alias("hits"))
    points = per_query.select("grp", "relevant", F.explode(zipped).alias("z")).select(
        "grp",
        "relevant",
        F.col("z.radius").alias("radius"),
        F.col("z.inside").alias("inside"),
        F.col("z.hits").alias("hits"),
    )
    return points.groupBy("grp", "radius").agg(
        F.avg(F.coalesce(F.try_divide("hits", "inside"), F.lit(0.0))).alias("precision"),
        F.avg(F.coalesce(F.try_divide("hits", "relevant"), F.lit(0.0))).alias("recall"),
    )


def precision_at(profile: DataFrame, depths) -> DataFrame:
    """Precision among the first k ranks for each k, k capped by the archive size.

    Needs a profile whose ``keep`` is at least ``max(depths)``.
    """
    sizes = profile.groupBy("grp", "qid").agg(F.sum("n_all").alias("archive"))
    ks = F.explode(F.array(*[F.lit(k) for k in depths])).alias("k")
    wanted = sizes.select("grp", "qid", "archive", ks)
    hits = relevant_ranks(profile).filter(F.col("rank") <= max(depths))
    counted = hits.groupBy("grp", "qid").agg(
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in depths]
    )
    joined = wanted.join(counted, ["grp", "qid"], "left")
    at_k = F.create_map(*[e for k in depths for e in (F.lit(k), F.col(f"h{k}"))])[F.col("k")]
    value = F.coalesce(at_k, F.lit(0)) / F.least(F.col("k"), F.col("archive"))
    return joined.groupBy("grp", "k").agg(F.avg(value).alias("precision"))
