"""Writers; every one is a distributed write, no result passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ntriples(triples: DataFrame, path, compression=None):
    """``s p o .`` lines."""
    lines = triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
    options = {"compression": compression} if compression else {}
    lines.write.mode("overwrite").text(path, **options)


def write_triple_table(triples: DataFrame, path):
    """Parquet stored by predicate, so a predicate filter reads its own folders only."""
    triples.write.mode("overwrite").partitionBy("p").parquet(path)


def write_geometry_tsv(rows: DataFrame, path):
    """``WKT\\tEntity`` with header; a missing WKT prints ``null``."""
    quoted = rows.select(F.coalesce("wkt", F.lit("null")).alias("WKT"), F.col("entity").alias("Entity"))
    quoted.write.mode("overwrite").options(sep="\t", header=True, quote="\0", emptyValue="", escapeQuotes=False).csv(path)


def tsv_to_csv(spark, source, target):
    spark.read.options(sep="\t", header=True).csv(source).write.mode("overwrite").options(header=True).csv(target)


def caption_documents(images: DataFrame, per_image=4) -> DataFrame:
    """``(image_id, filename, classcode, captions ARRAY<STRING>)`` → the nested caption layout.

    The captions of an image already share a row, so nothing is grouped.
    """
    first = F.col("image_id") * per_image

    def sentence(raw, i):
        return F.struct(
            F.col("image_id").alias("image_id"),
            (first + i).alias("sentence_id"),
            raw.alias("raw"),
            F.split(raw, " ").alias("tokens"),
        )

    return images.select(
        "filename",
        "classcode",
        F.transform("captions", sentence).alias("sentences"),
        F.transform("captions", lambda c, i: first + i).alias("sentids"),
    )


def write_captions(images: DataFrame, path):
    """One JSON document per image."""
    caption_documents(images).write.mode("overwrite").json(path)


def write_embeddings(df: DataFrame, path):
    """``(id, embedding)`` as float32."""
    df.select("id", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def write_codes(df: DataFrame, path):
    """``(key, code)`` in 0/1 form."""
    df.select("key", F.col("code").cast("array<tinyint>")).write.mode("overwrite").parquet(path)


def write_dialogues(transcripts: DataFrame, path):
    """One folder of JSON documents per dialogue."""
    transcripts.write.mode("overwrite").partitionBy("conv_id").json(path)


def write_results(results: DataFrame, path):
    """Request results; a failed request keeps its row with ``Error`` in both outcome columns."""
    failed = F.col("detected_category").isNull()
    rows = results.select(
        "request",
        "expected_category",
        F.when(failed, "Error").otherwise(F.col("detected_category")).alias("detected_category"),
        F.when(failed, "Error").otherwise(F.col("request_exists").cast("string")).alias("request_exists"),
    )
    rows.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path):
    """Long table ``(metric, direction, k, value)``."""
    metrics.select("metric", "direction", "k", "value").write.mode("overwrite").parquet(path)


def write_patch_lists(df: DataFrame, path, key, chunk=10_000):
    """``{key: [...]}`` documents of up to about ``chunk`` patches per split; ``df(split, patch)``."""
    total = max(1, -(-df.count() // chunk))
    bucket = F.pmod(F.xxhash64("patch"), F.lit(total))
    docs = df.groupBy("split", bucket.alias("part")).agg(F.array_sort(F.collect_list("patch")).alias(key))
    docs.drop("part").write.mode("overwrite").partitionBy("split").json(path)
