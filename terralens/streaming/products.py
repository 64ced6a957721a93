"""Graph construction over a growing product tree: the batch job of ``triples`` on new files only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rdf
from ..operators import triples as T
from ..sources.readers import PRODUCT


def stream_product_triples(spark, root, cls, target, checkpoint, vocab=rdf.Vocabulary()):
    """Write the triples of product files not seen before to the parquet folder ``target`` and stop.

    Stateless, so nothing grows with the stream; the checkpoint folder remembers the files.
    """
    reader = spark.readStream.schema(PRODUCT).option("multiLine", True)
    docs = reader.json(f"{root}/*/*/*/*").filter(F.col("id").isNotNull())
    placed = docs.withColumn("wkt", G.geojson_to_wkt(F.col("geometry")))
    writer = T.entity_triples(placed, cls, vocab).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
