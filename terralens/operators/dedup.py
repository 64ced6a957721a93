"""Geometry deduplication and dictionary joins over triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rdf


def keep_one_geometry(links: DataFrame, marker="Geometry_gadm") -> DataFrame:
    """The geometry kept per entity: the first without the marker, else the last with it.

    ``links(s, o, ord)`` in file order.
    """
    marked = F.col("o").contains(marker)
    picked = links.groupBy("s").agg(
        F.min_by("o", F.when(~marked, F.col("ord"))).alias("first_plain"),
        F.max_by("o", F.when(marked, F.col("ord"))).alias("last_marked"),
    )
    return picked.select("s", F.coalesce("first_plain", "last_marked").alias("o"))


def duplicate_geometries(links: DataFrame, marker="Geometry_gadm") -> DataFrame:
    """Every ``(s, o, ord)`` row but the kept one; a repeat of the kept geometry counts too."""
    marked = F.col("o").contains(marker)
    kept = links.groupBy("s").agg(
        F.min(F.when(~marked, F.col("ord"))).alias("first_plain"), F.max(F.when(marked, F.col("ord"))).alias("last_marked")
    )
    keep = kept.select("s", F.coalesce("first_plain", "last_marked").alias("keep"))
    return links.join(keep, "s").filter(F.col("ord") != F.col("keep")).drop("keep")


def drop_duplicates(triples: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Triples whose subject and object are both no duplicate geometry. ``duplicates(o)``."""
    gone = duplicates.select("o").distinct()
    return triples.join(gone.select(F.col("o").alias("s")), "s", "left_anti").join(gone, "o", "left_anti").select("s", "p", "o")


def keep_from_dictionary(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Triples whose subject or object is in the dictionary. ``subjects(s)``.

    Two marker joins instead of one OR join, so both stay hash or sort-merge joins.
    """
    names = subjects.select("s").distinct()
    ms = names.withColumn("_ms", F.lit(True))
    mo = names.select(F.col("s").alias("o"), F.lit(True).alias("_mo"))
    marked = triples.join(ms, "s", "left").join(mo, "o", "left")
    return marked.filter(F.col("_ms").isNotNull() | F.col("_mo").isNotNull()).select("s", "p", "o")


def largest_geometry(triples: DataFrame) -> DataFrame:
    """Of several WKT literals of a node keep the one with the largest area, the later one on a tie.

    ``triples(s, p, o, ord)``; all other triples pass through.
    """
    wkt = triples.filter(F.col("p") == rdf.AS_WKT)
    area = G.wkt_area(F.col("o"))
    best = wkt.groupBy("s").agg(F.max_by("o", F.struct(F.coalesce(area, F.lit(0.0)), F.col("ord"))).alias("o"))
    others = triples.filter(F.col("p") != rdf.AS_WKT).select("s", "p", "o")
    return others.unionByName(best.select("s", F.lit(rdf.AS_WKT).alias("p"), "o"))


def last_by_key(df: DataFrame, key, value, order="ord") -> DataFrame:
    """Later rows replace earlier ones of the same key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def entity_wkt(triples: DataFrame) -> DataFrame:
    """``(wkt, entity)`` per geometry node in use; null WKT where the node has none.

    ``triples(s, p, o, ord)``. The last triple wins on repeated keys: for a node both
    the last entity pointing at it and its last WKT.
    """
    links = triples.filter(F.col("p") == rdf.HAS_GEOMETRY).select(F.col("o").alias("node"), F.col("s").alias("entity"), "ord")
    wkts = triples.filter(F.col("p") == rdf.AS_WKT).select(F.col("s").alias("node"), F.col("o").alias("wkt"), "ord")
    owners = last_by_key(links, "node", "entity")
    return owners.join(last_by_key(wkts, "node", "wkt"), "node", "left").select("wkt", "entity")


def name_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Numbered pair results ``(s '<i>', p, o '<j>')`` back to entity names; unknown numbers become ``null`` text.

    ``left(row, entity)`` and ``right(row, entity)`` come from ``numbering``: the left
    file counts from 0, the right one from 1.
    """
    def dictionary(df, col):
        return df.select(F.concat(F.lit("<"), F.col("row").cast("string"), F.lit(">")).alias(col), F.col("entity").alias(f"{col}_name"))

    joined = pairs.join(dictionary(left, "s"), "s", "left").join(dictionary(right, "o"), "o", "left")
    none = F.lit("null")
    return joined.select(F.coalesce("s_name", none).alias("s"), "p", F.coalesce("o_name", none).alias("o"))
