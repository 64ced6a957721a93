"""Entity documents → triples and triples → wide tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rdf
from ..session import scratch_dir

TEXT, INTEGER, DOUBLE, DATETIME = None, rdf.XSD + "integer", rdf.XSD + "double", rdf.XSD + "dateTime"

#: Predicates a task writes without sorting, and bytes of a row group of each.
OPEN_FILES, ROW_GROUP = 64, 8 << 20

# fixed values: property key, predicate, datatype, replace double quotes
PROPERTY_MAP = {
    "sentinel1": [
        ("platformShortName", "hasPlatform", TEXT, False),
        ("productType", "hasProductType", TEXT, False),
        ("datetime", "hasTimestamp", DATETIME, False),
        ("polarisationChannels", "hasPolarisationChannels", TEXT, False),
        ("origin", "hasOrigin", TEXT, False),
        ("authority", "hasAuthority", TEXT, False),
        ("timeliness", "hasTimeliness", TEXT, False),
        ("orbitNumber", "hasOrbitNumber", INTEGER, False),
        ("sliceNumber", "hasSliceNumber", INTEGER, False),
        ("processingLevel", "hasProcessingLevel", TEXT, False),
        ("operationalMode", "operationalMode", TEXT, False),
        ("orbitDirection", "orbitDirection", TEXT, False),
    ],
    "sentinel2": [
        ("platform", "hasPlatform", TEXT, False),
        ("s2:product_type", "hasProductType", TEXT, False),
        ("datetime", "hasTimestamp", DATETIME, False),
        ("eo:cloud_cover", "hasCloudCover", DOUBLE, False),
        ("s2:medium_proba_clouds_percentage", "hasMediumProbaCloudsPercentage", DOUBLE, False),
        ("s2:not_vegetated_percentage", "hasNotVegetatedPercentage", DOUBLE, False),
        ("s2:high_proba_clouds_percentage", "hasHighProbaCloudsPercentage", DOUBLE, False),
        ("constellation", "inConstellation", TEXT, False),
        ("s2:thin_cirrus_percentage", "hasThinCirrusPercentage", DOUBLE, False),
        ("s2:snow_ice_percentage", "hasSnowIcePercentage", DOUBLE, False),
        ("s2:vegetation_percentage", "hasVegetationPercentage", DOUBLE, False),
        ("s2:unclassified_percentage", "hasUnclassifiedPercentage", DOUBLE, False),
        ("view:sun_azimuth", "hasSunAzimuth", DOUBLE, False),
        ("s2:water_percentage", "hasWaterPercentage", DOUBLE, False),
    ],
    "poi": [
        ("addr:city", "isInCity", TEXT, True),
        ("site", "typeOfSite", TEXT, True),
        ("tourism", "typeOfTourism", TEXT, True),
    ],
    "port": [
        ("amenity", "hasAmenity", TEXT, True),
        ("harbour", "isHarbour", TEXT, False),
        ("seamark:harbour:category", "hasHarbourCategory", TEXT, True),
        ("seamark:type", "hasSeamarkType", TEXT, True),
        ("source", "hasSource", TEXT, False),
    ],
    "river": [
        ("destination", "hasDestination", TEXT, False),
        ("waterway", "waterwayType", TEXT, False),
    ],
    "sea": [
        ("MRGID", "hasMRGID", INTEGER, False),
        ("area", "hasArea", DOUBLE, False),
    ],
}
# fixed values: classes with names in four languages, and whether their names are sanitised
NAMED = {"poi": True, "port": True, "river": False}
WIKI_LINKED = {"poi", "river"}
NAME_KEYS = [("name", None), ("name:en", "en"), ("name:de", "de"), ("name:fr", "fr")]
# fixed values: link relation → predicate
LINK_PREDICATES = {"thumbnail": "hasThumbnail", "derived_from": "derivedFrom", "license": "hasLicense"}


def _po(predicate, term):
    return F.struct(F.lit(predicate).alias("p"), term.alias("o"))


def subject(cls, vocab, key=None):
    local = F.col("id") if key is None else key
    return rdf.iri(vocab.resource + ("sea_" if cls == "sea" else ""), local)


def type_pair(cls, vocab):
    return _po(rdf.RDF_TYPE, F.lit(f"<{vocab.ontology}{cls}>"))


def property_pairs(cls, vocab):
    """(p, o) for every mapped property key; o is null where the key is absent."""
    pairs = []
    for key, predicate, datatype, clean in PROPERTY_MAP[cls]:
        value = F.col("properties")[key]
        pairs.append(_po(f"<{vocab.ontology}{predicate}>", rdf.literal(rdf.single_quotes(value) if clean else value, datatype)))
    return pairs


def name_pairs(cls, vocab):
    predicate = f"<{vocab.names}hasGADM_Name>"
    if cls == "sea":
        return [_po(predicate, rdf.literal(F.col("properties")["NAME"]))]
    if cls not in NAMED:
        return []
    value = {k: F.col("properties")[k] for k, _ in NAME_KEYS}
    return [
        _po(predicate, rdf.literal(rdf.single_quotes(value[k]) if NAMED[cls] else value[k], lang=lang))
        for k, lang in NAME_KEYS
    ]


def wiki_pairs(cls, vocab):
    if cls not in WIKI_LINKED:
        return []
    return [_po(f"<{vocab.ontology}wikilink>", rdf.iri(vocab.wiki, F.col("properties")["wikidata"]))]


def thumbnail_pairs(vocab):
    """Null-guarded ``assets.QUICKLOOK.href``."""
    return [_po(f"<{vocab.ontology}hasThumbnail>", rdf.literal(F.col("assets")["QUICKLOOK"]["href"]))]


def link_pairs(vocab):
    """(p, o) array of the ``links`` whose relation has a predicate."""
    known = F.filter("links", lambda l: l["rel"].isin(*LINK_PREDICATES) & l["href"].isNotNull())
    names = F.create_map(*[F.lit(x) for r, p in LINK_PREDICATES.items() for x in (r, f"<{vocab.ontology}{p}>")])
    return F.transform(
        known, lambda l: F.struct(names[l["rel"]].alias("p"), rdf.literal(l["href"]).alias("o"))
    )


def geometry_node(cls, vocab):
    return rdf.iri(f"{vocab.resource}Geometry_{cls}_", F.col("id"))


def geometry_triples(df: DataFrame, cls, vocab=rdf.Vocabulary()) -> DataFrame:
    """``entity hasGeometry node`` and ``node asWKT literal`` for rows with a ``wkt``."""
    node = geometry_node(cls, vocab)
    both = F.array(
        F.struct(subject(cls, vocab).alias("s"), F.lit(rdf.HAS_GEOMETRY).alias("p"), node.alias("o")),
        F.struct(node.alias("s"), F.lit(rdf.AS_WKT).alias("p"), rdf.wkt_literal(F.col("wkt")).alias("o")),
    )
    return df.filter(F.col("wkt").isNotNull()).select(F.inline(both))


def entity_triples(df: DataFrame, cls, vocab=rdf.Vocabulary()) -> DataFrame:
    """All triples of one entity class in a single generator over the rows.

    Expects ``id``, ``properties MAP<STRING,STRING>``, ``wkt``, and for products
    ``assets`` (sentinel1) or ``links`` (sentinel2). Absent values give no triple.
    """
    pairs = [type_pair(cls, vocab), *property_pairs(cls, vocab), *name_pairs(cls, vocab), *wiki_pairs(cls, vocab)]
    if cls == "sentinel1":
        pairs += thumbnail_pairs(vocab)
    has_wkt = F.col("wkt").isNotNull()
    pairs.append(_po(rdf.HAS_GEOMETRY, F.when(has_wkt, geometry_node(cls, vocab))))
    pairs.append(_po(rdf.AS_WKT, F.when(has_wkt, rdf.wkt_literal(F.col("wkt")))))
    po = F.array(*pairs)
    if cls == "sentinel2":
        po = F.concat(po, F.coalesce(link_pairs(vocab), F.array().cast("array<struct<p:string,o:string>>")))
    # a plain array stays in generated code; absent values are dropped right after it
    each = df.select(subject(cls, vocab).alias("s"), geometry_node(cls, vocab).alias("_node"), F.inline(po))
    of_node = F.when(F.col("p") == rdf.AS_WKT, F.col("_node")).otherwise(F.col("s"))
    return each.filter(F.col("o").isNotNull()).select(of_node.alias("s"), "p", "o")


def row_triples(df: DataFrame, cls, key, literals, relations=(), vocab=rdf.Vocabulary()) -> DataFrame:
    """Triples of a relational table: ``literals (column, predicate, datatype)``, ``relations (column, predicate, class)``."""
    pairs = [type_pair(cls, vocab)]
    pairs += [_po(f"<{vocab.ontology}{p}>", rdf.literal(c if not isinstance(c, str) else F.col(c), t)) for c, p, t in literals]
    pairs += [_po(f"<{vocab.ontology}{p}>", rdf.iri(f"{vocab.resource}{target}/", F.col(c))) for c, p, target in relations]
    me = rdf.iri(f"{vocab.resource}{cls}/", F.col(key))
    return df.select(me.alias("s"), F.inline(F.array(*pairs))).filter(F.col("o").isNotNull())


def graph(frames, distinct=False) -> DataFrame:
    """Union of entity graphs, optionally as a set."""
    out = reduce(lambda a, b: a.unionByName(b), [f.select("s", "p", "o") for f in frames])
    return out.distinct() if distinct else out


def with_predicate(triples: DataFrame, *predicates) -> DataFrame:
    """Triples of the given predicates; prunes partitions where the table is stored by ``p``."""
    return triples.filter(F.col("p").isin(*predicates))


def stored(triples: DataFrame, name="graph", open_files=OPEN_FILES) -> DataFrame:
    """The graph written once to the shared folder, a partition for each predicate: a constant predicate reads only its own."""
    spark = triples.sparkSession
    path = scratch_dir(spark, name)
    # a file stays open for each predicate, so that no task sorts its triples; 0 sorts them, for graphs of many predicates
    option, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    spark.conf.set(option, str(open_files))
    try:
        writer = triples.select("s", "p", "o").write.partitionBy("p")
        (writer.option("parquet.block.size", ROW_GROUP) if open_files else writer).parquet(path)
    finally:
        spark.conf.set(option, before)
    return spark.read.schema("s string, o string, p string").parquet(path).select("s", "p", "o")


def statistics(triples: DataFrame) -> dict:
    """Triples of each predicate as a dictionary; a graph has as many predicates as its vocabulary, whatever its size."""
    return {r["p"]: r["n"] for r in predicate_counts(triples).collect()}


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def wide(triples: DataFrame, columns) -> DataFrame:
    """One row per subject: ``columns`` maps a name to ``(predicate, spark type)``.

    One conditional aggregate per column, so a single shuffle by subject with
    map-side combine; the smallest term wins where a predicate repeats.
    """
    known = triples.filter(F.col("p").isin(*[p for p, _ in columns.values()]))
    terms = known.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, (p, _) in columns.items()])
    return terms.select(
        "s", *[(F.col(n) if t == "iri" else rdf.typed_value(F.col(n), t)).alias(n) for n, (_, t) in columns.items()]
    )
