"""Knowledge-graph construction, clean-up and pattern queries on the star schema and on derived catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rdf
from ..operators import dedup as D
from ..operators import numbering as N
from ..operators import patterns as P
from ..operators import triples as T
from ..operators.spatial import river_wkt
from .common import Catalogue, rounded, table

CAT = Catalogue()
VOC = rdf.Vocabulary("r/", "o/", "n/", "w/")
XSD = rdf.XSD
DOUBLE, INTEGER, DATETIME = XSD + "double", XSD + "integer", XSD + "dateTime"
ISO = "yyyy-MM-dd'T'HH:mm:ss"

# table, class, key, [(column, predicate, datatype)], [(column, predicate, class)]
STAR = [
    ("region", "region", "r_regionkey", [("r_name", "name", None)], []),
    ("nation", "nation", "n_nationkey", [("n_name", "name", None)], [("n_regionkey", "inRegion", "region")]),
    (
        "customer",
        "customer",
        "c_custkey",
        [("c_name", "name", None), ("c_acctbal", "balance", DOUBLE), ("c_mktsegment", "segment", None)],
        [("c_nationkey", "inNation", "nation")],
    ),
    (
        "supplier",
        "supplier",
        "s_suppkey",
        [("s_name", "name", None), ("s_acctbal", "balance", DOUBLE)],
        [("s_nationkey", "inNation", "nation")],
    ),
    (
        "orders",
        "order",
        "o_orderkey",
        [("o_orderstatus", "status", None), ("o_totalprice", "price", DOUBLE), ("o_orderpriority", "priority", None)],
        [("o_custkey", "orderedBy", "customer")],
    ),
]


def star(spark, sf, only=None):
    return T.graph(
        [T.row_triples(table(spark, sf, name), cls, key, literals, relations, VOC) for name, cls, key, literals, relations in STAR if only is None or name in only]
    )


def kept(spark, sf, name, build, open_files=0):
    """(graph, counts): the graph of the tables in a folder, stored by predicate by the first query of the application
    that asks for it, with the triples of each predicate."""
    context = spark.sparkContext
    if not hasattr(context, "terralens_graphs"):
        context.terralens_graphs = {}
    if (name, sf) not in context.terralens_graphs:
        graph = T.stored(build(spark, sf), name, open_files)
        context.terralens_graphs[name, sf] = graph, T.statistics(graph)
    return context.terralens_graphs[name, sf]


def star_store(spark, sf):
    return kept(spark, sf, "star", star, T.OPEN_FILES)


def star_sql():
    parts = []
    for name, cls, key, literals, relations in STAR:
        s = f"'<r/{cls}/' || {key} || '>'"
        parts.append(f"SELECT {s} AS s, '{rdf.RDF_TYPE}' AS p, '<o/{cls}>' AS o FROM {name}")
        for c, p, t in literals:
            tail = f"^^<{t}>" if t else ""
            parts.append(f"SELECT {s}, '<o/{p}>', '\"' || {c} || '\"{tail}' FROM {name} WHERE {c} IS NOT NULL")
        for c, p, target in relations:
            parts.append(f"SELECT {s}, '<o/{p}>', '<r/{target}/' || {c} || '>' FROM {name} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


QN = "WITH t AS (" + star_sql() + ") "


def mapping(**items):
    return F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("key"), v.cast("string").alias("value")) for k, v in items.items()]),
            lambda e: e["value"].isNotNull(),
        )
    )


def xy(key):
    return (F.col(key) * 37) % 360 - 180, (F.col(key) * 17) % 180 - 90


def point_wkt(key):
    x, y = xy(key)
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


SQL_POINT = "'POINT (' || (({k} * 37) % 360 - 180) || ' ' || (({k} * 17) % 180 - 90) || ')'"


def river_geojson(x):
    """A river's document: two lines that meet, the second told backwards, and a lone point."""
    return F.concat(
        F.lit('{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[['), x,
        F.lit(',50],[60,51]]},{"type":"LineString","coordinates":[[70,53],[60,51]]},{"type":"Point","coordinates":[80,1]}]}'),
    )


def entities(spark, sf, cls):
    """Catalogue documents of one class, derived from the tables."""
    if cls == "sentinel1":
        o = table(spark, sf, "orders")
        href = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("http://q/"), F.col("o_orderkey").cast("string")))
        return o.select(
            F.concat(F.lit("s1_"), F.col("o_orderkey").cast("string")).alias("id"),
            mapping(
                platformShortName=F.lit("SENTINEL-1"),
                productType=F.col("o_orderpriority"),
                datetime=F.date_format("o_orderdate", ISO),
                orbitNumber=F.col("o_custkey"),
                orbitDirection=F.when(F.col("o_orderstatus") == "F", F.lit("ASCENDING")),
            ).alias("properties"),
            F.create_map(F.lit("QUICKLOOK"), F.struct(href.alias("href"))).alias("assets"),
            G.geojson_to_wkt(
                F.format_string('{"type":"Polygon","coordinates":[[[%1$s,0],[%1$s,5],[200,5],[%1$s,0]]]}', (F.col("o_orderkey") % 100).cast("string"))
            ).alias("wkt"),
        )
    if cls == "sentinel2":
        e = table(spark, sf, "events")
        name = F.col("event_id").cast("string")
        links = F.array(
            F.struct(F.lit("thumbnail").alias("rel"), F.concat(F.lit("http://t/"), name).alias("href")),
            F.struct(
                F.when(F.col("event_id") % 2 == 0, F.lit("derived_from")).otherwise(F.lit("self")).alias("rel"),
                F.concat(F.lit("http://d/"), name).alias("href"),
            ),
            F.struct(F.lit("license").alias("rel"), F.when(F.col("event_id") % 5 == 0, F.lit("http://l/")).alias("href")),
        )
        return e.select(
            F.concat(F.lit("s2_"), name).alias("id"),
            mapping(
                platform=F.when(F.col("user_id") % 2 == 0, F.lit("sentinel-2a")).otherwise(F.lit("sentinel-2b")),
                s2__product_type=F.when(F.col("event_type") == "error", F.lit("S2MSI1C")).otherwise(F.lit("S2MSI2A")),
                datetime=F.date_format("ts", ISO),
                eo__cloud_cover=F.get_json_object("props", "$.k"),
                s2__snow_ice_percentage=F.col("event_id") % 101,
            ).alias("properties"),
            links.alias("links"),
            F.when(F.col("event_id") % 4 != 0, point_wkt("event_id")).alias("wkt"),
        )
    if cls == "poi":
        return table(spark, sf, "customer").select(
            F.concat(F.lit("poi_"), F.col("c_custkey").cast("string")).alias("id"),
            mapping(
                name=F.concat(F.lit('The "'), F.col("c_name"), F.lit('"')),
                name__en=F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")),
                name__de=F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Der "), F.col("c_name"))),
                name__fr=F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Le "), F.col("c_name"))),
                addr__city=F.when(F.col("c_nationkey") > 4, F.concat(F.lit("City "), F.col("c_nationkey").cast("string"))),
                tourism=F.lower("c_mktsegment"),
                wikidata=F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Q"), F.col("c_custkey").cast("string"))),
            ).alias("properties"),
            point_wkt("c_custkey").alias("wkt"),
        )
    if cls == "port":
        return table(spark, sf, "supplier").select(
            F.concat(F.lit("port_"), F.col("s_suppkey").cast("string")).alias("id"),
            mapping(
                name=F.col("s_name"),
                harbour=F.lit("yes"),
                seamark__type=F.when(F.col("s_suppkey") % 2 == 0, F.lit('"harbour"')),
                source=F.lit('a "survey"'),
            ).alias("properties"),
            point_wkt("s_suppkey").alias("wkt"),
        )
    if cls == "river":
        return table(spark, sf, "nation").select(
            F.concat(F.lit("river_"), F.col("n_nationkey").cast("string")).alias("id"),
            mapping(
                name=F.col("n_name"),
                waterway=F.lit("river"),
                wikidata=F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"))),
            ).alias("properties"),
            river_wkt(river_geojson(F.col("n_nationkey").cast("string"))).alias("wkt"),
        )
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("id"),
        mapping(MRGID=F.col("r_regionkey") + 1000, area=F.col("r_regionkey") * 7, NAME=F.col("r_name")).alias("properties"),
        point_wkt("r_regionkey").alias("wkt"),
    )


CLASSES = ("sentinel1", "sentinel2", "poi", "port", "river", "sea")
_ID = {
    "sentinel1": ("orders", "'s1_' || o_orderkey", ("o_orderkey", "true")),
    "sentinel2": ("events", "'s2_' || event_id", ("event_id", "event_id % 4 <> 0")),
    "poi": ("customer", "'poi_' || c_custkey", ("c_custkey", "true")),
    "port": ("supplier", "'port_' || s_suppkey", ("s_suppkey", "true")),
    "river": ("nation", "'river_' || n_nationkey", ("n_nationkey", "true")),
    "sea": ("region", "r_regionkey", ("r_regionkey", "true")),
}
_WKT = {
    "sentinel1": "'POLYGON ((' || ({k} % 100) || ' 0, ' || ({k} % 100) || ' 5, 200 5, ' || ({k} % 100) || ' 0))'",
    "river": "'MULTIPOLYGON (((' || {k} || ' 50, 60 51, 70 53, 70 53, 60 51, ' || {k} || ' 50, ' || {k} || ' 50)))'",
}
_Q = "'\"'"
# predicate, SQL term per class
_TERMS = {
    "sentinel1": [
        ("<o/hasPlatform>", "'\"SENTINEL-1\"'", "true"),
        ("<o/hasProductType>", "'\"' || o_orderpriority || '\"'", "true"),
        ("<o/hasTimestamp>", f"'\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '\"^^<{DATETIME}>'", "true"),
        ("<o/hasOrbitNumber>", f"'\"' || o_custkey || '\"^^<{INTEGER}>'", "true"),
        ("<o/orbitDirection>", "'\"ASCENDING\"'", "o_orderstatus = 'F'"),
        ("<o/hasThumbnail>", "'\"http://q/' || o_orderkey || '\"'", "o_orderkey % 3 <> 0"),
    ],
    "sentinel2": [
        ("<o/hasPlatform>", "CASE WHEN user_id % 2 = 0 THEN '\"sentinel-2a\"' ELSE '\"sentinel-2b\"' END", "true"),
        ("<o/hasProductType>", "CASE WHEN event_type = 'error' THEN '\"S2MSI1C\"' ELSE '\"S2MSI2A\"' END", "true"),
        ("<o/hasTimestamp>", f"'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\"^^<{DATETIME}>'", "true"),
        ("<o/hasCloudCover>", f"'\"' || json_extract_string(props, '$.k') || '\"^^<{DOUBLE}>'", "true"),
        ("<o/hasSnowIcePercentage>", f"'\"' || (event_id % 101) || '\"^^<{DOUBLE}>'", "true"),
        ("<o/hasThumbnail>", "'\"http://t/' || event_id || '\"'", "true"),
        ("<o/derivedFrom>", "'\"http://d/' || event_id || '\"'", "event_id % 2 = 0"),
        ("<o/hasLicense>", "'\"http://l/\"'", "event_id % 5 = 0"),
    ],
    "poi": [
        ("<n/hasGADM_Name>", "'\"The ''' || c_name || '''\"'", "true"),
        ("<n/hasGADM_Name>", "'\"' || c_name || '\"@en'", "c_custkey % 2 = 0"),
        ("<n/hasGADM_Name>", "'\"Der ' || c_name || '\"@de'", "c_custkey % 3 = 0"),
        ("<n/hasGADM_Name>", "'\"Le ' || c_name || '\"@fr'", "c_custkey % 5 = 0"),
        ("<o/isInCity>", "'\"City ' || c_nationkey || '\"'", "c_nationkey > 4"),
        ("<o/typeOfTourism>", "'\"' || lower(c_mktsegment) || '\"'", "true"),
        ("<o/wikilink>", "'<w/Q' || c_custkey || '>'", "c_custkey % 4 = 0"),
    ],
    "port": [
        ("<n/hasGADM_Name>", "'\"' || s_name || '\"'", "true"),
        ("<o/isHarbour>", "'\"yes\"'", "true"),
        ("<o/hasSeamarkType>", "'\"''harbour''\"'", "s_suppkey % 2 = 0"),
        ("<o/hasSource>", "'\"a \\\"survey\\\"\"'", "true"),
    ],
    "river": [
        ("<n/hasGADM_Name>", "'\"' || n_name || '\"'", "true"),
        ("<o/waterwayType>", "'\"river\"'", "true"),
        ("<o/wikilink>", "'<w/Q' || n_nationkey || '>'", "n_nationkey % 2 = 0"),
    ],
    "sea": [
        ("<o/hasMRGID>", f"'\"' || (r_regionkey + 1000) || '\"^^<{INTEGER}>'", "true"),
        ("<o/hasArea>", f"'\"' || (r_regionkey * 7) || '\"^^<{DOUBLE}>'", "true"),
        ("<n/hasGADM_Name>", "'\"' || r_name || '\"'", "true"),
    ],
}


def entity_sql(cls, kinds=("type", "props", "geo")):
    source, ident, geo = _ID[cls]
    prefix = "sea_" if cls == "sea" else ""
    s = f"'<r/{prefix}' || {ident} || '>'"
    node = f"'<r/Geometry_{cls}_' || {ident} || '>'"
    parts = []
    if "type" in kinds:
        parts.append(f"SELECT {s} AS s, '{rdf.RDF_TYPE}' AS p, '<o/{cls}>' AS o FROM {source}")
    if "props" in kinds:
        parts += [f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {source} WHERE {w}" for p, o, w in _TERMS[cls]]
    if "geo" in kinds and geo:
        wkt = _WKT.get(cls, SQL_POINT).format(k=geo[0])
        parts.append(f"SELECT {s} AS s, '{rdf.HAS_GEOMETRY}' AS p, {node} AS o FROM {source} WHERE {geo[1]}")
        parts.append(
            f"SELECT {node} AS s, '{rdf.AS_WKT}' AS p, '\"{rdf.EPSG_4326} ' || {wkt} || '\"^^{rdf.WKT_LITERAL}' AS o FROM {source} WHERE {geo[1]}"
        )
    return " UNION ALL ".join(parts)


def pairs_of(df, cls, pairs):
    kept = F.filter(F.array(*pairs), lambda x: x["o"].isNotNull())
    return df.select(T.subject(cls, VOC).alias("s"), F.inline(kept))


@CAT.add("prj_01", " UNION ALL ".join(entity_sql(c, ("type",)) for c in CLASSES))
def prj_01(spark, sf):
    """rdf:type of every entity of the six classes."""
    return T.graph([pairs_of(entities(spark, sf, c), c, [T.type_pair(c, VOC)]) for c in CLASSES])


@CAT.add(
    "prj_02",
    " UNION ALL ".join(
        f"SELECT * FROM ({entity_sql(c, ('props',))}) WHERE p LIKE '<o/%' AND p NOT IN ('<o/wikilink>', '<o/hasThumbnail>', '<o/derivedFrom>', '<o/hasLicense>')"
        for c in CLASSES
    ),
)
def prj_02(spark, sf):
    """Property → triple unpivot, one triple per present property."""
    return T.graph([pairs_of(entities(spark, sf, c), c, T.property_pairs(c, VOC)) for c in CLASSES])


@CAT.add(
    "prj_03",
    f"""SELECT c_custkey, '"' || c_acctbal || '"^^<{DOUBLE}>' AS term, c_acctbal AS value, '{DOUBLE}' AS datatype,
'"' || c_name || '"@en' AS named, 'en' AS lang FROM customer""",
)
def prj_03(spark, sf):
    """Typed literals and back."""
    c = table(spark, sf, "customer").select(
        "c_custkey", rdf.literal(F.col("c_acctbal"), DOUBLE).alias("term"), rdf.literal(F.col("c_name"), lang="en").alias("named")
    )
    return c.select(
        "c_custkey",
        "term",
        rdf.typed_value(F.col("term"), "double").alias("value"),
        rdf.literal_datatype(F.col("term")).alias("datatype"),
        "named",
        rdf.literal_lang(F.col("named")).alias("lang"),
    )


@CAT.add("prj_04", f"SELECT * FROM ({entity_sql('poi', ('props',))}) WHERE p = '<n/hasGADM_Name>'")
def prj_04(spark, sf):
    """Names in four language variants."""
    return pairs_of(entities(spark, sf, "poi"), "poi", T.name_pairs("poi", VOC))


# the text of a quoted literal: backslash, quote, line feed, carriage return and tab escaped
SQL_ESCAPED = (
    "replace(replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), "
    "chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
)


@CAT.add("prj_05", f"SELECT doc_id, chr(34) || {SQL_ESCAPED.format(x='replace(text, chr(34), chr(39))')} || chr(34) AS o FROM documents")
def prj_05(spark, sf):
    """Double quotes become single ones inside literals."""
    return table(spark, sf, "documents").select("doc_id", rdf.literal(rdf.single_quotes(F.col("text"))).alias("o"))


@CAT.add("prj_06", f"SELECT * FROM ({entity_sql('sentinel2', ('props',))}) WHERE p IN ('<o/hasThumbnail>', '<o/derivedFrom>', '<o/hasLicense>')")
def prj_06(spark, sf):
    """Links by relation."""
    return entities(spark, sf, "sentinel2").select(T.subject("sentinel2", VOC).alias("s"), F.inline(T.link_pairs(VOC)))


@CAT.add("prj_07", f"SELECT * FROM ({entity_sql('sentinel1', ('props',))}) WHERE p = '<o/hasThumbnail>'")
def prj_07(spark, sf):
    """Null-guarded nested thumbnail."""
    return pairs_of(entities(spark, sf, "sentinel1"), "sentinel1", T.thumbnail_pairs(VOC))


@CAT.add("prj_08", " UNION ALL ".join(f"SELECT * FROM ({entity_sql(c, ('props',))}) WHERE p = '<o/wikilink>'" for c in ("poi", "river")))
def prj_08(spark, sf):
    """External identifier links, object is an IRI."""
    return T.graph([pairs_of(entities(spark, sf, c), c, T.wiki_pairs(c, VOC)) for c in ("poi", "river")])


@CAT.add("prj_09", " UNION ALL ".join(entity_sql(c, ("geo",)) for c in CLASSES))
def prj_09(spark, sf):
    """Geometry node pairs."""
    return T.graph([T.geometry_triples(entities(spark, sf, c), c, VOC) for c in CLASSES])


WIDE = {
    "class": (rdf.RDF_TYPE, "iri"),
    "name": ("<o/name>", "string"),
    "balance": ("<o/balance>", "double"),
    "price": ("<o/price>", "double"),
    "nation": ("<o/inNation>", "iri"),
}


@CAT.add(
    "prj_10",
    """SELECT '<r/region/' || r_regionkey || '>' AS s, '<o/region>' AS class, r_name AS name, NULL::DOUBLE AS balance, NULL::DOUBLE AS price, NULL::VARCHAR AS nation FROM region
UNION ALL SELECT '<r/nation/' || n_nationkey || '>', '<o/nation>', n_name, NULL, NULL, NULL FROM nation
UNION ALL SELECT '<r/customer/' || c_custkey || '>', '<o/customer>', c_name, c_acctbal, NULL, '<r/nation/' || c_nationkey || '>' FROM customer
UNION ALL SELECT '<r/supplier/' || s_suppkey || '>', '<o/supplier>', s_name, s_acctbal, NULL, '<r/nation/' || s_nationkey || '>' FROM supplier
UNION ALL SELECT '<r/order/' || o_orderkey || '>', '<o/order>', NULL, NULL, o_totalprice, NULL FROM orders""",
)
def prj_10(spark, sf):
    """Triples back to a wide typed table."""
    return T.wide(star(spark, sf), WIDE)


def ordered(spark, sf, patterns):
    """The stored star graph, the patterns and the counts that order them."""
    graph, counts = star_store(spark, sf)
    return graph, patterns, counts


@CAT.add(
    "prj_12",
    QN + """SELECT a.s AS customer, upper(substr(a.o, 2, length(a.o) - 2)) AS shout FROM t a JOIN t b ON a.s = b.s
WHERE a.p = '<o/name>' AND b.p = '<o/segment>' AND b.o = '"BUILDING"'""",
)
def prj_12(spark, sf):
    """SELECT list with an expression."""
    found = P.match(*ordered(spark, sf, [("?c", "<o/segment>", '"BUILDING"'), ("?c", "<o/name>", "?n")]))
    return P.select(found, {"customer": F.col("c"), "shout": F.upper(rdf.literal_value(F.col("n")))})


@CAT.add("udtf_01", entity_sql("sentinel2"))
def udtf_01(spark, sf):
    """One product row → all its triples."""
    return T.entity_triples(entities(spark, sf, "sentinel2"), "sentinel2", VOC)


@CAT.add("set_01", " UNION ALL ".join(entity_sql(c) for c in CLASSES))
def set_01(spark, sf):
    """The graph: union of the six entity graphs."""
    return T.graph([T.entity_triples(entities(spark, sf, c), c, VOC) for c in CLASSES])


@CAT.add("flt_01", f"SELECT * FROM ({' UNION ALL '.join(entity_sql(c) for c in CLASSES)}) WHERE p = '{rdf.HAS_GEOMETRY}'")
def flt_01(spark, sf):
    """Triples of one predicate."""
    return T.with_predicate(kept(spark, sf, "entities", set_01)[0], rdf.HAS_GEOMETRY)


@CAT.add("agg_34", QN + "SELECT p, count(*) AS n FROM t GROUP BY p")
def agg_34(spark, sf):
    """Triples per predicate."""
    return T.predicate_counts(star_store(spark, sf)[0])


def crs_terms(spark, sf):
    """WKT literals, every third already tagged, plus name triples."""
    c = table(spark, sf, "customer")
    wkt = point_wkt("c_custkey")
    bare = F.concat(F.lit('"'), wkt, F.lit('"'))
    o = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(f'"{rdf.EPSG_4326} '), wkt, F.lit('"'))).otherwise(bare)
    geo = c.select(rdf.iri("r/g", F.col("c_custkey")).alias("s"), F.lit(rdf.AS_WKT).alias("p"), o.alias("o"))
    names = c.select(rdf.iri("r/c", F.col("c_custkey")).alias("s"), F.lit("<o/name>").alias("p"), rdf.literal(F.col("c_name")).alias("o"))
    return geo.unionByName(names)


SQL_CRS = f"""WITH w AS (SELECT c_custkey, {SQL_POINT.format(k='c_custkey')} AS wkt, c_name FROM customer) """


@CAT.add(
    "str_08",
    SQL_CRS + f"""SELECT '<r/g' || c_custkey || '>' AS s, '{rdf.AS_WKT}' AS p, CASE WHEN c_custkey % 3 = 0 THEN '"{rdf.EPSG_4326} ' ELSE '"{rdf.EPSG_4326}  ' END || wkt || '"' AS o FROM w
UNION ALL SELECT '<r/c' || c_custkey || '>', '<o/name>', '"' || c_name || '"' FROM w""",
)
def str_08(spark, sf):
    """Add the CRS tag where it is missing."""
    return crs_terms(spark, sf).withColumn("o", rdf.add_crs(F.col("p"), F.col("o")))


@CAT.add(
    "str_09",
    SQL_CRS + f"""SELECT '<r/g' || c_custkey || '>' AS s, '{rdf.AS_WKT}' AS p, '"' || wkt || '"' AS o FROM w
UNION ALL SELECT '<r/c' || c_custkey || '>', '<o/name>', '"' || c_name || '"' FROM w""",
)
def str_09(spark, sf):
    """Remove the CRS tag."""
    tagged = crs_terms(spark, sf).withColumn("o", rdf.add_crs(F.col("p"), F.col("o")))
    return tagged.withColumn("o", rdf.drop_crs(F.col("p"), F.col("o")))


def geometry_links(spark, sf):
    """Entity → geometry rows: customers own their orders as geometries; file order by order key."""
    o = table(spark, sf, "orders")
    marked = F.col("o_orderkey") % 3 == 0
    node = F.when(marked, rdf.iri("r/Geometry_gadm_", F.col("o_orderkey"))).otherwise(rdf.iri("r/Geometry_", F.col("o_orderkey")))
    return o.select(rdf.iri("r/c", F.col("o_custkey")).alias("s"), node.alias("o"), F.col("o_orderkey").alias("ord"))


SQL_LINKS = """g AS (SELECT '<r/c' || o_custkey || '>' AS s, CASE WHEN o_orderkey % 3 = 0 THEN '<r/Geometry_gadm_' ELSE '<r/Geometry_' END || o_orderkey || '>' AS o,
 o_orderkey AS ord, o_orderkey % 3 = 0 AS gadm FROM orders),
k AS (SELECT s, coalesce(min(ord) FILTER (NOT gadm), max(ord) FILTER (gadm)) AS keep FROM g GROUP BY s)"""


@CAT.add("agg_01", f"WITH {SQL_LINKS} SELECT g.s, g.o FROM g JOIN k ON g.s = k.s AND g.ord = k.keep")
def agg_01(spark, sf):
    """One geometry kept per entity."""
    return D.keep_one_geometry(geometry_links(spark, sf))


@CAT.add("win_06", f"WITH {SQL_LINKS} SELECT g.s, g.o, g.ord FROM g JOIN k ON g.s = k.s AND g.ord <> k.keep")
def win_06(spark, sf):
    """The rows after or before the kept one in file order: the duplicates."""
    return D.duplicate_geometries(geometry_links(spark, sf))


def area_triples(spark, sf):
    """Squares of different size as WKT of a geometry node; ties in area are frequent."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("int").alias("side"))
    q = F.col("side").cast("string")
    wkt = F.concat(F.lit('"POLYGON ((0 0, '), q, F.lit(" 0, "), q, F.lit(" "), q, F.lit(", 0 "), q, F.lit(', 0 0))"'))
    geo = l.select(rdf.iri("r/g", F.col("l_orderkey")).alias("s"), F.lit(rdf.AS_WKT).alias("p"), wkt.alias("o"), F.col("l_partkey").alias("ord"))
    other = table(spark, sf, "orders").select(
        rdf.iri("r/e", F.col("o_orderkey")).alias("s"), F.lit(rdf.HAS_GEOMETRY).alias("p"), rdf.iri("r/g", F.col("o_orderkey")).alias("o"), F.lit(0).cast("bigint").alias("ord")
    )
    return geo.unionByName(other)


SQL_AREA = f"""l AS (SELECT l_orderkey, l_partkey, max(l_quantity)::INTEGER::BIGINT AS side FROM lineitem GROUP BY l_orderkey, l_partkey),
w AS (SELECT *, '"POLYGON ((0 0, ' || side || ' 0, ' || side || ' ' || side || ', 0 ' || side || ', 0 0))"' AS o FROM l)"""


@CAT.add(
    "agg_02",
    f"""WITH {SQL_AREA} SELECT '<r/g' || l_orderkey || '>' AS s, '{rdf.AS_WKT}' AS p, arg_max(o, side * 1000000000 + l_partkey) AS o FROM w GROUP BY l_orderkey
UNION ALL SELECT '<r/e' || o_orderkey || '>', '{rdf.HAS_GEOMETRY}', '<r/g' || o_orderkey || '>' FROM orders""",
)
def agg_02(spark, sf):
    """Largest geometry per node, the later one on a tie."""
    return D.largest_geometry(area_triples(spark, sf))


@CAT.add(
    "jn_01",
    f"""WITH {SQL_AREA}, last AS (SELECT l_orderkey, arg_max(o, l_partkey) AS wkt FROM w GROUP BY l_orderkey)
SELECT wkt, '<r/e' || o_orderkey || '>' AS entity FROM orders LEFT JOIN last ON l_orderkey = o_orderkey""",
)
def jn_01(spark, sf):
    """(WKT, entity) rows; entities without WKT keep a null."""
    return D.entity_wkt(area_triples(spark, sf))


@CAT.add(
    "jn_02",
    """WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, '<r/c' || c_custkey || '>' AS e FROM customer),
b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, '<r/s' || s_suppkey || '>' AS e FROM supplier)
SELECT o_orderkey, coalesce(a.e, 'null') AS s, '<o/within>' AS p, coalesce(b.e, 'null') AS o FROM orders
LEFT JOIN a ON a.i = o_custkey + 3 LEFT JOIN b ON b.i = o_orderkey % 120""",
)
def jn_02(spark, sf):
    """Numbered pair results back to entities; source counts from 0, target from 1, unknown → null text."""
    left = N.number_by_id(table(spark, sf, "customer").select("c_custkey", rdf.iri("r/c", F.col("c_custkey")).alias("entity")), "c_custkey", start=0)
    right = N.number_by_id(table(spark, sf, "supplier").select("s_suppkey", rdf.iri("r/s", F.col("s_suppkey")).alias("entity")), "s_suppkey", start=1)
    number = lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit(">"))
    pairs = table(spark, sf, "orders").select(
        number(F.col("o_custkey") + 3).alias("s"),
        F.concat(F.lit("<o/within>"), F.lit("|"), F.col("o_orderkey").cast("string")).alias("p"),
        number(F.col("o_orderkey") % 120).alias("o"),
    )
    named = D.name_pairs(pairs, left, right)
    parts = F.split("p", r"\|")
    return named.select("s", parts[0].alias("p"), "o", parts[1].cast("bigint").alias("o_orderkey"))


@CAT.add(
    "jn_03",
    QN + "SELECT * FROM t WHERE s IN (SELECT '<r/nation/' || n_nationkey || '>' FROM nation WHERE n_regionkey = 1) OR o IN (SELECT '<r/nation/' || n_nationkey || '>' FROM nation WHERE n_regionkey = 1)",
)
def jn_03(spark, sf):
    """Triples whose subject or object is in a dictionary."""
    names = table(spark, sf, "nation").filter("n_regionkey = 1").select(rdf.iri("r/nation/", F.col("n_nationkey")).alias("s"))
    return D.keep_from_dictionary(star(spark, sf), names)


@CAT.add(
    "jn_04",
    f"WITH {SQL_LINKS}, d AS (SELECT g.o FROM g JOIN k ON g.s = k.s AND g.ord <> k.keep) SELECT s, '{rdf.HAS_GEOMETRY}' AS p, o FROM g WHERE s NOT IN (SELECT o FROM d) AND o NOT IN (SELECT o FROM d)",
)
def jn_04(spark, sf):
    """Triples without the duplicate geometries."""
    links = geometry_links(spark, sf)
    triples = links.select("s", F.lit(rdf.HAS_GEOMETRY).alias("p"), "o")
    return D.drop_duplicates(triples, D.duplicate_geometries(links))


@CAT.add(
    "win_09",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer",
)
def win_09(spark, sf):
    """Dense numbering of rows as pair ids."""
    return N.number_by_id(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


CUSTOMER_REGION = [("?c", rdf.RDF_TYPE, "<o/customer>"), ("?c", "<o/inNation>", "?n"), ("?n", "<o/inRegion>", "?r")]


@CAT.add(
    "jn_05",
    "SELECT '<r/customer/' || c_custkey || '>' AS c, '<r/nation/' || n_nationkey || '>' AS n, '<r/region/' || n_regionkey || '>' AS r FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def jn_05(spark, sf):
    """Basic graph pattern customer → nation → region."""
    return P.match(*ordered(spark, sf, CUSTOMER_REGION))


@CAT.add(
    "jn_06",
    "SELECT '<r/customer/' || c_custkey || '>' AS c, CASE WHEN o_orderkey IS NOT NULL THEN '<r/order/' || o_orderkey || '>' END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'",
)
def jn_06(spark, sf):
    """OPTIONAL group: urgent orders of a customer."""
    g, counts = star_store(spark, sf)
    urgent = P.match(g, [("?o", "<o/orderedBy>", "?c"), ("?o", "<o/priority>", '"1-URGENT"')], counts)
    return P.optional(P.match_one(g, ("?c", rdf.RDF_TYPE, "<o/customer>")), urgent)


@CAT.add(
    "jn_07",
    "SELECT '<r/customer/' || c_custkey || '>' AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def jn_07(spark, sf):
    """MINUS group."""
    g, counts = star_store(spark, sf)
    pending = P.match(g, [("?o", "<o/status>", '"P"'), ("?o", "<o/orderedBy>", "?c")], counts)
    return P.minus(P.match_one(g, ("?c", rdf.RDF_TYPE, "<o/customer>")), pending)


@CAT.add(
    "jn_08",
    """SELECT '<r/customer/' || c_custkey || '>' AS c, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_final FROM customer""",
)
def jn_08(spark, sf):
    """EXISTS and NOT EXISTS over a sub-pattern."""
    g, counts = star_store(spark, sf)
    customers = P.match_one(g, ("?c", rdf.RDF_TYPE, "<o/customer>"))
    final = P.match(g, [("?o", "<o/status>", '"F"'), ("?o", "<o/orderedBy>", "?c")], counts)
    yes = P.exists(customers, final).withColumn("has_final", F.lit(True))
    return yes.unionByName(P.exists(customers, final, negated=True).withColumn("has_final", F.lit(False)))


BALANCED = [("?c", "<o/balance>", "?b"), ("?c", "<o/segment>", "?g")]


@CAT.add(
    "flt_06",
    "SELECT '<r/customer/' || c_custkey || '>' AS c FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT c_acctbal < 0",
)
def flt_06(spark, sf):
    """Boolean filter with AND, OR and NOT."""
    found = P.match(*ordered(spark, sf, BALANCED))
    b = rdf.typed_value(F.col("b"), "double")
    return P.filter_all(found, (b > 5000) | (F.col("g") == '"BUILDING"'), ~(b < 0)).select("c")


@CAT.add(
    "set_02",
    """SELECT '<r/customer/' || c_custkey || '>' AS e, '"' || c_mktsegment || '"' AS g FROM customer
UNION ALL SELECT '<r/supplier/' || s_suppkey || '>', NULL FROM supplier""",
)
def set_02(spark, sf):
    """UNION of groups binding different variables."""
    g, _ = star_store(spark, sf)
    return P.union(P.match_one(g, ("?e", "<o/segment>", "?g")), P.match_one(g, ("?e", rdf.RDF_TYPE, "<o/supplier>")))


@CAT.add(
    "set_03",
    """SELECT '<r/customer/' || c_custkey || '>' AS c, 'bag' AS form FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT '<r/customer/' || c_custkey || '>', 'bag' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT '<r/customer/' || c_custkey || '>', 'filter' FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'""",
)
def set_03(spark, sf):
    """OR as one filter, and as a bag union of branches."""
    found = P.match(*ordered(spark, sf, BALANCED))
    either = (rdf.typed_value(F.col("b"), "double") > 5000, F.col("g") == '"BUILDING"')
    bag = P.filter_any(found, *either, as_union=True).select("c", F.lit("bag").alias("form"))
    return bag.unionByName(P.filter_any(found, *either).select("c", F.lit("filter").alias("form")))


@CAT.add("set_04", QN + "SELECT DISTINCT p, CASE WHEN o LIKE '<%' THEN 'iri' ELSE 'literal' END AS kind FROM t")
def set_04(spark, sf):
    """DISTINCT solutions."""
    all_triples = P.match_one(star_store(spark, sf)[0], ("?s", "?p", "?o"))
    kind = F.when(F.col("o").startswith("<"), F.lit("iri")).otherwise(F.lit("literal"))
    return P.select(all_triples, {"p": F.col("p"), "kind": kind}, distinct=True)


@CAT.add(
    "agg_27",
    """SELECT '<r/region/' || n_regionkey || '>' AS region, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal > 0 GROUP BY n_regionkey HAVING count(*) > 10""",
)
def agg_27(spark, sf):
    """GROUP BY with aggregates and HAVING."""
    found = P.match(*ordered(spark, sf, [("?c", "<o/balance>", "?b"), *CUSTOMER_REGION]))
    b = rdf.typed_value(F.col("b"), "double")
    return P.group(
        found.filter(b > 0),
        {"region": F.col("r")},
        {"n": F.count(F.lit(1)), "total": F.round(F.sum(b), 2)},
        having=F.col("n") > 10,
    )


@CAT.add("agg_29", "SELECT 'rich' AS question, count(*) > 0 AS answer FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'none', count(*) > 0 FROM customer WHERE c_acctbal > 1000000")
def agg_29(spark, sf):
    """ASK."""
    found = P.match(*ordered(spark, sf, BALANCED))
    b = rdf.typed_value(F.col("b"), "double")
    yes = P.ask(found.filter(b > 9000)).select(F.lit("rich").alias("question"), "answer")
    return yes.unionByName(P.ask(found.filter(b > 1000000)).select(F.lit("none").alias("question"), "answer"))


@CAT.add(
    "agg_32",
    """WITH n AS (SELECT n_regionkey, c_nationkey, count(*) AS customers, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT '<r/region/' || n_regionkey || '>' AS region, '<r/nation/' || arg_max(c_nationkey, customers * 1000 - c_nationkey) || '>' AS most, sum(customers)::BIGINT AS customers,
 round(sum(total), 2) AS total, count(*) FILTER (customers < 60) AS small_nations FROM n GROUP BY n_regionkey""",
)
def agg_32(spark, sf):
    """Superlatives, counts and totals per region."""
    found = P.match(*ordered(spark, sf, [("?c", "<o/balance>", "?b"), *CUSTOMER_REGION]))
    per = found.groupBy("r", "n").agg(F.count(F.lit(1)).alias("customers"), F.sum(rdf.typed_value(F.col("b"), "double")).alias("total"))
    key = F.regexp_extract("n", r"(\d+)>$", 1).cast("bigint")
    return per.groupBy(F.col("r").alias("region")).agg(
        F.max_by("n", F.struct("customers", -key)).alias("most"),
        F.sum("customers").alias("customers"),
        F.round(F.sum("total"), 2).alias("total"),
        F.count_if(F.col("customers") < 60).alias("small_nations"),
    )


@CAT.add(
    "top_06",
    "SELECT '<r/customer/' || c_custkey || '>' AS c, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c LIMIT 25",
)
def top_06(spark, sf):
    """ORDER BY and LIMIT."""
    found = P.match(*ordered(spark, sf, BALANCED))
    out = {"c": F.col("c"), "balance": rdf.typed_value(F.col("b"), "double")}
    return P.select(found, out, order=[F.desc("balance"), "c"], limit=25)


@CAT.add(
    "top_07",
    "SELECT 's2_' || event_id AS id, json_extract_string(props, '$.k')::DOUBLE AS cloud FROM events WHERE json_extract_string(props, '$.k')::DOUBLE > 15 AND user_id % 2 = 1 ORDER BY id LIMIT 12",
)
def top_07(spark, sf):
    """Give me twelve images after metadata filters."""
    products = entities(spark, sf, "sentinel2").select(
        "id", F.col("properties")["platform"].alias("platform"), F.col("properties")["eo:cloud_cover"].try_cast("double").alias("cloud")
    )
    return products.filter((F.col("cloud") > 15) & (F.col("platform") == "sentinel-2b")).orderBy("id").limit(12).select("id", "cloud")
