"""N-Triples terms as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

# fixed values: public standard IRIs
XSD = "http://www.w3.org/2001/XMLSchema#"
GEO = "http://www.opengis.net/ont/geosparql#"
EPSG_4326 = "<http://www.opengis.net/def/crs/EPSG/0/4326>"

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
HAS_GEOMETRY = f"<{GEO}hasGeometry>"
AS_WKT = f"<{GEO}asWKT>"
WKT_LITERAL = f"<{GEO}wktLiteral>"

# subject, predicate, object of one N-Triples line
TRIPLE_LINE = (
    r'^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+'
    r'(<[^>]*>|_:\S+|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*$'
)
LITERAL = r'(?s)^"((?:[^"\\]++|\\.)*+)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?$'


@dataclass(frozen=True)
class Vocabulary:
    """Namespaces of the graph; set them to those of an existing graph to extend it."""

    resource: str = "http://example.org/eo/resource/"
    ontology: str = "http://example.org/eo/ontology/"
    names: str = "http://example.org/eo/names/"
    wiki: str = "https://www.wikidata.org/wiki/"


def iri(prefix, local):
    return F.concat(F.lit(f"<{prefix}"), local.cast("string"), F.lit(">"))


def single_quotes(value):
    """Double quotes become single ones, so a literal cannot break."""
    return F.translate(value, '"', "'")


# fixed values: characters that a quoted literal escapes, the backslash first
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def escaped(value):
    """The text as it stands between the quotes of a literal."""
    for plain, written in ESCAPES:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def unescaped(value):
    """The text that a literal's quoted form stands for."""

    def plain_part(part):
        for plain, written in ESCAPES[1:]:
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    # between doubled backslashes every other escape is unambiguous
    return F.array_join(F.transform(F.split(value, r"\\\\"), plain_part), "\\")


def literal(value, datatype=None, lang=None):
    """``"v"``, ``"v"^^<datatype>`` or ``"v"@lang`` with special characters escaped; null stays null."""
    tail = f"@{lang}" if lang else f"^^<{datatype}>" if datatype else ""
    return F.concat(F.lit('"'), escaped(value.cast("string")), F.lit(f'"{tail}'))


def literal_value(term):
    """Text of a literal, null for IRIs and blank nodes."""
    return F.when(term.startswith('"'), unescaped(F.regexp_extract(term, LITERAL, 1)))


def literal_datatype(term):
    return F.nullif(F.regexp_extract(term, LITERAL, 3), F.lit(""))


def literal_lang(term):
    return F.nullif(F.regexp_extract(term, LITERAL, 2), F.lit(""))


def typed_value(term, spark_type):
    """Literal as a Spark value, null when it does not parse."""
    if spark_type == "timestamp":
        return F.try_to_timestamp(literal_value(term))
    return literal_value(term).try_cast(spark_type)


def wkt_literal(wkt):
    return F.concat(F.lit(f'"{EPSG_4326} '), wkt, F.lit(f'"^^{WKT_LITERAL}'))


def add_crs(predicate, term, crs=EPSG_4326):
    """Tag WKT literals that lack the CRS; two spaces follow the tag."""
    tagged = F.concat(F.lit(f'"{crs}  '), F.substring(term, 2, 2147483647))
    return F.when((predicate == AS_WKT) & ~term.contains(crs), tagged).otherwise(term)


def drop_crs(predicate, term, crs=EPSG_4326):
    """Remove the EPSG:4326 tag from WKT literals."""
    bare = F.concat(F.lit('"'), F.trim(F.replace(term, F.lit(f'"{EPSG_4326}'), F.lit(""))))
    return F.when((predicate == AS_WKT) & term.contains(crs), bare).otherwise(term)
