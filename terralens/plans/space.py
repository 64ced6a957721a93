"""Geometry and spatial queries: customers are points, suppliers 20° boxes, coast lines run through customer points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rdf
from ..operators import patterns as P
from ..operators import spatial as S
from ..sources import readers
from .common import Catalogue, rounded, table

CAT = Catalogue()

SQL_XY = """pt AS (SELECT c_custkey AS id, c_nationkey AS nation, ((c_custkey * 37) % 360 - 180)::DOUBLE AS x, ((c_custkey * 17) % 180 - 90)::DOUBLE AS y FROM customer),
bx AS (SELECT s_suppkey AS id, s_nationkey AS nation, ((s_suppkey * 37) % 360 - 180)::DOUBLE AS x, ((s_suppkey * 17) % 180 - 90)::DOUBLE AS y FROM supplier)"""


def place(key):
    return ((F.col(key) * 37) % 360 - 180).cast("double"), ((F.col(key) * 17) % 180 - 90).cast("double")


def points(spark, sf):
    x, y = place("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), x.alias("x"), y.alias("y"))


def sites(spark, sf):
    x, y = place("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), x.alias("x"), y.alias("y"))


def point_layer(spark, sf):
    n = G.number_text
    df = points(spark, sf).select("id", F.concat(F.lit("POINT ("), n(F.col("x")), F.lit(" "), n(F.col("y")), F.lit(")")).alias("wkt"))
    return S.prepare(df, "id", "wkt")


def box_wkt(x, y, half=10):
    rings = G.box_rings(x - half, y - half, x + half, y + half)
    return G.to_wkt(rings, F.lit("POLYGON"))


def box_layer(spark, sf):
    return S.prepare(sites(spark, sf).select("id", box_wkt(F.col("x"), F.col("y")).alias("wkt")), "id", "wkt")


def coast_lines(spark, sf):
    """Lines through ten customer points of consecutive keys."""
    p = points(spark, sf).withColumn("line", F.floor(F.col("id") / 10))
    ordered = F.array_sort(F.collect_list(F.struct("id", "x", "y")))
    grouped = p.groupBy("line").agg(ordered.alias("ps"))
    return grouped.select("line", F.transform("ps", lambda e: G.point(e["x"], e["y"])).alias("points"))


def squares(spark, sf):
    """One rotated square per order: centre (key % 100, key % 37), half diagonal = key % 9 + 1."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 100).cast("double").alias("cx"),
        (F.col("o_orderkey") % 37).cast("double").alias("cy"),
        (F.col("o_orderkey") % 9 + 1).cast("double").alias("h"),
    )
    cx, cy, h = F.col("cx"), F.col("cy"), F.col("h")
    ring = F.array(G.point(cx + h, cy), G.point(cx, cy + h), G.point(cx - h, cy), G.point(cx, cy - h), G.point(cx + h, cy))
    return o.withColumn("ring", ring)


SQL_SQ = "sq AS (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS cx, (o_orderkey % 37)::DOUBLE AS cy, (o_orderkey % 9 + 1)::DOUBLE AS h FROM orders)"


@CAT.add(
    "geo_01",
    """WITH k AS (SELECT o_orderkey, o_orderkey % 100 AS x, o_orderkey % 37 AS y FROM orders)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'POINT (' || x || ' ' || y || ')' WHEN 1 THEN 'LINESTRING (' || x || ' ' || y || ', ' || (x + 1) || '.5 ' || y || ')'
 WHEN 2 THEN 'POLYGON ((' || x || ' ' || y || ', ' || (x + 1) || ' ' || y || ', ' || x || ' ' || (y + 1) || ', ' || x || ' ' || y || '))'
 WHEN 3 THEN 'MULTIPOINT ((' || x || ' ' || y || '), (1 2))' WHEN 4 THEN 'MULTILINESTRING ((' || x || ' ' || y || ', 1 2), (3 4, 5 6))'
 WHEN 5 THEN 'GEOMETRYCOLLECTION (POINT (' || x || ' ' || y || '), LINESTRING (0 0, 1 1))'
 ELSE 'MULTIPOLYGON (((' || x || ' ' || y || ', ' || (x + 1) || ' ' || y || ', ' || x || ' ' || y || ')), ((0 0, 1 0, 0 0)))' END AS wkt FROM k""",
)
def geo_01(spark, sf):
    """GeoJSON text of all kinds → WKT."""
    x, y = (F.col("o_orderkey") % 100).cast("string"), (F.col("o_orderkey") % 37).cast("string")
    x1, y1 = (F.col("o_orderkey") % 100 + 1).cast("string"), (F.col("o_orderkey") % 37 + 1).cast("string")

    def text(kind, form, *args):
        return F.format_string('{"type":"' + kind + '","coordinates":' + form + "}", *args)

    k = F.col("o_orderkey") % 7
    both = F.concat(text("Point", "[%s,%s]", x, y), F.lit(',{"type":"LineString","coordinates":[[0,0],[1,1]]}'))
    gj = (
        F.when(k == 0, text("Point", "[%s,%s]", x, y))
        .when(k == 1, text("LineString", "[[%s,%s],[%s.5,%s.0]]", x, y, x1, y))
        .when(k == 2, text("Polygon", "[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", x, y, x1, y, x, y1, x, y))
        .when(k == 3, text("MultiPoint", "[[%s,%s],[1,2]]", x, y))
        .when(k == 4, text("MultiLineString", "[[[%s,%s],[1,2]],[[3,4],[5,6]]]", x, y))
        .when(k == 5, F.concat(F.lit('{"type":"GeometryCollection","geometries":['), both, F.lit("]}")))
        .otherwise(text("MultiPolygon", "[[[[%s,%s],[%s,%s],[%s,%s]]],[[[0,0],[1,0],[0,0]]]]", x, y, x1, y, x, y))
    )
    return table(spark, sf, "orders").select("o_orderkey", G.geojson_to_wkt(gj).alias("wkt"))


@CAT.add("geo_02", f"WITH {SQL_SQ} SELECT o_orderkey, round(2 * h * h, 6) AS area FROM sq")
def geo_02(spark, sf):
    """Shoelace area."""
    return squares(spark, sf).select("o_orderkey", F.round(G.ring_area(F.col("ring")), 6).alias("area"))


@CAT.add("geo_03", f"WITH {SQL_SQ} SELECT o_orderkey, cx AS x, cy AS y, true AS thin_is_null FROM sq")
def geo_03(spark, sf):
    """Area centroid; null for a degenerate ring."""
    df = squares(spark, sf).select("o_orderkey", G.centroid(F.col("ring")).alias("c"), G.centroid(F.slice("ring", 1, 2)).alias("d"))
    return df.select("o_orderkey", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.col("d").isNull().alias("thin_is_null"))


@CAT.add("geo_04", f"WITH {SQL_SQ} SELECT o_orderkey, 128 - cy AS first_y, 128 - (cy + h) AS second_y FROM sq")
def geo_04(spark, sf):
    """Flip y by the raster height."""
    df = squares(spark, sf).select("o_orderkey", G.flip_y(F.col("ring"), F.lit(128.0)).alias("r"))
    return df.select("o_orderkey", F.col("r")[0]["y"].alias("first_y"), F.col("r")[1]["y"].alias("second_y"))


SQL_CELL = "CASE WHEN cx < 90 AND cy < 30 THEN (floor(3 * cx / 90) + 3 * floor(3 * cy / 30))::INTEGER END"


@CAT.add("geo_05", f"WITH {SQL_SQ} SELECT o_orderkey, {SQL_CELL} AS cell FROM sq")
def geo_05(spark, sf):
    """3 × 3 grid cell of a point in a 90 × 30 image; null outside."""
    return squares(spark, sf).select("o_orderkey", G.grid_cell(F.col("cx"), F.col("cy"), F.lit(90.0), F.lit(30.0)).alias("cell"))


@CAT.add(
    "geo_06",
    f"""WITH {SQL_SQ}, c AS (SELECT o_orderkey, {SQL_CELL} AS cell FROM sq)
SELECT o_orderkey, CASE WHEN cell IS NOT NULL THEN ['upper-left','upper','upper-right','left','center','right','lower-left','lower','lower-right'][cell + 1] END AS side FROM c""",
)
def geo_06(spark, sf):
    """Side of the image."""
    cell = G.grid_cell(F.col("cx"), F.col("cy"), F.lit(90.0), F.lit(30.0))
    return squares(spark, sf).select("o_orderkey", G.side(cell).alias("side"))


@CAT.add("geo_07", f"WITH {SQL_SQ} SELECT o_orderkey, round(h / 360 * 2 * pi() * 6378137 * cos(radians(cy)), 4) AS metres FROM sq")
def geo_07(spark, sf):
    """Degrees → metres at a latitude."""
    return squares(spark, sf).select("o_orderkey", F.round(G.degrees_to_metres(F.col("h"), F.col("cy")), 4).alias("metres"))


@CAT.add("geo_08", f"WITH {SQL_SQ} SELECT o_orderkey, round(sqrt((cx - h) ** 2 + (cy - 3) ** 2), 6) AS d FROM sq")
def geo_08(spark, sf):
    """Euclidean distance."""
    return squares(spark, sf).select("o_orderkey", F.round(G.distance(F.col("h"), F.lit(3.0), F.col("cx"), F.col("cy")), 6).alias("d"))


@CAT.add("geo_09", f"WITH {SQL_SQ} SELECT o_orderkey, round(3 * (cx + 0.5) + 500000, 6) AS x, round(-3 * (cy + 0.5) + 4000000, 6) AS y FROM sq")
def geo_09(spark, sf):
    """Pixel centre → map coordinates by an affine transform."""
    m = G.pixel_to_map(F.col("cy"), F.col("cx"), (3.0, 0.0, 500000.0, 0.0, -3.0, 4000000.0))
    df = squares(spark, sf).select("o_orderkey", m.alias("m"))
    return df.select("o_orderkey", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


SQL_TM = """
f AS (SELECT *, 1 / {inv_f} AS f FROM src), n AS (SELECT *, f / (2 - f) AS n FROM f),
r AS (SELECT *, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.9996 AS r FROM n),
z AS (SELECT *, northing / r AS xi, (easting - 500000.0) / r AS eta,
 [n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440, 17 * n ** 3 / 480 - 37 * n ** 4 / 840, 4397 * n ** 4 / 161280] AS b,
 [2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45, 7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45, 56 * n ** 3 / 15 - 136 * n ** 4 / 35, 4279 * n ** 4 / 630] AS d FROM r),
s AS (SELECT *, xi - list_sum(list_transform([1, 2, 3, 4], lambda j: b[j] * sin(2 * j * xi) * cosh(2 * j * eta))) AS xp,
 eta - list_sum(list_transform([1, 2, 3, 4], lambda j: b[j] * cos(2 * j * xi) * sinh(2 * j * eta))) AS ep FROM z),
g AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM s),
ll AS (SELECT *, {lon0} + degrees(atan2(sinh(ep), cos(xp))) AS lon, degrees(chi + list_sum(list_transform([1, 2, 3, 4], lambda j: d[j] * sin(2 * j * chi)))) AS lat FROM g)"""


@CAT.add(
    "geo_10",
    "WITH src AS (SELECT c_custkey, 200000.0 + (c_custkey * 37) % 600000 AS easting, 3700000.0 + (c_custkey * 17) % 900000 AS northing FROM customer), "
    + SQL_TM.format(inv_f="298.257223563", lon0="15")
    + " SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll",
)
def geo_10(spark, sf):
    """UTM zone 33 → longitude and latitude."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        (200000.0 + (F.col("c_custkey") * 37) % 600000).alias("e"),
        (3700000.0 + (F.col("c_custkey") * 17) % 900000).alias("n"),
    )
    df = c.select("c_custkey", G.utm_to_lonlat(F.col("e"), F.col("n"), 33).alias("p"))
    return df.select("c_custkey", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))


@CAT.add(
    "geo_10_greek_grid",
    "WITH src AS (SELECT c_custkey, 200000.0 + (c_custkey * 37) % 600000 AS easting, 3900000.0 + (c_custkey * 17) % 700000 AS northing FROM customer), "
    + SQL_TM.format(inv_f="298.257222101", lon0="24")
    + """, c AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, (1 / 298.257222101) * (2 - 1 / 298.257222101) AS e2, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS w2 FROM ll),
v AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(la) ** 2) AS v FROM c),
q AS (SELECT *, v * cos(la) * cos(lo) - 199.87 AS gx, v * cos(la) * sin(lo) + 74.79 AS gy, v * (1 - e2) * sin(la) + 246.62 AS gz, 6378137.0 * (1 - 1 / 298.257223563) AS pb FROM v),
t AS (SELECT *, sqrt(gx ** 2 + gy ** 2) AS rho, atan2(gz * 6378137.0, sqrt(gx ** 2 + gy ** 2) * pb) AS th FROM q)
SELECT c_custkey, round(degrees(atan2(gz + w2 / (1 - w2) * pb * sin(th) ** 3, rho - w2 * 6378137.0 * cos(th) ** 3)), 6) AS first, round(degrees(atan2(gy, gx)), 6) AS second FROM t""",
)
def geo_10_greek_grid(spark, sf):
    """EPSG:2100 → 4326 over geometry vertices, latitude first as that CRS orders its axes."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.array(
            F.array(G.point(200000.0 + (F.col("c_custkey") * 37) % 600000, 3900000.0 + (F.col("c_custkey") * 17) % 700000))
        ).alias("rings"),
    )
    moved = c.select("c_custkey", G.reproject(F.col("rings"), G.greek_grid_to_lonlat, lat_first=True)[0][0].alias("p"))
    return moved.select("c_custkey", F.round("p.x", 6).alias("first"), F.round("p.y", 6).alias("second"))


@CAT.add("geo_11", f"WITH {SQL_SQ} SELECT o_orderkey, cx - h AS xmin, cy - h AS ymin, cx + h AS xmax, cy + h AS ymax FROM sq")
def geo_11(spark, sf):
    """Bounding box."""
    return squares(spark, sf).select("o_orderkey", G.bounds(F.array("ring")).alias("b")).select("o_orderkey", "b.*")


@CAT.add(
    "geo_12",
    """WITH k AS (SELECT o_orderkey, o_orderkey % 100 + 10 AS x FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'MULTIPOLYGON (((' || x || ' 0, 1 1, 2 5, 3 7, 3 7, 2 5, 1 1, ' || x || ' 0, ' || x || ' 0)))'
ELSE 'MULTIPOLYGON (((' || x || ' 0, 1 1, 1 1, ' || x || ' 0, ' || x || ' 0)), ((' || x || ' 50, 3 7, 3 7, ' || x || ' 50, ' || x || ' 50)))' END AS wkt
FROM k""",
)
def geo_12(spark, sf):
    """River segments merged to maximal lines, each a zero-width polygon of a multipolygon."""
    x = (F.col("o_orderkey") % 100 + 10).cast("double")
    p = lambda a, b: G.point(a if not isinstance(a, float) else F.lit(a), F.lit(b))
    joined = F.array(F.array(p(x, 0.0), p(1.0, 1.0)), F.array(p(3.0, 7.0), p(2.0, 5.0)), F.array(p(1.0, 1.0), p(2.0, 5.0)))
    apart = F.array(F.array(p(x, 0.0), p(1.0, 1.0)), F.array(p(x, 50.0), p(3.0, 7.0)))
    lines = F.when(F.col("o_orderkey") % 2 == 0, joined).otherwise(apart)
    o = table(spark, sf, "orders").select("o_orderkey", S.merge_lines(lines).alias("l"))
    return o.select("o_orderkey", G.to_wkt(F.transform("l", G.thin_polygon), F.lit("MULTIPOLYGON")).alias("wkt"))


@CAT.add(
    "geo_13",
    """SELECT o_orderkey, 'LINESTRING (' || (o_orderkey % 100) || ' 4, ' || CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) || ' 4)' ELSE '7.5 8)' END AS wkt FROM orders""",
)
def geo_13(spark, sf):
    """LineString as it is, Point as a two-point line."""
    x = (F.col("o_orderkey") % 100).cast("string")
    gj = F.when(F.col("o_orderkey") % 2 == 0, F.format_string('{"type":"Point","coordinates":[%s,4]}', x)).otherwise(
        F.format_string('{"type":"LineString","coordinates":[[%s,4],[7.5,8.0]]}', x)
    )
    line = F.array(G.line_from_geojson(gj))
    return table(spark, sf, "orders").select("o_orderkey", G.to_wkt(line, F.lit("LINESTRING")).alias("wkt"))


@CAT.add(
    "geo_14",
    f"""WITH {SQL_SQ} SELECT o_orderkey, o_orderkey % 2 = 0 AS closed, true AS enough_points, true AS has_area, o_orderkey % 3 = 0 AS repeats, 5 AS tidy_points FROM sq""",
)
def geo_14(spark, sf):
    """Validity flags and ring tidying."""
    ring = F.when(F.col("o_orderkey") % 2 == 0, F.col("ring")).otherwise(F.slice("ring", 1, 4))
    ring = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.slice("ring", 1, 1), ring)).otherwise(ring)
    df = squares(spark, sf).select("o_orderkey", ring.alias("r"))
    return df.select("o_orderkey", G.ring_flags(F.col("r")).alias("f"), F.size(G.tidy_ring(F.col("r"))).alias("tidy_points")).select(
        "o_orderkey", "f.*", "tidy_points"
    )


@CAT.add(
    "geo_15",
    f"""WITH {SQL_SQ} SELECT o_orderkey, round(CASE o_orderkey % 5 WHEN 0 THEN 2 * h * h WHEN 1 THEN 1.5 * h * h WHEN 2 THEN 0 WHEN 3 THEN 2 * h * h + 1.5 * h * h END, 6) AS area,
CASE o_orderkey % 5 WHEN 0 THEN 'POLYGON' WHEN 1 THEN 'POLYGON' WHEN 2 THEN 'LINESTRING' WHEN 3 THEN 'GEOMETRYCOLLECTION' END AS kind FROM sq""",
)
def geo_15(spark, sf):
    """Area of WKT geometries: a square, one with a hole, an open line, a collection of all, and a text that is none."""
    h = F.col("h") / 2
    hole = F.array(G.point(F.col("cx") + h, F.col("cy")), G.point(F.col("cx"), F.col("cy") + h), G.point(F.col("cx") - h, F.col("cy")), G.point(F.col("cx"), F.col("cy") - h), G.point(F.col("cx") + h, F.col("cy")))
    square = G.to_wkt(F.array("ring"), F.lit("POLYGON"))
    with_hole = G.to_wkt(F.array(F.col("ring"), hole), F.lit("POLYGON"))
    line = G.to_wkt(F.array(F.slice("ring", 1, 4)), F.lit("LINESTRING"))
    k = F.col("o_orderkey") % 5
    wkt = (
        F.when(k == 0, F.concat(F.lit('"'), square, F.lit('"')))
        .when(k == 1, with_hole)
        .when(k == 2, line)
        .when(k == 3, F.lower(F.concat(F.lit("GEOMETRYCOLLECTION ("), square, F.lit(", "), line, F.lit(", MULTIPOINT (0 0, 1 1), "), with_hole, F.lit(")"))))
        .otherwise(F.concat(square, F.lit(" and more")))
    )
    return squares(spark, sf).select("o_orderkey", F.round(G.wkt_area(wkt), 6).alias("area"), G.kind(wkt).alias("kind"))


SQL_AREA_AGG = f"WITH {SQL_SQ} SELECT o_custkey % 25 AS owner, round(sum(2 * h * h), 6) AS total_area FROM sq JOIN orders USING (o_orderkey) GROUP BY owner"


def area_by_owner(spark, sf):
    owners = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("owner"))
    wkt = G.to_wkt(F.array("ring"), F.lit("POLYGON"))
    areas = squares(spark, sf).join(owners, "o_orderkey").select("owner", G.wkt_area(wkt).alias("a"))
    return areas.groupBy("owner").agg(F.round(F.sum("a"), 6).alias("total_area"))


@CAT.add("agg_28", SQL_AREA_AGG)
def agg_28(spark, sf):
    """Area aggregate of a group."""
    return area_by_owner(spark, sf)


@CAT.add("udaf_01", SQL_AREA_AGG)
def udaf_01(spark, sf):
    """The area aggregate is the built-in sum over geometry areas."""
    return area_by_owner(spark, sf)


SQL_REL = f"""WITH {SQL_XY}, j AS (SELECT pt.id AS s, bx.id AS o, abs(pt.x - bx.x) < 10 AND abs(pt.y - bx.y) < 10 AS inside
FROM pt JOIN bx ON abs(pt.x - bx.x) <= 10 AND abs(pt.y - bx.y) <= 10)"""


@CAT.add(
    "jn_10",
    SQL_REL + " SELECT s, 'sfIntersects' AS rel, o FROM j UNION ALL SELECT s, CASE WHEN inside THEN 'sfWithin' ELSE 'sfTouches' END, o FROM j",
)
def jn_10(spark, sf):
    """Relations of customer points to supplier boxes."""
    return S.relation_pairs(point_layer(spark, sf), box_layer(spark, sf))


@CAT.add(
    "jn_10_boxes",
    f"""WITH {SQL_XY}, j AS (SELECT a.id AS s, b.id AS o, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM bx a JOIN bx b ON abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20)
SELECT s, o, unnest(CASE WHEN dx = 0 AND dy = 0 THEN ['sfEquals', 'sfWithin', 'sfContains', 'sfCovers', 'sfIntersects'] WHEN dx = 20 OR dy = 20 THEN ['sfTouches', 'sfIntersects'] ELSE ['sfOverlaps', 'sfIntersects'] END) AS rel FROM j""",
)
def jn_10_boxes(spark, sf):
    """Relations among the supplier boxes."""
    layer = box_layer(spark, sf)
    return S.relation_pairs(layer, layer)


@CAT.add(
    "jn_10_diamonds",
    f"""WITH {SQL_XY}, d AS (SELECT DISTINCT id, x, y FROM bx),
j AS (SELECT pt.id AS s, d.id AS o, abs(pt.x - d.x) + abs(pt.y - d.y) AS l1 FROM pt JOIN d ON abs(pt.x - d.x) + abs(pt.y - d.y) <= 10)
SELECT s, 'sfIntersects' AS rel, o FROM j UNION ALL SELECT s, CASE WHEN l1 < 10 THEN 'sfWithin' ELSE 'sfTouches' END, o FROM j""",
)
def jn_10_diamonds(spark, sf):
    """Points against rotated squares, the general exact predicate."""
    x, y = F.col("x"), F.col("y")
    ring = F.array(G.point(x + 10, y), G.point(x, y + 10), G.point(x - 10, y), G.point(x, y - 10), G.point(x + 10, y))
    diamonds = sites(spark, sf).select("id", G.to_wkt(F.array(ring), F.lit("POLYGON")).alias("wkt"))
    return S.relation_pairs(point_layer(spark, sf), S.prepare(diamonds, "id", "wkt"))


def relation_table(spark, sf):
    customers = point_layer(spark, sf).withColumn("id", rdf.iri("r/customer/", F.col("id")))
    pairs = S.relation_pairs(customers, box_layer(spark, sf), relations=("sfWithin",), distinct=True)
    named = pairs.select("s", "rel", rdf.iri("r/supplier/", F.col("o")).alias("o"))
    return S.relation_triples(named)


@CAT.add(
    "jn_09",
    SQL_REL + """ SELECT '<r/customer/' || s || '>' AS a, '<r/supplier/' || o || '>' AS b, 'yes' AS found FROM j WHERE inside
UNION ALL SELECT '<r/customer/' || id || '>', NULL, 'no' FROM pt WHERE id NOT IN (SELECT s FROM j WHERE inside)""",
)
def jn_09(spark, sf):
    """Spatial function as a lookup of the stored relation, and its negation."""
    customers = table(spark, sf, "customer").select(rdf.iri("r/customer/", F.col("c_custkey")).alias("a"))
    relations = relation_table(spark, sf)
    aliases = {"?w1": "?g1", "?g1": "?a", "?w2": "?g2", "?g2": "?b"}
    function = P.FUNCTION_BASE + "sfWithin"
    yes = P.spatial(customers, relations, function, "?w1", (P.SHORT_BASE + "buffer", "?w2"), aliases, unique=True)
    no = P.spatial(customers, relations, function, "?w1", "?w2", aliases, negated=True)
    return P.union(yes.withColumn("found", F.lit("yes")), no.withColumn("found", F.lit("no")))


SQL_SEG = """sg AS (SELECT id // 10 AS line, id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS "by" FROM pt WINDOW w AS (PARTITION BY id // 10 ORDER BY id) QUALIFY bx IS NOT NULL)"""


@CAT.add("src_15", f"WITH {SQL_XY}, {SQL_SEG} SELECT line, (id % 10)::INTEGER AS seg, ax, ay, bx, \"by\" FROM sg")
def src_15(spark, sf):
    """Coast lines → segment table."""
    return readers.segments(coast_lines(spark, sf))


def boxes(spark, sf, half=10):
    x, y = F.col("x"), F.col("y")
    b = F.struct((x - half).alias("xmin"), (y - half).alias("ymin"), (x + half).alias("xmax"), (y + half).alias("ymax"))
    return sites(spark, sf).select("id", b.alias("box"), "x", "y")


SQL_CLIP = f"""{SQL_XY}, {SQL_SEG}, cl AS (SELECT b.id, b.x - 2 AS x0, b.x + 2 AS x1, b.y - 2 AS y0, b.y + 2 AS y1, ax, ay, s.bx - ax AS dx, s."by" - ay AS dy FROM bx b, sg s),
ti AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END WHEN dx > 0 THEN (x0 - ax) / dx ELSE (x1 - ax) / dx END AS ex,
 CASE WHEN dx = 0 THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 1 ELSE -1 END WHEN dx > 0 THEN (x1 - ax) / dx ELSE (x0 - ax) / dx END AS lx,
 CASE WHEN dy = 0 THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END WHEN dy > 0 THEN (y0 - ay) / dy ELSE (y1 - ay) / dy END AS ey,
 CASE WHEN dy = 0 THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 1 ELSE -1 END WHEN dy > 0 THEN (y1 - ay) / dy ELSE (y0 - ay) / dy END AS ly FROM cl)"""


@CAT.add("jn_11", f"WITH {SQL_CLIP} SELECT DISTINCT id FROM ti WHERE greatest(0, ex, ey) <= least(1, lx, ly)")
def jn_11(spark, sf):
    """Which small boxes does a coast line touch."""
    return S.meets_coast(boxes(spark, sf, 2), readers.segments(coast_lines(spark, sf)))


def corner_points():
    x, y = F.col("x"), F.col("y")
    return F.array(G.point(x + 1, y - 1), G.point(x + 1, y + 1), G.point(x - 1, y + 1), G.point(x - 1, y - 1), G.point(x, y))


SQL_DIST = f"""{SQL_XY}, {SQL_SEG},
lb AS (SELECT id // 10 AS line, min(x) AS lx0, max(x) AS lx1, min(y) AS ly0, max(y) AS ly1 FROM pt GROUP BY line),
ps AS (SELECT id, x, y, unnest([1, 1, -1, -1, 0]) AS ox, unnest([-1, 1, 1, -1, 0]) AS oy FROM bx),
d AS (SELECT ps.id, s.line, ps.ox, ps.oy, ps.x + ps.ox AS px, ps.y + ps.oy AS py, s.ax, s.ay, s.bx - s.ax AS dx, s."by" - s.ay AS dy
 FROM ps JOIN lb ON lx0 <= ps.x + 10 AND lx1 >= ps.x - 10 AND ly0 <= ps.y + 10 AND ly1 >= ps.y - 10 JOIN sg s ON s.line = lb.line),
t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM d),
m AS (SELECT id, line, ox, oy, py, min(sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)) AS dist FROM t GROUP BY ALL),
f AS (SELECT id, min(dist) AS lo, max(dist) AS hi, arg_min(py, dist * 1e6 + py) AS lat FROM m GROUP BY id)"""


@CAT.add(
    "jn_12",
    f"WITH {SQL_DIST} SELECT id, round(lo, 6) AS min_deg, round(hi, 6) AS max_deg FROM f",
)
def jn_12(spark, sf):
    """Least and greatest distance of box points to the candidate coast lines."""
    images = boxes(spark, sf).withColumn("points", corner_points())
    return S.coast_distances(images, coast_lines(spark, sf)).select("id", rounded("min_deg"), rounded("max_deg"))


@CAT.add(
    "cnd_04",
    f"WITH {SQL_DIST} SELECT bx.id, CASE WHEN round(lo, 6) < 0.5 THEN 'harbor' WHEN lo IS NOT NULL THEN 'coast' END AS place FROM bx LEFT JOIN f ON f.id = bx.id",
)
def cnd_04(spark, sf):
    """Harbour or coast by the least distance; the limit is half a degree here."""
    images = boxes(spark, sf).withColumn("points", corner_points())
    near = S.coast_distances(images, coast_lines(spark, sf)).select("id", rounded("min_deg"))
    return images.select("id").join(near, "id", "left").select("id", S.place_of(F.col("min_deg"), 0.5).alias("place"))


SQL_KM = "2 * 6371.0088 * asin(sqrt(least(1, sin(radians({b}.y - {a}.y) / 2) ** 2 + cos(radians({a}.y)) * cos(radians({b}.y)) * sin(radians({b}.x - {a}.x) / 2) ** 2)))"


def others(spark, sf):
    return sites(spark, sf).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))


@CAT.add(
    "jn_24",
    f"""WITH {SQL_XY}, j AS (SELECT pt.id, bx.id AS other, {SQL_KM.format(a='pt', b='bx')} AS km FROM pt, bx) SELECT id, other, round(km, 4) AS km FROM j WHERE km <= 500""",
)
def jn_24(spark, sf):
    """Customer and supplier pairs within 500 km."""
    return S.within_km(points(spark, sf).select("id", "x", "y"), others(spark, sf), 500.0).select("id", "other", F.round("km", 4).alias("km"))


@CAT.add(
    "jn_24_direction",
    f"""WITH {SQL_XY}, m AS (SELECT nation, max(x) AS hi, min(x) AS lo FROM bx GROUP BY nation)
SELECT pt.id, 'west' AS direction FROM pt JOIN m USING (nation) WHERE pt.x < hi UNION ALL SELECT pt.id, 'east' FROM pt JOIN m USING (nation) WHERE pt.x > lo""",
)
def jn_24_direction(spark, sf):
    """Customers west (east) of some supplier of their nation."""
    left = points(spark, sf).select("id", "nation", "x")
    right = sites(spark, sf).select("nation", F.col("x").alias("ox"))
    both = [S.beside(left, right, "nation", d).select("id", F.lit(d).alias("direction")) for d in ("west", "east")]
    return both[0].unionByName(both[1])


@CAT.add(
    "top_08",
    f"""WITH {SQL_XY}, j AS (SELECT pt.id, bx.id AS other, round({SQL_KM.format(a='pt', b='bx')}, 6) AS km FROM pt, bx)
SELECT id, other, round(km, 4) AS km FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, other) = 1""",
)
def top_08(spark, sf):
    """Nearest supplier of every customer."""
    near = S.nearest_entity(points(spark, sf).select("id", "x", "y"), others(spark, sf))
    return near.select("id", "other", F.round("km", 4).alias("km"))
