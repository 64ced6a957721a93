"""Planar geometry as column expressions.

A geometry is ``ARRAY<ARRAY<STRUCT<x,y>>>``: one ring or line per entry. Points
have one ring of one point.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .arrays import let

RINGS = "array<array<struct<x:double,y:double>>>"
EARTH_RADIUS = 6378137.0
# fixed values: grid cell → side of the image
SIDE_OF_CELL = {
    0: "upper-left",
    1: "upper",
    2: "upper-right",
    3: "left",
    4: "center",
    5: "right",
    6: "lower-left",
    7: "lower",
    8: "lower-right",
}
# up to three levels of parentheses, read without going back
_BODY = r"\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)"
_SIMPLE = "MULTIPOLYGON|MULTILINESTRING|MULTIPOINT|POLYGON|LINESTRING|POINT"
MEMBER = rf"(?i)({_SIMPLE})\s*(?:ZM|Z|M)?\s*({_BODY}|EMPTY)"
ALONE = rf"(?i)^({_SIMPLE})\s*(?:ZM|Z|M)?\s*({_BODY}|EMPTY)\s*$"
COLLECTION = r"(?i)^GEOMETRYCOLLECTION\b"
# what is left of a collection once its members are gone
_FRAME = r"(?i)^(?:GEOMETRYCOLLECTION\s*(?:ZM|Z|M)?|EMPTY|[\s,()])*+$"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_VERTEX = rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*+"
PART = f"struct<kind:string,rings:{RINGS}>"
# one ring without anything unusual: its vertices are read without nested texts
_PAIR = rf"{_NUMBER} {_NUMBER}"
_PLAIN = rf'^"?POLYGON ?\(\(({_PAIR}(?:, ?{_PAIR})*+)\)\)"?$'


def point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _bare(wkt):
    """The text without quotes, CRS tag, datatype and blanks around it."""
    return F.regexp_replace(F.regexp_replace(wkt, r'^\s*"?\s*(?:<[^>]*>)?\s*', ""), r'\s*"?\s*(?:\^\^<[^>]*>|@[\w-]+)?\s*$', "")


def _members(text):
    """``(kind, body)`` of every simple geometry of a bare text."""
    kinds = F.regexp_extract_all(text, F.lit(MEMBER), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(MEMBER), F.lit(2))
    return F.arrays_zip(F.transform(kinds, F.upper).alias("kind"), bodies.alias("body"))


def _coordinates(name, body):
    """The member's coordinates as texts, always as polygons of rings of points: the kind tells how many levels are missing."""
    nested = F.translate(F.regexp_replace(body, _VERTEX, '{"$1","$2"}'), "(){}", "[][]")
    lines = name.isin("POLYGON", "MULTILINESTRING") | ((name == "MULTIPOINT") & body.rlike(r"^\(\s*\("))
    levels = F.when(name == "MULTIPOLYGON", "").when(lines, "[").otherwise("[[")
    return F.from_json(F.concat(levels, nested, F.translate(levels, "[", "]")), "array<array<array<array<string>>>>")


def _line(pairs):
    return F.transform(pairs, lambda c: point(c[0].try_cast("double"), c[1].try_cast("double")))


def _parts(member):
    """The member's points, lines and polygons, each with its rings; null where its text is no geometry."""
    name, body = member["kind"], member["body"]

    def part(kind_name, rings):
        return F.struct(F.lit(kind_name).alias("kind"), rings.alias("rings"))

    def own(polygons):
        each = lambda kind_name: F.transform(polygons, lambda rings: part(kind_name, rings))
        lines = lambda kind_name: F.transform(polygons[0], lambda line: part(kind_name, F.array(line)))
        points = F.transform(polygons[0], lambda line: F.transform(line, lambda v: part("POINT", F.array(F.array(v)))))
        return (
            F.when(name == "POINT", each("POINT"))
            .when(name == "LINESTRING", each("LINESTRING"))
            .when(name == "MULTILINESTRING", lines("LINESTRING"))
            .when(name == "MULTIPOINT", F.flatten(points))
            .otherwise(each("POLYGON"))
        )

    def sound(parts):
        broken = F.exists(parts, lambda p: p["rings"].isNull() | F.exists(p["rings"], lambda r: r.isNull() | F.exists(r, lambda v: v["x"].isNull() | v["y"].isNull())))
        return F.when(~broken, parts)

    read = let(F.transform(_coordinates(name, body), lambda rings: F.transform(rings, _line)), lambda polygons: let(own(polygons), sound))
    return F.when(F.upper(body) == "EMPTY", F.array().cast(f"array<{PART}>")).otherwise(read)


def kind(wkt):
    """The geometry kind in capitals; null for anything that is no WKT of the seven kinds."""
    return geometry(wkt)["kind"]


def geometry(wkt):
    """``struct(kind, parts)`` of a WKT text of any of the seven kinds, in any case, with or without quotes, CRS tag and
    datatype; third and fourth coordinates are left out, EMPTY has no parts, nested collections are flattened.

    Null when the text as a whole is no such geometry, so callers can put the row aside.
    """

    def told(kind_name, members, sound):
        def whole(parts):
            return F.when(~F.exists(parts, lambda p: p.isNull()), F.struct(kind_name.alias("kind"), F.flatten(parts).alias("parts")))

        return F.when(sound, let(F.transform(members, _parts), whole))

    def of(bare):
        collection = let(_members(bare), lambda m: told(F.lit("GEOMETRYCOLLECTION"), m, F.regexp_replace(bare, MEMBER, "").rlike(_FRAME)))
        name, body = F.upper(F.regexp_extract(bare, ALONE, 1)), F.regexp_extract(bare, ALONE, 2)
        single = let(F.struct(name.alias("kind"), body.alias("body")), lambda m: told(m["kind"], F.array(m), m["kind"] != ""))
        return F.when(bare.rlike(COLLECTION), collection).otherwise(single)

    return let(_bare(wkt), of)


def parse_wkt(wkt):
    """All rings, lines and points of a WKT text, one after the other; null when it is no geometry."""
    return F.flatten(F.transform(geometry(wkt)["parts"], lambda p: p["rings"]))


def number_text(x):
    """Coordinate text without a trailing ``.0``."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e7), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def ring_text(ring):
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", number_text(p["x"]), number_text(p["y"]))), ", ")


def to_wkt(rings, shape):
    """WKT of the rings; ``shape`` is a column with the geometry kind."""
    parts = F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), ring_text(r), F.lit(")"))), ", ")
    each = F.array_join(F.transform(rings, lambda r: F.concat(F.lit("(("), ring_text(r), F.lit("))"))), ", ")
    return (
        F.when(shape.isin("POINT", "LINESTRING"), F.concat(shape, F.lit(" "), parts))
        .when(shape.isin("POLYGON", "MULTILINESTRING", "MULTIPOINT"), F.concat(shape, F.lit(" ("), parts, F.lit(")")))
        .when(shape == "MULTIPOLYGON", F.concat(F.lit("MULTIPOLYGON ("), each, F.lit(")")))
    )


def _points(coordinates):
    return F.transform(coordinates, lambda c: point(c[0], c[1]))


def _geojson(geojson, body):
    """``body(type, polygons)`` of a GeoJSON geometry text; its coordinates are read once, as polygons whatever the type."""

    def read(told):
        shape, raw = told["type"], told["coordinates"]
        lines = shape.isin("Polygon", "MultiLineString")
        levels = F.when(shape == "MultiPolygon", "").when(lines, "[").when(shape.isin("LineString", "MultiPoint"), "[[").when(shape == "Point", "[[[")
        nested = F.from_json(F.concat(levels, raw, F.translate(levels, "[", "]")), "array<array<array<array<double>>>>")
        return let(nested, lambda polygons: body(shape, polygons))

    return let(F.struct(F.get_json_object(geojson, "$.type").alias("type"), F.get_json_object(geojson, "$.coordinates").alias("coordinates")), read)


def _all_rings(shape, polygons):
    each = F.flatten(F.transform(polygons, lambda p: F.transform(p, _points)))
    return F.when(shape == "MultiPoint", F.transform(polygons[0][0], lambda c: F.array(point(c[0], c[1])))).otherwise(each)


def geojson_rings(geojson):
    """Rings of a GeoJSON geometry text; null for a collection."""
    return _geojson(geojson, _all_rings)


def _simple_geojson_to_wkt(geojson):
    def ring(r):
        return F.concat(F.lit("("), ring_text(_points(r)), F.lit(")"))

    def text(shape, polygons):
        nested = F.transform(polygons, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")")))
        multi = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(nested, ", "), F.lit(")"))
        return F.when(shape == "MultiPolygon", multi).otherwise(let(_all_rings(shape, polygons), lambda rings: to_wkt(rings, F.upper(shape))))

    return _geojson(geojson, text)


def geojson_members(geojson):
    """The geometry texts of a GeoJSON collection."""
    return F.from_json(F.get_json_object(geojson, "$.geometries"), "array<string>")


def geojson_to_wkt(geojson):
    """GeoJSON geometry text of any kind → WKT text; null where it, or a member of the collection, is no geometry."""
    members = F.transform(geojson_members(geojson), _simple_geojson_to_wkt)
    collection = F.when(
        ~F.exists(members, lambda m: m.isNull()), F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(members, ", "), F.lit(")"))
    )
    return F.when(F.get_json_object(geojson, "$.type") == "GeometryCollection", collection).otherwise(_simple_geojson_to_wkt(geojson))


def line_from_geojson(geojson):
    """LineString → its points; Point → the point twice."""
    rings = geojson_rings(geojson)
    shape = F.get_json_object(geojson, "$.type")
    return F.when(shape == "Point", F.concat(rings[0], rings[0])).when(shape == "LineString", rings[0])


def _edges(ring, fn):
    """fn(p, next p) over the ring, the last point followed by the first."""
    shifted = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return let(ring, lambda r: F.zip_with(r, shifted(r), fn))


def signed_area(ring):
    crossed = _edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(crossed, F.lit(0.0), lambda acc, c: acc + c) * 0.5


def ring_area(ring):
    """Absolute shoelace area."""
    return F.abs(signed_area(ring))


def area(parts):
    """Area of a geometry's parts: the outer ring less the holes of each polygon; points and lines have none."""

    def less_holes(rings):
        holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda acc, a: acc + a)
        return F.when(F.size(rings) > 0, rings[0] - holes).otherwise(0.0)

    def of(part):
        return F.when(part["kind"] == "POLYGON", let(F.transform(part["rings"], ring_area), less_holes)).otherwise(0.0)

    return F.aggregate(F.transform(parts, of), F.lit(0.0), lambda acc, a: acc + a)


def wkt_area(wkt):
    """Area of a WKT geometry; null when the text is none."""

    def vertex(text):
        return point(F.substring_index(text, " ", 1).try_cast("double"), F.substring_index(text, " ", -1).try_cast("double"))

    def of(plain):
        ring = F.transform(F.split(plain, ","), lambda v: vertex(F.ltrim(v)))
        return F.when(plain != "", ring_area(ring)).otherwise(area(geometry(wkt)["parts"]))

    return let(F.regexp_extract(wkt, _PLAIN, 1), of)


def centroid(ring):
    """Area centroid; null for a degenerate ring."""
    parts = _edges(
        ring,
        lambda a, b: F.struct(
            (a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")
        ),
    )
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(
        parts,
        zero,
        lambda acc, e: F.struct(
            (acc["c"] + e["c"]).alias("c"), (acc["x"] + e["x"] * e["c"]).alias("x"), (acc["y"] + e["y"] * e["c"]).alias("y")
        ),
    )
    return let(sums, lambda s: F.when(s["c"] != 0, point(s["x"] / (3 * s["c"]), s["y"] / (3 * s["c"]))))


def flip_y(ring, height):
    return F.transform(ring, lambda p: point(p["x"], height - p["y"]))


def grid_cell(x, y, width, height):
    """Cell 0…8 of a 3 × 3 grid with half-open cells, null outside."""
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(inside, (F.floor(3 * x / width) + 3 * F.floor(3 * y / height)).cast("int"))


def side(cell):
    names = F.create_map(*[F.lit(v) for kv in SIDE_OF_CELL.items() for v in kv])
    return names[cell]


def degrees_to_metres(degrees, latitude):
    return degrees / 360.0 * 2 * math.pi * EARTH_RADIUS * F.cos(F.radians(latitude))


def distance(ax, ay, bx, by):
    return F.hypot(bx - ax, by - ay)


def pixel_to_map(row, col, affine):
    """Map coordinates of a pixel centre; ``affine`` is the six coefficients (a, b, c, d, e, f)."""
    a, b, c, d, e, f = affine
    return point(a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f)


def bounds(rings):
    """Bounding box ``struct(xmin, ymin, xmax, ymax)``."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def box_rings(xmin, ymin, xmax, ymax):
    """Rectangle as one closed ring: from the lower right corner, counter-clockwise."""
    return F.array(
        F.array(point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin), point(xmax, ymin))
    )


def thin_polygon(line):
    """A line walked forward and back as a closed polygon of zero width."""
    return F.concat(line, F.reverse(line), F.slice(line, 1, 1))


def ring_flags(ring):
    """Validity checks of a ring: closed, enough points, area, repeated neighbours."""
    n = F.size(ring)
    closed = (ring[0]["x"] == ring[n - 1]["x"]) & (ring[0]["y"] == ring[n - 1]["y"])
    nexts = F.slice(ring, 2, F.greatest(n - 1, F.lit(0)))
    repeats = F.exists(
        F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), nexts, lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])),
        lambda same: same,
    )
    return F.struct(
        closed.alias("closed"), (n >= 4).alias("enough_points"), (ring_area(ring) > 0).alias("has_area"), repeats.alias("repeats")
    )


def tidy_ring(ring):
    """Drop repeated neighbours and close the ring."""
    kept = F.filter(
        F.transform(ring, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda e: (e["i"] == 0)
        | (F.get(ring, e["i"] - 1)["x"] != e["p"]["x"])
        | (F.get(ring, e["i"] - 1)["y"] != e["p"]["y"]),
    )
    points = F.transform(kept, lambda e: e["p"])

    def close(ps):
        last = ps[F.size(ps) - 1]
        open_ring = (ps[0]["x"] != last["x"]) | (ps[0]["y"] != last["y"])
        return F.when(open_ring, F.concat(ps, F.slice(ps, 1, 1))).otherwise(ps)

    return let(points, close)


def haversine(lon1, lat1, lon2, lat2, radius=6371.0088):
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def point_segment_distance(px, py, ax, ay, bx, by):
    """Distance of a point to a segment; a segment may be a single point."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, length2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _inverse_tm(easting, northing, lon0, k0, false_e, false_n, a, inv_f):
    """Inverse transverse Mercator: (longitude, latitude) in degrees, Krüger series to n⁴."""
    f = 1 / inv_f
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # fixed values: published inverse series coefficients
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    xi = (northing - false_n) / (k0 * radius)
    eta = (easting - false_e) / (k0 * radius)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, 1):
        xi_p = xi_p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.lit(lon0) + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))
    return lon, F.degrees(lat)


def utm_to_lonlat(easting, northing, zone, north=True):
    """UTM (WGS 84) → longitude and latitude as a point."""
    lon, lat = _inverse_tm(easting, northing, zone * 6.0 - 183.0, 0.9996, 500000.0, 0.0 if north else 10000000.0, 6378137.0, 298.257223563)
    return point(lon, lat)


def greek_grid_to_lonlat(easting, northing):
    """EPSG:2100 → EPSG:4326 with the published three-parameter datum shift."""
    lon, lat = _inverse_tm(easting, northing, 24.0, 0.9996, 500000.0, 0.0, 6378137.0, 298.257222101)
    shift = (-199.87, 74.79, 246.62)
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)

    def shifted(p):
        la, lo = F.radians(p["y"]), F.radians(p["x"])
        v = a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
        return F.struct(
            (v * F.cos(la) * F.cos(lo) + shift[0]).alias("x"),
            (v * F.cos(la) * F.sin(lo) + shift[1]).alias("y"),
            (v * (1 - e2) * F.sin(la) + shift[2]).alias("z"),
        )

    wf = 1 / 298.257223563
    we2 = wf * (2 - wf)
    b = a * (1 - wf)
    ep2 = we2 / (1 - we2)

    def geodetic(c):
        rho = F.hypot(c["x"], c["y"])
        theta = F.atan2(c["z"] * a, rho * b)
        up = c["z"] + ep2 * b * F.pow(F.sin(theta), F.lit(3.0))
        out = rho - we2 * a * F.pow(F.cos(theta), F.lit(3.0))
        return point(F.degrees(F.atan2(c["y"], c["x"])), F.degrees(F.atan2(up, out)))

    return let(let(point(lon, lat), shifted), geodetic)


def reproject(rings, convert, lat_first=False):
    """Apply ``convert(x, y) -> point`` to every vertex; ``lat_first`` swaps the output axes."""

    def vertex(p):
        q = convert(p["x"], p["y"])
        return let(q, lambda r: point(r["y"], r["x"])) if lat_first else q

    return F.transform(rings, lambda ring: F.transform(ring, vertex))
