import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.functions import geometry as G
from terralens.operators import spatial as S
from terralens.sources.readers import segments

RNG = np.random.default_rng(3)


def rect(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def names_of_boxes(a, b):
    """Relations of two rectangles (x0, y0, x1, y1)."""
    lo, hi = (max(a[0], b[0]), max(a[1], b[1])), (min(a[2], b[2]), min(a[3], b[3]))
    if lo[0] > hi[0] or lo[1] > hi[1]:
        return set()
    if lo[0] == hi[0] or lo[1] == hi[1]:
        return {"Intersects", "Touches"}
    within = a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]
    contains = b[0] >= a[0] and b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3]
    found = {"Intersects"} | ({"Within"} if within else set()) | ({"Contains", "Covers"} if contains else set())
    return found | ({"Equals"} if within and contains else set() if within or contains else {"Overlaps"})


UNIT, BIG = rect(0, 0, 2, 2), rect(-1, -1, 5, 5)
INTO, OVER, SAME, MEET, CUT, LAP = (
    {"Intersects", "Within"}, {"Intersects", "Contains", "Covers"}, {"Intersects", "Equals", "Within", "Contains", "Covers"},
    {"Intersects", "Touches"}, {"Intersects", "Crosses"}, {"Intersects", "Overlaps"},
)
CASES = [
    (UNIT, BIG, INTO), (BIG, UNIT, OVER), (UNIT, UNIT, SAME), (UNIT, rect(2, 0, 4, 2), MEET), (UNIT, rect(1, 1, 4, 4), LAP), (UNIT, rect(7, 7, 9, 9), set()),
    (rect(-1, 0.5, 3, 1), rect(0.5, -1, 1, 3), LAP), ("POINT (1 1)", UNIT, INTO), ("POINT (2 1)", UNIT, MEET),
    (UNIT, "POINT (2 1)", MEET | {"Covers"}), (UNIT, "POINT (1 1)", OVER), ("LINESTRING (-1 1, 3 1)", UNIT, CUT),
    (UNIT, "LINESTRING (-1 1, 3 1)", CUT), ("LINESTRING (0.5 1, 1.5 1)", UNIT, INTO), ("LINESTRING (-1 0, 3 0)", UNIT, MEET),
    ("LINESTRING (0 0, 2 0)", UNIT, MEET), (UNIT, "LINESTRING (0 0, 2 0)", MEET | {"Covers"}), ("LINESTRING (0 0, 2 2)", UNIT, INTO),
    ("LINESTRING (-1 0, 1 2)", "LINESTRING (-1 2, 1 0)", CUT), ("LINESTRING (0 0, 1 1)", "LINESTRING (1 1, 2 0)", MEET),
    ("LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 3 0)", LAP), ("LINESTRING (1 0, 2 0)", "LINESTRING (0 0, 3 0)", INTO),
    ("LINESTRING (0 0, 2 0)", "LINESTRING (0 0, 1 0, 2 0)", SAME), ("LINESTRING (0 0, 2 0)", "LINESTRING (0 5, 2 5)", set()),
    ("POINT (0 0)", "LINESTRING (0 0, 2 0)", MEET), ("POINT (1 0)", "LINESTRING (0 0, 2 0)", INTO), ("POINT (0 0)", "LINESTRING (0 0, 1 0, 1 1, 0 0)", INTO),
    ("LINESTRING (1 -1, 1 0)", "LINESTRING (0 0, 2 0)", MEET), ("LINESTRING (1 -1, 1 1)", "LINESTRING (0 0, 2 0)", CUT),
    # many points
    ("MULTIPOINT (0.5 0.5, 1 1)", UNIT, INTO), ("MULTIPOINT (0.5 0.5, 9 9)", UNIT, CUT), ("MULTIPOINT (0 0, 2 2)", UNIT, MEET),
    ("MULTIPOINT (1 1, 3 3)", "MULTIPOINT (1 1, 4 4)", LAP), ("MULTIPOINT (1 1, 3 3)", "MULTIPOINT ((3 3), (1 1))", SAME), ("POINT (3 3)", "MULTIPOINT (1 1, 3 3)", INTO),
    ("MULTIPOINT (1 1, 3 3)", "POINT (5 5)", set()), (UNIT, "MULTIPOINT (0.5 0.5, 9 9)", CUT), ("MULTIPOINT (1 0, 5 5)", "LINESTRING (0 0, 2 0)", CUT),
    # many lines: the end that two of them share is no boundary
    ("MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))", "LINESTRING (0 0, 2 0)", SAME), ("POINT (1 0)", "MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))", INTO),
    ("MULTILINESTRING ((0.5 0.5, 1 1), (3 3, 4 4))", UNIT, CUT), ("MULTILINESTRING ((3 3, 4 4), (5 0, 6 0))", UNIT, set()),
    # many areas
    (f"MULTIPOLYGON ({UNIT[8:]}, {rect(10, 10, 12, 12)[8:]})", UNIT, OVER), (UNIT, f"MULTIPOLYGON ({UNIT[8:]}, {rect(10, 10, 12, 12)[8:]})", INTO),
    (f"MULTIPOLYGON ({UNIT[8:]}, {rect(2, 0, 4, 2)[8:]})", rect(1, 0, 3, 2), OVER),
    # two halves make a whole
    (f"MULTIPOLYGON ({rect(0, 0, 1, 2)[8:]}, {rect(1, 0, 2, 2)[8:]})", rect(0.5, 0.5, 1.5, 1.5), OVER),
    # collections, of one dimension and of several
    ("GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0.5 0.5, 1.5 0.5))", UNIT, INTO), ("GEOMETRYCOLLECTION (POINT (9 9), LINESTRING (0.5 0.5, 1.5 0.5))", UNIT, CUT),
    (f"GEOMETRYCOLLECTION ({UNIT}, POINT (9 9))", UNIT, OVER), (UNIT, f"GEOMETRYCOLLECTION ({rect(1, 1, 4, 4)}, POINT (9 9))", LAP),
    (f"GEOMETRYCOLLECTION ({UNIT}, POINT (9 9))", "POINT (9 9)", OVER), ("GEOMETRYCOLLECTION (POINT (50 50), POINT (7 7))", UNIT, set()),
    # holes, also one along the outer ring and a lake with an island
    ("POINT (5 1)", "POLYGON ((0 0, 9 0, 9 9, 0 0), (4 0, 6 0, 5 2, 4 0))", set()), ("POINT (8 1)", "POLYGON ((0 0, 9 0, 9 9, 0 0), (4 0, 6 0, 5 2, 4 0))", INTO),
    ("POINT (5 5)", f"MULTIPOLYGON (({rect(0, 0, 10, 10)[9:-1]}, {rect(2, 2, 8, 8)[9:-1]}), ({rect(4, 4, 6, 6)[9:-1]}))", INTO),
    ("POINT (3 3)", f"MULTIPOLYGON (({rect(0, 0, 10, 10)[9:-1]}, {rect(2, 2, 8, 8)[9:-1]}), ({rect(4, 4, 6, 6)[9:-1]}))", set()),
    # a ring that is not closed, and texts with third coordinates
    ("POINT (1 0.5)", "POLYGON ((0 0, 2 0, 2 2))", INTO), ("POINT Z (1 1 7)", UNIT, INTO),
]


@pytest.fixture(scope="module")
def related_cases(spark):
    """Every case at once: all pairs of the layers, of which each case looks at its own."""
    layers = []
    for side in (0, 1):
        rows = [(i, c[side]) for i, c in enumerate(CASES)]
        layers.append(S.prepare(spark.createDataFrame(rows, "id bigint, wkt string"), "id", "wkt").withColumn("plain", F.lit(False)))
    found = {i: set() for i in range(len(CASES))}
    for r in S.relation_pairs(*layers).filter("s = o").collect():
        found[r["s"]].add(r["rel"].removeprefix("sf"))
    return found


@pytest.mark.parametrize("case", range(len(CASES)))
def test_relations_of_all_kinds(related_cases, case):
    assert related_cases[case] == CASES[case][2], CASES[case]


def test_relations_run_without_python(spark):
    layer = S.prepare(spark.createDataFrame([(1, UNIT), (2, "LINESTRING (0 0, 5 5)")], "id bigint, wkt string"), "id", "wkt")
    plan = S.relation_pairs(layer, layer)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_literal_is_parsed_once(spark):
    plan = spark.createDataFrame([(UNIT,)], "w string").select(G.wkt_area(F.col("w")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 4


def test_a_long_ring_is_spread_over_strips(spark):
    """A coast of 4,000 vertices: its rows are many and short, and points and lines are placed right."""
    n = 4000
    ring = [(100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    text = ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]])
    rng = np.random.default_rng(4)
    points = [(float(x), float(y)) for x, y in rng.uniform(-110, 110, (300, 2))]
    rows = [(i, f"POINT ({x!r} {y!r})") for i, (x, y) in enumerate(points)]
    rows += [(1000, "LINESTRING (0 0, 150 0)"), (1001, "LINESTRING (-50 3, 50 3)"), (1002, rect(-10, -10, 10, 10)), (1003, rect(-200, -200, 200, 200))]
    left = S.prepare(spark.createDataFrame(rows, "id bigint, wkt string"), "id", "wkt")
    right = S.prepare(spark.createDataFrame([(0, f"POLYGON (({text}))")], "id bigint, wkt string"), "id", "wkt")
    got = {}
    for r in S.relation_pairs(left, right).collect():
        got.setdefault(r["s"], set()).add(r["rel"].removeprefix("sf"))
    inside = {i for i, (x, y) in enumerate(points) if math.hypot(x, y) < 99.9}
    outside = {i for i, (x, y) in enumerate(points) if math.hypot(x, y) > 100.1}
    assert all(got[i] == INTO for i in inside) and not outside & set(got)
    assert got[1000] == CUT and got[1001] == INTO and got[1002] == INTO and got[1003] == OVER


def boxes(spark, n, side, seed):
    r = np.random.default_rng(seed)
    data = [(i, f"POLYGON (({x} {y}, {x+w} {y}, {x+w} {y+h}, {x} {y+h}, {x} {y}))") for i, (x, y, w, h) in enumerate(zip(*[r.integers(0, 60, n) for _ in range(2)], *[r.integers(1, side, n) for _ in range(2)]))]
    return data, S.prepare(spark.createDataFrame(data, "id bigint, wkt string"), "id", "wkt")


@pytest.mark.parametrize("hot", [10**9, 3])
def test_fast_and_general_relations_agree_with_brute_force(spark, hot):
    """The rectangle path, the tile join (coarse and refined) and the general predicate give one answer."""
    d1, left = boxes(spark, 60, 15, 1)
    d2, right = boxes(spark, 60, 15, 2)

    def bounds(wkt):
        corners = [[float(v) for v in p.split()] for p in wkt[wkt.index("((") + 2 : -2].split(",")]
        return (*map(min, zip(*corners)), *map(max, zip(*corners)))

    want = {(i, "sf" + n, j) for i, a in d1 for j, b in d2 for n in names_of_boxes(bounds(a), bounds(b))}
    got = {tuple(r) for r in S.relation_pairs(left, right, size=10.0, hot_pairs=hot).collect()}
    assert got == want
    slow = S.relation_pairs(left.withColumn("plain", F.lit(False)), right, size=10.0, hot_pairs=hot)
    assert {tuple(r) for r in slow.collect()} == want


def box_rows(spark, rows, side):
    """``rows`` of (id, x, y, half)."""
    data = [(i, (x - h, y - h, x + h, y + h)) for i, x, y, h in rows]
    return spark.createDataFrame(data, f"{side}_g bigint, box struct<xmin:double,ymin:double,xmax:double,ymax:double>")


def touching(left, right):
    return {(i, j) for i, x, y, h in left for j, a, b, k in right if abs(x - a) <= h + k and abs(y - b) <= h + k}


def test_a_crowded_spot_is_cut_until_no_cell_is(spark):
    """Nine tenths of the boxes stand within a tenth of a degree; no cell keeps more pairs than allowed."""
    rng = np.random.default_rng(12)
    spots = [np.column_stack([rng.uniform(3, 3.1, 450), rng.uniform(7, 7.1, 450)]), rng.uniform(-80, 80, (50, 2))]
    rows = [[(i, float(x), float(y), 2e-5) for i, (x, y) in enumerate(np.vstack(spots) + shift)] for shift in (0.0, 1e-5)]
    left, right = box_rows(spark, rows[0], "l"), box_rows(spark, rows[1], "r")
    loads = []
    for l, r, keys, _ in S.cells(left, right, 10.0, hot_pairs=500):
        n = l.groupBy(*keys).count().withColumnRenamed("count", "n").join(r.groupBy(*keys).count(), keys)
        loads += [row["n"] * row["count"] for row in n.collect()]
    assert max(loads) <= 500 and sum(loads) < 450 * 450 / 10
    got = [tuple(r) for r in S.candidate_pairs(left, right, 10.0, hot_pairs=500).select("l_g", "r_g").collect()]
    assert len(got) == len(set(got)) and set(got) == touching(*rows)


def test_large_boxes_on_one_spot_are_dealt_out_instead(spark):
    rng = np.random.default_rng(13)
    rows = [[(i, float(x), float(y), 4.0) for i, (x, y) in enumerate(rng.uniform(4, 6, (120, 2)))] for _ in "lr"]
    left, right = box_rows(spark, rows[0], "l"), box_rows(spark, rows[1], "r")
    found = S.cells(left, right, 10.0, hot_pairs=1000)
    assert found[-1][2] == ["tx", "ty", "part"] and found[-1][0].count() <= 2 * left.count() * 4
    got = [tuple(r) for r in S.candidate_pairs(left, right, 10.0, hot_pairs=1000).select("l_g", "r_g").collect()]
    assert len(got) == len(set(got)) and set(got) == touching(*rows)


def test_copies_of_a_geometry_all_get_their_pairs(spark):
    pts = spark.createDataFrame([(i, "POINT (1 1)") for i in range(500)] + [(500, "POINT (40 40)")], "id bigint, wkt string")
    area = spark.createDataFrame([(i, "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))") for i in range(3)], "id bigint, wkt string")
    got = S.relation_pairs(S.prepare(pts, "id", "wkt"), S.prepare(area, "id", "wkt"), relations=("sfWithin",), hot_pairs=2)
    assert got.count() == 1500


def km(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def places(n, seed):
    r = np.random.default_rng(seed)
    pts = np.column_stack([r.uniform(-180, 180, n), r.uniform(-90, 90, n)])
    pts[:4] = [(179.9, 10), (-179.9, 10), (0, 89.9), (120, 89.95)]
    return pts


def test_within_km_wraps_and_reaches_the_poles(spark):
    a, b = places(150, 7), places(150, 8)
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id bigint, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "other bigint, ox double, oy double")
    for limit in (30.0, 1500.0):
        want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if km(p, q) <= limit}
        got = [(r["id"], r["other"]) for r in S.within_km(left, right, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = {r["id"]: (r["other"], r["km"]) for r in S.nearest_entity(left, right).collect()}
    for i, p in enumerate(a):
        d, j = min((round(km(p, q), 6), j) for j, q in enumerate(b))
        assert near[i][0] == j and near[i][1] == pytest.approx(d, abs=1e-5)


def test_places_of_many_members_are_spread_and_crowded_tiles_dealt(spark):
    r = np.random.default_rng(5)
    a = [(i % 50 or None, *map(float, p)) for i, p in enumerate(np.repeat(r.integers(0, 4, (30, 2)), 40, axis=0))]
    b = [(i, *map(float, p)) for i, p in enumerate(r.integers(0, 4, (200, 2)))]
    left = spark.createDataFrame(a, "id bigint, x double, y double")
    right = spark.createDataFrame(b, "other bigint, ox double, oy double")
    want = sorted((i or 0, x, y, j) for i, x, y in a for j, ox, oy in b if km((x, y), (ox, oy)) <= 150)
    got = S.within_km(left, right, 150.0, hot_pairs=7)
    assert got.columns == ["id", "x", "y", "other", "ox", "oy", "km"]
    assert sorted((r["id"] or 0, r["x"], r["y"], r["other"]) for r in got.collect()) == want


def test_each_relation_once_for_ids_that_repeat(spark):
    rows = [(1, "POINT (1 1)"), (1, "POINT (1 1)"), (1, "POINT (2 2)"), (2, "POINT (1 1)"), (None, "POINT (1 1)"), (None, "POINT (1 1)")]
    left = S.prepare(spark.createDataFrame(rows, "id bigint, wkt string"), "id", "wkt")
    right = S.prepare(spark.createDataFrame([(7, "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))")] * 2, "id bigint, wkt string"), "id", "wkt")
    every = S.relation_pairs(left, right, relations=("sfWithin",)).collect()
    once = S.relation_pairs(left, right, relations=("sfWithin",), distinct=True).collect()
    assert len(every) == 12 and len(once) == len(set(every)) and set(once) == set(every)
    named = S.relation_pairs(left.filter("id = 2"), right, relations=("sfWithin",), distinct=True)
    assert [tuple(r) for r in named.collect()] == [(2, "sfWithin", 7)]


def test_crowds_meet_in_blocks_that_a_task_holds_easily(spark, monkeypatch):
    blocks, keep = [], S._met
    monkeypatch.setattr(S, "_met", lambda *a: blocks.append(keep(*a)) or blocks[-1])
    spots = spark.range(3000).select("id", F.lit("POINT (1 1)").alias("wkt")).union(spark.createDataFrame([(7, "POINT (1 1)"), (None, "POINT (9 9)")], "id bigint, wkt string"))
    areas = spark.range(500).select("id", F.lit("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))").alias("wkt"))
    told = S.relation_pairs(S.prepare(spots, "id", "wkt"), S.prepare(areas, "id", "wkt")).groupBy("rel").agg(F.count(F.lit(1)), F.sum("s"), F.sum("o"), F.count("s"))
    each, ids = 500 * (2999 * 3000 // 2 + 7), 499 * 500 // 2
    assert {r[0]: tuple(r)[1:] for r in told.collect()} == {
        "sfWithin": (3001 * 500, each, 3001 * ids, 3001 * 500), "sfTouches": (500, None, ids, 0), "sfIntersects": (3002 * 500, each, 3002 * ids, 3001 * 500),
    }
    assert max(blocks[0].agg(F.max(F.size("_l")), F.max(F.size("_r"))).first()) < 256



def test_long_segments_meet_boxes_by_their_pieces(spark):
    r = np.random.default_rng(9)
    ends = [tuple(map(float, p)) for p in r.uniform(-150, 150, (25, 4))] + [(5.0, 5.0, 5.0, 5.0), (-20.0, 0.0, 20.0, 0.0)]
    seg = spark.createDataFrame(ends, "ax double, ay double, bx double, by double")
    boxes = [(i, (x, y, x + 2.0, y + 2.0)) for i, (x, y) in enumerate(map(lambda p: tuple(map(float, p)), r.integers(-30, 30, (200, 2))))]
    images = spark.createDataFrame(boxes + [(500, boxes[0][1])], "id bigint, box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    shape = F.struct("ax", "ay", "bx", "by")
    want = {r["id"] for r in images.crossJoin(seg).filter(S.segment_meets_box(shape, F.col("box"))).collect()}
    assert {r["id"] for r in S.meets_coast(images, seg).collect()} == want and len(want) > 10
    assert S.pieces(seg, 10.0).filter("box.xmax - box.xmin > 10.1 or box.ymax - box.ymin > 10.1").isEmpty()


def test_coast(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(3.0, 3.0)])], "line bigint, points array<struct<x:double,y:double>>")
    imgs = [(1, (4.0, -1.0, 6.0, 1.0), [(5.0, 2.0), (5.0, 1.0)]), (2, (20.0, 20.0, 21.0, 21.0), [(20.5, 20.5)]), (3, (9.0, 1.0, 12.0, 4.0), [(9.0, 1.0)])]
    images = spark.createDataFrame(imgs, "id bigint, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, points array<struct<x:double,y:double>>")
    assert [r["id"] for r in S.meets_coast(images, segments(line)).collect()] == [1]
    d = {r["id"]: r for r in S.coast_distances(images, line).collect()}
    assert set(d) == {1} and d[1]["min_deg"] == 1.0 and d[1]["max_deg"] == 2.0
    assert d[1]["min_m"] == pytest.approx(1 / 360 * 2 * math.pi * 6378137 * math.cos(math.radians(1)))


def test_coast_distances_of_blocks_match_every_pair(spark):
    r = np.random.default_rng(3)
    points = "array<struct<x:double,y:double>>"
    lines = [(i, [tuple(map(float, p)) for p in r.uniform(-20, 20, 2) + r.uniform(-6, 6, (int(r.integers(1, 5)), 2))]) for i in range(60)]
    lines += [(7, [(0.0, 0.0), (1.0, 1.0)]), (61, lines[0][1]), (None, [(2.0, 2.0), (3.0, 2.0)])]
    images = []
    for i in range(90):
        x, y = map(float, r.uniform(-20, 20, 2))
        images.append((i, (x - 3, y - 3, x + 3, y + 3), [(x, y), (x + 1, y - 1)]))
    images.append((90, *images[0][1:]))

    def far(p, line):
        ends = list(zip(line, line[1:])) or [(line[0], line[0])]
        out = []
        for (ax, ay), (bx, by) in ends:
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            out.append(math.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy))
        return min(out)

    want = {}
    for i, (x0, y0, x1, y1), pts in images:
        of_line = {}
        for name, line in lines:
            xs, ys = zip(*line)
            if min(xs) <= x1 and max(xs) >= x0 and min(ys) <= y1 and max(ys) >= y0:
                of_line.setdefault(name, []).append(line)
        d = [min(far(p, line) for line in own) for own in of_line.values() for p in pts]
        if d:
            want[i] = (min(d), max(d))
    table = spark.createDataFrame(images, f"id bigint, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, points {points}")
    coast = spark.createDataFrame(lines, f"line bigint, points {points}")
    found = S.coast_distances(table, coast, size=5.0, image_block=20, segment_block=30)
    got = {r["id"]: (r["min_deg"], r["max_deg"]) for r in found.collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


def test_directions(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 9.0), (3, "b", 1.0)], "id bigint, g string, x double")
    right = spark.createDataFrame([("a", 7.0), ("a", 8.0)], "g string, ox double")
    assert [r["id"] for r in S.beside(left, right, "g", "west").collect()] == [1]
    assert [r["id"] for r in S.beside(left, right, "g", "east").collect()] == [2]


@pytest.mark.parametrize(
    "text",
    ["POINT (1 2)", "LINESTRING (0 0, 1.5 2, 3 3)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"],
)
def test_wkt_round_trip(spark, text):
    df = spark.createDataFrame([(f'"<http://crs> {text}"^^<t>',)], "w string")
    assert df.select(G.to_wkt(G.parse_wkt(F.col("w")), G.kind(F.col("w"))).alias("w")).first()["w"] == text


def test_unsupported_wkt_is_null(spark):
    df = spark.createDataFrame([("CURVE (1 2)",)], "w string")
    assert df.select(G.parse_wkt(F.col("w")).alias("w"), G.kind(F.col("w")).alias("k")).first() == (None, None)


def test_projections_at_known_points(spark):
    p = spark.range(1).select(
        G.utm_to_lonlat(F.lit(500000.0), F.lit(4649776.22482), 33).alias("u"),
        G.greek_grid_to_lonlat(F.lit(476216.0), F.lit(4202434.0)).alias("g"),
    ).first()
    assert p["u"]["x"] == pytest.approx(15.0) and p["u"]["y"] == pytest.approx(42.0, abs=1e-7)
    assert p["g"]["x"] == pytest.approx(23.73, abs=0.02) and p["g"]["y"] == pytest.approx(37.97, abs=0.02)


def test_merge_lines():
    seg = lambda *ps: [{"x": x, "y": y} for x, y in ps]
    merged = S._merged([seg((0, 0), (1, 1)), seg((2, 2), (1, 1)), seg((2, 2), (3, 3)), seg((9, 9), (8, 8)), seg((5, 5), (5, 5))])
    assert [[(p["x"], p["y"]) for p in line] for line in merged] == [[(0, 0), (1, 1), (2, 2), (3, 3)], [(9, 9), (8, 8)]]
    star = S._merged([seg((0, 0), (1, 0)), seg((0, 0), (0, 1)), seg((0, 0), (-1, 0))])
    assert len(star) == 3
    loop = S._merged([seg((0, 0), (1, 0)), seg((1, 0), (1, 1)), seg((1, 1), (0, 0))])
    assert len(loop) == 1 and len(loop[0]) == 4


def test_geometry_of_all_kinds_and_of_none(spark):
    rows = [
        ("MULTIPOINT (0 0, 50 50)", "MULTIPOINT", 2, 0.0),
        ("multipoint ((50 50), (1 1))", "MULTIPOINT", 2, 0.0),
        ("MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTILINESTRING", 2, 0.0),
        ("POLYGON Z ((0 0 5, 10 0 5, 10 10 5, 0 10 5, 0 0 5), (1 1 0, 9 1 0, 9 9 0, 1 9 0, 1 1 0))", "POLYGON", 1, 36.0),
        ('"<http://crs> POLYGON ((0 0, 1e1 0, 10 10, 0 0))"^^<http://wkt>', "POLYGON", 1, 50.0),
        ("GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (POLYGON ((0 0, 2 0, 2 2, 0 0))), LINESTRING EMPTY)", "GEOMETRYCOLLECTION", 2, 2.0),
        ("POLYGON EMPTY", "POLYGON", 0, 0.0),
        ("LINESTRING (-1.5 .5, 4 -2)", "LINESTRING", 1, 0.0),
        ("POINT (1 2) POINT (3 4)", None, None, None),
        ("POINT (1)", None, None, None),
        ("CIRCLE (1 2)", None, None, None),
        ("see POINT (1 2)", None, None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "wkt string, kind string, parts int, area double")
    got = df.select("wkt", G.kind(F.col("wkt")).alias("kind"), F.size(G.geometry(F.col("wkt"))["parts"]).alias("n"), G.wkt_area(F.col("wkt")).alias("area"))
    told = {r["wkt"]: (r["kind"], r["n"] if r["kind"] else None, r["area"]) for r in got.collect()}
    assert told == {w: (k, n, a) for w, k, n, a in rows}


def test_what_has_no_relations_is_put_aside(spark):
    rows = [(1, "POINT (1 2)"), (2, "MULTIPOINT (1 2, 3 4)"), (3, "no"), (4, "POLYGON EMPTY"), (5, "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))")]
    df = spark.createDataFrame(rows, "id int, wkt string")
    assert sorted(r["id"] for r in S.prepare(df, "id", "wkt").collect()) == [1, 2, 5]
    aside = {r["id"]: r["reason"] for r in S.put_aside(df, "id", "wkt").collect()}
    assert aside == {3: "no geometry", 4: "empty"}


def square(x, y, half):
    return f"({x - half} {y - half}, {x + half} {y - half}, {x + half} {y + half}, {x - half} {y + half}, {x - half} {y - half})"


def test_relations_of_shapes_with_holes(spark):
    """A sea with an island, and a multipolygon with it: points, lines and areas in, on and around the hole."""
    sea = f"{square(0, 0, 10)}, {square(0, 0, 4)}"
    seas = [("sea", f"POLYGON ({sea})"), ("seas", f"MULTIPOLYGON (({sea}), ({square(40, 0, 10)}))")]
    others = [
        ("water", "POINT (7 0)", {"sfWithin"}),
        ("land", "POINT (0 0)", None),
        ("shore", "POINT (4 1)", {"sfTouches"}),
        ("coast", "POINT (10 1)", {"sfTouches"}),
        ("away", "POINT (0 11)", None),
        ("route", "LINESTRING (-7 -7, 7 -7)", {"sfWithin"}),
        ("bridge", "LINESTRING (-7 0, 7 0)", {"sfCrosses"}),
        ("road", "LINESTRING (-2 0, 2 0)", None),
        ("hill", f"POLYGON ({square(0, 0, 2)})", None),
        ("island", f"POLYGON ({square(0, 0, 4)})", {"sfTouches"}),
        ("ring", f"POLYGON ({square(0, 0, 6)})", {"sfOverlaps"}),
        ("bay", f"POLYGON ({square(7, 7, 1)})", {"sfWithin"}),
        ("atoll", f"POLYGON ({square(0, 0, 8)}, {square(0, 0, 5)})", {"sfWithin"}),
    ]
    right = S.prepare(spark.createDataFrame(seas, "id string, wkt string"), "id", "wkt")
    left = S.prepare(spark.createDataFrame([o[:2] for o in others], "id string, wkt string"), "id", "wkt")
    got = {tuple(r) for r in S.relation_pairs(left, right).collect()}
    assert got == {(i, rel, sea) for i, _, want in others if want for rel in want | {"sfIntersects"} for sea in ("sea", "seas")}
    whole = S.prepare(spark.createDataFrame([("whole", f"POLYGON ({square(0, 0, 10)})")], "id string, wkt string"), "id", "wkt")
    back = {tuple(r) for r in S.relation_pairs(right, whole).collect() if r["s"] == "sea"}
    assert back == {("sea", "sfWithin", "whole"), ("sea", "sfIntersects", "whole")}
    assert ("sea", "sfEquals", "sea") in {tuple(r) for r in S.relation_pairs(right, right).collect()}


def test_long_geometry_texts(spark):
    ring = ", ".join(f"{i % 1000} {i // 1000}" for i in range(60_000))
    df = spark.createDataFrame([(f"POLYGON (({ring}, 0 0))",)], "wkt string")
    assert df.select(F.size(G.parse_wkt(F.col("wkt"))[0])).first()[0] == 60_001


def test_area_of_plain_polygons_is_that_of_their_general_form(spark):
    texts = [
        '"POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))"', "POLYGON((0.5 -1e1,3 0,3. .5, 0 3))", "POLYGON ((1 1, 2 2))", "POLYGON ((1 1))",
        "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "POLYGON ((0 0 1, 2 0 1, 2 2 1, 0 0 1))", "polygon ((0 0, 2 0, 2 2))", "POLYGON ((0 0, 2 0, x 2))", "POLYGON EMPTY", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    got = [tuple(r) for r in df.select(G.wkt_area(F.col("w")), G.area(G.geometry(F.col("w"))["parts"])).collect()]
    assert [a for a, _ in got] == [b for _, b in got]
    assert got[0][0] == 9.0 and got[4][0] == 7.5
    plain = df.select(F.regexp_extract("w", G._PLAIN, 1).alias("p")).where("p != ''")
    assert plain.count() == 4
