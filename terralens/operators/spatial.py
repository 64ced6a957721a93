"""Spatial relation joins, coast tests, distances and nearest entities.

Pairs are found by an equi-join on grid tiles. Copies of one geometry are joined
once and spread afterwards, tiles with too many candidate pairs are cut into
finer ones until they are not, and a pair is kept only in the tile that holds the lower left corner
of the common box, so no pass to drop repeated pairs is needed.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rdf
from ..session import materialise
from . import neighbours
from .numbering import range_bucket
from .relations import RELATIONS, related, summary

#: Finer cells a side of a crowded tile, how often a tile is cut at most, and candidate pairs that make it crowded.
SUBTILES, LEVELS, HOT_PAIRS = 16, 5, 4_000_000
SIDES = ("xmin", "ymin", "xmax", "ymax")
#: Members of a geometry that are spread together, and those whose pairs are told at once: a task holds all rows of two
#: such blocks, in its cache if they are few.
MEMBERS, FEW_MEMBERS = 1024, 128
#: Images and line segments of a block, images bounded together, and distances held at once.
IMAGE_BLOCK, SEGMENT_BLOCK, FEW_IMAGES, DISTANCES_AT_ONCE = 4096, 1 << 17, 32, 1 << 18


def _span(low, high, size, first=None, last=None):
    a, b = F.floor(low / size), F.floor(high / size)
    if first is not None:
        a, b = F.greatest(a, first), F.least(b, last)
    return F.sequence(a, b)


def tiled(df: DataFrame, size) -> DataFrame:
    """One row per tile ``(tx, ty)`` the ``box`` touches."""
    across = df.withColumn("tx", F.explode(_span(F.col("box.xmin"), F.col("box.xmax"), size)))
    return across.withColumn("ty", F.explode(_span(F.col("box.ymin"), F.col("box.ymax"), size)))


def _children(box, fine):
    """First and last finer cells a box touches inside its tile, in both directions."""
    def along(low, high, tile):
        first = F.col(tile) * SUBTILES
        return F.greatest(F.floor(low / fine), first), F.least(F.floor(high / fine), first + SUBTILES - 1)

    return along(box["xmin"], box["xmax"], "tx"), along(box["ymin"], box["ymax"], "ty")


def _load(df, box, fine, side):
    """Rows of each tile, and how many finer cells one of them touches on average."""
    (x0, x1), (y0, y1) = _children(F.col(box), fine)
    return df.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias(f"n{side}"), F.avg((x1 - x0 + 1) * (y1 - y0 + 1)).alias(f"m{side}"))


def _finer(df, box, fine):
    (x0, x1), (y0, y1) = _children(F.col(box), fine)
    across = df.withColumn("_x", F.explode(F.sequence(x0, x1))).withColumn("_y", F.explode(F.sequence(y0, y1)))
    return across.withColumn("tx", F.col("_x")).withColumn("ty", F.col("_y")).drop("_x", "_y")


def cells(left: DataFrame, right: DataFrame, size, hot_pairs=HOT_PAIRS):
    """``(left, right, keys, cell size)`` of the joins that meet all pairs: an adaptive quadtree over counted loads.

    A tile with more than ``hot_pairs`` candidate pairs is cut into ``SUBTILES``² finer ones, again and again where they
    stay crowded. Where its boxes are so large that finer tiles would only hold copies of them, the left rows are dealt
    into as many parts as the load asks for and the right rows go to each.
    """
    l, r = tiled(left, size).withColumnRenamed("box", "lbox"), tiled(right, size).withColumnRenamed("box", "rbox")
    found = []
    for level in range(LEVELS + 1):
        fine = size / SUBTILES
        load = _load(l, "lbox", fine, "l").join(_load(r, "rbox", fine, "r"), ["tx", "ty"])
        pairs = F.col("nl") * F.col("nr")
        apart = (F.col("ml") <= SUBTILES) & (F.col("mr") <= SUBTILES) & F.lit(level < LEVELS)
        hot = load.filter(pairs > hot_pairs).select("tx", "ty", apart.alias("cut"), F.ceil(pairs / hot_pairs).cast("int").alias("parts"))
        hot = materialise(hot, "hot")
        if hot.isEmpty():
            return [*found, (l, r, ["tx", "ty"], size)]
        found.append((l.join(hot, ["tx", "ty"], "left_anti"), r, ["tx", "ty"], size))
        dealt = hot.filter(~F.col("cut")).drop("cut")
        part = F.pmod(F.xxhash64("lbox"), F.col("parts")).cast("int")
        lp = l.join(dealt, ["tx", "ty"]).withColumn("part", part).drop("parts")
        rp = r.join(dealt, ["tx", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        found.append((lp, rp, ["tx", "ty", "part"], size))
        again = hot.filter("cut").select("tx", "ty")
        if again.isEmpty():
            return found
        l, r = _finer(l.join(again, ["tx", "ty"], "left_semi"), "lbox", fine), _finer(r.join(again, ["tx", "ty"], "left_semi"), "rbox", fine)
        size = fine
    return found


def candidate_pairs(left: DataFrame, right: DataFrame, size, hot_pairs=HOT_PAIRS) -> DataFrame:
    """Pairs with touching boxes, each once. Inputs carry ``box``; other column names must differ."""
    x = F.greatest(F.col("lbox.xmin"), F.col("rbox.xmin"))
    y = F.greatest(F.col("lbox.ymin"), F.col("rbox.ymin"))
    meet = (x <= F.least(F.col("lbox.xmax"), F.col("rbox.xmax"))) & (y <= F.least(F.col("lbox.ymax"), F.col("rbox.ymax")))
    joined = [
        l.join(r, keys).filter(meet & (F.floor(x / cell) == F.col("tx")) & (F.floor(y / cell) == F.col("ty"))).drop(*keys)
        for l, r, keys, cell in cells(left, right, size, hot_pairs)
    ]
    return reduce(lambda a, b: a.unionByName(b), joined)


def _is_box(rings):
    """A closed axis-parallel rectangle with area, or a point."""
    ring, b = rings[0], G.bounds(rings)
    corners = F.forall(
        ring,
        lambda p: ((p["x"] == b["xmin"]) | (p["x"] == b["xmax"])) & ((p["y"] == b["ymin"]) | (p["y"] == b["ymax"])),
    )
    steps = F.forall(
        F.zip_with(F.slice(ring, 1, 4), F.slice(ring, 2, 4), lambda p, q: (p["x"] == q["x"]) != (p["y"] == q["y"])),
        lambda ok: ok,
    )
    rectangle = (F.size(rings) == 1) & (F.size(ring) == 5) & corners & steps
    return rectangle


def _read(df, id_col, wkt_col):
    """``members(id, wkt, g)`` and ``shapes(g, g_parts, reason)``: each distinct text is parsed once."""
    members = df.select(F.col(id_col).alias("id"), F.col(wkt_col).alias("wkt"), F.md5(F.coalesce(F.col(wkt_col), F.lit(""))).alias("g"))
    texts = members.groupBy("g").agg(F.any_value("wkt").alias("text"))
    shapes = texts.select("g", G.geometry(F.col("text")).alias("read"))
    reason = F.when(F.col("read").isNull(), "no geometry").when(F.size("read.parts") == 0, "empty")
    return members, shapes.select("g", F.col("read.parts").alias("parts"), reason.alias("reason"))


def put_aside(df: DataFrame, id_col, wkt_col) -> DataFrame:
    """``id, wkt, reason`` of the rows that ``prepare`` leaves out: empty geometries and texts that are none."""
    members, shapes = _read(df, id_col, wkt_col)
    return members.join(shapes.filter(F.col("reason").isNotNull()).select("g", "reason"), "g").select("id", "wkt", "reason")


def prepare(df: DataFrame, id_col, wkt_col) -> DataFrame:
    """``id, g, parts, box, plain, point`` of the rows that hold a geometry of any of the seven kinds.

    ``g`` names the text, ``plain`` marks single points and rectangles. ``put_aside`` gives the other rows.
    """
    members, shapes = _read(df, id_col, wkt_col)
    one = F.col("parts")[0]
    single = F.size("parts") == 1
    point = single & (one["kind"] == "POINT")
    plain = point | (single & (one["kind"] == "POLYGON") & _is_box(one["rings"]))
    whole = shapes.filter(F.col("reason").isNull()).select(
        "g", "parts", G.bounds(F.flatten(F.transform("parts", lambda p: p["rings"]))).alias("box"), plain.alias("plain"), point.alias("point")
    )
    return members.select("g", "id").join(whole, "g").select("id", "g", "parts", "box", "plain", "point")


def _plain_relations(l, r, l_point, r_point):
    """Relations of two points or rectangles from their bounds; the boxes are known to meet."""
    same = (l["xmin"] == r["xmin"]) & (l["xmax"] == r["xmax"]) & (l["ymin"] == r["ymin"]) & (l["ymax"] == r["ymax"])
    l_in_r = (l["xmin"] >= r["xmin"]) & (l["xmax"] <= r["xmax"]) & (l["ymin"] >= r["ymin"]) & (l["ymax"] <= r["ymax"])
    r_in_l = (r["xmin"] >= l["xmin"]) & (r["xmax"] <= l["xmax"]) & (r["ymin"] >= l["ymin"]) & (r["ymax"] <= l["ymax"])
    open_meet = (
        (F.greatest(l["xmin"], r["xmin"]) < F.least(l["xmax"], r["xmax"]))
        & (F.greatest(l["ymin"], r["ymin"]) < F.least(l["ymax"], r["ymax"]))
    )
    l_strict = (l["xmin"] > r["xmin"]) & (l["xmax"] < r["xmax"]) & (l["ymin"] > r["ymin"]) & (l["ymax"] < r["ymax"])
    r_strict = (r["xmin"] > l["xmin"]) & (r["xmax"] < l["xmax"]) & (r["ymin"] > l["ymin"]) & (r["ymax"] < l["ymax"])
    inner = (
        F.when(l_point & r_point, same).when(l_point, l_strict).when(r_point, r_strict).otherwise(open_meet)
    )
    within, contains = l_in_r & inner, r_in_l & inner
    flags = {
        "sfEquals": same,
        "sfWithin": within,
        "sfContains": contains,
        "sfCovers": r_in_l,
        "sfTouches": ~inner,
        "sfCrosses": F.lit(False),
        "sfOverlaps": ~l_point & ~r_point & inner & ~within & ~contains,
        "sfIntersects": F.lit(True),
    }
    return F.filter(F.array(*[F.when(flags[n], F.lit(n)) for n in RELATIONS]), lambda x: x.isNotNull())


def _unique(df, side):
    """The distinct geometries of a layer, each parsed and summed up once, and the members of each."""
    shapes = df.select("g", "parts", "box", "plain", "point").dropDuplicates(["g"]).withColumn("grid", summary(F.col("parts")))
    return materialise(shapes, "shapes"), df.select("g", F.col("id").alias(side))


def _members_in_blocks(members, key, name, most):
    """The rows of each group in arrays ``name`` of about ``most`` rows, numbered by ``name_part``."""
    columns = [c for c in members.columns if c not in key]
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(*columns), F.ceil(F.col("_n") / most)).cast("int")
    dealt = members.join(sizes, key).select(*key, part.alias(f"{name}_part"), F.struct(*columns).alias("_row"))
    return dealt.groupBy(*key, f"{name}_part").agg(F.collect_list("_row").alias(name))


def _met(found, left, right, l_key, r_key, most):
    """Every found pair of groups with blocks of both's members: columns of ``found``, arrays ``_l`` and ``_r``."""
    l, r = _members_in_blocks(left, l_key, "_l", most), _members_in_blocks(right, r_key, "_r", most)
    met = found.join(l, l_key).join(r, r_key)
    # few bytes, many rows to come: a fixed partition count keeps AQE from packing the blocks into one task
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *l_key, *r_key, "_l_part", "_r_part").drop("_l_part", "_r_part")


def spread(found: DataFrame, left: DataFrame, right: DataFrame, l_key, r_key, by=None) -> DataFrame:
    """Every found pair of groups with each member of both: columns of ``found``, structs ``l`` and ``r``.

    Blocks of members are shuffled instead of their pairs, so that a few large groups are dealt to all tasks. ``by``
    names a column of the left members that the result holds and is partitioned by.
    """
    met = _met(found, left, right, l_key, r_key, MEMBERS).withColumn("l", F.explode("_l")).drop("_l")
    if by:
        # the right members still stand in blocks, so few bytes move
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = met.withColumn(by, F.col(f"l.{by}")).repartition(parts, by)
    return met.withColumn("r", F.explode("_r")).drop("_r")


def _once(members, side):
    """Each member of a geometry once; ``many`` marks ids with several geometries."""
    return members.distinct().withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(side)) > 1)


def relation_pairs(left: DataFrame, right: DataFrame, size=10.0, relations=RELATIONS, hot_pairs=HOT_PAIRS, distinct=False) -> DataFrame:
    """Materialised relations ``(s, rel, o)`` between two prepared layers.

    Points and rectangles are decided by their bounds; all other pairs by ``relations.related``. ``distinct`` gives each
    relation once, partitioned by ``s``; only those of ids with several geometries are compared for it.
    """
    l, l_members = _unique(left, "s")
    r, r_members = _unique(right, "o")

    def sided(shapes, side):
        return shapes.select(F.col("g").alias(f"{side}_g"), "box", *[F.col(n).alias(f"{side}_{n}") for n in ("plain", "point", "grid")])

    pairs = candidate_pairs(sided(l, "l"), sided(r, "r"), size, hot_pairs)
    plain = F.col("l_plain") & F.col("r_plain")
    quick = _plain_relations(F.col("lbox"), F.col("rbox"), F.col("l_point"), F.col("r_point"))
    found = pairs.filter(plain).select("l_g", "r_g", quick.alias("rels"))
    if not (l.filter(~F.col("plain")).isEmpty() and r.filter(~F.col("plain")).isEmpty()):
        shapes = l.unionByName(r).select("g", "parts", "grid").dropDuplicates(["g"])
        found = found.unionByName(related(pairs.filter(~plain), shapes))
    found = found.select("l_g", "r_g", F.array_intersect("rels", F.array(*[F.lit(n) for n in relations])).alias("rels")).filter(F.size("rels") > 0)
    if distinct:
        l_members, r_members = _once(l_members, "s"), _once(r_members, "o")
    l_members, r_members = l_members.withColumnRenamed("g", "l_g"), r_members.withColumnRenamed("g", "r_g")
    if distinct:
        pairs = spread(found, l_members, r_members, ["l_g"], ["r_g"], by="s")
        told = pairs.select("s", F.explode("rels").alias("rel"), F.col("r.o").alias("o"), (F.col("l.many") | F.col("r.many")).alias("many"))
        single, several = told.filter(~F.col("many")).drop("many"), told.filter("many").drop("many")
        # an application without such ids keeps the partitioning
        many = l_members.select("many").unionByName(r_members.select("many")).filter("many")
        return single if many.isEmpty() else single.unionByName(several.distinct())
    # bare ids, and the name of a relation is taken once for all pairs of two blocks
    met = _met(found, l_members, r_members, ["l_g"], ["r_g"], FEW_MEMBERS)
    met = met.select(F.explode("rels").alias("rel"), F.col("_l.s").alias("_s"), F.col("_r.o").alias("_o"))
    return met.select("rel", "_o", F.explode("_s").alias("s")).select("s", "rel", F.explode("_o").alias("o"))


def relation_triples(pairs: DataFrame) -> DataFrame:
    """``(s, rel, o)`` of entity terms → triples with the relation predicates."""
    return pairs.select("s", F.concat(F.lit(f"<{rdf.GEO}"), F.col("rel"), F.lit(">")).alias("p"), "o")


def segment_meets_box(s, b):
    """Does the segment ``(ax, ay, bx, by)`` touch the closed box?"""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]

    def axis(start, delta, low, high):
        enter = F.when(delta > 0, (low - start) / delta).when(delta < 0, (high - start) / delta)
        leave = F.when(delta > 0, (high - start) / delta).when(delta < 0, (low - start) / delta)
        inside = (start >= low) & (start <= high)
        return (
            F.coalesce(enter, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))),
            F.coalesce(leave, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))),
        )

    ex, lx = axis(s["ax"], dx, b["xmin"], b["xmax"])
    ey, ly = axis(s["ay"], dy, b["ymin"], b["ymax"])
    return F.greatest(F.lit(0.0), ex, ey) <= F.least(F.lit(1.0), lx, ly)


def segment_box(s):
    return F.struct(
        F.least(s["ax"], s["bx"]).cast("double").alias("xmin"),
        F.least(s["ay"], s["by"]).cast("double").alias("ymin"),
        F.greatest(s["ax"], s["bx"]).cast("double").alias("xmax"),
        F.greatest(s["ay"], s["by"]).cast("double").alias("ymax"),
    )


def pieces(segments: DataFrame, size) -> DataFrame:
    """``seg, box``: the bounds of each stretch of a segment, none much longer than a tile."""
    seg = segments.select(F.struct(*[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]).alias("seg")).distinct()
    s = F.col("seg")
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    n = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / size), F.lit(1))
    each = seg.select("seg", n.alias("n"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    at = lambda c, d, i: s[c] + d * (i / F.col("n"))
    stretch = segment_box({"ax": at("ax", dx, F.col("i")), "ay": at("ay", dy, F.col("i")), "bx": at("ax", dx, F.col("i") + 1), "by": at("ay", dy, F.col("i") + 1)})
    # a little wider than the rounded stretch; the whole segment decides
    slack = F.lit(1e-9) * (1 + F.greatest(*[F.abs(s[c]) for c in ("ax", "ay", "bx", "by")]))
    wide = F.struct(*[(stretch[c] + (slack if c.endswith("max") else -slack)).alias(c) for c in SIDES])
    return each.select("seg", wide.alias("box"))


def meets_coast(boxes: DataFrame, segments: DataFrame, size=10.0) -> DataFrame:
    """Ids of the boxes some segment touches. ``boxes(id, box)``, ``segments(ax, ay, bx, by)``.

    Equal boxes and segments are compared once, a segment only where it passes.
    """
    told = F.struct(*[F.col(f"box.{c}").cast("double").alias(c) for c in SIDES])
    own = boxes.select("id", told.alias("own"))
    pairs = candidate_pairs(own.select(F.col("own").alias("box")).distinct().withColumn("own", F.col("box")), pieces(segments, size), size)
    met = pairs.filter(segment_meets_box(F.col("seg"), F.col("own"))).select("own").distinct()
    return own.join(met, "own").select("id").distinct()


def _distance(px, py, ax, ay, bx, by):
    """``G.point_segment_distance`` of every point to every segment, points down and segments across."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    px, py = px[:, None], py[:, None]
    t = ((px - ax) * dx + (py - ay) * dy) / np.where(length2 > 0, length2, 1.0)
    t = np.clip(t, 0.0, 1.0)
    return np.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _flat(column):
    """The entries of a list column one after the other, and how many each row has."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten(), np.asarray(lists.value_lengths())


def _members(struct, *names):
    return [struct.field(n).to_numpy(zero_copy_only=False) for n in names]


NEAR_FAR = "g string, d double, lat double, far double"


def _cell_distances(images, lines):
    """Nearest and farthest line of each image of a block, among a block of lines.

    Images stand in spatial order and are taken a few at a time. The distances of their common centre to the lines tell,
    by the triangle inequality, which lines can be the nearest or the farthest one of any of them; only these are measured.
    """
    out = {n: [] for n in ("g", "d", "lat", "far")}
    if images.num_rows == 0 or lines.num_rows == 0:
        return pa.table({n: pa.array([], pa.string() if n == "g" else pa.float64()) for n in out})
    images = images.take(pa.compute.sort_indices(images, sort_keys=[("place", "ascending"), ("g", "ascending")]))
    box = np.column_stack([images.column(n).to_numpy() for n in SIDES])
    spots, n_spots = _flat(images.column("points"))
    px, py = _members(spots, "x", "y")
    first_spot = np.r_[0, np.cumsum(n_spots)]
    parts, n_parts = _flat(lines.column("parts"))
    unit = np.repeat(np.arange(len(n_parts)), n_parts)
    part_box = np.column_stack([parts.field("box").field(n).to_numpy(zero_copy_only=False) for n in SIDES])
    segments, n_segments = _flat(parts.field("segs"))
    seg = np.column_stack(_members(segments, "ax", "ay", "bx", "by"))
    first_seg = np.r_[0, np.cumsum(n_segments)]
    names = images.column("g").to_pylist()

    def segments_of(chosen):
        """The chosen parts' segments, and where each part begins among them."""
        counts = n_segments[chosen]
        starts = np.cumsum(counts) - counts
        rows = np.repeat(first_seg[chosen] - starts, counts) + np.arange(counts.sum())
        return seg[rows].T, starts

    for lo in range(0, len(names), FEW_IMAGES):
        few = box[lo : lo + FEW_IMAGES]
        at = slice(first_spot[lo], first_spot[min(lo + FEW_IMAGES, len(names))])
        x, y, owner = px[at], py[at], np.repeat(np.arange(len(few)), n_spots[lo : lo + FEW_IMAGES])
        low, high = few[:, :2], few[:, 2:]
        some = ((part_box[:, :2] <= high.max(0)) & (part_box[:, 2:] >= low.min(0))).all(1)
        some = np.flatnonzero(some)
        if len(x) == 0 or len(some) == 0:
            continue
        all_ = ((part_box[some, :2] <= high.min(0)) & (part_box[some, 2:] >= low.max(0))).all(1)
        cx, cy = x.mean(), y.mean()
        reach = np.hypot(x - cx, y - cy).max() + 1e-9
        ends, starts = segments_of(some)
        centre = np.minimum.reduceat(_distance(np.array([cx]), np.array([cy]), *ends)[0], starts)
        heads = np.flatnonzero(np.r_[True, unit[some][1:] != unit[some][:-1]])
        closest, widest = np.minimum.reduceat(centre, heads), np.maximum.reduceat(centre, heads)
        sure = np.logical_or.reduceat(all_, heads)
        nearest = (centre[all_].min() if all_.any() else np.inf) + reach
        farthest = (closest[sure].max() if sure.any() else -np.inf) - reach
        keep = (closest - reach <= nearest) | (widest + reach >= farthest)
        some = some[np.repeat(keep, np.diff(np.r_[heads, len(some)]))]
        best_d, best_lat, far = np.full(len(few), np.inf), np.full(len(few), np.inf), np.full(len(few), -np.inf)
        # a bounded number of distances at a time, whole lines each
        cuts = np.flatnonzero(np.r_[True, unit[some][1:] != unit[some][:-1]])
        load = np.cumsum(n_segments[some]) * len(x) // DISTANCES_AT_ONCE
        begins = cuts[np.flatnonzero(np.r_[True, load[cuts][1:] != load[cuts][:-1]])]
        for start, stop in zip(begins, np.r_[begins[1:], len(some)]):
            chosen = some[start:stop]
            ends, starts = segments_of(chosen)
            d = np.minimum.reduceat(_distance(x, y, *ends), starts, axis=1)
            meets = ((part_box[None, chosen, :2] <= high[:, None]) & (part_box[None, chosen, 2:] >= low[:, None])).all(2)
            d[~meets[owner]] = np.inf
            heads = np.flatnonzero(np.r_[True, unit[chosen][1:] != unit[chosen][:-1]])
            d = np.minimum.reduceat(d, heads, axis=1)
            np.maximum.at(far, owner, np.where(np.isfinite(d), d, -np.inf).max(1))
            for i, (value, lat) in enumerate(zip(d.min(1), y)):
                if (value, lat) < (best_d[owner[i]], best_lat[owner[i]]):
                    best_d[owner[i]], best_lat[owner[i]] = value, lat
        found = np.flatnonzero(np.isfinite(best_d))
        out["g"] += [names[lo + i] for i in found]
        out["d"] += best_d[found].tolist()
        out["lat"] += best_lat[found].tolist()
        out["far"] += far[found].tolist()
    return pa.table({n: pa.array(v, pa.string() if n == "g" else pa.float64()) for n, v in out.items()})


def _blocks_for(rows, size):
    return max(1, math.ceil((rows or 0) / size))


def coast_distances(
    images: DataFrame, lines: DataFrame, size=10.0, image_block=IMAGE_BLOCK, segment_block=SEGMENT_BLOCK
) -> DataFrame:
    """Least and greatest distance of an image's points to the lines whose bounds meet its box.

    ``images(id, box, points ARRAY<STRUCT<x,y>>)``, ``lines(line, points)``. Distances come in
    degrees and in metres, taken at the latitude of the nearest point. Blocks of images meet blocks of lines in one
    bounded task each, which tells only the nearest and the farthest line: no pair is ever stored.
    """
    n = F.size("points")
    ends = F.zip_with(
        F.slice("points", 1, F.greatest(n - 1, F.lit(1))),
        F.slice("points", F.least(n, F.lit(2)), F.greatest(n - 1, F.lit(1))),
        lambda a, b: F.struct(*[p[c].cast("double").alias(f"{e}{c}") for e, p in (("a", a), ("b", b)) for c in "xy"]),
    )
    whole = F.filter(ends, lambda e: e["ax"].isNotNull() & e["ay"].isNotNull() & e["bx"].isNotNull() & e["by"].isNotNull())
    told = lambda b: F.struct(*[b[c].cast("double").alias(c) for c in SIDES])
    part = F.struct(told(G.bounds(F.array("points"))).alias("box"), whole.alias("segs"))
    parts = lines.select("line", part.alias("part")).filter((F.size("part.segs") > 0) & F.col("part.box.xmin").isNotNull())
    # rows of one line are one line; equal lines are measured once
    shapes = parts.groupBy("line").agg(F.array_sort(F.collect_set("part")).alias("parts")).select("parts").distinct()
    shapes = materialise(shapes.withColumn("key", F.xxhash64("parts")), "lines")
    vertices = F.aggregate("parts", F.lit(0), lambda acc, p: acc + F.size(p["segs"]))
    line_blocks = _blocks_for(shapes.agg(F.sum(vertices)).first()[0], segment_block)

    spots = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    spots = F.transform(spots, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    asked = images.select("id", told(F.col("box")).alias("box"), spots.alias("points"))
    asked = asked.filter((F.size("points") > 0) & F.col("box.xmin").isNotNull() & F.col("box.ymin").isNotNull() & F.col("box.xmax").isNotNull() & F.col("box.ymax").isNotNull())
    asked = materialise(asked.withColumn("g", F.md5(F.to_json(F.struct("box", "points")))), "images")
    once = asked.dropDuplicates(["g"]).select("g", "box.*", "points")
    # neighbours in strips of latitude stand together
    place = F.floor(F.col("points")[0]["y"] / size) * 1000 + F.col("points")[0]["x"]
    once = once.withColumn("place", place)
    image_blocks = _blocks_for(once.count(), image_block)
    left = range_bucket(once, "place", image_blocks, name="ib").withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(line_blocks - 1))))
    right = shapes.withColumn("lb", F.pmod("key", F.lit(line_blocks)).cast("int")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(image_blocks - 1))))
    # few bytes, much work: a fixed partition count keeps AQE from packing the blocks into one task
    spread = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = left.repartition(spread, "ib", "lb").groupBy("ib", "lb").cogroup(right.repartition(spread, "ib", "lb").groupBy("ib", "lb"))
    found = cells.applyInArrow(_cell_distances, NEAR_FAR)
    near = found.groupBy("g").agg(F.min(F.struct("d", "lat")).alias("near"), F.max("far").alias("max_deg"))
    out = asked.select("id", "g").join(near, "g").groupBy("id").agg(F.min("near").alias("near"), F.max("max_deg").alias("max_deg"))
    return out.select(
        "id",
        F.col("near.d").alias("min_deg"),
        "max_deg",
        G.degrees_to_metres(F.col("near.d"), F.col("near.lat")).alias("min_m"),
        G.degrees_to_metres(F.col("max_deg"), F.col("near.lat")).alias("max_m"),
    )


def place_of(min_metres, limit=10.0):
    """``harbor`` when some vessel is nearer than the limit, else ``coast``; null without a coast."""
    return F.when(min_metres < limit, "harbor").when(min_metres.isNotNull(), "coast")


KM_PER_DEGREE = math.pi / 180 * 6371.0088


def within_km(left: DataFrame, right: DataFrame, km, size=None, hot_pairs=HOT_PAIRS) -> DataFrame:
    """Pairs of points at most ``km`` apart. ``left(id, x, y)``, ``right(other, ox, oy)`` in degrees.

    Places are compared once, and their members spread afterwards.
    """
    spots, places = left.select("x", "y").distinct(), right.select("ox", "oy").distinct()
    pairs = spread(near_spots(spots, places, km, size, hot_pairs), left, right, ["x", "y"], ["ox", "oy"])
    mine = [c for c in left.columns if c not in ("x", "y")]
    theirs = [c for c in right.columns if c not in ("ox", "oy")]
    return pairs.select(*[F.col(f"l.{c}").alias(c) for c in mine], "x", "y", *[F.col(f"r.{c}").alias(c) for c in theirs], "ox", "oy", "km")


def near_spots(left: DataFrame, right: DataFrame, km, size=None, hot_pairs=HOT_PAIRS) -> DataFrame:
    """Pairs of places at most ``km`` apart, by tiles; the left rows of a crowded tile are dealt into parts.

    Longitudes wrap at 180°; the search box widens towards the poles.
    """
    reach = km / KM_PER_DEGREE
    size = size or 360.0 / max(1, math.floor(360.0 / max(reach, 0.01)))
    columns = round(360.0 / size)
    lat = F.radians("y")
    ratio = F.sin(F.lit(math.radians(min(reach, 90.0)))) / F.cos(lat)
    polar = (F.abs(F.col("y")) + reach >= 90.0) | (ratio >= 1.0) | F.lit(reach >= 90.0)
    dlon = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    xs = F.when(dlon >= 180.0 - size, F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<bigint>")).otherwise(
        F.array_distinct(
            F.transform(_span(F.col("x") + 180.0 - dlon, F.col("x") + 180.0 + dlon, size), lambda i: F.pmod(i, F.lit(columns)))
        )
    )
    l = left.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(_span(F.col("y") - reach - 1e-9, F.col("y") + reach + 1e-9, size)))
    tile_x = F.pmod(F.floor((F.col("ox") + 180.0) / size), F.lit(columns))
    r = right.withColumn("tx", tile_x).withColumn("ty", F.floor(F.col("oy") / size))
    load = l.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("nl")).join(r.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("nr")), ["tx", "ty"])
    load = load.select("tx", "ty", F.ceil(F.col("nl") * F.col("nr") / hot_pairs).cast("int").alias("parts"))
    l = l.join(load, ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")).drop("parts")
    r = r.join(load, ["tx", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dist = G.haversine(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    return l.join(r, ["tx", "ty", "part"]).withColumn("km", dist).filter(F.col("km") <= km).drop("tx", "ty", "part")


def nearest_entity(left: DataFrame, right: DataFrame, reaches_km=(25.0, 500.0), decimals=6) -> DataFrame:
    """The nearest ``other`` of every ``id``, ties to the lower one: ``(id, other, km)``; ids are BIGINT.

    Equal locations are searched once. Tile passes of growing reach settle the locations
    that have a neighbour inside it, so dense areas never meet a wide search; locations
    far from everything go through the exact block search on unit vectors.
    """
    spots = left.groupBy("x", "y").agg(F.min("id").alias("qid"))
    places = right.groupBy("ox", "oy").agg(F.min("other").alias("other"))
    km = F.round(F.col("km"), decimals)
    settled, open_spots = [], spots
    for reach in reaches_km:
        best = (
            near_spots(open_spots, places, reach)
            .groupBy("x", "y")
            .agg(F.min(F.struct(km.alias("km"), "other")).alias("best"))
            .select("x", "y", "best.km", "best.other")
        )
        # one table per pass holds both the settled and the open locations
        level = materialise(open_spots.join(best, ["x", "y"], "left"), "nearest")
        settled.append(level.filter(F.col("other").isNotNull()).select("x", "y", "km", "other"))
        open_spots = level.filter(F.col("other").isNull()).select("x", "y", "qid")

    def unit(x, y):
        lon, lat = F.radians(x), F.radians(y)
        return F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))

    found = neighbours.nearest(
        open_spots.select("qid", unit("x", "y").alias("vec")),
        places.select(F.col("other").alias("aid"), unit("ox", "oy").alias("vec")),
        k=1,
        decimals=12,
    )
    far = (
        found.join(open_spots, "qid")
        .join(places, F.col("aid") == F.col("other"))
        .select("x", "y", F.round(G.haversine(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")), decimals).alias("km"), "other")
    )
    for level in settled:
        far = far.unionByName(level)
    return left.select("id", "x", "y").join(far, ["x", "y"]).select("id", "other", "km")


def beside(left: DataFrame, right: DataFrame, by, direction) -> DataFrame:
    """Rows of ``left(id, by, x)`` that lie west or east of some ``right(by, ox)`` of the same group.

    Only the outermost longitude per group matters, so no pairs are built.
    """
    edge = F.max("ox") if direction == "west" else F.min("ox")
    limit = right.groupBy(by).agg(edge.alias("limit"))
    keep = F.col("x") < F.col("limit") if direction == "west" else F.col("x") > F.col("limit")
    return left.join(limit, by).filter(keep).drop("limit")


def river_wkt(geojson):
    """A river's GeoJSON, a collection of lines and points or one of them, as zero-width polygons of its maximal lines."""
    merged = _line_merger(_lines_of)(geojson)
    return F.when(F.size(merged) > 0, G.to_wkt(F.transform(merged, G.thin_polygon), F.lit("MULTIPOLYGON")))


def merge_lines(lines):
    """Maximal lines of an entity's segments, each joined at end points shared by exactly two.

    ``lines`` is an array column ``ARRAY<ARRAY<STRUCT<x,y>>>``; a document's lines sit in its own row.
    """
    return _line_merger(lambda row: row)(lines)


def _line_merger(read):
    @F.pandas_udf(G.RINGS)
    def merged(column):
        import pandas as pd

        rows = [None if row is None else read(row) for row in column]
        return pd.Series([None if row is None else _merged(row) for row in rows], dtype=object)

    return merged


def _lines_of(geojson):
    """The lines of a GeoJSON text or of its collection's members; null where it is none."""
    try:
        told = json.loads(geojson)
        lines = [m["coordinates"] for m in told.get("geometries", [told]) if m.get("type") == "LineString"]
        return [[{"x": float(v[0]), "y": float(v[1])} for v in line] for line in lines]
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return None


def _merged(row):
    lines = []
    for raw in row:
        pts = [(p["x"], p["y"]) for p in raw]
        pts = [p for i, p in enumerate(pts) if i == 0 or p != pts[i - 1]]
        if len(pts) > 1:
            lines.append(pts)
    ends = {}
    for i, line in enumerate(lines):
        ends.setdefault(line[0], []).append(i)
        ends.setdefault(line[-1], []).append(i)
    used, out = set(), []

    def grow(path):
        while True:
            tip = path[-1]
            nexts = [i for i in ends[tip] if i not in used]
            if len(ends[tip]) != 2 or not nexts:
                return path
            line = lines[nexts[0]]
            used.add(nexts[0])
            path.extend((line if line[0] == tip else line[::-1])[1:])

    for i, line in enumerate(lines):
        if i in used:
            continue
        used.add(i)
        forward = grow(list(line))
        if forward[0] != forward[-1]:
            forward = grow(forward[::-1])[::-1]
        out.append([{"x": x, "y": y} for x, y in forward])
    return out
