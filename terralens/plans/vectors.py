"""Vector queries on ``embeddings``: every tenth vector asks, the others are the archive.

Image features are the stored vectors, text features the reversed ones; codes are signs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import diagnostics as D
from ..operators import inference as I
from ..operators import labels as L
from ..operators import neighbours as N
from ..operators import retrieval as R
from .common import Catalogue, rounded, table

CAT = Catalogue()

def is_query():
    return F.col("vec_id") % 10 == 0


def multi_labels():
    """Three label sources of a row: its class and the last two digits of its id."""
    tens = F.floor(F.col("vec_id") / 10) % 10
    return F.array_distinct(F.array(F.col("label"), (F.col("vec_id") % 10).cast("int"), tens.cast("int")))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", A.as_doubles("embedding").alias("v"), "label", multi_labels().alias("labels")
    )


def sides(df, vec):
    q = df.filter(is_query()).select(F.col("vec_id").alias("qid"), vec.alias("vec"))
    a = df.filter(~is_query()).select(F.col("vec_id").alias("aid"), vec.alias("vec"))
    return q, a


def modality(df, name):
    return {"image": F.col("v"), "text": F.reverse("v")}[name]


def code_sides(df, directions, single_label=True):
    """Query and archive codes of several (query modality, archive modality) directions."""
    labels = F.array("label") if single_label else F.col("labels")
    code = {m: A.sign_code(modality(df, m)) for m in ("image", "text")}
    options = F.array(
        *[F.struct(F.lit(f"{a}-{b}").alias("grp"), code[a].alias("q"), code[b].alias("a")) for a, b in directions]
    )
    each = df.select("vec_id", labels.alias("labels"), F.explode(options).alias("o"))
    q = each.filter(is_query()).select(F.col("o.grp").alias("grp"), F.col("vec_id").alias("qid"), F.col("o.q").alias("vec"), "labels")
    a = each.filter(~is_query()).select(F.col("o.grp").alias("grp"), F.col("vec_id").alias("aid"), F.col("o.a").alias("vec"), "labels")
    return q, a


I2T = [("image", "text")]
ALL_FOUR = [("image", "text"), ("text", "image"), ("image", "image"), ("text", "text")]
DEPTHS = [1, 5, 10, 20, 50] + list(range(100, 1001, 100))

SQL_E = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS t, label,
  list_distinct([label, (vec_id % 10)::INTEGER, ((vec_id // 10) % 10)::INTEGER]) AS labels FROM embeddings),
n AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u,
  list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) AS w FROM e),
c AS (SELECT *, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS ic,
  array_to_string(list_transform(t, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS tc FROM n)"""
SQL_TOP = """
d AS (SELECT q.vec_id AS qid, a.vec_id AS aid, round(list_distance(q.u, a.u) ** 2, 6) AS dist
  FROM n q JOIN n a ON q.vec_id % 10 = 0 AND a.vec_id % 10 <> 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, aid)::INTEGER AS rank FROM d
  QUALIFY rank <= 8)"""
SQL_H = """
h AS (SELECT q.vec_id AS qid, a.vec_id AS aid, hamming(q.ic, a.tc) AS dist, q.label = a.label AS rel
  FROM c q JOIN c a ON q.vec_id % 10 = 0 AND a.vec_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, aid) AS rank FROM h)"""
SQL_H4 = """
h AS (SELECT g.grp, q.vec_id AS qid, a.vec_id AS aid, q.label = a.label AS rel,
   hamming(CASE WHEN g.grp LIKE 'image-%' THEN q.ic ELSE q.tc END, CASE WHEN g.grp LIKE '%-image' THEN a.ic ELSE a.tc END) AS dist
  FROM (VALUES ('image-text'), ('text-image'), ('image-image'), ('text-text')) g(grp), c q JOIN c a ON q.vec_id % 10 = 0 AND a.vec_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, qid ORDER BY dist, aid) AS rank FROM h)"""


def top8(spark, sf):
    df = vectors(spark, sf)
    return N.nearest(*sides(df, A.l2_normalise(F.col("v"))), k=8)


@CAT.add("top_01", f"WITH {SQL_E}, {SQL_TOP} SELECT qid, aid, dist, rank FROM top")
def top_01(spark, sf):
    """Exact L2 top-8 on normalised vectors."""
    return top8(spark, sf)


@CAT.add(
    "top_01_sensor_pairs",
    f"""WITH {SQL_E}, p AS (SELECT 'image-image' AS direction, u AS qv, u AS av, vec_id FROM n
 UNION ALL SELECT 'image-text', u, w, vec_id FROM n UNION ALL SELECT 'text-image', w, u, vec_id FROM n
 UNION ALL SELECT 'text-text', w, w, vec_id FROM n),
d AS (SELECT q.direction, q.vec_id AS qid, a.vec_id AS aid, round(list_distance(q.qv, a.av) ** 2, 6) AS dist
  FROM p q JOIN p a ON q.direction = a.direction AND q.vec_id % 10 = 0 AND a.vec_id % 10 <> 0)
SELECT *, row_number() OVER (PARTITION BY direction, qid ORDER BY dist, aid)::INTEGER AS rank FROM d QUALIFY rank <= 8""",
)
def top_01_sensor_pairs(spark, sf):
    """The four sensor pairs of the same search in one pass."""
    df = vectors(spark, sf)
    unit = {m: A.l2_normalise(modality(df, m)) for m in ("image", "text")}
    pairs = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("grp"), unit[a].alias("q"), unit[b].alias("a")) for a, b in ALL_FOUR])
    each = df.select("vec_id", F.explode(pairs).alias("o"))
    q = each.filter(is_query()).select(F.col("o.grp").alias("grp"), F.col("vec_id").alias("qid"), F.col("o.q").alias("vec"))
    a = each.filter(~is_query()).select(F.col("o.grp").alias("grp"), F.col("vec_id").alias("aid"), F.col("o.a").alias("vec"))
    return N.nearest(q, a, k=8).withColumnRenamed("grp", "direction")


@CAT.add(
    "top_02",
    f"""WITH {SQL_E}, d AS (SELECT q.vec_id AS qid, a.vec_id AS aid, hamming(q.ic, a.ic)::DOUBLE AS dist
  FROM c q JOIN c a ON q.vec_id % 10 = 0 AND a.vec_id % 10 <> 0)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, aid)::INTEGER AS rank FROM d QUALIFY rank <= 750""",
)
def top_02(spark, sf):
    """Exact top-750 on 0/1 codes, where the squared L2 distance counts differing bits."""
    df = vectors(spark, sf)
    return N.nearest(*sides(df, A.delivery_code(A.sign_code(F.col("v")))), k=750)


@CAT.add(
    "top_03",
    f"WITH {SQL_E}, {SQL_H} SELECT qid, aid, dist::DOUBLE AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 8",
)
def top_03(spark, sf):
    """Hamming top-8 of image codes among text codes."""
    df = vectors(spark, sf)
    q, _ = sides(df, A.sign_code(F.col("v")))
    _, a = sides(df, A.sign_code(F.reverse("v")))
    return N.nearest(q, a, k=8, metric="hamming")


@CAT.add(
    "top_04",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS m FROM embeddings),
x AS (SELECT vec_id, list_transform(v, lambda x: exp(x - m)) AS ex FROM s),
p AS (SELECT vec_id, unnest(range(64))::INTEGER AS pos, unnest(list_transform(ex, lambda z: z / list_sum(ex))) AS p FROM x)
SELECT vec_id, pos, round(p, 6) AS p FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) <= 3""",
)
def top_04(spark, sf):
    """Top-3 classes per image by softmax probability."""
    names = F.array(*[F.lit(f"class {i}") for i in range(64)])
    best = F.explode(A.top_classes(A.softmax(F.col("v")), names, 3)).alias("t")
    return vectors(spark, sf).select("vec_id", best).select("vec_id", F.col("t.pos").alias("pos"), F.round("t.p", 6).alias("p"))


@CAT.add(
    "jn_16",
    f"WITH {SQL_E}, {SQL_TOP} SELECT qid, rank, aid, a.label AS label, array_to_string(list_sort(a.labels), ',') AS labels FROM top JOIN e a ON a.vec_id = top.aid",
)
def jn_16(spark, sf):
    """Labels of the retrieved archive rows."""
    df = vectors(spark, sf)
    named = df.select(F.col("vec_id").alias("aid"), "label", F.array_join(F.array_sort("labels"), ",").alias("labels"))
    return top8(spark, sf).join(named, "aid").select("qid", "rank", "aid", "label", "labels")


@CAT.add(
    "jn_17",
    f"""WITH {SQL_E}, {SQL_H} SELECT qid, dist::INTEGER AS dist, count(*) AS n_all, count(*) FILTER (rel) AS n_rel
FROM h GROUP BY qid, dist""",
)
def jn_17(spark, sf):
    """Query × archive Hamming matrix, reduced to counts per query and distance."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=0)
    return profile.groupBy("qid", "dist").agg(F.sum("n_all").alias("n_all"), F.sum("n_rel").alias("n_rel"))


@CAT.add(
    "jn_22",
    f"""WITH {SQL_E} SELECT q.vec_id AS qid, count(*) AS relevant FROM e q JOIN e a
 ON q.vec_id % 10 = 0 AND a.vec_id % 10 <> 0 AND list_has_any(q.labels, a.labels) GROUP BY q.vec_id""",
)
def jn_22(spark, sf):
    """How many archive rows share at least one label with each query."""
    df = vectors(spark, sf)
    q = df.filter(is_query()).select(F.col("vec_id").alias("qid"), "labels")
    a = df.filter(~is_query()).select(F.col("vec_id").alias("aid"), "labels")
    return L.overlap_counts(q, a)


@CAT.add(
    "agg_06",
    f"""WITH {SQL_E}, {SQL_TOP}, o AS (SELECT qid, len(list_intersect(q.labels, a.labels))::DOUBLE AS ov, len(a.labels) AS na, len(q.labels) AS nq
 FROM top JOIN e a ON a.vec_id = aid JOIN e q ON q.vec_id = qid),
m AS (SELECT qid, avg(ov / na) AS p, avg(ov / nq) AS r FROM o GROUP BY qid), s AS (SELECT avg(p) AS p, avg(r) AS r FROM m)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""",
)
def agg_06(spark, sf):
    """Multi-label precision, recall and F1 of the top-8."""
    df = vectors(spark, sf)
    q = df.select(F.col("vec_id").alias("qid"), F.col("labels").alias("q_labels"))
    a = df.select(F.col("vec_id").alias("aid"), F.col("labels").alias("a_labels"))
    scores = R.multilabel_scores(top8(spark, sf), q, a)
    return scores.select(rounded("precision"), rounded("recall"), rounded("f1"))


SQL_MAP = """x AS (SELECT *, row_number() OVER (PARTITION BY {g}qid ORDER BY rank) AS nth FROM r WHERE rel),
ap AS (SELECT {g}qid, avg(nth / rank) AS ap FROM x WHERE {cap} GROUP BY {g}qid),
qs AS (SELECT DISTINCT {g}qid FROM h)"""


@CAT.add(
    "agg_07",
    f"WITH {SQL_E}, {SQL_H}, {SQL_MAP.format(g='', cap='nth <= 8')} SELECT round(avg(coalesce(ap, 0)), 6) AS map, count(*) AS n_queries FROM qs LEFT JOIN ap USING (qid)",
)
def agg_07(spark, sf):
    """mAP of image codes against text codes, at most 8 relevant rows counted."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=8)
    return R.mean_average_precision(profile, 8).select(rounded("map"), "n_queries")


@CAT.add(
    "agg_07_all",
    f"WITH {SQL_E}, {SQL_H}, {SQL_MAP.format(g='', cap='true')} SELECT round(avg(coalesce(ap, 0)), 6) AS map, count(*) AS n_queries FROM qs LEFT JOIN ap USING (qid)",
)
def agg_07_all(spark, sf):
    """mAP over every relevant row."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T))
    return R.mean_average_precision(profile, None).select(rounded("map"), "n_queries")


@CAT.add(
    "agg_07_depth",
    f"WITH {SQL_E}, {SQL_H}, {SQL_MAP.format(g='', cap='rank <= 20')} SELECT round(avg(coalesce(ap, 0)), 6) AS map, count(*) AS n_queries FROM qs LEFT JOIN ap USING (qid)",
)
def agg_07_depth(spark, sf):
    """The textbook variant: k limits the rank depth."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=20)
    return R.mean_average_precision(profile, 20, depth_k=True).select(rounded("map"), "n_queries")


SQL_RAD = """g AS (SELECT unnest(range(65))::INTEGER AS radius),
t AS (SELECT qid, count(*) FILTER (rel) AS tsum FROM h GROUP BY qid),
pr AS (SELECT qid, radius, any_value(tsum) AS tsum, count(*) FILTER (dist <= radius) AS tot, count(*) FILTER (dist <= radius AND rel) AS tp
  FROM h JOIN t USING (qid), g GROUP BY qid, radius)"""


@CAT.add(
    "agg_08",
    f"WITH {SQL_E}, {SQL_H}, {SQL_RAD} SELECT radius, round(avg(CASE WHEN tot > 0 THEN tp / tot ELSE 0 END), 6) AS precision FROM pr GROUP BY radius",
)
def agg_08(spark, sf):
    """Mean precision inside every Hamming radius."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=0)
    return R.radius_curve(profile, 64).select("radius", rounded("precision"))


@CAT.add(
    "agg_09",
    f"""WITH {SQL_E}, {SQL_H}, {SQL_RAD} SELECT radius, round(avg(CASE WHEN tot > 0 THEN tp / tot ELSE 0 END), 6) AS precision,
round(avg(CASE WHEN tsum > 0 THEN tp / tsum ELSE 0 END), 6) AS recall FROM pr GROUP BY radius""",
)
def agg_09(spark, sf):
    """Precision–recall curve by radius."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=0)
    return R.radius_curve(profile, 64).select("radius", rounded("precision"), rounded("recall"))


@CAT.add(
    "agg_10",
    f"""WITH {SQL_E}, {SQL_H}, k AS (SELECT unnest([1,5,10,20,50,100,200,300,400,500,600,700,800,900,1000])::INTEGER AS k),
n_a AS (SELECT count(*) AS na FROM e WHERE vec_id % 10 <> 0),
p AS (SELECT qid, k, count(*) FILTER (rel AND rank <= k) / least(k, any_value(na)) AS p FROM r, k, n_a GROUP BY qid, k)
SELECT k, round(avg(p), 6) AS precision FROM p GROUP BY k""",
)
def agg_10(spark, sf):
    """Precision at k."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=max(DEPTHS))
    return R.precision_at(profile, DEPTHS).select("k", rounded("precision"))


@CAT.add(
    "agg_11",
    f"""WITH {SQL_E}, {SQL_H4}, {SQL_MAP.format(g='grp, ', cap='nth <= 8')},
m AS (SELECT grp, avg(coalesce(ap, 0)) AS map FROM qs LEFT JOIN ap USING (grp, qid) GROUP BY grp)
SELECT grp AS direction, round(map, 6) AS map FROM m UNION ALL SELECT 'average', round(avg(map), 6) FROM m""",
)
def agg_11(spark, sf):
    """mAP in all four directions and their plain average, one pass."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), ALL_FOUR), keep=8)
    maps = R.mean_average_precision(profile, 8)
    both = maps.rollup("grp").agg(F.avg("map").alias("map"))
    return both.select(F.coalesce("grp", F.lit("average")).alias("direction"), rounded("map"))


@CAT.add("win_01", f"WITH {SQL_E}, {SQL_H} SELECT qid, aid, dist::DOUBLE AS dist, rank::INTEGER AS rank FROM r WHERE rank <= 20")
def win_01(spark, sf):
    """Archive rows ranked by Hamming distance, ties by id."""
    df = vectors(spark, sf)
    q, _ = sides(df, A.sign_code(F.col("v")))
    _, a = sides(df, A.sign_code(F.reverse("v")))
    return N.nearest(q, a, k=20, metric="hamming")


@CAT.add(
    "win_02",
    f"WITH {SQL_E}, {SQL_H} SELECT qid, rank::BIGINT AS rank, row_number() OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS nth FROM r WHERE rel QUALIFY nth <= 8",
)
def win_02(spark, sf):
    """Running count of relevant rows by rank."""
    profile = N.hamming_profile(*code_sides(vectors(spark, sf), I2T), keep=8)
    return R.relevant_ranks(profile).filter(F.col("nth") <= 8).select("qid", "rank", "nth")


@CAT.add(
    "arr_06",
    f"WITH {SQL_E} SELECT vec_id, round(list_sum(u), 6) AS s, round(u[1], 6) AS first, round(u[64], 6) AS last FROM n",
)
def arr_06(spark, sf):
    """L2-normalised vectors."""
    u = A.l2_normalise(F.col("v"))
    df = vectors(spark, sf).select("vec_id", u.alias("u"))
    return df.select("vec_id", F.round(A.total(F.col("u")), 6).alias("s"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@CAT.add(
    "arr_07",
    f"""WITH {SQL_E} SELECT vec_id, ic AS code, list_sum(list_transform(range(32), lambda i: CASE WHEN v[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS w0,
list_sum(list_transform(range(32), lambda i: CASE WHEN v[i + 33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS w1 FROM c""",
)
def arr_07(spark, sf):
    """Signs as 0/1 delivery codes and packed words."""
    code = A.sign_code(F.col("v"))
    packed = A.pack_bits(F.col("v"), 64)
    df = vectors(spark, sf).select("vec_id", F.array_join(A.delivery_code(code).cast("array<string>"), "").alias("code"), packed.alias("w"))
    return df.select("vec_id", "code", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))


@CAT.add(
    "arr_10",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS m FROM embeddings),
x AS (SELECT vec_id, list_transform(v, lambda x: exp(x - m)) AS ex FROM s)
SELECT vec_id, round(ex[1] / list_sum(ex), 6) AS p0, round(list_max(ex) / list_sum(ex), 6) AS best FROM x""",
)
def arr_10(spark, sf):
    """Softmax probabilities."""
    df = vectors(spark, sf).select("vec_id", A.softmax(F.col("v")).alias("p"))
    return df.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.array_max("p"), 6).alias("best"))


@CAT.add(
    "arr_09",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, d::INTEGER AS d, round((v[16+d+1] + v[16+d+9] + v[32+d+1] + v[32+d+9] + v[48+d+1] + v[48+d+9]) / 2, 6) AS summed,
 round((v[16+d+1] + v[16+d+9]) / 2, 6) AS concat_first FROM s, (SELECT unnest(range(8)) AS d)""",
)
def arr_09(spark, sf):
    """Pool 4 layers × 2 tokens × 8 dims: sum or concatenation of the last three layers, token mean."""
    layers = [
        F.array(*[F.slice("v", 16 * l + 8 * t + 1, 8) for t in range(2)]) for l in range(4)
    ]
    df = vectors(spark, sf).select("vec_id", F.array(*layers).alias("states"))
    both = df.select("vec_id", A.pool_states(F.col("states"), 3).alias("s"), A.pool_states(F.col("states"), 3, "concat").alias("c"))
    each = both.select("vec_id", "c", F.posexplode("s").alias("d", "x"))
    return each.select("vec_id", "d", F.round("x", 6).alias("summed"), F.round(F.element_at("c", F.col("d") + 1), 6).alias("concat_first"))


SQL_D = f"{SQL_E}, b AS (SELECT *, vec_id // 50 AS batch FROM n)"


def paired(spark, sf):
    return vectors(spark, sf).select(
        "vec_id", F.col("v").alias("a"), F.reverse("v").alias("b"), "label", F.floor(F.col("vec_id") / 50).alias("batch")
    )


@CAT.add(
    "agg_20",
    f"""WITH {SQL_E}, q AS (SELECT list_sum(list_transform(range(1, 65), lambda i: (sign(0.5 * (v[i] + t[i])) - v[i]) ** 2 + (sign(0.5 * (v[i] + t[i])) - t[i]) ** 2)) AS x,
list_sum(list_transform(v, lambda y: (sign(y) - y) ** 2)) AS o FROM e) SELECT round(sum(x), 6) AS paired, round(sum(o), 6) AS single FROM q""",
)
def agg_20(spark, sf):
    """Quantisation error against the sign of the paired mean, and against the own sign."""
    return D.quantisation_error(paired(spark, sf), "a", "b").select(rounded("paired"), rounded("single"))


@CAT.add("agg_21", f"WITH {SQL_E} SELECT round(sum(list_sum(v) ** 2 + list_sum(t) ** 2), 6) AS bit_balance FROM e")
def agg_21(spark, sf):
    """Bit balance: sum of squared code sums."""
    return D.bit_balance(paired(spark, sf), "a", "b").select(rounded("bit_balance"))


SQL_NT = """o AS (SELECT batch, vec_id, 0 AS side, u AS z, w AS p FROM b UNION ALL SELECT batch, vec_id, 1, w, u FROM b),
k AS (SELECT x.batch, x.vec_id, x.side, any_value(exp(list_inner_product(x.z, x.p) / {t})) AS pos,
 sum(exp(list_inner_product(x.z, y.z) / {t})) AS all_sum,
 sum(exp(list_inner_product(x.z, y.z) / {t})) FILTER (NOT (x.vec_id = y.vec_id AND x.side = y.side)) AS others,
 sum(exp(list_inner_product(x.z, y.z) / {t})) FILTER (x.side <> y.side) AS cross_sum
 FROM o x JOIN o y ON x.batch = y.batch GROUP BY x.batch, x.vec_id, x.side)"""


@CAT.add(
    "agg_22",
    f"""WITH {SQL_D}, {SQL_NT.format(t='0.5')} SELECT batch, round(avg(-ln(pos / others)), 6) AS mean_loss,
round(sum(-ln(pos / (greatest(all_sum - exp(1), 1e-6) + 1e-6))), 6) AS sum_loss, round(sum(-ln(pos / (cross_sum + 1e-6))), 6) AS cross_loss FROM k GROUP BY batch""",
)
def agg_22(spark, sf):
    """Contrastive loss per batch of 50 pairs in its three variants."""
    loss = D.contrastive_loss(paired(spark, sf), "batch", "vec_id", "a", "b", temperature=0.5)
    return loss.select("batch", rounded("mean_loss"), rounded("sum_loss"), rounded("cross_loss"))


@CAT.add("agg_23", f"WITH {SQL_E} SELECT round(avg(ln(1 + exp(list_inner_product(u, w)))), 6) AS paired_similarity FROM n")
def agg_23(spark, sf):
    """Mean log(1 + e^cos) of the pairs."""
    return D.paired_similarity(paired(spark, sf), "a", "b").select(rounded("paired_similarity"))


@CAT.add(
    "agg_24",
    f"""WITH {SQL_D}, m AS (SELECT x.batch, x.vec_id, y.vec_id AS other, round(list_distance(x.u, y.u) ** 2, 6) AS d, list_cosine_similarity(x.u, y.u) AS cos FROM b x JOIN b y ON x.batch = y.batch AND x.vec_id <> y.vec_id),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, other) = 1)
SELECT batch, round(avg(cos), 6) AS nearest_cosine FROM f GROUP BY batch""",
)
def agg_24(spark, sf):
    """Cosine to the nearest other vector of the batch."""
    return D.nearest_cosine(paired(spark, sf), "batch", "vec_id", "a").select("batch", rounded("nearest_cosine"))


@CAT.add(
    "agg_25",
    f"WITH {SQL_E} SELECT round(avg(list_sum(list_transform(v, lambda x: abs((CASE WHEN label % 2 = 0 THEN -1 ELSE 1 END) - x)))), 6) AS class_code_distance FROM e",
)
def agg_25(spark, sf):
    """Distance of codes to the all-ones / all-minus-ones code of their class."""
    target = F.when(F.col("label") % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return D.class_code_distance(paired(spark, sf), "a", target).select(rounded("class_code_distance"))


@CAT.add(
    "agg_26",
    f"""WITH {SQL_E} SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: sign(2 * v[i] + t[i] - v[1 + (i % 64)])::INTEGER), ',') AS code FROM e""",
)
def agg_26(spark, sf):
    """Unified code: sign of the mean of four codes."""
    shifted = F.concat(F.slice("a", 2, 63), F.slice("a", 1, 1))
    four = [F.col("a"), F.col("a"), F.col("b"), F.transform(shifted, lambda x: -x)]
    return paired(spark, sf).select("vec_id", F.array_join(D.unified_code(four).cast("array<string>"), ",").alias("code"))


@CAT.add("agg_30", f"WITH {SQL_E}, {SQL_TOP} SELECT DISTINCT aid FROM top")
def agg_30(spark, sf):
    """Distinct retrieved ids over all queries."""
    return top8(spark, sf).select("aid").distinct()


@CAT.add(
    "udf_01",
    "SELECT doc_id, len(string_split(text, ' '))::DOUBLE AS words, len(text)::DOUBLE AS chars FROM documents",
)
def udf_01(spark, sf):
    """Batch encoder: any callable from a list of items to a matrix of features."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    feats = I.encode(docs, "doc_id", "text", I.length_encoder)
    return feats.select("doc_id", F.col("embedding")[0].alias("words"), F.col("embedding")[1].alias("chars"))


@CAT.add(
    "udf_02",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
h AS (SELECT vec_id, j, greatest(0, (list_sum(list_transform(range(64), lambda i: v[i + 1] * (((i * 7 + j * 3) % 11) - 5))) - 0.01 * j) / sqrt(1 + 0.1 * j + 1e-5)) AS x FROM s, (SELECT unnest(range(16)) AS j)),
o AS (SELECT vec_id, k, sum(x * (((j * 5 + k * 2) % 7) - 3)) AS y FROM h, (SELECT unnest(range(8)) AS k) GROUP BY vec_id, k)
SELECT vec_id, string_agg(CASE WHEN round(y, 9) > 0 THEN '1' WHEN round(y, 9) < 0 THEN '-1' ELSE '0' END, ',' ORDER BY k) AS code FROM o GROUP BY vec_id""",
)
def udf_02(spark, sf):
    """Two-layer projection to a code with weights given as a table-sized bundle."""
    w1 = [[float((i * 7 + j * 3) % 11 - 5) for i in range(64)] for j in range(16)]
    w2 = [[float((j * 5 + k * 2) % 7 - 3) for j in range(16)] for k in range(8)]
    weights = I.ProjectionWeights(
        w1, [0.0] * 16, [0.01 * j for j in range(16)], [1 + 0.1 * j for j in range(16)], [1.0] * 16, [0.0] * 16, w2, [0.0] * 8
    )
    codes = I.project_codes(vectors(spark, sf), "v", weights)
    return codes.select("vec_id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@CAT.add(
    "arr_01",
    f"WITH {SQL_E} SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN list_contains(labels, i) THEN 1 ELSE 0 END), '') AS hot FROM e",
)
def arr_01(spark, sf):
    """Label list → multi-hot; unknown labels raise."""
    names = F.transform("labels", lambda x: x.cast("string"))
    hot = A.multi_hot(names, [str(i) for i in range(10)])
    return vectors(spark, sf).select("vec_id", F.array_join(hot.cast("array<string>"), "").alias("hot"))


@CAT.add(
    "arr_08",
    f"""WITH {SQL_E} SELECT vec_id, array_to_string(list_sort(labels), ',') AS categories, (list_position(v, list_max(v)) - 1)::INTEGER AS best FROM e""",
)
def arr_08(spark, sf):
    """Multi-hot → category ids, and argmax of a score vector."""
    hot = F.array(*[F.array_contains("labels", i).cast("int") for i in range(10)])
    return vectors(spark, sf).select("vec_id", F.array_join(A.hot_positions(hot).cast("array<string>"), ",").alias("categories"), A.arg_max(F.col("v")).alias("best"))


CLASSES = list(range(19))


@CAT.add(
    "agg_03",
    f"""WITH {SQL_E}, l AS (SELECT unnest(labels) AS label FROM e) SELECT d.label::INTEGER AS label, count(l.label) AS n
FROM (SELECT unnest(range(19)) AS label) d LEFT JOIN l ON l.label = d.label GROUP BY d.label""",
)
def agg_03(spark, sf):
    """Histogram over 19 classes with zeros for absent ones."""
    return L.histogram(vectors(spark, sf), "labels", CLASSES)


@CAT.add(
    "set_06",
    f"""WITH {SQL_E}, {SQL_TOP}, base AS (SELECT vec_id, labels FROM e WHERE vec_id % 10 = 0),
got AS (SELECT DISTINCT aid AS vec_id FROM top), u AS (SELECT 'base' AS origin, labels FROM base UNION ALL SELECT 'retrieved', e.labels FROM got JOIN e USING (vec_id)),
x AS (SELECT origin, unnest(labels) AS label FROM u)
SELECT d.label::INTEGER AS label, count(*) FILTER (origin = 'base') AS before, count(origin) AS after
FROM (SELECT unnest(range(19)) AS label) d LEFT JOIN x ON x.label = d.label GROUP BY d.label""",
)
def set_06(spark, sf):
    """Base set enriched with the distinct retrieved rows; class histogram before and after."""
    df = vectors(spark, sf)
    return L.enrichment_histogram(df.filter(is_query()), df, top8(spark, sf).select(F.col("aid").alias("vec_id")), "vec_id", "labels", CLASSES)
