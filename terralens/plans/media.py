"""Bands, labels, splits, samples, captions and their augmentation.

An order stands for an image and its line items for the vessel boxes in it; a document
is a caption; a 64-vector is four bands of 4 × 4 pixels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import augment as U
from ..operators import bands as B
from ..operators import captions as C
from ..operators import diagnostics as D
from ..operators import labels as L
from ..operators import numbering as N
from ..operators import sampling as S
from .common import Catalogue, rounded, table

CAT = Catalogue()
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


# --- bands and maps ---

BAND_NAMES = ["B02", "B03", "B04", "B08"]


def patches(spark, sf):
    v = A.as_doubles("embedding")
    pixels = [F.slice(v, 16 * i + 1, 16) for i in range(4)]
    named = F.create_map(*[x for n, p in zip(BAND_NAMES, pixels) for x in (F.lit(n), p)])
    return table(spark, sf, "embeddings").select("vec_id", "label", v.alias("v"), named.alias("bands"))


SQL_P = """p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT vec_id, label, unnest(['B02', 'B03', 'B04', 'B08']) AS band, unnest([v[1:16], v[17:32], v[33:48], v[49:64]]) AS px FROM p)"""


@CAT.add(
    "arr_02",
    f"""WITH {SQL_P}, o AS (SELECT unnest(['B04', 'B03', 'B02', 'B08']) AS band, unnest([0, 1, 2, 3])::INTEGER AS pos)
SELECT vec_id, pos, round(px[1], 6) AS first, round(list_sum(px), 6) AS total FROM b JOIN o USING (band)""",
)
def arr_02(spark, sf):
    """Bands of a named combination, in its order."""
    each = patches(spark, sf).select("vec_id", F.posexplode(B.select_bands(F.col("bands"), "RGB-IR")).alias("pos", "px"))
    return each.select("vec_id", "pos", F.round(F.col("px")[0], 6).alias("first"), F.round(A.total(F.col("px")), 6).alias("total"))


@CAT.add(
    "arr_03",
    f"""WITH {SQL_P}, e AS (SELECT band, unnest(px) AS x FROM b), st AS (SELECT band, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY band),
o AS (SELECT unnest(['B04', 'B03', 'B02']) AS band, unnest([0, 1, 2])::INTEGER AS pos)
SELECT vec_id, pos, round((px[1] - m) / s, 6) AS first, round(list_sum(list_transform(px, lambda x: (x - m) / s)), 6) AS total FROM b JOIN st USING (band) JOIN o USING (band)""",
)
def arr_03(spark, sf):
    """Channels standardised by per-band mean and deviation."""
    p = patches(spark, sf)
    each = p.select(F.explode("bands").alias("band", "px")).select("band", F.explode("px").alias("x"))
    stats = each.groupBy("band").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    done = B.standardise(p, "vec_id", "bands", stats, "RGB").select("vec_id", F.posexplode("bands").alias("pos", "px"))
    return done.select("vec_id", "pos", F.round(F.col("px")[0], 6).alias("first"), F.round(A.total(F.col("px")), 6).alias("total"))


@CAT.add(
    "arr_04",
    f"WITH {SQL_P} SELECT vec_id, round((v[1] - list_min(v)) / (list_max(v) - list_min(v)), 6) AS first, round(list_sum(list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)))), 6) AS total FROM p",
)
def arr_04(spark, sf):
    """Min–max scaling."""
    s = patches(spark, sf).select("vec_id", A.min_max(F.col("v")).alias("s"))
    return s.select("vec_id", F.round(F.col("s")[0], 6).alias("first"), F.round(A.total(F.col("s")), 6).alias("total"))


@CAT.add(
    "arr_05",
    f"""WITH {SQL_P} SELECT vec_id, 6 AS channels, 9 AS pixels, round(list_sum(list_transform([0, 16, 32, 48], lambda o: list_sum(list_transform([1, 2, 3, 5, 6, 7, 9, 10, 11], lambda i: v[o + i])))), 6) AS total, 0.0::DOUBLE AS padded FROM p""",
)
def arr_05(spark, sf):
    """Crop to 3 × 3 and pad with zero bands to six channels."""
    bands = F.array(*[F.col("bands")[n] for n in BAND_NAMES])
    c = patches(spark, sf).select("vec_id", A.crop_and_pad(bands, 4, 4, size=3, channels=6).alias("c"))
    return c.select(
        "vec_id",
        F.size("c").alias("channels"),
        F.size(F.col("c")[0]).alias("pixels"),
        F.round(A.total(F.flatten("c")), 6).alias("total"),
        A.total(F.col("c")[5]).alias("padded"),
    )


@CAT.add(
    "arr_11",
    f"""WITH {SQL_P}, s AS (SELECT vec_id, v, (list_sum(list_transform(v, lambda x: x ** 4)) / 64) ** 0.25 AS n FROM p),
c AS (SELECT vec_id, list_transform(v, lambda x: greatest(least(x / n - greatest(least(x / n, 0.25), -0.25), 12.75), -12.75) / 12.75) AS c FROM s)
SELECT vec_id, round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM c""",
)
def arr_11(spark, sf):
    """Relevance clipping."""
    c = patches(spark, sf).select("vec_id", A.clip_relevance(F.col("v")).alias("c"))
    return c.select("vec_id", F.round(F.col("c")[0], 6).alias("first"), F.round(A.total(F.col("c")), 6).alias("total"))


@CAT.add(
    "arr_12",
    f"""WITH {SQL_P}, e AS (SELECT vec_id, i, v[i + 1] AS x FROM p, (SELECT unnest(range(64)) AS i))
SELECT vec_id, ((i // 8 // 4) * 2 + (i % 8) // 4)::INTEGER AS cell, round(avg(x), 6) AS mean FROM e GROUP BY ALL""",
)
def arr_12(spark, sf):
    """Average pooling of an 8 × 8 map by stride 4."""
    pooled = A.let(F.col("v"), lambda v: B.average_pool(v, 8, 8, 4))
    return patches(spark, sf).select("vec_id", F.posexplode(pooled).alias("cell", "m")).select("vec_id", "cell", F.round("m", 6).alias("mean"))


@CAT.add(
    "arr_14",
    f"WITH {SQL_P}, e AS (SELECT label, i::INTEGER AS pos, v[i + 1] AS x FROM p, (SELECT unnest(range(64)) AS i)) SELECT label, pos, round(avg(x), 6) AS value FROM e GROUP BY label, pos",
)
def arr_14(spark, sf):
    """Mean of all maps of a class."""
    return B.mean_map(patches(spark, sf), "label", "v").select("label", "pos", rounded("value"))


@CAT.add("flt_07", f"WITH {SQL_P} SELECT vec_id FROM p WHERE len(list_filter(v, lambda x: x > 0.3)) > 0")
def flt_07(spark, sf):
    """Images with a non-zero pixel; pixels up to 0.3 count as zero here."""
    rows = [F.transform(F.slice("v", 1 + 16 * r, 16), lambda x: F.when(x > 0.3, x).otherwise(0.0)) for r in range(4)]
    masked = patches(spark, sf).select("vec_id", F.array(*rows).alias("px"))
    return B.nonzero_images(masked, "px").select("vec_id")


@CAT.add(
    "jn_21",
    f"""WITH {SQL_P}, x AS (SELECT a.vec_id AS vec_id, a.v AS a, b.v AS b FROM p a JOIN p b ON b.vec_id = a.vec_id + 1),
i AS (SELECT unnest(range(16))::INTEGER AS i), j AS (SELECT unnest(range(16))::INTEGER AS j)
SELECT vec_id, i, j, round(a[i + 1] * b[j + 1] + a[i + 17] * b[j + 17] + a[i + 33] * b[j + 33] + a[i + 49] * b[j + 49], 6) AS r FROM x, i, j""",
)
def jn_21(spark, sf):
    """Joint relevance of neighbouring images: Σ over four dimensions of 16-cell maps."""
    p = patches(spark, sf).select("vec_id", F.array(*[F.col("bands")[n] for n in BAND_NAMES]).alias("m"))
    pairs = p.withColumnRenamed("m", "a").join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("b")), "vec_id")
    return B.joint_relevance(pairs, "vec_id", "a", "b").select("vec_id", "i", "j", rounded("r"))


@CAT.add(
    "agg_18",
    f"""WITH {SQL_P}, e AS (SELECT i AS class, 1 / (1 + exp(-20 * v[i + 1])) > 0.5 AS p, label = i AS y FROM p, (SELECT unnest(range(10)) AS i)),
c AS (SELECT class, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM e GROUP BY class)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM c""",
)
def agg_18(spark, sf):
    """Macro multi-label F1."""
    from ..operators.requests import macro_f1

    return macro_f1(scores(spark, sf)).select(rounded("macro_f1"))


def scores(spark, sf):
    logits = F.transform(F.slice("v", 1, 10), lambda x: x * 20)
    truth = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (c == F.col("label")).cast("double"))
    return patches(spark, sf).select("vec_id", logits.alias("logits"), truth.alias("labels"))


@CAT.add(
    "agg_19",
    f"WITH {SQL_P}, e AS (SELECT 20 * v[i + 1] AS x, (label = i)::INTEGER AS y FROM p, (SELECT unnest(range(10)) AS i)) SELECT round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS cross_entropy FROM e",
)
def agg_19(spark, sf):
    """Mean binary cross-entropy with logits."""
    return D.cross_entropy(scores(spark, sf), "logits", "labels").select(rounded("cross_entropy"))


# --- object counts, strata, splits, samples ---


def images(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


def boxes(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") * 10).alias("area"))


def counted(spark, sf):
    return L.object_counts(images(spark, sf), boxes(spark, sf), "o_orderkey")


SQL_N = "n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"
SQL_ST = f"{SQL_N}, st AS (SELECT o_orderkey, CASE WHEN n >= 6 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END::INTEGER AS stratum FROM n)"


@CAT.add("agg_04", f"WITH {SQL_N} SELECT o_orderkey, n FROM n")
def agg_04(spark, sf):
    """Objects per image."""
    return counted(spark, sf)


@CAT.add("cnd_02", f"WITH {SQL_ST} SELECT o_orderkey, stratum FROM st")
def cnd_02(spark, sf):
    """Object-count stratum 0 / 1–5 / 6 and more."""
    return counted(spark, sf).select("o_orderkey", L.count_stratum(F.col("n"), (1, 6)).alias("stratum"))


@CAT.add("cnd_03", f"WITH {SQL_N} SELECT o_orderkey, (n > 0)::INTEGER AS present FROM n")
def cnd_03(spark, sf):
    """Vessel presence; implausible counts raise."""
    return counted(spark, sf).select("o_orderkey", L.presence(F.col("n")).alias("present"))


def strata(spark, sf):
    return counted(spark, sf).select("o_orderkey", L.count_stratum(F.col("n"), (1, 6)).alias("stratum"))


SQL_SPLIT = f"""{SQL_ST}, sp AS (SELECT o_orderkey, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || o_orderkey), o_orderkey)
 <= floor(0.33 * count(*) OVER (PARTITION BY stratum)) THEN 'archive' ELSE 'query' END AS split FROM st)"""


@CAT.add("smp_01", f"WITH {SQL_SPLIT} SELECT * FROM sp")
def smp_01(spark, sf):
    """Stratified split: 33 % of each stratum to the archive."""
    return S.stratified_split(strata(spark, sf), ["o_orderkey"], "stratum")


@CAT.add("jn_23", f"WITH {SQL_SPLIT} SELECT o_orderkey, stratum FROM sp WHERE split = 'query'")
def jn_23(spark, sf):
    """Stratum minus its archive sample."""
    all_rows = strata(spark, sf)
    archive = S.stratified_split(all_rows, ["o_orderkey"], "stratum").filter("split = 'archive'")
    return S.remainder(all_rows, archive, "o_orderkey")


@CAT.add("set_07", f"WITH {SQL_SPLIT} SELECT o_orderkey FROM sp WHERE split = 'query'")
def set_07(spark, sf):
    """Difference of index sets."""
    split = S.stratified_split(strata(spark, sf), ["o_orderkey"], "stratum")
    return images(spark, sf).select("o_orderkey").exceptAll(split.filter("split = 'archive'").select("o_orderkey"))


@CAT.add(
    "flt_03",
    "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000)",
)
def flt_03(spark, sf):
    """Annotated patches whose image exists and that are not zero patches."""
    o = images(spark, sf)
    annotated = boxes(spark, sf).select("o_orderkey").distinct()
    there = S.keep_listed(annotated, o.filter("o_orderstatus <> 'P'"), "o_orderkey")
    return S.drop_listed(there, o.filter("o_totalprice < 50000"), "o_orderkey")


@CAT.add("jn_13", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn_13(spark, sf):
    """Keep images in a split list."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("patch"))
    listed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patch"))
    return S.keep_listed(o, listed, "patch").select("o_orderkey")


@CAT.add("jn_14", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def jn_14(spark, sf):
    """Drop zero patches."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("patch"))
    zero = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("patch"))
    return S.drop_listed(o, zero, "patch").select("o_orderkey")


@CAT.add("jn_20", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def jn_20(spark, sf):
    """Patch with its annotation; a missing entry raises."""
    patches_ = boxes(spark, sf).select("o_orderkey").distinct()
    return S.with_objects(patches_, images(spark, sf).select("o_orderkey", "o_orderstatus"), "o_orderkey")


@CAT.add(
    "smp_04",
    """SELECT o_orderkey, 'train' AS split FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
SELECT o_orderkey, 'query' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <> 7 UNION ALL SELECT o_orderkey, 'archive' FROM orders WHERE o_orderstatus <> 'F'""",
)
def smp_04(spark, sf):
    """Train, query and archive from three lists with one exclusion."""
    o = images(spark, sf)
    key = o.select("o_orderkey")
    return S.assign_splits(
        key,
        o.filter("o_orderpriority = '1-URGENT'"),
        o.filter("o_orderstatus = 'F'"),
        o.filter("o_orderstatus <> 'F'"),
        "o_orderkey",
        excluded=(7,),
    )


@CAT.add("set_05", "SELECT o_orderkey, o_orderstatus AS split FROM orders")
def set_05(spark, sf):
    """Union of the splits."""
    o = images(spark, sf).select("o_orderkey", F.col("o_orderstatus").alias("split"))
    parts = [o.filter(F.col("split") == s) for s in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@CAT.add(
    "win_03",
    """WITH i AS (SELECT o_orderkey + o_orderkey // 5 * 2 AS idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders),
g AS (SELECT idx, row_number() OVER (PARTITION BY place // 4 ORDER BY md5('42:' || idx), idx) - 1 AS r, count(*) OVER (PARTITION BY place // 4) AS m FROM i)
SELECT idx, r::INTEGER AS list_no FROM g WHERE m = 4 AND r < 2""",
)
def win_03(spark, sf):
    """Two of every four consecutive rows, as two parallel lists; the index has gaps."""
    gaps = images(spark, sf).select((F.col("o_orderkey") + F.floor(F.col("o_orderkey") / 5) * 2).alias("idx"))
    return S.sample_groups(gaps, "idx", 2, 4)


@CAT.add("win_05", "WITH g AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey FROM g WHERE r % 5 = 0")
def win_05(spark, sf):
    """Every fifth row, undoing a five-fold replication."""
    return N.every_nth(images(spark, sf).select("o_orderkey"), "o_orderkey", 5)


@CAT.add("win_07", "WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) SELECT doc_id, r // 500 AS block FROM g")
def win_07(spark, sf):
    """Blocks of 500 rows."""
    return N.blocks_of(table(spark, sf, "documents").select("doc_id"), "doc_id", 500)


@CAT.add("top_05", "SELECT 'patch_' || o_orderkey AS patch FROM orders ORDER BY patch LIMIT 250")
def top_05(spark, sf):
    """Patches sorted and capped."""
    p = images(spark, sf).select(F.concat(F.lit("patch_"), F.col("o_orderkey").cast("string")).alias("patch"))
    return S.first_sorted(p, "patch", 250)


@CAT.add("top_09", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def top_09(spark, sf):
    """Seeded shuffle; the id restores the order."""
    return S.shuffled(images(spark, sf).select("o_orderkey"), ["o_orderkey"])


SQL_U = "(('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::BIGINT / 4294967296.0)"


@CAT.add("smp_02", f"SELECT doc_id, CASE WHEN {SQL_U.format(seed=7)} < 1.0 / 4 THEN 'es' WHEN {SQL_U.format(seed=7)} < 3.0 / 4 THEN 'de' ELSE 'ru' END AS language FROM documents")
def smp_02(spark, sf):
    """Weighted language per sentence."""
    docs = table(spark, sf, "documents").select("doc_id")
    return U.weighted_choice(docs, ["doc_id"], 7, {"es": 1, "de": 2, "ru": 1}, "language")


@CAT.add("smp_03", f"SELECT doc_id, ['rotation_cc', 'blur_cc', 'jitter_cc'][(CASE WHEN {SQL_U.format(seed=11)} < 1.0 / 3 THEN 1 WHEN {SQL_U.format(seed=11)} < 2.0 / 3 THEN 2 ELSE 3 END)] AS augmentation FROM documents")
def smp_03(spark, sf):
    """One augmentation per image from a named set."""
    docs = table(spark, sf, "documents").select("doc_id")
    return U.even_choice(docs, ["doc_id"], 11, U.EACH_IMAGE_RANDOM, "augmentation")


# --- caption text ---


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@CAT.add("str_01", "SELECT doc_id, lower(translate(text, '.,!?', '')) AS caption FROM documents")
def str_01(spark, sf):
    """Caption normalisation."""
    return docs(spark, sf).select("doc_id", X.normalise(F.col("text")).alias("caption"))


@CAT.add("str_02", f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents) SELECT doc_id, len(t)::INTEGER AS n, array_to_string(t, ' ') AS joined FROM t")
def str_02(spark, sf):
    """Tokenise and untokenise."""
    t = docs(spark, sf).select("doc_id", X.tokenise(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), X.untokenise(F.col("t")).alias("joined"))


@CAT.add("str_03", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: CASE WHEN x = 'the' THEN 'mask_n' ELSE x END), ' ') AS replaced FROM documents")
def str_03(spark, sf):
    """Replace one word of a token list."""
    tokens = X.replace_word(X.tokenise(F.col("text")), "the", "mask_n")
    return docs(spark, sf).select("doc_id", X.untokenise(tokens).alias("replaced"))


SQL_WORDS = """w AS (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS u,
 string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS t)"""
SQL_B100 = "CASE WHEN ({n}) < 20 THEN u[({n}) + 1] WHEN ({n}) % 10 = 0 THEN t[({n}) // 10 - 1] ELSE t[({n}) // 10 - 1] || '-' || u[({n}) % 10 + 1] END"
SQL_OK = f"""CASE WHEN n < 100 THEN {SQL_B100.format(n='n')} WHEN n > 999 THEN 'NaN' ELSE u[n // 100 + 1] || ' hundred' || CASE WHEN n % 100 > 0 THEN ' ' || {SQL_B100.format(n='n % 100')} ELSE '' END END"""
SQL_COMPAT = f"""CASE WHEN n < 100 THEN {SQL_B100.format(n='n')} WHEN n > 999 THEN 'NaN' WHEN n % 100 < 20 THEN u[n // 100 + 1] || ' hundred  ' || u[n % 100 + 1]
 WHEN n % 10 = 0 THEN t[(n % 100) // 10 - 1] ELSE u[n // 100 + 1] || ' hundred ' || {SQL_B100.format(n='n % 100')} END"""


@CAT.add("str_04", f"WITH {SQL_WORDS}, k AS (SELECT o_orderkey, o_orderkey % 1003 AS n FROM orders) SELECT o_orderkey, {SQL_OK} AS words, {SQL_COMPAT} AS compat FROM k, w")
def str_04(spark, sf):
    """Numbers in words, plain and with the published oddities."""
    n = F.col("o_orderkey") % 1003
    return images(spark, sf).select("o_orderkey", C.number_words(n).alias("words"), C.number_words(n, compat=True).alias("compat"))


def sized(spark, sf):
    """Size counts and place per order."""
    o = images(spark, sf)
    counts = C.size_counts(boxes(spark, sf), "o_orderkey", "area")
    joined = o.join(counts, "o_orderkey", "left").na.fill(0, [f"s{i}" for i in range(5)])
    place = F.when(F.col("o_orderstatus") == "F", "harbor").when(F.col("o_orderstatus") == "O", "coast")
    return joined.select("o_orderkey", *[f"s{i}" for i in range(5)], place.alias("place"))


SQL_SIZE = "CASE WHEN a < 12 THEN 0 WHEN a < 24 THEN 1 WHEN a < 100 THEN 2 WHEN a < 450 THEN 3 ELSE 4 END"
SQL_SIZED = f"""a AS (SELECT o_orderkey, o_orderstatus, l_quantity * 10 AS a, l_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
sz AS (SELECT o_orderkey, CASE any_value(o_orderstatus) WHEN 'F' THEN 'harbor' WHEN 'O' THEN 'coast' END AS place, """ + ", ".join(
    f"count(*) FILTER (l_orderkey IS NOT NULL AND {SQL_SIZE} = {i}) AS s{i}" for i in range(5)
) + " FROM a GROUP BY o_orderkey)"
_KINDS = [("very small", "boat"), ("small", "boat"), ("medium-sized", "boat"), ("big", "ship"), ("very big", "ship")]


def _cw(n):
    return f"CASE WHEN {n} >= 6 THEN 'many' ELSE u[{n} + 1] END"


SQL_PARTS = "[" + ", ".join(
    f"CASE WHEN s{i} = 1 THEN 'one {w} {k}' WHEN s{i} > 1 THEN {_cw(f's{i}')} || ' {w} {k}s' END" for i, (w, k) in enumerate(_KINDS)
) + "]"
SQL_PHRASE = f"""ph AS (SELECT *, list_filter({SQL_PARTS}, lambda x: x IS NOT NULL) AS parts, s0 + s1 + s2 + s3 + s4 AS n FROM sz, w),
pz AS (SELECT *, CASE WHEN len(parts) < 2 THEN array_to_string(parts, ' ') ELSE array_to_string(parts[1:len(parts) - 1], ' ') || ' and ' || parts[len(parts)] END AS phrase FROM ph)"""


@CAT.add("cnd_01", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 10 AS a FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {SQL_SIZE}::INTEGER AS size FROM x")
def cnd_01(spark, sf):
    """Size class of a box."""
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.size_class(F.col("l_quantity") * 10).alias("size"))


@CAT.add("agg_05", f"WITH {SQL_SIZED} SELECT o_orderkey, s0, s1, s2, s3, s4 FROM sz WHERE s0 + s1 + s2 + s3 + s4 > 0")
def agg_05(spark, sf):
    """Boxes per size class and image."""
    return C.size_counts(boxes(spark, sf), "o_orderkey", "area")


@CAT.add(
    "str_05",
    f"""WITH {SQL_WORDS}, {SQL_SIZED}, {SQL_PHRASE}, q AS (SELECT *, {_cw('n')} || CASE WHEN n = 1 THEN ' vessel' ELSE ' vessels' END AS base, CASE WHEN n = 1 THEN ' is present' ELSE ' are present' END AS verb FROM pz)
SELECT o_orderkey, CASE WHEN n = 0 THEN z ELSE base END AS c1, CASE WHEN n = 0 THEN z ELSE phrase END AS c2,
CASE WHEN n = 0 THEN z ELSE CASE place WHEN 'harbor' THEN 'in the port ' WHEN 'coast' THEN 'near the seacoast ' ELSE '' END || base || verb END AS c3,
CASE WHEN n = 0 THEN z ELSE base || CASE place WHEN 'harbor' THEN ' in the harbor' WHEN 'coast' THEN ' near the coast' ELSE '' END END AS c4
FROM q, (SELECT 'other types of land use land cover classes' AS z)""",
)
def str_05(spark, sf):
    """The four caption templates."""
    s = [F.col(f"s{i}") for i in range(5)]
    n = s[0] + s[1] + s[2] + s[3] + s[4]
    c = sized(spark, sf).select("o_orderkey", C.templates(n, F.col("place"), s).alias("c"))
    return c.select("o_orderkey", *[F.col("c")[i].alias(f"c{i + 1}") for i in range(4)])


def _pieces():
    out = []
    for i, (w, k) in enumerate(_KINDS):
        earlier = " + ".join(f"s{j}" for j in range(i)) or "0"
        link = f"CASE WHEN {earlier} > 0 THEN ' and ' ELSE '' END"
        many_link = "''" if i == 4 else link
        twice = " || ' ' || u[s3 + 1]" if i == 3 else ""
        out.append(f"CASE WHEN s{i} = 1 THEN {link} || 'one {w} {k}' WHEN s{i} > 1 THEN {many_link} || {_cw(f's{i}')}{twice} || ' {w} {k}s' END")
    return "[" + ", ".join(out) + "]"


SQL_PIECES = _pieces()


@CAT.add(
    "str_06",
    f"""WITH {SQL_WORDS}, {SQL_SIZED}, {SQL_PHRASE}, r AS (SELECT *, array_to_string(list_filter({SQL_PIECES}, lambda x: x IS NOT NULL), ' ') AS raw FROM pz),
s AS (SELECT *, string_split(raw, ' and') AS sp FROM r)
SELECT o_orderkey, phrase, CASE WHEN len(sp) > 2 THEN trim(regexp_replace(array_to_string(sp[1:len(sp) - 1], ' ') || ' and ' || sp[len(sp)], '\\s+', ' ', 'g')) ELSE raw END AS compat FROM s""",
)
def str_06(spark, sf):
    """Size phrase, plain and with the published oddities."""
    s = [F.col(f"s{i}") for i in range(5)]
    return sized(spark, sf).select("o_orderkey", C.size_phrase(s).alias("phrase"), C.size_phrase(s, compat=True).alias("compat"))


@CAT.add(
    "str_07",
    "SELECT doc_id, source || '_' || doc_id AS stem, 'a.b/' || lang || '/aug_' || source || '_' || doc_id || '.tif' AS prefixed, 'a.b/' || lang || '/' || source || '_' || doc_id || '.png' AS changed FROM documents",
)
def str_07(spark, sf):
    """File-name helpers."""
    path = F.concat(F.lit("a.b/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".tif"))
    p = docs(spark, sf).select("doc_id", path.alias("p"))
    return p.select(
        "doc_id",
        X.stem(F.col("p")).alias("stem"),
        X.add_prefix(F.col("p"), F.lit("aug_")).alias("prefixed"),
        X.change_extension(F.col("p"), "png").alias("changed"),
    )


@CAT.add("str_10", "SELECT doc_id, lower(text) AS text FROM documents")
def str_10(spark, sf):
    """Lower-case generated text."""
    return docs(spark, sf).select("doc_id", F.lower("text").alias("text"))


@CAT.add(
    "str_11",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS m FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda x: exp(x - m)) AS ex FROM s),
p AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(ex, lambda z: z / list_sum(ex))) AS p FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS r FROM p QUALIFY r <= 3)
SELECT vec_id, string_agg(r || ') class ' || pos || ' (' || printf('%.2f', p * 100) || ')%', chr(10) ORDER BY r) AS caption, string_agg(r || ') class ' || pos, chr(10) ORDER BY r) AS plain FROM r GROUP BY vec_id""",
)
def str_11(spark, sf):
    """Ranked class caption."""
    names = F.array(*[F.lit(f"class {i}") for i in range(64)])
    best = patches(spark, sf).select("vec_id", A.top_classes(A.softmax(F.col("v")), names, 3).alias("b"))
    return best.select("vec_id", X.class_caption(F.col("b")).alias("caption"), X.class_caption(F.col("b"), False).alias("plain"))


# --- caption tables ---


def captioned(images):
    """Four captions per document: whole text, prefixed text, reversed text and its source."""
    c = F.array(F.col("text"), F.concat(F.lit("A view of "), "text"), F.reverse("text"), F.col("source"))
    return images.select(F.col("doc_id").alias("image_id"), F.col("lang").alias("image"), c.alias("captions"))


SQL_C4 = """c4 AS (SELECT doc_id AS image_id, lang AS image, unnest([0, 1, 2, 3]) AS pos, unnest([text, 'A view of ' || text, reverse(text), source]) AS text FROM documents),
cs AS (SELECT *, image_id * 4 + pos AS sentence_id FROM c4)"""


def caption_rows(images):
    rows = captioned(images).select("image_id", "image", F.posexplode("captions").alias("pos", "text"))
    return rows.withColumn("sentence_id", F.col("image_id") * 4 + F.col("pos"))


@CAT.add("win_04", "SELECT doc_id AS image_id, doc_id * 4 + i AS sentence_id, CASE i WHEN 0 THEN text WHEN 1 THEN lang WHEN 2 THEN source ELSE 'x' END AS raw FROM documents, (SELECT unnest([0, 1, 2, 3]) AS i)")
def win_04(spark, sf):
    """Running image and sentence ids."""
    numbered = N.number_by_id(docs(spark, sf), "doc_id", name="image_id")
    return C.with_sentence_ids(numbered, "image_id", F.array("text", "lang", "source", F.lit("x")))


@CAT.add("jn_15", "SELECT doc_id, doc_id * 4 + i AS sentence_id FROM documents, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE lang = 'de'")
def jn_15(spark, sf):
    """Image index → positions of its captions."""
    listed = docs(spark, sf).filter("lang = 'de'").select("doc_id")
    return S.caption_positions(listed, "doc_id")


def neighbours(spark, sf):
    """Neighbour table derived from the words: three candidates per distinct token."""
    words = docs(spark, sf).select(F.explode(F.array_distinct(X.tokenise(F.col("text")))).alias("token")).distinct()
    n = F.length("token")
    options = F.array(
        F.struct(F.concat(F.lit("X"), "token").alias("candidate"), (n % 10 / 10.0).alias("similarity"), tag_of("token").alias("tag"), F.lit(1.0).alias("score")),
        F.struct(F.concat("token", F.lit("s")).alias("candidate"), F.lit(0.9).alias("similarity"), tag_of("token").alias("tag"), (n % 3).cast("double").alias("score")),
        F.struct(F.lit("zzz").alias("candidate"), F.lit(0.99).alias("similarity"), F.lit("JJ").alias("tag"), F.lit(9.0).alias("score")),
    )
    return words.select("token", F.inline(options))


def tag_of(token):
    n = F.length(token) % 5
    return F.when(n == 0, "NN").when(n == 1, "VB").when(n == 2, "EX").when(n == 3, "VBZ").otherwise("JJ")


SQL_AUG = f"""tk AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents)),
tg AS (SELECT *, CASE length(token) % 5 WHEN 0 THEN 'NN' WHEN 1 THEN 'VB' WHEN 2 THEN 'EX' WHEN 3 THEN 'VBZ' ELSE 'JJ' END AS tag FROM tk),
nx AS (SELECT *, lead(tag) OVER (PARTITION BY doc_id ORDER BY pos) AS next_tag FROM tg),
rp AS (SELECT *, CASE WHEN tag = 'EX' AND next_tag = 'VBZ' THEN 'it' WHEN tag IN ('NN', 'VB') THEN
 CASE WHEN (length(token) % 10) / 10.0 >= 0.65 AND (length(token) % 3 < 1 OR (length(token) % 3 = 1 AND 'X' || token < token || 's')) THEN 'X' || token ELSE token || 's' END ELSE token END AS w FROM nx),
ag AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS augmented FROM rp GROUP BY doc_id)"""


@CAT.add("jn_18", f"WITH {SQL_AUG} SELECT doc_id, augmented FROM ag")
def jn_18(spark, sf):
    """Nouns and verbs replaced by their best same-tag neighbour."""
    tokens = docs(spark, sf).select(F.col("doc_id").alias("id"), X.tokenise(F.col("text")).alias("tokens"))
    tagged = tokens.withColumn("tags", F.transform("tokens", tag_of))
    return U.augment_sentences(tagged, neighbours(spark, sf)).select(F.col("id").alias("doc_id"), "augmented")


@CAT.add(
    "flt_04",
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents)
SELECT token, 'X' || token AS candidate FROM w WHERE (length(token) % 10) / 10.0 >= 0.65 UNION ALL SELECT token, token || 's' FROM w UNION ALL SELECT token, 'zzz' FROM w""",
)
def flt_04(spark, sf):
    """Candidates at or above the similarity limit."""
    return U.usable_candidates(neighbours(spark, sf)).select("token", "candidate")


def aligned(spark, sf):
    base = docs(spark, sf).select(F.col("doc_id").alias("image_id"), (F.col("doc_id") * 4).alias("sentence_id"), F.col("text").alias("caption"), "lang")
    changed = X.untokenise(X.replace_word(X.tokenise(F.col("text")), "the", "a"))
    aug = docs(spark, sf).select(F.col("doc_id").alias("image_id"), (F.col("doc_id") * 4).alias("sentence_id"), changed.alias("augmented"))
    return U.align(base, aug)


SQL_FAIL = f"al AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{TOKEN}') AS t FROM documents), fl AS (SELECT *, CASE WHEN list_contains(t, 'the') THEN 0 ELSE 1 END AS same FROM al)"


@CAT.add("jn_19", f"WITH {SQL_FAIL} SELECT doc_id AS image_id, doc_id * 4 AS sentence_id, text AS caption, array_to_string(list_transform(t, lambda x: CASE WHEN x = 'the' THEN 'a' ELSE x END), ' ') AS augmented FROM al")
def jn_19(spark, sf):
    """Original beside augmented sentence."""
    return aligned(spark, sf).select("image_id", "sentence_id", "caption", "augmented")


@CAT.add("agg_15", f"WITH {SQL_FAIL} SELECT 'all' AS class, round(avg(same), 6) AS failed FROM fl UNION ALL SELECT lang, round(avg(same), 6) FROM fl GROUP BY lang UNION ALL SELECT 'block ' || (doc_id // 500), round(avg(same), 6) FROM fl GROUP BY doc_id // 500")
def agg_15(spark, sf):
    """Failed-augmentation rate overall, per class, and per block of 500."""
    pairs = aligned(spark, sf)
    blocks = N.blocks_of(pairs, "image_id", 500).withColumn("class", F.concat(F.lit("block "), F.col("block").cast("string")))
    total = U.failed_rate(pairs).select(F.lit("all").alias("class"), rounded("failed"))
    per = U.failed_rate(pairs.withColumnRenamed("lang", "class"), "class").select("class", rounded("failed"))
    return total.unionByName(per).unionByName(U.failed_rate(blocks, "class").select("class", rounded("failed")))


@CAT.add("agg_16", f"SELECT max(least(len(regexp_extract_all(text, '{TOKEN}')), 128))::INTEGER AS longest FROM documents")
def agg_16(spark, sf):
    """Longest caption in tokens, limited to 128."""
    return U.longest(docs(spark, sf), "text")


@CAT.add(
    "prj_11",
    "SELECT doc_id, text AS raw, 2 AS fields FROM documents",
)
def prj_11(spark, sf):
    """Nested token lists dropped."""
    s = F.struct(F.lit(0).alias("sentence_id"), F.col("text").alias("raw"), X.tokenise(F.col("text")).alias("tokens"))
    lean = U.drop_tokens(docs(spark, sf).select("doc_id", F.array(s).alias("sentences")))
    n_fields = len(lean.schema["sentences"].dataType.elementType.fields)
    return lean.select("doc_id", F.col("sentences")[0]["raw"].alias("raw"), F.lit(n_fields).alias("fields"))


@CAT.add("pair_01", f"WITH {SQL_C4}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('42:' || sentence_id), sentence_id) AS r FROM cs) SELECT 'all' AS form, image_id, sentence_id, text FROM cs UNION ALL SELECT 'one', image_id, sentence_id, text FROM r WHERE r = 1")
def pair_01(spark, sf):
    """Image–caption pairs: all four captions, and one sampled caption."""
    rows = caption_rows(docs(spark, sf))
    cols = ["image_id", "sentence_id", "text"]
    every = S.image_captions(rows).select(F.lit("all").alias("form"), *cols)
    return every.unionByName(S.image_captions(rows, n=1).select(F.lit("one").alias("form"), *cols))


@CAT.add("pair_02", f"WITH {SQL_C4} SELECT a.image_id, a.pos AS pos1, b.pos AS pos2, a.text AS first, b.text AS second FROM cs a JOIN cs b ON a.image_id = b.image_id AND a.pos < b.pos")
def pair_02(spark, sf):
    """Image with every 2-combination of its captions."""
    return S.caption_triplets(captioned(docs(spark, sf)))


@CAT.add(
    "pair_03",
    f"""WITH {SQL_C4}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('42:' || sentence_id), sentence_id) AS r FROM cs)
SELECT image_id, max(text) FILTER (r = 1) AS first, max(text) FILTER (r = 2) AS second FROM r GROUP BY image_id""",
)
def pair_03(spark, sf):
    """Image with two sampled captions."""
    return S.two_captions(caption_rows(docs(spark, sf)))


@CAT.add("pair_04", f"WITH {SQL_C4} SELECT image_id, sentence_id, image, image || '_aug' AS image_aug, text, lower(text) AS text_aug FROM cs")
def pair_04(spark, sf):
    """Image, augmented image, caption, augmented caption."""
    # each text moves once, before its captions are made of it
    placed = docs(spark, sf).repartition("doc_id")
    rows = caption_rows(placed)
    imgs = captioned(placed).select("image_id", "image")
    aug_imgs = imgs.select("image_id", F.concat("image", F.lit("_aug")).alias("image_aug"))
    aug = rows.select("image_id", "sentence_id", F.lower("text").alias("text_aug"))
    return S.quadruplets(imgs, aug_imgs, rows.select("image_id", "sentence_id", "text"), aug)
