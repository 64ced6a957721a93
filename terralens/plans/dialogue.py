"""Requests, metadata filters, classifier evaluation and dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import requests as R
from .common import Catalogue, rounded, table

CAT = Catalogue()


def results(spark, sf):
    """Expected against detected class: quality against toxicity of the labelled documents."""
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    detected = F.when(F.col("n_chars") < 400, "short").when(F.col("toxic") == 1, "bad").when(F.col("n_chars") % 3 == 0, "good").otherwise("fair")
    expected = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "bad").otherwise("fair")
    return l.select("doc_id", "lang", expected.alias("expected"), detected.alias("detected"))


SQL_R = """r AS (SELECT l.doc_id, lang, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'bad' ELSE 'fair' END AS expected,
CASE WHEN n_chars < 400 THEN 'short' WHEN toxic = 1 THEN 'bad' WHEN n_chars % 3 = 0 THEN 'good' ELSE 'fair' END AS detected FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
CLASSES = ["good", "bad", "fair", "short"]


@CAT.add("agg_12", f"WITH {SQL_R} SELECT expected, " + ", ".join(f"count(*) FILTER (detected = '{c}') AS {c}" for c in CLASSES) + " FROM r GROUP BY expected")
def agg_12(spark, sf):
    """Confusion matrix."""
    return R.confusion_matrix(results(spark, sf), CLASSES)


@CAT.add(
    "agg_13",
    f"WITH {SQL_R} SELECT expected, " + ", ".join(f"count(*) FILTER (detected = '{c}') AS {c}" for c in CLASSES) + " FROM r WHERE expected <> detected GROUP BY expected",
)
def agg_13(spark, sf):
    """Misclassification matrix."""
    return R.confusion_matrix(R.misclassified(results(spark, sf)), CLASSES)


@CAT.add("flt_05", f"WITH {SQL_R} SELECT * FROM r WHERE expected <> detected")
def flt_05(spark, sf):
    """Misclassified rows."""
    return R.misclassified(results(spark, sf))


@CAT.add(
    "agg_14",
    f"""WITH {SQL_R}, c AS (SELECT DISTINCT unnest([expected, detected]) AS label FROM r),
k AS (SELECT label, (SELECT count(*) FROM r WHERE expected = label) AS support, (SELECT count(*) FROM r WHERE detected = label) AS pred, (SELECT count(*) FROM r WHERE expected = label AND detected = label) AS tp FROM c),
m AS (SELECT label, CASE WHEN pred > 0 THEN tp / pred ELSE 1 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 1 END AS recall, CASE WHEN pred + support > 0 THEN 2 * tp / (pred + support) ELSE 1 END AS f1, support, tp FROM k)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m""",
)
def agg_14(spark, sf):
    """Classification report."""
    report = R.classification_report(results(spark, sf))
    return report.select("label", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@CAT.add(
    "agg_17",
    """WITH a AS (SELECT CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'no' ELSE lang END AS truth,
 CASE WHEN n_chars % 5 = 0 THEN 'yes' WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'no' ELSE lang END AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
m AS (SELECT avg((truth = predicted)::INTEGER) FILTER (truth IN ('yes', 'no')) AS y, avg((truth = predicted)::INTEGER) FILTER (truth NOT IN ('yes', 'no')) AS l, avg((truth = predicted)::INTEGER) AS o FROM a)
SELECT round(y, 6) AS yes_no, round(l, 6) AS land_cover, round(o, 6) AS overall, round((y + l) / 2, 6) AS average FROM m""",
)
def agg_17(spark, sf):
    """Answer accuracy by question type."""
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    truth = F.when(F.col("quality") == 1, F.lit("yes")).when(F.col("toxic") == 1, F.lit("no")).otherwise(F.col("lang"))
    answers = l.select(F.when(F.col("n_chars") % 5 == 0, F.lit("yes")).otherwise(truth).alias("predicted"), truth.alias("truth"))
    return R.answer_accuracy(answers).select(rounded("yes_no"), rounded("land_cover"), rounded("overall"), rounded("average"))


@CAT.add("cnd_05", "SELECT vec_id, CASE WHEN list_max(embedding) > 0.3 THEN 'yes' ELSE 'no' END AS answer FROM embeddings")
def cnd_05(spark, sf):
    """Yes/no answer by the largest score."""
    return table(spark, sf, "embeddings").select("vec_id", R.yes_no(A.as_doubles("embedding"), 0.3).alias("answer"))


def classified(spark, sf):
    """A classifier's outcome columns derived per document."""
    k = F.col("n_chars") % 7
    category = (
        F.when(k == 0, "IMAGE_RETRIEVAL_BY_CAPTION")
        .when(k == 1, "IMAGE_RETRIEVAL_BY_METADATA")
        .when(k == 2, "IMAGE_RETRIEVAL_BY_IMAGE")
        .when(k == 3, "GEOGRAPHY_QA")
        .when(k == 4, "OBJECT_COUNTING")
        .when(k == 5, "IMAGE_SEGMENTATION")
        .otherwise("None")
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        "n_chars",
        category.alias("category"),
        (F.col("doc_id") % 11 != 0).alias("exists"),
        (F.col("doc_id") % 2 == 0).alias("is_vessel"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("Sentinel-1")).alias("image_type"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("BINARY_VISUAL_QA")).alias("second"),
    )


SQL_CL = """c AS (SELECT doc_id, CASE n_chars % 7 WHEN 0 THEN 'IMAGE_RETRIEVAL_BY_CAPTION' WHEN 1 THEN 'IMAGE_RETRIEVAL_BY_METADATA' WHEN 2 THEN 'IMAGE_RETRIEVAL_BY_IMAGE' WHEN 3 THEN 'GEOGRAPHY_QA'
 WHEN 4 THEN 'OBJECT_COUNTING' WHEN 5 THEN 'IMAGE_SEGMENTATION' ELSE 'None' END AS category FROM documents)"""


@CAT.add(
    "cnd_06",
    f"""WITH {SQL_CL}, t AS (SELECT doc_id, category, CASE WHEN doc_id % 11 = 0 OR category = 'None' THEN 'CHAT'
 WHEN category = 'IMAGE_RETRIEVAL_BY_METADATA' AND doc_id % 2 = 0 THEN 'IMAGE_RETRIEVAL_BY_CAPTION'
 WHEN category = 'IMAGE_RETRIEVAL_BY_IMAGE' AND doc_id % 3 = 0 THEN 'Sentinel-1_IMAGE_RETRIEVAL_BY_IMAGE' ELSE category END AS target FROM c)
SELECT doc_id, target, CASE WHEN target = 'CHAT' THEN NULL WHEN category = 'IMAGE_RETRIEVAL_BY_CAPTION' AND doc_id % 2 = 1 THEN 'My ''Search by Caption'' engine is designed to help you specifically with image searches related to vessels.'
 ELSE ' ' || target || ' answer [Link]' END AS answer FROM t""",
)
def cnd_06(spark, sf):
    """Route a classified request to its engine."""
    routed = R.route(F.col("exists"), F.col("category"), F.col("is_vessel"), F.col("image_type"))
    return classified(spark, sf).select("doc_id", routed.alias("r")).select("doc_id", F.col("r.category").alias("target"), F.col("r.answer").alias("answer"))


@CAT.add(
    "cnd_07",
    f"""WITH {SQL_CL} SELECT doc_id, CASE WHEN category IN ('OBJECT_COUNTING', 'IMAGE_SEGMENTATION', 'IMAGE_RETRIEVAL_BY_IMAGE') THEN 'IMAGE_RETRIEVAL_BY_IMAGE, BINARY_VISUAL_QA, IMAGE_SEGMENTATION, OBJECT_COUNTING, None'
 ELSE 'IMAGE_RETRIEVAL_BY_CAPTION, IMAGE_RETRIEVAL_BY_METADATA, GEOGRAPHY_QA, None' END AS candidates,
CASE WHEN category = 'GEOGRAPHY_QA' THEN 'GEOSPATIAL_QA' WHEN category IN ('OBJECT_COUNTING', 'IMAGE_SEGMENTATION', 'IMAGE_RETRIEVAL_BY_IMAGE') AND doc_id % 4 = 0 THEN 'BINARY_VISUAL_QA' ELSE category END AS final FROM c""",
)
def cnd_07(spark, sf):
    """Candidate categories, renaming and second check."""
    offered = F.array_join(R.candidate_categories(R.has_image(F.col("category"))), ", ")
    return classified(spark, sf).select("doc_id", offered.alias("candidates"), R.final_category(F.col("category"), F.col("second")).alias("final"))


# --- metadata ---


def products(spark, sf):
    """Wide product table from events: cloud and snow percentage, platform, acquisition time."""
    props = F.from_json("props", "MAP<STRING, STRING>")
    return table(spark, sf, "events").select(
        "event_id",
        props.alias("properties"),
        F.col("ts").alias("taken"),
        F.when(F.col("user_id") % 2 == 0, F.lit("sentinel-2a")).otherwise(F.lit("sentinel-2b")).alias("platform"),
        F.col("event_type").alias("product_type"),
        "value",
    ).withColumn("cloud", F.col("properties")["k"].try_cast("double"))


SQL_PR = """p AS (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS cloud, ts, CASE WHEN user_id % 2 = 0 THEN 'sentinel-2a' ELSE 'sentinel-2b' END AS platform, event_type, value FROM events)"""


@CAT.add(
    "flt_02",
    f"""WITH {SQL_PR} SELECT event_id, 'range' AS question FROM p WHERE cloud > 15 AND value < 10 UNION ALL
SELECT event_id, 'exact' FROM p WHERE platform = 'sentinel-2b' AND event_type = 'click' AND cloud < 25 UNION ALL SELECT event_id, 'clear' FROM p WHERE cloud = 0""",
)
def flt_02(spark, sf):
    """Percentage ranges, exact platform and product type, no clouds."""
    p = products(spark, sf)
    questions = {
        "range": R.metadata_filter(p, ranges={"cloud": (15, None), "value": (None, 10)}),
        "exact": R.metadata_filter(p, ranges={"cloud": (None, 25)}, equals={"platform": "sentinel-2b", "product_type": "click"}),
        "clear": R.metadata_filter(p, equals={"cloud": 0.0}),
    }
    parts = [df.select("event_id", F.lit(q).alias("question")) for q, df in questions.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@CAT.add("flt_08", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS absent FROM events")
def flt_08(spark, sf):
    """Property lookup by key in a JSON map; absent keys are null."""
    return products(spark, sf).select("event_id", F.col("properties")["k"].alias("k"), F.col("properties")["addr:city"].alias("absent"))


@CAT.add(
    "dat_01",
    """SELECT o_orderkey, 'after' AS question FROM orders WHERE o_orderdate::DATE > DATE '2000-05-31' UNION ALL
SELECT o_orderkey, 'month' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' AND o_orderdate < TIMESTAMP '1999-01-01' UNION ALL
SELECT o_orderkey, 'around' FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1999-01-25' AND DATE '1999-02-08'""",
)
def dat_01(spark, sf):
    """After a month, during a month, around a day; dates come from dateTime text."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    o = table(spark, sf, "orders").select("o_orderkey", text.alias("t")).withColumn("taken", F.try_to_timestamp("t"))
    questions = {
        "after": R.metadata_filter(o, after="2000-05-31"),
        "month": R.metadata_filter(o, month="1998-12"),
        "around": R.metadata_filter(o, around="1999-02-01", window_days=7),
    }
    parts = [df.select("o_orderkey", F.lit(q).alias("question")) for q, df in questions.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- dialogues ---


@CAT.add(
    "win_08",
    """WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn * 3 + turn // 2 AS turn, text AS input, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM n WHERE role = 'user'""",
)
def win_08(spark, sf):
    """Each user turn with the answer that follows; the turn numbers have gaps."""
    turns = table(spark, sf, "conversations").withColumn("turn", (F.col("turn") * 3 + F.floor(F.col("turn") / 2)).cast("bigint"))
    return R.dialogue_pairs(turns)


@CAT.add(
    "agg_31",
    """SELECT conv_id, turn // 1000 AS part, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id, part""",
)
def agg_31(spark, sf):
    """Dialogue transcript in turn order."""
    t = R.transcripts(table(spark, sf, "conversations"))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return t.select("conv_id", "part", F.array_join(lines, "\n").alias("transcript"))
