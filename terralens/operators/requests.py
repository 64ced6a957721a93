"""Requests, routing, dialogue tables and the evaluation of a request classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import number_in_buckets

# fixed values: request categories with and without an image
IMAGE_CATEGORIES = ["IMAGE_RETRIEVAL_BY_IMAGE", "BINARY_VISUAL_QA", "IMAGE_SEGMENTATION", "OBJECT_COUNTING", "None"]
TEXT_CATEGORIES = ["IMAGE_RETRIEVAL_BY_CAPTION", "IMAGE_RETRIEVAL_BY_METADATA", "GEOGRAPHY_QA", "None"]
CHECKED_TWICE = ["OBJECT_COUNTING", "IMAGE_SEGMENTATION", "IMAGE_RETRIEVAL_BY_IMAGE"]
# fixed value: answer to a caption search that is not about vessels
VESSEL_ONLY = "My 'Search by Caption' engine is designed to help you specifically with image searches related to vessels."


def candidate_categories(has_image):
    """Categories offered to the classifier."""
    return F.when(has_image, F.array(*[F.lit(c) for c in IMAGE_CATEGORIES])).otherwise(
        F.array(*[F.lit(c) for c in TEXT_CATEGORIES])
    )


def has_image(category):
    """Requests of these categories come with an image."""
    return category.isin([c for c in IMAGE_CATEGORIES if c != "None"])


def final_category(first, second):
    """Rename the geography category; three categories take the outcome of the yes/no check."""
    named = F.when(first == "GEOGRAPHY_QA", F.lit("GEOSPATIAL_QA")).otherwise(first)
    return F.when(named.isin(CHECKED_TWICE) & second.isNotNull(), second).otherwise(named)


def route(exists, category, is_vessel, image_type):
    """Engine and answer of a classified request: ``struct(category, answer)``."""
    chat = ~F.coalesce(exists, F.lit(False)) | (category == "None") | category.isNull()
    refused = (category == "IMAGE_RETRIEVAL_BY_CAPTION") & ~is_vessel
    to_caption = (category == "IMAGE_RETRIEVAL_BY_METADATA") & is_vessel
    typed = (category == "IMAGE_RETRIEVAL_BY_IMAGE") & image_type.isNotNull()
    target = (
        F.when(chat, F.lit("CHAT"))
        .when(to_caption, F.lit("IMAGE_RETRIEVAL_BY_CAPTION"))
        .when(typed, F.concat_ws("_", image_type, category))
        .otherwise(category)
    )
    answer = F.when(chat, F.lit(None).cast("string")).when(refused, F.lit(VESSEL_ONLY)).otherwise(
        F.concat(F.lit(" "), target, F.lit(" answer [Link]"))
    )
    return F.struct(target.alias("category"), answer.alias("answer"))


def yes_no(scores, limit=0.5):
    return F.when(F.array_max(scores) > limit, F.lit("yes")).otherwise(F.lit("no"))


def metadata_filter(
    products: DataFrame, ranges=None, equals=None, after=None, before=None, month=None, around=None, window_days=7, when="taken"
) -> DataFrame:
    """Metadata predicates on a wide product table.

    ``ranges {column: (low, high)}`` are open at the ends and may be None; ``equals``
    holds exact values; ``after``/``before`` are dates, ``month`` is ``YYYY-MM``,
    ``around`` a date with a window of ± ``window_days``.
    """
    out = products
    for column, (low, high) in (ranges or {}).items():
        if low is not None:
            out = out.filter(F.col(column) > low)
        if high is not None:
            out = out.filter(F.col(column) < high)
    for column, value in (equals or {}).items():
        out = out.filter(F.col(column) == value)
    day = F.to_date(F.col(when))
    if after:
        out = out.filter(day > F.lit(after).cast("date"))
    if before:
        out = out.filter(day < F.lit(before).cast("date"))
    if month:
        first = F.lit(f"{month}-01").cast("date")
        out = out.filter((day >= first) & (day < F.add_months(first, 1)))
    if around:
        centre = F.lit(around).cast("date")
        out = out.filter(day.between(F.date_sub(centre, window_days), F.date_add(centre, window_days)))
    return out


def misclassified(results: DataFrame) -> DataFrame:
    return results.filter(F.col("expected") != F.col("detected"))


def confusion_counts(results: DataFrame) -> DataFrame:
    """Long confusion matrix ``(expected, detected, n)``."""
    return results.groupBy("expected", "detected").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(results: DataFrame, classes) -> DataFrame:
    """One row per expected class, one column per class in ``classes`` order, zeros filled."""
    pivoted = results.groupBy("expected").pivot("detected", list(classes)).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0)


def classes_by_appearance(results: DataFrame, order) -> list:
    """Expected classes in order of first appearance; there are as many as classes, not rows."""
    first = results.groupBy("expected").agg(F.min(order).alias("at")).orderBy("at", "expected")
    return [r["expected"] for r in first.collect()]


def classification_report(results: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages and accuracy; 0/0 is 1.

    The counts are reduced to the confusion table first; all the rest runs on it.
    """
    counts = confusion_counts(results)
    expected = counts.groupBy(F.col("expected").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("detected"), F.col("n")).otherwise(0)).alias("tp")
    )
    detected = counts.groupBy(F.col("detected").alias("label")).agg(F.sum("n").alias("predicted"))
    per = expected.join(detected, "label", "full").select(
        "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "predicted")]
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(1.0))

    tp = F.col("tp").cast("double")
    scored = per.select(
        "label",
        ratio(tp, F.col("predicted")).alias("precision"),
        ratio(tp, F.col("support")).alias("recall"),
        ratio(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )
    total = F.sum("support")
    averages = scored.agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        (F.sum("tp") / total).alias("acc"),
        total.alias("n"),
    )

    def line(name, p, r, f):
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n").alias("support"))

    acc = F.col("acc")
    summary = averages.select(
        F.inline(
            F.array(
                line("accuracy", acc, acc, acc),
                line("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
                line("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
            )
        )
    )
    return scored.drop("tp").unionByName(summary)


def answer_accuracy(answers: DataFrame) -> DataFrame:
    """Accuracy of yes/no answers, of the others, overall, and the mean of the first two.

    ``answers(predicted, truth)``.
    """
    hit = (F.col("predicted") == F.col("truth")).cast("double")
    closed = F.col("truth").isin("yes", "no")
    scores = answers.agg(
        F.avg(F.when(closed, hit)).alias("yes_no"), F.avg(F.when(~closed, hit)).alias("land_cover"), F.avg(hit).alias("overall")
    )
    return scores.withColumn("average", (F.col("yes_no") + F.col("land_cover")) / 2)


def macro_f1(scores: DataFrame, logits="logits", labels="labels", threshold=0.5) -> DataFrame:
    """Mean over classes of the F1 of thresholded sigmoid scores; a class never seen or predicted counts 0."""
    zipped = F.arrays_zip(F.col(logits).alias("x"), F.col(labels).alias("y"))
    each = scores.select(F.posexplode(zipped).alias("class", "e"))
    p = 1 / (1 + F.exp(-F.col("e.x"))) > threshold
    y = F.col("e.y") > 0
    per = each.groupBy("class").agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn")
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per.agg(F.avg(f1).alias("macro_f1"))


def dialogue_pairs(turns: DataFrame, chunk=1000) -> DataFrame:
    """Every user turn with the answer if that is the next turn told: ``(conv_id, turn, input, answer)``.

    Turns are numbered by their place in the conversation, so skipped turn numbers lose no answer; a window holds at
    most ``chunk`` turn numbers of one conversation.
    """
    keyed = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / chunk).alias("_part"))
    placed = number_in_buckets(keyed, ["_part"], ["turn"], name="place", group=["conv_id"])
    users = placed.filter(F.col("role") == "user").select("conv_id", "turn", "place", F.col("text").alias("input"))
    replies = placed.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("place") - 1).alias("place"), F.col("text").alias("answer")
    )
    return users.join(replies, ["conv_id", "place"], "left").drop("place")


def transcripts(turns: DataFrame, chunk=1000) -> DataFrame:
    """Turns of a conversation in order, at most ``chunk`` turn numbers per row.

    An ordinary dialogue is one row ``part = 0``; a very long one continues in further parts.
    """
    part = F.floor(F.col("turn") / chunk)
    entry = F.struct("turn", "role", "text")
    return turns.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("turns"))
