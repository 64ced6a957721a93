"""Captions of vessel images from counts, sizes and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.arrays import let
from ..sources.readers import segments
from . import spatial

# fixed values: number words
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# fixed values: box area limits and the size words
SIZE_LIMITS = (12, 24, 100, 450)
SIZE_WORDS = [
    ("very small", "boat"),
    ("small", "boat"),
    ("medium-sized", "boat"),
    ("big", "ship"),
    ("very big", "ship"),
]
NO_VESSEL = "other types of land use land cover classes"
MANY_FROM = 6


def number_words(n, compat=False):
    """English words of 0…999, ``NaN`` outside.

    ``compat`` keeps two known oddities of published captions: spaces around
    ``hundred`` with a spoken zero, and round tens above 100 without their hundreds.
    """
    n = n.cast("int")
    units, tens = F.array(*[F.lit(w) for w in UNITS]), F.array(*[F.lit(w) for w in TENS])

    def below_100(x):
        ten = F.get(tens, F.floor(x / 10).cast("int") - 2)
        return F.when(x < 20, F.get(units, x)).when(x % 10 == 0, ten).otherwise(F.concat_ws("-", ten, F.get(units, x % 10)))

    hundreds, rest = F.get(units, F.floor(n / 100).cast("int")), n % 100
    if compat:
        large = (
            F.when(rest < 20, F.concat(hundreds, F.lit(" hundred  "), F.get(units, rest)))
            .when(rest % 10 == 0, below_100(rest))
            .otherwise(F.concat(hundreds, F.lit(" hundred "), below_100(rest)))
        )
    else:
        large = F.concat(hundreds, F.lit(" hundred"), F.when(rest > 0, F.concat(F.lit(" "), below_100(rest))).otherwise(F.lit("")))
    return F.when((n < 0) | (n > 999), F.lit("NaN")).when(n < 100, below_100(n)).otherwise(large)


def size_class(area):
    """0…4 by box area."""
    a, b, c, d = SIZE_LIMITS
    return F.when(area < a, 0).when(area < b, 1).when(area < c, 2).when(area < d, 3).when(area >= d, 4)


def size_counts(boxes: DataFrame, key, area) -> DataFrame:
    """Boxes per size class and image: ``s0 … s4``."""
    sized = boxes.select(key, size_class(F.col(area)).alias("size"))
    return sized.groupBy(key).agg(*[F.count_if(F.col("size") == i).alias(f"s{i}") for i in range(5)])


def count_words(n, compat=False):
    return F.when(n >= MANY_FROM, F.lit("many")).otherwise(number_words(n, compat))


def size_phrase(counts, compat=False):
    """``two small boats and one big ship``; ``counts`` are five columns, smallest size first.

    ``compat`` keeps the oddities of published captions: two spaces before a single
    ``and``, the doubled number of several big ships, no ``and`` before several very
    big ships.
    """
    texts = []
    for i, ((word, noun), n) in enumerate(zip(SIZE_WORDS, counts)):
        several = F.concat_ws(" ", count_words(n, compat), F.lit(f"{word} {noun}s"))
        if compat and i == 3:
            several = F.concat_ws(" ", count_words(n, compat), number_words(n, compat), F.lit(f"{word} {noun}s"))
        texts.append(F.when(n == 1, F.lit(f"one {word} {noun}")).when(n > 1, several))
    if not compat:
        def joined(parts):
            n = F.size(parts)
            head = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), " ")
            return F.when(n <= 1, F.array_join(parts, " ")).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))

        return let(F.filter(F.array(*texts), lambda t: t.isNotNull()), joined)

    pieces = []
    for i, text in enumerate(texts):
        if i == 0:
            pieces.append(text)
            continue
        earlier = texts[0].isNotNull()
        for t in texts[1:i]:
            earlier = earlier | t.isNotNull()
        linked = F.when(earlier, F.concat(F.lit(" and "), text)).otherwise(text)
        pieces.append(F.when(counts[i] > 1, text).otherwise(linked) if i == 4 else linked)
    raw = F.array_join(F.filter(F.array(*pieces), lambda t: t.isNotNull()), " ")

    def relink(text):
        words = F.split(text, " and")
        n = F.size(words)
        tail = F.array(F.lit("and"), F.element_at(words, -1))
        sentence = F.array_join(F.concat(F.slice(words, 1, n - 1), tail), " ")
        return F.when(n > 2, F.trim(F.regexp_replace(sentence, r"\s+", " "))).otherwise(text)

    return let(raw, relink)


def templates(n, place, counts, compat=False):
    """The four captions of an image: count, sizes, count at the port or coast, count with place."""
    noun = F.when(n == 1, F.lit("vessel")).otherwise(F.lit("vessels"))
    verb = F.when(n == 1, F.lit("is present")).otherwise(F.lit("are present"))
    base = F.concat_ws(" ", count_words(n, compat), noun)
    before = F.when(place == "harbor", F.lit("in the port")).when(place == "coast", F.lit("near the seacoast"))
    after = F.when(place == "harbor", F.lit("in the harbor")).when(place == "coast", F.lit("near the coast"))
    none = F.lit(NO_VESSEL)
    return F.array(
        F.when(n == 0, none).otherwise(base),
        F.when(n == 0, none).otherwise(size_phrase(counts, compat)),
        F.when(n == 0, none).otherwise(F.concat_ws(" ", before, base, verb)),
        F.when(n == 0, none).otherwise(F.concat_ws(" ", base, after)),
    )


def with_sentence_ids(df: DataFrame, image_id, captions, per_image=4) -> DataFrame:
    """One row per caption with its running sentence id."""
    each = df.select(F.col(image_id).alias("image_id"), F.posexplode(captions).alias("pos", "raw"))
    return each.select("image_id", (F.col("image_id") * per_image + F.col("pos")).alias("sentence_id"), "raw")


def describe_images(images: DataFrame, lines: DataFrame, size=10.0, harbour_metres=10.0, compat=False) -> DataFrame:
    """Captions of annotated images end to end: ``(id, captions)``.

    ``images(id, height, box, boxes, geo_points)``: ``boxes`` are pixel rings with the origin
    below, ``box`` the bounds in degrees, ``geo_points`` the box corners and centroids in
    degrees. ``lines(line, points)`` is the coast.
    """
    flipped = F.transform("boxes", lambda r: G.flip_y(r, F.col("height")))
    sizes = F.transform(flipped, lambda r: size_class(G.ring_area(r)))
    counted = images.withColumn("_sizes", sizes)

    def boxes_of(size):
        return F.size(F.filter("_sizes", lambda s: s == size))

    counts = [boxes_of(i) for i in range(5)]
    n = F.size("boxes")
    busy = images.filter(F.size("geo_points") > 0).select("id", "box", F.col("geo_points").alias("points"))
    near = spatial.coast_distances(busy, lines, size).select("id", "min_m")
    coast = spatial.meets_coast(images.select("id", "box"), segments(lines), size).withColumn("coast", F.lit(True))
    placed = counted.join(near, "id", "left").join(coast, "id", "left")
    place = F.when(F.col("coast"), spatial.place_of(F.col("min_m"), harbour_metres))
    return placed.select("id", templates(n, place, counts, compat).alias("captions"))
