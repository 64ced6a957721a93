"""Column expressions over numeric arrays: vectors, codes, bands and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F


def as_doubles(v):
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def let(value, body):
    """Evaluate ``value`` once per row and use it inside ``body`` (lambdas would recompute it per element)."""
    return F.transform(F.array(value), body)[0]


def total(v):
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b):
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v):
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalise(v):
    """Divide by the Euclidean norm; an all-zero vector stays as it is."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))


def squared_distance(a, b):
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a, b):
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sign_code(v):
    """Component signs: -1, 0 or 1."""
    return F.transform(v, lambda x: F.signum(x).cast("tinyint"))


def delivery_code(code):
    """-1 becomes 0; 0 and 1 stay."""
    return F.transform(code, lambda x: F.when(x < 0, F.lit(0)).otherwise(x).cast("tinyint"))


def pack_bits(v, dim, word=32):
    """Positive components as set bits, ``word`` bits per BIGINT, lowest bit first."""
    words = []
    for base in range(0, dim, word):
        part = F.slice(v, base + 1, min(word, dim - base))
        bits = F.transform(
            part,
            lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
                F.lit(0).cast("bigint")
            ),
        )
        words.append(F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x)))
    return F.array(*words)


def packed_hamming(a, b):
    """Number of differing bits of two packed codes."""
    diff = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(diff, F.lit(0), lambda acc, x: acc + x)


def code_distance(a, b):
    """Hamming distance of -1/0/1 codes from their inner product: (bits - a.b) / 2."""
    return (F.size(a) - dot(a.cast("array<double>"), b.cast("array<double>"))) * 0.5


def min_max(v):
    """Scale to [0, 1]; null for a constant array."""
    bounds = F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))

    def scale(b):
        return F.when(b["high"] > b["low"], F.transform(v, lambda x: (x - b["low"]) / (b["high"] - b["low"])))

    return let(bounds, scale)


def multi_hot(labels, classes):
    """0/1 per class; unknown or missing labels are an error."""
    names = F.array(*[F.lit(c.lower()) for c in classes])
    known = F.array_distinct(F.transform(labels, lambda x: F.lower(x)))
    bad = F.raise_error(F.concat(F.lit("labels outside the class list: "), F.array_join(labels, "|")))

    def check(low):
        hot = F.transform(names, lambda c: F.array_contains(low, c).cast("int"))
        hits = F.size(F.array_intersect(low, names))
        return F.when((hits >= 1) & (hits == F.size(low)), hot).otherwise(bad)

    return let(known, check)


def hot_positions(hot):
    """Positions (from 0) of the non-zero entries."""
    marked = F.transform(hot, lambda x, i: F.when(x != 0, i))
    return F.filter(marked, lambda i: i.isNotNull())


def arg_max(v):
    """First position (from 0) of the largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v):
    powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def top_classes(probabilities, names, k):
    """The k best (p, pos, name) entries, best first, ties by position."""
    entries = F.transform(
        probabilities,
        lambda p, i: F.struct((-p).alias("neg"), i.alias("pos"), F.element_at(names, i + 1).alias("name")),
    )
    return F.transform(
        F.slice(F.array_sort(entries), 1, k),
        lambda e: F.struct((-e["neg"]).alias("p"), e["pos"].alias("pos"), e["name"].alias("name")),
    )


def add_arrays(arrays):
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)


def pool_states(states, layers, operation="sum"):
    """Sum or concatenate the last ``layers`` token matrices, then average over all tokens."""
    last = F.slice(states, -layers, layers)
    n_tokens = F.size(F.element_at(states, 1))
    dims = F.size(F.element_at(F.element_at(states, 1), 1))
    zeros = F.array_repeat(F.lit(0.0), dims)

    def token_sum(layer):
        return F.aggregate(layer, zeros, lambda acc, tok: F.zip_with(acc, tok, lambda x, y: x + y))

    per_layer = F.transform(last, token_sum)
    if operation == "sum":
        pooled = F.aggregate(per_layer, zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    elif operation == "concat":
        pooled = F.flatten(per_layer)
    else:
        raise ValueError(f"unknown operation {operation!r}")
    return F.transform(pooled, lambda x: x / n_tokens)


def clip_relevance(v, low_cut=(-0.25, 0.25), high_cut=(-13.0, 13.0)):
    """Divide by the L4 mean norm, drop the small band, limit and scale by the upper limit."""
    d0, d1 = high_cut[0] - low_cut[0], high_cut[1] - low_cut[1]
    scale = F.pow(total(F.transform(v, lambda x: F.pow(x, F.lit(4.0)))) / F.size(v), F.lit(0.25))

    def one(x, by):
        y = x / by
        rest = y - F.greatest(F.least(y, F.lit(low_cut[1])), F.lit(low_cut[0]))
        return F.greatest(F.least(rest, F.lit(d1)), F.lit(d0)) / F.lit(d1)

    return let(scale, lambda by: F.transform(v, lambda x: one(x, by)))


def standardise(v, mean, std):
    return F.transform(v, lambda x: (x - mean) / std)


def any_nonzero(v):
    return F.exists(v, lambda x: x != 0)


def crop_and_pad(bands, height, width, size=120, channels=10):
    """Keep the top-left ``size`` square of each row-major band and add zero bands up to ``channels``."""
    side_h, side_w = min(size, height), min(size, width)

    def crop(band):
        rows = [F.slice(band, r * width + 1, side_w) for r in range(side_h)]
        return F.concat(*rows)

    cropped = F.transform(bands, crop)
    blank = F.array_repeat(F.lit(0.0), side_h * side_w)
    return F.concat(cropped, F.array_repeat(blank, F.greatest(F.lit(channels) - F.size(bands), F.lit(0))))
