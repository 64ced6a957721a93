"""Caption augmentation tables: candidates, replacement, language choice, failure rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import materialise
from . import numbering

# fixed values: tags whose words may be replaced, similarity limits, language weights
NOUNS = ["NN", "NNS", "NNP", "NNPS"]
VERBS = ["VB", "VBD", "VBG", "VBN"]
SIMILARITY = 0.65
LANGUAGE_WEIGHTS = {"es": 1, "de": 1}
EACH_IMAGE_RANDOM = ["rotation_cc", "blur_cc", "jitter_cc"]
OPEN = NOUNS + VERBS
#: Bytes of words of the sentences that share a word list.
CHUNK_BYTES = 1 << 25


def usable_candidates(neighbours: DataFrame, threshold=SIMILARITY) -> DataFrame:
    """Drop neighbours below the similarity limit. ``neighbours(token, candidate, similarity, tag)``."""
    return neighbours.filter(F.col("similarity") >= threshold)


def best_candidates(neighbours: DataFrame, threshold=SIMILARITY) -> DataFrame:
    """Best candidate per ``(token, tag)`` by sentence score, ties to the smaller word."""
    kept = usable_candidates(neighbours, threshold)
    pick = F.min(F.struct((-F.col("score")).alias("neg"), "candidate")).alias("best")
    return kept.groupBy("token", "tag").agg(pick).select("token", "tag", F.col("best.candidate").alias("replacement"))


def augment_sentences(sentences: DataFrame, neighbours: DataFrame, threshold=SIMILARITY, token_scores=None, chunk_bytes=CHUNK_BYTES) -> DataFrame:
    """Replace nouns and verbs by their best same-tag neighbour: ``(id, augmented)``.

    ``sentences(id, tokens, tags)``. Without ``token_scores`` a candidate's ``score`` belongs to
    the word, so the best one per word is found once, before any sentence is touched, and only the distinct words of
    a chunk of sentences meet it.
    ``token_scores(id, pos, candidate, score)`` gives scores per place instead.
    """
    nexts = F.concat(F.slice("tags", 2, F.greatest(F.size("tags") - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    zipped = F.arrays_zip(F.col("tokens").alias("token"), F.col("tags").alias("tag"), nexts.alias("next_tag"))
    placed = sentences.select("id", zipped.alias("places"))
    if token_scores is not None:
        return _by_place(placed, usable_candidates(neighbours, threshold), token_scores)
    chunks, done = _by_chunk(placed, best_candidates(neighbours, threshold), chunk_bytes)
    # rows of one id are one sentence; ids of a single row are never gathered
    many = chunks.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = materialise(many.select(F.col("id").alias("again")), "many")
    single = done if many.isEmpty() else done.join(many, F.col("id").eqNullSafe(F.col("again")), "left_anti")
    augmented = single.select("id", X.untokenise(F.col("words")).alias("augmented"))
    if many.isEmpty():
        return augmented
    several = done.join(many, F.col("id").eqNullSafe(F.col("again")), "left_semi")
    told = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("w")))
    return augmented.unionByName(_gathered(several.select("id", told.alias("told")), F.flatten(F.collect_list("told"))))


def _expletive(tag, next_tag):
    return (tag == "EX") & (next_tag == "VBZ")


def _gathered(rows, places):
    """The words of each id in order; a sentence came from one row, so its tokens fit one row again."""
    # sort_array compares by itself, array_sort through an expression for each comparison
    done = rows.groupBy("id").agg(F.transform(F.sort_array(places), lambda e: e["w"]).alias("words"))
    return done.select("id", X.untokenise(F.col("words")).alias("augmented"))


def _by_place(placed, pool, token_scores):
    """Scores per place: every token of an open class meets its own candidates."""
    # partitioned by sentence before the explode
    each = placed.repartition("id").select("id", F.posexplode("places").alias("pos", "t")).select("id", "pos", "t.*")
    pool = pool.select("token", "tag", "candidate")
    pick = F.min(F.struct((-F.col("score")).alias("neg"), "candidate")).alias("best")
    best = (
        each.filter(F.col("tag").isin(OPEN))
        .join(pool, ["token", "tag"])
        .join(token_scores, ["id", "pos", "candidate"])
        .groupBy("id", "pos")
        .agg(pick)
        .select("id", "pos", F.col("best.candidate").alias("replacement"))
    )
    word = F.when(_expletive(F.col("tag"), F.col("next_tag")), F.lit("it")).otherwise(F.coalesce("replacement", "token"))
    return _gathered(each.join(best, ["id", "pos"], "left"), F.collect_list(F.struct("pos", word.alias("w"))))


def _by_chunk(placed, best, chunk_bytes):
    """The stored chunks, and ``id, words`` of their sentences.

    A chunk holds sentences as places in a list of its distinct words, packed. Only these lists meet the candidates; each
    chunk and the replacements found for it move once to be written out.
    """
    tags = F.array(*[F.lit(t) for t in OPEN])

    def key(t):
        # one character for the class of the word, 0 for those that stay
        place = F.coalesce(F.array_position(tags, t["tag"]), F.lit(0)).cast("string")
        return F.when(_expletive(t["tag"], t["next_tag"]), F.lit("0it")).otherwise(F.concat(place, t["token"]))

    # rows without tokens are left out once coded: a filter here would be pushed down and read each text again
    kind = placed.schema["id"].dataType
    texts = T.ArrayType(T.StringType())
    stored = T.StructType().add("ids", T.ArrayType(kind)).add("sizes", T.ArrayType(T.IntegerType())).add("codes", T.BinaryType()).add("words", texts)
    keyed = placed.select("id", F.transform("places", key).alias("words"))
    chunks = materialise(keyed.mapInArrow(lambda batches: _coded(batches, chunk_bytes), stored).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    entries = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("code", "word"))
    tag = F.element_at(tags, F.substring("word", 1, 1).cast("int"))
    asked = entries.filter(F.col("word").isNotNull() & ~F.col("word").startswith("0"))
    asked = asked.select("of", "code", tag.alias("tag"), F.expr("substring(word, 2)").alias("token"))
    usable = best.filter(F.col("tag").isin(OPEN) & F.col("replacement").isNotNull())
    found = asked.join(usable, ["token", "tag"]).select("of", "code", "replacement")
    written = T.StructType().add("id", kind).add("words", texts)
    return chunks, chunks.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_written, written)


def _coded(batches, chunk_bytes):
    """Chunks of sentences whose words have at most ``chunk_bytes``; a longer sentence is one of its own."""
    held, size = [], 0
    for batch in batches:
        batch = batch.filter(batch.column("words").is_valid())
        words = batch.column("words")
        lengths = np.asarray(pc.fill_null(pc.binary_length(words.flatten()), 0), dtype="int64")
        upto = np.r_[0, np.cumsum(lengths + 4)][np.cumsum(np.asarray(words.value_lengths()))]
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(upto, before + chunk_bytes - size, "right")), start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size, before = size + int(upto[stop - 1]) - before, int(upto[stop - 1])
            if stop < batch.num_rows:
                yield _chunk(held)
                held, size = [], 0
            start = stop
    if held:
        yield _chunk(held)


def _list(values):
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunk(held):
    rows = pa.Table.from_batches(held)
    words = pa.concat_arrays(rows.column("words").chunks)
    told = words.flatten().dictionary_encode()
    codes = np.asarray(told.indices.fill_null(-1), dtype="<i4")
    # equal bytes stand together: mostly zeros in the upper ones
    packed = pa.compress(np.ascontiguousarray(codes.view("u1").reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)
    columns = [_list(pa.concat_arrays(rows.column("id").chunks)), _list(words.value_lengths()), pa.array([packed], pa.binary()), _list(told.dictionary)]
    return pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "codes", "words"])


def _written(chunk, found):
    """The sentences of a chunk with the replacements found for its words."""
    ids, sizes, words = (pa.concat_arrays(chunk.column(n).chunks).flatten() for n in ("ids", "sizes", "words"))
    ends = np.r_[0, np.cumsum(np.asarray(sizes))].astype("int32")
    count = int(ends[-1])
    packed = np.frombuffer(pa.decompress(chunk.column("codes")[0].as_py(), 4 * count, codec="zstd", asbytes=True), "u1")
    codes = np.ascontiguousarray(packed.reshape(4, -1).T).reshape(-1).view("<i4")
    own = pc.utf8_slice_codeunits(words, 1)
    pool = pa.concat_arrays([own, *[c.cast(own.type) for c in found.column("replacement").chunks]])
    place = np.arange(len(own) + 1)
    place[np.asarray(found.column("code"))] = len(own) + np.arange(found.num_rows)
    taken = pool.take(pa.array(place[codes], mask=codes < 0))
    return pa.table({"id": ids, "words": pa.ListArray.from_arrays(pa.array(ends), taken)})


def failed_rate(pairs: DataFrame, by=None) -> DataFrame:
    """Share of captions left unchanged, overall or per class. ``pairs(caption, augmented)``."""
    same = (X.untokenise(X.tokenise(F.col("caption"))) == F.col("augmented")).cast("double")
    return (pairs.groupBy(by) if by else pairs).agg(F.avg(same).alias("failed"))


def align(original: DataFrame, augmented: DataFrame) -> DataFrame:
    """Original and augmented sentence side by side, by ids instead of position."""
    return original.join(augmented, ["image_id", "sentence_id"])


def longest(captions: DataFrame, text, cap=128) -> DataFrame:
    """Longest token count, limited to the model's window."""
    n = F.size(X.tokenise(F.col(text)))
    return captions.agg(F.max(F.least(n, F.lit(cap))).alias("longest"))


def weighted_choice(df: DataFrame, ids, seed, weights, name="choice") -> DataFrame:
    """Pick one key of ``weights`` per row with probability proportional to its weight, repeatable by seed."""
    total = float(sum(weights.values()))
    u = numbering.unit_interval(numbering.seeded_key(seed, *ids))
    keys = list(weights)
    chain, upto = None, 0.0
    for key in keys[:-1]:
        upto += weights[key] / total
        chain = F.when(u < upto, F.lit(key)) if chain is None else chain.when(u < upto, F.lit(key))
    last = F.lit(keys[-1])
    return df.withColumn(name, last if chain is None else chain.otherwise(last))


def even_choice(df: DataFrame, ids, seed, options, name="choice") -> DataFrame:
    """Pick one of ``options`` per row with equal probability."""
    return weighted_choice(df, ids, seed, {o: 1 for o in options}, name)


def drop_tokens(images: DataFrame) -> DataFrame:
    """The caption dataset without the token lists."""
    return images.withColumn("sentences", F.transform("sentences", lambda s: s.dropFields("tokens")))
