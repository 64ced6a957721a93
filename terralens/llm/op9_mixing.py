"""Mixing of sources to target weights by the quotients of Sainte-Laguë; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .shared import written

CAT = Catalogue()

#: Weights of the sources in code point order, repeating, and the share of all words that the mix takes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No source and no document is taken more often.
MOST = 2
#: Words of a block, words of a shard at most about, and the seed of the block order.
BLOCK = 128
SHARD = 1 << 21
SEED = 17


def word_count(text):
    """The number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes, weights=WEIGHTS, share=SHARE, most=MOST):
    """Per source: its place in code point order (null last), source_size and target.

    The targets are ``level * weight``, but never above ``most`` times the source's size; the level is the one at which
    they sum to ``share`` of all words, which is where resharing the excess by weight ends.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    placed = (
        totals.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.get(wheel, (F.col("place") - 1) % len(weights)))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
    )
    filled = W.orderBy(F.col("cap") / F.col("weight"), "place")
    steps = (
        placed.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ahead", F.sum("weight").over(filled.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("ahead"))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place_in", "level"))).over(W.partitionBy())
    return (
        steps.withColumn("place_in", F.row_number().over(filled))
        .withColumn("first", level)
        .withColumn(
            "target",
            F.when(F.col("place_in") < F.coalesce(F.col("first.place_in"), F.lit(1 << 30)), F.col("cap")).otherwise(
                F.col("first.level") * F.col("weight")
            ),
        )
        .select("source", "place", "source_size", "target")
    )


def sainte_lague(parties, group, party, votes, seats):
    """``parties`` with ``quota``: each group's ``seats`` go one by one to the highest of the quotients votes / (k + 1/2).

    With V votes and n parties in the group, all quotients above V / (seats - n) win and none below V / (seats + n)
    does, so only those between, at most 3 n, are listed and ranked. Ties go to the smaller ``party``.
    """
    of = W.partitionBy(*group)
    live = (
        parties.where(F.col(votes) > 0)
        .withColumn("__all", F.sum(votes).over(of).cast("double"))
        .withColumn("__n", F.count(F.lit(1)).over(of))
    )
    above = F.when(
        F.col(seats) > F.col("__n"),
        F.greatest(F.lit(0), F.ceil(F.col(votes) * (F.col(seats) - F.col("__n")) / F.col("__all") - 0.5) - 1),
    ).otherwise(F.lit(0))
    below = F.floor(F.col(votes) * (F.col(seats) + F.col("__n")) / F.col("__all") - 0.5) + 1
    live = live.withColumn("__sure", above.cast("long")).withColumn("__last", below.cast("long"))
    ranked = (
        live.withColumn("__left", F.col(seats) - F.sum("__sure").over(of))
        .withColumn("__k", F.explode(F.expr("sequence(__sure, __last)")))
        .withColumn("__quotient", F.col(votes) / (F.col("__k") + 0.5))
        .withColumn("__rank", F.row_number().over(of.orderBy(F.col("__quotient").desc(), party, "__k")))
    )
    won = ranked.groupBy(*group, party).agg(
        (F.max("__sure") + F.count(F.when(F.col("__rank") <= F.col("__left"), 1))).alias("quota")
    )
    return parties.join(won, [*group, party], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def drawn_pieces(docs, text="text", weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shard=SHARD, seed=SEED):
    """Per row of ``docs`` and block that it reaches into: the piece's first word and length, and how it is taken.

    The documents of a source are dealt over shards by a seeded hash, and each shard's words, documents in seeded order,
    form blocks of ``block`` words. Sainte-Laguë gives each source a number of blocks by its target, then each of its
    shards a share of them by its words. A shard takes all its words as often as its quota covers them, and the rest
    as blocks in seeded order; the last is cut. The words by which a source's blocks miss its target are made up in its
    largest shard.
    """
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = written(
        docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.md5(name).alias("draw")), "sizes"
    )
    sources = written(source_targets(narrow, weights, share, most), "sources")
    seats = F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")
    sources = sainte_lague(sources.withColumn("seats", seats), [], "place", "target", "seats").withColumn(
        "shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1))
    )
    sources = written(sources.select("source", "place", "source_size", "target", "quota", "shards"), "quotas")
    dealt = (
        narrow.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.doc_id", "d.source", "size", "draw", "place", "source_size", "target", "shards")
        .withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards"))
    )
    cells = (
        dealt.groupBy("place", "shard")
        .agg(F.sum("size").alias("words"))
        .join(sources.select("place", "target", F.col("quota").alias("seats")), "place")
    )
    first = F.row_number().over(W.partitionBy("place").orderBy(F.col("words").desc(), "shard")) == 1
    missed = F.when(first, F.round("target") - F.col("seats") * block).otherwise(0)
    cells = (
        sainte_lague(cells, ["place"], "shard", "words", "seats")
        .withColumn("due", F.least(F.greatest(F.col("quota") * block + missed, F.lit(0)), F.col("words") * most).cast("long"))
        .select(F.col("place").alias("c_place"), F.col("shard").alias("c_shard"), "words", "due")
    )
    cell = W.partitionBy("place", "shard")
    placed = (
        dealt.withColumn("row", F.row_number().over(cell.orderBy("draw", "doc_id", "size")))
        .withColumn("start", F.sum("size").over(cell.orderBy("row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"greatest(start, start + size - 1) div {block}"))))
        .withColumn("piece", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("shard"), F.col("block")))
    drawn = (
        placed.join(cells, (F.col("place") == F.col("c_place")) & (F.col("shard") == F.col("c_shard")))
        .withColumn("order", order)
        .withColumn("ahead", F.sum("piece").over(cell.orderBy("order", "block", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("piece"))
        .withColumn("rounds", F.when(F.col("words") > 0, F.expr("due div words")).otherwise(0))
        .withColumn("rest", F.col("due") - F.col("rounds") * F.col("words"))
        .withColumn("extra", F.least(F.greatest(F.col("rest") - F.col("ahead"), F.lit(0)), F.col("piece")))
    )
    return drawn.withColumn("first", F.greatest("start", F.col("block") * block) - F.col("start"))


ROW = ["place", "shard", "row", "doc_id", "source", "size"]


def mix(docs, **settings):
    """Per row of ``docs``: doc_id, source, size, source_size, target and taken, the words that the mix takes of it.

    Null texts have no words, a null source is a source of its own, rows that repeat an id are taken each on its own,
    and an empty table gives an empty one. Only doc_id, source and the text are read.
    """
    return (
        drawn_pieces(docs, **settings)
        .groupBy(*ROW, "source_size", "target")
        .agg(F.sum(F.col("rounds") * F.col("piece") + F.col("extra")).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def mixed(docs, text="text", **settings):
    """The mix itself: rows like ``docs``, whole documents as often as all their words are taken, then one row with the
    words that are taken once more, joined by one blank, with n_chars, where there is such a column, told anew.

    Rows that repeat doc_id, source and size are all taken as the first of them is. Documents of which the mix takes no
    word give no row.
    """
    part = F.when(F.col("extra") > 0, F.struct("first", F.col("extra").alias("words")))
    plans = (
        drawn_pieces(docs, text, **settings)
        .groupBy(*ROW)
        .agg(F.max("rounds").alias("rounds"), F.sort_array(F.collect_list(part)).alias("parts"))
        .groupBy("doc_id", "source", "size")
        .agg(F.min_by(F.struct("rounds", "parts"), F.struct("shard", "row")).alias("plan"))
        .where("size > 0 AND (plan.rounds > 0 OR size(plan.parts) > 0)")
        .select(F.struct("doc_id", "source", "size").alias("__key"), "plan")
    )
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = F.flatten(F.transform("plan.parts", lambda p: F.slice("__words", p["first"].cast("int") + 1, p["words"].cast("int"))))
    again = F.when(F.size("plan.parts") > 0, F.array(F.array_join(chosen, " "))).otherwise(F.array().cast("array<string>"))
    told = docs.withColumn("__key", F.struct("doc_id", "source", word_count(F.col(text)).alias("size")))
    rows = (
        told.join(plans.withColumnRenamed("__key", "__plan_key"), F.col("__key").eqNullSafe(F.col("__plan_key")))
        .withColumn("__words", F.when(F.size("plan.parts") > 0, words))
        .withColumn("__text", F.explode(F.concat(F.array_repeat(F.col(text), F.col("plan.rounds").cast("int")), again)))
        .withColumn(text, F.col("__text"))
    )
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length(text).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)


@CAT.add(
    "op9_mixing",
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''))) AS draw FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(place - 1) % 3 + 1]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM p),
l AS (SELECT *, row_number() OVER o AS place_in,
        ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, place)),
f AS (SELECT min(place_in) AS free FROM l WHERE level * weight <= cap),
s AS (SELECT source, place, source_size,
        CASE WHEN place_in < (SELECT free FROM f) THEN cap
             ELSE (SELECT level FROM l WHERE place_in = (SELECT free FROM f)) * weight END AS target FROM l),
a AS (SELECT round(sum(target) / 128)::BIGINT AS seats FROM s),
q AS (SELECT place, count(*) AS quota FROM (
        SELECT place, row_number() OVER (ORDER BY target / (k + 0.5) DESC, place, k) AS r
        FROM s, (SELECT unnest(range((SELECT seats FROM a))) AS k) WHERE target > 0)
      WHERE r <= (SELECT seats FROM a) GROUP BY place),
sq AS (SELECT s.*, coalesce(quota, 0) AS quota, greatest(ceil(source_size / 2097152), 1)::BIGINT AS shards FROM s LEFT JOIN q USING (place)),
e AS (SELECT d.*, place, source_size, target, quota AS seats, ('0x' || substr(draw, 1, 8))::BIGINT % shards AS shard
      FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
c AS (SELECT place, shard, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(seats) AS seats FROM e GROUP BY ALL),
cq AS (SELECT place, shard, count(*) AS quota FROM (
        SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY words / (k + 0.5) DESC, shard, k) AS r
        FROM (SELECT *, unnest(range(seats)) AS k FROM c WHERE words > 0)) WHERE r <= seats GROUP BY ALL),
cd AS (SELECT place, shard, words, least(greatest(coalesce(quota, 0) * 128
          + CASE WHEN row_number() OVER (PARTITION BY place ORDER BY words DESC, shard) = 1 THEN round(target) - seats * 128 ELSE 0 END, 0),
          words * 2)::BIGINT AS due FROM c LEFT JOIN cq USING (place, shard)),
g AS (SELECT *, row_number() OVER (PARTITION BY place, shard ORDER BY draw, doc_id NULLS FIRST, size) AS rw FROM e),
h AS (SELECT *, (sum(size) OVER (PARTITION BY place, shard ORDER BY rw) - size)::BIGINT AS start FROM g),
i AS (SELECT *, unnest(range(start // 128, greatest(start, start + size - 1) // 128 + 1)) AS blk FROM h),
j AS (SELECT *, (least(start + size, (blk + 1) * 128) - greatest(start, blk * 128))::BIGINT AS piece FROM i),
k AS (SELECT j.*, words, due, (sum(piece) OVER (PARTITION BY place, shard ORDER BY md5(concat_ws(':', '17', shard, blk)), blk, rw
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - piece)::BIGINT AS ahead FROM j JOIN cd USING (place, shard))
SELECT doc_id, source, size, source_size, target,
       sum(CASE WHEN words > 0 THEN due // words ELSE 0 END * piece
         + least(greatest(CASE WHEN words > 0 THEN due % words ELSE due END - ahead, 0), piece))::BIGINT AS taken
FROM k GROUP BY place, shard, rw, doc_id, source, size, source_size, target
""",
)
def mixing(spark, sf):
    return mix(table(spark, sf, "documents"))
