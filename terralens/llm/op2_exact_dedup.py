"""Exact deduplication of documents by salted combining; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

CAT = Catalogue()

#: White space that counts as one blank, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"
#: Parts into which the copies of one text are dealt before they meet; below 64, as a bit mask keeps which parts hold a copy.
SALTS = 32

KEY = ["__digest", "__check", "__salt"]
FOUND = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text):
    """The compared form: each run of white space is one blank, null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _salt(doc_id, salts):
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def _keyed(docs, text, doc_id, salts):
    norm = normalised(F.col(text))
    return docs.withColumns(
        {"__digest": F.sha2(norm, 256), "__check": F.xxhash64(norm), "__salt": _salt(F.col(doc_id), salts), "__norm": norm}
    )


def winners(docs, text="text", doc_id="doc_id", salts=SALTS):
    """One row for each distinct text and part that holds a copy: digest, check, salt, keep_id, group_size.

    Copies meet in three steps, and the whole normalised text is a grouping key in each: in the map task (partial
    aggregation), in a part of a digest's copies, and over the parts. No task gets more than one row of a text from
    each map task and part, however many copies there are.
    """
    parts = (
        _keyed(docs, text, doc_id, salts)
        .groupBy("__digest", "__check", "__salt", "__norm")
        .agg(F.min(doc_id).alias("__least"), F.count(F.lit(1)).alias("__n"))
    )
    whole = parts.groupBy("__digest", "__check", "__norm").agg(
        F.min("__least").alias("keep_id"),
        F.sum("__n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__mask"),
    )
    held = F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(__mask, s) & 1L) = 1L)")
    return whole.select("__digest", "__check", "keep_id", "group_size", F.explode(held).alias("__salt"))


def label_copies(docs, text="text", doc_id="doc_id", salts=SALTS):
    """``docs`` with keep_id (smallest doc_id of the equal texts), group_size, kept and text_sha256.

    Null texts count as empty. Rows that repeat a doc_id together with its text are one document told twice: they count
    in group_size and are kept or dropped alike. Null doc_ids come last: such a row stays only if no equal text has an
    id. Columns of ``docs`` that bear the name of an added one are replaced. An empty table gives an empty table.
    """
    docs = docs.drop(*FOUND)
    found = winners(docs, text, doc_id, salts)
    return (
        _keyed(docs, text, doc_id, salts)
        .drop("__norm")
        .join(found, KEY)
        .withColumns({"kept": F.col(doc_id).eqNullSafe(F.col("keep_id")), "text_sha256": F.col("__digest")})
        .select(*docs.columns, *FOUND)
    )


def deduplicate(docs, text="text", doc_id="doc_id", salts=SALTS):
    """The rows of ``docs`` that stay, with their columns as they were."""
    found = winners(docs, text, doc_id, salts).select(*KEY, F.col("keep_id").alias("__keep"))
    return (
        _keyed(docs, text, doc_id, salts)
        .drop("__norm")
        .join(found, KEY)
        .where(F.col(doc_id).eqNullSafe(F.col("__keep")))
        .select(*docs.columns)
    )


@CAT.add(
    "op2_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""",
)
def exact_dedup(spark, sf):
    return label_copies(table(spark, sf, "documents")).select("doc_id", *FOUND)
