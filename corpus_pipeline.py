"""From raw documents to packed sequences: five stages, each working on all that the one before has kept."""

from __future__ import annotations

from terralens.llm.op2_exact_dedup import deduplicate
from terralens.llm.op4_packing import pack
from terralens.llm.op6_jaccard import representatives
from terralens.llm.op9_mixing import mixed
from terralens.llm.op10_quality import accepted, learn
from terralens.llm.shared import written
from terralens.session import ship_package


def quality_classifier(spark, docs, sf_dir):
    """Documents that the byte network, learned from the labelled ones of ``docs``, does not reject."""
    ship_package(spark)
    return accepted(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark, docs, sf_dir):
    """The document with the smallest id of each text."""
    ship_package(spark)
    return deduplicate(docs)


def jaccard_join(spark, docs, sf_dir):
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return representatives(docs, width=5, percent=80)


def mixing(spark, docs, sf_dir):
    """The sources at their target weights: documents repeated or cut as the mix takes them."""
    ship_package(spark)
    return mixed(docs)


def packing(spark, docs, sf_dir):
    """Pieces of all documents with their places in the sequences."""
    ship_package(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

# a learned classifier and a tokenizer decide the rows, which SQL cannot express; the tests hold them against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
