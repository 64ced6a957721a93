"""Shared helpers of the query catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


class Catalogue:
    """Collects ``key -> query`` and ``key -> SQL`` of one topic."""

    def __init__(self):
        self.queries = {}
        self.sql = {}

    def add(self, key, sql=None):
        def register(fn):
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return register
