"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark import SparkFiles

from tools.check import TABLES, close, plain, sort_key

import __spark_entry__ as entry
from terralens.plans import catalogue
from terralens.session import ship_package

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_query_has_a_statement():
    assert set(SQL) <= set(QUERIES)
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("key", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, sf, key):
    df = QUERIES[key](spark, sf)
    names = sorted(df.columns)
    got = sorted([tuple(plain(r[n]) for n in names) for r in df.collect()], key=sort_key)
    cur = duck.execute(SQL[key])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = sorted([tuple(plain(r[columns.index(n)]) for n in names) for r in cur.fetchall()], key=sort_key)
    assert len(got) == len(want)
    assert all(close(a, b) for g, w in zip(got, want) for a, b in zip(g, w))


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert 0 <= row["precision"] <= 1 and 0 <= row["recall"] <= 1


def test_workers_get_the_package(spark, tmp_path):
    """The shipped archive alone is enough for a worker's interpreter to import the operators."""
    ship_package(spark)
    archive = os.path.join(SparkFiles.getRootDirectory(), "shipped", "terralens.zip")
    code = "import sys; sys.path.insert(0, sys.argv[1]); import terralens.operators.neighbours as n; print(n.__file__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code, archive], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.startswith(archive), said.stderr[-2000:]
