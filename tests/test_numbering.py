import hashlib

from pyspark.sql import functions as F

from terralens.operators import numbering as N
from terralens.operators import sampling as S


def test_number_by_id_over_many_buckets(spark):
    ids = [i * i for i in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r["id"]: r["row"] for r in N.number_by_id(df, "id", rows_per_bucket=37).collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_seeded_numbers_in_hot_group_with_null(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    out = N.number_by_seed(df, ["id"], 42, group=["g"], total="n", rows_per_bucket=50).collect()
    for g in ("hot", None):
        members = [i for i, v in rows if v == g]
        order = sorted(members, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        assert {r["id"]: r["row"] for r in out if r["g"] == g} == {v: i for i, v in enumerate(order)}
        assert {r["n"] for r in out if r["g"] == g} == {len(members)}


def test_stratified_split_is_disjoint_complete_and_exact(spark):
    df = spark.createDataFrame([(i, min(i % 7, 2)) for i in range(1000)], "id bigint, s int")
    out = S.stratified_split(df, ["id"], "s", rows_per_bucket=64).collect()
    assert sorted(r["id"] for r in out) == list(range(1000))
    for s in (0, 1, 2):
        part = [r for r in out if r["s"] == s]
        assert sum(r["split"] == "archive" for r in part) == int(0.33 * len(part))


def test_lines_keep_file_order(spark, tmp_path):
    from terralens.sources import readers

    path = tmp_path / "lines.txt"
    path.write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = N.number_lines(readers.text_lines(spark, str(path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["row"]: r["value"] for r in rows} == {i: f"line {i}" for i in range(5000)}


def test_every_nth_and_blocks(spark):
    df = spark.range(100).withColumn("id", F.col("id") * 3)
    assert sorted(r["id"] for r in N.every_nth(df, "id", 5).collect()) == [i * 3 for i in range(0, 100, 5)]
    assert {r["id"]: r["block"] for r in N.blocks_of(df, "id", 30).collect()} == {i * 3: i // 30 for i in range(100)}


def test_shuffle_is_a_permutation(spark):
    out = S.shuffled(spark.range(200), ["id"]).collect()
    assert sorted(r["place"] for r in out) == list(range(200))
    assert [r["id"] for r in sorted(out, key=lambda r: r["place"])] != list(range(200))
