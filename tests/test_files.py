from pyspark.sql import Row

from terralens.plans import files


def test_annotation_maps_are_few_and_hold_every_box(spark, tmp_path):
    lines = [(k, float(n + k % 7)) for k in range(1, 2501) for n in range(1 + k % 3)] + [(7, 7.0), (7, 7.0), (123456789012, 2.5)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = files.src_09(spark, str(tmp_path))
    assert len(set(found.inputFiles())) <= 4
    want = {}
    for k, q in lines:
        n, area = want.get(k, (0, 0.0))
        want[k] = n + 1, area + q
    assert sorted(found.collect()) == sorted(Row(patch=f"p_{k}", boxes=n, area=a) for k, (n, a) in want.items())
