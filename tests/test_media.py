import pytest
from pyspark.sql import functions as F

from terralens.functions import arrays as A
from terralens.functions import text as X
from terralens.operators import augment as U
from terralens.operators import bands as B
from terralens.operators import captions as C
from terralens.operators import inference as I
from terralens.operators import requests as R
from terralens.operators import sampling as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "n,plain,compat",
    [(0, "zero", "zero"), (13, "thirteen", "thirteen"), (40, "forty", "forty"), (42, "forty-two", "forty-two"), (100, "one hundred", "one hundred  zero"),
     (105, "one hundred five", "one hundred  five"), (120, "one hundred twenty", "twenty"), (999, "nine hundred ninety-nine", "nine hundred ninety-nine"), (1000, "NaN", "NaN")],
)
def test_number_words(spark, n, plain, compat):
    assert one(spark, C.number_words(F.lit(n))) == plain
    assert one(spark, C.number_words(F.lit(n), compat=True)) == compat


@pytest.mark.parametrize(
    "counts,plain,compat",
    [
        ((1, 0, 0, 0, 0), "one very small boat", "one very small boat"),
        ((2, 1, 0, 0, 0), "two very small boats and one small boat", "two very small boats  and one small boat"),
        ((1, 1, 7, 0, 0), "one very small boat one small boat and many medium-sized boats", "one very small boat one small boat and many medium-sized boats"),
        ((0, 0, 0, 2, 0), "two big ships", "two two big ships"),
        ((1, 0, 0, 0, 3), "one very small boat and three very big ships", "one very small boat three very big ships"),
        ((0, 0, 0, 0, 0), "", ""),
    ],
)
def test_size_phrases(spark, counts, plain, compat):
    cols = [F.lit(c) for c in counts]
    assert one(spark, C.size_phrase(cols)) == plain
    assert one(spark, C.size_phrase(cols, compat=True)) == compat


def test_captions_end_to_end(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 5.0), (0.0, 5.0)]
    box = (0.0, 0.0, 1.0, 1.0)
    data = [(1, 120.0, box, [ring, ring], [(0.5, 0.5)]), (2, 120.0, (50.0, 50.0, 51.0, 51.0), [ring], [(50.5, 50.5)]), (3, 120.0, box, [], [])]
    images = spark.createDataFrame(data, "id bigint, height double, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, boxes array<array<struct<x:double,y:double>>>, geo_points array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(1, [(-1.0, 0.5), (2.0, 0.5)])], "line bigint, points array<struct<x:double,y:double>>")
    got = {r["id"]: r["captions"] for r in C.describe_images(images, lines).collect()}
    assert got[1] == ["two vessels", "two small boats", "in the port two vessels are present", "two vessels in the harbor"]
    assert got[2] == ["one vessel", "one small boat", "one vessel is present", "one vessel"]
    assert got[3] == [C.NO_VESSEL] * 4


def test_augmentation_prefers_scores_and_keeps_whole_sentences(spark):
    s = spark.createDataFrame([(1, ["there", "is", "boat", "big"], ["EX", "VBZ", "NN", "JJ"]), (2, ["boat"], ["NN"])], "id bigint, tokens array<string>, tags array<string>")
    n = spark.createDataFrame([("boat", "ship", 0.9, "NN", 0.1), ("boat", "vessel", 0.7, "NN", 0.8), ("boat", "raft", 0.6, "NN", 0.99), ("boat", "sail", 0.9, "VB", 1.0), ("big", "huge", 0.9, "JJ", 1.0)],
                             "token string, candidate string, similarity double, tag string, score double")
    assert {r["id"]: r["augmented"] for r in U.augment_sentences(s, n).collect()} == {1: "it is vessel big", 2: "vessel"}
    scores = spark.createDataFrame([(1, 2, "ship", 0.9), (1, 2, "vessel", 0.2)], "id bigint, pos int, candidate string, score double")
    assert {r["id"]: r["augmented"] for r in U.augment_sentences(s, n, token_scores=scores).collect()} == {1: "it is ship big", 2: "boat"}


def test_augmentation_meets_distinct_words_and_merges_rows_of_one_id(spark, monkeypatch):
    rows = [(i, ["boat", "big", "there", "is", "boat", "sea"] * 20, ["NN", "JJ", "EX", "VBZ", "VB", "NN"] * 20) for i in range(40)]
    rows += [(50, [], []), (51, None, None), (52, ["boat", None, "x"], ["NN", "NN"]), (53, ["boat"], ["NN"]), (53, ["a", "sea"], ["JJ", "NN"]), (None, ["sea"], ["NN"]), (None, ["ü", "boat"], ["NN", "NN"])]
    s = spark.createDataFrame(rows, "id bigint, tokens array<string>, tags array<string>").repartition(2)
    n = spark.createDataFrame([("boat", "ship", 0.9, "NN", 0.1), ("boat", "ähre", 0.9, "VB", 0.1), ("sea", "ocean", 0.7, "NN", 0.1), ("sea", None, 0.7, "NN", 0.5), ("it", "them", 0.9, "NN", 1.0), ("big", "huge", 0.9, "JJ", 1.0)],
                             "token string, candidate string, similarity double, tag string, score double")
    stored = {}
    keep = U.materialise
    monkeypatch.setattr(U, "materialise", lambda df, name: stored.setdefault(name, keep(df, name)))
    long = " ".join(["ship big it is ähre ocean"] * 20)
    want = {i: long for i in range(40)} | {50: "", 52: "ship x", 53: "a ship ocean", None: "ocean ü ship"}
    got = U.augment_sentences(s, n.filter("candidate IS NOT NULL"), chunk_bytes=5000).collect()
    assert {r["id"]: r["augmented"] for r in got} == want and len(got) == len(want)
    lists = [r["words"] for r in stored["chunks"].select("words").collect()]
    assert len(lists) > 2 and all(len(set(words)) == len(words) <= 9 for words in lists)
    monkeypatch.undo()
    # a word whose best candidate is null stays
    assert {r["id"]: r["augmented"] for r in U.augment_sentences(s.filter("id = 53"), n).collect()} == {53: "a ship sea"}


def test_weighted_choice_shares(spark):
    out = U.weighted_choice(spark.range(20000), ["id"], 3, {"a": 1, "b": 3})
    shares = {r["choice"]: r["count"] / 20000 for r in out.groupBy("choice").count().collect()}
    assert shares["a"] == pytest.approx(0.25, abs=0.02) and shares["b"] == pytest.approx(0.75, abs=0.02)


def test_text_helpers(spark):
    assert one(spark, X.normalise(F.lit("A, b! C?."))) == "a b c"
    assert one(spark, X.tokenise(F.lit("It's é-1."))) == ["It", "'", "s", "é", "-", "1", "."]
    assert one(spark, X.stem(F.lit("a/b.c/d.e.tif"))) == "d.e"
    assert one(spark, X.add_prefix(F.lit("x.tif"), F.lit("p_"))) == "p_x.tif"


def test_bands(spark):
    assert B.resolve(3) == ["B04", "B03", "B02"] and B.resolve("10m20m") == B.resolve(12)
    for bad in ("nope", 7, ["B99"]):
        with pytest.raises(ValueError):
            B.resolve(bad)
    v = F.array(*[F.lit(float(x)) for x in range(16)])
    assert one(spark, B.average_pool(v, 4, 4, 2)) == [2.5, 4.5, 10.5, 12.5]
    assert one(spark, A.min_max(F.array(F.lit(1.0), F.lit(1.0)))) is None
    assert one(spark, A.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, A.delivery_code(A.sign_code(F.array(F.lit(-2.0), F.lit(0.0), F.lit(3.0))))) == [0, 0, 1]


def test_code_distances_agree(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0], [1.0, 1.0, -1.0])], "a array<double>, b array<double>")
    r = df.select(A.packed_hamming(A.pack_bits(F.col("a"), 3), A.pack_bits(F.col("b"), 3)).alias("p"), A.code_distance(A.sign_code(F.col("a")), A.sign_code(F.col("b"))).alias("d")).first()
    assert r["p"] == 2 and r["d"] == 2.0


def test_encoder_and_chain(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i % 3} x") for i in range(50)], "id bigint, text string")
    enc = I.encode(df, "id", "text", batch_size=7)
    assert enc.count() == 50 and all(sum(r["embedding"]) == 2 for r in enc.collect())
    calls = str(tmp_path / "steps")
    first = I.chain_steps(df, "id", "text", [("a", lambda ts: [t + "!" for t in ts])], calls)
    assert first.filter("text LIKE '%!'").count() == 50

    def fail(ts):
        raise RuntimeError("a finished step must not run again")

    again = I.chain_steps(df, "id", "text", [("a", fail), ("b", lambda ts: [t + "?" for t in ts])], calls)
    assert again.filter("text LIKE '%!?'").count() == 50


def test_sampling_edges(spark):
    df = spark.range(10)
    picked = S.sample_groups(df, "id", 2, 4).collect()
    assert sorted(r["list_no"] for r in picked) == [0, 0, 1, 1] and all(r["id"] < 8 for r in picked)
    assert S.first_sorted(df, "id", -1).count() == 10 and S.first_sorted(df, "id", 3).count() == 3
    with pytest.raises(Exception, match="no annotation for"):
        S.with_objects(df, spark.range(5).withColumn("n", F.lit(1)), "id").collect()


def test_unknown_key_raises(spark):
    from terralens.sources.readers import fetch

    patches = spark.createDataFrame([(1, "a")], "k bigint, v string")
    assert [tuple(r) for r in fetch(patches, spark.createDataFrame([(1,)], "k bigint"), "k").collect()] == [(1, "a")]
    with pytest.raises(Exception, match="unknown key"):
        fetch(patches, spark.createDataFrame([(2,)], "k bigint"), "k").collect()


def test_report_on_a_class_never_detected(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "expected string, detected string")
    got = {r["label"]: tuple(r)[1:] for r in R.classification_report(df).collect()}
    assert got["a"][:2] == (0.5, 0.5) and got["a"][3] == 2
    assert got["c"][:3] == (1.0, 0.0, 0.0) and got["b"][1] == 1.0
    assert got["accuracy"][0] == pytest.approx(1 / 3)


def test_long_dialogues_are_cut_into_parts(spark):
    turns = spark.range(2500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    parts = R.transcripts(turns).orderBy("part").collect()
    assert [len(p["turns"]) for p in parts] == [1000, 1000, 500]
    assert [t["turn"] for p in parts for t in p["turns"]] == list(range(2500))
    firsts = R.classes_by_appearance(spark.createDataFrame([("b", 1), ("a", 2), ("b", 0)], "expected string, n int"), "n")
    assert firsts == ["b", "a"]


def test_quadruplets_do_not_move_tables_that_lie_by_image(spark):
    placed = spark.createDataFrame([(1, 4, "A"), (1, 5, "B"), (1, 5, "B2"), (2, 8, "C"), (2, None, "D"), (None, 9, "E"), (3, 4, "F")], "image_id int, sentence_id int, text string").repartition("image_id")
    images = placed.select("image_id").distinct().withColumn("image", F.concat(F.lit("i"), F.col("image_id").cast("string")))
    augmented = placed.where("text != 'C'").select("image_id", "sentence_id", F.lower("text").alias("text_aug"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        four = S.quadruplets(images, images.withColumnRenamed("image", "image_aug"), placed, augmented)
        plan = four._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["image_id"], r["sentence_id"], r["text"], r["text_aug"], r["image"], r["image_aug"]) for r in four.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL")
    assert got == [(1, 4, "A", "a", "i1", "i1")] + [(1, 5, x, y, "i1", "i1") for x in ("B", "B2") for y in ("b", "b2")] + [(3, 4, "F", "f", "i3", "i3")]
