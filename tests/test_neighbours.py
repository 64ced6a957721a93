import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.operators import diagnostics as D
from terralens.operators import labels as L
from terralens.operators import neighbours as N
from terralens.operators import retrieval as R

RNG = np.random.default_rng(5)


def frame(spark, ids, matrix, id_col, labels=None, grp=None):
    rows = []
    for i, v in zip(ids, matrix):
        row = [int(i), [float(x) for x in v]]
        rows.append(tuple(row + ([labels[int(i)]] if labels else []) + ([grp] if grp else [])))
    schema = f"{id_col} bigint, vec array<double>" + (", labels array<int>" if labels else "") + (", grp string" if grp else "")
    return spark.createDataFrame(rows, schema)


def brute(q, a, k, metric):
    out = set()
    for i, v in enumerate(q):
        d = ((v - a) ** 2).sum(1).round(6) if metric == "l2" else 0.5 * (a.shape[1] - a @ v)
        for rank, j in enumerate(np.lexsort((np.arange(len(a)), d))[:k], 1):
            out.add((i, int(j), round(float(d[j]), 6), rank))
    return out


@pytest.mark.parametrize("metric", ["l2", "hamming"])
@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_nearest_equals_brute_force(spark, metric, limit):
    q, a = RNG.normal(size=(23, 8)), RNG.normal(size=(301, 8))
    a[100:150] = a[0]  # copies: many ties
    if metric == "hamming":
        q, a = np.sign(q), np.sign(a)
    got = N.nearest(
        frame(spark, range(23), q, "qid"),
        frame(spark, range(301), a, "aid").repartition(5),
        k=7,
        metric=metric,
        query_block=5,
        archive_block=40,
        broadcast_bytes=limit,
    )
    assert {(r["qid"], r["aid"], round(r["dist"], 6), r["rank"]) for r in got.collect()} == brute(q, a, 7, metric)


def test_top_k_is_a_prefix_of_larger_k(spark):
    q, a = RNG.normal(size=(6, 4)), RNG.normal(size=(50, 4))
    small, large = (
        {(r["qid"], r["rank"]): r["aid"] for r in N.nearest(frame(spark, range(6), q, "qid"), frame(spark, range(50), a, "aid"), k=k).collect()}
        for k in (3, 9)
    )
    assert all(large[key] == value for key, value in small.items())


def test_k_above_archive_size(spark):
    got = N.nearest(frame(spark, [0], RNG.normal(size=(1, 4)), "qid"), frame(spark, range(3), RNG.normal(size=(3, 4)), "aid"), k=10)
    assert got.count() == 3


@pytest.fixture(scope="module")
def coded(spark):
    q, a = np.sign(RNG.normal(size=(17, 16))), np.sign(RNG.normal(size=(260, 16)))
    a[50:120] = a[3]
    labels_q = {i: [int(i % 4), 9] if i else [77] for i in range(17)}
    labels_a = {i: [int(i % 5)] for i in range(260)}
    qf, af = frame(spark, range(17), q, "qid", labels_q, "g"), frame(spark, range(260), a, "aid", labels_a, "g")
    rel = np.array([[bool(set(labels_q[i]) & set(labels_a[j])) for j in range(260)] for i in range(17)])
    dist = 0.5 * (16 - q @ a.T)
    return qf, af, rel, dist


def reference_map(rel, dist, k, depth=False):
    total = 0.0
    for r, d in zip(rel, dist):
        g = r[np.lexsort((np.arange(len(d)), d))]
        if not g.any():
            continue
        ranks = np.nonzero(g)[0] + 1
        ranks = ranks[ranks <= k] if depth else ranks[: min(k, len(ranks))]
        if len(ranks):
            total += np.mean(np.arange(1, len(ranks) + 1) / ranks)
    return total / len(rel)


@pytest.mark.parametrize("k", [3, 40, None])
def test_map_over_blocks(coded, k):
    qf, af, rel, dist = coded
    profile = N.hamming_profile(qf, af, keep=k, query_block=4, archive_block=33)
    row = R.mean_average_precision(profile, k).first()
    assert row["map"] == pytest.approx(reference_map(rel, dist, k or 10**9))
    assert row["n_queries"] == 17


def test_map_by_depth(coded):
    qf, af, rel, dist = coded
    profile = N.hamming_profile(qf, af, query_block=4, archive_block=33)
    assert R.mean_average_precision(profile, 25, depth_k=True).first()["map"] == pytest.approx(reference_map(rel, dist, 25, True))


def test_map_is_one_when_sorted_by_truth(spark):
    q = np.ones((2, 8))
    a = np.vstack([np.ones((5, 8)), -np.ones((5, 8))])
    labels = {i: [1] if i < 5 else [2] for i in range(10)}
    profile = N.hamming_profile(frame(spark, range(2), q, "qid", {0: [1], 1: [1]}, "g"), frame(spark, range(10), a, "aid", labels, "g"))
    assert R.mean_average_precision(profile, None).first()["map"] == 1.0


def test_radius_curve_and_precision_at(coded):
    qf, af, rel, dist = coded
    profile = N.hamming_profile(qf, af, keep=300, query_block=4, archive_block=33)
    curve = {r["radius"]: (r["precision"], r["recall"]) for r in R.radius_curve(profile, 16).collect()}
    assert sorted(curve) == list(range(17))
    for radius, (p, r) in curve.items():
        inside = dist <= radius
        hits = (inside & rel).sum(1)
        assert p == pytest.approx(np.mean(np.where(inside.sum(1) > 0, hits / np.maximum(inside.sum(1), 1), 0)))
        assert r == pytest.approx(np.mean(np.where(rel.sum(1) > 0, hits / np.maximum(rel.sum(1), 1), 0)))
    at = {r["k"]: r["precision"] for r in R.precision_at(profile, [1, 10, 1000]).collect()}
    ranked = np.array([r[np.lexsort((np.arange(260), d))] for r, d in zip(rel, dist)])
    assert at[1] == pytest.approx(ranked[:, :1].mean()) and at[10] == pytest.approx(ranked[:, :10].mean())
    assert at[1000] == pytest.approx(ranked.mean())


def test_overlap_counts(spark):
    q = spark.createDataFrame([(1, [1, 2, 2]), (2, [7]), (3, [2, 1])], "qid bigint, labels array<int>")
    a = spark.createDataFrame([(i, [i % 3, 1]) for i in range(30)], "aid bigint, labels array<int>")
    assert {r["qid"]: r["relevant"] for r in L.overlap_counts(q, a).collect()} == {1: 30, 3: 30}


def test_label_errors(spark):
    from terralens.functions.arrays import multi_hot

    df = spark.createDataFrame([(["Urban fabric", "pastures"],)], "l array<string>")
    hot = df.select(multi_hot(F.col("l"), L.LAND_COVER_19).alias("h")).first()["h"]
    assert len(hot) == 19 and sum(hot) == 2 and hot[18] == 1 and hot[15] == 1
    for bad in (["moon"], []):
        with pytest.raises(Exception, match="outside the class list"):
            spark.createDataFrame([(bad,)], "l array<string>").select(multi_hot(F.col("l"), L.LAND_COVER_19)).collect()
    with pytest.raises(Exception, match="object count"):
        spark.range(150, 151).select(L.presence(F.col("id"))).collect()


def test_contrastive_loss_against_numpy(spark):
    x, y = RNG.normal(size=(6, 5)), RNG.normal(size=(6, 5))
    df = spark.createDataFrame([(0, i, x[i].tolist(), y[i].tolist()) for i in range(6)], "b bigint, id bigint, a array<double>, c array<double>")
    got = D.contrastive_loss(df, "b", "id", "a", "c", temperature=0.5).first()
    u, w = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    z = np.vstack([u, w])
    sim = np.exp(z @ z.T / 0.5)
    pos = np.exp(np.r_[(u * w).sum(1), (u * w).sum(1)] / 0.5)
    assert got["mean_loss"] == pytest.approx(np.mean(-np.log(pos / (sim.sum(1) - np.diag(sim)))))


def test_large_blocks_hold_few_distances_at_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "DISTANCES", 64)
    whole = N._distances
    monkeypatch.setattr(N, "_distances", lambda q, a, *more: seen.append(len(q) * len(a)) or whole(q, a, *more))
    r = np.random.default_rng(2)
    q, a = np.sign(r.normal(size=(30, 8))), np.sign(r.normal(size=(20, 8)))
    qid, aid, dist = N._block_best(np.arange(30), q, np.arange(20), a, 3, "hamming", 0)
    full = 0.5 * (8 - q @ a.T)
    want = [(i, j, full[i, j]) for i in range(30) for j in np.lexsort((np.arange(20), full[i]))[:3]]
    assert list(zip(qid, aid, dist)) == want and max(seen) <= 64


def test_profile_without_places_keeps_all_counts(spark):
    r = np.random.default_rng(4)
    q, a = np.sign(r.normal(size=(6, 8))), np.sign(r.normal(size=(40, 8)))
    labels = {i: [i % 3] for i in range(40)}
    sides = frame(spark, range(6), q, "qid", labels, "g"), frame(spark, range(40), a, "aid", labels, "g")
    counts = lambda p: {(x["qid"], x["dist"]): (x["n_all"], x["n_rel"]) for x in p.collect()}
    none = N.hamming_profile(*sides, keep=0)
    assert counts(none) == counts(N.hamming_profile(*sides)) and all(x["rel_pos"] == [] for x in none.collect())
    assert "array<tinyint>" in N._vectors(sides[0], "qid", metric="hamming").schema.simpleString()
    assert N._block_count(1_000_000, N.ARCHIVE_BLOCK) == 32 and N._block_count(100, N.ARCHIVE_BLOCK) == 1 and N._block_count(100, 33) == 4
