import math

import numpy as np
import pytest

from terralens.llm import op11_negatives as op


def brute(rows, every=100, positives=5, negatives=10):
    """``rows`` of (vec_id, label, embedding)."""
    whole = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        whole.append((i, label, [math.floor(256 * v) for v in x]))
    anchors = {}
    for i, label, x in whole:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, x)), (label, x))
    out = []
    for a, (label, x) in anchors.items():
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in whole if i != a]
        for s, p, _ in sorted((s, i, o) for s, i, o in scored if o == label)[:positives]:
            fit = sorted((t, i) for t, i, o in scored if o != label and -30 * s <= -100 * t <= -90 * s)
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


FIELDS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_negatives_against_brute_force(spark, monkeypatch, spread):
    # several clusters, pieces and blocks; the narrow clusters let walks end early
    for name, value in (("PER_CLUSTER", 4), ("PIECE", 16), ("MEMBERS", 7), ("HEAD", 1)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(6)
    heart = rng.normal(size=(8, 6)) * 3
    rows = []
    for i in range(600):
        c = int(rng.integers(8))
        rows.append((i, int(rng.integers(4)), ((heart[c] + rng.normal(size=6) * spread) * rng.gamma(2.0)).tolist()))
    rows += [(i, rows[i % 9][1], rows[i % 5][2]) for i in range(600, 660)]  # ties
    rows += [
        (700, None, [1.0] * 6), (710, 1, None), (720, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (730, 2, [float("nan")] * 6), (740, 1, [float("inf")] * 6),
        (None, 1, [1.0] * 6), (750, 1, []), (760, 1, [5.0]), (770, 3, [0.0] * 6), (780, 77, [1.0] * 6), (20, 3, rows[20][2]), (1, 0, rows[1][2]),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"{FIELDS}, rank string, cluster int, score int").repartition(5)
    got = sorted(tuple(r) for r in op.mined(df, every=10).collect())
    assert got == brute(rows, every=10) and len(got) > 500


def test_few_rows_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.5]), (100, 1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, FIELDS)
    assert sorted(tuple(r) for r in op.mined(df).collect()) == brute(rows)
    assert op.mined(df.limit(0)).count() == 0
    alone = df.where("vec_id = 0")
    assert op.mined(alone).count() == 0


def test_large_scores_stay_exact(spark):
    rows = [(0, 1, [3e6, 1.0]), (1, 1, [3e6, 2.0]), (2, 2, [2e6, 5.0]), (3, 2, [2e6, 5.0]), (4, 2, [1e6, 1.0])]
    assert sorted(tuple(r) for r in op.mined(spark.createDataFrame(rows, FIELDS)).collect()) == brute(rows)


def test_walks_end_early_where_clusters_are_narrow():
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(10, 16))
    ints = np.floor((heart[np.arange(2000) % 10] + rng.normal(size=(2000, 16)) * 0.05) * 256)
    centre = op.directions(heart[:1])[0]
    own = op.angles(ints[:2000:10][:20], centre[None])[:, 0]
    row = {
        "ids": op.packed(np.arange(0, 200, 10)), "labels": op.packed(np.zeros(20, np.int64)), "ints": op.packed(ints[:200:10]),
        "angles": b"f8" + own.tobytes(), "slots": 1,
    } | {n: b"i8" + np.full((20, 1), v).astype("<i8").tobytes() for n, v in (("lows", op.NONE), ("highs", op.MOST), ("bars", op.NONE))}
    bound = op.bounds(np.sqrt((ints * ints).sum(1)), op.angles(ints, centre[None])[:, 0], own.max())
    order, read = np.argsort(-bound), 0
    walk = op.Walk(row, centre, True, 5)
    for lo in range(0, 2000, 50):
        part = order[lo : lo + 50]
        if walk.over(bound[part[0]]):
            break
        walk.meet(part, np.zeros(50, np.int64), ints[part])
        read += 50
    assert read <= 400
    exact = ints[:200:10] @ ints.T
    for i in range(20):
        exact[i, 10 * i] = -np.inf
        want = sorted(zip(-exact[i], range(2000)))[:5]
        assert list(zip(-walk.score[walk.key == i], walk.who[walk.key == i])) == want
