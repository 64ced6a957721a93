import math

import numpy as np
import pytest

from terralens.llm import op12_embedding_neighbours as op

FIELDS = "vec_id long, label int, embedding array<double>"


def brute(rows, least=0.93):
    """``rows`` of (vec_id, label, embedding); each row stands for itself."""
    width = max((len(x) for _, _, x in rows if x), default=1)

    def whole(i, label, x):
        return i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)

    at = [k for k, r in enumerate(rows) if whole(*r)]
    m = np.array([list(rows[k][2]) + [0.0] * (width - len(rows[k][2])) for k in at])
    m = m / np.abs(m).max(1, keepdims=True)
    m = m / np.sqrt((m * m).sum(1, keepdims=True))
    label = np.array([rows[k][1] for k in at])
    link = (m @ m.T >= least) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    ids = np.array([rows[k][0] for k in at])
    reach = ids.copy()
    while True:
        new = np.minimum(reach, np.where(link, reach[None], np.iinfo(np.int64).max).min(1))
        if (new == reach).all():
            break
        reach = new
    out = [(i, 0, i, i is not None) for i, *_ in rows]
    for k, n, c in zip(at, link.sum(1).tolist(), reach.tolist()):
        out[k] = (rows[k][0], n, c, rows[k][0] == c)
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in op.neighbours(df, **more).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(3)), rng.normal(size=12).tolist()) for i in range(300)]
    # chains and groups of near copies, some just below the threshold
    for i in range(300, 500):
        base = rows[int(rng.integers(0, 300)) if i < 400 else i - 1]
        rows.append((i, base[1], (np.array(base[2]) + rng.normal(size=12) * 0.3).tolist()))
    heart = rng.normal(size=12)
    rows += [(i, 1, (heart + rng.normal(size=12) * 0.25).tolist()) for i in range(500, 700)]
    rows += [(i, 2, heart.tolist()) for i in range(700, 760)] + [(760, 1, heart.tolist()), (761, 2, (heart * 3).tolist()), (762, 2, (-heart).tolist())]
    rows += [
        (800, None, heart.tolist()), (801, 2, None), (802, 2, [1.0, None]), (803, 2, [float("nan")] * 12), (804, 2, [float("inf")] * 12),
        (805, 2, [0.0] * 12), (806, 2, []), (None, 2, heart.tolist()), (None, None, None), (807, 2, [1.0]), (808, 2, [2.0]), (809, 2, [1e200, 1e190]),
        (810, 2, [1e-200, 0.0]), (500, 1, rows[500][2]), (500, 1, rows[3][2]), (700, 2, heart.tolist()),
    ]
    return rows


def test_links_and_components_against_brute_force(spark, rows, monkeypatch):
    for name, value in (("PER_LIST", 20), ("BLOCK", 16), ("WORDS", 32)):
        monkeypatch.setattr(op, name, value)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{FIELDS}, no long, first string, weight int").repartition(4)
    want = brute(rows)
    assert found(df) == want
    assert sum(n for _, n, _, _ in want) > 10_000
    assert found(df, least=0.99) == brute(rows, 0.99)


def test_single_precision_and_default_sizes(spark, rows):
    short = [(i, label, None if x is None else [None if v is None else float(np.float32(min(v, 3e38))) for v in x]) for i, label, x in rows]
    df = spark.createDataFrame(short, FIELDS).selectExpr("vec_id", "label", "CAST(embedding AS array<float>) AS embedding")
    assert found(df) == brute(short)


def test_none_and_few(spark):
    df = spark.createDataFrame([(5, 1, [1.0, 0.0]), (3, 1, [1.0, 0.1]), (4, 2, [1.0, 0.0])], FIELDS)
    assert found(df) == [(3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False)]
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 4")) == [(4, 0, 4, True)]


def test_lookups_and_probes_exclude_only_what_is_far():
    rng = np.random.default_rng(1)
    heart = op.units(rng.normal(size=(20, 32)))
    u = op.units(heart[rng.integers(20, size=2000)] + rng.normal(size=(2000, 32)) * 0.08)
    q = op.Quantiser(u, 20)
    of, codes, error = q.code(u)
    far = np.sqrt(((u - q.centres[of]) ** 2).sum(1))
    radius = np.array([far[of == c].max(initial=0) for c in range(len(q.centres))])
    within = math.sqrt(2 - 2 * 0.93)
    exact = np.sqrt(op.squares(u, u))
    reach = q.reach(u, of, radius, within)
    assert not ((exact <= within) & ~reach[:, of]).any()
    assert reach.mean() < 0.5
    for cell in range(len(q.centres)):
        inside = np.flatnonzero(of == cell)
        near = op.distances(q.lookups(u, cell), codes[inside])
        assert (np.abs(near - exact[:, inside]) <= error[inside] + op.LOOKUP).all()
