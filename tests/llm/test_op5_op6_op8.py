import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from terralens.llm import op5_topk as search
from terralens.llm import op6_jaccard as join
from terralens.llm import op8_substring as repeats
from terralens.llm.components import components

from .conftest import words_of


def brute_top(rows, every=50, top=5):
    usable = {}
    whole = []
    for vec_id, x in rows:
        if vec_id is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        ints = [math.floor(256 * v) for v in x]
        whole.append((vec_id, ints))
        if vec_id % every == 0:
            usable[vec_id] = min(usable.get(vec_id, ints), ints)
    out = []
    for q, x in usable.items():
        scores = [(min(max(sum(a * b for a, b in zip(x, y)), -(1 << 63)), (1 << 63) - 1), v) for v, y in whole if v != q]
        best = sorted((-s, v) for s, v in scores)[:top]
        out += [(q, i, v, -s) for i, (s, v) in enumerate(best, 1)]
    return sorted(out)


def test_top_products_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * rng.gamma(0.7)).tolist()) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, []), (505, [9.0]), (550, [0.0] * 6)]
    rows += [(600, [1e9] * 6), (601, [3e15, -3e15, 1.0, 1.0, 1.0, 1.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(tuple(r) for r in search.top_products(df).collect())
    assert got == brute_top(rows)
    few = df.where("vec_id IN (0, 1, 2)")
    assert sorted(tuple(r) for r in search.top_products(few).collect()) == brute_top(rows[:3])
    assert search.top_products(df.limit(0)).count() == 0


def test_bounds_skip_blocks_without_changing_results():
    rng = np.random.default_rng(8)
    ints = np.floor(rng.normal(size=(3000, 16)) * rng.gamma(0.4, size=(3000, 1)) * 256)
    ints = ints[np.argsort(-(ints * ints).sum(1))]
    ids, queries = np.arange(3000), np.arange(0, 3000, 50)
    turn = np.linalg.eigh(ints.T @ ints)[1][:, ::-1]
    best = search.Best(ids[queries], ints[queries], turn, 5)
    for lo in range(0, 3000, 100):
        best.meet(ids[lo : lo + 100], ints[lo : lo + 100], float(np.sqrt((ints[lo] ** 2).sum())))
    exact = (ints[queries] @ ints.T).astype(np.int64)
    exact[np.arange(len(queries)), queries] = -(1 << 62)
    for i in range(len(queries)):
        want = sorted(zip(-exact[i], ids))[:5]
        assert list(zip(-best.score[i], best.who[i])) == want


def shingle_set(text, width):
    w = words_of(text, True)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_groups(rows, width, percent):
    """(doc_id -> smallest id reachable), with rows of one id as one document."""
    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for t in s:
            holders[t].append(k)
    for k, (i, s) in enumerate(sets):
        for j, n in Counter(j for t in s for j in holders[t] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
    return {i: find(i) for i in root}


@pytest.mark.parametrize("costly", [0, 32])
def test_groups_of_awkward_documents(docs, rows, costly):
    want = brute_groups([r[:2] for r in rows], 4, 85)
    got = join.similar_groups(docs, costly=costly).collect()
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=str) == sorted(((i, len(shingle_set(t, 4))) for i, t, *_ in rows), key=str)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])


def test_groups_of_a_table_and_what_stays(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_groups(rows, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in join.jaccard(spark, sf).collect()} == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, g in brute_groups(rows, 5, 80).items() if i == g}


def test_one_common_passage_and_a_chain_of_near_copies(spark):
    """Every document has the passage; a third of them are a chain in which only neighbours are similar."""
    rng = np.random.default_rng(9)
    word = lambda: "w%d" % rng.integers(10**9)
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join(passage + [word() for _ in range(30)])) for i in range(200)]
    own = [word() for _ in range(120)]
    for i in range(200, 300):
        own = own[1:] + [word()]
        rows.append((i, " ".join(own + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in join.similar_groups(df).collect()}
    assert got == brute_groups(rows, 4, 85)
    assert sum(v == 200 for v in got.values()) == 100


def test_groups_of_no_documents(no_docs):
    assert join.similar_groups(no_docs).count() == join.representatives(no_docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from terralens.llm import components as module

    names = []
    monkeypatch.setattr(module, "written", lambda df, name, write=module.written: names.append(name) or write(df, name))
    edges = [(10, i) for i in range(11, 40)] + [(41, 40), (40, 41), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(11, 40)} | {41: 40}
    assert len(names) == 1
    names.clear()
    chain = [(i, i + 1) for i in range(8)]
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {i: 0 for i in range(1, 9)}
    assert len(names) > 1


def test_level_maps_take_few_jobs(spark):
    size = join.LEVEL_BITS
    bits = sorted({(i * 7919 * 4096) % (3 * size) for i in range(300)} | {0, size - 1, size, 3 * size - 1})
    answers = spark.createDataFrame([(bits[i::5],) for i in range(5)], "bits array<long>")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("level maps", "level maps")
    try:
        maps = join.level_maps(answers)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("level maps")
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in held.items():
            spark.conf.set(k, v)
    assert np.flatnonzero(np.unpackbits(maps, bitorder="little")).tolist() == bits
    assert 0 < len(jobs) < 20


def brute_repeats(rows, window=50):
    first = {}
    for doc_id, text in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_of_awkward_documents(docs, no_docs, rows):
    got = repeats.without_repeats(docs).collect()
    told = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str)
    assert told == brute_repeats([r[:2] for r in rows])
    assert repeats.without_repeats(no_docs).count() == 0


def test_repeats_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, repeats.substring(spark, sf).collect()), key=str) == brute_repeats(rows)


def told_factors(df, **how):
    told = df.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(text, '') AS text").selectExpr("*", "xxhash64(text) AS version")
    texts = {(r["doc_id"], r["version"]): words_of(r["text"]) for r in told.collect()}
    found = repeats.factors(told, **how).collect()
    return texts, {(r["doc_id"], r["version"]): [tuple(f) for f in r["factors"]] for r in found}


def greedy(words, places, window):
    """At each block the longest run of blocks whose places advance with it, over all blocks before or after."""
    at = {i: places[tuple(words[i : i + window])] for i in range(len(words) - window + 1) if tuple(words[i : i + window]) in places}
    spans = {}
    for i, (source, version, j) in at.items():
        spans.setdefault((source, version, j - i), set()).update(range(i, i + window))
    out, done = [], -1
    for i in sorted(at):
        if i <= done:
            continue
        best = None
        for key, covered in spans.items():
            if set(range(i, i + window)) <= covered:
                end = i
                while end in covered:
                    end += 1
                best = min(best or (-end, key), (-end, key))
        end, (source, version, distance) = -best[0], best[1]
        out.append((i, end, source, version, i + distance))
        done = end - window
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_factors_stand_whole_in_their_sources(spark, docs, partitions):
    rng = np.random.default_rng(5)
    made, rows = [], []
    for i in range(120):
        text = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 60))]
        for _ in range(int(rng.integers(0, 4)) if made else 0):
            other = made[rng.integers(0, len(made))]
            lo = rng.integers(0, max(len(other), 1))
            text += other[lo : lo + rng.integers(1, 90)]
        made.append(text)
        rows.append((i, " ".join(text)))
    rows += [(7, rows[50][1]), (7, rows[51][1]), (200, rows[7][1] + " " + rows[8][1])]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df, window, run in ((made, 12, 4), (docs.select("doc_id", "text").where("doc_id IS NOT NULL"), 50, 8)):
        texts, got = told_factors(df.repartition(partitions), window=window, run=run)
        assert len(got) > 5
        for (doc, version), found in got.items():
            words = texts[doc, version]
            for first, last, source, source_version, at in found:
                assert source < doc and last - first >= window
                assert words[first:last] == texts[source, source_version][at : at + last - first]
            # each begins behind the blocks of the one before
            assert all(y[0] > x[1] - window for x, y in zip(found, found[1:]))
        if partitions == 1:
            places = {}
            for (doc, version), words in texts.items():
                for i in range(len(words) - window + 1):
                    key = tuple(words[i : i + window])
                    places[key] = min(places.get(key, (doc, version, i)), (doc, version, i))
            for (doc, version), words in texts.items():
                own = {k: p for k, p in places.items() if p[0] < doc}
                assert got.get((doc, version), []) == greedy(words, own, window)


def test_a_copied_passage_is_one_factor(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(["a"] * 9 + words[100:2900] + ["b"] * 9))]
    _, got = told_factors(spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id"))
    (found,) = got.values()
    assert [(f[0], f[1], f[2], f[4]) for f in found] == [(9, 2809, 1, 100)]


def test_blocks_are_equal_when_both_hashes_are():
    hashes, second = np.array([5, 5, 5, 6], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    doc, version, first = np.array([4, 1, 3, 2]), np.zeros(4, np.int64), np.array([0, 7, 8, 9])
    assert repeats.reference_places(hashes, second, doc, version, first).tolist() == [2, 1, 2, 3]


def test_least_hashes_spread_over_the_parts():
    anchors = np.random.default_rng(2).integers(0, 2**63, (200_000, 43), dtype=np.uint64).min(1)
    part = repeats.part_of(anchors)
    assert np.bincount(part, minlength=repeats.PARTS).max() < 2 * len(anchors) / repeats.PARTS
    assert (repeats.place_of(anchors) // repeats.PART_BITS == part).all()


def test_groups_of_many_near_copies_that_mostly_do_not_link(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(240):
        text = list(words)
        for at in rng.choice(len(text), rng.integers(0, 7), replace=False):
            text[at] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(text)))
    want = brute_groups(rows, 4, 85)
    assert 20 < len(set(want.values())) < 220
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in join.similar_groups(df).collect()}
    assert got == want


def test_lone_shingles_and_signatures_are_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 12, rng.integers(0, 60)))) for i in range(300)]
    rows += [(900, rows[5][1]), (901, None), (None, "a b c d e"), (902, "a b c d e f")]
    found, _ = join.holdings(spark.createDataFrame(rows, "doc_id long, text string"), 4, 7)
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(max(1, len(t.split()) - 3))} if t and t.split() else set() for i, t in rows}
    for r in found.collect():
        own = sets[r["doc_id"]]
        others = set().union(*(s for s in sets.values() if s != own))
        assert r["n"] == len(own) and r["lone"] <= len(own - others)
        if sum(s == own for s in sets.values()) == 1:
            assert r["lone"] == len(own - others)
    found = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    x, y = np.unique(found[:300]), np.unique(found[60:])
    both = np.concatenate([x, y])
    sx, sy = join.parities(both, np.repeat([0, 1], [len(x), len(y)]), 2)
    assert 0 < sum(int(v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in (sx ^ sy).tolist()) <= len(np.setxor1d(x, y))


def test_wide_signatures_tell_apart_what_narrow_ones_do_not(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    y = x.copy()
    y[:39] = rng.integers(0, 1 << 63, 39).astype(np.uint64)  # similarity 361 / 439, below 0.85
    z = x.copy()
    z[:32] = rng.integers(0, 1 << 63, 32).astype(np.uint64)  # similarity 368 / 432, above it
    wide = join.parities(np.concatenate([x, y, z]), np.repeat([0, 1, 2], 400), 3)
    narrow = join.folded(wide)
    rows = [(i, 400, *map(int, narrow[i]), *map(int, wide[i])) for i in range(3)]
    columns = ", ".join(f"{s} long" for s in join.SIGNATURE + join.WIDE)
    df = spark.createDataFrame(rows, f"rid int, n int, {columns}")

    def met(words):
        pairs = df.alias("x").join(df.alias("y")).where("x.rid = 0 AND y.rid > 0").where(join.near("x", "y", 85, words))
        return {r[0] for r in pairs.select("y.rid").collect()}

    assert met(join.SIGNATURE) == {1, 2}
    assert met(join.WIDE) == {2}
