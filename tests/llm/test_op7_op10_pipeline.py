import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralens.llm import op7_hmm as lm
from terralens.llm import op10_quality as quality

from .conftest import words_of
from .test_op2_op9 import normal
from .test_op5_op6_op8 import brute_groups


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def plain_forward(states, seen):
    v, total, ahead = states.start, 0.0, []
    for c in seen:
        a = v * states.emits[c]
        total += math.log(a.sum())
        ahead.append(a / a.sum())
        v = ahead[-1] @ states.moves
    return total, np.array(ahead)


def test_sweep_is_the_forward_and_backward_recursion():
    rng = np.random.default_rng(1)
    states = lm.first_states(np.full(lm.CLASSES, 1 / lm.CLASSES), 4)
    states.moves = rng.dirichlet(np.ones(4), 4)
    count = np.array([3, 200, 64, 1, 130])
    seen = rng.integers(0, lm.CLASSES, count.sum())
    sweep = lm.Sweep(seen, count)
    logs = sweep.forward(states)[0]
    starts, moves, emits = np.zeros(4), np.zeros((4, 4)), np.zeros((4, lm.CLASSES))
    for n, end, log in zip(count, np.cumsum(count), logs):
        own = seen[end - n : end]
        total, ahead = plain_forward(states, own)
        assert log == pytest.approx(total)
        back = np.ones((n, 4))
        for t in range(n - 2, -1, -1):
            back[t] = states.moves @ (states.emits[own[t + 1]] * back[t + 1])
            back[t] /= (ahead[t] * back[t]).sum()
        share = ahead * back
        share /= share.sum(1, keepdims=True)
        starts += share[0]
        for t in range(n):
            emits[:, own[t]] += share[t]
            if t + 1 < n:
                xi = ahead[t][:, None] * states.moves * (states.emits[own[t + 1]] * back[t + 1])
                moves += xi / xi.sum()
    for got, want in zip(sweep.counts(states), (starts, moves, emits)):
        assert np.allclose(got, want)


def test_counts_of_mixed_lengths_are_those_of_the_sweep():
    rng = np.random.default_rng(3)
    states = lm.first_states(rng.dirichlet(np.ones(lm.CLASSES)))
    count = np.concatenate([rng.integers(1, 90, 60), [1, 4000, 700, 64, 65]])
    seen = rng.integers(0, lm.CLASSES, count.sum())
    want = lm.Sweep(seen, count).counts(states)
    assert want[3] == pytest.approx(lm.Sweep(seen, count).forward(states)[0].sum())
    for got in (lm.side_by_side(seen, count, states), lm.counts_of(seen, count, states)):
        for g, w in zip(got, want):
            assert np.allclose(g, w)


def test_training_ends_when_the_likelihood_stops_rising(spark):
    """More passes over all training documents raise the likelihood by no more than the last one was allowed to."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    told = [sum(r["score"] for r in got if not r["held_out"]) for got in (lm.scored(df).collect(), lm.scored(df, passes=45).collect())]
    tokens = lm.scored(df, passes=0).first()["train_tokens"]
    assert abs(told[0] - told[1]) < 1e-4 * tokens


def check_scores(got, rows):
    words = [(i, words_of(t, True) + [None]) for i, t in rows]
    counts = Counter(w for i, own in words if fold(i, 7) != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    want = [
        (i, fold(i, 7) == 2, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6))
        for i, own in words
    ]
    told = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert [w[:5] for w in sorted(want, key=str)] == [w[:5] for w in sorted(told, key=str)]
    assert np.allclose([w[5] for w in sorted(want, key=str)], [w[5] for w in sorted(told, key=str)], atol=1e-5)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_scores_of_awkward_documents(docs, no_docs, rows):
    check_scores(lm.scored(docs).collect(), [r[:2] for r in rows])
    assert lm.scored(no_docs).count() == 0


def test_scores_when_most_words_are_rare(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 4)
    check_scores(lm.scored(docs, passes=0).collect(), [r[:2] for r in rows])


def test_score_is_the_model_of_class_and_word(spark):
    """One training document: the score by hand from the same states."""
    df = spark.createDataFrame([(1, "ab ab cd"), (2, "ab zz")], "doc_id long, text string")
    ids = [i for i in range(1, 60) if fold(i, 7) != 2][:1] + [i for i in range(1, 60) if fold(i, 7) == 2][:1]
    df = spark.createDataFrame([(ids[0], "ab ab cd"), (ids[1], "ab zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.scored(df, passes=0).collect()}
    told = df.withColumn("version", F.xxhash64("text")).withColumn("held_out", lm.is_held_out(F.col("doc_id")))
    tokens = {"ab": 2, "cd": 1, None: 1}
    kind = lambda w: lm.END_CLASS if w is None else (ord(w[0]) & 31) << 5 | ord(w[-1]) & 31
    seen = np.zeros(lm.CLASSES)
    mass = np.zeros(lm.CLASSES)
    for w, c in tokens.items():
        seen[kind(w)] += c
        mass[kind(w)] += c + 1
    states = lm.start_states(told, (seen + 1) / (seen + 1).sum())
    for i, own in zip(ids, (["ab", "ab", "cd", None], ["ab", "zz", None])):
        log = plain_forward(states, [kind(w) for w in own])[0] / math.log(10)
        log += sum(math.log10(tokens.get(w, 0) + 1) - math.log10(mass[kind(w)] + 1) for w in own)
        assert got[i] == pytest.approx(log)


def test_states_beat_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = lm.hmm(spark, sf).collect()
    check_scores(got, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def plain_score(raw, network):
    """The network position by position: chunks of two blocks, maxima, mean, logistic unit."""
    b, w = quality.BLOCK, quality.WIDTH
    many = max(-(-len(raw) // b), 1)
    data = np.frombuffer(raw + bytes(b * many + 2 * w), np.uint8)
    response = np.array([sum(network.filters[k][data[i + k]] for k in range(w)) for i in range(many * b)])
    blocks = [response[i * b : (i + 1) * b].max(0) for i in range(many)]
    chunks = [np.maximum(x, y) for x, y in zip(blocks, blocks[1:])] or blocks
    mean = np.mean([np.maximum(c + network.offsets, 0) for c in chunks], axis=0)
    return 1 / (1 + math.exp(-(mean @ network.weights + network.bias)))


def test_scores_against_the_plain_network():
    rng = np.random.default_rng(6)
    net = quality.Network(rng.normal(size=(4, 256, 3)).astype(np.float32), rng.normal(size=3), rng.normal(size=3), 0.2)
    texts = ["", None, "a", "é" * 64, "b" * 128, "c" * 129, "x y " * 200, "end"]
    got = quality.scores(pa.array(texts), net)
    assert np.allclose(got, [plain_score((t or "").encode(), net) for t in texts], atol=1e-5)
    assert len(quality.scores(pa.array([], pa.string()), net)) == 0


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    texts = [(i, "good words here " * 9 if i % 2 else "XQ#7 %%% 00" * 9) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    got = quality.learn(docs, labels, sample=20)
    alone = quality.learn(docs, labels.where("doc_id < 40"), sample=20)
    assert np.abs(alone.weights).max() > 0
    assert np.allclose(got.weights, alone.weights) and np.isclose(got.bias, alone.bias)


def test_labelled_texts_are_learned_from_whole(spark):
    # what tells the classes apart stands once, behind the first eight of many chunks or anywhere between
    rng = np.random.default_rng(8)
    texts = []
    for i in range(300):
        words = ["plain"] * 600
        if i % 2:
            words[rng.integers(250, 600)] = "#%#%#%"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.range(300).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    got = quality.classify(docs, quality.learn(docs, labels)).collect()
    held = [r for r in got if fold(r["doc_id"], 5) == 0]
    assert np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in held]) > 0.95


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    texts = [(i, "word " * (1 + i % 7)) for i in range(200)] + [(3, "word word word word ")] * 50 + [(500, "x" * 5000), (501, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality").distinct()
    seen = []
    monkeypatch.setattr(quality, "fit", lambda t, y: seen.append((t, y)))
    quality.learn(docs, labels)
    quality.learn(docs, labels, sample=20)
    quality.learn(docs, labels, sample_bytes=1000)
    whole = sorted(t or "" for i, t in dict(texts).items() if fold(i, 5) != 0)
    assert sorted(bytes(x).decode() for x in seen[0][0]) == whole
    assert len(seen[1][0]) == 20
    assert 950 < sum(map(len, seen[2][0])) <= 1000 and max(map(len, seen[2][0])) < 5000


def test_chunk_maxima_against_position_by_position():
    rng = np.random.default_rng(4)
    filters = rng.normal(size=(4, 256, quality.FILTERS)).astype(np.float32)
    data = rng.integers(0, 256, 700).astype(np.uint8)
    start, end = np.array([0, 128, 500]), np.array([400, 400, 700])
    high, seen = quality.chunk_maxima(data, start, end, filters)
    for c in range(3):
        row = np.concatenate([data[start[c] : min(start[c] + 259, end[c])], np.zeros(300, np.uint8)])
        response = np.array([sum(filters[k][row[i + k]] for k in range(4)) for i in range(256)])
        assert np.allclose(high[c], response.max(0), atol=1e-5)
        assert np.allclose([sum(filters[k][seen[k, c, u], u] for k in range(4)) for u in range(quality.FILTERS)], high[c], atol=1e-5)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(fold(r["doc_id"], 5) == 0 and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    good, bad = ([r["predicted"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_learning_with_few_or_odd_labels(spark, docs, no_docs):
    kind = "doc_id long, quality int, toxic int"
    for rows in ([], [(None, 1, 0), (1, None, 0)], [(i, 1, 0) for i in range(30)], [(i, i % 2, None) for i in range(30)] * 2 + [(999, 0, 0)]):
        network = quality.learn(docs, spark.createDataFrame(rows, kind))
        got = quality.classify(docs, network)
        assert got.count() == docs.count() and got.where("score BETWEEN 0 AND 1").count() == docs.count()
    kept = quality.accepted(docs, network)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()
    assert quality.classify(no_docs, network).count() == quality.accepted(no_docs, network).count() == 0


def test_stages_on_their_own_inputs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality classifier"](spark, docs, sf).cache()
    stays = {r["doc_id"] for r in kept.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert kept.columns == docs.columns and np.mean([i in stays for i in good]) > 0.98

    unique = stage["exact dedup"](spark, kept, sf).cache()
    first = {}
    for r in kept.collect():
        first[normal(r["text"])] = min(first.get(normal(r["text"]), r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in unique.collect()} == set(first.values())

    apart = stage["n-gram Jaccard join"](spark, unique, sf).cache()
    groups = brute_groups([(r["doc_id"], r["text"]) for r in unique.collect()], 5, 80)
    assert {r["doc_id"] for r in apart.collect()} == {i for i, g in groups.items() if i == g}

    mix = stage["mixing sources to target weights"](spark, apart, sf).cache()
    assert mix.columns == docs.columns
    total = sum(len(words_of(r["text"])) for r in apart.collect())
    assert abs(sum(len(words_of(r["text"])) for r in mix.collect()) - 1.5 * total) < 30

    packed = stage["packing"](spark, mix, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mix.collect()}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))
    assert corpus_pipeline.ORACLE_SQL is None
