import hashlib
import re

import pytest

from terralens.llm import op2_exact_dedup as dedup
from terralens.llm import op9_mixing as mixing

from .conftest import words_of


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_labels_of_awkward_documents(docs, no_docs, rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    want = []
    for doc_id, text, *_ in rows:
        own = groups[normal(text)]
        keep = min((i for i in own if i is not None), default=None)
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    got = dedup.label_copies(docs).select("doc_id", *dedup.FOUND).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if w[3])
    assert dedup.label_copies(no_docs).count() == dedup.deduplicate(no_docs).count() == 0


def test_python_has_no_part_in_the_plans(spark, sf):
    for df in (dedup.exact_dedup(spark, sf), mixing.mixing(spark, sf), mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan) and not re.search("Cartesian|NestedLoop", plan)


def targets_by_rounds(sizes):
    """Targets by the rule itself: share by weight, stop at twice the size, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check_mix(got, rows, near):
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    target = targets_by_rounds(sizes)
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=str) == sorted(((i, s, len(words_of(t))) for i, t, _, s, _ in rows), key=str)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near


def test_mix_of_awkward_documents(docs, no_docs, rows):
    got = mixing.mix(docs).collect()
    check_mix(got, rows, 1)
    # small blocks and shards, so that quotas matter
    small = mixing.mix(docs, block=4, shard=300)
    check_mix(small.collect(), rows, 4 * 30)
    assert sorted(small.collect(), key=str) == sorted(mixing.mix(docs, block=4, shard=300).collect(), key=str)
    assert mixing.mix(no_docs).count() == mixing.mixed(no_docs).count() == 0


def test_mixed_rows_hold_the_words_that_are_taken(docs, rows):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(unique, block=16).collect()}
    got = mixing.mixed(unique, block=16)
    assert got.columns == docs.columns
    held, texts = {}, {i: t for i, t, *_ in rows}
    for r in got.collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"])
        if r["text"] != texts[r["doc_id"]]:
            it = iter(words_of(texts[r["doc_id"]]))
            assert all(w in it for w in r["text"].split(" "))
    assert held == {k: v for k, v in plan.items() if v}


def highest(votes, seats):
    ranked = sorted(((-v / (k + 0.5), p, k) for p, v in votes.items() if v for k in range(seats)))[:seats]
    return {p: sum(q == p for _, q, _ in ranked) for p in votes}


def test_quotients_against_listing_them(spark):
    for votes, seats in (({0: 53, 1: 24, 2: 23, 3: 0}, 7), ({0: 10, 1: 10, 2: 10}, 10), ({0: 1, 1: 1000}, 300), ({0: 5}, 4), ({0: 3, 1: 2}, 0)):
        rows = [("g", p, v, seats) for p, v in votes.items()] + [("h", 0, 1, 1)]
        df = spark.createDataFrame(rows, "grp string, p int, v long, seats long")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["grp"], "p", "v", "seats").where("grp = 'g'").collect()}
        assert got == highest(votes, seats)
