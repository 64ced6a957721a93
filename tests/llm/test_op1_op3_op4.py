import random
import zlib

import numpy as np
import pyarrow as pa

from terralens.llm import op1_training_order as order
from terralens.llm import op3_edit_counts as counts
from terralens.llm import op4_packing as packing
from terralens.llm.shared import shared_folder
from terralens.llm.tokens import default_vocabulary


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_permutation_is_one_at_any_size():
    for size in (1, 2, 3, 4, 5, 63, 64, 65, 1000):
        assert sorted(order.permuted(np.arange(size), size)) == list(range(size))
    assert (order.permuted(np.arange(1000), 1000, 1) != order.permuted(np.arange(1000), 1000, 2)).any()


def test_shards_give_back_every_document(spark, docs, rows, reference):
    folder = shared_folder(spark, "test-shards")
    told = order.write_shards(docs, folder, length=16, shard_bytes=4096).collect()
    assert len(told) > 3 and len({r["shard"] for r in told}) == len(told)
    got = sorted(order.read_slots(spark, folder, length=16).collect())
    assert [r["slot"] for r in got] == list(range(sum(r["records"] for r in told)))
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["start"]), []).append(r["ids"])
    want = {}
    for doc_id, text, *_ in rows:
        ids = reference(text) + [0]
        for a in range(0, len(ids), 16):
            want.setdefault((-1 if doc_id is None else doc_id, a), []).append(ids[a : a + 16])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    some = sorted(order.read_slots(spark, folder, 40, 90, length=16).collect())
    assert some == [r for r in got if 40 <= r["slot"] < 90]
    again = shared_folder(spark, "test-shards")
    order.write_shards(docs, again, length=16, shard_bytes=4096)
    assert sorted(order.read_slots(spark, again, length=16).collect()) == got


def test_no_documents_no_shards(spark, no_docs):
    folder = shared_folder(spark, "test-shards")
    assert order.write_shards(no_docs, folder).count() == 0
    assert order.read_slots(spark, folder).count() == 0


def test_training_order_of_a_table(spark, sf, reference):
    got = order.training_order(spark, sf).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got[:200]:
        ids = reference(texts[r["doc_id"]]) + [0]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])


def edited(text, edits):
    for position, deleted, inserted in edits:
        position = min(max(position, 0), len(text))
        text = text[:position] + inserted + text[position + max(deleted, 0) :]
    return text


def test_tree_follows_any_edits(reference, rows):
    rng = random.Random(5)
    texts = [t or "" for _, t, *_ in rows if len(t or "") < 3000]
    bits = ["", " ", "\n", "new word", "é", " ", "  ", "<|endoftext|>", "'s", " x y z "]
    for text, tree in zip(texts, counts.trees(pa.array(texts), default_vocabulary())):
        assert tree.total() == len(reference(text))
        for _ in range(12):
            move = (rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 9, 400]), rng.choice(bits))
            tree.edit(*move)
            text = edited(text, [move])
            assert tree.total() == len(reference(text)), (text, move)


def test_counts_after_edits_of_a_table(spark, docs, rows, reference):
    moves = [(11, 1, 3, 4, "zz"), (11, 0, 10_000, 1, None), (11, 2, None, None, "top "), (2, 0, 1, 1, "q"), (999, 0, 0, 0, "lost"), (None, 0, 0, 0, "x"), (3, 5, 7, 7, "seven")]
    edits = spark.createDataFrame(moves, "doc_id long, seq long, position long, deleted long, inserted string")
    got = sorted(counts.recount(docs, edits).collect(), key=str)
    want = []
    for doc_id, text, *_ in rows:
        own = sorted((m[1:] for m in moves if m[0] == doc_id and doc_id is not None), key=lambda m: m[0])
        after = edited(text or "", [(p or 0, d or 0, i or "") for _, p, d, i in own])
        want.append((doc_id, len(reference(text)), len(own), len(reference(after))))
    assert sorted((r[:4] for r in got), key=str) == sorted(want, key=str)
    touched = [r for r in got if r["n_edits"]]
    assert all(r["segments_encoded"] <= 8 * r["n_edits"] for r in touched)
    assert all(r["segments_encoded"] == 0 for r in got if not r["n_edits"])


def test_no_documents_no_counts(spark, no_docs):
    edits = spark.createDataFrame([(1, 0, 0, 0, "x")], "doc_id long, seq long, position long, deleted long, inserted string")
    assert counts.recount(no_docs, edits).count() == 0


def test_edit_query_against_whole_encoding(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    moves = {}
    for e in counts.own_edits(docs).collect():
        moves.setdefault(e["doc_id"], []).append((e["seq"], e["position"], e["deleted"], e["inserted"]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = counts.edit_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        after = edited(texts[r["doc_id"]], [m[1:] for m in sorted(moves[r["doc_id"]])])
        assert (r["n_edits"], r["tokens_after"]) == (len(moves[r["doc_id"]]), len(reference(after)))


def check_packing(got, rows, reference, length=1024):
    want = sorted((-1 if i is None else i, t or "") for i, t in rows)
    by_doc = {}
    for r in got:
        by_doc.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in want}
    for doc_id, own in by_doc.items():
        pieces = sorted((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in own)
        expected = []
        for i, text in want:
            if i == doc_id:
                ids = reference(text) + [0]
                expected += [(a, min(length, len(ids) - a), len(ids), crc(ids[a : a + length])) for a in range(0, len(ids), length)]
        assert pieces == sorted(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
        padding += length - at if at & (at - 1) else 0
    return len(sequences), padding, sum(r["length"] for r in got)


def test_packing_of_awkward_documents(docs, no_docs, rows, reference):
    got = packing.pack(docs).collect()
    check_packing(got, [r[:2] for r in rows], reference)
    small = packing.pack(docs, length=32, grain=1).collect()
    check_packing(small, [r[:2] for r in rows], reference, 32)
    assert packing.pack(no_docs).count() == 0


def test_packing_pads_little(spark, reference):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, padding, tokens = check_packing(packing.packing(spark, sf).collect(), rows, reference)
    assert padding < 0.02 * tokens and n <= 1.02 * tokens / 1024 + 1


def first_fit(histogram, capacity):
    rooms = []
    for size in range(capacity, 0, -1):
        for _ in range(histogram[size]):
            at = next((i for i, r in enumerate(rooms) if r >= size), None)
            if at is None:
                rooms.append(capacity - size)
            else:
                rooms[at] -= size
    return len(rooms)


def test_patterns_cover_the_histogram():
    rng = np.random.default_rng(2)
    for capacity in (4, 16, 64):
        histogram = rng.integers(0, 40, capacity + 1)
        histogram[0] = 0
        histogram[rng.integers(1, capacity + 1, capacity // 3)] = 0
        found = packing.patterns(histogram, capacity)
        assert all((p * np.arange(capacity + 1)).sum() <= capacity and n > 0 for p, n in found)
        assert (sum(p * n for p, n in found) >= histogram).all()
        assert sum(n for _, n in found) <= first_fit(histogram, capacity) + 2
    assert packing.patterns(np.zeros(9, int), 8) == []
