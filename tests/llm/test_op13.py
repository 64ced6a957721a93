import hashlib
from collections import Counter

import numpy as np
import pytest

from terralens.llm import op13_alignment as op


@pytest.fixture(scope="module")
def brute():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from terralens.llm.tokens import byte_of_sign

    signs = byte_of_sign()
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        """(id, start, end) of both sides."""
        if not text:
            return [], []
        raw, out = (" " + text).encode(), []
        encoded = a.encode(" " + text, add_special_tokens=False)
        for ids, of in (
            (encoded.ids, [bytes(signs[c] for c in t) for t in encoded.tokens]),
            (b.encode(text), None),
        ):
            of = [b_bytes(i) for i in ids] if of is None else of
            if b"".join(of) != raw:
                return [], []
            ends = np.cumsum([len(x) for x in of]).tolist()
            out.append(list(zip(ids, [e - len(x) for e, x in zip(ends, of)], ends)))
        return out

    def all_rows(rows):
        """``rows`` of (doc_id, text) to sorted results."""
        told, count = [], Counter()
        for doc_id, text in rows:
            x, y = tokens(text)
            end_b = {e: i for i, _, e in y}
            links = [(i, end_b[e]) for i, _, e in x if e in end_b]
            cuts = [e for _, _, e in x if e in end_b]
            count.update(links)
            at_x, at_y, texts = 0, 0, []
            for cut in cuts:
                sides = []
                for side, at in ((x, at_x), (y, at_y)):
                    to = at
                    while to < len(side) and side[to][2] <= cut:
                        to += 1
                    sides.append((",".join(str(i) for i, _, _ in side[at:to]), to))
                at_x, at_y = sides[0][1], sides[1][1]
                texts.append(f"{sides[0][0]}|{sides[1][0]}")
            sha = hashlib.sha256(";".join(texts).encode()).hexdigest() if texts else ""
            told.append((doc_id, len(x), len(y), len(cuts), links, sha))
        most = {}
        for (_, i), n in count.items():
            most[i] = max(most.get(i, 0), n)
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        return sorted(
            ((d, a, b, g, len(s), sum(count[p] == most[p[1]] for p in s), sum(count[p] for p in s), sha) for d, a, b, g, s, sha in told), key=key
        ), count

    return all_rows


def in_order(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


HARD = [
    "", " ", "   ", "a", " a", "a ", "a  b   ", "\n", "\n\n a\n b \n", "\ta\tb", "a▁b", "▁", " ▁ ", "<|endoftext|> x<|endoftext|>",
    "<s> </s> <unk> <0x41>", "éé ﬁ 　x y", "\U0001f642\U0001f642 \U0001f468‍\U0001f469‍\U0001f467", "日本語 文",
    "1234567 89,000.5", "don't we'll I'VE", "x" * 5000, " " * 3000, "\x00\x01 \x7f", "� ﻿a", "café naïve À la", "a\r\nb\x0b\x0cc", None,
]


def test_hard_texts_against_brute_force(spark, brute):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "a"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    found, counts = op.align(df)
    want, count = brute(rows)
    assert in_order(found) == want
    assert {r["pair"]: r["links"] for r in counts.collect()} == {a << 32 | b: n for (a, b), n in count.items()}


def test_awkward_documents_against_brute_force(docs, rows, brute):
    assert in_order(op.align(docs)[0]) == brute([r[:2] for r in rows])[0]


def test_whole_table_against_brute_force(spark, sf, brute):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert in_order(op.alignment(spark, sf)) == brute(rows)[0]


def test_no_documents(no_docs):
    found, counts = op.align(no_docs)
    assert found.count() == 0 and counts.count() == 0


def test_tokens_that_do_not_join_take_no_part(spark, brute):
    rows = [(1, "a▁b c"), (2, "a b c")]
    found = {r["doc_id"]: r for r in op.align(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert found[1]["n_a"] == 0 and found[1]["groups_sha256"] == "" and found[2]["n_groups"] > 0


def test_intervals_without_spark():
    rng = np.random.default_rng(5)
    for _ in range(50):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, size=int(rng.integers(0, 30))), total)) for _ in "ab"]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        group_a, group_b = op.coalesced(starts[0], ends[0], starts[1], ends[1])
        cuts = np.intersect1d(*ends)
        assert group_a.tolist() == np.searchsorted(cuts, ends[0]).tolist()
        assert group_b.tolist() == np.searchsorted(cuts, ends[1]).tolist()
        a, b = op.ending_together(starts[0], ends[0], starts[1], ends[1])
        assert ends[0][a].tolist() == ends[1][b].tolist() == cuts.tolist()
