import numpy as np
import pyarrow as pa

from terralens.llm import text
from terralens.llm.tokens import default_vocabulary, encoded_slices, encoder

from .conftest import awkward_rows, words_of


def test_words_and_shingles_of_rows():
    texts = [r[1] for r in awkward_rows()]
    data, offsets = text.text_bytes(pa.array(texts))
    starts, ends, row = text.word_spans(data, offsets)
    raw = data.tobytes()
    found = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row):
        found[r].append(raw[a:b].decode())
    assert found == [words_of(t) for t in texts]
    hashes = text.word_hashes(data, starts, ends, True)
    runs, owner, _ = text.shingles(hashes, row, len(texts), 3)
    seen = {}
    at = 0
    for r, t in enumerate(texts):
        w = words_of(t, True)
        own = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [tuple(w)] * bool(w)
        for run in own:
            assert owner[at] == r and seen.setdefault(run, runs[at]) == runs[at]
            at += 1
    assert at == len(runs) and len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows_and_nulls():
    column = pa.chunked_array([pa.array(["ab", None, ""]), pa.array(["c" * 50, "d"])])
    got = [(lo, bytes(d), o.tolist()) for lo, d, o in text.slices(column, 4)]
    assert b"".join(d for _, d, _ in got) == b"ab" + b"c" * 50 + b"d"
    assert sum(len(o) - 1 for _, _, o in got) == 5
    assert list(text.slices(pa.array([], pa.string()))) == []


def test_ids_are_those_of_the_vocabulary(reference):
    texts = [r[1] for r in awkward_rows()] + ["  lead", "trail  ", "a \u0085 b", "tabs\t\t x", "a  b", "\r\n\r\n", "12,5% of 'tis"]
    for lo, ids, at in encoded_slices(pa.array(texts), default_vocabulary()):
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == reference(texts[lo + i])


def test_encoder_that_forgets(reference):
    own = type(encoder(default_vocabulary()))(default_vocabulary(), remembered=5)
    texts = [r[1] or "" for r in awkward_rows()[:30]]
    data, offsets = text.text_bytes(pa.array(texts))
    for i in range(len(texts)):
        ids, _ = own.encode(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        assert ids.tolist() == reference(texts[i])


def test_hashing_a_long_text_needs_little_beside_it():
    import tracemalloc

    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4 * text.SLICE, np.uint8)
    starts = np.array([0, 5, text.STRIPE - 1, text.STRIPE, 3 * text.STRIPE + 7, len(data) - 9])
    ends = np.array([5, 5, text.STRIPE + 1, 2 * text.STRIPE, 3 * text.STRIPE + 8, len(data)])
    tracemalloc.start()
    try:
        hashes = text.word_hashes(data, starts, ends, True)
        assert tracemalloc.get_traced_memory()[1] < len(data)
    finally:
        tracemalloc.stop()
    for i, (a, b) in enumerate(zip(starts, ends)):
        alone = text.word_hashes(data[a:b], np.array([0]), np.array([b - a]), True)
        assert hashes[i] == alone[0]
