"""Scoring texts by a hidden Markov language model.

A hidden state gives each token a word class, and the class gives the word. Classes are few (first and last byte), so
the states' tables stay small whatever the vocabulary; the share of a word in its class comes from counts over all
training documents. The states are trained by Baum-Welch counts summed over all partitions, and a text's likelihood is
the exact forward recursion over all its tokens, scaled on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .shared import bounded_batches, gathered, shared_folder, shuffle_partitions, written
from .text import mix64, slices, word_hashes, word_spans

CAT = Catalogue()

#: Hidden states, word classes (the last one is the end of a text), tokens of a chunk that is swept at once.
STATES, CLASSES, CHUNK = 6, 1025, 64
END_CLASS = CLASSES - 1
#: Baum-Welch passes over all training documents until one raises the log likelihood by less than GAIN a token (nats).
#: A pass goes over the documents in BLOCKS parts by hash and moves the states after each.
GAIN, BLOCKS, SEED = 1e-4, 8, 5
#: Tokens counted together, steps between rescalings, and how many tokens of a chunked document cost as much as a step.
SWEPT, RESCALED, STEP_COST = 1 << 19, 4, 8
#: Most frequent words whose counts every task knows; the others meet their counts by hash.
FREQUENT = 1 << 16
#: Entries of the vocabulary that a task sums up together.
COUNTED = 3 << 19

END_HASH = np.uint64(0xE5D)
LOG10 = np.log(10)
U64 = np.uint64

FOLD = np.arange(256)
FOLD[65:91] += 32
FOLD &= 31


def tokens_of(data, offsets, hashes=True):
    """Word hashes (or None), class and row of all tokens; each row's words and then its end."""
    starts, ends, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    at = np.arange(len(starts)) + row
    stop = np.cumsum(count + 1) - 1
    classes = np.full(len(starts) + rows, END_CLASS, np.int64)
    if len(starts):
        classes[at] = FOLD[data[starts]] << 5 | FOLD[data[ends - 1]]
    owner = np.repeat(np.arange(rows), count + 1)
    words = None
    if hashes:
        words = np.full(len(classes), END_HASH, U64)
        words[at] = word_hashes(data, starts, ends, True)
    return words, classes, owner, stop


@dataclass
class States:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


class Sweep:
    """The chunks of some documents, swept side by side; exact for whole documents of any length."""

    def __init__(self, classes, count):
        chunks = -(-count // CHUNK)
        self.order = np.argsort(-chunks, kind="stable")
        first = np.cumsum(chunks) - chunks
        at = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(count)), chunks)
        begin = at[doc] + (np.arange(len(doc)) - first[doc]) * CHUNK
        self.length = np.minimum(at[doc] + count[doc] - begin, CHUNK)
        place = begin[:, None] + np.arange(CHUNK)
        self.on = np.arange(CHUNK) < self.length[:, None]
        self.seen = classes[np.minimum(place, max(len(classes) - 1, 0))]
        self.closing = np.zeros(len(doc), bool)
        self.closing[first + chunks - 1] = True
        self.first, self.chunks = first, chunks

    def transfer(self, states):
        """For each chunk the matrix that takes the state forecast before it to the one after, and its log scale."""
        k, n = len(states.start), len(self.length)
        x = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        scale = np.zeros(n)
        for t in range(CHUNK):
            live = np.flatnonzero(self.on[:, t])
            whole = len(live) == n
            y = x if whole else x[live]
            y = ((y * states.emits[self.seen[live, t]][:, None, :]).reshape(-1, k) @ states.moves).reshape(-1, k, k)
            if t % 8 == 7 or t == CHUNK - 1:
                s = y.max(axis=(1, 2))
                y /= s[:, None, None]
                scale[live] += np.log(s)
            if whole:
                x = y
            else:
                x[live] = y
        return x, scale

    def forward(self, states):
        """Log likelihood of each document, and the state forecast before each chunk."""
        x, scale = self.transfer(states)
        before = np.empty((len(x), len(states.start)))
        v = np.broadcast_to(states.start, (len(self.order), len(states.start))).copy()
        total = np.zeros(len(self.order))
        counts = self.chunks[self.order]
        for j in range(int(counts[0]) if len(counts) else 0):
            live = int(np.searchsorted(-counts, -j, "left"))
            at = self.first[self.order[:live]] + j
            before[at] = v[:live]
            w = np.einsum("dk,dkl->dl", v[:live], x[at])
            s = w.sum(1)
            total[:live] += np.log(s) + scale[at]
            v[:live] = w / s[:, None]
        out = np.empty(len(total))
        out[self.order] = total
        return out, before, x

    def counts(self, states):
        """Expected numbers of starts, moves and emitted classes, and the log likelihood of all documents."""
        likely, before, x = self.forward(states)
        k, n = len(states.start), len(self.length)
        after = np.ones((n, k))
        counts = self.chunks[self.order]
        for j in range(int(counts[0]) - 1 if len(counts) else 0, 0, -1):
            live = int(np.searchsorted(-counts, -j, "left"))
            at = self.first[self.order[:live]] + j
            w = np.einsum("dkl,dl->dk", x[at], after[at])
            after[at - 1] = w / w.max(1)[:, None]
        ahead = np.empty((CHUNK, n, k))
        v = before.copy()
        for t in range(CHUNK):
            ahead[t] = v
            w = (v * states.emits[self.seen[:, t]]) @ states.moves
            v = np.where(self.on[:, t, None], w / w.sum(1)[:, None], v)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
        w = after
        for t in range(CHUNK - 1, -1, -1):
            on = self.on[:, t]
            b = states.emits[self.seen[:, t]]
            back = b * (w @ states.moves.T)
            z = (ahead[t] * back).sum(1)
            share = np.where(on[:, None], ahead[t] * back / z[:, None], 0)
            goes = on & ~(self.closing & (t == self.length - 1))
            moves += (np.where(goes[:, None], ahead[t] * b / z[:, None], 0)).T @ w
            for i in range(k):
                emits[i] += np.bincount(self.seen[:, t], share[:, i], CLASSES)
            if t == 0:
                starts += share[self.first].sum(0)
            w = np.where(on[:, None], back / back.max(1)[:, None], w)
        return starts, moves * states.moves, emits, likely.sum()


def side_by_side(classes, count, states):
    """What ``Sweep.counts`` gives, by one step a position for all documents at once: cheap for many of like length."""
    k = len(states.start)
    order = np.argsort(-count, kind="stable")
    count, at = count[order], (np.cumsum(count) - count)[order]
    live = np.searchsorted(-count, -np.arange(count[0]), "left")
    off = np.concatenate([[0], np.cumsum(live)])
    step = np.arange(off[-1]) - np.repeat(np.cumsum(count) - count, count)
    seen = np.empty(off[-1], np.int64)
    seen[off[step] + np.repeat(np.arange(len(count)), count)] = classes[np.repeat(at, count) + step]
    ahead = np.ascontiguousarray(states.emits.T).take(seen, axis=1)
    back, after = ahead.copy(), np.ones_like(ahead)
    moved = np.ascontiguousarray(states.moves.T)
    likely = 0.0
    v = np.repeat(states.start[:, None], len(count), axis=1)
    for t, (lo, n) in enumerate(zip(off.tolist(), live.tolist())):
        x = ahead[:, lo : lo + n]
        x *= v[:, :n]
        if t % RESCALED == 0:
            scale = x.sum(0)
            x /= scale
            likely += np.log(scale).sum()
        v = moved @ x
    for t in range(len(live) - 1, 0, -1):
        lo, n = off[t], live[t]
        w = back[:, lo : lo + n]
        w *= after[:, lo : lo + n]
        if t % RESCALED == 0:
            w /= w.max(0)
        after[:, off[t - 1] : off[t - 1] + n] = states.moves @ w
    last = off[count - 1] + np.arange(len(count))
    likely += np.log(ahead[:, last].sum(0)).sum()
    after *= ahead
    z = after.sum(0)
    after /= z
    ahead /= z
    later = np.arange(live[0], off[-1])
    before = later - np.repeat(live[:-1], live[1:])
    moves = ahead.take(before, axis=1) @ back[:, live[0] :].T
    emits = np.stack([np.bincount(seen, share, CLASSES) for share in after])
    return after[:, : live[0]].sum(1), moves * states.moves, emits, likely


def counts_of(classes, count, states):
    """Expected counts and log likelihood of documents of any length: the longest in chunks, the others side by side."""
    order = np.argsort(-count, kind="stable")
    most = count[order]
    cut = int(np.argmin(np.append(most, 0) * STEP_COST + np.concatenate([[0], np.cumsum(most)])))
    at = np.cumsum(count) - count
    total = None
    for own, counted in ((np.sort(order[:cut]), lambda *x: Sweep(*x).counts(states)), (np.sort(order[cut:]), lambda *x: side_by_side(*x, states))):
        if len(own):
            place = np.arange(count[own].sum()) + np.repeat(at[own] - (np.cumsum(count[own]) - count[own]), count[own])
            got = counted(classes[place], count[own])
            total = got if total is None else [a + b for a, b in zip(total, got)]
    return total


def reestimated(starts, moves, emits, classes):
    """The states from expected counts; every class keeps a share by ``classes``, so no text is impossible."""
    return States(
        (starts + 1) / (starts + 1).sum(),
        (moves + 1) / (moves + 1).sum(1, keepdims=True),
        ((emits + classes) / (emits + classes).sum(1, keepdims=True)).T.copy(),
    )


def first_states(classes, states=STATES, seed=SEED):
    rng = np.random.default_rng(seed)
    share = classes[:, None] * rng.gamma(2.0, size=(CLASSES, states))
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return States(np.full(states, 1 / states), moves, share / share.sum(0))


def is_held_out(doc_id, folds=7, fold=2):
    """Documents that no count is learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def joined(blobs, width):
    return np.concatenate([np.frombuffer(b, "<i8").reshape(width, -1) for b in blobs], axis=1)


def vocabulary(docs, parts):
    """Words of the training documents: rows (part, words, frequent), byte blocks of hash, class and count.

    A task sends each word of its next documents once, with its count, to where the word's counts meet. ``frequent`` repeats those
    that may be among the FREQUENT most frequent of all.
    """

    def counted(batch):
        for _, data, offsets in slices(batch.column(0)):
            words, classes, _, _ = tokens_of(data, offsets)
            values, first, times = np.unique(words, return_index=True, return_counts=True)
            yield np.stack([values.view(np.int64), classes[first], times])

    def pack(batches):
        for got in gathered(batches, counted, lambda x: x.shape[1], COUNTED):
            yield blocks(*summed(np.concatenate(got, axis=1)), parts)

    def blocks(words, classes, times, parts):
        part = (mix64(words.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        own = np.flatnonzero(np.diff(bounds))
        whole = np.stack([words, classes, times]).astype("<i8")[:, order]
        blobs = [np.ascontiguousarray(whole[:, bounds[i] : bounds[i + 1]]).tobytes() for i in own]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], ["part", "words"])

    def meet(batches):
        part, held = None, []
        for batch in batches:
            for p, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield whole(part, held)
                    held = []
                part = p
                held.append(blob)
        if held:
            yield whole(part, held)

    def whole(part, held):
        words, classes, times = summed(joined(held, 3))
        most = np.argsort(-times, kind="stable")[:FREQUENT]
        mass = np.bincount(classes, times + 1, CLASSES)
        seen = np.bincount(classes, times, CLASSES)
        rows = ([words, classes, times], [words[most], times[most]], [mass.astype(np.int64), seen.astype(np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), *(pa.array([np.stack(r).astype("<i8").tobytes()], pa.binary()) for r in rows), pa.array([len(words)], pa.int64())],
            ["part", "words", "frequent", "mass", "distinct"],
        )

    return (
        docs.where("NOT held_out")
        .select("text")
        .mapInArrow(pack, "part long, words binary")
        .repartition(shuffle_partitions(docs.sparkSession), "part")
        .sortWithinPartitions("part")
        .mapInArrow(meet, "part long, words binary, frequent binary, mass binary, distinct long")
    )


def summed(rows):
    """Rows (word, class, count) with each word once."""
    words, first, which = np.unique(rows[0], return_index=True, return_inverse=True)
    return words, rows[1][first], np.bincount(which, rows[2], len(words)).astype(np.int64)


def most_frequent(spark, words):
    """Hashes and counts of the FREQUENT most frequent words, sorted by hash."""

    def listed(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined([blob], 2)], ["word", "times"])

    top = words.select("frequent").mapInArrow(listed, "word long, times long").orderBy(F.desc("times"), "word").limit(FREQUENT)
    rows = top.toArrow()
    word, times = rows.column("word").to_numpy().view(U64), rows.column("times").to_numpy()
    order = np.argsort(word)
    return word[order], times[order]


def class_counts(words):
    """Of each class the words' counts plus one each, and the counts; the number of tokens and of distinct words."""
    mass = np.zeros((2, CLASSES), np.int64)
    distinct = 0
    for row in words.select("mass", "distinct").toLocalIterator():
        mass += np.frombuffer(row["mass"], "<i8").reshape(2, -1)
        distinct += row["distinct"]
    return mass[0], mass[1], int(mass[1].sum()), distinct


def rare_sums(docs, words, known, parts):
    """Rows (doc_id, version, logs, found, tokens): of each document's words that are not frequent, by part, the sum of
    log10(count + 1), how many are known, and how many there are. No word here has more than its share of the tokens,
    1 / FREQUENT, so no part is much larger than another."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(known)

    def pack(batches):
        hashes, _ = frequent.value
        for batch in batches:
            got = []
            for lo, data, offsets in slices(batch.column(2)):
                found, _, owner, _ = tokens_of(data, offsets)
                at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
                rare = np.flatnonzero(hashes[at] != found) if len(hashes) else np.arange(len(found))
                got.append(np.stack([found[rare].view(np.int64), lo + owner[rare]]))
            if not got:
                continue
            found, row = np.concatenate(got, axis=1)
            part = (mix64(found.view(U64)) % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            own = np.flatnonzero(np.diff(bounds))
            ids, versions = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            blobs = []
            for i in own:
                pick = order[bounds[i] : bounds[i + 1]]
                rows, which = np.unique(row[pick], return_inverse=True)
                head = np.concatenate([[len(rows)], ids[rows], versions[rows]]).astype("<i8").tobytes()
                blobs.append(head + np.diff(which, prepend=0).astype("<i4").tobytes() + found[pick].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(len(own), pa.binary())], ["part", "asked", "words"])

    def answer(table_of, blob):
        rows = int(np.frombuffer(blob, "<i8", 1)[0])
        ids, versions = np.frombuffer(blob, "<i8", 2 * rows, 8).reshape(2, -1)
        n = (len(blob) - 8 - 16 * rows) // 12
        which = np.cumsum(np.frombuffer(blob, "<i4", n, 8 + 16 * rows))
        found = np.frombuffer(blob, "<i8", n, 8 + 16 * rows + 4 * n)
        words, times = table_of
        at = np.minimum(np.searchsorted(words, found), max(len(words) - 1, 0))
        count = np.where(words[at] == found, times[at], 0) if len(words) else np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids),
                pa.array(versions),
                pa.array(np.bincount(which, np.log10(count + 1.0), rows)),
                pa.array(np.bincount(which, count > 0, rows).astype(np.int64)),
                pa.array(np.bincount(which, minlength=rows)),
            ],
            ["doc_id", "version", "logs", "found", "tokens"],
        )

    def meet(batches):
        part, table_of = None, None
        for batch in batches:
            for p, asked, told in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, table_of = p, (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if told is not None:
                    kept = joined([told], 3)
                    table_of = (kept[0], kept[2])
                else:
                    yield answer(table_of, asked)

    asked = docs.select("key", "version", "text").mapInArrow(pack, "part long, asked binary, words binary")
    told = words.select("part", F.lit(None).cast("binary").alias("asked"), "words")
    return (
        asked.unionByName(told)
        .repartition(shuffle_partitions(spark), "part")
        .sortWithinPartitions("part", F.col("words").isNull())
        .mapInArrow(meet, "doc_id long, version long, logs double, found long, tokens long")
    )


def classes_of_texts(docs):
    """The classes of each training document's tokens as one row (block, seen), two bytes each; blocks are dealt by hash."""

    def read(batches):
        for batch in batches:
            for lo, data, offsets in slices(batch.column(1)):
                _, classes, _, stop = tokens_of(data, offsets, hashes=False)
                bounds = 2 * np.concatenate([[0], stop + 1])
                raw = classes.astype("<i2").tobytes()
                seen = pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(seen)), seen], ["block", "seen"])

    block = F.pmod(F.xxhash64("doc_id", "version"), F.lit(BLOCKS)).cast("int").alias("block")
    return docs.where("NOT held_out").select(block, "text").mapInArrow(read, "block int, seen binary")


def expected_counts(seen, states):
    """The expected counts of all documents of ``seen`` and their log likelihood, summed over the tasks, in one row of numbers."""
    sent = seen.sparkSession.sparkContext.broadcast(states)

    def blobs(batch):
        return batch.column(0).to_pylist()

    def count(batches):
        total = None
        for held in gathered(batches, blobs, len, 2 * SWEPT):
            classes = np.frombuffer(b"".join(held), "<i2").astype(np.int64)
            own = counts_of(classes, np.array([len(b) // 2 for b in held]), sent.value)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            flat = np.concatenate([np.ravel(x) for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = seen.select("seen").mapInArrow(count, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    sent.unpersist()
    k = len(states.start)
    flat = np.zeros(k + k * k + k * CLASSES + 1)
    flat[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return flat


def parted(flat, k):
    """Starts, moves and emits of a row of expected counts, and the log likelihood."""
    return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, CLASSES), flat[-1]


def start_states(docs, classes):
    """States before the first pass: drawn around ``classes``, the counts over all training documents of ``docs``."""
    return first_states(classes)


def trained(docs, classes, tokens, passes=None):
    """The states after Baum-Welch over all training documents: ``passes`` times, or until the likelihood stops rising.

    The expectation is incremental: after each block its expected counts take the place of those it had before, and the
    states are estimated anew from the counts of all blocks. So a pass reads every document once, moves the states once a
    block, and needs no more passes on a larger corpus; at rest it is where whole passes rest. The likelihood of a pass
    is the sum over its blocks, each under the states it was counted with.
    """
    states = start_states(docs, classes)
    if passes == 0 or not tokens:
        return states
    folder = shared_folder(docs.sparkSession, "classes")
    classes_of_texts(docs).write.partitionBy("block").parquet(folder)
    seen = docs.sparkSession.read.schema("seen binary, block int").parquet(folder)
    counts, done, before = {}, 0, -np.inf
    while passes is None or done < passes:
        for block in range(BLOCKS):
            counts[block] = expected_counts(seen.where(F.col("block") == block), states)
            *parts, likely = parted(sum(counts.values()), len(states.start))
            states = reestimated(*parts, classes)
        done += 1
        if passes is None and likely - before < GAIN * tokens:
            break
        before = likely
    return states


def scored(docs, passes=None):
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Only documents that are not held out are learned from, all of them whole. Null texts count as empty: they hold the
    end alone. Unknown words share one place in their class, as in the base model in the vocabulary. Rows without an id
    are scored too; rows that repeat an id count and are scored each. Without training documents every word is unknown.
    Only doc_id and text are read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    told = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"held_out": is_held_out(F.col("doc_id")), "version": F.xxhash64("text"), "key": F.coalesce("doc_id", F.xxhash64("text"))}
    )
    parts = 4 * shuffle_partitions(spark)
    words = written(vocabulary(told, parts), "vocabulary")
    mass, seen, total, distinct = class_counts(words)
    known = most_frequent(spark, words)
    classes = (seen + 1) / (seen + 1).sum()
    states = trained(told, classes, total, passes)
    sent = spark.sparkContext.broadcast((known, states, np.log10(mass + 1.0)))

    def score(batches):
        (hashes, times), own, share = sent.value
        logs = np.log10(times + 1.0)
        for batch in batches:
            for lo, data, offsets in slices(batch.column(3)):
                rows = len(offsets) - 1
                found, classes_of, owner, stop = tokens_of(data, offsets)
                count = np.diff(stop, prepend=-1)
                at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
                hit = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
                likely = Sweep(classes_of, count).forward(own)[0] / LOG10
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, rows) for i in range(3)),
                        pa.array(count),
                        pa.array(np.bincount(owner, hit, rows).astype(np.int64)),
                        pa.array(np.bincount(owner[hit], logs[at[hit]], rows)),
                        pa.array(likely - np.bincount(owner, share[classes_of], rows)),
                    ],
                    ["doc_id", "key", "version", "n_tokens", "hits", "logs", "model"],
                )

    # repeated rows of one text add up below, so what they sum to is divided by how often they were told
    rare = rare_sums(told, words, known, parts).groupBy("doc_id", "version").agg(
        F.sum("logs").alias("rare_logs"), F.sum("found").alias("rare_found"), F.sum("tokens").alias("rare_tokens")
    ).withColumnRenamed("doc_id", "key")
    scores = told.select("doc_id", "key", "version", "text").mapInArrow(
        score, "doc_id long, key long, version long, n_tokens long, hits long, logs double, model double"
    )
    times = F.greatest(F.round(F.col("rare_tokens") / (F.col("n_tokens") - F.col("hits"))), F.lit(1))
    logs = F.col("logs") + F.coalesce(F.col("rare_logs") / times, F.lit(0.0))
    return scores.join(rare, ["key", "version"], "left").select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce(F.col("rare_found") / times, F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )


@CAT.add("op7_hmm")
def hmm(spark, sf):
    return scored(table(spark, sf, "documents"))
