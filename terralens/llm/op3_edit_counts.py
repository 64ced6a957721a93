"""Token counts that follow edits: only what an edit touches is encoded again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terralens.plans.common import Catalogue, table

from .shared import bounded_batches, shuffle_partitions
from .text import slices
from .tokens import default_vocabulary, encoder, segments

CAT = Catalogue()

#: Edits of a document in the query, at most, and characters that one of them deletes and inserts, at most.
EDITS, DELETED, INSERTED = 4, 24, 24


class CountTree:
    """The segments of one text as leaves of a binary tree that knows the characters and tokens of every subtree."""

    def __init__(self, raw, starts, ends, chars, tokens, own):
        self.raw, self.starts, self.ends, self.encoder = raw, starts, ends, own
        self.leaves = max(1, len(starts))
        self.base = 1 << (self.leaves - 1).bit_length()
        self.chars, self.tokens = (self._sums(x) for x in (chars, tokens))
        self.changed: dict[int, bytes] = {}
        self.encoded = 0

    def _sums(self, values):
        level = np.zeros(self.base, np.int64)
        level[: len(values)] = values
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(1)
            levels.append(level)
        return np.concatenate([[0], *levels[::-1]]).tolist()

    def total(self):
        return self.tokens[1]

    def leaf_bytes(self, i):
        if i in self.changed:
            return self.changed[i]
        return self.raw[self.starts[i] : self.ends[i]] if i < len(self.starts) else b""

    def leaf_at(self, position):
        """The leaf that holds the character at ``position``, and the place of the character in it."""
        node = 1
        while node < self.base:
            node *= 2
            if position >= self.chars[node]:
                position -= self.chars[node]
                node += 1
        return node - self.base, position

    def _beside(self, leaf, step):
        """The next leaf in that direction that is not empty, or the outermost."""
        while 0 <= leaf + step < self.leaves:
            leaf += step
            if self.chars[self.base + leaf]:
                break
        return leaf

    def _put(self, leaf, text, chars, tokens):
        self.changed[leaf] = text
        node = self.base + leaf
        more, extra = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += extra
            node //= 2

    def edit(self, position, deleted, inserted):
        """Deletes characters from ``position`` on and puts ``inserted`` there; places beyond the end mean the end."""
        length = self.chars[1]
        position = min(max(position, 0), length)
        deleted = min(max(deleted, 0), length - position)
        first, within = self.leaf_at(position) if position < length else (self.leaves - 1, None)
        last = self.leaf_at(position + deleted - 1)[0] if deleted else first
        if position >= length and not self.chars[self.base + first]:
            first = last = self._beside(first, -1)
        # one segment on either side decides whether the cut beside it stays
        lo, hi = self._beside(first, -1), self._beside(last, 1)
        # a segment that only runs into the next one since an edit is taken along
        before = sum(self.chars[self.base + i] for i in range(lo, first))
        text = b"".join(self.leaf_bytes(i) for i in range(lo, hi + 1)).decode("utf-8", "replace")
        at = before + (within if within is not None else self.chars[self.base + first])
        text = text[:at] + inserted + text[at + deleted :]
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = segments(data, np.array([0, len(raw)]))
        parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        self.encoded += len(parts)
        room = hi - lo + 1
        if len(parts) > room:
            parts = [*parts[: room - 1], b"".join(parts[room - 1 :])]
        parts += [b""] * (room - len(parts))
        for leaf, part in zip(range(lo, hi + 1), parts):
            told = part.decode("utf-8", "replace")
            self._put(leaf, part, len(told), self.encoder.count(told))


def trees(column, path):
    """A tree for each row's text; all texts of a slice are encoded together."""
    own = encoder(path)
    for _, data, offsets in slices(column):
        starts, ends, row, counts = own.segment_counts(data, offsets)
        sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = sums[ends] - sums[starts]
        at = np.searchsorted(row, np.arange(len(offsets)))
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            own_rows = slice(at[i], at[i + 1])
            yield CountTree(raw, starts[own_rows], ends[own_rows], chars[own_rows], counts[own_rows], own)


def recount(docs, edits, path=None, text="text"):
    """Per row of ``docs``: doc_id, tokens_before, n_edits, tokens_after, segments and segments_encoded.

    ``edits`` holds doc_id, seq, position, deleted and inserted; a document's edits apply in the order of ``seq`` (ties by
    their values), positions and lengths count characters of the text as it stands by then, and places outside it mean
    its ends. A null text is empty, a null number is 0 and a null insertion inserts nothing. Edits without a document
    are passed over; rows that repeat a doc_id get its edits each; rows without an id get none. segments_encoded is how
    many segments the edits made the encoder look at again. A document's rows are sorted together, its text first, and
    its edits stream past the tree, so a task holds one tree at a time. Only the named columns are read.
    """
    bounded_batches(docs.sparkSession)
    path = path or default_vocabulary()
    kind = "doc_id long, seq long, position long, deleted long, inserted string, text string"
    none = {c: F.lit(None).cast(t) for c, t in (x.split() for x in kind.split(", "))}
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    bare = told.where("doc_id IS NULL")
    lone = bare.select("doc_id", *(none[c].alias(c) for c in ("seq", "position", "deleted", "inserted")), "text")
    rows = told.where("doc_id IS NOT NULL").select("doc_id", *(none[c].alias(c) for c in ("seq", "position", "deleted", "inserted")), "text")
    moves = edits.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("seq", "position", "deleted")),
        F.coalesce("inserted", F.lit("")).alias("inserted"), none["text"].alias("text"),
    )

    def count(batches):
        doc, held, begun = None, [], None
        for batch in batches:
            own = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            made = trees(batch.column(5).filter(pa.array(~own)), path)
            names, _, position, deleted, inserted, _ = (c.to_pylist() for c in batch.columns[:5] + [batch.column(0)])
            out = []
            for i, is_edit in enumerate(own.tolist()):
                if is_edit:
                    if names[i] == doc:
                        for entry in held:
                            entry[1].edit(position[i], deleted[i], inserted[i])
                            entry[3] += 1
                    continue
                if names[i] != doc or doc is None:
                    out += [told_of(e) for e in held]
                    doc, held = names[i], []
                tree = next(made)
                held.append([names[i], tree, tree.total(), 0])
            yield result(out)
        yield result([told_of(e) for e in held])

    def told_of(entry):
        name, tree, before, n = entry
        return name, before, n, tree.total(), len(tree.starts), tree.encoded

    def result(rows):
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return (
        rows.unionByName(lone)
        .unionByName(moves)
        .repartition(shuffle_partitions(docs.sparkSession), F.coalesce("doc_id", F.xxhash64("text")))
        .sortWithinPartitions("doc_id", F.col("text").isNull(), "seq", "position", "deleted", "inserted")
        .mapInArrow(count, ", ".join(f"{n} long" for n in NAMES))
    )


NAMES = ["doc_id", "tokens_before", "n_edits", "tokens_after", "segments", "segments_encoded"]


def own_edits(docs, edits=EDITS, deleted=DELETED, inserted=INSERTED, text="text"):
    """Up to ``edits`` edits of each document, by hashes of its id: at some place some characters go, and characters from
    another place of the same text come in."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    draw = [F.pmod(F.xxhash64("doc_id", "seq", F.lit(k)), F.lit(1 << 30)) for k in range(4)]
    return (
        docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), size.alias("size"))
        .withColumn("seq", F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("doc_id"), F.lit(edits)).cast("int"))))
        .select(
            "doc_id",
            F.col("seq").cast("long"),
            (draw[0] % (F.col("size") + 1)).alias("position"),
            (draw[1] % (deleted + 1)).alias("deleted"),
            F.substring("text", (draw[2] % (F.col("size") + 1) + 1).cast("int"), (draw[3] % (inserted + 1)).cast("int")).alias("inserted"),
        )
    )


@CAT.add("op3_edit_counts")
def edit_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return recount(docs, own_edits(docs))
