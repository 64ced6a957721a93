"""Exact nearest neighbours and Hamming profiles over blocks of vectors.

Queries and archive are cut into blocks; a task compares one query block with
one archive block as dense matrices and emits only its k best rows or its
distance counts, never the pairs. A query side of proven small size is
broadcast and the archive is scanned in place without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import range_bucket

#: Rows of the blocks that meet in one task: the more, the fewer copies are shuffled. A profile that tells all places has small ones.
QUERY_BLOCK, ARCHIVE_BLOCK = 16384, 65536
PROFILE_QUERIES, SMALL_QUERIES, SMALL_ARCHIVE = 2048, 1024, 8192
#: Archive blocks at least, as far as they are not smaller than the small ones; rows of a result and distances held at once.
BLOCKS, BEST_ROWS, DISTANCES = 32, 1 << 20, 1 << 20
#: Query blocks at least, as far as they are not smaller than the small ones.
FEW_BLOCKS = 8
BROADCAST_BYTES = 32 * 1024 * 1024


def _matrix(column, rows):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _distances(q, a, metric, decimals):
    if metric == "hamming":
        return 0.5 * (q.shape[1] - q @ a.T)
    d = (q * q).sum(1)[:, None] + (a * a).sum(1)[None, :] - 2.0 * (q @ a.T)
    return np.round(np.maximum(d, 0.0), decimals)


def _block_best(qid, q, aid, a, k, metric, decimals):
    """Row-wise k smallest distances of one block pair, ties by archive id."""
    few = max(1, DISTANCES // max(1, len(aid)))
    if len(qid) > few:
        parts = [_block_best(qid[i : i + few], q[i : i + few], aid, a, k, metric, decimals) for i in range(0, len(qid), few)]
        return tuple(np.concatenate(c) for c in zip(*parts))
    d = _distances(q, a, metric, decimals)
    k = min(k, d.shape[1])
    kth = np.partition(d, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero(d <= kth[:, None])
    dist = d[rows, cols]
    order = np.lexsort((aid[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, np.arange(len(qid)))
    keep = np.arange(len(rows)) - first[rows] < k
    return qid[rows[keep]], aid[cols[keep]], dist[keep]


def _merge_best(old, new, k):
    """k best per query of two result triples, ties by archive id."""
    qid, aid, dist = (np.concatenate(c) for c in zip(old, new))
    order = np.lexsort((aid, dist, qid))
    qid, aid, dist = qid[order], aid[order], dist[order]
    starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]]) if len(qid) else np.array([], int)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(qid)]))
    keep = np.arange(len(qid)) - starts[group] < k
    return qid[keep], aid[keep], dist[keep]


BEST = pa.schema([("grp", pa.string()), ("qid", pa.int64()), ("aid", pa.int64()), ("dist", pa.float64())])


def _best_columns(grp, parts):
    qid, aid, dist = parts
    return [pa.repeat(pa.scalar(grp, pa.string()), len(qid)), pa.array(qid, pa.int64()), pa.array(aid, pa.int64()), pa.array(dist, pa.float64())]


def _keep_best(found, k):
    best = Window.partitionBy("grp", "qid").orderBy("dist", "aid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _vectors(df, id_col, *more, metric="l2"):
    grp = F.col("grp") if "grp" in df.columns else F.lit("")
    return df.select(
        grp.alias("grp"), F.col(id_col).cast("bigint").alias(id_col), F.col("vec").cast("array<tinyint>" if metric == "hamming" else "array<double>").alias("vec"), *more
    )


def nearest(
    queries: DataFrame,
    archive: DataFrame,
    k,
    metric="l2",
    decimals=6,
    query_block=QUERY_BLOCK,
    archive_block=ARCHIVE_BLOCK,
    broadcast_bytes=BROADCAST_BYTES,
) -> DataFrame:
    """The k nearest archive rows of every query: ``(qid, aid, dist, rank)``.

    Inputs are ``(qid BIGINT, vec)`` and ``(aid BIGINT, vec)``; with a ``grp`` column on both
    sides rows of one group meet each other only and the result carries it. ``l2`` gives
    squared distances, ``hamming`` takes codes of -1/0/1. Ties go to the lower id.
    """
    q, a = _vectors(queries, "qid", metric=metric), _vectors(archive, "aid", metric=metric)
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    # vectors plus the running result of every query have to fit the limit
    if size["n"] * ((size["dim"] or 0) + 1 + 3 * k) * 8 <= broadcast_bytes:
        found = _scan_archive(q, a, k, metric, decimals, query_block)
    else:
        found = _join_blocks(q, a, k, metric, decimals, size["n"], query_block, archive_block)
    best = _keep_best(found, k)
    return best if "grp" in queries.columns else best.drop("grp")


def _scan_archive(q, a, k, metric, decimals, query_block):
    """Queries of proven small size go to every task; the archive is read in place."""
    rows = q.toArrow()
    groups = {}
    for grp in set(rows.column("grp").to_pylist()):
        part = rows.filter(pa.compute.equal(rows.column("grp"), grp))
        groups[grp] = (part.column("qid").to_numpy(), _matrix(part.column("vec"), part.num_rows))
    shared = q.sparkSession.sparkContext.broadcast(groups)

    def scan(batches):
        best = {}
        for batch in batches:
            names = np.asarray(batch.column("grp").to_pylist(), object)
            for grp in set(names):
                if grp not in shared.value:
                    continue
                qid, qm = shared.value[grp]
                part = batch.take(pa.array(np.flatnonzero(names == grp)))
                am, aid = _matrix(part.column("vec"), part.num_rows), part.column("aid").to_numpy()
                for lo in range(0, len(qid), query_block):
                    new = _block_best(qid[lo : lo + query_block], qm[lo : lo + query_block], aid, am, k, metric, decimals)
                    best[grp, lo] = _merge_best(best[grp, lo], new, k) if (grp, lo) in best else new
        for (grp, _), parts in best.items():
            yield pa.RecordBatch.from_arrays(_best_columns(grp, parts), schema=BEST)

    return a.mapInArrow(scan, "grp string, qid bigint, aid bigint, dist double")


def _block_count(rows, block):
    """Blocks of at most ``block`` rows; more of them where that only makes them less than large."""
    return max(1, math.ceil(rows / max(min(block, SMALL_ARCHIVE), min(block, math.ceil(rows / BLOCKS)))))


def _query_blocks(rows, block, small):
    """Blocks of at most ``block`` queries; a few small ones where the queries fill less."""
    return max(1, math.ceil(rows / block), min(FEW_BLOCKS, math.ceil(rows / min(block, small))))


def _join_blocks(q, a, k, metric, decimals, n_queries, query_block, archive_block):
    """Every query block meets every archive block of its group in one bounded task."""
    q_blocks = _query_blocks(n_queries, max(1, min(query_block, BEST_ROWS // k)), SMALL_QUERIES)
    a_blocks = _block_count(a.count(), archive_block)
    q_cells = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks))).withColumn(
        "ab", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1)).cast("array<bigint>"))
    )
    a_cells = a.withColumn("ab", F.pmod(F.xxhash64("aid"), F.lit(a_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>"))
    )

    def cell(left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return BEST.empty_table()
        best = _block_best(
            left.column("qid").to_numpy(),
            _matrix(left.column("vec"), left.num_rows),
            right.column("aid").to_numpy(),
            _matrix(right.column("vec"), right.num_rows),
            k,
            metric,
            decimals,
        )
        return pa.Table.from_arrays(_best_columns(left.column("grp")[0].as_py(), best), schema=BEST)

    keys = ("grp", "qb", "ab")
    return q_cells.groupBy(*keys).cogroup(a_cells.groupBy(*keys)).applyInArrow(cell, "grp string, qid bigint, aid bigint, dist double")


PROFILE_SCHEMA = (
    "grp string, qid bigint, ab int, dist int, n_all bigint, n_rel bigint, rel_pos array<int>"
)


def _profile_cell(left, right, keep):
    """Counts per (query, distance) of one block pair, and where its relevant rows stand."""
    empty = {n: [] for n in ("grp", "qid", "ab", "dist", "n_all", "n_rel", "rel_pos")}
    if left.num_rows == 0 or right.num_rows == 0:
        return empty
    aid = right.column("aid").to_numpy()
    order = np.argsort(aid, kind="stable")
    right = right.take(pa.array(order))
    qm, am = _matrix(left.column("vec"), left.num_rows), _matrix(right.column("vec"), right.num_rows)
    bits = qm.shape[1]
    q_lab, a_lab = left.column("labels").combine_chunks(), right.column("labels").combine_chunks()
    names = np.unique(np.concatenate([q_lab.flatten().to_numpy(), a_lab.flatten().to_numpy()]))

    def hot(lists):
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        out = np.zeros((len(lengths), max(1, len(names))))
        values = lists.flatten().to_numpy()
        out[np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(names, values)] = 1.0
        return out

    q_hot, a_hot = hot(q_lab), hot(a_lab)
    few = max(1, DISTANCES // len(am))
    grp, qid = left.column("grp").to_pylist(), left.column("qid").to_numpy()
    block = right.column("ab")[0].as_py()
    out = empty
    for i in range(len(qid)):
        if i % few == 0:
            dist = np.rint(_distances(qm[i : i + few], am, "hamming", 0)).astype(np.int16)
            relevant = q_hot[i : i + few] @ a_hot.T > 0
        by_dist = np.argsort(dist[i % few], kind="stable")
        d, rel = dist[i % few][by_dist], relevant[i % few][by_dist]
        counts = np.bincount(d, minlength=bits + 1)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        taken = 0
        for value in np.nonzero(counts)[0]:
            hits = np.nonzero(rel[starts[value] : starts[value] + counts[value]])[0] + 1
            places = hits if keep is None else hits[: max(0, keep - taken)]
            taken += len(hits)
            out["grp"].append(grp[i])
            out["qid"].append(int(qid[i]))
            out["ab"].append(block)
            out["dist"].append(int(value))
            out["n_all"].append(int(counts[value]))
            out["n_rel"].append(len(hits))
            out["rel_pos"].append(places.tolist())
    return out


def hamming_profile(
    queries: DataFrame, archive: DataFrame, keep=None, query_block=None, archive_block=None
) -> DataFrame:
    """How many archive rows, and how many relevant ones, lie at each Hamming distance.

    Inputs are ``(grp, qid|aid, vec, labels ARRAY<INT>)``; rows of one ``grp`` meet
    each other only. Archive blocks are id ranges, so ``(dist, ab)`` orders ties by id
    and ``rel_pos`` holds the in-class places of relevant rows (the first ``keep`` of a
    block when given, none for 0). Relevant means at least one shared label.
    """
    query_block = query_block or (SMALL_QUERIES if keep is None else PROFILE_QUERIES)
    archive_block = archive_block or (SMALL_ARCHIVE if keep is None else ARCHIVE_BLOCK)
    labels = F.col("labels").cast("array<int>").alias("labels")
    q, a = _vectors(queries, "qid", labels, metric="hamming"), _vectors(archive, "aid", labels, metric="hamming")
    q_blocks = _query_blocks(q.count(), query_block, SMALL_QUERIES // 4)
    a_blocks = _block_count(a.count(), archive_block)
    ranged = range_bucket(a, "aid", a_blocks, name="ab")
    q_cells = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int")).withColumn(
        "ab", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1)))
    )
    a_cells = ranged.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    keys = ("grp", "qb", "ab")
    arrow_schema = pa.schema(
        [
            ("grp", pa.string()),
            ("qid", pa.int64()),
            ("ab", pa.int32()),
            ("dist", pa.int32()),
            ("n_all", pa.int64()),
            ("n_rel", pa.int64()),
            ("rel_pos", pa.list_(pa.int32())),
        ]
    )

    def cell(left, right):
        return pa.table(_profile_cell(left, right, keep), schema=arrow_schema)

    return q_cells.groupBy(*keys).cogroup(a_cells.groupBy(*keys)).applyInArrow(cell, PROFILE_SCHEMA)
