"""Exact top-k by inner product with bounds from segment means and deviations.

For a segment of m components, q.x = m * mean_q * mean_x + centred part, and the centred part is
at most m * dev_q * dev_x (the segment distance is at least
m * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2); an inner product is half of
|q|^2 + |x|^2 - distance^2). Summed over segments this bounds every score, the closer the
shorter the segments.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

#: Segments of a vector, coarse to fine.
LEVELS = (1, 4, 16)
#: Vectors of a block; a task holds one block of queries and one of candidates.
QUERY_BLOCK = 1_024
CANDIDATE_BLOCK = 16_384


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations per segment, both times the root of the segment's length."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    means = np.stack([x[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
    devs = np.stack([x[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)
    return means, devs


def block_top_k(q_ids, q, c_ids, c, k: int, levels: Sequence[int] = LEVELS, step: int = 4_096):
    """``query, candidate, score`` of the best ``k`` candidates of each query within the block,
    ties to the smaller id, a query's own row left out."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    stats = [(segment_stats(q, s), segment_stats(c, s)) for s in levels]
    n = len(q)
    best = np.full((n, k), -np.inf)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    for at in range(0, len(c), step):
        rows = slice(at, at + step)
        own = q_ids[:, None] == c_ids[rows][None, :]
        alive = ~own
        floor = best[:, -1]
        if np.isfinite(floor).any():
            for (qm, qd), (cm, cd) in stats:  # coarse to fine, only what can still be among the k
                bound = qm @ cm[rows].T + qd @ cd[rows].T
                # A tie with the k-th score has a larger id here, so only more counts.
                alive &= bound * (1 + 1e-9) + 1e-6 > floor[:, None]
                if not alive.any():
                    break
        if not alive.any():
            continue
        live_q, live_c = alive.any(1), alive.any(0)
        exact = np.full(alive.shape, -np.inf)
        exact[np.ix_(live_q, live_c)] = q[live_q] @ c[rows][live_c].T
        exact[~alive] = -np.inf
        all_scores = np.concatenate([best, exact], 1)
        all_ids = np.concatenate([ids, np.broadcast_to(c_ids[rows], exact.shape)], 1)
        # Ids ascend from left to right among equal scores, so a stable sort breaks ties rightly.
        if all_scores.shape[1] > 4 * k:
            cut = np.partition(all_scores, all_scores.shape[1] - k, axis=1)[:, -k]
            for i in range(n):
                keep = np.flatnonzero(all_scores[i] >= cut[i])
                top = keep[np.argsort(-all_scores[i][keep], kind="stable")][:k]
                best[i, : len(top)], ids[i, : len(top)] = all_scores[i][top], all_ids[i][top]
        else:
            top = np.argsort(-all_scores, axis=1, kind="stable")[:, :k]
            best, ids = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
    real = np.isfinite(best)
    return np.broadcast_to(q_ids[:, None], best.shape)[real], ids[real], best[real].astype(np.int64)


def wide_top_k(q_ids, q, c_ids, c, k: int):
    """As :func:`block_top_k`, in 64-bit integers and without bounds, for scores that a double does not hold."""
    q, c = q.astype(np.int64), c.astype(np.int64)
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    found = []
    for q_id, v in zip(q_ids, q):
        rows = np.flatnonzero(c_ids != q_id)
        scores = c[rows] @ v
        top = np.argsort(-scores, kind="stable")[:k]
        found.append((np.full(len(top), q_id), c_ids[rows[top]], scores[top]))
    return tuple(np.concatenate(x) for x in zip(*found))


def widest_score(queries: DataFrame, candidates: DataFrame) -> int:
    """No score, and no part of its sum, is larger than this."""
    largest = F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0))
    (q,), (c, dim) = queries.agg(largest).first(), candidates.agg(largest, F.coalesce(F.max("dim"), F.lit(0))).first()
    return int(q) * int(c) * dim


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * component) of each vector. Vectors (and ids) that are null or
    hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad)
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` candidates of the highest inner
    product, fewer if there are fewer, ties to the smaller ``vec_id``.

    Both inputs are ``vec_id, v`` with whole-numbered components. Scores are exact: where doubles can't
    hold every sum (2^53), the blocks are multiplied in 64-bit integers; where these can't
    either, a ValueError says so. Every block of queries meets every block of candidates once,
    with equal dimensions; only ``k`` rows per query and block leave a task. A query's own id
    is no candidate. Of rows with one id each counts as a candidate; a query id that
    repeats is answered once. Empty inputs give an empty result.
    """
    q = queries.dropDuplicates(["vec_id"]).withColumn("dim", F.size("v"))
    c = candidates.withColumn("dim", F.size("v"))
    q, c = cut_lineage(q), cut_lineage(c)
    widest = widest_score(q, c)
    if widest >= 2**63:
        raise ValueError(f"scores may reach {widest}, beyond 64 bits")
    n_q, n_c = -(-q.count() // query_block) or 1, -(-c.count() // candidate_block) or 1
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)))
    # Blocks of candidates by a hash of id and vector, so that a repeated id is spread too.
    c = c.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_c)))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def search(left, right):
        import pyarrow as pa

        q_ids, c_ids = (t.column("vec_id").to_numpy() for t in (left, right))
        found = (np.zeros(0, np.int64),) * 3
        if len(q_ids) and len(c_ids):
            vectors = (np.stack(t.column("v").combine_chunks().to_numpy(zero_copy_only=False)) for t in (left, right))
            best = block_top_k if widest < 2**53 else wide_top_k
            found = best(q_ids, next(vectors), c_ids, next(vectors), k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})

    keys = ["qb", "cb", "dim"]
    pairs = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
