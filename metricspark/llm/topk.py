"""Exact top-k search by a three-phase uniform threshold.

The coordinates are cut into m groups, and a pair's local score in a group is its inner product
there; the score is the sum over the groups.

1. Every block of candidates gathers, for each query, the k best of each local list over its
   longest vectors (one in ``PROBE``), resolves those and reports the k best scores. The k-th best
   of all reports is a score that k candidates reach: a safe cutoff, whichever vectors were asked.
2. The cutoff goes back to the queries. A candidate that reaches it must reach a part of 1 / m of
   it in at least one group, or the sum could not. Blocks score one group after another and collect
   the pairs with such an entry; a pair whose sum so far and the lengths of its missing parts cannot
   reach the cutoff is left out of all later groups.
3. The groups still missing are scored for the pairs that are left alone, and what reaches the
   cutoff is ranked.

Vectors are whole numbers, so all scores are exact; bounds are rounded up. Queries meet candidates
block by block: candidates are dealt over folds, and every fold takes in a copy of the queries, by
shuffles only. A task reports the k best it has found for a query, not those of every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import column, partitions, stored

SCALE = 1024
GROUPS = 8
#: One in so many candidates of a block, the longest ones, is asked for the cutoff.
PROBE = 16
#: Below this share of open pairs a group is scored pair by pair instead of as a matrix product.
SPARSE = 0.125
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 256
#: So many blocks of queries meet a fold at once; more make groups, which each see all candidates.
QUERY_GROUP = 64
#: Found pairs that a task holds before it cuts them to the best of each query.
HELD = 1 << 20

NO_CUTOFF = -(1 << 62)

_BLOCK = pa.schema([("ids", pa.binary()), ("cutoffs", pa.binary()), ("rows", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
_BLOCK_DDL = "ids binary, cutoffs binary, rows int, width int, data binary"


def _whole_vectors(col: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors as rows of whole numbers, padded with zeros."""
    lengths = np.array(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), lengths)
    ok = np.array(col.is_valid().to_numpy(zero_copy_only=False))
    ok[row[~np.isfinite(flat)]] = False
    width = int(lengths.max(initial=0))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = np.zeros((len(col), width), np.int64)
    good = ok[row]
    whole[row[good], place[good]] = np.floor(scale * flat[good]).astype(np.int64)
    return ok, whole[ok]


def _pack(scale: int, most: int):
    """(vec_id, vector, cutoff) to blocks of at most ``most`` rows, the longest vectors first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ok, whole = _whole_vectors(part.column(1), scale)
                if not len(whole):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)[ok]
                cutoffs = part.column(2).fill_null(NO_CUTOFF).to_numpy(zero_copy_only=False)[ok]
                order = np.argsort(-(whole.astype(np.float64) ** 2).sum(axis=1), kind="stable")
                ids, cutoffs, whole = ids[order], cutoffs[order], whole[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], f.type) for x, f in zip((ids.astype(np.int64).tobytes(), cutoffs.astype(np.int64).tobytes(), len(whole), whole.shape[1], _narrow(whole).tobytes()), _BLOCK)],
                    schema=_BLOCK)
    return run


def _narrow(whole: np.ndarray) -> np.ndarray:
    """The same numbers in the shortest type of 2, 4 or 8 bytes that holds them."""
    low, high = int(whole.min(initial=0)), int(whole.max(initial=0))
    return whole.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, width, data = row[side + "rows"], row[side + "width"], row[side + "data"]
    size = len(data) // (rows * width) if width else 8
    whole = np.frombuffer(data, f"i{size}").reshape(rows, width).astype(np.int64)
    return np.frombuffer(row[side + "ids"], np.int64), np.frombuffer(row[side + "cutoffs"], np.int64), whole


def _exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """Doubles, as long as they hold every partial sum exactly."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64


def _cuts(width: int, groups: int) -> list[tuple[int, int]]:
    ends = [width * g // groups for g in range(groups + 1)]
    return [(a, b) for a, b in zip(ends, ends[1:]) if b > a]


def _local_scores(q: np.ndarray, c: np.ndarray, groups: int) -> list[np.ndarray]:
    """The inner products in each group of coordinates, exact."""
    width = min(q.shape[1], c.shape[1])  # a missing coordinate is 0
    q, c = q[:, :width], c[:, :width]
    kind = _exact_type(q, c)
    q, c = q.astype(kind), c.astype(kind)
    return [(q[:, a:b] @ c[:, a:b].T).astype(np.int64) for a, b in _cuts(width, groups)] or [np.zeros((len(q), len(c)), np.int64)]


def _lengths_left(x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """For each group the length of what lies behind it in every vector, rounded up."""
    squares = x.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[:, b:].sum(axis=1)) for _, b in cuts]) * (1 + 1e-9)


def _resolve(q: np.ndarray, c: np.ndarray, cutoffs: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query place, candidate place and score of all pairs that reach the query's cutoff, and the multiplications it took."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    kind = _exact_type(q, c)
    q, c = q.astype(kind), c.astype(kind)
    cuts = _cuts(width, groups)
    least = cutoffs.astype(np.float64)
    least -= np.abs(least) * 1e-12
    if not cuts:
        i, j = np.nonzero(np.repeat(cutoffs[:, None] <= 0, len(c), axis=1))
        return i, j, np.zeros(len(i), np.int64), 0
    q_left, c_left = _lengths_left(q, cuts), _lengths_left(c, cuts)
    share = -(-cutoffs // len(cuts))  # whole scores: at least the part, rounded up
    total, listed, work = np.zeros((len(q), len(c)), kind), np.zeros((len(q), len(c)), bool), 0
    i = j = None  # the open pairs, once they are few
    for g, (a, b) in enumerate(cuts):
        last = g + 1 == len(cuts)
        if i is None:
            local = q[:, a:b] @ c[:, a:b].T
            total += local
            listed |= local >= share[:, None]
            work += local.size * (b - a)
            if last:
                i, j = np.nonzero(listed & (total >= cutoffs[:, None]))
                return i, j, total[i, j].astype(np.int64), work
            open_ = total + np.outer(q_left[g], c_left[g]) >= least[:, None]
            work += open_.size
            if open_.mean() < SPARSE:
                i, j = np.nonzero(open_)
                total, listed = total[i, j], listed[i, j]
        else:
            local = np.einsum("ij,ij->i", q[i, a:b], c[j, a:b])
            total = total + local
            listed = listed | (local >= share[i])
            work += len(i) * (b - a)
            if last:
                keep = listed & (total >= cutoffs[i])
            else:
                keep = total + q_left[g][i] * c_left[g][j] >= least[i]
                work += len(i)
            i, j, total, listed = i[keep], j[keep], total[keep], listed[keep]
    return i, j, total.astype(np.int64), work


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of different ids, ties to smaller ids."""
    order = np.lexsort((ids, -scores))
    first = np.unique(ids[order], return_index=True)[1]
    return order[np.sort(first)[:k]]


def _gather(k: int, groups: int):
    """Phase 1: the best of every local list over the longest vectors of a block, resolved."""
    def found(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        qids, _, q = _unpack(row, "q_")
        cids, _, c = _unpack(row, "c_")
        asked = -(-len(cids) // PROBE)
        cids, c = cids[:asked], c[:asked]
        local = _local_scores(q, c, groups)
        total = sum(local)
        for at_q, qid in enumerate(qids):
            at = np.unique(np.concatenate([np.argpartition(-s[at_q], min(k, asked - 1))[:k + 1] for s in local]))
            at = at[cids[at] != qid]
            at = at[_best(total[at_q, at], cids[at], k)]
            yield int(qid), cids[at], total[at_q, at]
    return _rows(found, k)


def _collect(k: int, groups: int):
    """Phases 2 and 3: the pairs of a block that reach the cutoff, at most k of a query."""
    def found(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        qids, cutoffs, q = _unpack(row, "q_")
        cids, _, c = _unpack(row, "c_")
        i, j, score, _ = _resolve(q, c, cutoffs, groups)
        other = cids[j] != qids[i]
        i, j, score = i[other], j[other], score[other]
        ends = np.searchsorted(i, np.arange(len(qids) + 1))
        order = np.argsort(i, kind="stable")
        for at_q, qid in enumerate(qids):
            at = order[ends[at_q]:ends[at_q + 1]]
            at = at[_best(score[at], cids[j[at]], k)]
            yield int(qid), cids[j[at]], score[at]
    return _rows(found, k)


def _k_best(found: np.ndarray, k: int) -> np.ndarray:
    """The columns (query, vector, score) of the k best vectors of every query, each vector once."""
    found = found[:, np.lexsort((-found[2], found[1], found[0]))]
    again = (found[0, 1:] == found[0, :-1]) & (found[1, 1:] == found[1, :-1])
    found = found[:, np.concatenate([np.ones(min(1, found.shape[1]), bool), ~again])]
    found = found[:, np.lexsort((found[1], -found[2], found[0]))]
    first = np.searchsorted(found[0], found[0])
    return found[:, np.arange(found.shape[1]) - first < k]


def _rows(found, k: int):
    """The pairs that ``found`` gives for the rows of a task, cut to the k best of each query."""
    def batch(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.empty((3, 0), np.int64)], 0
        for rows in batches:
            for row in rows.to_pylist():
                for qid, ids, scores in found(row):
                    held.append(np.stack([np.full(len(ids), qid, np.int64), ids, scores.astype(np.int64)]))
                    n += len(ids)
                if n > HELD:
                    best = _k_best(np.concatenate(held, axis=1), k)
                    held, n = [best], best.shape[1]
                    if n > HELD // 2:  # so many queries: what they have so far goes out
                        yield batch(best)
                        held, n = [np.empty((3, 0), np.int64)], 0
        yield batch(_k_best(np.concatenate(held, axis=1), k))
    return run


def _meet(queries: DataFrame, candidates: DataFrame, fold: int, groups: int) -> DataFrame:
    """Every block of queries next to every block of candidates, which are dealt over folds.

    Queries are copied once per fold and candidates once per group of queries. Copies are made by a generator,
    which no estimate of sizes sees, so the sides are never broadcast; a number of partitions keeps folds that
    are small on input from being put together again.
    """
    at = ["fold", "group"]

    def dealt(blocks: DataFrame, side: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return blocks.select(
            *[F.col(c).alias(side + c) for c in blocks.columns], F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).repartition(fold * groups, *at)

    q = dealt(queries, "q_", "group", groups, "fold", fold)
    return dealt(candidates, "c_", "fold", fold, "group", groups).join(q.hint("merge"), at).drop(*at)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query, all if there are fewer.

    A vector's components become floor(scale * x). Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part. Shorter vectors count as padded with zeros.
    Rows with the query's own id are not its candidates. Ids that occur more than once, with equal or
    other vectors, count once: their score is the best of any of their vectors with any of the query's. Ties go to the smaller id. An empty table,
    or one without queries, gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vector_col).alias("vector"), is_query.alias("asks")
    ).filter("vec_id IS NOT NULL")
    none = F.lit(None).cast("long").alias("cutoff")
    candidates = stored(rows.select("vec_id", "vector", none).mapInArrow(_pack(scale, CANDIDATE_BLOCK), _BLOCK_DDL))
    asking = stored(rows.filter("asks").select("vec_id", "vector").distinct())
    parts = max(1, -(-asking.count() // QUERY_BLOCK))
    n_blocks = candidates.count()
    # Every fold reports k pairs a query: several blocks a fold, once there are enough folds for all cores.
    fold = max(1, min(partitions(spark), max(-(-n_blocks // 4), min(n_blocks, 4 * spark.sparkContext.defaultParallelism))))
    together = -(-parts // QUERY_GROUP)

    def blocks(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "vector", "cutoff").repartition(parts).mapInArrow(_pack(scale, QUERY_BLOCK), _BLOCK_DDL)

    schema = "query_id long, vec_id long, score long"
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order))

    gathered = _meet(blocks(asking.select("vec_id", "vector", none)), candidates, fold, together).mapInArrow(_gather(k, groups), schema)
    cutoffs = stored(ranked(gathered).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff")))
    found = _meet(blocks(asking.join(cutoffs, "vec_id", "left")), candidates, fold, together).mapInArrow(_collect(k, groups), schema)
    return ranked(found).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
