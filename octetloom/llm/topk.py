"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are packed into blocks. A block keeps one list per component, sorted;
a query reads each list from its good end (the large values where its own
component is positive, the small ones where it is negative). After a read of
some depth every vector has bounds: components seen count as they are, the
others lie between the list's far end and the last value read. Vectors whose
upper bound is below the bar leave; reading goes on, each time twice as deep,
and whoever is left when the lists end has its exact score. The bar of a query
is the greater of the block's k-th lower bound and the k-th best score of the
blocks that the same task has read before, so that a block with nothing good
is left before its lists end. The bounds of many queries at once are matrix
products of the clipped lists. Best rows of each task are merged by query.

Vectors stay where they are: the queries, a hundredth of them, are packed and
sent to all tasks where their counted size allows it. Otherwise vector blocks
are dealt out once into groups, and every group gets each query block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octetloom.llm.common import materialised
from octetloom.session import spread

K = 10
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
#: Packed queries up to this size are broadcast; beyond it each group of vector blocks gets its copy by a shuffle.
BROADCAST_BYTES = 32 << 20
BLOCKS_PER_GROUP = 64
#: Queries whose running bars a task keeps, at most; what is dropped costs only reading.
BARS = 1 << 20
#: Share of a list that the first read takes.
FIRST_DEPTH = 1 / 8
#: Products and sums below this are exact as doubles.
EXACT = 2.0**53


def quantised(vector: list | None) -> np.ndarray | None:
    """floor(1024 * x) of each component as doubles, or None for a vector that takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return np.floor(1024 * v) if np.isfinite(v).all() else None


def no_random_access(rows: np.ndarray, queries: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows that may be among its k best, with exact scores: all that no bound excludes, ties included.

    ``own`` are pairs (query, row) that don't count, as arrays; ``bars`` are scores that a row of interest must reach.
    """
    n, d = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    low_end, high_end = rows.min(axis=0), rows.max(axis=0)
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(n)[:, None], axis=0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bars = np.full(len(queries), -np.inf) if bars is None else bars
    own_q, own_r = own if own is not None else (np.zeros(0, np.int64),) * 2
    live = [(np.arange(len(queries)), np.arange(n))]  # groups of queries with the rows that some of them still hold
    depth = max(k, int(n * FIRST_DEPTH))
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    q_at, r_at = np.full(len(queries), -1), np.full(n, -1)

    def without_own(scores: np.ndarray, qs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(own_q):
            q_at[qs], r_at[ids] = np.arange(len(qs)), np.arange(len(ids))
            q, r = q_at[own_q], r_at[own_r]
            there = (q >= 0) & (r >= 0)
            scores[q[there], r[there]] = -np.inf
            q_at[qs], r_at[ids] = -1, -1
        return scores

    while live:
        depth = min(depth, n)
        at = np.arange(d)
        top, bottom = rows[order[n - depth], at], rows[order[depth - 1], at]
        ahead = []
        for qs, ids in live:
            x, r = rows[ids], ranks[ids]
            from_top, from_bottom = r >= n - depth, r < depth
            upper = without_own(plus[qs] @ np.where(from_top, x, top).T + minus[qs] @ np.where(from_bottom, x, bottom).T, qs, ids)
            if depth == n:
                for q, scores in zip(qs, upper):
                    bar = max(bars[q], np.partition(scores, -k)[-k] if len(ids) > k else -np.inf)
                    keep = (scores >= bar) & (scores > -np.inf)
                    out[q] = (ids[keep], scores[keep])
                continue
            lower = without_own(plus[qs] @ np.where(from_top, x, low_end).T + minus[qs] @ np.where(from_bottom, x, high_end).T, qs, ids)
            bar = np.maximum(bars[qs], np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else -np.inf)
            held = (upper >= bar[:, None]) & (upper > -np.inf)
            open_ = held.any(axis=1)
            qs, held = qs[open_], held[open_]
            if not len(qs):
                continue
            some = held.any(axis=0)
            if some.sum() > len(ids) / 2 and len(qs) > 1:
                # Queries that exclude much go on by themselves, the others together.
                few = held.sum(axis=1) < len(ids) / 8
                ahead += [(qs[i : i + 1], ids[held[i]]) for i in np.flatnonzero(few)]
                if (~few).any():
                    ahead.append((qs[~few], ids[held[~few].any(axis=0)]))
            else:
                ahead.append((qs, ids[some]))
        if depth == n:
            break
        live, depth = ahead, depth * 2
    return out


def _exactly(rows: np.ndarray, queries: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray], bars: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
    """The same in whole numbers of any size, for components so large that doubles round; every list is read to its end."""
    out = []
    whole = [[int(x) for x in r] for r in rows]
    for i, q in enumerate(queries):
        q, mine = [int(x) for x in q], set(own[1][own[0] == i].tolist())
        scores = {j: sum(a * b for a, b in zip(q, r)) for j, r in enumerate(whole) if j not in mine}
        bar = sorted(scores.values())[-k] if len(scores) > k else min(scores.values(), default=0)
        ids = [j for j, s in scores.items() if s >= bar]
        out.append((np.array(ids, np.int64), [scores[j] for j in ids]))
    return out


def _narrow(m: np.ndarray) -> bytes:
    """A matrix of whole numbers in the smallest type that holds them: a letter, then the values."""
    most = float(np.abs(m).max(initial=0))
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"
    return kind.encode() + m.astype(kind).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, chr(blob[0]), offset=1).reshape(n, -1).astype(np.float64)


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, vectors = TaskContext.get().partitionId() << 24, [], []

        def block() -> pa.RecordBatch:
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([_narrow(m)], pa.binary())], ["block", "ids", "data"])

        for b in batches:
            for vec_id, vector in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = quantised(vector)
                if v is None or vec_id is None:
                    continue
                ids.append(vec_id)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield block()

    return run


def _pairs(ids: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, row) of one id, as arrays of positions."""
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], q_ids, "left"), np.searchsorted(ids[order], q_ids, "right")
    n = high - low
    q = np.repeat(np.arange(len(q_ids)), n)
    within = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
    return q, order[low[q] + within]


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}  # the k-th best score of a query so far
        for b in batches:
            for ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in b.columns)):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                rows, queries = _wide(data, len(ids)), _wide(q_data, len(q_ids))
                width = max(rows.shape[1], queries.shape[1])
                rows, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, queries))
                exact = width * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) < EXACT
                bars = np.array([best.get(q, -np.inf) for q in q_ids.tolist()])
                found = (no_random_access if exact else _exactly)(rows, queries, k, _pairs(ids, q_ids), bars)
                out = []
                for q, (at, scores) in zip(q_ids.tolist(), found):
                    top = sorted((-int(s), v) for s, v in zip(scores, ids[at].tolist()))[:k]
                    out += [(q, v, -s) for s, v in top]
                    if exact and len(top) == k and (q in best or len(best) < BARS):
                        best[q] = max(best.get(q, -np.inf), float(-top[-1][0]))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest integer inner products, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding. Components become
    floor(1024 * x); vectors that are null, or hold null or non-finite components,
    and rows without an id take no part; shorter vectors are filled with zeros. A
    query is not its own candidate: rows with its id are left out, however many
    there are. A repeated id among the queries is one query, its least vector; a
    repeated row among the vectors is a candidate each time. Queries with no
    candidate have no rows. A score beyond a long is an error. Other columns are
    ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    kind = "block long, ids binary, data binary"
    asked = materialised(asked.mapInArrow(_pack(BLOCK_QUERIES), kind).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))
    size = asked.agg(F.sum(F.length("q_ids") + F.length("q_data"))).first()[0] or 0
    rows = rows.mapInArrow(_pack(BLOCK_ROWS), kind)
    if size <= BROADCAST_BYTES:
        met = rows.withColumn("group", F.lit(0)).join(F.broadcast(asked.withColumn("group", F.lit(0))), "group")
    else:
        rows = materialised(rows)
        groups = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // BLOCKS_PER_GROUP)
        copies = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        met = rows.withColumn("group", F.pmod(F.hash("block"), F.lit(groups))).join(copies.hint("merge"), "group")
    found = met.select("ids", "data", "q_ids", "q_data").mapInArrow(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten best of all rows for every hundredth."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spread(rows), rows.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""
