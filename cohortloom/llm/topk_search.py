"""Exact top-k search by no-random-access aggregation.

Each dimension is a list of the candidates sorted by component; a query reads it from the end
that its own component prefers. After the first t entries of every list, a candidate's score
lies between the sum of what was seen plus the worst that the unseen lists hold, and the same
sum plus what stands at the reading positions. Reading goes on, twice as deep each time, until
few candidates have an upper bound that reaches the k-th lower bound; these get final scores.

The bounds of all queries of a block against all candidates of an Arrow batch are matrix
products, as which entries were seen depends on the depth and the query's sign only. Queries
come in blocks of a bounded size, each broadcast; every candidate meets every query.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

QUERY_BLOCK = 2048  # queries broadcast at a time, on average
FEW = 8  # times k: so many candidates are resolved rather than read further


def _survivors(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
    """(query, candidate) numbers that may belong to the k best of each query, ties included."""
    n, d = x.shape
    m = len(q)
    if n <= k or not d:
        return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    ends = np.take_along_axis(x, order, 0)
    low, high = ends[0], ends[-1]
    open_q = np.arange(m)
    out_q, out_c = [], []
    depth = max(k, n // 32)
    while len(open_q):
        depth = min(depth, n)
        top, bottom = rank >= n - depth, rank < depth
        a, b = up[open_q], down[open_q]
        seen = (x * top) @ a.T + (x * bottom) @ b.T
        worst = (~top * low) @ a.T + (~bottom * high) @ b.T
        best = (~top * ends[n - depth]) @ a.T + (~bottom * ends[depth - 1]) @ b.T
        lower, upper = seen + worst, seen + best
        mine = own[:, None] == np.arange(n)[None, :]
        hidden = mine[open_q].T
        lower[hidden], upper[hidden] = -np.inf, -np.inf
        kth = np.maximum(np.partition(lower, n - k, axis=0)[n - k], floor[open_q])
        alive = upper >= kth
        alive[hidden] = False
        done = (alive.sum(0) <= FEW * k) | (depth == n)
        c, j = np.nonzero(alive[:, done])
        out_q.append(open_q[done][j])
        out_c.append(c)
        open_q = open_q[~done]
        depth *= 4
    return np.concatenate(out_q), np.concatenate(out_c)


def _best(query, score, vec, k):
    """Of the rows, the k best of each query, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, score, vec = query[order], score[order], vec[order]
    fresh = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    keep = place < k
    return query[keep], score[keep], vec[keep]


def _search(shared, k: int):
    def run(batches):
        blocks = shared.value  # dimension -> (row ids, integer components)
        best = {d: (np.zeros(0, np.int64),) * 3 for d in blocks}
        floors = {d: np.full(len(ids), -np.inf) for d, (ids, _) in blocks.items()}
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy()
            values = lists.flatten().to_numpy()
            first = np.cumsum(sizes) - sizes
            uid, vec = batch.column("uid").to_numpy(), batch.column("vec").to_numpy()
            for d, (ids, q) in blocks.items():
                rows = np.flatnonzero(sizes == d)
                if not len(rows):
                    continue
                x = values[first[rows][:, None] + np.arange(d)[None, :]] if d else np.zeros((len(rows), 0), np.int64)
                where = {u: i for i, u in enumerate(uid[rows].tolist())}
                own = np.array([where.get(u, -1) for u in ids.tolist()])
                bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1)
                if bound < 2**50:  # sums of doubles are exact
                    j, c = _survivors(x.astype(np.float64), q.astype(np.float64), own, k, floors[d])
                else:
                    j, c = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
                other = own[j] != c
                j, c = j[other], c[other]
                score = np.concatenate([np.einsum("ij,ij->i", q[j[s : s + 65536]], x[c[s : s + 65536]]) for s in range(0, len(j), 65536)] or [np.zeros(0, np.int64)])
                best[d] = _best(*(np.concatenate(p) for p in zip(best[d], (j, score, vec[rows][c]))), k)
                query, got, _ = best[d]
                full = np.flatnonzero(np.bincount(query, minlength=len(ids)) == k)
                least = np.full(len(ids), np.inf)
                np.minimum.at(least, query, got)
                floors[d][full] = least[full]
        for d, (ids, _) in blocks.items():
            query, score, vec = best[d]
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(vec), pa.array(score)], ["query_uid", "vec", "score"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(uid, vec, v) of the rows that take part; v is floor(scale * component)."""
    double = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return materialise(
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite)
        .select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec"), F.transform(double, lambda x: F.floor(x * scale)).alias("v")),
        "vectors",
    )


def topk_inner_product(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each row whose id is
    divisible by ``every``, by inner product of floor(scale * component); ties to the smaller id.

    Every row but the query's own is a candidate, rows that repeat an id included. Rows with a
    null id, a null vector or a component that is null or not finite take no part. Vectors of
    different lengths don't meet; vectors of length 0 score 0. Scores are exact below 2**63.
    With fewer than ``k`` candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    queries = rows.filter(F.col("vec") % every == 0)
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    results = []
    for b in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "v").toArrow()
        by_size: dict[int, list] = {}
        for uid, v in zip(mine.column("uid").to_pylist(), mine.column("v").to_pylist()):
            by_size.setdefault(len(v), []).append((uid, v))
        shared = spark.sparkContext.broadcast(
            {d: (np.array([u for u, _ in g], np.int64), np.array([v for _, v in g], np.int64).reshape(len(g), d)) for d, g in by_size.items()}
        )
        results.append(rows.mapInArrow(_search(shared, k), "query_uid long, vec long, score long"))
    found = results[0]
    for more in results[1:]:
        found = found.unionAll(more)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = queries.select(F.col("uid").alias("query_uid"), F.col("vec").alias("query_id"))
    return best.join(ids, "query_uid").select("query_id", "rank", F.col("vec").alias("vec_id"), "score")
