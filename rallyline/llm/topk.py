"""Exact top-k search by inner product, by elimination with a pivot table.

The Euclidean distances of every vector to a number of pivots are computed once. By the
triangle inequality |d(q, p) - d(x, p)| bounds d(q, x) from below for every pivot p; the
greatest of these gives the largest score that x can have with q, as
2 * q.x = |q|^2 + |x|^2 - d(q, x)^2. Candidates are taken in the order of that bound, in
steps, until it falls under the k-th best score found. The pivots are rows themselves, so
their scores give every query a first threshold; all of it is exact.

Pivots are chosen far apart from a sample of SAMPLE rows by hash (a documented bound);
every row is indexed and searched. A length that is not in the sample has the zero vector
for its pivot, which is no row and gives no threshold. Queries and rows meet in blocks of bounded size, each
pair of blocks gives at most k rows a query, and these are merged at the end.

Vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of equal length are compared. Ties go to the smaller vec_id. A vec_id on several
rows counts as several rows, none of which answers the queries of that vec_id; several query
rows of one vec_id are one query with the k best of all their pairs. An empty
table, or one without queries, gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch, load

PIVOTS = 24
SAMPLE = 1024
ROWS, QUERIES = 2048, 512
STEP = 64


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def far_apart(sample: np.ndarray, count: int) -> list[int]:
    """Places of rows of the sample, each the farthest from those before."""
    chosen = [int(np.argmax((sample * sample).sum(axis=1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def table_rows(pivots: dict[int, np.ndarray]):
    """vec_id, v -> vec_id, v and its distances to the pivots of its length."""

    def run(iterator):
        for batch in iterator:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                mine = batch.filter(pa.array(lengths == size))
                d = distances(matrix(mine.column(1)), pivots.get(int(size), np.zeros((1, int(size)))))
                table = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), table], names=["vec_id", "v", "d"])

    return run


def search(q_ids: np.ndarray, q: np.ndarray, q_d: np.ndarray, ids: np.ndarray, x: np.ndarray, x_d: np.ndarray, start: np.ndarray, k: int):
    """(query, vec_id, score) rows: the best k of x for each query; ``start`` is a score known to be reached by k rows."""
    low = np.zeros((len(q), len(x)))
    for p in range(q_d.shape[1]):
        np.maximum(low, np.abs(q_d[:, p, None] - x_d[None, :, p]), out=low)
    low = np.maximum(low - 1e-6, 0)
    bound = np.floor(((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - low * low) / 2 + 1e-6)
    bound[q_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero((bound[i] >= start[i]) & np.isfinite(bound[i]))
        alive = alive[np.argsort(-bound[i][alive], kind="stable")]
        score, who, least = np.zeros(0), np.zeros(0, np.int64), start[i]
        for at in range(0, len(alive), STEP):
            some = alive[at : at + STEP]
            if bound[i][some[0]] < least:
                break
            score, who = np.append(score, x[some] @ q[i]), np.append(who, ids[some])
            best = np.lexsort((who, -score))[:k]
            score, who = score[best], who[best]
            if len(score) == k:
                least = max(least, score[-1])
        out += [(int(q_ids[i]), int(w), int(s)) for w, s in zip(who, score, strict=True)]
    return out


def block_rows(pivots: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Rows sorted by (size, row_block, query_block, role), queries first -> the best of each pair of blocks."""

    def run(iterator):
        name, held = None, ([], [])

        def found():
            if not held[0] or not held[1]:
                return []
            (q_ids, q, q_d), (ids, x, x_d) = ([np.array(c) for c in zip(*side, strict=True)] for side in held)
            own_ids, own = pivots.get(name[0], (np.zeros(0, np.int64), np.zeros((0, name[0]))))
            known = np.where(own_ids[None, :] == q_ids[:, None], -np.inf, q @ own.T)
            # Each pivot stands for a row, but those of the query's own vec_id answer nothing.
            start = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
            return search(q_ids, q, q_d, ids, x, x_d, start, k)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        for got in iterator:
            keys = list(zip(*[got.column(i).to_pylist() for i in range(3)], strict=True))
            roles, ids = got.column(3).to_pylist(), got.column(4).to_pylist()
            edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != name:
                    if name:
                        yield batch(found())
                    name, held = keys[a], ([], [])
                v, d = matrix(got.column(5).slice(a, b - a)), matrix(got.column(6).slice(a, b - a))
                for i in range(a, b):
                    held[roles[i]].append((ids[i], v[i - a], d[i - a]))
        if name:
            yield batch(found())

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivot_count: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score over ``vectors`` (vec_id, v array<double> of whole numbers)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots = {}
    for n in {len(r.v) for r in sample}:
        some = [r for r in sample if len(r.v) == n]
        own = np.array([r.v for r in some])
        chosen = far_apart(own, pivot_count)
        pivots[n] = (np.array([some[i].vec_id for i in chosen]), own[chosen])
    table = scratch.write(vectors.mapInArrow(table_rows({n: p for n, (_, p) in pivots.items()}), "vec_id long, v array<double>, d array<double>"), "table")
    counts = table.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    row_blocks, query_blocks = -(-max(1, counts.n) // ROWS), -(-max(1, counts.q) // QUERIES)
    sized = table.withColumn("size", F.size("v"))
    row_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    columns = ["size", "row_block", "query_block", "role", "vec_id", "v", "d"]
    rows = sized.withColumn("row_block", row_block).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("role", F.lit(1))
    asked = sized.filter(is_query).withColumn("query_block", query_block).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).withColumn("role", F.lit(0))
    met = rows.select(columns).unionByName(asked.select(columns))
    met = met.repartition("size", "row_block", "query_block").sortWithinPartitions("size", "row_block", "query_block", "role")
    best = met.mapInArrow(block_rows(pivots, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return scratch.finish(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def whole_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    return embeddings.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(load(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
