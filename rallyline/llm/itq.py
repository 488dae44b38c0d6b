"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learned so that their signs lose little
(iterative quantisation), on SAMPLE vectors by hash (a documented bound). Every vector
gets a code of 64 signs (random directions beyond its length), cut into TABLES substrings; a table holds the vectors by
label and substring. Vectors whose substrings differ in at most one bit in some table are
compared by the cosine of the original vectors, so that all codes within
2 * TABLES - 1 bits of each other are found. A pair is counted in the first table that
brings it together.

Equal vectors of a label form a class, compared once. A bucket is cut into blocks of
about BLOCK rows by hash, and pairs of blocks are compared as matrices: they give counts
and a spanning set of links, never the pairs, so a bucket of any size is shared among
tasks of bounded size.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without a label, link with nothing; vectors of different length don't either. Repeated
rows are copies of each other; a vec_id on several rows is one node. An empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch, load
from rallyline.llm._graph import components
from rallyline.llm.topk import matrix, usable

COSINE = 0.98
SAMPLE = 8192
BITS, TABLES = 64, 4
ROUNDS = 40
BLOCK = 512


def rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` signs): principal components turned so that signs are nearest to values.

    Vectors shorter than the code have random directions for the rest of it, so that every
    table tells vectors apart. With no more samples than bits the turn is a random one.
    """
    size, whole = sample.shape[1], bits
    bits = min(bits, size)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(size)
    if len(sample) > bits:
        values, vectors = np.linalg.eigh(np.cov((sample - mean).T).reshape(size, size))
        base = vectors[:, np.argsort(-values, kind="stable")[:bits]]
    else:
        base = np.linalg.qr(np.random.default_rng(0).standard_normal((size, bits)))[0]
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((bits, bits)))[0]
    low = (sample - mean) @ base
    for _ in range(rounds if len(sample) > bits else 0):
        u, _, w = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = w.T @ u.T
    more = np.random.default_rng(2).standard_normal((size, whole - bits))
    return mean, np.hstack([base @ turn, more])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def code_rows(turns: dict[int, tuple[np.ndarray, np.ndarray]]):
    """vec_id, label, weight, v -> the same with its code."""

    def run(iterator):
        for batch in iterator:
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                mine = batch.filter(pa.array(lengths == size))
                mean, turn = turns[int(size)] if int(size) in turns else rotation(np.zeros((0, int(size))), BITS)
                signs = (unit(matrix(mine.column(3))) - mean) @ turn >= 0
                code = np.packbits(signs, axis=1, bitorder="little").view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(code)], names=["vec_id", "label", "weight", "v", "code"])

    return run


def near(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    width = BITS // TABLES
    diff = ((a ^ b) >> np.uint64(width * table)) & np.uint64((1 << width) - 1)
    return (diff & (diff - np.uint64(1))) == 0


def linked(x, y, table: int, same: bool, cosine: float):
    """Places (i, j) of pairs of two blocks that are linked and first meet in this table."""
    i, j = np.nonzero(x[2] @ y[2].T >= cosine)
    if same:
        i, j = i[i < j], j[i < j]
    a, b = x[1][i], y[1][j]
    own = near(a, b, table)
    for earlier in range(table):
        own &= ~near(a, b, earlier)
    return i[own], j[own]


def span(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the links."""
    parent: dict[int, int] = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(p), root(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((min(p, q), max(p, q)))
    return out


def task_rows(cosine: float):
    """Rows sorted by (task, side): one block, or two -> (a, b, n): links with n = 0, counts with b null."""

    def run(iterator):
        name, same, held = None, True, ([], [])

        def found():
            x = [np.array(c) for c in zip(*held[0], strict=True)] if held[0] else None
            y = x if same else ([np.array(c) for c in zip(*held[1], strict=True)] if held[1] else None)
            if x is None or y is None:
                return None
            i, j = linked(x, y, name[1], same, cosine)
            if not len(i):
                return None
            ids = np.concatenate([x[0][i], y[0][j]])
            n = np.concatenate([y[3][j], x[3][i]])
            who, at = np.unique(ids, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)
            links = span(x[0][i], y[0][j])
            a = [p for p, _ in links] + who.tolist()
            b = [q for _, q in links] + [None] * len(who)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(links) + n.tolist(), pa.int64())], names=["a", "b", "n"])

        for got in iterator:
            if not got.num_rows:
                continue
            tasks, tables, alike, sides, ids, weights = (got.column(i).to_pylist() for i in range(6))
            codes = got.column(6).to_numpy().view(np.uint64)
            lengths = got.column(7).value_lengths().to_numpy(zero_copy_only=False)
            edges = [0] + [i for i in range(1, len(tasks)) if tasks[i] != tasks[i - 1] or lengths[i] != lengths[i - 1]] + [len(tasks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if name is None or tasks[a] != name[0]:
                    if name is not None and (out := found()) is not None:
                        yield out
                    name, same, held = (tasks[a], tables[a]), alike[a], ([], [])
                v = unit(matrix(got.column(7).slice(a, b - a)))
                for i in range(a, b):
                    held[sides[i]].append((ids[i], codes[i], v[i - a], weights[i]))
        if name is not None and (out := found()) is not None:
            yield out

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "itq")
    ids = F.col("vec_id").cast("long").alias("vec_id")
    good = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    rows = embeddings.select(ids, "label", F.when(good, F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    whole = rows.filter("v is not null")
    classes = whole.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight")).select("vec_id", F.col("label").cast("string").alias("label"), "weight", "v")
    sample = whole.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"].tolist()
    turns = {n: rotation(unit(np.array([v for v in sample if len(v) == n], float)), BITS) for n in {len(v) for v in sample}}
    coded = scratch.write(classes.mapInArrow(code_rows(turns), "vec_id long, label string, weight long, v array<double>, code long"), "coded")
    width = BITS // TABLES
    mask = (1 << width) - 1
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("code", width * t).bitwiseAND(F.lit(mask)).cast("int").alias("s")) for t in range(TABLES)]))
    keyed = coded.withColumn("size", F.size("v")).withColumn("k", tables).select("vec_id", "label", "size", "k.t", "k.s")
    bucket = ["label", "size", "t", "s"]
    held = keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias("held")).withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    held = scratch.write(held, "held")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    placed = scratch.write(keyed.join(held, bucket).withColumn("block", block).select("vec_id", *bucket, "block"), "placed")
    one = held.select(*bucket, "held", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    flips = F.array(F.col("s"), *[F.col("s").bitwiseXOR(F.lit(1 << i)) for i in range(width)])
    other = one.select("label", "size", "t", F.col("s").alias("s1"), F.col("block").alias("block1"), F.col("held").alias("held1"), F.explode(flips).alias("s"))
    pairs = other.join(one.withColumnRenamed("block", "block2"), ["label", "size", "t", "s"])
    same = (F.col("s") == F.col("s1")) & (F.col("block1") == F.col("block2"))
    pairs = pairs.filter((F.col("s1") < F.col("s")) | ((F.col("s1") == F.col("s")) & (F.col("block1") <= F.col("block2")))).filter(~(same & (F.col("held1") == 1)))
    pairs = pairs.select(F.xxhash64("label", "size", "t", "s1", "block1", "s", "block2").alias("task"), "label", "size", "t", "s1", "block1", "s", "block2", same.alias("alike"))
    left = pairs.select("task", "alike", F.lit(0).alias("side"), "label", "size", "t", F.col("s1").alias("s"), F.col("block1").alias("block"))
    right = pairs.filter(~F.col("alike")).select("task", "alike", F.lit(1).alias("side"), "label", "size", "t", "s", F.col("block2").alias("block"))
    routed = placed.join(left.unionByName(right), [*bucket, "block"]).select("vec_id", "task", "t", "alike", "side")
    routed = routed.join(coded.select("vec_id", "weight", "code", "v"), "vec_id").select("task", "t", "alike", "side", "vec_id", "weight", "code", "v")
    met = routed.repartition("task").sortWithinPartitions("task", "side").mapInArrow(task_rows(cosine), "a long, b long, n long")
    met = scratch.write(met, "met")
    found = components(met.filter("b is not null").select("a", "b"), scratch)
    counts = met.filter("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    by_class = coded.select("vec_id", "label", "weight", "v").join(counts, "vec_id", "left").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    by_class = by_class.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "vec_id").alias("component"))
    out = rows.withColumn("label", F.col("label").cast("string")).join(by_class, ["label", "v"], "left")
    component = F.coalesce("component", "vec_id")
    return scratch.finish(out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")))


def op4_itq(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))
