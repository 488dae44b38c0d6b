"""Bootstrap intervals whose draws come from a hash, so that reruns and other engines agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyline.operators import draws

REPETITIONS = 10_000
#: Values that are drawn from as one array; more are drawn in pieces.
HELD = 1 << 20
#: Draws of a task, tasks of a shuffle, and bytes of counts of a piece of rows over all repetitions.
TASK, WIDTH, PIECE = 1 << 25, 48, 1 << 24


def draw(seed: str, rep: Column, i: Column, n: Column) -> Column:
    """A place in 0..n-1 for draw i of a repetition."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), rep, i)), 1, 8), 16, 10).cast("long") % n


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def tendency(values: Column) -> Column:
    """100 * (positive + half of the zeros) / n."""
    return mean(F.transform(values, lambda v: F.when(v > 0, 100.0).when(v == 0, 50.0).otherwise(0.0)))


def interval(estimates: DataFrame, key: list[str], value: str = "estimate") -> DataFrame:
    return estimates.groupBy(*key).agg(F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"))


def bootstrap(values: DataFrame, key: list[str], value: str, order: list[str], seed: str = "7", repetitions: int = REPETITIONS, statistic: Callable[[Column], Column] = mean) -> DataFrame:
    """Percentile interval of a statistic (of an array) by key; a single value is its own interval, none gives null.

    Values are numbered by ``order``. Means and tendencies are drawn by ``drawn_means``; for
    another statistic a key with up to HELD values is drawn from as one array.
    """
    rows = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if statistic is tendency:
        rows = rows.withColumn(value, F.when(F.col(value) > 0, 100.0).when(F.col(value) == 0, 50.0).otherwise(0.0))
    if statistic in (mean, tendency):
        return drawn_means(rows, key, value, order, seed, repetitions)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")) if key else rows.agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > HELD:
        raise ValueError(f"a statistic other than the mean takes at most {HELD} values a key")
    held = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_s")).select(*key, F.transform("_s", lambda r: r["_v"]).alias("_vals"))
    reps = rows.sparkSession.range(repetitions).select(F.col("id").cast("int").alias("_rep"))
    n = F.size("_vals")
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_vals", draw(seed, F.col("_rep"), i, n).cast("int")))
    est = reps.crossJoin(F.broadcast(held)).select(*key, statistic(drawn).alias("estimate"))
    return interval(est, key)


def drawn_means(rows: DataFrame, key: list[str], value: str, order: list[str], seed: str, repetitions: int) -> DataFrame:
    """The interval of the mean. Repetitions of a key are spread over tasks, each of which gets its values as one array up to HELD, and in pieces beyond."""
    rows = rows.select(*key, *order, F.col(value).cast("double").alias("_v")).localCheckpoint()
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    few, many = (sizes.filter(c) for c in (F.col("_n") <= HELD, F.col("_n") > HELD))
    if many.isEmpty():
        return interval(held_means(rows, key, order, seed, repetitions), key)
    big = (rows.join(F.broadcast(many), key) if key else rows).drop("_n")
    est = drawn_sums(big, key, order, [F.col("_v")], seed, repetitions).select(*key, (F.get("_sums", 0) / F.col("_n")).alias("estimate"))
    if key:
        est = est.unionByName(held_means(rows.join(F.broadcast(few), key).drop("_n"), key, order, seed, repetitions))
    return interval(est, key)


def held_means(rows: DataFrame, key: list[str], order: list[str], seed: str, repetitions: int) -> DataFrame:
    """key, estimate: means of ``_v`` drawn from one array a key."""
    held = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "_v"))).alias("_s")).select(*key, F.transform("_s", lambda r: r["_v"]).alias("_vals")).filter(F.size("_vals") > 0)
    parts = F.least(F.lit(repetitions), F.ceil(F.size("_vals") * F.lit(float(repetitions)) / TASK).cast("int"))
    tasks = held.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = (F.floor((F.col("_part") + k) * F.lit(float(repetitions)) / F.col("_parts")).cast("long") for k in (0, 1))
    tasks = tasks.select(*key, "_part", low.alias("_low"), high.alias("_high"), "_vals").repartition(WIDTH, *key, "_part")
    names = list(key)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                vals = batch["_vals"][k].values.to_numpy(zero_copy_only=False)
                out = draws.means(np.ascontiguousarray(vals), seed, batch["_low"][k].as_py(), batch["_high"][k].as_py())
                same = [pa.array([batch[c][k].as_py()] * len(out), batch.schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*same, pa.array(out)], names=[*names, "estimate"])

    fields = [*[rows.schema[c] for c in key], T.StructField("estimate", T.DoubleType())]
    return tasks.mapInArrow(run, T.StructType(fields))


def numbered_rows(rows: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """key, ``_i`` (place by ``order`` within the key, from 0) and ``keep``, sorted in ranges over all tasks.

    The sorted rows are kept, so that their ranges are the same each time; the places
    before a range follow from its keys' counts.
    """
    at = F.monotonically_increasing_id()
    rows = rows.orderBy(*key, *order).select(*key, *keep, at.alias("_at")).withColumn("_range", F.shiftright("_at", 33)).localCheckpoint()
    counts = rows.groupBy(*key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_off"))
    return rows.join(F.broadcast(counts), [*key, "_range"]).select(*key, (F.col("_at") + F.col("_off")).alias("_i"), *keep)


def drawn_sums(rows: DataFrame, key: list[str], order: list[str], values: list[Column], seed: str, repetitions: int) -> DataFrame:
    """key, ``_rep``, ``_n`` and ``_sums``: for each repetition the sums of ``values`` over as many drawn rows as there are.

    A task counts how often each row is drawn in a repetition, four bytes a row; the counts
    of a piece of rows, for all repetitions, are multiplied with the piece's values.
    """
    rows = numbered_rows(rows.select(*key, *order, F.array(*[v.cast("double") for v in values]).alias("_vs")), key, order, ["_vs"])
    piece = max(64, PIECE // repetitions)
    rows = rows.withColumn("_piece", F.floor(F.col("_i") / piece))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    width, names = len(values), list(key)
    spark = rows.sparkSession
    tasks = spark.range(0, repetitions, 1, min(repetitions, WIDTH)).select(F.col("id").cast("int").alias("_rep")).crossJoin(F.broadcast(sizes.filter("_n > 0")))
    fields = [rows.schema[c] for c in key]
    long, blob = T.LongType(), T.BinaryType()
    counted = T.StructType([*fields, T.StructField("_piece", long), T.StructField("_rep", T.IntegerType()), T.StructField("_n", long), T.StructField("_times", blob)])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                times = draws.times(seed, row["_rep"], row["_n"])
                kind = np.uint8 if times.max() < 256 else np.uint32
                cut = [times[a:a + piece].astype(kind).tobytes() for a in range(0, len(times), piece)]
                for a in range(0, len(cut), 64):
                    some = cut[a:a + 64]
                    same = [pa.array([row[c]] * len(some), batch.schema.field(c).type) for c in names]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(a, a + len(some)), pa.int64()), pa.array([row["_rep"]] * len(some), pa.int32()), pa.array([row["_n"]] * len(some), pa.int64()), pa.array(some, pa.binary())], names=counted.names)

    summed = T.StructType([*fields, T.StructField("_rep", T.IntegerType()), T.StructField("_n", long), T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def add(left, right):
        import numpy as np
        import pyarrow as pa

        places = left["_i"].to_numpy() % piece
        table = np.zeros((len(places), width))
        table[places] = left["_vs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        n = len(table)
        sums = np.empty((right.num_rows, width))
        for k, b in enumerate(right["_times"].to_pylist()):
            sums[k] = np.frombuffer(b, np.uint8 if len(b) == n else np.uint32) @ table
        each = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))
        return pa.table([*[right[c] for c in names], right["_rep"], right["_n"], each], names=summed.names)

    by = [*key, "_piece"]
    times = tasks.mapInArrow(count, counted)
    parts = rows.select(*by, "_i", "_vs").groupBy(*by).cogroup(times.groupBy(*by)).applyInArrow(add, summed)
    sums = F.array(*[F.sum(F.get("_s", k)) for k in range(width)])
    return parts.groupBy(*key, "_rep", "_n").agg(sums.alias("_sums"))


def cluster_bootstrap(values: DataFrame, key: list[str], cluster: str, value: str, seed: str = "7", repetitions: int = REPETITIONS) -> DataFrame:
    """Percentile interval of the pooled mean over resampled clusters, each drawn with all its values."""
    rows = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    sums = rows.groupBy(*key, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_c"))
    held = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(cluster, "_s", "_c"))).alias("_cl"))
    reps = rows.sparkSession.range(repetitions).select(F.col("id").cast("int").alias("_rep"))
    n = F.size("_cl")
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_cl", draw(seed, F.col("_rep"), i, n).cast("int")))
    total = lambda f: F.aggregate(drawn, F.lit(0.0), lambda a, r: a + r[f])
    est = reps.crossJoin(F.broadcast(held)).select(*key, (total("_s") / total("_c")).alias("estimate"))
    return interval(est, key)


def block_bootstrap(blocks: DataFrame, block: list[str], row: str, column: str, rows: list[str], columns: list[str], seed: str = "7", repetitions: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resampled blocks of a contingency table: (proportions, association, draws).

    ``blocks`` holds a row per observation. Each block's table is one array of counts; a
    repetition adds up as many drawn blocks as there are. Tables and draws are made once
    and kept. Draws give the row proportions of each repetition, for contrasts.
    """
    from rallyline.operators import profile

    cells = [(r, c) for r in rows for c in columns]
    counts = F.array(*[F.count_if((F.col(row) == r) & (F.col(column) == c)).cast("double") for r, c in cells])
    some = F.exists("_t", lambda c: c > 0)  # a filter of the observations would be pushed down and work their zones out again
    tables = blocks.groupBy(*block).agg(counts.alias("_t")).filter(some).localCheckpoint()
    n = tables.count()
    sums = drawn_sums(tables, [], block, [F.get("_t", k) for k in range(len(cells))], seed, repetitions)
    drawn = sums.select("_rep", *[F.get("_sums", k).alias(f"c{k}") for k in range(len(cells))])
    whole = tables.agg(*[F.coalesce(F.sum(F.get("_t", k)), F.lit(0.0)).alias(f"c{k}") for k in range(len(cells))]).withColumn("_rep", F.lit(-1))
    table = F.array(*[F.array(*[F.col(f"c{i * len(columns) + j}") for j in range(len(columns))]) for i in range(len(rows))])
    every = drawn.unionByName(whole.select("_rep", *[f"c{k}" for k in range(len(cells))])).select("_rep", table.alias("_table")).withColumn("v", profile.cramers_v(F.col("_table"), len(rows), len(columns))).localCheckpoint()
    grid = F.array(*[F.struct(F.lit(r).alias(row), F.lit(c).alias(column), F.lit(i).alias("_r"), F.lit(j).alias("_c")) for i, r in enumerate(rows) for j, c in enumerate(columns)])
    long = every.withColumn("_g", F.explode(grid)).select("_rep", "_g.*", "_table")
    line = F.get("_table", F.col("_r"))
    total = F.aggregate(line, F.lit(0.0), lambda a, x: a + x)
    long = long.withColumn("proportion", F.coalesce(F.try_divide(F.get(line, F.col("_c")), total), F.lit(0.0))).withColumn("n", F.get(line, F.col("_c")).cast("long"))
    draws = long.select("_rep", row, column, "proportion", "n")
    seen = draws.filter("_rep = -1").select(row, column, F.col("proportion").alias("observed_proportion"), F.col("n").alias("stroke_count"))
    ci = interval(draws.filter("_rep >= 0"), [row, column], "proportion")
    v = every.filter("_rep >= 0").agg(F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high")).crossJoin(F.broadcast(every.filter("_rep = -1").select(F.col("v").alias("observed_v"))))
    return seen.join(ci, [row, column]).withColumn("block_count", F.lit(n)), v.withColumn("block_count", F.lit(n)), draws


def contrasts(draws: DataFrame, row: str, column: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Differences of row proportions in percentage points, first less second, with their interval over the draws."""
    spark = draws.sparkSession
    names = F.broadcast(spark.createDataFrame(pairs, "reference_context string, comparison_context string"))
    a = draws.select("_rep", F.col(row).alias("reference_context"), column, F.col("proportion").alias("_a"))
    b = draws.select("_rep", F.col(row).alias("comparison_context"), column, F.col("proportion").alias("_b"))
    d = a.join(names, "reference_context").join(b, ["_rep", "comparison_context", column]).withColumn("difference", (F.col("_a") - F.col("_b")) * 100)
    key = ["reference_context", "comparison_context", column]
    seen = d.filter("_rep = -1").select(*key, F.col("difference").alias("observed_difference_percentage_points"))
    return seen.join(interval(d.filter("_rep >= 0"), key, "difference"), key)
