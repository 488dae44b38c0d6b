"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule w(t) = W * (1 - a + 2 * a * t) over training time
t in [0, 1]; its integral is the source's weight W. Targets are W's shares of the mix,
filled like water: a source is never asked for more than ``cap`` times its size, and
what it cannot give is shared again by weight. A source is read in the order of a hash
of doc_id, over again if its target exceeds its size; the last document taken is cut.
The words asked of a source before a document, divided by its target, are inverted
through the integrated schedule to give the document's position, and documents are
sorted by range of positions.

Cumulative words come from two levels (sums by hash bucket, then within a bucket), so
that a source with any share of the rows is spread over all tasks.

Null text has size 0, null source is a source of its own (last in order), a document
of size 0 takes 0 words and has no position, an empty table gives an empty result;
repeated rows each count. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch, fresh, load

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = (0.5, 0.0, -0.5)
#: Rows that a bucket of one source holds on average, if the source had all rows.
BUCKET_ROWS = 20_000


def cycle(values: tuple[float, ...], index: Column) -> Column:
    """values[index mod len(values)] without a lookup table."""
    out = F.lit(float(values[-1]))
    for k in range(len(values) - 1):
        out = F.when(index % len(values) == k, F.lit(float(values[k]))).otherwise(out)
    return out


def inverse(u: Column, ramp: Column) -> Column:
    """t with (1 - ramp) * t + ramp * t * t = u."""
    return F.when(ramp == 0, u).otherwise((ramp - 1 + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)) / (2 * ramp))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its number, size, target and ramp. As many rows as sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", (F.row_number().over(number) - 1).cast("long"))
    per = per.withColumn("weight", cycle(weights, F.col("sid"))).withColumn("ramp", cycle(ramps, F.col("sid")))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    per = per.withColumn("before", F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.coalesce("before", F.lit(0.0))) / F.col("left"))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    per = per.withColumn("level", F.max(fits).over(every))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("level")))
    return per.select("source", "sid", "source_size", "ramp", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = 1.5, cap: float = 2.0, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, passes, and the columns ``carried``.

    ``passes`` has a struct (pass, taken, position) for each time the mix reads the
    document; ``taken`` is their sum. Rows come sorted by their first position.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.write(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *carried), "sizes")
    rows = sizes.count()
    digits = 1 + max(0, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    per = source_targets(sizes, weights, ramps, share, cap)
    same = F.expr("s.source <=> p.source")
    docs_in = sizes.alias("s").join(per.alias("p"), same).select("s.doc_id", "s.size", "s.key", "p.sid", "p.source_size", "p.target", "p.ramp", *[f"s.{c}" for c in carried])
    docs_in = docs_in.withColumn("bucket", F.substring("key", 1, digits))
    held = docs_in.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("sid", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    docs_in = docs_in.withColumn("prior", F.coalesce(F.sum("size").over(within), F.lit(0)))
    docs_in = docs_in.join(held, ["sid", "bucket"]).withColumn("prior", F.col("prior") + F.col("ahead"))
    limit = F.floor("target")

    def reading(k: int) -> Column:
        start = F.col("prior") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), limit - start)).cast("long")
        return F.struct(F.lit(k).alias("pass"), words.alias("taken"), inverse(start / F.col("target"), F.col("ramp")).alias("position"))

    passes = F.filter(F.array(*[reading(k) for k in range(math.ceil(cap))]), lambda p: p["taken"] > 0)
    out = docs_in.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(F.filter(passes, lambda p: F.lit(False))))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["taken"])
    position = F.when(F.size("passes") > 0, F.element_at("passes", 1)["position"])
    out = out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), position.alias("position"), "passes", *carried)
    return scratch.finish(out.orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents in training order, cut and repeated as planned.

    A row per reading of a document, with all columns of ``docs``; a document cut by
    its source's target keeps its first words, one blank between them. Every row is a document, whether its doc_id is
    null or on other rows too: rows are told apart by doc_id, text and source, and equal ones by number.
    """
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("")) for c in ("doc_id", "text", "source")]
    names = {n: fresh(docs, f"_{n}") for n in ("key", "nth", "whole", "used", "place")}
    key, nth, whole, used, place = names.values()
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(" ", *parts), 256))
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    plan = mix_sources(keyed.select("doc_id", "text", "source", F.col(key).alias("_row")), **options, carried=("_row",))
    plan = plan.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    plan = plan.select("_row", "_nth", "size", F.explode("passes").alias("p"))
    reads = plan.select(F.col("_row").alias(key), F.col("_nth").alias(nth), F.col("size").alias(whole), F.col("p.taken").alias(used), F.col("p.position").alias(place))
    rows = keyed.withColumn(nth, number).join(reads, [key, nth])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col(used).cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col(used) < F.col(whole), first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE sid % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS ramp,
         source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM per),
l AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT *, least(most, weight * max(level) FILTER (WHERE level <= most / weight) OVER ()) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp, CAST(floor(t.target) AS BIGINT) AS lim,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, lim - prior)) AS one, greatest(0, least(size, lim - prior - source_size)) AS two FROM p)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one = 0 THEN NULL WHEN ramp = 0 THEN prior / target
            ELSE (ramp - 1 + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (prior / target))) / (2 * ramp) END AS position
FROM q
"""
