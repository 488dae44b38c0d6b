"""Main-camera views: adaptive thresholds, stable runs of flags, segments, sample times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import order_statistics
from rallyline.operators import sequence


def adaptive_threshold(scores: DataFrame, key: list[str], score: str, configured: float, margin: float = 0.012) -> DataFrame:
    """Per key, the threshold of the template scores.

    A tight mode of high scores lowers it to just under the 10 % score; a best score that
    narrowly misses it, or matches that are few beside those of 0.75, lower it to 0.75.
    """
    p = order_statistics(scores, key, score, {"p10": (0.10, "truncated"), "p90": (0.90, "truncated")})
    x = F.col(score)
    s = scores.filter(x.isNotNull()).groupBy(*key).agg(F.max(x).alias("best"), F.avg((x >= configured).cast("double")).alias("strict"), F.avg((x >= 0.75).cast("double")).alias("loose"))
    out = s.join(p, key)
    tight = (F.col("p10") >= 0.65) & (F.col("p90") - F.col("p10") <= 0.12) & (F.col("p90") < configured)
    near = (F.col("best") < configured) & (F.col("best") >= 0.75)
    sparse = F.lit(configured > 0.75) & (F.col("strict") < 0.10) & (F.col("loose") >= 0.15) & (F.col("loose") >= F.col("strict") * 3.0)
    value = F.when(tight, F.greatest(F.lit(0.65), F.col("p10") - margin)).when(near | sparse, 0.75).otherwise(float(configured))
    return out.select(*key, value.alias("threshold"))


def runs(flags: DataFrame, key: list[str], at: str, flag: str) -> DataFrame:
    """Runs of equal flags over rows ordered by ``at``: first, last, n, and whether rows lie before and after."""
    w = sequence.by(key, at)
    df = flags.withColumn("_new", F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*key, "_run", flag).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    order = sequence.by(key, "_run")
    return out.withColumn("before", F.lag("_run").over(order).isNotNull()).withColumn("after", F.lead("_run").over(order).isNotNull())


def stable_runs(flags: DataFrame, key: list[str], at: str, flag: str, least_on: int = 5, least_off: int = 5) -> DataFrame:
    """Runs of true flags (first, last, n) once short gaps within are filled and short runs dropped.

    A gap at either end of a video is not filled. Works on runs, not on rows.
    """
    r = runs(flags, key, at, flag)
    filled = F.col(flag) | (F.col("before") & F.col("after") & (F.col("n") < least_off))
    r = r.withColumn("_on", filled)
    w = sequence.by(key, "_run")
    r = r.withColumn("_new", F.coalesce((F.col("_on") != F.lag("_on").over(w)).cast("int"), F.lit(1)))
    r = r.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_on")
    out = r.groupBy(*key, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out.filter(F.col("n") >= least_on).drop("_group")


def segments(stable: DataFrame, key: list[str], fps: float | Column) -> DataFrame:
    """Numbered segments of true runs; frames closed at both ends, seconds open at the end."""
    fps = F.lit(float(fps)) if isinstance(fps, (int, float)) else fps
    place = F.row_number().over(sequence.by(key, "first"))
    seconds = lambda c: F.bround(c / fps, 3)
    return stable.select(
        *key, F.format_string("main_%03d", place).alias("segment_id"), F.col("first").alias("start_frame"), F.col("last").alias("end_frame"),
        (F.col("last") - F.col("first") + 1).alias("frame_count"), seconds(F.col("first")).alias("start_sec"), seconds(F.col("last") + 1).alias("end_sec"),
        seconds(F.col("last") - F.col("first") + 1).alias("duration_sec"),
    )


def score_summary(scores: DataFrame, key: list[str], score: str) -> DataFrame:
    return scores.groupBy(*key).agg(F.bround(F.min(score), 6).alias("score_min"), F.bround(F.max(score), 6).alias("score_max"), F.bround(F.avg(score), 6).alias("score_mean"))


def sample_times(found: DataFrame, key: list[str], fps: float, fallback_ms: int, most: int = 6) -> DataFrame:
    """Per key, midpoints in milliseconds of the longest segments (the first named among equals), distinct, then the fallback."""
    rank = F.row_number().over(sequence.by(key, F.col("frame_count").desc(), "start_frame"))
    middle = F.bround((F.col("start_frame") + F.col("end_frame")) / 2 / fps * 1000, 0).cast("long")
    rows = found.withColumn("_k", rank).filter(F.col("_k") <= most).select(*key, "_k", middle.alias("ms"))
    times = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ms"))), lambda r: r["ms"]).alias("times"))
    return times.select(*key, F.array_distinct(F.concat("times", F.array(F.lit(max(0, int(fallback_ms))).cast("long")))).alias("times"))


def selected_frames(spans: DataFrame, key: list[str], stride: int, most: int = 0) -> DataFrame:
    """Per key, how many frames of closed spans a stride selects, ``most`` at most (0: all)."""
    first = F.col("start_frame") + F.pmod(-F.col("start_frame"), F.lit(stride))
    n = F.when(first <= F.col("end_frame"), F.floor((F.col("end_frame") - first) / stride) + 1).otherwise(0)
    total = F.sum(n)
    return spans.groupBy(*key).agg((F.least(total, F.lit(most)) if most else total).alias("frames"))


def remaining_spans(spans: DataFrame, key: list[str], stride: int, done: int) -> DataFrame:
    """Spans that are left, from their first selected frame on, once ``done`` selected frames are there."""
    first = F.col("start_frame") + F.pmod(-F.col("start_frame"), F.lit(stride))
    n = F.when(first <= F.col("end_frame"), F.floor((F.col("end_frame") - first) / stride) + 1).otherwise(0)
    rows = spans.withColumn("_n", n)
    before = F.coalesce(F.sum("_n").over(sequence.by(key, "start_frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_skip", F.greatest(F.lit(0), F.lit(done) - before))
    rows = rows.filter(F.col("_skip") < F.col("_n"))
    return rows.select(*key, (first + F.col("_skip") * stride).alias("start_frame"), "end_frame")
