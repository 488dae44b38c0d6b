"""Peaks of frame probabilities, their fusion with rule events, grid search, and decoders of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import order_statistics
from rallyline.operators import joins, sequence


def percentile_ranks(df: DataFrame, key: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank of each value in 0..1, ties at their mean; 0 for a single row."""
    every = Window.partitionBy(*key)
    r, ties = F.rank().over(sequence.by(key, value)), F.count(F.lit(1)).over(Window.partitionBy(*key, value))
    n = F.greatest(F.count(F.lit(1)).over(every) - 1, F.lit(1))
    return df.withColumn(out, (r - 1 + (ties - 1) / 2) / n)


def author_peaks(probabilities: DataFrame, key: list[str], at: str, p: str, least: int = 3) -> DataFrame:
    """The highest frame of each run of at least ``least`` neighbouring frames above the 80 % quantile.

    The quantile is the higher of two neighbours; the last frame above it is left out
    before runs are made, as in the published grouping. Equals: the first.
    """
    q = order_statistics(probabilities, key, p, {"_q": (0.8, "higher")})
    over = probabilities.join(F.broadcast(q), key).filter(F.col(p) > F.col("_q"))
    over = over.withColumn("_last", F.max(at).over(Window.partitionBy(*key))).filter(F.col(at) < F.col("_last"))
    over = over.withColumn("_run", F.col(at) - F.row_number().over(sequence.by(key, at)))
    runs = over.groupBy(*key, "_run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col(p)).alias("o"), F.col(at).alias("at"))).alias("best"))
    return runs.filter(F.col("n") >= least).select(*key, F.col("best.at").alias(at))


def around(events: DataFrame, others: DataFrame, key: str, x: str, y: str, radius: int, best: Column, out: str) -> DataFrame:
    """``events`` (unique by key, x) with ``out``: the greatest ``best`` (a struct over others) within ``radius``, or null."""
    found = joins.band_join(events.select(key, x).distinct(), others, key, x, y, radius).groupBy(key, x).agg(F.max(best).alias(out))
    return events.join(found, [key, x], "left")


def fuse(rules: DataFrame, swings: DataFrame, probabilities: DataFrame, proposals: DataFrame, keep_rank: float, add_evidence: float, refine: bool, radius: int = 4, span: int = 6) -> DataFrame:
    """Fused events: (video, candidate_frame, predicted_hitter, sources, fusion_score).

    ``rules``: video, candidate_frame, predicted_hitter; ``swings``: video, candidate_frame;
    ``probabilities``: video, frame, p; ``proposals``: video, frame, event_confidence,
    predicted_hitter. A rule event stays if the best rank around it is high enough, a swing
    peak is added if the best proposal around it is. Events within ``span`` of a group's
    first become the best of them (a rule before others), with all their sources, moved to
    the best proposal around if asked; one event is left per frame.
    """
    ranks = percentile_ranks(probabilities, ["video"], "p").select("video", F.col("frame").alias("_f"), "rank")
    w = Window.partitionBy("video").orderBy("_f").rangeBetween(-radius, radius)
    ranks = ranks.select("video", F.col("_f"), F.max("rank").over(w).alias("swing"))
    near = proposals.select("video", F.col("frame").alias("_pf"), "event_confidence", "predicted_hitter")
    first = F.struct(F.col("event_confidence"), (-F.col("_pf")).alias("_o"), F.col("predicted_hitter"))
    base = rules.select("video", "candidate_frame", "predicted_hitter", F.lit("rule").alias("source")).unionByName(swings.select("video", "candidate_frame", F.lit(None).cast("string").alias("predicted_hitter"), F.lit("swingnet").alias("source")))
    rows = base.join(ranks.withColumnRenamed("_f", "candidate_frame"), ["video", "candidate_frame"], "left").na.fill(0.0, ["swing"])
    rows = around(rows, near, "video", "candidate_frame", "_pf", radius, first, "_best")
    evidence = F.coalesce("_best.event_confidence", F.lit(0.0))
    rows = rows.withColumn("fusion_score", F.col("swing") + evidence)
    rows = rows.filter(F.when(F.col("source") == "rule", F.col("swing") >= keep_rank).otherwise(evidence >= add_evidence))
    rows = rows.withColumn("predicted_hitter", F.when(F.col("source") == "rule", F.col("predicted_hitter")).otherwise(F.coalesce("_best.predicted_hitter", F.lit("unknown"))))
    grouped = sequence.anchored(rows.select("video", "candidate_frame", "predicted_hitter", "source", "fusion_score"), ["video"], "candidate_frame", "source", span)
    top = F.max(F.struct("fusion_score", (F.col("source") == "rule").alias("_rule"), (-F.col("candidate_frame")).alias("_o"), "candidate_frame", "predicted_hitter"))
    out = grouped.groupBy("video", "grp").agg(top.alias("_t"), F.array_sort(F.collect_set("source")).alias("sources")).select("video", F.col("_t.candidate_frame").alias("candidate_frame"), F.col("_t.predicted_hitter").alias("predicted_hitter"), "sources", F.col("_t.fusion_score").alias("fusion_score"))
    if refine:
        weighed = near.join(ranks.withColumnRenamed("_f", "_pf"), ["video", "_pf"], "left").na.fill(0.0, ["swing"])
        peak = F.struct((F.col("event_confidence") * (0.5 + 0.5 * F.col("swing"))).alias("s"), (-F.col("_pf")).alias("_o"), F.col("event_confidence"), F.col("_pf"), F.col("predicted_hitter"))
        out = around(out, weighed, "video", "candidate_frame", "_pf", radius, peak, "_p")
        moved = F.coalesce(F.col("_p.event_confidence") >= 0.35, F.lit(False))
        out = out.withColumn("predicted_hitter", F.when(moved, F.coalesce("_p.predicted_hitter", F.lit("unknown"))).otherwise(F.col("predicted_hitter"))).withColumn("_from", F.col("candidate_frame"))
        out = out.withColumn("candidate_frame", F.when(moved, F.col("_p._pf")).otherwise(F.col("candidate_frame"))).drop("_p")
    else:
        out = out.withColumn("_from", F.col("candidate_frame"))
    k = F.row_number().over(Window.partitionBy("video", "candidate_frame").orderBy(F.col("fusion_score").desc(), "_from"))
    return out.withColumn("_k", k).filter("_k = 1").drop("_k", "_from")


def grid(spark, **axes) -> DataFrame:
    """Every combination of the named values, numbered in their order."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_{name} int, {name} {'boolean' if isinstance(values[0], bool) else 'double'}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.drop(*[f"_{n}" for n in axes])


def best_then(first: DataFrame, second: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """The k best of one scoring (f1, precision, fewer predictions), in the order of another one."""
    order = [F.col("f1").desc(), F.col("precision").desc(), F.col("predicted")]
    top = first.orderBy(*order, *key).limit(k).select(*key)
    return second.join(F.broadcast(top), key).orderBy(*order, *key)


def slope_extrema(series: DataFrame, key: list[str], at: str, value: str, threshold: float = 10, window: int = 7) -> DataFrame:
    """Local extrema of a series with a median slope over the threshold on either side."""
    w = sequence.by(key, at)
    held = w.rowsBetween(-window, window)
    rows = series.withColumns({
        "_v": F.collect_list(value).over(held), "_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*key)),
        "_a": F.lag(value).over(w), "_b": F.lead(value).over(w),
    })
    rows = rows.filter((F.col("_i") >= window + 1) & (F.col("_i") < F.col("_n") - window - 1))
    z = F.col(value)
    rows = rows.filter((z - F.col("_a")) * (z - F.col("_b")) >= 0)
    steps = F.transform(F.sequence(F.lit(1), F.lit(2 * window)), lambda i: F.try_element_at("_v", i + 1) - F.try_element_at("_v", i))

    def median(part: Column) -> Column:
        s = F.array_sort(part)
        low, high = (F.floor((F.size(s) + k) / 2).cast("int") for k in (1, 2))
        return (F.try_element_at(s, low) + F.try_element_at(s, high)) / 2

    left, right = F.abs(median(F.slice(steps, 1, window))), F.abs(median(F.slice(steps, window + 1, window)))
    return rows.filter(F.greatest(left, right) > threshold).select(*key, at)


def merge_close(a: DataFrame, b: DataFrame, key: list[str], at: str, closeness: int = 15) -> DataFrame:
    """Both sets of times as one; a time within ``closeness`` of the last kept goes."""
    both = a.select(*key, at).unionByName(b.select(*key, at)).distinct()
    grouped = sequence.anchored(both, key, at, at, closeness)
    return grouped.groupBy(*key, "grp").agg(F.min(at).alias(at)).drop("grp")


def decode_alternating(probabilities: list[tuple[float, float, float]], fps: float) -> list[tuple[int, int]]:
    """Best (frame, side) sequence under a least distance of half a second, alternating sides and a limit on hits.

    ``probabilities`` are (none, lower, upper) per window. Scores are what exceeds 0.9 of the
    mean score of sure hits, averaged over two windows. Nothing comes out if no window is a
    sure hit.
    """
    import numpy as np

    p = np.asarray(probabilities, float).reshape(-1, 3)
    sure = p[:, 0] < 0.1
    if not sure.any():
        return []
    n, apart = len(p), int(fps // 2)
    limit = int(1.2 * n // fps)
    gain = p - 0.9 * p[sure, 1:3].mean()
    gain[1:] = (gain[1:] + gain[:-1]) / 2
    gain[0] /= 2
    # value[i][j][k]: the best of the first i windows with j hits still to come and side k hit next
    value = np.full((n + apart, limit + 1, 2), -1e99)
    value[:apart] = 0
    hit = np.zeros((n + apart, limit + 1, 2), bool)
    for i in range(apart, n + apart):
        stay = np.maximum(value[i - 1, :limit], -1e99)
        take = value[i - apart, 1:, ::-1] + gain[i - apart, 1:]
        hit[i, :limit] = take >= stay
        value[i, :limit] = np.where(hit[i, :limit], take, stay)
    j, k = np.unravel_index(int(np.argmax(value[-1])), value[-1].shape)
    i, out = n + apart - 1, []
    while i >= apart:
        if hit[i, j, k]:
            out.append((i + 8 - apart, int(k) + 1))
            i, j, k = i - apart, j + 1, 1 - k
        else:
            i -= 1
    return [(f, s) for f, s in out[::-1] if 0 <= f]


def decode_votes(probabilities: list[tuple[float, float, float]], xs: list[float], low: float, high: float, fps: float, size: int = 12, threshold: float = 0.1) -> list[tuple[int, int]]:
    """(frame, side) of clusters of sure windows: within half a second of a cluster's first, none of it near or beyond the court's edges.

    A cluster's place is its median, its side that of most votes; a second hit of one side
    within 0.8 seconds of the last goes.
    """
    import numpy as np

    p = np.asarray(probabilities, float).reshape(-1, 3)
    clusters: list[list[int]] = []
    for t in np.flatnonzero(p[:, 0] < threshold).tolist():
        if clusters and clusters[-1][0] >= t - fps / 2:
            clusters[-1].append(t)
        else:
            clusters.append([t])
    edge = 0.1 * (high - low)
    out: list[tuple[int, int]] = []
    last, side = -1, -1
    for c in clusters:
        if any(not low + edge <= xs[t] <= high - edge for t in c):
            continue
        at, who = int(np.median(c) + size - 4), int(np.argmax(p[c].sum(axis=0)))
        if at - last < 0.8 * fps and who == side:
            continue
        out.append((at, who))
        last, side = at, who
    return out


def decode(windows: DataFrame, fps: float, mode: str = "dp", edges: tuple[float, float] | None = None) -> DataFrame:
    """(video, candidate_frame, side) out of rows of video, frame (contiguous), p0, p1, p2 and, for votes, x.

    The decoder sees a whole video at once, because its limit on hits does.
    """
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("frame", kind="stable")
        p = list(zip(pdf["p0"], pdf["p1"], pdf["p2"], strict=True))
        hits = decode_alternating(p, fps) if mode == "dp" else decode_votes(p, pdf["x"].tolist(), *edges, fps)
        start = int(pdf["frame"].iloc[0])
        kept = [(f, s) for f, s in hits if f < len(p) and s in (1, 2)]
        return pd.DataFrame({"video": [pdf["video"].iloc[0]] * len(kept), "candidate_frame": [start + f for f, _ in kept], "side": [s for _, s in kept]}, dtype=object)

    return windows.groupBy("video").applyInPandas(run, f"video {dict(windows.dtypes)['video']}, candidate_frame long, side int")
