"""Windows of frames around events as nested arrays with masks, for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import COURT_L, COURT_W, filled, geometry, opposite, pose
from rallyline.operators import sequence

#: Length of a stroke's clip, frames at its ends without a neighbour, and pairs of joints of its bones.
CLIP, SHOULDER = 100, 30
BONES = (
    (0, 1), (0, 2), (1, 2), (1, 3), (2, 4),
    (3, 5), (4, 6), (5, 7), (7, 9), (6, 8), (8, 10),
    (5, 6), (5, 11), (6, 12), (11, 12),
    (11, 13), (13, 15), (12, 14), (14, 16),
)


def clip_bounds(events: DataFrame, first: Column, last: Column, shoulder: int = SHOULDER) -> DataFrame:
    """``clip_start`` and ``clip_end``: midpoints to the neighbours in the rally, clamped to the frames there are."""
    w = Window.partitionBy("video_id", F.coalesce("rally_id", F.lit(""))).orderBy("candidate_frame", "event_id")
    at, before, after = F.col("candidate_frame"), F.lag("candidate_frame").over(w), F.lead("candidate_frame").over(w)
    out = events.withColumn("_a", F.coalesce(F.floor((before + at) / 2), at - shoulder)).withColumn("_z", F.coalesce(F.floor((at + after) / 2), at + shoulder))
    out = out.withColumn("clip_start", F.greatest("_a", first)).withColumn("_z", F.least("_z", last))
    return out.withColumn("clip_end", F.greatest("clip_start", "_z")).drop("_a", "_z")


def strided(start: Column, end: Column, target: int = CLIP) -> Column:
    """At most ``target`` frame numbers from start to end, evenly apart."""
    n = F.greatest(F.lit(1), end - start + 1)
    step = F.floor(n / target) + (n % target > target // 2).cast("long")
    return F.when(n <= target, F.sequence(start, end)).otherwise(F.slice(F.sequence(start, end, F.greatest(F.lit(1).cast("long"), step)), 1, target))


def dense_window(events: DataFrame, frames: DataFrame, size: int, values: list[str], start: Column | None = None) -> DataFrame:
    """Per event, ``size`` slots from ``start`` on (half the size before its frame): frame number, mask and the frame's values."""
    start = F.col("candidate_frame") - size // 2 if start is None else start
    slots = events.select("video_id", "event_id", F.posexplode(F.sequence(start, start + size - 1)).alias("slot", "frame_idx"))
    rows = slots.join(frames.select("video_id", "frame_idx", F.lit(True).alias("_there"), *values), ["video_id", "frame_idx"], "left")
    one = F.struct("slot", "frame_idx", F.coalesce("_there", F.lit(False)).alias("mask"), *values)
    return rows.groupBy("video_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("slot", one.alias("v")))).alias("_w")).select("video_id", "event_id", F.transform("_w", lambda r: r["v"]).alias("window"))


def court_share(side: Column) -> Column:
    """A side's court position (track, else pose) in units of the court, null without any."""
    out = F.lit(None).cast("array<double>")
    for s in ("upper", "lower"):
        at = F.coalesce(F.col(f"player_tracks.{s}.court_xy_m"), pose.of_side(F.col("players"), s)["court_xy_m"])
        out = F.when((side == s) & (F.size(at) == 2), F.array(F.get(at, 0) / COURT_W, F.get(at, 1) / COURT_L)).otherwise(out)
    return out


def label_of(events: DataFrame) -> Column:
    """The first label that is not blank: human, given, predicted; else ``unknown``."""
    have = [c for c in ("human_stroke_type", "stroke_type", "predicted_stroke_type") if c in events.columns]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in have], F.lit("unknown"))


def stroke_samples(frames: DataFrame, events: DataFrame, size: int = 30, least: float = pose.LEAST_SCORE) -> DataFrame:
    """A row per event: label, hitter, landing, and a slot per frame of its window with pose, skeleton, shuttle and places.

    Values of a slot are null where the frame, the joint or the point is not valid; nothing
    is made up. Events of neither side raise an error.
    """
    hitter = filled(*[F.col(c) for c in ("human_hitter", "predicted_hitter") if c in events.columns])
    hitter = F.when(hitter.isin("upper", "lower"), hitter).otherwise(F.raise_error(F.lit("an event must name upper or lower as its hitter")).cast("string"))
    e = events.withColumn("hitter", hitter)
    start = F.col("candidate_frame") - size // 2
    slots = e.select("video_id", "event_id", "hitter", F.posexplode(F.sequence(start, start + size - 1)).alias("slot", "frame_idx"))
    rows = slots.join(frames.select("video_id", "frame_idx", "width", "height", "players", "shuttle", "player_tracks", F.lit(True).alias("_there")), ["video_id", "frame_idx"], "left")
    p = F.when(F.col("hitter") == "upper", pose.of_side(F.col("players"), "upper")).otherwise(pose.of_side(F.col("players"), "lower"))
    rows = rows.withColumn("_p", p)
    wide, high = (F.greatest(F.lit(1.0), F.coalesce(c, F.lit(1)).cast("double")) for c in ("width", "height"))
    whole = F.size("_p.keypoints_xy") == pose.JOINTS
    whole = F.when(F.col("_p").isNotNull() & ~F.coalesce(whole, F.lit(False)), F.raise_error(F.lit("a hitter's pose must have 17 keypoints")).cast("boolean")).otherwise(F.col("_p").isNotNull())
    points = F.array(*[F.when(pose.keypoint(F.col("_p"), i, least).isNotNull(), F.array(F.get(pose.keypoint(F.col("_p"), i, least), 0) / wide, F.get(pose.keypoint(F.col("_p"), i, least), 1) / high)) for i in range(pose.JOINTS)])
    rows = rows.withColumn("_points", F.when(whole, points)).withColumn("_mask", F.transform("_points", lambda q: q.isNotNull()))
    shuttle = F.col("shuttle.smoothed_xy")
    seen = F.size(shuttle) == 2
    one = F.struct(
        "frame_idx", F.coalesce("_there", F.lit(False)).alias("frame_mask"), F.col("_points").alias("pose_xy"), F.col("_p.keypoint_scores").alias("pose_confidence"), F.col("_mask").alias("pose_mask"),
        F.when(F.col("_points").isNotNull(), pose.masked_edges(F.col("_points"), F.col("_mask"))).alias("skeleton_vectors"),
        F.when(seen, F.array(F.get(shuttle, 0) / wide, F.get(shuttle, 1) / high)).alias("shuttle_xy"), F.col("shuttle.confidence").alias("shuttle_confidence"),
        F.coalesce(seen & (F.col("shuttle.tracking_state") == "measured"), F.lit(False)).alias("shuttle_measured"),
        court_share(F.col("hitter")).alias("hitter_court_xy"), court_share(opposite(F.col("hitter"))).alias("opponent_court_xy"),
    )
    windows = rows.groupBy("video_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("slot", one.alias("v")))).alias("_w"))
    windows = windows.select("video_id", "event_id", F.transform("_w", lambda r: r["v"]).alias("window"))
    have = set(e.columns)
    pick = lambda axis: F.coalesce(*[F.col(c) for c in (f"human_landing_{axis}", f"landing_{axis}") if c in have], F.lit(None).cast("double"))
    kind = F.coalesce(F.col("landing_kind"), F.lit("unknown")) if "landing_kind" in have else F.lit("unknown")
    own = e.select("video_id", "event_id", "candidate_frame", "hitter", label_of(e).alias("label"), pick("x").alias("landing_x"), pick("y").alias("landing_y"), kind.alias("landing_kind"))
    return own.join(windows, ["video_id", "event_id"])


def coverage(samples: DataFrame) -> DataFrame:
    """Means of the samples' masks, in one row."""
    s = samples.select(F.explode("window").alias("s"), (F.col("landing_x").isNotNull() & F.col("landing_y").isNotNull()).cast("double").alias("l"), F.size("window").alias("n"))
    mean = lambda c: F.avg(c.cast("double"))
    joints = F.coalesce(F.size(F.filter("s.pose_mask", lambda m: m)), F.lit(0)) / pose.JOINTS
    joints = F.when(F.col("s.pose_mask").isNull(), 0.0).otherwise(joints)
    return s.agg(
        mean(F.col("s.frame_mask")).alias("frame"), F.avg(joints).alias("pose_keypoint"), mean(F.col("s.shuttle_xy").isNotNull()).alias("shuttle"), mean(F.col("s.shuttle_measured")).alias("shuttle_measured"),
        mean(F.col("s.hitter_court_xy").isNotNull()).alias("hitter_position"), mean(F.col("s.opponent_court_xy").isNotNull()).alias("opponent_position"), F.avg("l").alias("landing_target"),
    )


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def clip_inputs(frames: DataFrame, events: DataFrame, least: float = pose.LEAST_SCORE) -> DataFrame:
    """A row per event: its clip's joints and bones of both sides, places, shuttle, length and input quality.

    Quality is the mean over the requested frames of the lesser pose coverage, 0 where the
    frame or the shuttle is missing.
    """
    ends = frames.groupBy("video_id").agg(F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("_last"))
    e = clip_bounds(events.join(F.broadcast(ends), "video_id"), F.col("_first"), F.col("_last"))
    e = e.withColumn("indices", strided(F.col("clip_start"), F.col("clip_end")))
    length = F.greatest(F.lit(1), F.col("clip_end") - F.col("clip_start") + 1)
    e = e.withColumn("video_length", F.when(length <= CLIP, length).otherwise(F.size("indices")))
    slots = e.select("video_id", "event_id", F.posexplode("indices").alias("slot", "frame_idx"))
    rows = slots.join(frames.select("video_id", "frame_idx", "width", "height", "players", "shuttle", "player_tracks", F.lit(True).alias("_there")), ["video_id", "frame_idx"], "left")
    for s in ("upper", "lower"):
        rows = rows.withColumn(f"_{s}", F.when(pose.of_side(F.col("players"), s).isNotNull(), pose.normalised_pose(pose.of_side(F.col("players"), s), least)))
    wide, high = (F.greatest(F.lit(1.0), F.coalesce(c, F.lit(1)).cast("double")) for c in ("width", "height"))
    at = F.col("shuttle.smoothed_xy")
    seen = F.coalesce(F.size(at) == 2, F.lit(False))
    covered = F.least(*[F.coalesce(f"_{s}.coverage", F.lit(0.0)) for s in ("upper", "lower")])
    zeros = F.array(*[F.array(F.lit(0.0), F.lit(0.0))] * pose.JOINTS)
    sides = [F.coalesce(F.col(f"_{s}.points"), zeros) for s in ("upper", "lower")]
    one = F.struct(
        F.array(*sides).alias("joints"), F.array(*[pose.bones(p, BONES) for p in sides]).alias("bones"), F.array(court_share(F.lit("upper")), court_share(F.lit("lower"))).alias("positions"),
        F.when(seen, F.array(F.get(at, 0) / wide, F.get(at, 1) / high)).alias("shuttle"),
    )
    got = rows.groupBy("video_id", "event_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", one.alias("v")))).alias("_w"), (F.sum(covered * seen.cast("double")) / F.count(F.lit(1))).alias("sample_quality"),
    )
    got = got.select("video_id", "event_id", F.transform("_w", lambda r: r["v"]).alias("clip"), "sample_quality")
    return e.select("video_id", "event_id", "candidate_frame", "clip_start", "clip_end", "video_length").join(got, ["video_id", "event_id"])


def limited_windows(events: DataFrame, fps: int, first: Column, end: Column) -> DataFrame:
    """``start_frame`` and ``end_frame_exclusive`` between the neighbouring hits, with limits; neighbours over six seconds off don't count."""
    half, limit = fps // 2, fps * 3 // 2
    more = half // 2
    w = Window.partitionBy("video_id").orderBy("candidate_frame", "event_id")
    at, before, after = F.col("candidate_frame"), F.lag("candidate_frame").over(w), F.lead("candidate_frame").over(w)
    out = events.withColumn("_b", F.when(at - before <= 6 * fps, before)).withColumn("_n", F.when(after - at <= 6 * fps, after))
    start = F.greatest(first, at - limit, F.coalesce(F.col("_b"), at - half))
    stop = F.least(end, at + limit + more, F.coalesce(F.col("_n") + more, at + half))
    return out.withColumn("start_frame", start).withColumn("end_frame_exclusive", stop).drop("_b", "_n")


def frame_features(frames: DataFrame, corners: Column) -> DataFrame:
    """78 numbers per frame: the shuttle, the lower and the upper player's joints (0 where missing) and the corners."""
    zero = F.lit(0.0)
    clean = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), zero).otherwise(v)
    out = [clean(F.get(F.when(F.size("shuttle.smoothed_xy") == 2, F.col("shuttle.smoothed_xy")), k)) for k in (0, 1)]
    for side in ("lower", "upper"):
        p = pose.of_side(F.col("players"), side)
        for i in range(pose.JOINTS):
            out += [clean(F.when(~F.coalesce(F.get(p["keypoint_missing"], i), F.lit(False)), F.get(F.get(p["keypoints_xy"], i), k))) for k in (0, 1)]
    for i in (1, 3, 0, 2):
        out += [clean(geometry.at(corners, i, k)) for k in (0, 1)]
    return frames.select("video_id", "frame_idx", F.array(*out).alias("features"))


def scale_features(rows: DataFrame, key: list[str], features: str = "features", zero: float = 1e-6) -> DataFrame:
    """Features of each parity scaled to 1..2 over the key's rows; values near 0 are missing and stay."""
    def part(parity: int) -> Column:
        return F.filter(F.transform(features, lambda v, i: F.when((i % 2 == parity) & (F.abs(v) >= zero), v)), lambda v: v.isNotNull())

    ends = []
    for parity in (0, 1):
        ends += [F.min(F.array_min(part(parity))).alias(f"_lo{parity}"), F.max(F.array_max(part(parity))).alias(f"_hi{parity}")]
    stats = rows.groupBy(*key).agg(*ends)

    def scaled(v: Column, i: Column) -> Column:
        lo, hi = (F.when(i % 2 == 0, F.col(f"_{e}0")).otherwise(F.col(f"_{e}1")) for e in ("lo", "hi"))
        return F.when(F.abs(v) >= zero, (v - lo) / F.greatest(hi - lo, F.lit(zero)) + 1).otherwise(v)

    out = rows.join(F.broadcast(stats), key)
    return out.withColumn(features, F.transform(features, scaled)).drop("_lo0", "_hi0", "_lo1", "_hi1")


def contiguous(frames: DataFrame, key: list[str], at: str, start: int | None = None) -> DataFrame:
    """Per key, whether every row follows the one before by 1 (and the first is at ``start``)."""
    step = F.col(at) - F.lag(at).over(sequence.by(key, at))
    rows = frames.withColumn("_s", step)
    ok = F.coalesce(F.bool_and(F.col("_s") == 1), F.lit(True))
    return rows.groupBy(*key).agg((ok if start is None else ok & (F.min(at) == start)).alias("contiguous"))


def feature_windows(rows: DataFrame, key: list[str], at: str, features: str, gold: DataFrame | None = None, size: int = 12, late: int = 6) -> DataFrame:
    """Windows of ``size`` contiguous frames; with gold (key, hit_frame, hitter) also their label: 1 lower, 2 upper, 0 none, -1 several."""
    label = F.lit(0)
    if gold is not None:
        g = gold.select(*key, F.col("hit_frame").alias(at), F.when(F.col("hitter") == "lower", 1).when(F.col("hitter") == "upper", 2).otherwise(F.raise_error(F.lit("a gold hit needs a known hitter")).cast("int")).alias("_l"))
        rows = rows.join(g, [*key, at], "left")
        label = F.coalesce("_l", F.lit(0))
    return sequence.labelled_windows(rows.withColumn("_label", label), key, at, features, "_label", size, late).drop("_label", "_l")


