"""Hit candidates: scores out of three neighbouring frames, peaks, separation, hitters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import frames_of, pose
from rallyline.operators.tracking import broken

#: Least score, seconds between hits, seconds around a hit where its hitter is looked for.
THRESHOLD, SEPARATION, HITTER_WINDOW = 0.38, 0.4, 2 / 30


def turn(v1: tuple[Column, Column], v2: tuple[Column, Column], s1: Column, s2: Column) -> Column:
    """Angle between two steps as a share of a half turn; 0 where either step is under 0.3."""
    cosine = (v1[0] * v2[0] + v1[1] * v2[1]) / (s1 * s2)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when((s1 < 0.3) | (s2 < 0.3), 0.0).otherwise(F.acos(cosine) / math.pi)


def speed_change(s1: Column, s2: Column) -> Column:
    return F.abs(s2 - s1) / F.greatest(s1, s2, F.lit(1.0))


def trajectory(angle: Column, change: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 * angle + 0.3 * change)


def event_confidence(track: Column, hand: Column, swing: Column) -> Column:
    return 0.52 * track + 0.33 * hand + 0.15 * swing


def contact_point(shuttle: Column) -> Column:
    """The detection that the filter accepted, else the smoothed point."""
    accepted = shuttle["measurement_status"].isin("initialized", "accepted") & (F.coalesce(F.size(shuttle["associated_xy"]), F.lit(0)) >= 2)
    return F.when(F.coalesce(accepted, F.lit(False)), shuttle["associated_xy"]).otherwise(shuttle["smoothed_xy"])


def score(frames: DataFrame, fps: float) -> DataFrame:
    """A row per frame that has a place for the shuttle in itself and both neighbours, none of them across a gap."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    keep = ["video_id", "frame_idx", "timestamp_sec", "width", "height", "players", "player_tracks", "shuttle"]
    near = frames.select(
        *keep, F.lag("frame_idx").over(w).alias("f0"), F.lead("frame_idx").over(w).alias("f2"), F.lag("shuttle").over(w).alias("sh0"), F.lead("shuttle").over(w).alias("sh2"),
        F.lag("players").over(w).alias("pl0"), F.lead("players").over(w).alias("pl2"),
    )
    near = near.filter((F.col("frame_idx") - F.col("f0") <= broken(fps)) & (F.col("f2") - F.col("frame_idx") <= broken(fps)))
    points = {i: F.col(f"{c}.smoothed_xy") for i, c in ((0, "sh0"), (1, "shuttle"), (2, "sh2"))}
    near = near.filter(points[0].isNotNull() & points[1].isNotNull() & points[2].isNotNull())
    step = lambda a, b: tuple(F.get(points[b], k) - F.get(points[a], k) for k in (0, 1))
    v1, v2 = step(0, 1), step(1, 2)
    near = near.withColumn("_s1", F.hypot(*v1)).withColumn("_s2", F.hypot(*v2))
    s1, s2 = F.col("_s1"), F.col("_s2")
    sure = F.least(*[F.coalesce(F.col(f"{c}.trajectory_reliability"), F.lit(1.0)) for c in ("sh0", "shuttle", "sh2")])
    diagonal = F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))
    near = near.withColumn("trajectory_score_raw", trajectory(turn(v1, v2, s1, s2), speed_change(s1, s2))).withColumn("trajectory_tracking_reliability", sure)
    near = near.withColumn("trajectory_score", F.col("trajectory_score_raw") * (0.35 + 0.65 * F.col("trajectory_tracking_reliability")))
    near = near.withColumn("shuttle_image_xy", contact_point(F.col("shuttle"))).withColumn("_d", diagonal)
    near = near.withColumn("_hand", pose.nearest_wrist(F.col("players"), F.col("shuttle_image_xy")))
    near = near.withColumn("hand_distance_score", F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.col("_hand.distance") / (F.col("_d") * 0.09)), F.lit(0.0)))
    near = near.withColumn("pose_score", F.least(F.lit(1.0), pose.wrist_motion(F.col("pl0"), F.col("pl2")) / (F.col("_d") * 0.035)))
    confidence = event_confidence(F.col("trajectory_score"), F.col("hand_distance_score"), F.col("pose_score"))
    s = F.col("shuttle")
    return near.select(
        "video_id", "frame_idx", "timestamp_sec", F.col("_hand.identity").alias("predicted_hitter"), "trajectory_score", "trajectory_score_raw", "trajectory_tracking_reliability",
        "hand_distance_score", "pose_score", confidence.alias("event_confidence"), F.col("player_tracks").alias("player_locations"), "shuttle_image_xy",
        s["smoothed_xy"].alias("shuttle_track_xy"), F.coalesce(s["tracking_state"], F.lit("unknown")).alias("shuttle_tracking_state"),
        F.coalesce(s["measurement_status"], F.lit("unknown")).alias("shuttle_measurement_status"), s["measurement_weight"].alias("shuttle_measurement_weight"),
        s["innovation_ratio"].alias("shuttle_innovation_ratio"),
    )


def assign_hitters(scored: DataFrame, window: int) -> DataFrame:
    """``hitter``: struct of hitter, frame and hand score of the best hand evidence within ``window`` frames.

    The highest hand score wins, then the nearest frame, then the surest and then the
    earliest. Without evidence a row keeps its own.
    """
    row = F.struct("frame_idx", "hand_distance_score", "event_confidence", "predicted_hitter")
    evidence = F.when(F.col("predicted_hitter").isNotNull() & (F.col("hand_distance_score") > 0), row)
    w = Window.partitionBy("video_id").orderBy("frame_idx").rangeBetween(-window, window)
    out = scored.withColumn("_near", F.collect_list(evidence).over(w))
    base = F.col("frame_idx")
    ranked = F.transform("_near", lambda r: F.struct(
        r["hand_distance_score"].alias("a"), (-F.abs(r["frame_idx"] - base)).alias("b"), r["event_confidence"].alias("c"), (-r["frame_idx"]).alias("d"), r["predicted_hitter"].alias("hitter")))
    best = F.array_max(ranked)
    own = F.struct(F.col("predicted_hitter").alias("hitter"), base.alias("frame"), F.col("hand_distance_score").alias("hand"))
    found = F.struct(best["hitter"].alias("hitter"), (-best["d"]).alias("frame"), best["a"].alias("hand"))
    return out.withColumn("hitter", F.when(F.size("_near") > 0, found).otherwise(own)).drop("_near")


def separate(rows: DataFrame, key: list[str], at: str, value: str, gap: int, tie: str | None = None) -> DataFrame:
    """Greedy suppression in order: a row nearer than ``gap`` to the last kept replaces it if greater, else goes.

    Rows are first cut where neighbours lie ``gap`` apart, for no row acts across such a
    cut; each run is folded by an expression, so a video of any length is many small folds.
    """
    tie = tie or at
    w = Window.partitionBy(*key).orderBy(at, tie)
    out = rows.withColumn("_cut", F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(1)))
    out = out.withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = out.groupBy(*key, "_run").agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value")))).alias("_rows"))
    none = F.slice("_rows", 1, 0)

    def step(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        close = F.coalesce(r["at"] - last["at"] < gap, F.lit(False))
        better = r["value"] > last["value"]
        return F.when(close & better, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(r))).when(close, kept).otherwise(F.concat(kept, F.array(r)))

    kept = runs.select(*key, F.explode(F.aggregate("_rows", none, step)).alias("_k"))
    kept = kept.select(*key, F.col("_k.at").alias(at), *([] if tie == at else [F.col("_k.tie").alias(tie)]))
    return rows.join(kept, [*key, at, *([] if tie == at else [tie])], "left_semi")


def candidates(scored: DataFrame, fps: float, threshold: float = THRESHOLD, separation: int | None = None, window: int | None = None) -> DataFrame:
    """Local maxima over two scored rows either side that reach the threshold, kept apart, with their hitter and window."""
    separation = frames_of(SEPARATION, fps, 1) if separation is None else separation
    window = frames_of(HITTER_WINDOW, fps) if window is None else window
    around = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(-2, 2)
    peaks = assign_hitters(scored, window).withColumn("_top", F.max("event_confidence").over(around))
    peaks = peaks.filter((F.col("event_confidence") >= threshold) & (F.col("event_confidence") >= F.col("_top"))).drop("_top")
    kept = separate(peaks, ["video_id"], "frame_idx", "event_confidence", separation)
    reach = round(fps * 1.5)
    out = kept.withColumn("event_id", F.format_string("evt_%08d", "frame_idx")).withColumn("window_start_frame", F.greatest(F.lit(0), F.col("frame_idx") - reach))
    out = out.withColumn("window_end_frame", F.col("frame_idx") + reach).withColumn("predicted_hitter", F.col("hitter.hitter"))
    out = out.withColumn("hitter_assignment_method", F.lit("max_hand_proximity_window")).withColumn("hitter_assignment_frame", F.col("hitter.frame"))
    out = out.withColumn("hitter_assignment_offset_frames", F.col("hitter.frame") - F.col("frame_idx")).withColumn("hitter_assignment_hand_score", F.col("hitter.hand"))
    out = out.withColumn("review_status", F.lit("unreviewed")).withColumn("label_source", F.lit("machine_candidate"))
    return out.drop("hitter").withColumnRenamed("frame_idx", "candidate_frame").withColumnRenamed("timestamp_sec", "candidate_time")
