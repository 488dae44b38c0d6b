"""Flat tables out of frames and events, and the report on a video's quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import filled, opposite, order_statistics, pose, ratio
from rallyline.operators.tracking import complete
from rallyline.schemas import EVENT, names

SHUTTLE_POINTS = {"raw": "raw_xy", "smoothed": "smoothed_xy", "associated": "associated_xy", "predicted": "predicted_xy"}
SHUTTLE_VALUES = [
    "innovation_px", "innovation_ratio", "adaptive_gate_px", "continuity_score", "hit_support_score", "hand_support_score", "pose_support_score",
    "association_score", "measurement_weight", "measurement_status", "tracking_uncertainty_px", "trajectory_reliability",
]


def text(c: Column, default: str = "unknown") -> Column:
    """Text, the default for null and empty."""
    return F.coalesce(filled(c), F.lit(default))


def frame_rows(frames: DataFrame) -> DataFrame:
    """A flat row per frame."""
    frames = complete(frames)
    s, out = F.col("shuttle"), [F.col(c) for c in ("video_id", "frame_idx", "timestamp_sec", "width", "height")]
    sides = {side: pose.of_side(F.col("players"), side) for side in ("upper", "lower")}
    out.append((sides["upper"].isNotNull() | sides["lower"].isNotNull()).alias("is_court_view"))
    for side, p in sides.items():
        out += [p[a].alias(f"{side}_{b}") for a, b in (("bbox_xyxy", "bbox"), ("keypoints_xy", "keypoints"), ("keypoint_scores", "keypoint_scores"), ("keypoint_missing", "keypoint_missing"))]
        x, y = pose.xy(F.col(f"player_tracks.{side}.court_xy_m"))
        out += [x.alias(f"{side}_court_x"), y.alias(f"{side}_court_y"), F.coalesce(F.col(f"player_tracks.{side}.state"), F.lit("missing")).alias(f"{side}_tracking_state")]
    for name, field in SHUTTLE_POINTS.items():
        x, y = pose.xy(s[field])
        out += [x.alias(f"shuttle_{name}_x"), y.alias(f"shuttle_{name}_y")]
    out += [
        s["confidence"].alias("shuttle_confidence"), F.coalesce(s["tracking_state"], s["state"], F.lit("unknown")).alias("shuttle_state"), s["track_version"].alias("shuttle_track_version"),
        F.coalesce(F.to_json(s["candidates"]), F.lit("[]")).alias("shuttle_candidates_json"), F.coalesce(s["detector_candidate_count"], F.lit(0)).alias("shuttle_detector_candidate_count"),
        s["selected_candidate_rank"].alias("shuttle_selected_candidate_rank"), *[s[v].alias(f"shuttle_{v}") for v in SHUTTLE_VALUES],
        text(F.col("play_state_gate_version")).alias("play_state_gate_version"), text(F.col("play_state")).alias("play_state"), F.col("play_state_segment_id"),
    ]
    for model in ("pose", "shuttle"):
        out += [F.col(f"models.{model}.family").alias(f"{model}_model_version"), F.col(f"models.{model}.weights_sha256").alias(f"{model}_weights_sha256")]
    return frames.select(*out)


def landing(df: DataFrame, axis: str, have: set[str]) -> Column:
    """A human value where the record has one (null as well, if the column ``human_landing_given`` says it was given), then the predicted and the raw one."""
    human, guess = F.col(f"human_landing_{axis}"), F.coalesce(F.col(f"predicted_landing_{axis}"), F.col(f"landing_{axis}"))
    if "human_landing_given" in have:
        return F.when(F.col("human_landing_given"), human).otherwise(guess)
    return F.coalesce(human, guess)


def event_rows(events: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """A flat row per event with its place in the rally, the players' places and the labels' priority."""
    have = set(events.columns)
    kinds = dict(events.sparkSession.createDataFrame([], EVENT).dtypes)
    e = events.select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in names(EVENT) if n not in have])
    e = e.withColumn("rally_id", text(F.col("rally_id")))
    if videos is None:
        e = e.withColumn("match_id", F.lit("unknown"))
    else:
        e = e.drop("match_id").join(F.broadcast(videos.select("video_id", text(F.col("match_id")).alias("match_id"))), "video_id", "left").withColumn("match_id", text(F.col("match_id")))
    order = Window.partitionBy("video_id", "rally_id").orderBy("candidate_time", "candidate_frame", "event_id")
    side, other = F.col("predicted_hitter"), opposite(F.col("predicted_hitter"))

    def place(s: Column) -> tuple[Column, Column]:
        at = F.when(s == "upper", F.col("player_locations.upper.court_xy_m")).when(s == "lower", F.col("player_locations.lower.court_xy_m"))
        return pose.xy(at)

    (px, py), (ox, oy), (sx, sy) = place(side), place(other), pose.xy(F.col("shuttle_image_xy"))
    plain = lambda *cs: [F.col(c) for c in cs]
    play = [n for n in names(EVENT) if n.startswith("play_state_") and n not in ("play_state_version", "play_state_filter_applied", "play_state_decision", "play_state_gate_version", "play_state_gate_applied", "play_state_gate_decision", "play_state_segment_id")]
    null = F.lit(None).cast("double")
    return e.select(
        "event_id", "video_id", "match_id", F.lit("unknown").alias("set_id"), "rally_id", F.row_number().over(order).cast("long").alias("stroke_index"),
        F.col("candidate_frame").alias("hit_frame"), F.col("candidate_time").alias("hit_time"), text(side).alias("player"),
        F.coalesce(filled(F.col("human_stroke_type"), F.col("predicted_stroke_type"), F.col("stroke_type")), F.lit("unknown")).alias("stroke_type"),
        "stroke_type_confidence", text(F.col("stroke_type_status")).alias("stroke_type_status"), "stroke_type_input_quality",
        text(F.col("stroke_type_source"), "unavailable").alias("stroke_type_source"), "stroke_type_raw_class", F.coalesce(F.to_json("stroke_type_top3"), F.lit("[]")).alias("stroke_type_top3_json"),
        "aroundhead", "backhand", px.alias("player_location_x"), py.alias("player_location_y"), ox.alias("opponent_location_x"), oy.alias("opponent_location_y"),
        null.alias("hit_x"), null.alias("hit_y"), landing(e, "x", have).alias("landing_x"), landing(e, "y", have).alias("landing_y"), "landing_frame",
        text(F.col("landing_kind")).alias("landing_kind"), "landing_confidence", text(F.col("landing_source"), "unavailable").alias("landing_source"),
        text(F.col("landing_status")).alias("landing_status"), text(F.col("landing_proxy_kind"), "unavailable").alias("landing_proxy_kind"), sx.alias("shuttle_image_x"), sy.alias("shuttle_image_y"),
        F.coalesce("shuttle_tracking_state", F.lit("unknown")).alias("shuttle_tracking_state"),
        *plain("window_start_frame", "window_end_frame", "trajectory_score", "trajectory_score_raw", "trajectory_tracking_reliability", "hand_distance_score", "pose_score", "event_confidence"),
        text(F.col("shuttle_measurement_status")).alias("shuttle_measurement_status"), "shuttle_measurement_weight", "shuttle_innovation_ratio",
        text(F.col("play_state_version")).alias("play_state_version"), F.coalesce("play_state_filter_applied", F.lit(False)).alias("play_state_filter_applied"),
        text(F.col("play_state_decision"), "not_available").alias("play_state_decision"), *plain(*play),
        text(F.col("play_state_gate_version")).alias("play_state_gate_version"), F.coalesce("play_state_gate_applied", F.lit(False)).alias("play_state_gate_applied"),
        text(F.col("play_state_gate_decision"), "not_available").alias("play_state_gate_decision"), "play_state_segment_id", text(F.col("label_source"), "machine_candidate").alias("label_source"),
        text(F.col("review_status"), "unreviewed").alias("annotation_status"),
        F.coalesce(filled(F.col("semantic_label_source"), F.col("label_source")), F.lit("machine_candidate")).alias("semantic_label_source"),
        F.coalesce(filled(F.col("semantic_review_status"), F.col("review_status")), F.lit("unreviewed")).alias("semantic_review_status"),
        text(F.col("model_version")).alias("model_version"), "calibration_version",
    )


def video_rows(frames: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """A row per video of the frames: what was registered, defaults for what was not."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    first = frames.select("video_id", F.row_number().over(w).alias("_k"), F.col("width").alias("_w"), F.col("height").alias("_h")).filter("_k = 1").drop("_k")
    if registered is None:
        registered = frames.sparkSession.createDataFrame([], "video_id string, path string, proxy_path string, checksum string, fps double, frame_count long, width long, height long, duration_sec double, match_id string, players struct<A: string, B: string>, domain string, redistribution string")
    known = registered.withColumn("_known", F.lit(True))
    v = first.join(F.broadcast(known), "video_id", "left")
    absent = F.col("_known").isNull()
    nobody = F.struct(F.lit("unknown").alias("A"), F.lit("unknown").alias("B"))
    return v.select(
        "video_id", "path", "proxy_path", "checksum", "fps", "frame_count", F.when(absent, F.col("_w")).otherwise(F.col("width")).alias("width"),
        F.when(absent, F.col("_h")).otherwise(F.col("height")).alias("height"), "duration_sec", text(F.col("match_id")).alias("match_id"),
        F.to_json(F.when(absent, nobody).otherwise(F.col("players"))).alias("players_json"), F.when(absent, F.lit("fixed-camera-singles")).otherwise(text(F.col("domain"))).alias("domain"),
        text(F.col("redistribution")).alias("redistribution"),
    )


def calibration_rows(calibrations: DataFrame) -> DataFrame:
    corners = F.transform("corners", lambda c: F.array(c["x"], c["y"]))
    return calibrations.select("calibration_id", "video_id", "version", "frame_time_ms", corners.alias("corners"), "homography", "court_orientation", "quality_status", "source")


def share(n: Column, of: Column) -> Column:
    return F.bround(ratio(n, of), 6)


def player_quality(side: str) -> list[Column]:
    state = F.col(f"{side}_tracking_state")
    seen = F.col(f"{side}_keypoint_missing")
    measured, predicted = F.count_if(state == "measured"), F.count_if(state == "predicted")
    total = F.count(F.lit(1))
    valid = F.sum(F.size(F.filter(seen, lambda m: ~m)))
    inside = F.col(f"_{side}_inside")
    return [
        measured.alias(f"{side}_measured_frames"), predicted.alias(f"{side}_predicted_frames"), F.count_if(state == "missing").alias(f"{side}_missing_frames"),
        share(measured + predicted, total).alias(f"{side}_tracking_coverage"), share(measured, total).alias(f"{side}_measured_rate"),
        share(F.count(F.col(f"_{side}_there")), total).alias(f"{side}_selected_pose_rate"), share(valid, F.sum(F.when(seen.isNotNull(), F.size(seen)))).alias(f"{side}_valid_keypoint_rate"),
        share(F.count_if(inside), F.count(inside)).alias(f"{side}_court_in_bounds_rate"),
    ]


def quality(frames: DataFrame, events: DataFrame) -> DataFrame:
    """A row per video of the frames: coverage, rates, percentiles and warnings, from frames and flat events."""
    frames = complete(frames)
    sides = {side: pose.of_side(F.col("players"), side) for side in ("upper", "lower")}
    flat = frame_rows(frames.select("*"))
    extra = frames.select("video_id", "frame_idx", *[c for s, p in sides.items() for c in (F.when(p.isNotNull(), 1).alias(f"_{s}_there"), p["court_in_bounds"].alias(f"_{s}_inside"))])
    f = flat.join(extra, ["video_id", "frame_idx"])
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    f = f.withColumn("_gap", F.col("timestamp_sec") - F.lag("timestamp_sec").over(w))
    state, status, total = F.col("shuttle_state"), F.coalesce("shuttle_measurement_status", F.lit("unknown")), F.count(F.lit(1))
    measured, predicted = F.count_if(state == "measured"), F.count_if(state == "predicted")
    last_gap = F.max_by("_gap", "frame_idx")
    version = F.min_by("shuttle_track_version", F.when(F.col("shuttle_track_version").isNotNull(), F.col("frame_idx")))
    q = f.groupBy("video_id").agg(
        total.alias("frames"), F.when(total > 1, F.max("timestamp_sec") - F.min("timestamp_sec") + last_gap).otherwise(0.0).alias("_duration"), *player_quality("upper"), *player_quality("lower"),
        measured.alias("shuttle_measured_frames"), predicted.alias("shuttle_predicted_frames"), F.count_if(state.isin("missing", "not_run", "unknown")).alias("shuttle_missing_frames"),
        share(F.count("shuttle_raw_x"), total).alias("raw_detection_rate"), share(measured + predicted, total).alias("track_coverage"), version.alias("track_version"),
        F.count_if(status == "soft_suppressed").alias("soft_suppressed_frames"), F.count_if(F.col("shuttle_selected_candidate_rank") != 0).alias("selected_non_primary_frames"),
        F.count_if(F.col("shuttle_detector_candidate_count") > 1).alias("multi_candidate_frames"),
        *[F.count_if(F.col("play_state") == p).alias(f"{p}_frames") for p in ("active_play", "inactive_wait", "not_gated")],
    )
    for value, wanted in {
        "shuttle_innovation_ratio": {"innovation_ratio_p95": (0.95, "nearest"), "innovation_ratio_p99": (0.99, "nearest")},
        "shuttle_tracking_uncertainty_px": {"tracking_uncertainty_px_median": (0.5, "nearest")},
    }.items():
        q = q.join(order_statistics(flat.select("video_id", value), ["video_id"], value, wanted), "video_id", "left").withColumns({n: F.bround(n, 6) for n in wanted})
    e = events.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_distinct("rally_id").alias("rally_candidate_count"), F.count_if("play_state_filter_applied").alias("play_state_filter_applied_count"),
        F.count_if("play_state_gate_applied").alias("play_state_gate_applied_count"), F.count_if(F.coalesce(filled(F.col("stroke_type")), F.lit("unknown")) != "unknown").alias("_typed"),
        F.count_if(F.col("landing_x").isNotNull() & F.col("landing_y").isNotNull()).alias("_landed"),
        F.count_if((F.col("semantic_label_source") == "human_semantic_gold") & (F.col("semantic_review_status") == "confirmed")).alias("_confirmed"),
    )
    for value, name in (("event_confidence", "confidence"), ("play_state_score", "play_state_score")):
        wanted = {f"{name}_p25": (0.25, "nearest"), f"{name}_median": (0.5, "nearest"), f"{name}_p75": (0.75, "nearest")}
        e = e.join(order_statistics(events.select("video_id", value), ["video_id"], value, wanted), "video_id", "left").withColumns({n: F.bround(n, 6) for n in wanted})
    q = q.join(e, "video_id", "left")
    counts = ["candidate_count", "rally_candidate_count", "play_state_filter_applied_count", "play_state_gate_applied_count", "_typed", "_landed", "_confirmed"]
    q = q.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    n = F.col("candidate_count")
    q = q.withColumn("candidate_rate_per_min", F.when(F.col("_duration") > 0, F.bround(n * 60 / F.col("_duration"), 3)))
    for name, c in (("stroke_type_prediction_coverage", "_typed"), ("destination_prediction_coverage", "_landed"), ("semantic_gold_confirmation_coverage", "_confirmed")):
        q = q.withColumn(name, share(F.col(c), n))
    q = q.withColumn("active_play_frame_rate", share(F.col("active_play_frames"), F.col("frames"))).withColumn("processed_duration_sec", F.bround("_duration", 3))
    said = []
    for side in ("upper", "lower"):
        said += [(F.col(f"{side}_tracking_coverage") < 0.9, f"{side} player tracking coverage is below 90%"), (F.col(f"{side}_court_in_bounds_rate") < 0.9, f"{side} player court in-bounds rate is below 90%")]
    said += [
        (F.col("track_coverage") < 0.8, "shuttle track coverage is below 80%"), (n == 0, "no hit candidates were generated"),
        (F.col("_typed") < n, "stroke-type prediction coverage is incomplete"), (F.col("_landed") < n, "destination prediction coverage is incomplete, including terminal strokes"),
        (F.col("_confirmed") < n, "semantic rows are automatic prelabels, not confirmed ground truth"),
    ]
    q = q.withColumn("warnings", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in said]), lambda t: t.isNotNull()))
    return q.withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("ok")).drop("_duration", "_typed", "_landed", "_confirmed")


def review_feed(events: DataFrame, rally: str = "Model pilot") -> tuple[DataFrame, DataFrame]:
    """(rows of the review feed, its range of source frames)."""
    rows = events.select(
        F.format_string("EVT-M%05d", "candidate_frame").alias("id"), F.coalesce("rally_id", F.lit(rally)).alias("rally"), F.col("candidate_time").alias("time"),
        F.when(F.col("predicted_hitter") == "upper", "A").otherwise("B").alias("hitter"), F.col("predicted_hitter").alias("hitter_side"), F.lit("待标注").alias("stroke"),
        *[F.bround(c, 3).alias(n) for c, n in (("event_confidence", "confidence"), ("trajectory_score", "trajectory"), ("hand_distance_score", "wrist"), ("pose_score", "pose"))],
        F.lit("unreviewed").alias("status"),
    )
    span = events.agg(F.coalesce(F.min("window_start_frame"), F.lit(0)).alias("start"), (F.coalesce(F.max("window_end_frame"), F.lit(0)) + 1).alias("end_exclusive"))
    return rows, span
