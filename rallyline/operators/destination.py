"""Where a stroke goes: the next contact by fused evidence, or the end of the last track of a rally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import filled, geometry, pose

#: Frames around a contact, frames after a last hit that are searched, metres at which ball and receiver are fused.
RADIUS, TERMINAL, NEAR = 3, 75, 1.8
#: Joins of frames and of rows by frame are merges: these repeat an event up to TERMINAL times, take little room when
#: shuffled, and would overflow the driver if they were broadcast by that size.
MERGE = "merge"


def shuttle_evidence(shuttle: Column) -> tuple[Column, Column]:
    """The shuttle's point (the associated one, else the smoothed one) and the confidence in it."""
    point = F.coalesce(shuttle["associated_xy"], shuttle["smoothed_xy"])
    sure = F.coalesce(shuttle["trajectory_reliability"], F.lit(0.0)) * F.exp(-F.coalesce(shuttle["innovation_ratio"], F.lit(0.0)))
    sure = sure * F.when(shuttle["tracking_state"] == "measured", 1.0).otherwise(0.55)
    point = F.when(F.size(point) == 2, point)
    return point, F.when(point.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.0)


def receiver(side: Column) -> tuple[Column, Column]:
    """Court position of a side in a frame (its track, else its pose) and the confidence in it: 0.62 measured, 0.42 otherwise."""
    point = confidence = F.lit(None)
    for s in ("upper", "lower"):
        track, seen = F.col(f"player_tracks.{s}"), pose.of_side(F.col("players"), s)["court_xy_m"]
        at = F.coalesce(track["court_xy_m"], seen)
        measured = F.when(track["court_xy_m"].isNotNull(), track["state"] == "measured").otherwise(True)
        point = F.when(side == s, F.when(F.size(at) == 2, at)).otherwise(point)
        confidence = F.when(side == s, F.when(F.size(at) == 2, F.when(F.coalesce(measured, F.lit(False)), 0.62).otherwise(0.42)).otherwise(0.0)).otherwise(confidence)
    return point, F.coalesce(confidence.cast("double"), F.lit(0.0))


def followers(events: DataFrame) -> DataFrame:
    """Events with the frame and the hitter of the next one of their rally."""
    rally = F.coalesce("rally_id", F.lit(""))
    w = Window.partitionBy("video_id", rally).orderBy("candidate_frame", "event_id")
    hitter = filled(*([F.col("human_hitter")] if "human_hitter" in events.columns else []), F.col("predicted_hitter"))
    return events.withColumn("_target", F.lead("candidate_frame").over(w)).withColumn("_receiver", F.lead(hitter).over(w))


def nearest_evidence(events: DataFrame, frames: DataFrame, target: str, radius: int = RADIUS) -> DataFrame:
    """video_id, event_id and the best shuttle evidence within ``radius`` frames of the target: 0.02 off per frame; the earliest of equals."""
    point, sure = shuttle_evidence(F.col("shuttle"))
    f = frames.select("video_id", "frame_idx", point.alias("_point"), sure.alias("_sure")).filter(F.col("_point").isNotNull())
    e = events.filter(F.col(target).isNotNull()).select("video_id", "event_id", F.col(target).alias("_t"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_o"))
    e = e.withColumn("frame_idx", F.col("_t") + F.col("_o"))
    got = e.join(f.hint(MERGE), ["video_id", "frame_idx"]).withColumn("_score", F.col("_sure") - 0.02 * F.abs("_o"))
    best = F.max(F.struct(F.col("_score"), (-F.col("_o")).alias("_n"), F.col("frame_idx"), F.col("_point")))
    got = got.groupBy("video_id", "event_id").agg(best.alias("_b"))
    return got.select("video_id", "event_id", F.col("_b._score").alias("ball_score"), F.col("_b.frame_idx").alias("ball_frame"), F.col("_b._point").alias("ball_point"))


def terminal(events: DataFrame, frames: DataFrame, h: Column, search: int = TERMINAL) -> DataFrame:
    """video_id, event_id, frame, x, y, confidence of the last reliable point of a rally's last track, where its end is evident.

    The rows after the hit are followed up to ``search`` frames and, for an event of an
    active segment, from where that segment's rows begin to where they end. The last point
    on the court, four or more frames after the hit, counts if the segment ended or three
    rows without a point follow at once, and if the image has not been falling before.
    """
    point, sure = shuttle_evidence(F.col("shuttle"))
    x, y = geometry.project(h, F.get(point, 0), F.get(point, 1), "null")
    f = frames.select("video_id", "frame_idx", F.col("play_state_segment_id").alias("_fs"), F.get(point, 1).alias("_iy"), point.isNotNull().alias("_has"), sure.alias("_sure"), x.alias("_x"), y.alias("_y"))
    e = events.select("video_id", "event_id", F.col("candidate_frame").alias("_hit"), F.col("play_state_segment_id").alias("_es"))
    e = e.withColumn("frame_idx", F.explode(F.sequence(F.col("_hit") + 1, F.col("_hit") + search)))
    rows = e.join(f.hint(MERGE), ["video_id", "frame_idx"])
    w = Window.partitionBy("video_id", "event_id").orderBy("frame_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same = F.coalesce(F.col("_fs") == F.col("_es"), F.lit(False))
    rows = rows.withColumn("_in", F.max(same.cast("int")).over(upto))
    left = F.col("_es").isNotNull() & (F.col("_in") == 1) & ~same
    rows = rows.withColumn("_left", F.max(left.cast("int")).over(upto))
    followed = F.col("_es").isNull() | ((F.col("_in") == 1) & (F.col("_left") == 0))
    good = followed & F.col("_has") & (F.col("frame_idx") >= F.col("_hit") + 4) & (F.col("_sure") >= 0.35) & geometry.in_bounds(F.col("_x"), F.col("_y"))
    rows = rows.withColumn("_good", good).withColumn("_followed", followed)
    held = F.struct("frame_idx", "_iy", "_sure", "_x", "_y", "_good", "_has", "_followed")
    whole = rows.groupBy("video_id", "event_id").agg(F.array_sort(F.collect_list(held)).alias("_r"), F.max("_left").alias("_ended"))
    whole = whole.withColumn("_r", F.filter("_r", lambda r: r["_followed"])).withColumn("_g", F.filter("_r", lambda r: r["_good"])).filter(F.size("_g") >= 2)
    last = F.element_at("_g", -1)
    tail = F.slice(F.filter("_r", lambda r: r["frame_idx"] > last["frame_idx"]), 1, 8)
    until = F.array_position(F.transform(tail, lambda r: r["_has"]), True)
    missing = F.when(until > 0, until - 1).otherwise(F.size(tail))
    recent = F.slice("_g", F.greatest(F.lit(1), F.size("_g") - 4), F.lit(5))
    highest = F.array_max(F.transform(recent, lambda r: r["_iy"]))
    whole = whole.filter(((F.col("_ended") == 1) | (missing >= 3)) & (last["_iy"] + 5.0 >= highest))
    confidence = F.least(F.lit(0.5), 0.2 + 0.25 * last["_sure"] + F.when(F.col("_ended") == 1, 0.08).otherwise(0.0))
    return whole.select("video_id", "event_id", last["frame_idx"].alias("end_frame"), last["_x"].alias("end_x"), last["_y"].alias("end_y"), confidence.alias("end_confidence"))


def fuse(h: Column) -> dict[str, Column]:
    """Landing out of ball_point, ball_score, receiver_point and receiver_confidence."""
    x, y = geometry.project(h, F.get("ball_point", 0), F.get("ball_point", 1), "null")
    ball = geometry.in_bounds(x, y)
    rx, ry = F.get("receiver_point", 0), F.get("receiver_point", 1)
    there = F.col("receiver_point").isNotNull()
    close = there & ball & F.coalesce(F.hypot(x - rx, y - ry) <= NEAR, F.lit(False))
    score = F.coalesce(F.col("ball_score"), F.lit(0.0))
    mix = lambda a, b: F.when(close, 0.6 * a + 0.4 * b).when(there, b).otherwise(a)
    fx, fy = mix(x, rx), mix(y, ry)
    alone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * F.when(ball, 0.55).otherwise(0.0)
    sure = F.when(close, F.least(F.greatest(F.lit(0.0), score) * 0.65, F.col("receiver_confidence"))).when(there, F.col("receiver_confidence") * 0.7).otherwise(alone)
    kind = F.when(close, "shuttle_receiver_fusion").when(there, "receiver_position_fallback").otherwise("shuttle_contact_projection")
    return {"x": fx, "y": fy, "confidence": sure, "kind": kind, "on": geometry.in_bounds(fx, fy)}


def destinations(frames: DataFrame, events: DataFrame, h: Column, radius: int = RADIUS, search: int = TERMINAL) -> DataFrame:
    """Events with their predicted landing, its frame, kind, confidence, status and source."""
    fresh = ["predicted_landing_x", "predicted_landing_y", "landing_frame", "landing_kind", "landing_confidence", "landing_status", "landing_source", "landing_proxy_kind"]
    e = followers(events.drop(*fresh))
    more = e.filter(F.col("_target").isNotNull())
    ball = nearest_evidence(more, frames, "_target", radius)
    at = more.select("video_id", "event_id", F.col("_target").alias("frame_idx"), "_receiver")
    spot, sure = receiver(F.col("_receiver"))
    who = at.join(frames.select("video_id", "frame_idx", "player_tracks", "players").hint(MERGE), ["video_id", "frame_idx"]).select("video_id", "event_id", spot.alias("receiver_point"), sure.alias("receiver_confidence"))
    end = terminal(e.filter(F.col("_target").isNull()), frames, h, search)
    rows = e
    for found in (ball, who, end):
        rows = rows.join(found.hint(MERGE), ["video_id", "event_id"], "left")
    f = fuse(h)
    next_, ended = F.col("_target").isNotNull(), F.col("end_frame").isNotNull()
    nothing = F.col("ball_point").isNull() & F.col("receiver_point").isNull()
    made = next_ & ~nothing
    cut = lambda c: F.bround(c, 6)
    out = {
        "predicted_landing_x": F.when(made & f["on"], cut(f["x"])).when(~next_ & ended, cut(F.col("end_x"))),
        "predicted_landing_y": F.when(made & f["on"], cut(f["y"])).when(~next_ & ended, cut(F.col("end_y"))),
        "landing_frame": F.when(next_, F.coalesce(F.col("ball_frame"), F.col("_target"))).otherwise(F.col("end_frame")),
        "landing_kind": F.when(next_, "next_contact").otherwise("ground_contact"),
        "landing_confidence": F.when(made, cut(f["confidence"])).when(~next_ & ended, cut(F.col("end_confidence"))).otherwise(0.0),
        "landing_status": F.when(made & f["on"], "predicted_monocular_proxy").when(made, "rejected_out_of_bounds").when(next_, "unavailable_missing_shuttle").when(ended, "experimental_terminal_track_end").otherwise("unavailable_terminal_ground_contact"),
        "landing_source": F.when(made, "automatic_next_contact_projection_v1").when(~next_ & ended, "automatic_terminal_track_end_v1").otherwise("automatic_destination_v1"),
        "landing_proxy_kind": F.when(made, f["kind"]).when(~next_ & ended, "shuttle_track_end_projection").when(~next_, "unavailable"),
    }
    return rows.withColumns(out).drop("_target", "_receiver", "ball_score", "ball_frame", "ball_point", "receiver_point", "receiver_confidence", "end_frame", "end_x", "end_y", "end_confidence")
