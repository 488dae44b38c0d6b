"""Whether play is on: evidence around candidates, links of alternating hits, active segments, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import frames_of, ratio0
from rallyline.operators import joins, sequence

EVIDENCE_VERSION, GATE_VERSION = "play-state-evidence-0.1.0", "play-state-gate-0.1.0-dev"
#: Share of the image's diagonal that a moving shuttle goes between rows.
MOVING = 0.0015
#: Seconds of evidence and of support, of links, of rolls, and least ratios of a link.
WINDOW, SUPPORT = 1.0, 3.0
LINK, ROLL, LEAST_TRACKED, LEAST_MOVING, LEAST_SUPPORT = (0.25, 4.0), (0.15, 0.35), 0.55, 0.25, 0.75


def steps(frames: DataFrame) -> DataFrame:
    """Per frame: whether tracked, measured, both players tracked, and the step from the row before."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    state = F.coalesce(F.col("shuttle.tracking_state"), F.lit("missing"))
    point, before = F.col("shuttle.smoothed_xy"), F.lag("shuttle.smoothed_xy").over(w)
    way = F.hypot(F.get(point, 0) - F.get(before, 0), F.get(point, 1) - F.get(before, 1))
    diagonal = F.greatest(F.lit(1.0), F.hypot(F.coalesce("width", F.lit(0)).cast("double"), F.coalesce("height", F.lit(0)).cast("double")))
    both = F.lit(True)
    for side in ("upper", "lower"):
        both = both & F.coalesce(F.col(f"player_tracks.{side}.state").isin("measured", "predicted"), F.lit(False))
    return frames.select(
        "video_id", "frame_idx", F.lag("frame_idx").over(w).alias("before"), (state == "measured").cast("int").alias("measured"),
        state.isin("measured", "predicted").cast("int").alias("tracked"), both.cast("int").alias("both_players"),
        way.isNotNull().cast("int").alias("pair"), F.coalesce(way >= diagonal * MOVING, F.lit(False)).cast("int").alias("moving"),
    )


def nearby(events: DataFrame, radius: int) -> Column:
    """Candidates within ``radius`` frames, the row itself included."""
    return F.count(F.lit(1)).over(Window.partitionBy("video_id").orderBy("candidate_frame").rangeBetween(-radius, radius))


def evidence(frames: DataFrame, events: DataFrame, fps: float, window: float = WINDOW, support: float = SUPPORT) -> DataFrame:
    """Events with the play-state evidence around them; nothing is filtered."""
    radius, reach = frames_of(window / 2, fps, 1), frames_of(support, fps, 1)
    own = events.select("video_id", "event_id", "candidate_frame").withColumn("_near", nearby(events, reach))
    inside = joins.band_join(own, steps(frames), "video_id", "candidate_frame", "frame_idx", radius)
    paired = F.coalesce(F.col("before") >= F.col("candidate_frame") - radius, F.lit(False)).cast("int")
    got = inside.groupBy("video_id", "event_id", "candidate_frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("measured").alias("measured"), F.sum("tracked").alias("tracked"), F.sum("both_players").alias("both_players"),
        F.sum(F.col("pair") * paired).alias("pairs"), F.sum(F.col("moving") * paired).alias("moving"),
    )
    got = own.join(got, ["video_id", "event_id", "candidate_frame"], "left")
    measured, tracked, both = (ratio0(F.col(c), F.col("n")) for c in ("measured", "tracked", "both_players"))
    moving = ratio0(F.col("moving"), F.col("pairs"))
    backing = F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("_near") - 1) / 2.0)
    total = 0.45 * measured + 0.20 * tracked + 0.20 * moving + 0.10 * both + 0.05 * backing
    got = got.select(
        "video_id", "event_id", "candidate_frame", F.lit(EVIDENCE_VERSION).alias("play_state_version"), F.bround(total, 6).alias("play_state_score"),
        F.lit(False).alias("play_state_filter_applied"), F.lit("score_only_unreviewed").alias("play_state_decision"), F.lit(float(window)).alias("play_state_window_seconds"),
        F.coalesce("n", F.lit(0)).alias("play_state_window_frames"), F.lit(radius).cast("long").alias("play_state_window_radius_frames"),
        F.lit(float(support)).alias("play_state_support_seconds"), F.lit(reach).cast("long").alias("play_state_support_radius_frames"),
        F.bround(measured, 6).alias("play_state_shuttle_measured_ratio"), F.bround(tracked, 6).alias("play_state_shuttle_tracked_ratio"),
        F.bround(moving, 6).alias("play_state_shuttle_moving_ratio"), F.bround(both, 6).alias("play_state_both_player_tracking_ratio"),
        F.col("_near").alias("play_state_nearby_candidate_count"), F.bround(backing, 6).alias("play_state_sequence_support"),
    )
    fresh = [c for c in got.columns if c not in ("video_id", "event_id", "candidate_frame")]
    return events.drop(*fresh).join(got, ["video_id", "event_id", "candidate_frame"])


def running(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Events with counts over the rows before their frame (``_before_*``), up to it (``_upto_*``), and of pairs up to the first row from it on.

    The evidence of any span between two events is then a difference, however long the span.
    """
    rows = steps(frames).select("video_id", F.col("frame_idx").alias("_at"), F.lit(1).alias("_row"), "tracked", "pair", "moving")
    points = events.select("video_id", "event_id", F.col("candidate_frame").alias("_at"))
    both = rows.unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy("video_id").orderBy("_at")
    below, upto = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(Window.unboundedPreceding, 0)
    ahead = w.rangeBetween(0, Window.unboundedFollowing)
    cut = lambda c, f: F.coalesce(F.sum(c).over(f), F.lit(0))
    named = {"rows": "_row", "tracked": "tracked", "pairs": "pair", "moving": "moving"}
    first = F.min(F.when(F.col("_row") == 1, F.struct(F.col("_at"), F.col("pair"), F.col("moving")))).over(ahead)
    out = both.select(
        "video_id", "event_id", "_at", "_row", *[cut(c, below).alias(f"_before_{n}") for n, c in named.items()], *[cut(c, upto).alias(f"_upto_{n}") for n, c in named.items()], first.alias("_first"),
    )
    out = out.withColumn("_first_pairs", F.col("_before_pairs") + F.coalesce("_first.pair", F.lit(0))).withColumn("_first_moving", F.col("_before_moving") + F.coalesce("_first.moving", F.lit(0)))
    return events.join(out.filter("_row is null").drop("_at", "_row", "_first"), ["video_id", "event_id"])


def links(frames: DataFrame, events: DataFrame, fps: float, link=LINK, least_tracked: float = LEAST_TRACKED, least_moving: float = LEAST_MOVING, least_support: float = LEAST_SUPPORT) -> DataFrame:
    """All pairs of supported hits of different sides whose gap fits and over which the shuttle is seen to fly."""
    low = frames_of(link[0], fps, 1)
    high = max(low + 1, round(fps * link[1]))
    support = F.coalesce(F.col("play_state_sequence_support"), F.lit(1.0)) if "play_state_sequence_support" in events.columns else F.lit(1.0)
    good = running(frames, events.filter(support >= least_support))
    ends = good.filter(F.col("predicted_hitter").isin("upper", "lower")).select(
        "video_id", F.col("event_id").alias("left_event_id"), F.col("candidate_frame").alias("start_frame"), F.col("predicted_hitter").alias("_l"),
        "_before_rows", "_before_tracked", "_first_pairs", "_first_moving",
    )
    others = good.select(
        "video_id", F.col("event_id").alias("right_event_id"), F.col("candidate_frame").alias("end_frame"), F.col("predicted_hitter").alias("_r"), "_upto_rows", "_upto_tracked", "_upto_pairs", "_upto_moving",
    )
    gap = F.col("end_frame") - F.col("start_frame")
    pairs = joins.forward_join(ends, others, "video_id", "start_frame", "end_frame", low, high).filter(~F.col("_r").eqNullSafe(F.col("_l")))
    count = F.col("_upto_rows") - F.col("_before_rows")
    tracked = ratio0(F.col("_upto_tracked") - F.col("_before_tracked"), count)
    moving = ratio0(F.col("_upto_moving") - F.col("_first_moving"), F.col("_upto_pairs") - F.col("_first_pairs"))
    pairs = pairs.select("video_id", "left_event_id", "right_event_id", "start_frame", "end_frame", gap.alias("gap_frames"), count.alias("frame_count"), tracked.alias("tracked_ratio"), moving.alias("moving_ratio"))
    return pairs.filter((F.col("tracked_ratio") >= least_tracked) & (F.col("moving_ratio") >= least_moving))


def segments(found: DataFrame, fps: float, roll=ROLL) -> DataFrame:
    """Active segments: links widened by the rolls, and joined where they meet or touch."""
    spans = found.select(
        "video_id", F.greatest(F.lit(0), F.col("start_frame") - frames_of(roll[0], fps)).alias("low"), (F.col("end_frame") + frames_of(roll[1], fps)).alias("high"),
        F.array("left_event_id", "right_event_id").alias("ids"), "tracked_ratio", "moving_ratio",
    )
    island = sequence.islands(spans, ["video_id"], "low", "high")
    out = island.groupBy("video_id", "_i").agg(
        F.min("low").alias("start_frame"), F.max("high").alias("end_frame"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("event_ids"),
        F.count(F.lit(1)).alias("link_count"), F.min("tracked_ratio").alias("tracked_ratio_min"), F.min("moving_ratio").alias("moving_ratio_min"),
    )
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame"))
    return out.withColumn("segment_id", F.format_string("Active %02d", place)).drop("_i")


def within(rows: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """Rows with ``play_state_segment_id``, the segment that holds them or null."""
    spans = found.select("video_id", F.col("start_frame").alias("_lo"), F.col("end_frame").alias("_hi"), "segment_id")
    out = joins.contains_join(rows, spans, "video_id", at, "_lo", "_hi", ["segment_id"])
    return out.drop("low").withColumnRenamed("segment_id", "play_state_segment_id")


def gate(frames: DataFrame, events: DataFrame, fps: float, enabled: bool = True, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, events, segments): state of every frame, decision on every event. Suppressed events stay, marked as such."""
    named = ["play_state_gate_version", "play_state", "play_state_gate_applied", "play_state_gate_decision", "play_state_segment_id"]
    frames, events = (x.drop(*named) for x in (frames, events))
    version = F.lit(GATE_VERSION)
    found = segments(links(frames, events, fps, **{k: v for k, v in options.items() if k != "roll"}), fps, options.get("roll", ROLL))
    if not enabled:
        nothing = F.lit(None).cast("string")
        frames = frames.withColumn("play_state", F.lit("not_gated")).withColumn("play_state_segment_id", nothing)
        events = events.withColumn("play_state_gate_applied", F.lit(False)).withColumn("play_state_gate_decision", F.lit("gate_disabled")).withColumn("play_state_segment_id", nothing)
        return frames.withColumn("play_state_gate_version", version), events.withColumn("play_state_gate_version", version), found.limit(0)
    held = F.col("play_state_segment_id").isNotNull()
    frames = within(frames, found, "frame_idx").withColumn("play_state", F.when(held, "active_play").otherwise("inactive_wait"))
    events = within(events, found, "candidate_frame").withColumn("play_state_gate_applied", F.lit(True))
    events = events.withColumn("play_state_gate_decision", F.when(held, "kept_active_play").otherwise("suppressed_inactive_wait"))
    return frames.withColumn("play_state_gate_version", version), events.withColumn("play_state_gate_version", version), found


def rallies(events: DataFrame, gap: float = 6.0) -> DataFrame:
    """Events with their proposed rally: a new one after more than ``gap`` seconds without an event."""
    w = Window.partitionBy("video_id").orderBy("candidate_time", "candidate_frame")
    since = F.col("candidate_time") - F.lag("candidate_time").over(w)
    out = events.withColumn("_since", since).withColumn("_new", F.when(F.col("_since").isNull() | (F.col("_since") > gap), 1).otherwise(0))
    out = out.withColumn("rally_id", F.format_string("Rally %02d", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    source = F.when(F.col("_since").isNull(), "first_event").when(F.col("_new") == 1, "time_gap").otherwise("continuation")
    out = out.withColumn("rally_boundary_source", source).withColumn("previous_hit_gap_sec", F.bround("_since", 3))
    return out.withColumn("rally_boundary_status", F.lit("candidate")).drop("_since", "_new")


def process(frames: DataFrame, h: Column, fps: float, calibration_version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole chain from detections to (frames, kept events with rallies, suppressed events)."""
    from rallyline.operators import hits, tracking

    frames = tracking.enrich(frames, h, fps)
    events = evidence(frames, hits.candidates(hits.score(frames, fps), fps), fps)
    frames, events, _ = gate(frames, events, fps)
    marked = events.withColumn("model_version", F.lit("hit-rules-0.6.0-dev")).withColumn("calibration_version", F.lit(calibration_version).cast("long"))
    kept = F.col("play_state_segment_id").isNotNull()
    return frames, rallies(marked.filter(kept)), marked.filter(~kept)


def provisional(kept: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Both sets of events as one, what only one has as null."""
    return kept.unionByName(suppressed, allowMissingColumns=True)
