"""From detections to tracks: players on the court, their smoothed positions, the shuttle's path.

Frames carry the columns of ``schemas.FRAME``; an input without some of them is given
nulls. All steps keep one row per frame. Players are found and smoothed by expressions and
windows alone. The shuttle's filter is sequential and runs as a fold per unbroken part of
a video: it starts anew after a gap, so that parts are independent and bound its memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyline.functions import COURT_L, COURT_W, geometry, pose
from rallyline.schemas import FRAME, TRACKED, names

VERSION = "shuttle-track-0.2.0-dev"
#: Confidence of a usable detection, gains and patience of the shuttle's filter.
LEAST_CONFIDENCE, ALPHA, BETA, PATIENCE = 0.18, 0.55, 0.16, 5
#: Gain of a player's position, frames that it is carried on.
GAIN, CARRIED = 0.65, 5
#: Measured rows that a smoothed position is made of; what lies before weighs less than 1e-29.
MEMORY = 64


def broken(fps: float) -> int:
    """Frames beyond which two rows belong to different parts of a video."""
    return max(3, round(fps * 0.5))


def complete(frames: DataFrame) -> DataFrame:
    """Frames with every column of the schema, nulls for those missing."""
    have = set(frames.columns)
    kinds = dict(frames.sparkSession.createDataFrame([], FRAME).dtypes)
    return frames.select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in names(FRAME) if n not in have])


def project_players(frames: DataFrame, h: Column) -> DataFrame:
    """Every player's foot in the image and on the court, and whether it lies in bounds."""

    def one(p: Column) -> Column:
        foot = pose.foot_point(p)
        x, y = geometry.project(h, F.get(foot, 0), F.get(foot, 1))
        return p.withField("foot_image_xy", foot).withField("court_xy_m", F.array(x, y)).withField("court_in_bounds", geometry.in_bounds(x, y))

    return frames.withColumn("players", F.transform(F.coalesce("players", F.array().cast(dict(frames.dtypes)["players"])), one))


def best_of_half(players: Column, side: str) -> Column:
    """The player of a half with the surest ankles, then nearest to its middle, then named first; null without any."""
    middle = COURT_L / 4 if side == "upper" else 3 * COURT_L / 4

    def rank(p: Column, i: Column) -> Column:
        x, y = F.get(p["court_xy_m"], 0), F.get(p["court_xy_m"], 1)
        off = F.abs(x - COURT_W / 2) + 0.08 * F.abs(y - middle)
        return F.when(geometry.half(x, y) == side, F.struct((-pose.ankle_confidence(p)).alias("a"), off.alias("b"), i.alias("c"), p.withField("identity", F.lit(side)).alias("p")))

    return F.array_min(F.filter(F.transform(players, rank), lambda r: r.isNotNull()))["p"]


def choose_players(frames: DataFrame) -> DataFrame:
    """At most one player a half, and how many there were to choose from."""
    out = frames.withColumn("pose_candidate_count", F.size("players").cast("long"))
    sides = F.array(best_of_half(F.col("players"), "upper"), best_of_half(F.col("players"), "lower"))
    return out.withColumn("players", F.filter(sides, lambda p: p.isNotNull()))


def smoothed(values: Column) -> Column:
    """The last of exponentially smoothed points (structs of x and y, oldest first)."""
    start = F.lit(None).cast("struct<k: long, x: double, y: double>")

    def step(acc: Column, p: Column) -> Column:
        blend = lambda k: F.coalesce(GAIN * p[k] + (1.0 - GAIN) * acc[k], p[k])
        return F.struct(p["k"].cast("long").alias("k"), blend("x").alias("x"), blend("y").alias("y"))

    return F.aggregate(F.array_sort(values), start, step)


def track_players(frames: DataFrame) -> DataFrame:
    """``player_tracks``: smoothed position of each side, carried on for CARRIED frames.

    Smoothing remembers across gaps of any length. A row needs its last MEMORY measured
    rows only, so that a video of any length is a bounded window.
    """
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = frames
    for side in ("upper", "lower"):
        spot = pose.of_side(F.col("players"), side)["court_xy_m"]
        out = out.withColumn(f"_p_{side}", spot)
        seen = F.col(f"_p_{side}").isNotNull()
        out = out.withColumn(f"_k_{side}", F.count(F.when(seen, 1)).over(upto))
        out = out.withColumn(f"_f_{side}", F.last(F.when(seen, F.col("frame_idx")), ignorenulls=True).over(upto))
        p = F.col(f"_p_{side}")
        recent = Window.partitionBy("video_id").orderBy(f"_k_{side}").rangeBetween(-(MEMORY - 1), 0)
        held = F.collect_list(F.when(seen, F.struct(F.col(f"_k_{side}").alias("k"), F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))).over(recent)
        out = out.withColumn(f"_s_{side}", smoothed(held))

    def track(side: str) -> Column:
        seen, since = F.col(f"_p_{side}").isNotNull(), F.col("frame_idx") - F.col(f"_f_{side}")
        on = seen | F.coalesce(since <= CARRIED, F.lit(False))
        state = F.when(seen, "measured").when(on, "predicted").otherwise("missing")
        at = F.array(F.col(f"_s_{side}.x"), F.col(f"_s_{side}.y"))
        return F.struct(F.when(on, at).alias("court_xy_m"), state.alias("state"), F.when(on, F.col(f"_f_{side}")).alias("source_frame"))

    out = out.withColumn("player_tracks", F.struct(track("upper").alias("upper"), track("lower").alias("lower")))
    return out.drop(*[f"_{c}_{side}" for c in "pkfs" for side in ("upper", "lower")])


class Shuttle:
    """State of the shuttle's filter: where it is, how fast, how sure, and for how long unseen."""

    __slots__ = ("at", "speed", "doubt", "unseen", "last", "fps")

    def __init__(self, fps: float) -> None:
        self.fps, self.last = fps, None
        self.forget()

    def forget(self) -> None:
        self.at, self.speed, self.doubt, self.unseen = None, (0.0, 0.0), None, 0

    def see(self, frame: int, diagonal: float, found: list, hands: list, motion: float) -> dict:
        """What the filter says of a row; ``found`` are (rank, x, y, confidence), ``hands`` wrist points."""
        step = 1 if self.last is None else max(1, frame - self.last)
        if self.last is not None and step > broken(self.fps):
            self.forget()
        self.last = frame
        if self.at is None:
            return self._begin(diagonal, found)
        dt = step / self.fps
        ahead = (self.at[0] + self.speed[0] * dt, self.at[1] + self.speed[1] * dt)
        return self._measure(diagonal, found, hands, motion, ahead, dt) if found else self._miss(diagonal, ahead, step)

    def _row(self, **values) -> dict:
        return {"smoothed_xy": None if self.at is None else list(self.at), "tracking_uncertainty_px": self.doubt} | values

    def _begin(self, diagonal: float, found: list) -> dict:
        if not found:
            return self._row(tracking_state="missing", measurement_weight=0.0, measurement_status="no_measurement", trajectory_reliability=0.0)
        rank, x, y, _ = max(found, key=lambda m: m[3])
        self.forget()
        self.at, self.doubt = (x, y), diagonal * 0.02
        return self._row(
            tracking_state="measured", associated_xy=[x, y], selected_candidate_rank=rank, predicted_xy=[x, y], innovation_px=0.0, innovation_ratio=0.0, continuity_score=1.0,
            hit_support_score=0.0, hand_support_score=0.0, pose_support_score=0.0, measurement_weight=1.0, measurement_status="initialized", trajectory_reliability=1.0,
        )

    def _miss(self, diagonal: float, ahead: tuple, step: int) -> dict:
        self.unseen += step
        if self.unseen > PATIENCE:
            self.forget()
            return self._row(tracking_state="missing", predicted_xy=list(ahead), measurement_weight=0.0, measurement_status="reset_after_missing", trajectory_reliability=0.0)
        self.at, self.doubt = ahead, min(diagonal * 0.25, self.doubt + diagonal * 0.008 * step)
        return self._row(
            tracking_state="predicted", predicted_xy=list(ahead), measurement_weight=0.0, measurement_status="predicted_missing",
            trajectory_reliability=max(0.2, 1.0 - self.unseen / (PATIENCE + 1.0)),
        )

    def _measure(self, diagonal: float, found: list, hands: list, motion: float, ahead: tuple, dt: float) -> dict:
        swing = min(1.0, motion / (diagonal * 0.035))
        pace = math.hypot(*self.speed) * dt / diagonal
        best = None
        for rank, x, y, confidence in found:
            off = math.hypot(x - ahead[0], y - ahead[1])
            reach = min((math.hypot(x - a, y - b) for a, b in hands), default=math.inf)
            hand = max(0.0, 1.0 - reach / (diagonal * 0.09))
            support = max(hand, swing)
            gate = max(3.0, diagonal * min(0.22, 0.025 + 1.5 * pace + 0.08 * support + self.doubt / diagonal))
            fit = math.exp(-0.5 * (off / gate) ** 2)
            score = 0.55 * confidence + 0.35 * fit + 0.10 * support
            if best is None or (score, -rank) > best[0]:
                best = ((score, -rank), x, y, off, gate, fit, support, hand)
        (score, rank), x, y, off, gate, fit, support, hand = best
        weight = max(0.05 + 0.95 * fit, min(1.0, 0.05 + 0.75 * hand + 0.15 * swing))
        pull, push = ALPHA * (0.10 + 0.90 * weight), BETA * (0.05 + 0.95 * weight)
        dx, dy = x - ahead[0], y - ahead[1]
        self.at = (ahead[0] + pull * dx, ahead[1] + pull * dy)
        self.speed = (self.speed[0] + push * dx / dt, self.speed[1] + push * dy / dt)
        self.unseen = 0
        settled = self.doubt * (0.90 - 0.35 * weight) + diagonal * 0.004 * (1.0 - weight)
        self.doubt = max(diagonal * 0.005, min(diagonal * 0.25, settled))
        sure = weight >= 0.35
        return self._row(
            tracking_state="measured" if sure else "predicted", associated_xy=[x, y], selected_candidate_rank=-rank, predicted_xy=list(ahead), innovation_px=off,
            innovation_ratio=off / diagonal, adaptive_gate_px=gate, continuity_score=fit, hit_support_score=support, hand_support_score=hand, pose_support_score=swing,
            association_score=score, measurement_weight=weight, measurement_status="accepted" if sure else "soft_suppressed", trajectory_reliability=weight,
        )


FOLLOWED = names(TRACKED)


def lists(column, values) -> list[list]:
    """The rows of an Arrow list column out of its flat values; null is empty."""
    import pyarrow.compute as pc

    ends = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def follow(fps: float, schema):
    """Rows (video_id, part, frame_idx, diagonal, found, hands, motion), parts one after the other by frame_idx -> ``schema``: video_id, frame_idx, the filter's columns, how many were found.

    A task goes through its parts as a stream, each with a filter of its own, and holds a batch at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        part, state = None, Shuttle(fps)
        for batch in batches:
            video, number, frame, diagonal, motion = (batch.column(n).to_pylist() for n in ("video_id", "part", "frame_idx", "diagonal", "motion"))
            found, hands = batch.column("found"), batch.column("hands")
            spots, wrists = found.flatten(), hands.flatten()
            each = list(zip(*[spots.field(k).to_pylist() for k in range(4)], strict=True))
            each, points = lists(found, each), lists(hands, [tuple(h) for h in lists(wrists, wrists.flatten().to_pylist())])
            columns = [[] for _ in FOLLOWED]
            for row in zip(video, number, frame, diagonal, each, points, motion, strict=True):
                if row[:2] != part:
                    part, state = row[:2], Shuttle(fps)
                seen = state.see(*row[2:]).get
                for values, n in zip(columns, FOLLOWED):  # noqa: B905
                    values.append(seen(n))
            out = [batch.column("video_id"), batch.column("frame_idx"), *columns, list(map(len, each))]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return run


def shuttle_inputs(frames: DataFrame, fps: float) -> DataFrame:
    """What the filter looks at: the part, the image's diagonal, usable detections, wrists, and the players' wrist motion."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    gap = F.col("frame_idx") - F.lag("frame_idx").over(w)
    out = frames.withColumn("_new", F.coalesce((gap > broken(fps)).cast("int"), F.lit(0)))
    out = out.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before, after = F.lag("players").over(w), F.lead("players").over(w)
    motion = F.when(before.isNotNull() & after.isNotNull(), pose.wrist_motion(before, after)).otherwise(0.0)
    size = F.hypot(F.coalesce(F.col("width"), F.lit(0)).cast("double"), F.coalesce(F.col("height"), F.lit(0)).cast("double"))
    return out.select(
        "video_id", "part", "frame_idx", F.greatest(F.lit(1.0), size).alias("diagonal"), pose.measurements(F.col("shuttle"), LEAST_CONFIDENCE).alias("found"),
        F.flatten(F.transform("players", pose.wrists)).alias("hands"), motion.alias("motion"),
    )


def track_shuttle(frames: DataFrame, fps: float) -> DataFrame:
    """``shuttle`` with the filter's fields; frames are unique by video and number."""
    inputs = shuttle_inputs(frames, fps).repartition("video_id", "part").sortWithinPartitions("video_id", "part", "frame_idx")
    schema = T._parse_datatype_string(f"video_id {dict(frames.dtypes)['video_id']}, frame_idx long, {TRACKED}, _n long")  # noqa: SLF001
    found = inputs.mapInArrow(follow(fps, schema), schema)
    out = frames.join(found.hint("merge"), ["video_id", "frame_idx"])
    s = F.col("shuttle").withField("track_version", F.lit(VERSION)).withField("detector_candidate_count", F.col("_n"))
    for n in FOLLOWED:
        s = s.withField(n, F.col(n))
    return out.withColumn("shuttle", s).drop("_n", *FOLLOWED)


def enrich(frames: DataFrame, h: Column, fps: float) -> DataFrame:
    """All steps: projected and chosen players, their tracks, the shuttle's track."""
    frames = choose_players(project_players(complete(frames), h))
    return track_shuttle(track_players(frames), fps)


def frame_rate(frames: DataFrame) -> DataFrame:
    """video_id, fps: frames a second between the first two rows; null unless both grow."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    two = frames.select("video_id", F.row_number().over(w).alias("k"), F.lead("frame_idx").over(w).alias("f2"), "frame_idx", F.lead("timestamp_sec").over(w).alias("t2"), "timestamp_sec").filter("k = 1")
    df, dt = F.col("f2") - F.col("frame_idx"), F.col("t2") - F.col("timestamp_sec")
    return two.select("video_id", F.when((df > 0) & (dt > 0), df / dt).alias("fps"))


def motion_trail(frames: DataFrame, points: int = 20) -> DataFrame:
    """The last ``points`` positions of the shuttle up to each frame, the oldest first; frames without one add none."""
    order = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("shuttle.smoothed_xy")
    rows = frames.select("video_id", "frame_idx", at.alias("_at"), F.count(at).over(order).alias("_k"))
    recent = Window.partitionBy("video_id").orderBy("_k").rangeBetween(-(points - 1), 0)
    held = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_k", "_at"))).over(recent))
    return rows.select("video_id", "frame_idx", F.transform(held, lambda r: r["_at"]).alias("trail"))
