"""Streaming forms: rally sessions, tracks, the shuttle's filter, evidence, peaks, latest revisions.

Inputs are streams with an event time ``ts``; frames of a video arrive in order, within a
batch in any order. Late rows are dropped by the watermark where one is used. Progress is
in the query's checkpoint, from which a stopped stream goes on where it was.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from rallyline.functions import pose
from rallyline.operators import tracking

STATE = "blob binary"


def parquet(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "6 seconds", watermark: str = "0 seconds") -> DataFrame:
    """Rallies as sessions by key: first and last event and their number; a gap longer than ``gap`` parts them."""
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, watermark).groupBy(key, s.alias("session")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


def latest(revisions: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """The row with the highest revision of each key; for the update or complete mode."""
    rest = [c for c in revisions.columns if c not in key]
    return revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("row")).select(*key, "row.*")


def evidence(events: DataFrame, frames: DataFrame, seconds: float, watermark: str = "10 seconds") -> DataFrame:
    """Pairs of an event and the frames of its video within ``seconds`` on either side, joined as streams."""
    e = events.withWatermark("event_ts", watermark).alias("e")
    f = frames.withWatermark("frame_ts", watermark).alias("f")
    span = F.expr(f"interval {seconds} seconds")
    near = (F.col("f.frame_ts") >= F.col("e.event_ts") - span) & (F.col("f.frame_ts") <= F.col("e.event_ts") + span)
    return e.join(f, (F.col("e.video_id") == F.col("f.video_id")) & near).drop(F.col("f.video_id"))


def wrist_sides(players: Column) -> Column:
    """Both wrists of both sides, null where not valid."""
    return F.struct(*[F.array(*[pose.keypoint(pose.of_side(players, s), i) for i in pose.WRISTS]).alias(s) for s in ("upper", "lower")])


def motion(before, after) -> float:
    """Longest way of a wrist that is valid in both rows."""
    ways = [math.dist(a, b) for s in ("upper", "lower") for a, b in zip(before[s], after[s], strict=True) if a is not None and b is not None]
    return max(ways, default=0.0)


def _load(state):
    return pickle.loads(state.get[0]) if state.exists else None  # noqa: S301


def shuttle_inputs(frames: DataFrame) -> DataFrame:
    size = F.hypot(F.coalesce(F.col("width"), F.lit(0)).cast("double"), F.coalesce(F.col("height"), F.lit(0)).cast("double"))
    return frames.select(
        "video_id", "frame_idx", F.greatest(F.lit(1.0), size).alias("diagonal"), pose.measurements(F.col("shuttle"), tracking.LEAST_CONFIDENCE).alias("found"),
        F.flatten(F.transform("players", pose.wrists)).alias("hands"), wrist_sides(F.col("players")).alias("sides"),
    )


def follow_shuttle(frames: DataFrame, fps: float) -> DataFrame:
    """The shuttle's filter by video. A row comes out once the next one is there, whose wrists it needs; the last one waits.

    After a long gap the filter starts anew, so that a video's state stays small.
    """
    out = f"video_id {dict(frames.dtypes)['video_id']}, frame_idx long, {tracking.TRACKED}"

    def run(key, pdfs: Iterator, state):
        import pandas as pd

        held = _load(state) or {"filter": tracking.Shuttle(fps), "row": None, "before": None}
        rows = pd.concat(list(pdfs)).sort_values("frame_idx")
        done = []
        for r in rows.to_dict("records"):
            row = held["row"]
            if row is not None:
                way = motion(held["before"], r["sides"]) if held["before"] is not None else 0.0
                seen = held["filter"].see(int(row["frame_idx"]), float(row["diagonal"]), [(int(m["rank"]), m["x"], m["y"], m["confidence"]) for m in row["found"]], [tuple(h) for h in row["hands"]], way)
                done.append([key[0], row["frame_idx"], *[seen.get(n) for n in tracking.FOLLOWED]])
                held["before"] = row["sides"]
            held["row"] = r
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(done, columns=["video_id", "frame_idx", *tracking.FOLLOWED]).astype({"selected_candidate_rank": "Int64"})

    return shuttle_inputs(frames).groupBy("video_id").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def track_players(frames: DataFrame) -> DataFrame:
    """Smoothed position and state of each side by video, carried on for a few frames."""
    spots = frames.select("video_id", "frame_idx", *[pose.of_side(F.col("players"), s)["court_xy_m"].alias(s) for s in ("upper", "lower")])
    out = f"video_id {dict(frames.dtypes)['video_id']}, frame_idx long, side string, court_xy_m array<double>, state string, source_frame long"

    def run(key, pdfs: Iterator, state):
        import pandas as pd

        held = _load(state) or {}
        done = []
        for r in pd.concat(list(pdfs)).sort_values("frame_idx").to_dict("records"):
            frame = int(r["frame_idx"])
            for side in ("upper", "lower"):
                at, known = r[side], held.get(side)
                if at is not None:
                    if known is not None:
                        at = [tracking.GAIN * a + (1 - tracking.GAIN) * b for a, b in zip(at, known[0], strict=True)]
                    held[side] = (list(at), frame)
                    done.append([key[0], frame, side, list(at), "measured", frame])
                elif known is not None and frame - known[1] <= tracking.CARRIED:
                    done.append([key[0], frame, side, known[0], "predicted", known[1]])
                else:
                    done.append([key[0], frame, side, None, "missing", None])
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(done, columns=["video_id", "frame_idx", "side", "court_xy_m", "state", "source_frame"]).astype({"source_frame": "Int64"})

    return spots.groupBy("video_id").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def peaks(scored: DataFrame, separation: int, threshold: float, radius: int = 2) -> DataFrame:
    """Hits of a stream of scored rows (video_id, frame_idx, event_confidence): local maxima, kept apart.

    A row is judged once ``radius`` later rows are there; a hit comes out once a later row
    lies ``separation`` frames on, for until then a better one may take its place.
    """
    out = f"video_id {dict(scored.dtypes)['video_id']}, candidate_frame long, event_confidence double"

    def run(key, pdfs: Iterator, state):
        import pandas as pd

        held = _load(state) or {"near": [], "judged": 0, "last": None}
        done = []
        for r in pd.concat(list(pdfs)).sort_values("frame_idx").to_dict("records"):
            near = held["near"]
            near.append((int(r["frame_idx"]), float(r["event_confidence"])))
            if len(near) - held["judged"] > radius:
                i = held["judged"]
                frame, value = near[i]
                last = held["last"]
                if last is not None and frame - last[0] >= separation:
                    done.append([key[0], *last])
                    last = None
                if value >= threshold and value >= max(v for _, v in near[max(0, i - radius) : i + radius + 1]) and (last is None or value > last[1]):
                    last = (frame, value)
                held["last"], held["judged"] = last, i + 1
                if held["judged"] > radius:
                    near.pop(0)
                    held["judged"] -= 1
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(done, columns=["video_id", "candidate_frame", "event_confidence"])

    return scored.select("video_id", "frame_idx", "event_confidence").groupBy("video_id").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is, into Parquet, and stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_latest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run a complete-mode stream over what there is; the target holds the last full state."""
    def write(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
