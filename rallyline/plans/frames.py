"""Queries of tracking, hits, play state, export and windows over ``events``, each row of which stands for a frame.

user_id is the video; a session's frames follow each other, sessions lie 20 frames apart.
Places, scores and states come from event_id. The same table is built in Spark with nested
records, as the operators take them, and in SQL with flat columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline import functions as fn
from rallyline.functions import geometry, pose
from rallyline.operators import destination, export, hits, playstate, sequence, tensors, tracking, views
from rallyline.plans.registry import SESS, query, sess

FPS = 30
FR = f"""{SESS}, fr AS (SELECT video, id, row_number() OVER (PARTITION BY video ORDER BY us, id) + 20 * session AS frame, id % 11 <> 0 AS has, CAST(id * 37 % 1280 AS DOUBLE) AS x, CAST(id * 91 % 720 AS DOUBLE) AS y,
 CASE WHEN id % 13 = 0 THEN NULL ELSE id % 10 / 10 END AS rel, CASE WHEN id % 11 = 0 OR id % 5 = 4 THEN 'missing' WHEN id % 5 = 3 THEN 'predicted' ELSE 'measured' END AS state, id % 3 = 0 AS sure,
 id % 4 <> 0 AS up, id % 7 <> 0 AS lo, id % 6 <> 0 AS ok, CAST(id * 53 % 1280 AS DOUBLE) AS ax, CAST(id * 29 % 720 AS DOUBLE) AS ay, CAST(id * 17 % 1280 AS DOUBLE) AS bx, CAST(id * 71 % 720 AS DOUBLE) AS by_, score FROM s)"""


def hashed(a: int, m: int) -> Column:
    return (F.col("id") * a % m).cast("double")


def player(side: str, there: Column, a: tuple[int, int], b: tuple[int, int]) -> Column:
    """A player whose wrists are at two places, the second one sure only for some rows; other joints are missing."""
    seen = F.col("id") % 6 != 0
    zero = F.array(F.lit(0.0), F.lit(0.0))
    spots = {9: F.array(hashed(a[0], 1280), hashed(a[1], 720)), 10: F.array(hashed(b[0], 1280), hashed(b[1], 720))}
    points = F.array(*[spots.get(i, zero) for i in range(17)])
    scores = F.array(*[F.lit(0.9) if i == 9 else F.when(seen, 0.9).otherwise(0.1) if i == 10 else F.lit(0.0) for i in range(17)])
    missing = F.array(*[F.lit(i not in (9, 10)) for i in range(17)])
    box = F.array(*[F.lit(v) for v in (100.0, 100.0, 200.0, 300.0)])
    null = F.lit(None).cast("array<double>")
    return F.when(there, F.struct(
        F.lit(side).alias("identity"), box.alias("bbox_xyxy"), points.alias("keypoints_xy"), scores.alias("keypoint_scores"), missing.alias("keypoint_missing"), null.alias("foot_image_xy"),
        F.array(hashed(7, 61) / 10, hashed(11, 134) / 10).alias("court_xy_m"), F.lit(True).alias("court_in_bounds")))


def track(there: Column) -> Column:
    at = F.array(hashed(7, 61) / 10, hashed(11, 134) / 10)
    return F.struct(F.when(there, at).alias("court_xy_m"), F.when(there, "measured").otherwise("missing").alias("state"), F.when(there, F.col("frame_idx")).alias("source_frame"))


def frames(spark, d) -> DataFrame:
    """Enriched frames: players chosen and tracked, the shuttle filtered."""
    s = sess(spark, d)
    w = sequence.by(["video"], "us", "id")
    f = s.withColumn("frame_idx", F.row_number().over(w) + 20 * F.col("session"))
    i = F.col("id")
    up, low, has = i % 4 != 0, i % 7 != 0, i % 11 != 0
    sides = F.filter(F.array(player("upper", up, (53, 29), (17, 71)), player("lower", low, (59, 31), (19, 73))), lambda p: p.isNotNull())
    state = F.when((i % 11 == 0) | (i % 5 == 4), "missing").when(i % 5 == 3, "predicted").otherwise("measured")
    at = F.when(has, F.array(hashed(37, 1280), hashed(91, 720)))
    sure = i % 3 == 0
    null, none = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    shuttle = F.struct(
        at.alias("raw_xy"), F.col("score").alias("confidence"), F.lit("visible").alias("state"), none.alias("bbox_xyxy"), F.lit(None).cast("array<struct<raw_xy: array<double>, confidence: double, bbox_xyxy: array<double>, detector_index: long>>").alias("candidates"),
        F.lit(tracking.VERSION).alias("track_version"), (i % 3).alias("detector_candidate_count"), at.alias("smoothed_xy"), state.alias("tracking_state"),
        F.when(has & sure, F.array(hashed(37, 1280) + 2, hashed(91, 720) + 1)).alias("associated_xy"), (i % 2).alias("selected_candidate_rank"), none.alias("predicted_xy"), null.alias("innovation_px"), (i % 8 / 100).alias("innovation_ratio"),
        null.alias("adaptive_gate_px"), null.alias("continuity_score"), null.alias("hit_support_score"), null.alias("hand_support_score"), null.alias("pose_support_score"), null.alias("association_score"),
        F.lit(0.5).alias("measurement_weight"), F.when(sure, "accepted").otherwise("soft_suppressed").alias("measurement_status"), (i % 40).cast("double").alias("tracking_uncertainty_px"), F.when(i % 13 != 0, i % 10 / 10).alias("trajectory_reliability"),
    )
    model = F.struct(F.lit("m").alias("family"), F.lit("0").alias("weights_sha256"))
    return f.select(
        F.col("video").cast("string").alias("video_id"), "id", F.col("frame_idx").cast("long").alias("frame_idx"), (F.col("frame_idx") / FPS).alias("timestamp_sec"), F.lit(1280).cast("long").alias("width"), F.lit(720).cast("long").alias("height"),
        sides.alias("players"), shuttle.alias("shuttle"), F.struct(track(up).alias("upper"), track(low).alias("lower")).alias("player_tracks"), F.struct(model.alias("pose"), model.alias("shuttle")).alias("models"),
    )


def events(spark, d) -> DataFrame:
    """Every third frame as a candidate."""
    f = frames(spark, d)
    return f.filter("id % 3 = 0").select(
        "video_id", F.concat(F.lit("e"), "id").alias("event_id"), "id", F.col("frame_idx").alias("candidate_frame"), F.col("timestamp_sec").alias("candidate_time"), F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, "upper").otherwise("lower").alias("predicted_hitter"),
        F.col("player_tracks").alias("player_locations"), (F.col("id") % 9 / 8).alias("event_confidence"),
    )


EVS = f"{FR}, ev_ AS (SELECT video, 'e' || id AS event_id, id, frame, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'upper' ELSE 'lower' END AS hitter, id % 9 / 8 AS conf FROM fr WHERE id % 3 = 0)"


def num(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


V = "CAST(video AS VARCHAR) AS video_id"
W3 = f"""{FR}, n3 AS (SELECT *, lag(frame) OVER o AS f0, lead(frame) OVER o AS f2, CASE WHEN lag(has) OVER o THEN lag(x) OVER o END AS x0, lag(y) OVER o AS y0, CASE WHEN lead(has) OVER o THEN lead(x) OVER o END AS x2, lead(y) OVER o AS y2, lag(rel) OVER o AS r0, lead(rel) OVER o AS r2,
 lag(up) OVER o AS u0, lead(up) OVER o AS u2, lag(lo) OVER o AS l0, lead(lo) OVER o AS l2, lag(ok) OVER o AS k0, lead(ok) OVER o AS k2, lag(id) OVER o AS i0, lead(id) OVER o AS i2 FROM fr WINDOW o AS (PARTITION BY video ORDER BY frame)),
 st3 AS (SELECT *, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS s1, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS s2, least(coalesce(r0, 1), coalesce(rel, 1), coalesce(r2, 1)) AS rr, CASE WHEN sure THEN x + 2 ELSE x END AS cx, CASE WHEN sure THEN y + 1 ELSE y END AS cy FROM n3 WHERE has AND x0 IS NOT NULL AND x2 IS NOT NULL AND frame - f0 <= 15 AND f2 - frame <= 15),
 ang AS (SELECT *, CASE WHEN s1 < 0.3 OR s2 < 0.3 THEN 0 ELSE acos(greatest(-1, least(1, ((x - x0) * (x2 - x) + (y - y0) * (y2 - y)) / (s1 * s2)))) / pi() END AS turn, abs(s2 - s1) / greatest(s1, s2, 1) AS chg, sqrt(1280.0::DOUBLE ** 2 + 720.0::DOUBLE ** 2) AS dg FROM st3),
 wr AS (SELECT *, CASE WHEN up THEN sqrt((id * 53 % 1280 - cx) ** 2 + (id * 29 % 720 - cy) ** 2) END AS d1, CASE WHEN up AND ok THEN sqrt((id * 17 % 1280 - cx) ** 2 + (id * 71 % 720 - cy) ** 2) END AS d2, CASE WHEN lo THEN sqrt((id * 59 % 1280 - cx) ** 2 + (id * 31 % 720 - cy) ** 2) END AS d3, CASE WHEN lo AND ok THEN sqrt((id * 19 % 1280 - cx) ** 2 + (id * 73 % 720 - cy) ** 2) END AS d4,
  CASE WHEN u0 AND u2 THEN sqrt((i2 * 53 % 1280 - i0 * 53 % 1280) ** 2 + (i2 * 29 % 720 - i0 * 29 % 720) ** 2) END AS m1, CASE WHEN u0 AND u2 AND k0 AND k2 THEN sqrt((i2 * 17 % 1280 - i0 * 17 % 1280) ** 2 + (i2 * 71 % 720 - i0 * 71 % 720) ** 2) END AS m2, CASE WHEN l0 AND l2 THEN sqrt((i2 * 59 % 1280 - i0 * 59 % 1280) ** 2 + (i2 * 31 % 720 - i0 * 31 % 720) ** 2) END AS m3, CASE WHEN l0 AND l2 AND k0 AND k2 THEN sqrt((i2 * 19 % 1280 - i0 * 19 % 1280) ** 2 + (i2 * 73 % 720 - i0 * 73 % 720) ** 2) END AS m4 FROM ang),
 sc0 AS (SELECT *, least(1, 0.7::DOUBLE * turn + 0.3::DOUBLE * chg) AS raw_, least(d1, d2, d3, d4) AS dd, least(1, coalesce(greatest(m1, m2, m3, m4), 0) / (dg * 0.035::DOUBLE)) AS swing FROM wr),
 sc AS (SELECT *, raw_ * (0.35::DOUBLE + 0.65::DOUBLE * rr) AS traj, coalesce(greatest(0, 1 - dd / (dg * 0.09::DOUBLE)), 0) AS hand, CASE WHEN dd = d1 OR dd = d2 THEN 'upper' WHEN dd IS NOT NULL THEN 'lower' END AS hitter FROM sc0),
 scored AS (SELECT *, 0.52::DOUBLE * traj + 0.33::DOUBLE * hand + 0.15::DOUBLE * swing AS conf FROM sc)"""


def scored(spark, d) -> DataFrame:
    return hits.score(frames(spark, d), FPS)


@query("win01_neighbours", f"WITH {W3} SELECT {V}, frame AS frame_idx FROM scored")
def win01(spark, d):
    return scored(spark, d).select("video_id", "frame_idx")


@query("win02_03_turn_and_speed", f"WITH {W3} SELECT {V}, frame AS frame_idx, round(raw_, 6) AS trajectory_score_raw FROM scored")
def win02(spark, d):
    return scored(spark, d).select("video_id", "frame_idx", *num("trajectory_score_raw"))


@query("win04_trajectory_score", f"WITH {W3} SELECT {V}, frame AS frame_idx, round(traj, 6) AS trajectory_score, round(rr, 6) AS trajectory_tracking_reliability FROM scored")
def win04(spark, d):
    return scored(spark, d).select("video_id", "frame_idx", *num("trajectory_score", "trajectory_tracking_reliability"))


@query("win05_pose_motion", f"WITH {W3} SELECT {V}, frame AS frame_idx, round(swing, 6) AS pose_score FROM scored")
def win05(spark, d):
    return scored(spark, d).select("video_id", "frame_idx", *num("pose_score"))


@query("win06_event_confidence", f"WITH {W3} SELECT {V}, frame AS frame_idx, round(hand, 6) AS hand_distance_score, hitter AS predicted_hitter, round(conf, 6) AS event_confidence FROM scored")
def win06(spark, d):
    return scored(spark, d).select("video_id", "frame_idx", F.round("hand_distance_score", 6).alias("hand_distance_score"), "predicted_hitter", *num("event_confidence"))


@query("win09_windowed_hitter", f"WITH {W3}, j AS (SELECT a.video, a.frame, b.hitter, b.frame AS bf, b.hand, row_number() OVER (PARTITION BY a.video, a.frame ORDER BY b.hand DESC, abs(b.frame - a.frame), b.conf DESC, b.frame) AS k FROM scored a JOIN scored b ON a.video = b.video AND abs(a.frame - b.frame) <= 2 AND b.hitter IS NOT NULL AND b.hand > 0) SELECT CAST(s.video AS VARCHAR) AS video_id, s.frame AS frame_idx, CASE WHEN j.k IS NULL THEN s.hitter ELSE j.hitter END AS hitter, coalesce(j.bf, s.frame) AS hitter_frame FROM scored s LEFT JOIN j ON j.video = s.video AND j.frame = s.frame AND j.k = 1")
def win09(spark, d):
    return hits.assign_hitters(scored(spark, d), 2).select("video_id", "frame_idx", F.col("hitter.hitter").alias("hitter"), F.col("hitter.frame").alias("hitter_frame"))


PEAKS = f"{W3}, pk AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM (SELECT *, max(conf) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM scored) WHERE conf >= 0.38 AND conf >= top)"


@query("flt05_win07_peaks", f"WITH {PEAKS} SELECT {V}, frame AS frame_idx FROM pk")
def flt05(spark, d):
    s = scored(spark, d)
    return sequence.local_maxima(s, ["video_id"], ["frame_idx"], "event_confidence").filter(F.col("event_confidence") >= hits.THRESHOLD).select("video_id", "frame_idx")


FOLD = "SELECT video, k, frame, conf, 1 AS grp FROM pk WHERE k = 1 UNION ALL SELECT p.video, p.k, CASE WHEN p.frame - r.frame >= 12 OR p.conf > r.conf THEN p.frame ELSE r.frame END, CASE WHEN p.frame - r.frame >= 12 OR p.conf > r.conf THEN p.conf ELSE r.conf END, CASE WHEN p.frame - r.frame >= 12 THEN r.grp + 1 ELSE r.grp END FROM r JOIN pk p ON p.video = r.video AND p.k = r.k + 1"


@query("win08_10_candidates", f"WITH RECURSIVE {PEAKS}, r AS ({FOLD}), c AS (SELECT video, arg_max(frame, k) AS frame FROM r GROUP BY video, grp) SELECT {V}, printf('evt_%08d', frame) AS event_id, frame AS candidate_frame, greatest(0, frame - 45) AS window_start_frame, frame + 45 AS window_end_frame FROM c")
def win08(spark, d):
    return hits.candidates(scored(spark, d), FPS).select("video_id", "event_id", "candidate_frame", "window_start_frame", "window_end_frame")


STEPS = f"{EVS}, stp AS (SELECT *, lag(frame) OVER o AS pf, CASE WHEN has AND lag(has) OVER o THEN sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) END AS way FROM fr WINDOW o AS (PARTITION BY video ORDER BY frame))"
NEAR = f"{STEPS}, nr AS (SELECT video, event_id, frame, count(*) OVER (PARTITION BY video ORDER BY frame RANGE BETWEEN 90 PRECEDING AND 90 FOLLOWING) AS near FROM ev_)"


@query("win11_evidence", f"WITH {NEAR}, a AS (SELECT e.video, e.event_id, any_value(e.near) AS near, count(*) AS n, count(*) FILTER (WHERE state = 'measured') AS me, count(*) FILTER (WHERE state <> 'missing') AS tr, count(*) FILTER (WHERE up AND lo) AS bo, count(way) FILTER (WHERE pf >= e.frame - 15) AS pa, count(*) FILTER (WHERE pf >= e.frame - 15 AND way >= sqrt(1280.0::DOUBLE ** 2 + 720.0::DOUBLE ** 2) * 0.0015::DOUBLE) AS mo FROM nr e JOIN stp f ON f.video = e.video AND abs(f.frame - e.frame) <= 15 GROUP BY e.video, e.event_id) SELECT {V}, event_id, n AS play_state_window_frames, near AS play_state_nearby_candidate_count, round(0.45::DOUBLE * (me / n) + 0.2::DOUBLE * (tr / n) + 0.2::DOUBLE * coalesce(mo / nullif(pa, 0), 0) + 0.1::DOUBLE * (bo / n) + 0.05::DOUBLE * least(1, (near - 1) / 2), 5) AS play_state_score FROM a")
def win11(spark, d):
    e = playstate.evidence(frames(spark, d), events(spark, d), FPS)
    return e.select("video_id", "event_id", "play_state_window_frames", "play_state_nearby_candidate_count", F.round("play_state_score", 5).alias("play_state_score"))


@query("win12_sequence_support", f"WITH {NEAR} SELECT {V}, event_id, least(1, (near - 1) / 2) AS play_state_sequence_support FROM nr")
def win12(spark, d):
    return playstate.evidence(frames(spark, d), events(spark, d), FPS).select("video_id", "event_id", "play_state_sequence_support")


LINKS = f"""{STEPS}, pr AS (SELECT a.video, a.event_id AS l, b.event_id AS r, a.frame AS fa, b.frame AS fb FROM ev_ a JOIN ev_ b ON a.video = b.video AND b.frame - a.frame BETWEEN 8 AND 120 AND a.hitter IS NOT NULL AND (b.hitter IS NULL OR a.hitter <> b.hitter)),
 li_ AS (SELECT pr.video, l, r, fa, fb, count(*) AS n, count(*) FILTER (WHERE state <> 'missing') / count(*) AS tr, coalesce(count(*) FILTER (WHERE pf >= fa AND way >= sqrt(1280.0::DOUBLE ** 2 + 720.0::DOUBLE ** 2) * 0.0015::DOUBLE) / nullif(count(way) FILTER (WHERE pf >= fa), 0), 0) AS mo FROM pr JOIN stp f ON f.video = pr.video AND f.frame BETWEEN fa AND fb GROUP BY ALL),
 lk AS (SELECT * FROM li_ WHERE tr >= 0.55::DOUBLE AND mo >= 0.25::DOUBLE)"""


@query("win13_join03_links", f"WITH {LINKS} SELECT {V}, l AS left_event_id, r AS right_event_id, fb - fa AS gap_frames, n AS frame_count, round(tr, 6) AS tracked_ratio, round(mo, 6) AS moving_ratio FROM lk")
def win13(spark, d):
    return playstate.links(frames(spark, d), events(spark, d), FPS).select("video_id", "left_event_id", "right_event_id", "gap_frames", "frame_count", *num("tracked_ratio", "moving_ratio"))


SEGS = f"""{LINKS}, iv AS (SELECT video, greatest(0, fa - 4) AS lo_, fb + 10 AS hi_, l, r, tr, mo FROM lk), h1 AS (SELECT *, max(hi_) OVER (PARTITION BY video ORDER BY lo_, hi_, l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb FROM iv),
 h2 AS (SELECT *, sum(CASE WHEN hb IS NULL OR lo_ > hb + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY lo_, hi_, l, r ROWS UNBOUNDED PRECEDING) AS g FROM h1), sg AS (SELECT video, g, min(lo_) AS a, max(hi_) AS z, count(*) AS n, min(tr) AS tr, min(mo) AS mo, list(l) AS ll, list(r) AS rr FROM h2 GROUP BY video, g)"""


@query("win14_active_segments", f"WITH {SEGS} SELECT {V}, printf('Active %02d', row_number() OVER (PARTITION BY video ORDER BY a)) AS segment_id, a AS start_frame, z AS end_frame, n AS link_count, round(tr, 6) AS tracked_ratio_min, round(mo, 6) AS moving_ratio_min, array_to_string(list_sort(list_distinct(list_concat(ll, rr))), ',') AS event_ids FROM sg")
def win14(spark, d):
    s = playstate.segments(playstate.links(frames(spark, d), events(spark, d), FPS), FPS)
    return s.select("video_id", "segment_id", "start_frame", "end_frame", "link_count", *num("tracked_ratio_min", "moving_ratio_min"), F.concat_ws(",", "event_ids").alias("event_ids"))


@query("win15_gate_events", f"WITH {SEGS} SELECT {V}, event_id, CASE WHEN EXISTS (SELECT 1 FROM sg WHERE sg.video = ev_.video AND ev_.frame BETWEEN a AND z) THEN 'kept_active_play' ELSE 'suppressed_inactive_wait' END AS play_state_gate_decision FROM ev_")
def win15(spark, d):
    return playstate.gate(frames(spark, d), events(spark, d), FPS)[1].select("video_id", "event_id", "play_state_gate_decision")


@query("join04_gate_frames", f"WITH {SEGS} SELECT {V}, frame AS frame_idx, CASE WHEN EXISTS (SELECT 1 FROM sg WHERE sg.video = fr.video AND fr.frame BETWEEN a AND z) THEN 'active_play' ELSE 'inactive_wait' END AS play_state FROM fr")
def join04(spark, d):
    return playstate.gate(frames(spark, d), events(spark, d), FPS)[0].select("video_id", "frame_idx", "play_state")


@query("set02_provisional", f"WITH {EVS} SELECT {V}, event_id, frame AS candidate_frame FROM ev_")
def set02(spark, d):
    _, e, _ = playstate.gate(frames(spark, d), events(spark, d), FPS)
    kept = F.col("play_state_segment_id").isNotNull()
    return playstate.provisional(playstate.rallies(e.filter(kept)), e.filter(~kept)).select("video_id", "event_id", "candidate_frame")


@query("flt06_supported", f"WITH {NEAR} SELECT CAST(nr.video AS VARCHAR) AS video_id, event_id FROM nr JOIN ev_ USING (video, event_id) WHERE least(1, (near - 1) / 2) >= 0.75::DOUBLE AND hitter IN ('upper', 'lower')")
def flt06(spark, d):
    e = playstate.evidence(frames(spark, d), events(spark, d), FPS)
    return e.filter((F.coalesce("play_state_sequence_support", F.lit(1.0)) >= playstate.LEAST_SUPPORT) & F.col("predicted_hitter").isin("upper", "lower")).select("video_id", "event_id")


@query("win16_rallies", f"WITH {EVS}, g AS (SELECT video, event_id, frame, frame / 30 - lag(frame / 30) OVER (PARTITION BY video ORDER BY frame) AS gap FROM ev_) SELECT {V}, event_id, printf('Rally %02d', 1 + sum(CASE WHEN gap > 0.5::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING)) AS rally_id, CASE WHEN gap IS NULL THEN 'first_event' WHEN gap > 0.5::DOUBLE THEN 'time_gap' ELSE 'continuation' END AS rally_boundary_source, round(gap, 3) AS previous_hit_gap_sec FROM g")
def win16(spark, d):
    return playstate.rallies(events(spark, d), 0.5).select("video_id", "event_id", "rally_id", "rally_boundary_source", "previous_hit_gap_sec")


FLAGS = f"{FR}, fl AS (SELECT video, frame, has AS flag, lag(has) OVER o IS DISTINCT FROM has AS new FROM fr WINDOW o AS (PARTITION BY video ORDER BY frame)), ru AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM fl), rn AS (SELECT video, run, any_value(flag) AS flag, min(frame) AS a, max(frame) AS z, count(*) AS n FROM ru GROUP BY ALL)"
STABLE = f"{FLAGS}, fi AS (SELECT *, flag OR (n < 5 AND lag(run) OVER o IS NOT NULL AND lead(run) OVER o IS NOT NULL) AS on_ FROM rn WINDOW o AS (PARTITION BY video ORDER BY run)), gp AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY run ROWS UNBOUNDED PRECEDING) AS g FROM fi), sb AS (SELECT video, g, min(a) AS a, max(z) AS z, sum(n) AS n FROM gp WHERE on_ GROUP BY ALL HAVING sum(n) >= 5)"


def flags(spark, d) -> DataFrame:
    return frames(spark, d).select("video_id", "frame_idx", F.col("shuttle.smoothed_xy").isNotNull().alias("on"))


@query("win18_view_runs", f"WITH {FLAGS} SELECT {V}, flag AS \"on\", a AS first, z AS last, n FROM rn")
def win18(spark, d):
    return views.runs(flags(spark, d), ["video_id"], "frame_idx", "on").select("video_id", "on", "first", "last", "n")


@query("win19_stable_views", f"WITH {STABLE} SELECT {V}, a AS first, z AS last, CAST(n AS BIGINT) AS n FROM sb")
def win19(spark, d):
    return views.stable_runs(flags(spark, d), ["video_id"], "frame_idx", "on")


@query("win20_view_segments", f"WITH {STABLE} SELECT {V}, printf('main_%03d', row_number() OVER (PARTITION BY video ORDER BY a)) AS segment_id, a AS start_frame, z AS end_frame, z - a + 1 AS frame_count, round(a / 30, 3) AS start_sec, round((z + 1) / 30, 3) AS end_sec FROM sb")
def win20(spark, d):
    return views.segments(win19(spark, d), ["video_id"], FPS).select("video_id", "segment_id", "start_frame", "end_frame", "frame_count", "start_sec", "end_sec")


@query("win21_agg04_adaptive_threshold", f"WITH {FR}, v AS (SELECT video, 0.6::DOUBLE + id % 29 / 100 AS sc FROM fr), l AS (SELECT video, list(sc ORDER BY sc) AS a, max(sc) AS best, avg(CASE WHEN sc >= 0.87::DOUBLE THEN 1 ELSE 0 END) AS strict, avg(CASE WHEN sc >= 0.75::DOUBLE THEN 1 ELSE 0 END) AS loose FROM v GROUP BY video), p AS (SELECT *, a[CAST(floor(0.1::DOUBLE * (len(a) - 1)) AS INT) + 1] AS p10, a[CAST(floor(0.9::DOUBLE * (len(a) - 1)) AS INT) + 1] AS p90 FROM l) SELECT {V}, round(CASE WHEN p10 >= 0.65::DOUBLE AND p90 - p10 <= 0.12::DOUBLE AND p90 < 0.87::DOUBLE THEN greatest(0.65::DOUBLE, p10 - 0.012::DOUBLE) WHEN (best < 0.87::DOUBLE AND best >= 0.75::DOUBLE) OR (strict < 0.1 AND loose >= 0.15 AND loose >= 3 * strict) THEN 0.75 ELSE 0.87 END, 6) AS threshold FROM p")
def win21(spark, d):
    s = frames(spark, d).select("video_id", (F.lit(0.6) + F.col("id") % 29 / 100).alias("score"))
    return views.adaptive_threshold(s, ["video_id"], "score", 0.87).withColumn("threshold", F.round("threshold", 6))


@query("agg53_score_summary", f"WITH {FR} SELECT {V}, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(avg(score), 6) AS score_mean FROM fr GROUP BY video")
def agg53(spark, d):
    s = views.score_summary(frames(spark, d).select("video_id", F.col("shuttle.confidence").alias("score")), ["video_id"], "score")
    return s.select("video_id", *num("score_min", "score_max", "score_mean"))


@query("srt05_sample_times", f"WITH {STABLE}, k AS (SELECT *, z - a + 1 AS fc, row_number() OVER (PARTITION BY video ORDER BY z - a + 1 DESC, a) AS k FROM sb), t AS (SELECT video, k, CAST(round_even((a + z) / 2 / 30 * 1000, 0) AS BIGINT) AS ms FROM k WHERE k <= 6), f AS (SELECT video, ms, min(k) AS k FROM (SELECT * FROM t UNION ALL SELECT DISTINCT video, 99, 10000 FROM t) GROUP BY ALL) SELECT {V}, array_to_string(list(ms ORDER BY k), ',') AS times FROM f GROUP BY video")
def srt05(spark, d):
    t = views.sample_times(win20(spark, d), ["video_id"], FPS, 10_000)
    return t.select("video_id", F.concat_ws(",", F.transform("times", lambda x: x.cast("string"))).alias("times"))


@query("scl23_selected_frames", f"WITH {STABLE}, c AS (SELECT video, CASE WHEN a + (4 - a % 4) % 4 <= z THEN (z - (a + (4 - a % 4) % 4)) // 4 + 1 ELSE 0 END AS n FROM sb) SELECT {V}, CAST(sum(n) AS BIGINT) AS frames FROM c GROUP BY video")
def scl23(spark, d):
    return views.selected_frames(win20(spark, d), ["video_id"], 4).select("video_id", F.col("frames").cast("long").alias("frames"))


@query("prj01_frame_rows", f"WITH {FR} SELECT {V}, frame AS frame_idx, up OR lo AS is_court_view, CASE WHEN up THEN id * 7 % 61 / 10 END AS upper_court_x, CASE WHEN up THEN 'measured' ELSE 'missing' END AS upper_tracking_state, CASE WHEN lo THEN id * 11 % 134 / 10 END AS lower_court_y, CASE WHEN has THEN x END AS shuttle_smoothed_x, CASE WHEN has THEN y END AS shuttle_raw_y, CASE WHEN has AND sure THEN x + 2 END AS shuttle_associated_x, state AS shuttle_state, '[]' AS shuttle_candidates_json, id % 3 AS shuttle_detector_candidate_count, 'unknown' AS play_state, rel AS shuttle_trajectory_reliability FROM fr")
def prj01(spark, d):
    return export.frame_rows(frames(spark, d)).select("video_id", "frame_idx", "is_court_view", "upper_court_x", "upper_tracking_state", "lower_court_y", "shuttle_smoothed_x", "shuttle_raw_y", "shuttle_associated_x", "shuttle_state", "shuttle_candidates_json", "shuttle_detector_candidate_count", "play_state", "shuttle_trajectory_reliability")


def flat_events(spark, d) -> DataFrame:
    e = events(spark, d).withColumn("rally_id", F.concat(F.lit("r"), F.floor(F.col("candidate_frame") / 50))).withColumn("predicted_stroke_type", F.when(F.col("id") % 4 != 0, "clear").otherwise(""))
    e = e.withColumn("stroke_type", F.when(F.col("id") % 8 != 0, "drop")).withColumn("predicted_landing_x", F.when(F.col("id") % 2 == 0, F.lit(1.5))).withColumn("landing_x", F.lit(2.5)).withColumn("landing_y", F.lit(3.0))
    return export.event_rows(e)


@query("prj02_event_rows", f"WITH {EVS} SELECT {V}, event_id, 'r' || frame // 50 AS rally_id, row_number() OVER (PARTITION BY video, frame // 50 ORDER BY frame, event_id) AS stroke_index, frame AS hit_frame, coalesce(hitter, 'unknown') AS player, CASE WHEN hitter = 'upper' AND id % 4 <> 0 OR hitter = 'lower' AND id % 7 <> 0 THEN id * 7 % 61 / 10 END AS player_location_x, CASE WHEN hitter = 'upper' AND id % 7 <> 0 OR hitter = 'lower' AND id % 4 <> 0 THEN id * 11 % 134 / 10 END AS opponent_location_y FROM ev_")
def prj02(spark, d):
    return flat_events(spark, d).select("video_id", "event_id", "rally_id", F.col("stroke_index").cast("long").alias("stroke_index"), "hit_frame", "player", "player_location_x", "opponent_location_y")


@query("prj05_priority", f"WITH {EVS} SELECT {V}, event_id, CASE WHEN id % 4 <> 0 THEN 'clear' WHEN id % 8 <> 0 THEN 'drop' ELSE 'unknown' END AS stroke_type, CASE WHEN id % 2 = 0 THEN 1.5 ELSE 2.5 END AS landing_x, 'unavailable' AS landing_source, 'unreviewed' AS annotation_status FROM ev_")
def prj05(spark, d):
    return flat_events(spark, d).select("video_id", "event_id", "stroke_type", "landing_x", "landing_source", "annotation_status")


@query("prj03_opposite_side", f"WITH {EVS} SELECT {V}, event_id, CASE hitter WHEN 'upper' THEN 'lower' WHEN 'lower' THEN 'upper' END AS opposite FROM ev_")
def prj03(spark, d):
    return events(spark, d).select("video_id", "event_id", fn.opposite(F.col("predicted_hitter")).alias("opposite"))


@query("prj04_xy", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN has THEN x END AS x, CASE WHEN has THEN y END AS y FROM fr")
def prj04(spark, d):
    x, y = pose.xy(F.col("shuttle.smoothed_xy"))
    return frames(spark, d).select("video_id", "frame_idx", x.alias("x"), y.alias("y"))


@query("prj06_video_defaults", f"WITH {FR} SELECT DISTINCT {V}, 1280 AS width, 'unknown' AS match_id, 'fixed-camera-singles' AS domain, '{{\"A\":\"unknown\",\"B\":\"unknown\"}}' AS players_json FROM fr")
def prj06(spark, d):
    return export.video_rows(frames(spark, d)).select("video_id", "width", "match_id", "domain", "players_json")


@query("agg01_quality_report", f"WITH {EVS}, f AS (SELECT video, count(*) AS frames, count(*) FILTER (WHERE up) AS um, round(count(*) FILTER (WHERE up) / count(*), 6) AS uc, round(count(*) FILTER (WHERE state <> 'missing') / count(*), 6) AS tc, count(*) FILTER (WHERE NOT sure) AS soft, count(*) FILTER (WHERE id % 2 <> 0) AS other, count(*) FILTER (WHERE id % 3 > 1) AS multi FROM fr GROUP BY video), u AS (SELECT video, list(CAST(id % 40 AS DOUBLE) ORDER BY id % 40) AS l FROM fr GROUP BY video), e AS (SELECT video, count(*) AS n, count(DISTINCT frame // 50) AS ra FROM ev_ GROUP BY video) SELECT CAST(f.video AS VARCHAR) AS video_id, frames, um AS upper_measured_frames, uc AS upper_tracking_coverage, tc AS track_coverage, soft AS soft_suppressed_frames, other AS selected_non_primary_frames, multi AS multi_candidate_frames, l[CAST(round_even((len(l) - 1) * 0.5::DOUBLE, 0) AS INT) + 1] AS tracking_uncertainty_px_median, coalesce(n, 0) AS candidate_count, coalesce(ra, 0) AS rally_candidate_count FROM f JOIN u USING (video) LEFT JOIN e USING (video)")
def agg01(spark, d):
    q = export.quality(frames(spark, d), flat_events(spark, d))
    return q.select("video_id", "frames", "upper_measured_frames", "upper_tracking_coverage", "track_coverage", "soft_suppressed_frames", "selected_non_primary_frames", "multi_candidate_frames", "tracking_uncertainty_px_median", "candidate_count", "rally_candidate_count")


@query("agg55_candidate_rate", f"WITH {EVS}, g AS (SELECT video, frame, frame / 30 - lag(frame / 30) OVER (PARTITION BY video ORDER BY frame) AS gap FROM fr), t AS (SELECT video, CASE WHEN count(*) > 1 THEN max(frame / 30) - min(frame / 30) + arg_max(gap, frame) ELSE 0 END AS du FROM g GROUP BY video), e AS (SELECT video, count(*) AS n FROM ev_ GROUP BY video) SELECT CAST(t.video AS VARCHAR) AS video_id, round(du, 3) AS processed_duration_sec, CASE WHEN du > 0 THEN round(coalesce(n, 0) * 60 / du, 3) END AS candidate_rate_per_min FROM t LEFT JOIN e USING (video)")
def agg55(spark, d):
    return export.quality(frames(spark, d), flat_events(spark, d)).select("video_id", "processed_duration_sec", "candidate_rate_per_min")


@query("agg54_first_version", f"WITH {FR} SELECT DISTINCT {V}, '{tracking.VERSION}' AS track_version FROM fr")
def agg54(spark, d):
    return export.quality(frames(spark, d), flat_events(spark, d)).select("video_id", "track_version")


@query("snk09_review_feed", f"WITH {EVS} SELECT printf('EVT-M%05d', frame) AS id, frame / 30 AS time, CASE WHEN hitter = 'upper' THEN 'A' ELSE 'B' END AS hitter, round(conf, 3) AS confidence FROM ev_")
def snk09(spark, d):
    e = events(spark, d).withColumns({"rally_id": F.lit(None).cast("string"), "trajectory_score": F.lit(0.5), "hand_distance_score": F.lit(0.5), "pose_score": F.lit(0.5), "window_start_frame": F.col("candidate_frame"), "window_end_frame": F.col("candidate_frame")})
    return export.review_feed(e)[0].select("id", "time", "hitter", "confidence")


@query("scl22_frame_rate", f"WITH {FR}, k AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM fr) SELECT {V}, round((max(frame) FILTER (WHERE k = 2) - max(frame) FILTER (WHERE k = 1)) / (max(frame / 30) FILTER (WHERE k = 2) - max(frame / 30) FILTER (WHERE k = 1)), 6) AS fps FROM k GROUP BY video")
def scl22(spark, d):
    return tracking.frame_rate(frames(spark, d)).withColumn("fps", F.round("fps", 6))


@query("win39_motion_trail", f"WITH {FR}, p AS (SELECT video, frame, x, y, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM fr WHERE has), c AS (SELECT f.video, f.frame, (SELECT max(k) FROM p WHERE p.video = f.video AND p.frame <= f.frame) AS k FROM fr f) SELECT CAST(c.video AS VARCHAR) AS video_id, c.frame AS frame_idx, count(p.k) AS n, sum(p.x) AS sx, arg_min(p.y, p.k) AS oldest_y FROM c LEFT JOIN p ON p.video = c.video AND p.k BETWEEN c.k - 19 AND c.k GROUP BY ALL")
def win39(spark, d):
    t = tracking.motion_trail(frames(spark, d))
    total = F.aggregate("trail", F.lit(0.0), lambda a, p: a + F.get(p, 0))
    return t.select("video_id", "frame_idx", F.size("trail").cast("long").alias("n"), F.when(F.size("trail") > 0, total).alias("sx"), F.get(F.get("trail", 0), 1).alias("oldest_y"))


@query("win23_player_tracks", f"WITH RECURSIVE {FR}, m AS (SELECT video, frame, id * 7 % 61 / 10 AS x, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM fr WHERE up), e AS (SELECT video, frame, k, x FROM m WHERE k = 1 UNION ALL SELECT m.video, m.frame, m.k, 0.65::DOUBLE * m.x + 0.35::DOUBLE * e.x FROM e JOIN m ON m.video = e.video AND m.k = e.k + 1), l AS (SELECT f.video, f.frame, max(m.frame) AS src FROM fr f LEFT JOIN m ON m.video = f.video AND m.frame <= f.frame GROUP BY ALL) SELECT CAST(l.video AS VARCHAR) AS video_id, l.frame AS frame_idx, CASE WHEN src = l.frame THEN 'measured' WHEN l.frame - src <= 5 THEN 'predicted' ELSE 'missing' END AS state, CASE WHEN l.frame - src <= 5 THEN src END AS source_frame, CASE WHEN l.frame - src <= 5 THEN round(e.x + 3e-8::DOUBLE, 5) END AS x FROM l LEFT JOIN e ON e.video = l.video AND e.frame = l.src")
def win23(spark, d):
    """Places are shifted by less than they are rounded to, for many lie on a tie."""
    t = tracking.track_players(frames(spark, d))
    return t.select("video_id", "frame_idx", F.col("player_tracks.upper.state").alias("state"), F.col("player_tracks.upper.source_frame").alias("source_frame"), F.round(F.get("player_tracks.upper.court_xy_m", 0) + 3e-8, 5).alias("x"))


@query("win22_shuttle_filter")
def win22(spark, d):
    """Sequential; tested against a plain statement of the rule and hand-worked cases."""
    t = tracking.track_shuttle(frames(spark, d), FPS)
    s = F.col("shuttle")
    return t.select("video_id", "frame_idx", s["tracking_state"].alias("tracking_state"), s["measurement_status"].alias("measurement_status"), F.round(F.get(s["smoothed_xy"], 0), 4).alias("x"), F.round(s["trajectory_reliability"], 6).alias("reliability"))


@query("prj12_measurements", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN has THEN 1 ELSE 0 END AS n FROM fr")
def prj12(spark, d):
    return frames(spark, d).select("video_id", "frame_idx", F.size(pose.measurements(F.col("shuttle"))).alias("n"))


@query("flt01_confident", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN has AND score >= 0.18::DOUBLE THEN 1 ELSE 0 END AS n FROM fr")
def flt01(spark, d):
    return frames(spark, d).select("video_id", "frame_idx", F.size(pose.measurements(F.col("shuttle"), tracking.LEAST_CONFIDENCE)).alias("n"))


@query("flt02_valid_wrists", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN up THEN 1 + CAST(ok AS INT) ELSE 0 END AS n FROM fr")
def flt02(spark, d):
    return frames(spark, d).select("video_id", "frame_idx", F.coalesce(F.size(pose.wrists(pose.of_side(F.col("players"), "upper"))), F.lit(0)).alias("n")).withColumn("n", F.when(F.col("n") < 0, 0).otherwise(F.col("n")))


@query("prj10_foot_point", f"WITH {FR} SELECT {V}, frame AS frame_idx, 150.0::DOUBLE AS x, 300.0::DOUBLE AS y FROM fr WHERE up")
def prj10(spark, d):
    p = pose.foot_point(pose.of_side(F.col("players"), "upper"))
    return frames(spark, d).filter("id % 4 <> 0").select("video_id", "frame_idx", F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))


HM = "hm AS (SELECT 0.01::DOUBLE AS a, 0.002::DOUBLE AS b, -1.0::DOUBLE AS c, 0.0005::DOUBLE AS d, 0.02::DOUBLE AS e, -2.0::DOUBLE AS f, 0.0001::DOUBLE AS g, 0.0002::DOUBLE AS h)"
PROJ = f"{FR}, {HM}, pj AS (SELECT fr.*, (a * x + b * y + c) / (g * x + h * y + 1) AS u, (d * x + e * y + f) / (g * x + h * y + 1) AS v FROM fr, hm WHERE has)"
MATRIX = ((0.01, 0.002, -1.0), (0.0005, 0.02, -2.0), (0.0001, 0.0002, 1.0))


def projected(spark, d) -> DataFrame:
    u, v = geometry.project(geometry.matrix(MATRIX), F.get("shuttle.smoothed_xy", 0), F.get("shuttle.smoothed_xy", 1))
    return frames(spark, d).filter("shuttle.smoothed_xy is not null").select("video_id", "frame_idx", u.alias("u"), v.alias("v"))


@query("prj11_projection", f"WITH {PROJ} SELECT {V}, frame AS frame_idx, round(u, 6) AS u, round(v, 6) AS v FROM pj")
def prj11(spark, d):
    return projected(spark, d).select("video_id", "frame_idx", *num("u", "v"))


@query("flt03_half_admission", f"WITH {PROJ} SELECT {V}, frame AS frame_idx, CASE WHEN u BETWEEN -0.4::DOUBLE AND 6.5::DOUBLE AND v BETWEEN -0.8::DOUBLE AND 6.7::DOUBLE THEN 'upper' WHEN u BETWEEN -0.4::DOUBLE AND 6.5::DOUBLE AND v > 6.7::DOUBLE AND v <= 14.2::DOUBLE THEN 'lower' END AS half FROM pj")
def flt03(spark, d):
    return projected(spark, d).select("video_id", "frame_idx", geometry.half(F.col("u"), F.col("v")).alias("half"))


@query("flt04_in_bounds", f"WITH {PROJ} SELECT {V}, frame AS frame_idx, u BETWEEN 0 AND 6.1::DOUBLE AND v BETWEEN 0 AND 13.4::DOUBLE AS in_bounds FROM pj")
def flt04(spark, d):
    return projected(spark, d).select("video_id", "frame_idx", geometry.in_bounds(F.col("u"), F.col("v")).alias("in_bounds"))


@query("flt20_court_half", f"WITH {PROJ}, n AS (SELECT video, frame, u / 6.1::DOUBLE AS p, v / 13.4::DOUBLE AS q FROM pj) SELECT {V}, frame AS frame_idx, CASE WHEN p > -0.15::DOUBLE AND p < 1.15::DOUBLE AND q > -0.05::DOUBLE AND q < 1.05::DOUBLE THEN CASE WHEN q > 0.55::DOUBLE THEN 2 ELSE 1 END ELSE 0 END AS half FROM n")
def flt20(spark, d):
    return projected(spark, d).select("video_id", "frame_idx", geometry.court_half(F.col("u") / 6.1, F.col("v") / 13.4, (0.1, 0.0)).alias("half"))


CORNER_SQL = f"{FR}, co AS (SELECT DISTINCT id % 7 AS k FROM fr), pt AS (SELECT k, [300.0::DOUBLE, 980, 1200 + k * 40, 80] AS xs, [150.0::DOUBLE, 150 + k * 100, 700, 700] AS ys FROM co)"


def corners() -> Column:
    k = F.col("k")
    return F.array(F.array(F.lit(300.0), F.lit(150.0)), F.array(F.lit(980.0), 150.0 + k * 100), F.array(1200.0 + k * 40, F.lit(700.0)), F.array(F.lit(80.0), F.lit(700.0)))


def corner_rows(spark, d) -> DataFrame:
    return frames(spark, d).select((F.col("id") % 7).alias("k")).distinct().withColumn("corners", corners())


@query("flt09_corner_check", f"WITH {CORNER_SQL}, c AS (SELECT *, (xs[2] - xs[1]) * (ys[3] - ys[2]) - (ys[2] - ys[1]) * (xs[3] - xs[2]) AS c1, (xs[3] - xs[2]) * (ys[4] - ys[3]) - (ys[3] - ys[2]) * (xs[4] - xs[3]) AS c2, (xs[4] - xs[3]) * (ys[1] - ys[4]) - (ys[4] - ys[3]) * (xs[1] - xs[4]) AS c3, (xs[1] - xs[4]) * (ys[2] - ys[1]) - (ys[1] - ys[4]) * (xs[2] - xs[1]) AS c4 FROM pt) SELECT k, CASE WHEN xs[3] > 1280 THEN 'All corners must be inside the image' WHEN NOT (least(c1, c2, c3, c4) > 0 OR greatest(c1, c2, c3, c4) < 0) THEN 'Court corners cross or form a concave quadrilateral' WHEN (ys[1] + ys[2]) / 2 >= (ys[3] + ys[4]) / 2 THEN 'Upper corners must be above lower corners' ELSE 'accepted' END AS message FROM c")
def flt09(spark, d):
    return corner_rows(spark, d).select("k", geometry.corner_check(F.col("corners"), F.lit(1280.0), F.lit(720.0))["message"].alias("message"))


@query("scl17_geometry", f"WITH {CORNER_SQL} SELECT k, round(abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2, 6) AS area, 6.1 AS u, 13.4 AS v FROM pt")
def scl17(spark, d):
    """Area by the shoelace, and the lower right corner sent to the court by the solved homography."""
    rows = corner_rows(spark, d).withColumn("h", geometry.homography(F.col("corners")))
    u, v = geometry.project(F.col("h"), F.get(F.get("corners", 2), 0), F.get(F.get("corners", 2), 1))
    return rows.select("k", F.round(F.abs(geometry.shoelace(F.col("corners"))), 6).alias("area"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("prj17_calibration_rows", f"WITH {CORNER_SQL} SELECT k AS version, xs[3] AS x, ys[2] AS y FROM pt")
def prj17(spark, d):
    c = corner_rows(spark, d).select(
        F.lit("c").alias("calibration_id"), F.lit("v").alias("video_id"), F.col("k").alias("version"), F.lit(0).alias("frame_time_ms"), F.transform("corners", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("corners"),
        F.lit(None).cast("array<array<double>>").alias("homography"), F.lit("upper_is_far_side").alias("court_orientation"), F.lit("accepted").alias("quality_status"), F.lit("manual").alias("source"),
    )
    r = export.calibration_rows(c)
    return r.select("version", F.get(F.get("corners", 2), 0).alias("x"), F.get(F.get("corners", 1), 1).alias("y"))


RALLIES = f"{EVS}, rl AS (SELECT *, frame // 40 AS rally FROM ev_)"


def rally_events(spark, d) -> DataFrame:
    return events(spark, d).withColumn("rally_id", F.floor(F.col("candidate_frame") / 40).cast("string"))


@query("join01_event_frames", f"WITH {EVS} SELECT CAST(e.video AS VARCHAR) AS video_id, event_id, f.state AS state FROM ev_ e LEFT JOIN fr f ON f.video = e.video AND f.frame = e.frame")
def join01(spark, d):
    f = frames(spark, d).select("video_id", F.col("frame_idx").alias("candidate_frame"), F.col("shuttle.tracking_state").alias("state"))
    return events(spark, d).join(f, ["video_id", "candidate_frame"], "left").select("video_id", "event_id", "state")


NEXT = f"{RALLIES}, nx AS (SELECT *, lead(frame) OVER (PARTITION BY video, rally ORDER BY frame, event_id) AS target, lead(hitter) OVER (PARTITION BY video, rally ORDER BY frame, event_id) AS rec FROM rl), cf AS (SELECT video, frame, CASE WHEN sure THEN x + 2 ELSE x END AS px, CASE WHEN sure THEN y + 1 ELSE y END AS py, greatest(0, least(1, coalesce(rel, 0) * exp(-(id % 8 / 100)) * CASE WHEN state = 'measured' THEN 1 ELSE 0.55::DOUBLE END)) AS cf FROM fr WHERE has)"
BALL = f"{NEXT}, bl AS (SELECT n.video, n.event_id, c.frame, c.px, c.py, c.cf - 0.02::DOUBLE * abs(c.frame - n.target) AS score, row_number() OVER (PARTITION BY n.video, n.event_id ORDER BY c.cf - 0.02::DOUBLE * abs(c.frame - n.target) DESC, c.frame) AS k FROM nx n JOIN cf c ON c.video = n.video AND c.frame BETWEEN n.target - 3 AND n.target + 3)"


@query("join07_nearest_evidence", f"WITH {BALL} SELECT {V}, event_id, frame AS ball_frame, round(score, 6) AS ball_score FROM bl WHERE k = 1")
def join07(spark, d):
    e = destination.followers(rally_events(spark, d))
    return destination.nearest_evidence(e, frames(spark, d), "_target").select("video_id", "event_id", "ball_frame", F.round("ball_score", 6).alias("ball_score"))


@query("join08_receiver", f"WITH {NEXT} SELECT CAST(n.video AS VARCHAR) AS video_id, event_id, CASE WHEN rec = 'upper' AND up OR rec = 'lower' AND lo THEN f.id * 7 % 61 / 10 END AS x, CASE WHEN rec = 'upper' AND up OR rec = 'lower' AND lo THEN 0.62 ELSE 0 END AS confidence FROM nx n JOIN fr f ON f.video = n.video AND f.frame = n.target")
def join08(spark, d):
    e = destination.followers(rally_events(spark, d)).filter("_target is not null").select("video_id", "event_id", F.col("_target").alias("frame_idx"), "_receiver")
    at, sure = destination.receiver(F.col("_receiver"))
    j = e.join(frames(spark, d).drop("id"), ["video_id", "frame_idx"])
    return j.select("video_id", "event_id", F.get(at, 0).alias("x"), sure.alias("confidence"))


@query("win28_terminal_contact")
def win28(spark, d):
    """Last points of rallies; tested by hand-worked cases."""
    e = destination.followers(rally_events(spark, d)).filter("_target is null").withColumn("play_state_segment_id", F.lit(None).cast("string"))
    f = frames(spark, d).withColumn("play_state_segment_id", F.lit(None).cast("string"))
    return destination.terminal(e, f, geometry.matrix(MATRIX))


@query("win29_destinations")
def win29(spark, d):
    """Fused landings; their parts have SQL (join07, join08), the whole is tested by hand-worked cases."""
    e = rally_events(spark, d).withColumn("play_state_segment_id", F.lit(None).cast("string"))
    f = frames(spark, d).withColumn("play_state_segment_id", F.lit(None).cast("string"))
    return destination.destinations(f, e, geometry.matrix(MATRIX)).select("video_id", "event_id", "predicted_landing_x", "predicted_landing_y", "landing_frame", "landing_kind", "landing_confidence", "landing_status", "landing_source", "landing_proxy_kind")


@query("join22_dense_windows", f"WITH {EVS}, sl AS (SELECT video, event_id, frame - 15 + i AS f, i FROM ev_ CROSS JOIN range(30) t(i)) SELECT CAST(sl.video AS VARCHAR) AS video_id, event_id, count(*) AS slots, count(fr.frame) AS there, min(f) AS first FROM sl LEFT JOIN fr ON fr.video = sl.video AND fr.frame = sl.f GROUP BY ALL")
def join22(spark, d):
    w = tensors.dense_window(events(spark, d), frames(spark, d), 30, ["timestamp_sec"])
    return w.select("video_id", "event_id", F.size("window").cast("long").alias("slots"), F.size(F.filter("window", lambda r: r["mask"])).cast("long").alias("there"), F.get("window", 0)["frame_idx"].alias("first"))


CLIPS = f"{RALLIES}, en AS (SELECT video, min(frame) AS f0, max(frame) AS f9 FROM fr GROUP BY video), cl AS (SELECT rl.video, event_id, greatest(coalesce((lag(frame) OVER o + frame) // 2, frame - 30), f0) AS a, least(coalesce((frame + lead(frame) OVER o) // 2, frame + 30), f9) AS z FROM rl JOIN en USING (video) WINDOW o AS (PARTITION BY rl.video, rally ORDER BY frame, event_id))"


def clips(spark, d) -> DataFrame:
    f = frames(spark, d)
    ends = f.groupBy("video_id").agg(F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f9"))
    return tensors.clip_bounds(rally_events(spark, d).join(F.broadcast(ends), "video_id"), F.col("f0"), F.col("f9"))


@query("win25_clip_bounds", f"WITH {CLIPS} SELECT {V}, event_id, a AS clip_start, greatest(a, z) AS clip_end FROM cl")
def win25(spark, d):
    return clips(spark, d).select("video_id", "event_id", F.col("clip_start").cast("long").alias("clip_start"), F.col("clip_end").cast("long").alias("clip_end"))


@query("win26_strided", f"WITH {FR}, mm AS (SELECT video, min(frame) AS a, max(frame) AS z FROM fr GROUP BY video), ss AS (SELECT *, z - a + 1 AS n, (z - a + 1) // 100 + CASE WHEN (z - a + 1) % 100 > 50 THEN 1 ELSE 0 END AS st FROM mm) SELECT {V}, CASE WHEN n <= 100 THEN n ELSE least(100, (n - 1) // st + 1) END AS picked, CASE WHEN n <= 100 THEN z ELSE a + (least(100, (n - 1) // st + 1) - 1) * st END AS last FROM ss")
def win26(spark, d):
    m = frames(spark, d).groupBy("video_id").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("z"))
    i = tensors.strided(F.col("a"), F.col("z"))
    return m.select("video_id", F.size(i).cast("long").alias("picked"), F.element_at(i, -1).alias("last"))


@query("win27_limited_windows", f"WITH {EVS}, en AS (SELECT video, min(frame) AS f0, max(frame) AS f9 FROM fr GROUP BY video), b AS (SELECT e.video, event_id, frame, f0, f9, CASE WHEN frame - lag(frame) OVER o <= 180 THEN lag(frame) OVER o END AS p, CASE WHEN lead(frame) OVER o - frame <= 180 THEN lead(frame) OVER o END AS n FROM ev_ e JOIN en USING (video) WINDOW o AS (PARTITION BY e.video ORDER BY frame, event_id)) SELECT {V}, event_id, greatest(f0, frame - 45, coalesce(p, frame - 15)) AS start_frame, least(f9 + 1, frame + 52, coalesce(n + 7, frame + 15)) AS end_frame_exclusive FROM b")
def win27(spark, d):
    f = frames(spark, d)
    ends = f.groupBy("video_id").agg(F.min("frame_idx").alias("f0"), (F.max("frame_idx") + 1).alias("f9"))
    w = tensors.limited_windows(events(spark, d).join(F.broadcast(ends), "video_id"), FPS, F.col("f0"), F.col("f9"))
    return w.select("video_id", "event_id", "start_frame", "end_frame_exclusive")


@query("win30_contiguous_windows", f"WITH {FR}, c AS (SELECT video, frame, lead(frame, 11) OVER o AS last, count(*) FILTER (WHERE id % 17 = 0) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 6 FOLLOWING AND 11 FOLLOWING) AS n FROM fr WINDOW o AS (PARTITION BY video ORDER BY frame)) SELECT {V}, frame AS frame_idx, CASE WHEN n > 0 THEN 1 ELSE 0 END AS window_label FROM c WHERE last = frame + 11")
def win30(spark, d):
    f = frames(spark, d).select("video_id", "frame_idx", F.array("timestamp_sec").alias("features"), "id")
    gold = f.filter("id % 17 = 0").select("video_id", F.col("frame_idx").alias("hit_frame"), F.lit("lower").alias("hitter"))
    return tensors.feature_windows(f, ["video_id"], "frame_idx", "features", gold).select("video_id", "frame_idx", "window_label")


@query("flt21_contiguity", f"WITH {FR}, g AS (SELECT video, frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) AS g FROM fr) SELECT {V}, coalesce(bool_and(g = 1), true) AS contiguous FROM g GROUP BY video")
def flt21(spark, d):
    return tensors.contiguous(frames(spark, d), ["video_id"], "frame_idx")


@query("agg49_tensor_coverage", f"WITH {EVS}, sl AS (SELECT video, event_id, hitter, frame - 15 + i AS f FROM ev_ CROSS JOIN range(30) t(i) WHERE hitter IS NOT NULL) SELECT round(avg(CASE WHEN fr.frame IS NULL THEN 0 ELSE 1 END), 6) AS frame, round(avg(CASE WHEN has THEN 1 ELSE 0 END), 6) AS shuttle, round(avg(CASE WHEN has AND state = 'measured' THEN 1 ELSE 0 END), 6) AS shuttle_measured, round(avg(CASE WHEN hitter = 'upper' AND up OR hitter = 'lower' AND lo THEN (1 + CAST(ok AS INT)) / 17 ELSE 0 END), 6) AS pose_keypoint FROM sl LEFT JOIN fr ON fr.video = sl.video AND fr.frame = sl.f")
def agg49(spark, d):
    s = tensors.stroke_samples(frames(spark, d).drop("id"), events(spark, d).filter("predicted_hitter is not null").drop("id"))
    return tensors.coverage(s).select(*num("frame", "shuttle", "shuttle_measured", "pose_keypoint"))


@query("agg61_label_counts", f"WITH {EVS} SELECT CASE WHEN id % 4 = 0 THEN 'unknown' ELSE 'clear' END AS label, count(*) AS n FROM ev_ GROUP BY ALL")
def agg61(spark, d):
    e = events(spark, d).withColumn("predicted_stroke_type", F.when(F.col("id") % 4 != 0, " clear"))
    return tensors.label_counts(e.select(tensors.label_of(e).alias("label")))


@query("agg50_clip_quality", f"WITH {CLIPS}, ix AS (SELECT video, event_id, unnest(range(a, greatest(a, z) + 1)) AS f FROM cl), q AS (SELECT ix.video, event_id, CASE WHEN fr.frame IS NOT NULL AND has AND up AND lo THEN (1 + CAST(ok AS INT)) / 17 ELSE 0 END AS v FROM ix LEFT JOIN fr ON fr.video = ix.video AND fr.frame = ix.f) SELECT {V}, event_id, round(avg(v), 6) AS sample_quality FROM q GROUP BY ALL")
def agg50(spark, d):
    c = tensors.clip_inputs(frames(spark, d).drop("id"), rally_events(spark, d).drop("id"))
    return c.select("video_id", "event_id", F.round("sample_quality", 6).alias("sample_quality"))


@query("scl18_normalised_pose", f"WITH {FR} SELECT {V}, frame AS frame_idx, round((ax - 100) / sqrt(50000.0::DOUBLE), 6) AS x, round((1 + CAST(ok AS INT)) / 17, 6) AS coverage FROM fr WHERE up")
def scl18(spark, d):
    f = frames(spark, d).filter("id % 4 <> 0").select("video_id", "frame_idx", pose.normalised_pose(pose.of_side(F.col("players"), "upper")).alias("p"))
    return f.select("video_id", "frame_idx", F.round(F.get(F.get("p.points", 9), 0), 6).alias("x"), F.round("p.coverage", 6).alias("coverage"))


@query("scl19_bone_vectors", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN ok AND ax <> 0 AND bx <> 0 THEN bx - ax ELSE 0 END AS dx FROM fr WHERE up")
def scl19(spark, d):
    p = pose.of_side(F.col("players"), "upper")
    points = F.transform(p["keypoints_xy"], lambda q, i: F.when(F.get(p["keypoint_scores"], i) >= 0.2, q).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    b = pose.bones(points, ((9, 10),))
    return frames(spark, d).filter("id % 4 <> 0").select("video_id", "frame_idx", F.get(F.get(b, 0), 0).alias("dx"))


@query("scl20_parity_scaling", f"WITH {FR}, m AS (SELECT video, x, CASE WHEN has AND x <> 0 THEN x END AS v FROM fr) SELECT {V}, round(sum(coalesce((v - lo_) / greatest(hi_ - lo_, 1e-6) + 1, 0)), 4) AS total FROM (SELECT *, min(v) OVER (PARTITION BY video) AS lo_, max(v) OVER (PARTITION BY video) AS hi_ FROM m) GROUP BY video")
def scl20(spark, d):
    f = frames(spark, d).select("video_id", "frame_idx", F.array(F.coalesce(F.get("shuttle.smoothed_xy", 0), F.lit(0.0)), F.lit(0.0)).alias("features"))
    return tensors.scale_features(f, ["video_id"]).groupBy("video_id").agg(F.round(F.sum(F.get("features", 0)), 4).alias("total"))


@query("scl21_softmax", f"WITH {FR} SELECT {V}, frame AS frame_idx, round(exp(id % 3) / (exp(id % 3) + exp(id % 5) + exp(1)), 6) AS p FROM fr")
def scl21(spark, d):
    s = pose.softmax(F.array((F.col("id") % 3).cast("double"), (F.col("id") % 5).cast("double"), F.lit(1.0)))
    return frames(spark, d).select("video_id", "frame_idx", F.round(F.get(s, 0), 6).alias("p"))


@query("srt03_top_classes", f"WITH {FR}, c AS (SELECT video, frame, unnest(['Top_a', 'Bottom_b', 'unknown', 'Top_d']) AS n, unnest([id % 7, id % 5, id % 3, id % 2]) AS p, unnest([0, 1, 2, 3]) AS i FROM fr), k AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY p DESC, i) AS k FROM c) SELECT {V}, frame AS frame_idx, string_agg(n, ',' ORDER BY k) AS top FROM k WHERE k <= 3 GROUP BY ALL")
def srt03(spark, d):
    p = F.array(*[(F.col("id") % m).cast("double") for m in (7, 5, 3, 2)])
    t = pose.top_classes(p, ["Top_a", "Bottom_b", "unknown", "Top_d"])
    return frames(spark, d).select("video_id", "frame_idx", F.concat_ws(",", F.transform(t, lambda r: r["raw_class"])).alias("top"))


@query("scl11_class_collapse", f"WITH {FR}, c AS (SELECT DISTINCT ['Top_net shot', 'Bottom_smash', 'unknown'][CAST(id % 3 AS INT) + 1] AS raw, id % 10 / 10 AS conf FROM fr) SELECT raw, conf, CASE WHEN raw = 'unknown' THEN 'unknown' ELSE substr(raw, strpos(raw, '_') + 1) END AS label, CASE WHEN raw = 'unknown' THEN 'unknown' WHEN conf < 0.35::DOUBLE THEN 'low_confidence' ELSE 'predicted' END AS status FROM c")
def scl11(spark, d):
    raw = F.get(F.array(F.lit("Top_net shot"), F.lit("Bottom_smash"), F.lit("unknown")), (F.col("id") % 3).cast("int"))
    c = frames(spark, d).select(raw.alias("raw"), (F.col("id") % 10 / 10).alias("conf")).distinct().withColumn("label", fn.collapse_class(F.col("raw")))
    return c.withColumn("status", fn.stroke_status(F.col("label"), F.col("conf"), F.lit(0.9)))


@query("prj13_poses", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN id % 9 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN id % 9 = 0 THEN CAST(id % 50 AS DOUBLE) ELSE least(CAST(id % 50 AS DOUBLE), 25.0) END AS first_bottom FROM fr")
def prj13(spark, d):
    def person(y: Column, score: Column) -> Column:
        return F.struct(F.array(*[F.array(F.lit(float(i)), y) for i in range(17)]).alias("points"), F.array(*[score] * 17).alias("scores"))

    people = F.array(person(F.lit(25.0), F.when(F.col("id") % 9 == 0, 0.1).otherwise(0.9)), person((F.col("id") % 50).cast("double"), F.lit(0.5)))
    p = pose.poses(people)
    return frames(spark, d).select("video_id", "frame_idx", F.size(p).alias("n"), F.get(F.get(p, 0)["bbox_xyxy"], 3).alias("first_bottom"))


@query("prj14_shuttle_top", f"WITH {FR} SELECT {V}, frame AS frame_idx, CASE WHEN id % 3 >= id % 5 THEN 5.0 ELSE 15.0 END AS x FROM fr")
def prj14(spark, d):
    boxes = F.array(*[F.array(*[F.lit(v) for v in b]) for b in ((0.0, 0.0, 10.0, 10.0), (10.0, 10.0, 20.0, 20.0))])
    c = pose.shuttle_candidates(F.array((F.col("id") % 3).cast("double"), (F.col("id") % 5).cast("double")), boxes)
    return frames(spark, d).select("video_id", "frame_idx", F.get(F.get(c, 0)["raw_xy"], 0).alias("x"))


@query("win24_best_of_half", f"WITH {FR}, c AS (SELECT video, frame, id, unnest([0, 1, 2]) AS i, unnest([id % 61 / 10, id % 47 / 10, id % 53 / 10]) AS x, unnest([id % 67 / 10, id % 59 / 10, id % 134 / 10]) AS y FROM fr), k AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY abs(x - 3.05::DOUBLE) + 0.08::DOUBLE * abs(y - 3.35::DOUBLE), i) AS k FROM c WHERE x BETWEEN -0.4 AND 6.5 AND y BETWEEN -0.8 AND 6.7::DOUBLE) SELECT {V}, frame AS frame_idx, x FROM k WHERE k = 1")
def win24(spark, d):
    def one(mx: int, my: int) -> Column:
        p = player("candidate", F.lit(True), (53, 29), (17, 71))
        return p.withField("court_xy_m", F.array(F.col("id") % mx / 10, F.col("id") % my / 10))

    f = frames(spark, d).withColumn("people", F.array(one(61, 67), one(47, 59), one(53, 134)))
    return f.select("video_id", "frame_idx", F.get(tracking.best_of_half(F.col("people"), "upper")["court_xy_m"], 0).alias("x"))


@query("join25_overlay", f"WITH {EVS} SELECT CAST(f.video AS VARCHAR) AS video_id, f.frame AS frame_idx, e.event_id FROM fr f LEFT JOIN ev_ e ON e.video = f.video AND e.frame = f.frame")
def join25(spark, d):
    e = events(spark, d).groupBy("video_id", F.col("candidate_frame").alias("frame_idx")).agg(F.max("event_id").alias("event_id"))
    return frames(spark, d).select("video_id", "frame_idx").join(e, ["video_id", "frame_idx"], "left")


@query("agg62_visible_events", f"WITH {EVS} SELECT {V}, count(*) FILTER (WHERE frame >= 30 AND frame < 60) AS visible FROM ev_ GROUP BY video")
def agg62(spark, d):
    from rallyline.operators import batch

    return batch.side_counts(events(spark, d), ["video_id"], "candidate_frame", 30, 60)


@query("join18_predictions", f"WITH {EVS} SELECT {V}, event_id, CASE WHEN id % 2 = 0 THEN 'smash' ELSE 'old' END AS stroke FROM ev_")
def join18(spark, d):
    e = events(spark, d).withColumn("stroke", F.lit("old"))
    p = e.filter("id % 2 = 0").select("event_id", F.lit("smash").alias("new"))
    return e.join(p, "event_id", "left").select("video_id", "event_id", F.coalesce("new", "stroke").alias("stroke"))
