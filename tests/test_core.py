"""Hand-worked cases of the operators: values follow from the rules as they are documented."""

import json
import math
import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyline import functions as fn
from rallyline import orchestration, schemas, sinks, sources
from rallyline.functions import geometry, pose
from rallyline.operators import batch, destination, evaluation, export, fusion, hits, playstate, profile, review, tracking, views
from rallyline.sources import media, sqlite

def identity():
    return geometry.matrix([[1, 0, 0], [0, 1, 0], [0, 0, 1]])


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("side", "y", "zone"), [
    ("upper", 0.0, "后场"), ("upper", 6.7 / 3 - 1e-9, "后场"), ("upper", 6.7 / 3, "中场"), ("upper", 2 * 6.7 / 3 + 1e-9, "前场"), ("upper", 6.7, "前场"), ("upper", 6.8, None),
    ("lower", 13.4, "后场"), ("lower", 6.7, "前场"), ("lower", 6.0, None), ("referee", 3.0, None), ("upper", None, None), ("upper", -0.1, None),
])
def test_depth_zone(spark, side, y, zone):
    assert col(spark, fn.depth_zone(F.lit(side), F.lit(y).cast("double"))) == zone


@pytest.mark.parametrize(("own", "landing", "line"), [(3.0, 3.0 - 6.1 / 6 - 1e-9, "左偏"), (3.0, 2.0, "中路"), (3.0, 4.5, "右偏"), (1.0, 1.0, "中路"), (None, 1.0, None), (1.0, None, None)])
def test_line_class(spark, own, landing, line):
    assert col(spark, fn.line_class(F.lit(own).cast("double"), F.lit(landing).cast("double"))) == line


def test_small_scalars(spark):
    assert [col(spark, fn.whole(F.lit(t))) for t in ("3.9", " 4 ", "", "nan", "x")] == [3, 4, None, None, None]
    assert [col(spark, fn.macro_of(F.lit(t))) for t in ("rush", "driven flight", None)] == ["网前/前场", "unknown", "unknown"]
    assert [col(spark, fn.collapse_class(F.lit(t))) for t in ("Top_net shot", "unknown")] == ["net shot", "unknown"]
    assert col(spark, fn.ids_match(F.lit("vid_abc"), F.lit("abcdef"))) and not col(spark, fn.ids_match(F.lit("vid_abd"), F.lit("abcdef")))
    assert [col(spark, fn.half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 1.0), ("c", None)], "k string, v double")
    wanted = {f"{r}_{f}": (f, r) for r in fn.RANKS for f in (0.25, 0.5, 0.9)}
    got = {r.k: r.asDict() for r in fn.order_statistics(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"a", "b"}
    for f in (0.25, 0.5, 0.9):
        assert got["a"][f"nearest_{f}"] == round(9 * f) and got["a"][f"truncated_{f}"] == int(9 * f) and got["a"][f"higher_{f}"] == math.ceil(9 * f)


def test_homography_takes_corners_to_the_court(spark):
    corners = [(300.0, 150.0), (980.0, 150.0), (1200.0, 700.0), (80.0, 700.0)]
    c = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in corners])
    h = spark.range(1).select(geometry.homography(c).alias("h"))
    for (x, y), want in zip(corners, [(0, 0), (6.1, 0), (6.1, 13.4), (0, 13.4)], strict=True):
        u, v = geometry.project(F.col("h"), F.lit(x), F.lit(y))
        assert tuple(h.select(u.alias("u"), v.alias("v")).first()) == pytest.approx(want, abs=1e-9)
    rows, rhs = [], []
    for (x, y), (u, v) in zip(corners, [(0, 0), (6.1, 0), (6.1, 13.4), (0, 13.4)], strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    assert np.array(h.first().h).ravel()[:8] == pytest.approx(np.linalg.solve(np.array(rows), np.array(rhs)), rel=1e-6)
    same = F.array(*[F.array(F.lit(1.0), F.lit(1.0))] * 4)
    assert col(spark, geometry.homography(same)) is None
    with pytest.raises(Exception, match="infinity"):
        col(spark, geometry.project(geometry.matrix([[1, 0, 0], [0, 1, 0], [0, 0, 0]]), F.lit(1.0), F.lit(1.0))[0])


@pytest.mark.parametrize(("corners", "message"), [
    ([(300, 150), (980, 150), (1200, 700), (80, 700)], "accepted"), ([(300, 150), (980, 150), (80, 700), (1200, 700)], "Court corners cross or form a concave quadrilateral"),
    ([(300, 150), (980, 150), (1300, 700), (80, 700)], "All corners must be inside the image"), ([(300, 150), (310, 150), (310, 160), (300, 160)], "Court quadrilateral is too small"),
    ([(80, 700), (1200, 700), (980, 150), (300, 150)], "Upper corners must be above lower corners"), ([(1, 1)], "Exactly four court corners are required"),
])
def test_corner_check(spark, corners, message):
    c = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in corners])
    got = col(spark, geometry.corner_check(c, F.lit(1280.0), F.lit(720.0)))
    assert (got.message, got.valid) == (message, message == "accepted")


def player(side, x, y, wrist=None):
    points = [[float(x), float(y)] for _ in range(17)]
    if wrist:
        points[9] = points[10] = [float(v) for v in wrist]
    return {"identity": side, "bbox_xyxy": [x - 5.0, y - 20.0, x + 5.0, float(y)], "keypoints_xy": points, "keypoint_scores": [0.9] * 17, "keypoint_missing": [False] * 17}


def frames(spark, rows):
    fill = [{"video_id": "v", "timestamp_sec": r["frame_idx"] / 30, "width": 100, "height": 100, "players": [], "shuttle": {}, **r} for r in rows]
    return sources.parse_lines(spark.createDataFrame([(json.dumps(r),) for r in fill], "value string"), schemas.FRAME)


def test_foot_point(spark):
    f = frames(spark, [{"frame_idx": 0, "players": [player("upper", 10, 20)]}])
    assert f.select(pose.foot_point(F.get("players", 0)).alias("p")).first().p == [10.0, 20.0]
    hidden = player("upper", 10, 20) | {"keypoint_missing": [True] * 17}
    assert frames(spark, [{"frame_idx": 0, "players": [hidden]}]).select(pose.foot_point(F.get("players", 0)).alias("p")).first().p == [10.0, 20.0]


def test_players_are_projected_chosen_and_carried(spark):
    f = frames(spark, [{"frame_idx": 10, "players": [player("x", 3, 4), player("y", 9, 9)]}, {"frame_idx": 11}, {"frame_idx": 17}])
    e = {r.frame_idx: r for r in tracking.enrich(f, identity(), 30.0).collect()}
    assert [(p.identity, p.court_xy_m, p.court_in_bounds) for p in e[10].players] == [("upper", [3.0, 4.0], True)] and e[10].pose_candidate_count == 2
    assert [(e[i].player_tracks.upper.state, e[i].player_tracks.upper.court_xy_m) for i in (10, 11, 17)] == [("measured", [3.0, 4.0]), ("predicted", [3.0, 4.0]), ("missing", None)]


def test_smoothing_equals_the_recurrence(spark):
    rng = np.random.default_rng(1)
    spots = {i: (rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(300) if i % 7}
    f = frames(spark, [{"frame_idx": i, "players": [player("upper", *spots[i]) | {"court_xy_m": list(spots[i])}] if i in spots else []} for i in range(300)])
    got = {r.frame_idx: r.player_tracks.upper.court_xy_m for r in tracking.track_players(f).collect()}
    at = None
    for i in range(300):
        if i in spots:
            at = spots[i] if at is None else tuple(0.65 * a + 0.35 * b for a, b in zip(spots[i], at, strict=True))
        if at:
            assert got[i] == pytest.approx(at, abs=1e-12)


def test_shuttle_prefers_the_continuous_candidate(spark):
    one = {"raw_xy": [10, 10], "confidence": 0.8, "candidates": [{"raw_xy": [10, 10], "confidence": 0.8}]}
    two = {"raw_xy": [90, 90], "confidence": 0.9, "candidates": [{"raw_xy": [90, 90], "confidence": 0.9}, {"raw_xy": [12, 10], "confidence": 0.3}]}
    e = {r.frame_idx: r.shuttle for r in tracking.enrich(frames(spark, [{"frame_idx": 0, "shuttle": one}, {"frame_idx": 1, "shuttle": two}, {"frame_idx": 2, "shuttle": {"raw_xy": [14, 10], "confidence": 0.8}}]), identity(), 30.0).collect()}
    assert (e[1].detector_candidate_count, e[1].selected_candidate_rank, e[1].associated_xy) == (2, 1, [12.0, 10.0])
    assert e[0].measurement_status == "initialized" and e[0].trajectory_reliability == 1.0


def test_shuttle_far_off_is_suppressed_carried_and_reset(spark):
    near = lambda x: {"raw_xy": [x, 10], "confidence": 0.8}
    rows = [{"frame_idx": 0, "shuttle": near(10)}, {"frame_idx": 1, "shuttle": near(90)}, *[{"frame_idx": i} for i in range(2, 9)], {"frame_idx": 40, "shuttle": near(50)}]
    e = {r.frame_idx: r.shuttle for r in tracking.enrich(frames(spark, rows), identity(), 30.0).collect()}
    assert (e[1].measurement_status, e[1].tracking_state, e[1].associated_xy) == ("soft_suppressed", "predicted", [90.0, 10.0])
    assert [e[i].measurement_status for i in range(2, 9)] == ["predicted_missing"] * 5 + ["reset_after_missing", "no_measurement"]
    assert e[2].trajectory_reliability == pytest.approx(1 - 1 / 6) and e[6].trajectory_reliability == pytest.approx(0.2)
    assert (e[40].measurement_status, e[40].smoothed_xy) == ("initialized", [50.0, 10.0])


def test_shuttle_parts_are_followed_as_a_stream(spark):
    rows = [{"video_id": f"v{v}", "frame_idx": 40 * k + i, "shuttle": {"raw_xy": [float(10 + 3 * i + v), 20.0 + k], "confidence": 0.5 + i / 10} if i != 2 else {}} for v in range(3) for k in range(20) for i in range(4)]
    f = frames(spark, rows + [{"video_id": "w", "frame_idx": 0, "players": None, "shuttle": {"raw_xy": [5.0, 6.0], "confidence": 0.9}}])
    got = tracking.track_shuttle(f, 30.0)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # a group a part costs more than its rows
    seen = {(r.video_id, r.frame_idx): r.shuttle for r in got.collect()}
    assert len(seen) == 241 and seen["w", 0].smoothed_xy == [5.0, 6.0]
    for v in range(3):
        for k in range(20):
            state = tracking.Shuttle(30.0)
            for i in range(4):
                want = state.see(40 * k + i, math.hypot(100, 100), [(0, float(10 + 3 * i + v), 20.0 + k, 0.5 + i / 10)] if i != 2 else [], [], 0.0)
                s = seen[f"v{v}", 40 * k + i]
                assert [s[n] for n in tracking.FOLLOWED] == [want.get(n) for n in tracking.FOLLOWED] and s.detector_candidate_count == int(i != 2)


def test_shuttle_step_by_the_formulas():
    s = tracking.Shuttle(30.0)
    s.see(0, 100.0, [(0, 10.0, 10.0, 0.9)], [], 0.0)
    got = s.see(1, 100.0, [(0, 14.0, 10.0, 0.9)], [(14.0, 10.0)], 0.0)
    gate = 100 * min(0.22, 0.025 + 0.08 + 0.02)
    fit = math.exp(-0.5 * (4 / gate) ** 2)
    weight = max(0.05 + 0.95 * fit, 0.8)
    assert got["adaptive_gate_px"] == pytest.approx(gate) and got["measurement_weight"] == pytest.approx(weight)
    assert got["association_score"] == pytest.approx(0.55 * 0.9 + 0.35 * fit + 0.1)
    assert got["smoothed_xy"][0] == pytest.approx(10 + 0.55 * (0.1 + 0.9 * weight) * 4)
    assert s.speed[0] == pytest.approx(0.16 * (0.05 + 0.95 * weight) * 4 * 30)
    assert got["tracking_uncertainty_px"] == pytest.approx(max(0.5, 2 * (0.9 - 0.35 * weight) + 0.4 * (1 - weight)))


def turning(spark):
    points = [(40, 50), (50, 50), (40, 50), (30, 50), (20, 50)]
    return frames(spark, [{"frame_idx": i, "players": [player("upper", 50, 80, (50, 50))], "shuttle": {"smoothed_xy": list(p)}} for i, p in enumerate(points)])


def test_turn_near_a_wrist_is_a_hit(spark):
    e = hits.candidates(hits.score(turning(spark), 30), 30, 0.3, 1).orderBy("candidate_frame").first()
    assert (e.candidate_frame, e.predicted_hitter, e.shuttle_image_xy, e.event_id) == (1, "upper", [50.0, 50.0], "evt_00000001")
    assert e.event_confidence == pytest.approx(0.52 * 0.7 + 0.33) and (e.window_start_frame, e.window_end_frame) == (0, 46)


def test_candidates_keep_their_distance(spark):
    points = [(40, 50), (50, 50), (40, 50)] * 12
    f = frames(spark, [{"frame_idx": i, "players": [player("upper", 50, 80, (50, 50))], "shuttle": {"smoothed_xy": list(p)}} for i, p in enumerate(points)])
    at = [r.candidate_frame for r in hits.candidates(hits.score(f, 30), 30, 0.3).orderBy("candidate_frame").collect()]
    assert len(at) > 1 and all(b - a >= 12 for a, b in zip(at, at[1:], strict=False))


def test_windowed_hitter(spark):
    rows = [("v", 99, "lower", 0.4, 0.5), ("v", 100, "lower", 0.5, 0.8), ("v", 102, "upper", 0.9, 0.6), ("v", 103, "lower", 1.0, 0.9)]
    s = spark.createDataFrame(rows, "video_id string, frame_idx long, predicted_hitter string, hand_distance_score double, event_confidence double")
    got = {r.frame_idx: tuple(r.hitter) for r in hits.assign_hitters(s, 2).collect()}
    assert got[100] == ("upper", 102, 0.9) and got[99] == ("lower", 100, 0.5)


def test_separation_is_greedy(spark):
    rnd = np.random.default_rng(3)
    rows = [(v, int(t), float(s)) for v in range(3) for t, s in zip(np.unique(rnd.integers(0, 400, 120)), rnd.integers(0, 5, 400), strict=False)]
    got = {(r.v, r.t) for r in hits.separate(spark.createDataFrame(rows, "v int, t int, s double"), ["v"], "t", "s", 12).collect()}
    want = set()
    for v in range(3):
        kept = []
        for _, t, s in sorted(r for r in rows if r[0] == v):
            if kept and t - kept[-1][0] < 12:
                if s > kept[-1][1]:
                    kept[-1] = (t, s)
            else:
                kept.append((t, s))
        want |= {(v, t) for t, _ in kept}
    assert got == want


def flight(spark, states):
    return frames(spark, [{"frame_idx": i, "shuttle": {"smoothed_xy": [float(2 * i), 10.0] if s != "missing" else None, "tracking_state": s}, "player_tracks": {"upper": {"state": "measured"}, "lower": {"state": "predicted"}}} for i, s in enumerate(states)])


def marks(spark, rows):
    return spark.createDataFrame([("v", f"e{f}", f, f / 30.0, h) for f, h in rows], "video_id string, event_id string, candidate_frame long, candidate_time double, predicted_hitter string")


def test_evidence_ratios(spark):
    e = playstate.evidence(flight(spark, ["measured"] * 20 + ["predicted"] * 5 + ["missing"] * 10), marks(spark, [(5, "upper"), (30, "lower")]), 30)
    got = {r.candidate_frame: r for r in e.collect()}
    assert (got[5].play_state_window_frames, got[5].play_state_shuttle_measured_ratio, got[5].play_state_nearby_candidate_count) == (21, round(20 / 21, 6), 2)
    assert got[5].play_state_score == pytest.approx(0.45 * 20 / 21 + 0.2 + 0.2 + 0.1 + 0.05 * 0.5, abs=2e-6)
    assert got[30].play_state_shuttle_tracked_ratio == round(10 / 20, 6)


def test_gate_keeps_alternating_hits_in_flight(spark):
    f, e = flight(spark, ["measured"] * 100 + ["missing"] * 100), marks(spark, [(10, "upper"), (40, "lower"), (70, "upper"), (150, "lower")])
    fr, ev, seg = playstate.gate(f, e, 30)
    s = seg.first()
    assert (s.start_frame, s.end_frame, s.link_count, s.event_ids, s.segment_id) == (6, 80, 2, ["e10", "e40", "e70"], "Active 01")
    assert {r.candidate_frame: r.play_state_gate_decision.split("_")[0] for r in ev.collect()} == {10: "kept", 40: "kept", 70: "kept", 150: "suppressed"}
    assert fr.filter("play_state = 'active_play'").count() == 75
    assert playstate.gate(f, e, 30, enabled=False)[1].first().play_state_gate_decision == "gate_disabled"


def test_gate_needs_another_side_and_support(spark):
    f = flight(spark, ["measured"] * 100)
    assert playstate.links(f, marks(spark, [(10, "upper"), (40, "upper")]), 30).count() == 0
    weak = marks(spark, [(10, "upper"), (40, "lower")]).withColumn("play_state_sequence_support", F.lit(0.5))
    assert playstate.links(f, weak, 30).count() == 0
    assert playstate.links(f, marks(spark, [(10, "upper"), (12, "lower")]), 30).count() == 0


def test_rallies(spark):
    e = spark.createDataFrame([("v", "a", 0, 1.0), ("v", "b", 1, 7.0), ("v", "c", 2, 13.1)], "video_id string, event_id string, candidate_frame long, candidate_time double")
    got = {r.event_id: (r.rally_id, r.rally_boundary_source, r.previous_hit_gap_sec) for r in playstate.rallies(e).collect()}
    assert got == {"a": ("Rally 01", "first_event", None), "b": ("Rally 01", "continuation", 6.0), "c": ("Rally 02", "time_gap", 6.1)}


def test_views(spark):
    flags = [False] * 3 + [True] * 10 + [False] * 3 + [True] * 6 + [False] * 8 + [True] * 4 + [False] * 2 + [True] * 2
    df = spark.createDataFrame([("v", i, f) for i, f in enumerate(flags)], "v string, i long, f boolean")
    runs = views.stable_runs(df, ["v"], "i", "f")
    assert sorted((r["first"], r["last"], r["n"]) for r in runs.collect()) == [(3, 21, 19), (30, 37, 8)]
    seg = views.segments(runs, ["v"], 25.0).orderBy("start_frame").collect()
    assert (seg[0].segment_id, seg[0].start_sec, seg[0].end_sec, seg[0].duration_sec) == ("main_001", 0.12, 0.88, 0.76)
    assert views.sample_times(views.segments(runs, ["v"], 25.0), ["v"], 25.0, 10_000).first().times == [480, 1340, 10_000]


@pytest.mark.parametrize(("scores", "configured", "want"), [([0.70, 0.71, 0.72], 0.8, 0.70 - 0.012), ([0.1, 0.5, 0.78], 0.8, 0.75), ([0.9] * 10, 0.8, 0.8), ([0.76] * 30 + [0.2] * 70 + [0.9], 0.85, 0.75), ([0.1, 0.2], 0.8, 0.8)])
def test_adaptive_threshold(spark, scores, configured, want):
    df = spark.createDataFrame([("v", s) for s in scores], "v string, s double")
    assert views.adaptive_threshold(df, ["v"], "s", configured).first().threshold == pytest.approx(want)


def test_flat_frames_and_events_have_all_columns(spark):
    f = tracking.enrich(turning(spark), identity(), 30.0)
    flat = export.frame_rows(f)
    assert len(flat.columns) == 53 and flat.filter("frame_idx = 0").first().shuttle_state == "missing"
    e = hits.candidates(hits.score(turning(spark), 30), 30, 0.3, 1).withColumn("rally_id", F.lit("r"))
    rows = export.event_rows(e)
    assert len(rows.columns) == 71
    r = rows.first()
    assert (r.stroke_index, r.player, r.stroke_type, r.set_id, r.landing_kind, r.annotation_status) == (1, "upper", "unknown", "unknown", "unknown", "unreviewed")
    q = export.quality(f, rows).first()
    assert q.status == "warning" and "shuttle track coverage is below 80%" in q.warnings and q.candidate_count == 1


def test_given_null_landing_wins(spark):
    e = spark.createDataFrame([("v", "a", 0, 0.0, True, None, 1.0), ("v", "b", 1, 1.0, False, None, 1.0)], "video_id string, event_id string, candidate_frame long, candidate_time double, human_landing_given boolean, human_landing_x double, predicted_landing_x double")
    assert {r.event_id: r.landing_x for r in export.event_rows(e).collect()} == {"a": None, "b": 1.0}


def destination_frames(spark, **at):
    rows = []
    for i in range(0, 60):
        s = at.get(f"f{i}")
        rows.append({"frame_idx": i, "shuttle": {"smoothed_xy": s, "tracking_state": "measured", "trajectory_reliability": 1.0, "innovation_ratio": 0.0} if s else {}, "player_tracks": {"lower": {"court_xy_m": [3.0, 10.0], "state": "measured"}, "upper": {"state": "missing"}}, "play_state_segment_id": "Active 01" if i < 30 else None})
    return frames(spark, rows)


def test_destinations(spark):
    f = destination_frames(spark, f20=[2.0, 9.0], f5=[1.0, 1.0], f6=[1.0, 2.0])
    e = marks(spark, [(0, "upper"), (20, "lower")]).withColumn("rally_id", F.lit("r")).withColumn("play_state_segment_id", F.lit("Active 01"))
    got = {r.candidate_frame: r for r in destination.destinations(f, e, identity()).collect()}
    a = got[0]
    assert (a.predicted_landing_x, a.predicted_landing_y, a.landing_frame, a.landing_proxy_kind) == (pytest.approx(0.6 * 2 + 0.4 * 3), pytest.approx(0.6 * 9 + 0.4 * 10), 20, "shuttle_receiver_fusion")
    assert a.landing_confidence == pytest.approx(min(0.65, 0.62)) and got[20].landing_status == "unavailable_terminal_ground_contact"
    far = destination.destinations(destination_frames(spark, f20=[5.9, 1.0]), e, identity())
    b = {r.candidate_frame: r for r in far.collect()}[0]
    assert (b.predicted_landing_x, b.predicted_landing_y, b.landing_proxy_kind) == (3.0, 10.0, "receiver_position_fallback") and b.landing_confidence == pytest.approx(0.62 * 0.7)


def test_terminal_contact(spark):
    f = destination_frames(spark, f25=[2.0, 9.0], f26=[2.0, 9.5], f27=[2.0, 10.0])
    e = marks(spark, [(20, "lower")]).withColumn("rally_id", F.lit("r")).withColumn("play_state_segment_id", F.lit("Active 01"))
    r = destination.destinations(f, e, identity()).first()
    assert (r.predicted_landing_x, r.predicted_landing_y, r.landing_frame, r.landing_kind) == (2.0, 10.0, 27, "ground_contact") and r.landing_confidence == pytest.approx(0.5)


def test_destinations_send_no_frames_through_the_driver(spark, tmp_path):
    destination_frames(spark, f20=[2.0, 9.0]).write.parquet(f"{tmp_path}/frames")
    f = spark.read.parquet(f"{tmp_path}/frames")  # a table whose size is known, and small
    e = marks(spark, [(0, "upper"), (20, "lower")]).withColumn("rally_id", F.lit("r")).withColumn("play_state_segment_id", F.lit("Active 01"))
    plan = destination.destinations(f, e, identity())._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 6


def candidate_rows(spark, rows):
    return spark.createDataFrame([("v", f"e{i}", f, h, "r1") for i, (f, h) in enumerate(rows)], "video string, event_id string, candidate_frame long, predicted_hitter string, rally_id string")


def gold_rows(spark, rows):
    return spark.createDataFrame([("v", f, h, "r1", u) for f, h, u in rows], "video string, hit_frame long, hitter string, rally_id string, uncertainty_frames long")


def test_evaluation(spark):
    c, g = candidate_rows(spark, [(98, "upper"), (101, "lower"), (140, "upper")]), gold_rows(spark, [(100, "lower", 0), (200, "unknown", 0)])
    r = evaluation.evaluate(c, g, (5,)).first()
    assert (r.matched_count, r.false_positive_count, r.false_negative_count, r.ambiguous_gold_count, r.hitter_accuracy) == (1, 2, 1, 1, 1.0)
    assert (r.precision, r.recall, r.f1, r.median_signed_frame_error) == (0.333333, 0.5, 0.4, 1.0)
    wide = evaluation.evaluate(candidate_rows(spark, [(108, "upper")]), gold_rows(spark, [(100, "upper", 3)]), (5,)).first()
    assert wide.matched_count == 1
    late = {x.allowance: x.matched_count for x in evaluation.evaluate(candidate_rows(spark, [(111, "upper")]), gold_rows(spark, [(100, "upper", 0)]), (5,), 6).collect()}
    assert late == {0: 0, 6: 1}


def test_integrity(spark):
    c, g = candidate_rows(spark, [(10, "upper"), (15, "upper"), (20, "lower"), (30, "upper")]), gold_rows(spark, [(10, "upper", 0), (20, "lower", 0), (30, "upper", 0)])
    r = evaluation.integrity(g, c, evaluation.match(c, g, (2,))).first()
    assert (r.gold_pairs, r.both_detected, r.clean_adjacent_pairs, r.gold_triples, r.all_three_detected, r.clean_adjacent_triples, r.matched_upper, r.gold_lower) == (2, 2, 1, 1, 1, 0, 2, 1)


def strokes(spark, rows):
    m = spark.createDataFrame([("v", "upper", "o", "c")], "video_id string, focal_side string, opponent string, competition string")
    names = schemas.ANALYSIS.split(", ")
    raw = spark.createDataFrame([("v", *[r.get(n, "") for n in names]) for r in rows], "video_id string, " + ", ".join(f"{n} string" for n in names))
    return profile.normalise(raw, m)


def rally(name, types, side=None):
    return [{"event_id": f"{name}{i}", "rally_id": name, "stroke_index": str(i + 1), "hit_time": str(float(i)), "player": side or ("upper" if i % 2 == 0 else "lower"), "stroke_type": t} for i, t in enumerate(types)]


def test_sensitivity_counts_the_strokes_once(spark):
    types = ["lob", "smash", "?", "rush", "drop", "drive", "net shot", "lob", "clear", "smash"]
    e = strokes(spark, rally("a", types) + rally("b", types[3:] + types[:4]) + rally("c", types[::-1]))
    checks = profile.sensitivity(e, 20)
    assert "InMemoryRelation" not in checks._jdf.queryExecution().optimizedPlan().toString()  # else each check goes through all strokes again
    got = {(r.test, r.variant, r.metric): r.variant_paired_delta for r in checks.collect()}
    for test, name, rule in (("S2", "unknown_as_seventh", {"with_unknown": True}), ("S4", "court_width_div_4", {"divisor": 4}), ("S5", "raw_stroke_sequence", {"raw_sequence": True}), ("S6", "attack_plus_rush", {"wide_attack": True})):
        want = {r.metric: r.value for r in profile.paired_mean(profile.deltas(profile.long_form(profile.player_metrics(e, **rule), ["video_id"]))).collect()}
        own = {m: v for (t, n, m), v in got.items() if (t, n) == (test, name)}
        assert own and {m: want.get(m) for m in own} == own


def test_entry_needs_a_classified_follower(spark):
    # own strokes of the focal side: lob, ?, smash | lob, ?, ? | clear, smash
    rows = rally("a", ["lob", "x", "smash"], "upper") + rally("b", ["lob", "x", "x"], "upper") + rally("c", ["clear", "smash"], "upper")
    m = profile.player_metrics(strokes(spark, rows)).filter("athlete = 'focal'").first()
    assert (m.attack_entry_proxy_n, m.attack_entry_successes, m.attack_entry_proxy, m.defense_to_attack_proxy) == (2, 2, 1.0, 1.0)
    assert (m.terminal_attack_event_share_n, m.terminal_attack_events, m.unknown_strokes, m.long_rally_share_8) == (2, 2, 3, 0.0)
    assert m.sequence_predictability == pytest.approx(1.0) and m.sequence_predictability_n == 1


def test_event_rate_counts_own_events_over_the_whole_rally(spark):
    m = {r.athlete: r for r in profile.player_metrics(strokes(spark, rally("a", ["lob"] * 9) + rally("b", ["lob"] * 10))).collect()}
    assert m["focal"].event_rate_proxy == pytest.approx((5 / 8 + 5 / 9) / 2) and m["opponent"].event_rate_proxy == pytest.approx((4 / 8 + 5 / 9) / 2)
    assert (m["focal"].long_rally_share_8, m["focal"].long_rally_share_10, m["focal"].long_rally_share_12) == (1.0, 0.5, 0.0)


def test_conflicting_repeats_are_an_error(spark):
    a = rally("a", ["lob"])
    assert strokes(spark, a + a).count() == 1
    with pytest.raises(Exception, match="inconsistent duplicate"):
        strokes(spark, a + [a[0] | {"stroke_type": "drop"}]).count()


def test_statistics_of_tables(spark):
    t = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((10, 0), (0, 10))])
    assert col(spark, profile.cramers_v(t, 2, 2)) == pytest.approx(1.0)
    assert col(spark, profile.cramers_v(F.array(*[F.array(F.lit(0.0), F.lit(0.0))] * 2), 2, 2)) == 0.0
    p, q = [F.lit(0.5), F.lit(0.5)], [F.lit(1.0), F.lit(0.0)]
    want = 0.5 * (0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25)) + 0.5 * math.log2(1 / 0.75)
    assert col(spark, profile.divergence(p, q, "2")) == pytest.approx(want)
    assert col(spark, profile.entropy_of([F.lit(5), F.lit(5), F.lit(0)], 3)) == pytest.approx(math.log(2) / math.log(3))


def test_empty_tables_give_no_error(spark):
    empty = strokes(spark, rally("a", ["lob"])).limit(0)
    wide = profile.player_metrics(empty)
    assert wide.count() == 0 and profile.contingency(empty, "own_depth", ["a", "b"]).first().v == 0.0
    assert profile.leave_one_out(profile.deltas(profile.long_form(wide, ["video_id"]))).count() == 0
    c, g = candidate_rows(spark, [(1, "upper")]).limit(0), gold_rows(spark, [(1, "upper", 0)]).limit(0)
    assert evaluation.evaluate(c, g, (5,)).count() == 0 and evaluation.micro(evaluation.evaluate(c, g, (5,)), []).first().f1 == 0.0
    one = spark.createDataFrame([("v", "m", 1.0)], "video_id string, metric string, delta double").withColumn("metric", F.lit("net_share"))
    r = profile.leave_one_out(one).first()
    assert (r.low, r.stable) == (None, False)


def test_fusion_by_a_plain_statement(spark):
    rnd = np.random.default_rng(7)
    n = 120
    p = rnd.integers(0, 50, n) / 50
    rules = [{"f": int(f), "h": "upper"} for f in sorted(rnd.choice(n, 20, replace=False))]
    swings = sorted(int(f) for f in rnd.choice(n, 20, replace=False))
    props = [{"f": int(f), "c": float(rnd.integers(0, 10) / 10), "h": "lower"} for f in sorted(rnd.choice(n, 40, replace=False))]
    ranks = np.array([((p < v).sum() + ((p == v).sum() - 1) / 2) / (n - 1) for v in p])
    sr = lambda f: ranks[max(0, f - 4) : f + 5].max()
    near = lambda f: [q for q in props if abs(q["f"] - f) <= 4]
    ev = lambda f: max((q["c"] for q in near(f)), default=0.0)
    rows = [(r["f"], "rule", r["h"]) for r in rules if sr(r["f"]) >= 0.6]
    for f in swings:
        if ev(f) >= 0.4:
            best = max(near(f), key=lambda q: (q["c"], -q["f"]), default={"h": "unknown"})
            rows.append((f, "swingnet", best["h"]))
    rows.sort()
    groups = []
    for r in rows:
        if not groups or r[0] - groups[-1][0][0] > 6:
            groups.append([])
        groups[-1].append(r)
    want = {}
    for g in groups:
        best = max(g, key=lambda r: (sr(r[0]) + ev(r[0]), r[1] == "rule", -r[0]))
        want[best[0]] = (best[2], sorted({r[1] for r in g}))
    as_df = lambda rs, s: spark.createDataFrame(rs, s)
    got = fusion.fuse(
        as_df([("v", r["f"], r["h"]) for r in rules], "video string, candidate_frame long, predicted_hitter string"), as_df([("v", f) for f in swings], "video string, candidate_frame long"),
        as_df([("v", i, float(v)) for i, v in enumerate(p)], "video string, frame long, p double"), as_df([("v", q["f"], q["c"], q["h"]) for q in props], "video string, frame long, event_confidence double, predicted_hitter string"), 0.6, 0.4, False)
    assert {r.candidate_frame: (r.predicted_hitter, r.sources) for r in got.collect()} == want


def test_decoders():
    quiet = (0.9, 0.05, 0.05)
    p = [quiet] * 10 + [(0.02, 0.9, 0.08)] * 4 + [quiet] * 26 + [(0.02, 0.08, 0.9)] * 4 + [quiet] * 16
    got = fusion.decode_alternating(p, 30)
    assert [s for _, s in got if s] == [1, 2] and got[0][0] in range(17, 24) and got[1][0] - got[0][0] >= 15
    assert fusion.decode_alternating([quiet] * 30, 30) == []
    assert fusion.decode_votes(p, [500.0] * 60, 0, 1000, 30) == [(19, 1), (49, 2)]
    assert fusion.decode_votes(p, [20.0] * 60, 0, 1000, 30) == []


REV = "video_id string, event_id string, revision long, status string, label_source string, hitter string, stroke string, candidate_frame long, annotator_id string, reviewer_id string, actor_id string, review_note string, review_base_revision long"


def revision(e, n, status, **kw):
    return ("v", e, n, status, kw.get("source", "machine_review"), kw.get("hitter", "A"), kw.get("stroke", "clear"), kw.get("frame", 100), "p1", kw.get("reviewer"), kw.get("actor", "p1"), None, kw.get("base"))


def test_workflow(spark):
    rows = [revision("a", 1, "gold"), revision("a", 2, "double_checked", actor="p1"), revision("b", 1, "gold"), revision("b", 2, "double_checked", actor="p2"), revision("b", 3, "gold"), revision("c", 1, "adjudicated")]
    got = {(r.event_id, r.revision): r.error for r in review.workflow_violations(spark.createDataFrame(rows, REV), ["video_id", "event_id"]).collect()}
    assert set(got) == {("a", 2), ("b", 3), ("c", 1)} and "another annotator" in got["a", 2]


def test_agreement(spark):
    rows = [revision("a", 1, "gold"), revision("a", 2, "double_checked", base=1, frame=103), revision("b", 1, "gold", stroke="drop"), revision("b", 2, "double_checked", base=1, frame=104, hitter="B", stroke="clear"), revision("b", 3, "adjudicated", base=2)]
    df = spark.createDataFrame(rows, REV)
    r = review.agreement(df).first()
    assert (r.sample_size, r.hitter_agreement, r.hit_frame_within_3_agreement, r.stroke_agreement, r.adjudicated_count, r.disagreements_count) == (2, 0.5, 0.5, 0.5, 1, 1)
    assert r.stroke_cohen_kappa == pytest.approx(0.0)
    assert review.disagreements(df).first().changed_fields == ["hitter", "hit_frame", "stroke"]


def test_rally_edits(spark):
    e = spark.createDataFrame([("v", f"e{i}", float(i), "X" if i < 4 else "Y") for i in range(6)], "video_id string, event_id string, time double, rally string")
    names = lambda df: {r.event_id: r.rally for r in df.collect()}
    cut = review.split_before(e, "v", "e2")
    assert names(cut) == {"e0": "Rally 01", "e1": "Rally 01", "e2": "Rally 02", "e3": "Rally 02", "e4": "Rally 03", "e5": "Rally 03"}
    assert names(review.merge_with_previous(cut, "v", "Rally 03"))["e5"] == "Rally 02"
    assert names(review.split_before(e, "v", "e0"))["e0"] == "Rally 01"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_gold_files(spark, tmp_path):
    p = write(tmp_path / "g.csv", "﻿video_id,hit_frame,hitter,notes\nv,10, Upper ,a\nv,20,lower,\n")
    assert sorted((r.hit_frame, r.hitter, r.rally_id, r.uncertainty_frames) for r in sources.read_hit_gold(spark, p).collect()) == [(10, "upper", "unknown", 0), (20, "lower", "unknown", 0)]
    for body, why in (("v,x,upper\n", "invalid frame"), ("v,-1,upper\n", "negative"), ("v,1,me\n", "invalid hitter"), ("v,1,upper\nv,1,lower\n", "repeated"), (",1,upper\n", "empty video_id")):
        with pytest.raises(Exception, match=why):
            sources.read_hit_gold(spark, write(tmp_path / f"{abs(hash(why))}.csv", "video_id,hit_frame,hitter\n" + body)).collect()
    with pytest.raises(ValueError, match="lacks"):
        sources.read_hit_gold(spark, write(tmp_path / "c.csv", "video_id,hitter\nv,upper\n"))


def test_strict_lines_name_the_line(spark, tmp_path):
    p = write(tmp_path / "x.jsonl", '{"a": 1}\n\n{"a": 2}\n[3]\n')
    assert sorted(r.a for r in sources.jsonl(spark, p, "a long").collect() if r.a) == [1, 2]
    with pytest.raises(Exception, match=r"x\.jsonl:4"):
        sources.jsonl(spark, p, "a long", True, True).collect()


def test_resume_prefix(spark, tmp_path):
    lines = "".join(json.dumps({"video_id": "v", "frame_idx": f}) + "\n" for f in (10, 12, 14))
    spans = spark.createDataFrame([(9, 30)], "start_frame long, end_frame long")
    state = lambda body: tuple(sources.prefix_state(sources.numbered_lines(spark, write(tmp_path / f"{abs(hash(body))}.jsonl", body)), spans, "v", 2).first())
    assert state(lines) == (True, 3) and state(lines + '{"video_id"') == (True, 3) and state(lines.replace("12", "13")) == (False, 0)


def test_bundle_and_lock(spark, tmp_path):
    hit = {"videoId": "v", "hitFrame": 5, "uncertaintyFrames": 1, "hitter": "upper", "confidence": "high"}
    good = {"schemaVersion": "shuttlelab-gold-bundle-1", "batchId": "b", "videos": [{"videoId": "v", "frameCount": 10, "hits": [hit]}]}
    read = lambda b: sources.bundle_hits(spark.createDataFrame([(json.dumps(b),)], "value string"))
    assert read(good).first().rally_id == "unknown"
    bad = json.loads(json.dumps(good))
    bad["videos"][0]["hits"][0]["hitFrame"] = 10
    with pytest.raises(Exception, match="invalid or duplicate frame"):
        read(bad).collect()
    path = write(tmp_path / "bundle.json", json.dumps(good))
    lock = str(tmp_path / "lock.json")
    first = sinks.lock(spark, {"bundle.json": path}, lock)
    assert sinks.lock(spark, {"bundle.json": path}, lock) == first
    write(tmp_path / "bundle.json", "{}")
    with pytest.raises(ValueError, match="changed"):
        sinks.lock(spark, {"bundle.json": path}, lock)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_video_metadata(spark, tmp_path):
    tkhd = bytes(76) + struct.pack(">II", 1920 << 16, 1080 << 16)
    header = bytes(12) + struct.pack(">II", 1000, 2000)
    stbl = box(b"stbl", box(b"stsz", bytes(8) + struct.pack(">I", 60)))
    video = box(b"trak", box(b"tkhd", tkhd) + box(b"mdia", box(b"hdlr", bytes(8) + b"vide" + bytes(8)) + box(b"mdhd", header) + box(b"minf", stbl)))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + b"soun" + bytes(8))))
    (tmp_path / "A.MP4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", header) + sound + video))
    (tmp_path / "x.txt").write_text("no")
    found = sources.discover_videos(spark, str(tmp_path))
    r = media.registered(media.probe(found)).first()
    assert (r.duration_sec, r.width, r.height, r.fps, r.frame_count, r.has_audio, r.container) == (2.0, 1920, 1080, 30.0, 60, True, "mp4")
    assert r.video_id == "vid_" + r.checksum[:12] and r.file_size_bytes == os.path.getsize(tmp_path / "A.MP4")


def test_tables_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "a,b"), (2, None, None)], "i int, x double, t string")
    folder = str(tmp_path)
    sinks.parquet(df, f"{folder}/p")
    sinks.jsonl(df, f"{folder}/j")
    sinks.bom_csv(sinks.text_table([df, spark.createDataFrame([(1e-5,)], "y double")]), f"{folder}/t.csv", ["i"])
    assert spark.read.parquet(f"{folder}/p").count() == 2 and spark.read.schema("i int, x double, t string").json(f"{folder}/j").count() == 2
    assert (tmp_path / "t.csv").read_bytes().decode() == '﻿i,x,t,y\n,,,1e-05\n1,0.1,"a,b",\n2,,,\n'
    m = sinks.manifest(spark, {"p": 2}, {"p": f"{folder}/p", "t": f"{folder}/t.csv"})
    assert sinks.changed_artifacts(spark, m["artifacts"]) == []
    (tmp_path / "t.csv").write_text("x")
    assert sinks.changed_artifacts(spark, m["artifacts"]) == ["t"]
    sinks.atomic_json({"a": 1}, f"{folder}/d.json")
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1}


@pytest.mark.parametrize("v", [0.1, 1 / 3, 123456.789, 1e-5, 1e20, 100.0, -2.5, 0.0, 1e15, 123456789012345678.0, 0.0001])
def test_significant_digits(spark, v):
    assert col(spark, sinks.significant(F.lit(v))) == format(v, ".15g")


def test_sqlite_table(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("create table r (video text, revision integer, x real)")
    db.executemany("insert into r values (?, ?, ?)", [("v", i, i / 2) for i in range(10)])
    db.commit()
    got = sqlite.read_table(spark, str(tmp_path / "a.db"), "r", 3)
    assert got.dtypes == [("video", "string"), ("revision", "bigint"), ("x", "double")] and sorted(r.revision for r in got.collect()) == list(range(10))


def test_batches_resume(tmp_path):
    calls = []

    def stage(name, result=None, fail=()):
        def run(video, _):
            calls.append((video["source_path"], name))
            if (video["source_path"], name) in fail:
                fail.remove((video["source_path"], name))
                raise ValueError("no")
            if name == "court" and waiting:
                raise orchestration.Waiting("review the court")
            return result

        return run

    waiting, fail = [], [("b", "infer")]
    stages = {s: stage(s, {"quality_status": "ok"} if s == "validate" else {}, fail) for s in orchestration.STAGES}
    merge = lambda videos, _: [v["source_path"] for v in videos]
    make = lambda videos: orchestration.Batch(str(tmp_path), "x", videos, stages, merge, {"a": 1})
    assert make(["a", "b"]).run()["status"] == "partial_failure"
    calls.clear()
    done = make(["a", "b"]).run()
    assert done["status"] == "completed" and done["merge"]["result"] == ["a", "b"] and calls == [("b", "infer"), ("b", "validate")]
    with pytest.raises(ValueError, match="input video list"):
        make(["a"])
    with orchestration.exclusive(str(tmp_path / "batch.lock")), pytest.raises(RuntimeError, match="already running"):
        make(["a", "b"]).run()


def test_batches_wait_for_review(tmp_path):
    ready = []

    def court(video, _):
        if not ready:
            raise orchestration.Waiting("accept the court")
        return {}

    stages = {s: (court if s == "court" else lambda v, _: {"quality_status": "warning", "warnings": ["w"], "calibration": "c1"}) for s in orchestration.STAGES}
    used = ["c1"]
    make = lambda: orchestration.Batch(str(tmp_path), "x", ["a"], stages, lambda v, _: len(v), calibration=lambda v: used[0])
    assert make().run()["status"] == "waiting_court_review"
    ready.append(1)
    assert make().run()["status"] == "completed_with_warning"
    used[0] = "c2"
    again = make()
    assert again._stale(again.state["videos"][0])


def test_proposals():
    check = {"valid": True, "area_ratio": 0.4, "message": "accepted"}
    p = orchestration.proposal("v", [], check, "auto", (0.40, 0.47))
    assert p["boundary_audit"]["likely_singles_sidelines"] and not p["validation"]["valid"]
    with pytest.raises(ValueError, match="cannot accept"):
        orchestration.accepted(p, 1, [])
    q, record = orchestration.accepted(orchestration.proposal("v", [], check, "manual"), 2, [[1.0]])
    assert q["accepted"] and record["version"] == 2


def test_frozen_selection(tmp_path):
    a = orchestration.frozen({"x": 1}, str(tmp_path / "s.json"))
    assert orchestration.frozen({"x": 1}, str(tmp_path / "s.json")) == a
    with pytest.raises(ValueError, match="different selection"):
        orchestration.frozen({"x": 2}, str(tmp_path / "s.json"))
    assert orchestration.reusable({"input": "a", "segments_manifest": None, "processed_frames": 3}, "a", None, 3)
    assert not orchestration.reusable({"input": "a", "segments_manifest": None, "processed_frames": 3}, "a", None, 2)


def test_strict_union_and_merge(spark):
    a, b = spark.createDataFrame([("v", 1)], "video_id string, frame_idx long"), spark.createDataFrame([("w", 1)], "video_id string, frame_idx long")
    both = batch.strict_union([a, b])
    with pytest.raises(ValueError, match="schema mismatch"):
        batch.strict_union([a, b.withColumn("frame_idx", F.col("frame_idx").cast("int"))])
    assert batch.merge_problems({"frames": both}, both, {"frames": 2}) == []
    assert batch.merge_problems({"frames": both.unionByName(a)}, a, {"frames": 3}) == ["frames contains undeclared video IDs: ['w']", "duplicate (video_id, frame_idx) keys in frames"]
