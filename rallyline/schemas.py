"""Explicit schemas of the records and tables; nothing is inferred."""

from __future__ import annotations

POINT = "array<double>"
PLAYER = f"struct<identity: string, bbox_xyxy: {POINT}, keypoints_xy: array<{POINT}>, keypoint_scores: {POINT}, keypoint_missing: array<boolean>, foot_image_xy: {POINT}, court_xy_m: {POINT}, court_in_bounds: boolean>"
CANDIDATE = f"struct<raw_xy: {POINT}, confidence: double, bbox_xyxy: {POINT}, detector_index: long>"
#: What the shuttle filter adds to a detection.
TRACKED = (
    f"smoothed_xy {POINT}, tracking_state string, associated_xy {POINT}, selected_candidate_rank long, predicted_xy {POINT}, innovation_px double, "
    "innovation_ratio double, adaptive_gate_px double, continuity_score double, hit_support_score double, hand_support_score double, "
    "pose_support_score double, association_score double, measurement_weight double, measurement_status string, "
    "tracking_uncertainty_px double, trajectory_reliability double"
)
SHUTTLE = (
    f"struct<raw_xy: {POINT}, confidence: double, state: string, bbox_xyxy: {POINT}, candidates: array<{CANDIDATE}>, track_version: string, detector_candidate_count: long, "
    + ", ".join(": ".join(f.split(" ")) for f in TRACKED.split(", "))
    + ">"
)
TRACK = f"struct<court_xy_m: {POINT}, state: string, source_frame: long>"
TRACKS = f"struct<upper: {TRACK}, lower: {TRACK}>"
MODEL = "struct<family: string, weights_sha256: string>"
FRAME = (
    f"video_id string, frame_idx long, timestamp_sec double, width long, height long, players array<{PLAYER}>, shuttle {SHUTTLE}, player_tracks {TRACKS}, "
    f"models struct<pose: {MODEL}, shuttle: {MODEL}>, play_state_gate_version string, play_state string, play_state_segment_id string"
)
#: Machine candidates, as the stages of tracking leave them.
EVENT = (
    f"event_id string, video_id string, candidate_frame long, candidate_time double, predicted_hitter string, rally_id string, player_locations {TRACKS}, "
    f"shuttle_image_xy {POINT}, shuttle_tracking_state string, window_start_frame long, window_end_frame long, trajectory_score double, trajectory_score_raw double, "
    "trajectory_tracking_reliability double, hand_distance_score double, pose_score double, event_confidence double, shuttle_measurement_status string, "
    "shuttle_measurement_weight double, shuttle_innovation_ratio double, play_state_version string, play_state_score double, play_state_filter_applied boolean, "
    "play_state_decision string, play_state_window_seconds double, play_state_window_frames long, play_state_window_radius_frames long, play_state_support_seconds double, "
    "play_state_support_radius_frames long, play_state_shuttle_measured_ratio double, play_state_shuttle_tracked_ratio double, play_state_shuttle_moving_ratio double, "
    "play_state_both_player_tracking_ratio double, play_state_nearby_candidate_count long, play_state_sequence_support double, play_state_gate_version string, "
    "play_state_gate_applied boolean, play_state_gate_decision string, play_state_segment_id string, label_source string, review_status string, "
    "semantic_label_source string, semantic_review_status string, model_version string, calibration_version long, human_hitter string, human_stroke_type string, "
    "predicted_stroke_type string, stroke_type string, stroke_type_confidence double, stroke_type_status string, stroke_type_input_quality double, "
    "stroke_type_source string, stroke_type_raw_class string, stroke_type_top3 array<struct<raw_class: string, probability: double>>, aroundhead boolean, backhand boolean, "
    "human_landing_x double, human_landing_y double, predicted_landing_x double, predicted_landing_y double, landing_x double, landing_y double, landing_frame long, "
    "landing_kind string, landing_confidence double, landing_source string, landing_status string, landing_proxy_kind string"
)
VIDEO = (
    "video_id string, path string, proxy_path string, file_name string, checksum string, fps double, frame_count long, width long, height long, duration_sec double, "
    "match_id string, players struct<A: string, B: string>, domain string, redistribution string"
)
CORNER = "struct<x: double, y: double>"
CALIBRATION = f"calibration_id string, video_id string, version long, frame_time_ms long, corners array<{CORNER}>, homography array<{POINT}>, court_orientation string, quality_status string, source string"
HIT_GOLD = "video_id string, hit_frame long, hitter string, rally_id string, confidence string, uncertainty_frames long, notes string"
SEMANTIC_GOLD = (
    "video_id string, rally_id string, hit_frame long, hitter string, stroke_type string, landing_x double, landing_y double, landing_frame long, "
    "landing_kind string, confidence string, uncertainty_frames long, notes string"
)
#: One row of a rally's stroke, as the match analysis reads it: everything is text.
ANALYSIS = "event_id, rally_id, stroke_index, hit_time, player, stroke_type, player_location_x, player_location_y, opponent_location_x, opponent_location_y, landing_x, landing_y"
SPOT = "struct<image_x: double, image_y: double, court_x: double, court_y: double, source: string>"
REVISION = (
    "video_id string, event_id string, revision long, candidate_frame long, candidate_time_ms long, rally_id string, hitter string, stroke string, backhand boolean, "
    "aroundhead boolean, certainty string, notes string, hit_position_json string, landing_position_json string, status string, label_source string, "
    "machine_prediction_json string, annotator_id string, reviewer_id string, review_note string, review_base_revision long, reviewed_at string, created_at string"
)


def names(schema: str) -> list[str]:
    """Top-level column names of a schema text."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out
