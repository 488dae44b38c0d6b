"""Queries of evaluation, annotation, fusion, integrity, readers and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline import functions as fn
from rallyline import sinks, sources, streaming
from rallyline.operators import batch, evaluation, fusion, joins, resample, review, sequence
from rallyline.plans.frames import EVS, FR, V, events, frames
from rallyline.plans.registry import EV, SESS, ev, query, sess, table

TOL = (60, 120, 240)


def num(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def candidates(spark, d) -> DataFrame:
    s = sess(spark, d).filter("cls = 'click'")
    return s.select(F.col("video").cast("string").alias("video"), F.col("id").cast("string").alias("event_id"), F.col("frame").alias("candidate_frame"), F.when(F.col("id") % 7 != 0, F.col("side")).alias("predicted_hitter"), F.col("session").cast("string").alias("rally_id"), "score", "id")


def gold(spark, d) -> DataFrame:
    """Purchases as labels, one per minute."""
    s = sess(spark, d).filter("cls = 'purchase'")
    g = s.groupBy("video", "frame").agg(F.min(F.struct("id", "side", "session")).alias("g"))
    hitter = F.when(F.col("g.id") % 5 == 0, "unknown").otherwise(F.col("g.side"))
    return g.select(F.col("video").cast("string").alias("video"), F.col("frame").alias("hit_frame"), hitter.alias("hitter"), F.col("g.session").cast("string").alias("rally_id"), (F.col("g.id") % 3 * 10).alias("uncertainty_frames"), F.col("g.id").alias("id"))


GC = f"""{SESS}, cand AS (SELECT CAST(video AS VARCHAR) AS video, CAST(id AS VARCHAR) AS event_id, frame, score FROM s WHERE cls = 'click'),
 gl AS (SELECT CAST(video AS VARCHAR) AS video, frame, arg_min(id, id) AS id, arg_min(side, id) AS side, arg_min(session, id) AS session FROM s WHERE cls = 'purchase' GROUP BY ALL)"""


@query("join09_optimal_match")
def join09(spark, d):
    """Sequential; its counts, errors and ties are tested against all matchings and a plain table."""
    return evaluation.match(candidates(spark, d), gold(spark, d), (120,))


@query("join10_compatible_ids", f"WITH {EV}, a AS (SELECT DISTINCT 'vid_' || substr(md5(CAST(video AS VARCHAR)), 1, 12) AS x, md5(CAST(video AS VARCHAR)) AS y FROM ev) SELECT x, y FROM a")
def join10(spark, d):
    v = ev(spark, d).select(F.md5(F.col("video").cast("string")).alias("y")).distinct()
    return evaluation.compatible_ids(v.select(F.concat(F.lit("vid_"), F.substring("y", 1, 12)).alias("x")), v, "x", "y")


@query("join11_false_negatives")
def join11(spark, d):
    return evaluation.review_tables(candidates(spark, d), gold(spark, d), join09(spark, d))["false_negatives"].select("video", "hit_frame")


@query("join12_ambiguous_gold", f"WITH {GC}, n AS (SELECT gl.video, gl.frame, count(cand.event_id) AS n FROM gl LEFT JOIN cand ON cand.video = gl.video AND abs(cand.frame - gl.frame) <= 120 + gl.id % 3 * 10 GROUP BY ALL) SELECT video, CAST(120 AS BIGINT) AS tolerance, count(*) FILTER (WHERE n > 1) AS ambiguous_gold_count FROM n GROUP BY video")
def join12(spark, d):
    return evaluation.ambiguous(candidates(spark, d), gold(spark, d), (120,)).select("video", "tolerance", "ambiguous_gold_count")


@query("agg06_frame_errors")
def agg06(spark, d):
    return evaluation.errors(join09(spark, d), ["video"])


@query("agg08_conditional_accuracy")
def agg08(spark, d):
    return evaluation.evaluate(candidates(spark, d), gold(spark, d), (120,)).select("video", "hitter_accuracy", "hitter_scored_count", "rally_id_accuracy", "rally_scored_count")


@query("agg09_tolerance_sweep")
def agg09(spark, d):
    """All tolerances with and without the reaction allowance; counts are tested by brute force."""
    return evaluation.evaluate(candidates(spark, d), gold(spark, d), TOL, 30)


@query("agg12_micro", f"WITH {GC} SELECT (SELECT count(*) FROM cand) AS predicted, (SELECT count(*) FROM gl) AS gold")
def agg12(spark, d):
    return evaluation.micro(evaluation.evaluate(candidates(spark, d), gold(spark, d), (120,)), ["tolerance"]).select("predicted", "gold")


@query("agg48_side_recall")
def agg48(spark, d):
    return evaluation.integrity(gold(spark, d), candidates(spark, d), join09(spark, d)).select("video", "gold_upper", "matched_upper", "gold_lower", "matched_lower", *num("upper_detection_recall", "lower_detection_recall"))


@query("agg47_integrity", f"WITH {GC}, w AS (SELECT video, lead(frame) OVER o AS b, lead(frame, 2) OVER o AS c FROM gl WINDOW o AS (PARTITION BY video, session ORDER BY frame)) SELECT video, count(b) AS gold_pairs, count(c) AS gold_triples FROM w GROUP BY video")
def agg47(spark, d):
    return evaluation.integrity(gold(spark, d), candidates(spark, d), join09(spark, d)).select("video", "gold_pairs", "gold_triples")


@query("agg64_typed_scores")
def agg64(spark, d):
    return evaluation.typed_scores(evaluation.micro(evaluation.evaluate(candidates(spark, d), gold(spark, d), (120,)), ["tolerance"])).select("tolerance", "typed_micro_precision", "typed_micro_recall")


PAIRS = f"{EV}, pr AS (SELECT ['clear', 'drop', 'smash'][CAST(id % 3 AS INT) + 1] AS t, ['clear', 'drop', 'unknown', 'smash'][CAST(id % 4 AS INT) + 1] AS g, id % 61 / 10 AS gx, id % 134 / 10 AS gy, CASE WHEN id % 5 <> 0 THEN id % 61 / 10 + id % 7 / 5 END AS x, id % 134 / 10 + id % 3 / 10 AS y FROM ev)"


def pairs(spark, d) -> DataFrame:
    i = F.col("id")
    t, g = F.array(*[F.lit(v) for v in ("clear", "drop", "smash")]), F.array(*[F.lit(v) for v in ("clear", "drop", "unknown", "smash")])
    return ev(spark, d).select(F.get(t, (i % 3).cast("int")).alias("gold_type"), F.get(g, (i % 4).cast("int")).alias("predicted_type"), (i % 61 / 10).alias("gold_x"), (i % 134 / 10).alias("gold_y"), F.when(i % 5 != 0, i % 61 / 10 + i % 7 / 5).alias("x"), (i % 134 / 10 + i % 3 / 10).alias("y"))


CLS = f"{PAIRS}, c AS (SELECT l, (SELECT count(*) FROM pr WHERE t = l) AS support, (SELECT count(*) FROM pr WHERE g = l) AS predicted, (SELECT count(*) FROM pr WHERE t = l AND g = l) AS tp FROM (SELECT unnest(['clear', 'drop', 'smash']) AS l)), f AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c), ff AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM f)"


@query("agg10_class_scores", f"WITH {CLS} SELECT l AS label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM ff WHERE support > 0")
def agg10(spark, d):
    return evaluation.class_scores(pairs(spark, d), "gold_type", "predicted_type").select("label", "support", *num("precision", "recall", "f1"))


@query("agg10_macro_f1", f"WITH {CLS} SELECT round(avg(f1), 6) AS macro_f1 FROM ff WHERE support > 0")
def agg10m(spark, d):
    return evaluation.macro_f1(pairs(spark, d), "gold_type", "predicted_type").select(*num("macro_f1"))


@query("agg11_landing_errors", f"WITH {PAIRS}, e AS (SELECT *, sqrt((x - gx) ** 2 + (y - gy) ** 2) AS e FROM pr), l AS (SELECT list(e ORDER BY e) FILTER (WHERE e IS NOT NULL) AS v FROM e) SELECT round(count(e) / count(*), 6) AS landing_coverage, round(avg(e), 6) AS mean_error_m, round(count(*) FILTER (WHERE e <= 1) / count(e), 6) AS within_1_0m, round(count(*) FILTER (WHERE e <= 0.5 AND t = g) / count(*), 6) AS joint_0_5m, (SELECT round(v[CAST(round_even((len(v) - 1) * 0.9::DOUBLE, 0) AS INT) + 1], 6) FROM l) AS p90_error_m FROM e")
def agg11(spark, d):
    return evaluation.semantics(pairs(spark, d)).select("landing_coverage", *num("mean_error_m"), "within_1_0m", "joint_0_5m", *num("p90_error_m"))


@query("agg13_window_macro_f1", f"WITH {EV}, p AS (SELECT id % 3 AS t, id % 2 AS g FROM ev), c AS (SELECT k, (SELECT count(*) FROM p WHERE t = k AND g = k) AS tp, (SELECT count(*) FROM p WHERE t = k) + (SELECT count(*) FROM p WHERE g = k) AS d FROM range(3) r(k)) SELECT round(sum(coalesce(2 * tp / nullif(d, 0), 0)) / 3, 6) AS macro_f1 FROM c")
def agg13(spark, d):
    p = ev(spark, d).select((F.col("id") % 3).alias("t"), (F.col("id") % 2).alias("g"))
    return evaluation.window_macro_f1(p, "t", "g").select(*num("macro_f1"))


@query("agg60_class_weights", f"WITH {EV}, c AS (SELECT k, (SELECT count(*) FROM ev WHERE id % 2 = k) AS n FROM range(3) r(k)) SELECT CAST(k AS INT) AS label, n, round((SELECT count(*) FROM ev) / (3 * greatest(n, 1)), 6) AS weight FROM c")
def agg60(spark, d):
    return evaluation.class_weights(ev(spark, d).select((F.col("id") % 2).alias("k")), "k").select("label", "n", *num("weight"))


REV = """rev AS (SELECT 'v' || user_id % 5 AS video_id, 'e' || user_id AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, event_id AS id, 100 + event_id % 9 AS frame, CASE event_type WHEN 'click' THEN 'gold' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'uncertain' WHEN 'signup' THEN 'double_checked' ELSE 'adjudicated' END AS status,
 CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'machine_review' END AS source, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS hitter, ['clear', 'drop', 'smash'][CAST(event_id % 3 AS INT) + 1] AS stroke, 'p' || event_id % 4 AS actor FROM events),
 lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY revision DESC) AS k FROM rev) WHERE k = 1)"""


def revisions(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    i = F.col("event_id")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("event_type") == "click", "gold").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "uncertain").when(F.col("event_type") == "signup", "double_checked").otherwise("adjudicated")
    strokes = F.array(*[F.lit(s) for s in ("clear", "drop", "smash")])
    return e.select(
        F.concat(F.lit("v"), F.col("user_id") % 5).alias("video_id"), F.concat(F.lit("e"), "user_id").alias("event_id"), k.cast("long").alias("revision"), i.alias("id"), (100 + i % 9).alias("candidate_frame"), status.alias("status"),
        F.when(i % 3 == 0, "manual").otherwise("machine_review").alias("label_source"), F.when(i % 2 == 0, "A").otherwise("B").alias("hitter"), F.get(strokes, (i % 3).cast("int")).alias("stroke"), F.concat(F.lit("p"), i % 4).alias("actor_id"),
        F.concat(F.lit("p"), i % 4).alias("annotator_id"), F.concat(F.lit("p"), i % 4).alias("reviewer_id"), F.lit("").alias("review_note"), F.when(status.isin("double_checked", "adjudicated") & (k > 1), (k - 1).cast("long")).alias("review_base_revision"),
        F.col("ts").cast("string").alias("created_at"),
    )


@query("win40_latest_revision", f"WITH {REV} SELECT video_id, event_id, revision, status, stroke FROM lat")
def win40(spark, d):
    return review.latest(revisions(spark, d), ["video_id", "event_id"]).select("video_id", "event_id", "revision", "status", "stroke")


@query("snk12_next_revision", f"WITH {REV} SELECT video_id, event_id, max(revision) + 1 AS revision FROM rev GROUP BY ALL")
def snk12(spark, d):
    r = revisions(spark, d)
    new = r.select("video_id", "event_id").distinct().withColumn("created_at", F.lit("2030"))
    return review.next_revision(r, new, ["video_id", "event_id"]).select("video_id", "event_id", "revision")


@query("flt12_workflow", f"WITH {REV}, l AS (SELECT *, lag(status) OVER w AS b, lag(actor) OVER w AS ba FROM rev WINDOW w AS (PARTITION BY video_id, event_id ORDER BY revision)) SELECT video_id, event_id, revision FROM l WHERE (b = 'adjudicated' AND status <> 'adjudicated') OR (b = 'double_checked' AND status NOT IN ('double_checked', 'adjudicated')) OR (b IS DISTINCT FROM status AND status = 'double_checked' AND (coalesce(b, '') NOT IN ('gold', 'uncertain') OR ba = actor)) OR (b IS DISTINCT FROM status AND status = 'adjudicated' AND (coalesce(b, '') NOT IN ('double_checked', 'uncertain') OR ba = actor))")
def flt12(spark, d):
    return review.workflow_violations(revisions(spark, d), ["video_id", "event_id"]).select("video_id", "event_id", "revision")


@query("flt13_payload", f"WITH {REV} SELECT video_id, event_id, revision, CASE WHEN id % 11 = 0 THEN 'hitter must be A or B' WHEN id % 13 = 0 THEN 'stroke is required' END AS error FROM rev")
def flt13(spark, d):
    r = revisions(spark, d).withColumns({"candidate_time": F.lit(1.0), "hitter": F.when(F.col("id") % 11 == 0, "C").otherwise(F.col("hitter")), "stroke": F.when(F.col("id") % 13 == 0, " ").otherwise(F.col("stroke")), "hit_position": F.lit(None).cast(review.SPOT), "landing_position": F.lit(None).cast(review.SPOT)})
    return review.payload_error(r).select("video_id", "event_id", "revision", "error")


@query("flt22_complete_gold", f"WITH {REV} SELECT video_id, event_id, revision, status = 'gold' AND (id % 4 <> 0 OR id % 3 <> 0) AS complete FROM rev")
def flt22(spark, d):
    r = revisions(spark, d).withColumns({"stroke_type": F.col("stroke"), "landing_status": F.when(F.col("id") % 4 == 0, "observed").otherwise("out"), "landing_area": F.when(F.col("id") % 3 != 0, 5)})
    return r.select("video_id", "event_id", "revision", review.complete_gold().alias("complete"))


@query("agg44_pilot_metrics", f"WITH {REV}, a AS (SELECT video_id, count(*) FILTER (WHERE status IN ('gold', 'double_checked', 'adjudicated')) AS gold, count(*) FILTER (WHERE status IN ('gold', 'double_checked', 'adjudicated') AND source = 'machine_review') AS mg, count(*) FILTER (WHERE status = 'rejected' AND source = 'machine_review') AS mr, count(*) FILTER (WHERE status IN ('gold', 'double_checked', 'adjudicated') AND source = 'manual') AS ma, count(*) FILTER (WHERE status = 'uncertain') AS un FROM lat GROUP BY video_id) SELECT a.video_id, gold, mg AS machine_gold, ma AS manual_gold, mr AS machine_rejected, un AS uncertain, (SELECT count(*) FROM rev WHERE rev.video_id = a.video_id) AS total_revisions, least(1, gold / 50) AS progress, round(mg / nullif(mg + mr, 0), 6) AS candidate_precision, round(mg / nullif(mg + ma, 0), 6) AS estimated_recall FROM a")
def agg44(spark, d):
    return review.pilot_metrics(revisions(spark, d)).select("video_id", "gold", "machine_gold", "manual_gold", "machine_rejected", "uncertain", "total_revisions", "progress", *num("candidate_precision", "estimated_recall"))


CMP = f"{REV}, q AS (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY CASE WHEN status = 'double_checked' THEN 0 ELSE 1 END, revision DESC) AS j FROM rev WHERE status IN ('double_checked', 'adjudicated') AND revision > 1), cp AS (SELECT q.video_id, q.event_id, q.revision, b.revision AS base, b.hitter AS bh, q.hitter AS rh, b.frame AS bf, q.frame AS rf, b.stroke AS bs, q.stroke AS rs FROM q JOIN rev b ON b.video_id = q.video_id AND b.event_id = q.event_id AND b.revision = q.revision - 1 WHERE j = 1)"


@query("win41_last_review", f"WITH {CMP} SELECT video_id, event_id, revision, base AS base_revision FROM cp")
def win41(spark, d):
    return review.comparisons(revisions(spark, d)).select("video_id", "event_id", F.col("review.revision").alias("revision"), "base_revision")


@query("join17_base_revision", f"WITH {CMP} SELECT video_id, event_id, bh AS base_hitter, rh AS review_hitter FROM cp")
def join17(spark, d):
    return review.comparisons(revisions(spark, d)).select("video_id", "event_id", F.col("base.hitter").alias("base_hitter"), F.col("review.hitter").alias("review_hitter"))


@query("agg45_agreement", f"WITH {CMP}, n AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE bh = rh) AS h, count(*) FILTER (WHERE abs(bf - rf) <= 3) AS f, count(*) FILTER (WHERE bs = rs) AS s FROM cp GROUP BY video_id), l AS (SELECT video_id, bs AS l, count(*) AS n FROM cp GROUP BY ALL), r AS (SELECT video_id, rs AS l, count(*) AS n FROM cp GROUP BY ALL), e AS (SELECT video_id, sum(l.n * r.n) AS c FROM l JOIN r USING (video_id, l) GROUP BY video_id) SELECT n.video_id, n AS sample_size, round(h / n, 6) AS hitter_agreement, round(f / n, 6) AS hit_frame_within_3_agreement, round(s / n, 6) AS stroke_agreement, CASE WHEN abs(1 - coalesce(c, 0) / (n * n)) >= 1e-12 THEN round((s / n - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)), 6) END AS stroke_cohen_kappa FROM n LEFT JOIN e USING (video_id)")
def agg45(spark, d):
    return review.agreement(revisions(spark, d)).filter("sample_size > 0").select("video_id", "sample_size", *num("hitter_agreement", "hit_frame_within_3_agreement", "stroke_agreement", "stroke_cohen_kappa"))


@query("agg45_disagreements", f"WITH {CMP} SELECT video_id, event_id, concat_ws(',', CASE WHEN bh <> rh THEN 'hitter' END, CASE WHEN abs(bf - rf) > 3 THEN 'hit_frame' END, CASE WHEN bs <> rs THEN 'stroke' END) AS changed FROM cp WHERE bh <> rh OR abs(bf - rf) > 3 OR bs <> rs")
def agg45d(spark, d):
    return review.disagreements(revisions(spark, d)).select("video_id", "event_id", F.concat_ws(",", "changed_fields").alias("changed"))


@query("prj18_serialise", f"WITH {REV} SELECT video_id, event_id, revision, id / 1000 AS candidate_time, CASE WHEN id % 2 = 0 THEN 1.5 END AS court_x FROM rev")
def prj18(spark, d):
    point = '{"image_x": null, "image_y": null, "court_x": 1.5, "court_y": 2.0, "source": "court"}'
    r = revisions(spark, d).withColumns({"candidate_time_ms": F.col("id"), "hit_position_json": F.when(F.col("id") % 2 == 0, point), "landing_position_json": F.lit(None).cast("string"), "machine_prediction_json": F.lit('{"confidence": 0.5}')})
    return review.serialised(r).select("video_id", "event_id", "revision", "candidate_time", F.col("hit_position.court_x").alias("court_x"))


def review_rows(spark, d) -> DataFrame:
    """Events as a reviewer sees them: status, rally and time."""
    r = review.latest(revisions(spark, d), ["video_id", "event_id"])
    return r.select("video_id", "event_id", F.when(F.col("id") % 3 == 0, "unreviewed").otherwise(F.col("status")).alias("status"), F.concat(F.lit("R"), F.col("id") % 4).alias("rally"), (F.col("id") + 0.0).alias("time"), "hitter", "stroke")


QU = f"{REV}, qu AS (SELECT video_id, event_id, CASE WHEN id % 3 = 0 THEN 'unreviewed' ELSE status END AS status, 'R' || id % 4 AS rally, CAST(id AS DOUBLE) AS t FROM lat)"


@query("flt15_work_queue", f"WITH {QU}, n AS (SELECT *, (SELECT arg_min(b.event_id, (b.t, b.event_id)) FROM qu b WHERE b.video_id = a.video_id AND b.status = 'unreviewed' AND (b.t, b.event_id) > (a.t, a.event_id)) AS u, lead(event_id) OVER (PARTITION BY video_id ORDER BY t, event_id) AS nx, first_value(event_id) OVER (PARTITION BY video_id ORDER BY t, event_id) AS f FROM qu a) SELECT video_id, event_id, coalesce(u, nx, f) AS next_event_id FROM n")
def flt15(spark, d):
    return review.next_item(review_rows(spark, d))


@query("win42_renumber", f"WITH {QU}, s AS (SELECT video_id, rally, min((t, event_id)) AS st FROM qu GROUP BY ALL), k AS (SELECT video_id, rally, printf('Rally %02d', row_number() OVER (PARTITION BY video_id ORDER BY st)) AS name FROM s) SELECT qu.video_id, event_id, k.name AS rally FROM qu JOIN k ON k.video_id = qu.video_id AND k.rally = qu.rally")
def win42(spark, d):
    return review.renumber(review_rows(spark, d)).select("video_id", "event_id", "rally")


@query("join15_player_at_frame", f"WITH {FR}, a AS (SELECT video, frame, id FROM fr WHERE id % 10 = 0) SELECT {V}, f.id, CASE WHEN f.id % 2 = 0 THEN CASE WHEN x.id IS NULL THEN 'A' ELSE 'P' || x.id END ELSE CASE WHEN x.id IS NULL THEN 'B' ELSE 'Q' || x.id END END AS player FROM fr f LEFT JOIN LATERAL (SELECT a.id FROM a WHERE a.video = f.video AND a.frame <= f.frame ORDER BY a.frame DESC LIMIT 1) x ON true".replace("SELECT CAST(video", "SELECT CAST(f.video"))
def join15(spark, d):
    f = frames(spark, d).select("video_id", "id", F.col("frame_idx").alias("candidate_frame"), F.when(F.col("id") % 2 == 0, "upper").otherwise("lower").alias("hitter_side"))
    a = f.filter("id % 10 = 0").select("video_id", F.col("candidate_frame").alias("effective_frame"), F.concat(F.lit("P"), "id").alias("upper_player"), F.concat(F.lit("Q"), "id").alias("lower_player"), F.col("id").alias("version"))
    return review.player_at(f, a).select("video_id", "id", "player")


@query("join16_merged_events", f"WITH {REV}, m AS (SELECT video_id, event_id, 'clear' AS stroke FROM lat WHERE id % 2 = 0), r AS (SELECT video_id, event_id, stroke FROM lat WHERE id % 3 <> 0) SELECT coalesce(m.video_id, r.video_id) AS video_id, coalesce(m.event_id, r.event_id) AS event_id, coalesce(r.stroke, m.stroke) AS stroke, m.event_id IS NULL AS review_only FROM m FULL JOIN r ON m.video_id = r.video_id AND m.event_id = r.event_id")
def join16(spark, d):
    lat = review.latest(revisions(spark, d), ["video_id", "event_id"])
    m = lat.filter("id % 2 = 0").select("video_id", "event_id", F.lit("Rally 01").alias("rally"), F.lit(1.0).alias("time"), "hitter", F.lit("clear").alias("stroke"), F.lit(0.5).alias("confidence"), "status")
    r = lat.filter("id % 3 <> 0").select("video_id", "event_id", "revision", F.lit("Model pilot").alias("rally_id"), F.lit(2.0).alias("candidate_time"), "hitter", "stroke", "status", F.lit("{}").alias("machine_prediction_json"))
    return review.merged_events(m, r).select("video_id", "event_id", "stroke", "review_only")


@query("snk15_annotation_csv", f"WITH {QU} SELECT event_id, rally AS rally_id, printf('%.3f', t) AS hit_time, status AS annotation_status FROM qu")
def snk15(spark, d):
    none = F.lit(None).cast(review.SPOT)
    e = review_rows(spark, d).withColumns({"confidence": F.lit(0.5), "hit_position": none, "landing_position": none, "label_source": F.lit("manual")})
    return review.annotation_csv(e).select("event_id", "rally_id", "hit_time", "annotation_status")


PROB = f"{FR}, pb AS (SELECT video, frame, id, id * 7919 % 1009 / 1009 AS p FROM fr)"


def probabilities(spark, d) -> DataFrame:
    return frames(spark, d).select(F.col("video_id").alias("video"), F.col("frame_idx").alias("frame"), (F.col("id") * 7919 % 1009 / 1009).alias("p"), "id")


RANKS = f"{PROB}, rk AS (SELECT video, frame, (rank() OVER (PARTITION BY video ORDER BY p) - 1 + (count(*) OVER (PARTITION BY video, p) - 1) / 2) / greatest(count(*) OVER (PARTITION BY video) - 1, 1) AS r FROM pb), sr AS (SELECT video, frame, max(r) OVER (PARTITION BY video ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS swing FROM rk)"


@query("win32_average_ranks", f"WITH {RANKS} SELECT {V.replace('video_id', 'video')}, frame, round(r, 6) AS rank FROM rk")
def win32(spark, d):
    return fusion.percentile_ranks(probabilities(spark, d), ["video"], "p").select("video", "frame", *num("rank"))


@query("win33_agg05_author_peaks", f"WITH {FR}, pb AS (SELECT video, frame, abs((frame % 23) - 11) / 11 + id % 7 / 1000 AS p FROM fr), q AS (SELECT video, list(p ORDER BY p)[CAST(ceil((count(*) - 1) * 0.8::DOUBLE) AS INT) + 1] AS q FROM pb GROUP BY video), o AS (SELECT pb.*, max(frame) OVER (PARTITION BY pb.video) AS last FROM pb JOIN q USING (video) WHERE p > q), i AS (SELECT *, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS g FROM o WHERE frame < last) SELECT {V.replace('video_id', 'video')}, arg_min(frame, (-p, frame)) AS frame FROM i GROUP BY video, g HAVING count(*) >= 3")
def win33(spark, d):
    f = frames(spark, d).select(F.col("video_id").alias("video"), F.col("frame_idx").alias("frame"), (F.abs(F.col("frame_idx") % 23 - 11) / 11 + F.col("id") % 7 / 1000).alias("p"))
    return fusion.author_peaks(f, ["video"], "frame", "p")


def swing_inputs(spark, d):
    e = events(spark, d)
    p = probabilities(spark, d)
    rules = e.filter("id % 2 = 0").select(F.col("video_id").alias("video"), "candidate_frame", F.coalesce("predicted_hitter", F.lit("unknown")).alias("predicted_hitter"))
    swings = p.filter("id % 4 = 1").select("video", F.col("frame").alias("candidate_frame"))
    proposals = e.select(F.col("video_id").alias("video"), F.col("candidate_frame").alias("frame"), "event_confidence", F.coalesce("predicted_hitter", F.lit("unknown")).alias("predicted_hitter"))
    return rules, swings, p, proposals


@query("join23_neighbourhood", f"WITH {EVS}, t AS (SELECT video, frame FROM fr WHERE id % 4 = 1) SELECT {V.replace('video_id', 'video').replace('video AS', 't.video AS')}, t.frame, round(max(conf), 6) AS evidence FROM t LEFT JOIN ev_ e ON e.video = t.video AND abs(e.frame - t.frame) <= 4 GROUP BY ALL")
def join23(spark, d):
    _, swings, _, proposals = swing_inputs(spark, d)
    t = swings.withColumnRenamed("candidate_frame", "frame")
    o = proposals.withColumnRenamed("frame", "_f")
    return fusion.around(t, o, "video", "frame", "_f", 4, F.col("event_confidence"), "evidence").select("video", "frame", *num("evidence"))


@query("win34_anchored_groups", f"WITH RECURSIVE {FR}, o AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM fr WHERE id % 3 = 0), r AS (SELECT video, k, frame, frame AS first, 1 AS grp FROM o WHERE k = 1 UNION ALL SELECT o.video, o.k, o.frame, CASE WHEN o.frame - r.first > 6 THEN o.frame ELSE r.first END, CASE WHEN o.frame - r.first > 6 THEN r.grp + 1 ELSE r.grp END FROM r JOIN o ON o.video = r.video AND o.k = r.k + 1) SELECT {V.replace('video_id', 'video')}, frame, CAST(grp AS BIGINT) AS grp FROM r")
def win34(spark, d):
    f = frames(spark, d).filter("id % 3 = 0").select(F.col("video_id").alias("video"), F.col("frame_idx").alias("frame"))
    return sequence.anchored(f, ["video"], "frame", "frame", 6)


@query("win35_fusion")
def win35(spark, d):
    """Fused events of one configuration; tested against a plain statement of the rule."""
    return fusion.fuse(*swing_inputs(spark, d), 0.4, 0.2, True)


@query("srt06_join24_grid_search")
def srt06(spark, d):
    """The configurations of a small grid by F1, then the best two by another split."""
    rules, swings, p, proposals = swing_inputs(spark, d)
    g = events(spark, d).filter("id % 6 = 0").select(F.col("video_id").alias("video"), F.col("candidate_frame").alias("hit_frame"), F.lit(1).cast("long").alias("uncertainty_frames"))
    half = lambda v: F.pmod(F.xxhash64(v), F.lit(2)).cast("int")
    every = []
    for keep, refine in ((0.0, False), (0.6, False), (0.6, True)):
        f = fusion.fuse(rules, swings, p, proposals, keep, 0.2, refine)
        every.append(f.select(F.concat_ws("|", "video", F.lit(keep), F.lit(refine)).alias("video"), F.concat_ws(":", "video", "candidate_frame").alias("event_id"), "candidate_frame", F.lit(keep).alias("keep_rank"), F.lit(refine).alias("refine"), half("video").alias("split")))
    c = every[0].unionByName(every[1]).unionByName(every[2])
    key = ["keep_rank", "refine", "split"]
    runs = fusion.grid(spark, keep_rank=[0.0, 0.6], refine=[False, True]).filter("keep_rank > 0 or not refine")
    gold_of = g.crossJoin(F.broadcast(runs)).withColumn("split", half("video")).withColumn("video", F.concat_ws("|", "video", F.col("keep_rank").cast("string"), F.col("refine").cast("string")))
    m = evaluation.match(c, gold_of, (5,)).join(c.select("video", "event_id", *key), ["video", "event_id"]).groupBy(*key).agg(F.count(F.lit(1)).alias("tp"))
    n = c.groupBy(*key).agg(F.count(F.lit(1)).alias("predicted")).join(gold_of.groupBy(*key).agg(F.count(F.lit(1)).alias("gold")), key)
    s = evaluation.prf(n.join(m, key, "left").na.fill(0, ["tp"]), "tp", "predicted", "gold")
    return fusion.best_then(s.filter("split = 0"), s.filter("split = 1"), ["keep_rank", "refine"], 2)


def decoder_rows(spark, d) -> DataFrame:
    i = F.col("id")
    return probabilities(spark, d).select("video", (F.row_number().over(Window.partitionBy("video").orderBy("frame"))).cast("long").alias("frame"), F.when(i % 9 < 2, 0.05).otherwise(0.9).alias("p0"), F.when(i % 2 == 0, 0.6).otherwise(0.1).alias("p1"), F.when(i % 2 == 1, 0.6).otherwise(0.1).alias("p2"), (i * 37 % 1280).cast("double").alias("x"))


@query("win36_decode_alternating")
def win36(spark, d):
    return fusion.decode(decoder_rows(spark, d), 30)


@query("win37_decode_votes")
def win37(spark, d):
    return fusion.decode(decoder_rows(spark, d), 30, "votes", (80.0, 1200.0))


@query("win38_slope_extrema", f"WITH {FR}, z AS (SELECT video, frame, x, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY video) AS n, lag(x) OVER o AS a, lead(x) OVER o AS b, list(x) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM fr WINDOW o AS (PARTITION BY video ORDER BY frame)), c AS (SELECT video, frame, abs(list_median(list_transform(range(1, 8), lambda k: v[k + 1] - v[k]))) AS l, abs(list_median(list_transform(range(8, 15), lambda k: v[k + 1] - v[k]))) AS r FROM z WHERE i >= 8 AND i < n - 8 AND (x - a) * (x - b) >= 0) SELECT {V.replace('video_id', 'video')}, frame FROM c WHERE greatest(l, r) > 10")
def win38(spark, d):
    f = frames(spark, d).select(F.col("video_id").alias("video"), F.col("frame_idx").alias("frame"), (F.col("id") * 37 % 1280).cast("double").alias("x"))
    return fusion.slope_extrema(f, ["video"], "frame", "x")


@query("set03_upsert", f"WITH {EV} SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE cls END AS cls FROM ev")
def set03(spark, d):
    e = ev(spark, d).select("id", "cls")
    return batch.upsert(e, e.filter("id % 2 = 0").withColumn("cls", F.lit("new")), ["id"])


@query("set01_strict_union", f"WITH {EV} SELECT id, cls FROM ev")
def set01(spark, d):
    e = ev(spark, d).select("id", "cls")
    return batch.strict_union([e.filter(F.col("id") % 3 == k) for k in range(3)])


@query("set07_overlap_by_video", f"WITH {EV}, a AS (SELECT DISTINCT video, frame FROM ev WHERE cls = 'click'), b AS (SELECT DISTINCT video, frame FROM ev WHERE cls = 'view') SELECT video, count(*) FILTER (WHERE a.frame IS NOT NULL AND b.frame IS NOT NULL) AS both_n, count(*) FILTER (WHERE b.frame IS NULL) AS only_a, count(*) FILTER (WHERE a.frame IS NULL) AS only_b FROM a FULL JOIN b USING (video, frame) GROUP BY video".replace("USING (video, frame)", "ON a.video = b.video AND a.frame = b.frame").replace("SELECT video, count", "SELECT coalesce(a.video, b.video) AS video, count").replace("GROUP BY video", "GROUP BY 1"))
def set07(spark, d):
    e = ev(spark, d)
    return batch.overlap(e.filter("cls = 'click'"), e.filter("cls = 'view'"), ["video", "frame"], ["video"])


@query("join20_same_videos", f"WITH {EV} SELECT (SELECT count(DISTINCT video) FROM ev) = 1 AS same")
def join20(spark, d):
    e = ev(spark, d)
    return spark.createDataFrame([(batch.same_keys(e, e, "video"),)], "same boolean")


@query("join21_undeclared", f"WITH {EV} SELECT DISTINCT video FROM ev WHERE video % 3 = 0")
def join21(spark, d):
    e = ev(spark, d)
    return batch.undeclared(e, e.filter("video % 3 <> 0"), "video")


@query("join19_snk14_catalog", f"WITH {GC} SELECT video AS \"videoId\", count(*) AS \"anchorCount\" FROM gl WHERE CAST(video AS BIGINT) % 2 = 0 GROUP BY video")
def join19(spark, d):
    g = gold(spark, d).withColumnRenamed("video", "video_id").withColumns({"confidence": F.lit("high"), "notes": F.lit("")})
    v = g.select("video_id").distinct().filter("cast(video_id as bigint) % 2 = 0").select("video_id", F.lit(None).cast("string").alias("file_name"), F.lit("/a/b.mp4").alias("path"), F.lit(30.0).alias("fps"), F.lit(1).alias("frame_count"), F.lit(1.0).alias("duration_sec"))
    return sinks.semantic_catalog(g, v).select("videoId", F.col("anchorCount").cast("long").alias("anchorCount"))


@query("flt10_latest_calibration", f"WITH {EV} SELECT video, max(id) AS version FROM ev WHERE id % 4 <> 0 GROUP BY video")
def flt10(spark, d):
    c = ev(spark, d).select(F.col("video").alias("video_id"), F.col("id").alias("version"), F.when(F.col("id") % 4 == 0, "proposed").otherwise("accepted").alias("quality_status"))
    return batch.latest_calibration(c).select(F.col("video_id").alias("video"), "version")


@query("srt07_latest_one", f"WITH {EV} SELECT max(id) AS version FROM ev")
def srt07(spark, d):
    return ev(spark, d).agg(F.max("id").alias("version"))


@query("srt01_multi_key_sort", f"WITH {EV}, o AS (SELECT video, id, row_number() OVER (ORDER BY video, frame, id) AS k FROM ev) SELECT video, id FROM o WHERE k <= 100")
def srt01(spark, d):
    return ev(spark, d).orderBy("video", "frame", "id").limit(100).select("video", "id")


@query("flt11_accepted_guard", f"WITH {EV} SELECT DISTINCT video FROM ev")
def flt11(spark, d):
    v = F.md5(F.col("video").cast("string"))
    return ev(spark, d).filter(batch.accepted_for(F.lit("accepted"), F.concat(F.lit("vid_"), F.substring(v, 1, 12)), v)).select("video").distinct()


@query("flt17_variants", f"WITH {EV} SELECT id % 40 AS k, CASE WHEN id % 40 < 10 THEN 'excluded_source_variant' ELSE 'pending' END AS status, count(*) AS n FROM (SELECT DISTINCT id % 40 AS id FROM ev) GROUP BY ALL")
def flt17(spark, d):
    k = F.col("k")
    name = F.when(k < 10, F.concat(F.lit("/d/main_view_outputs/V"), k + 10, F.lit("_主视角.MP4"))).otherwise(F.concat(F.lit("/d/v"), k, F.lit(".mp4")))
    v = ev(spark, d).select((F.col("id") % 40).alias("k")).distinct().withColumn("source_path", name)
    return batch.exclude_variants(v).groupBy("k", "status").agg(F.count(F.lit(1)).alias("n"))


@query("flt19_catalog_problems", f"WITH {EV}, v AS (SELECT DISTINCT video FROM ev) SELECT video, CASE WHEN video % 5 = 0 THEN 'video record identity/checksum mismatch' ELSE 'duplicate video id or checksum' END AS problem FROM v WHERE video % 5 = 0 OR video % 5 = 1 AND (SELECT count(*) FROM v WHERE video % 5 = 1) > 1")
def flt19(spark, d):
    v = F.col("video")
    r = ev(spark, d).select("video").distinct().select("video", F.concat(F.lit("vid_"), v).alias("video_id"), F.when(v % 5 == 0, "other").otherwise(F.concat(F.lit("vid_"), v)).alias("name"), F.when(v % 5 == 1, "same").otherwise(v.cast("string")).alias("checksum"))
    return batch.catalog_problems(r).select("video", "problem")


STATES = ("completed", "completed_with_warning", "waiting_court_review", "failed", "running", "excluded_source_variant")
ST_SQL = f"{EV}, v AS (SELECT DISTINCT video FROM ev), st_ AS (SELECT ['{STATES[0]}', '{STATES[1]}', '{STATES[2]}', '{STATES[3]}', '{STATES[4]}', '{STATES[5]}'][CAST(video % 6 AS INT) + 1] AS s FROM v)"


@query("agg46_batch_counts", f"WITH {ST_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE s <> 'excluded_source_variant') AS processable_total, count(*) FILTER (WHERE s IN ('completed', 'completed_with_warning')) AS completed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'running') AS pending, CASE WHEN count(*) FILTER (WHERE s = 'failed') > 0 THEN 'partial_failure' ELSE 'waiting_court_review' END AS status FROM st_")
def agg46(spark, d):
    names = F.array(*[F.lit(s) for s in STATES])
    v = ev(spark, d).select("video").distinct().select(F.get(names, (F.col("video") % 6).cast("int")).alias("status"))
    return batch.batch_status(batch.status_counts(v)).select("total", "processable_total", "completed", "failed", "pending", "status")


@query("agg51_storage", f"WITH {EV} SELECT CAST(sum(id) FILTER (WHERE id % 2 = 0) AS BIGINT) AS source_bytes, CAST(sum(id) FILTER (WHERE id % 4 = 0) AS BIGINT) AS canonical_source_bytes, CAST(sum(id) FILTER (WHERE id % 2 = 1) AS BIGINT) AS generated_bytes FROM ev")
def agg51(spark, d):
    i = F.col("id")
    f = ev(spark, d).select(i.alias("bytes"), F.when(i % 2 == 0, "source").otherwise("work").alias("kind"), F.when(i % 4 == 0, "completed").otherwise("excluded_source_variant").alias("status"))
    return batch.storage(f)


@query("agg52_frame_keys", f"WITH {EV} SELECT video, frame, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1")
def agg52(spark, d):
    return batch.duplicate_keys(ev(spark, d), ["video", "frame"])


@query("orc08_merge_problems", f"WITH {EV} SELECT 'frames contains undeclared video IDs: [-1]' AS problem UNION ALL SELECT 'frames row count differs from input manifests: ' || (count(*) + 1) || ' != ' || count(*) FROM ev")
def orc08(spark, d):
    e = ev(spark, d).select(F.col("video").alias("video_id"), F.col("id").alias("frame_idx"))
    n = e.count()
    more = e.unionByName(spark.createDataFrame([(-1, -1)], "video_id long, frame_idx long"))
    return spark.createDataFrame([(p,) for p in batch.merge_problems({"frames": more}, e, {"frames": n})], "problem string")


def lines(spark, d) -> DataFrame:
    """Events as lines of JSON, with blank ones between."""
    e = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    return e.unionByName(spark.createDataFrame([("",), ("  ",)], "value string"))


@query("src01_jsonl", "SELECT event_id, user_id, value FROM events")
def src01(spark, d):
    return sources.parse_lines(lines(spark, d), "event_id long, user_id long, value double", strict=False)


@query("src02_strict_jsonl", "SELECT event_id, user_id, value FROM events")
def src02(spark, d):
    return sources.parse_lines(lines(spark, d), "event_id long, user_id long, value double")


@query("src03_str06_resume_prefix", f"WITH {EV} SELECT count(*) - 1 AS rows, true AS safe FROM (SELECT DISTINCT id FROM ev)")
def src03(spark, d):
    """An output that stops within its last line."""
    n = ev(spark, d).count()
    i = F.col("id")
    out = spark.range(n).select(i.alias("position"), F.when(i < n - 1, F.to_json(F.struct(F.lit("v").alias("video_id"), (i * 2).alias("frame_idx")))).otherwise("{").alias("value"), (i < n - 1).alias("closed"))
    spans = spark.createDataFrame([(0, 2 * n)], "start_frame long, end_frame long")
    return sources.prefix_state(out, spans, "v", 2)


def gold_text(spark, d) -> DataFrame:
    g = gold(spark, d)
    return g.select(F.col("video").alias("video_id"), F.col("hit_frame").cast("string").alias("hit_frame"), F.upper("hitter").alias("hitter"), F.lit(" ").alias("rally_id"), F.col("uncertainty_frames").cast("string").alias("uncertainty_frames"), "id")


@query("src05_hit_gold", f"WITH {GC} SELECT video AS video_id, frame AS hit_frame, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE side END AS hitter, 'unknown' AS rally_id, id % 3 * 10 AS uncertainty_frames FROM gl")
def src05(spark, d):
    return sources.hit_gold(gold_text(spark, d)).select("video_id", "hit_frame", "hitter", "rally_id", "uncertainty_frames")


@query("src06_semantic_gold", f"WITH {GC} SELECT video AS video_id, frame AS hit_frame, CASE WHEN id % 2 = 0 THEN 'clear' ELSE 'net shot' END AS stroke_type, id % 60 / 10 AS landing_x, frame + 5 AS landing_frame FROM gl")
def src06(spark, d):
    i = F.col("id")
    g = gold_text(spark, d).withColumns({"stroke_type": F.when(i % 2 == 0, "Clear").otherwise("net shot "), "landing_x": (i % 60 / 10).cast("string"), "landing_y": F.lit("3.5"), "landing_frame": (F.col("hit_frame").cast("long") + 5).cast("string"), "landing_kind": F.lit("next_contact")})
    return sources.semantic_gold(g).select("video_id", "hit_frame", "stroke_type", "landing_x", "landing_frame")


@query("src07_prj07_predictions", f"WITH {GC} SELECT video AS video_id, frame AS candidate_frame, CASE WHEN TRY_CAST(event_id AS BIGINT) % 2 = 0 THEN 'clear' ELSE 'unknown' END AS predicted_stroke_type, 1.5 AS predicted_landing_x FROM cand")
def src07(spark, d):
    c = candidates(spark, d).select(F.col("video").alias("video_id"), F.col("candidate_frame").cast("string").alias("hit_frame"), F.when(F.col("id") % 2 == 0, " Clear").otherwise("").alias("stroke_type"), F.lit("").alias("predicted_landing_x"), F.lit("1.5").alias("landing_x"))
    return sources.predictions(c).select("video_id", "candidate_frame", "predicted_stroke_type", "predicted_landing_x")


@query("src08_candidates", "SELECT event_id, user_id FROM events")
def src08(spark, d):
    return sources.parse_lines(lines(spark, d), "event_id long, user_id long").orderBy("user_id", "event_id")


@query("src09_bundle", f"WITH {GC} SELECT video AS video_id, count(*) AS hit_count, min(frame) AS first_hit_frame, max(frame) AS last_hit_frame FROM gl GROUP BY video")
def src09(spark, d):
    g = gold(spark, d)
    top = g.agg(F.max("hit_frame").alias("m"))
    hit = F.struct(F.col("video").alias("videoId"), F.col("hit_frame").alias("hitFrame"), F.col("uncertainty_frames").alias("uncertaintyFrames"), "hitter", F.lit("high").alias("confidence"), F.col("rally_id").alias("rallyId"), F.lit("").alias("notes"))
    v = g.groupBy(F.col("video").alias("videoId")).agg(F.collect_list(hit).alias("hits")).crossJoin(top).select(F.struct("videoId", (F.col("m") + 1).alias("frameCount"), "hits").alias("v"), "videoId")
    b = v.select(F.to_json(F.struct(F.lit("shuttlelab-gold-bundle-1").alias("schemaVersion"), F.concat(F.lit("b"), "videoId").alias("batchId"), F.array("v").alias("videos"))).alias("value"))
    return sources.bundle_report(sources.bundle_hits(b)).select("video_id", "hit_count", "first_hit_frame", "last_hit_frame")


@query("src14_segments", f"WITH {EV} SELECT CAST(video AS VARCHAR) AS name, min(frame) AS start_frame, max(frame) AS end_frame FROM ev GROUP BY video")
def src14(spark, d):
    s = ev(spark, d).groupBy("video").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    return sources.segment_manifest(s.select(F.col("video").cast("string").alias("name"), F.to_json(F.struct(F.array(F.struct("start_frame", "end_frame")).alias("segments"))).alias("value")))


@query("src15_revisions_of", f"WITH {REV} SELECT event_id, revision FROM rev WHERE video_id = 'v1'")
def src15(spark, d):
    return revisions(spark, d).filter("video_id = 'v1'").orderBy(F.col("revision").desc()).select("event_id", "revision")


@query("prj15_gold_template", f"WITH {GC} SELECT video AS video_id, CAST(frame AS VARCHAR) AS hit_frame, '' AS stroke_type, 'unknown' AS confidence FROM gl")
def prj15(spark, d):
    return sources.semantic_template(gold_text(spark, d)).select("video_id", "hit_frame", "stroke_type", "confidence")


@query("prj16_gold_events", f"WITH {GC} SELECT video AS video_id, printf('gold_semantic_%06d', row_number() OVER (PARTITION BY video ORDER BY frame)) AS event_id, frame AS candidate_frame FROM gl")
def prj16(spark, d):
    g = gold(spark, d).withColumnRenamed("video", "video_id").withColumn("stroke_type", F.lit("clear"))
    return sources.gold_events(g).select("video_id", "event_id", "candidate_frame")


@query("snk10_text_table", f"WITH {EV} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 8 * 0.125::DOUBLE AS VARCHAR) END AS x, CASE WHEN id % 2 = 0 THEN cls ELSE '' END AS cls FROM ev")
def snk10(spark, d):
    i = F.col("id")
    e = ev(spark, d).select("id", F.when(i % 3 != 0, i % 8 * 0.125).alias("x"), "cls")
    t = sinks.text_table([e.filter("id % 2 = 0"), e.filter("id % 2 = 1").drop("cls")])
    return t.withColumn("x", F.when(F.col("x").rlike(r"^\d+$"), F.concat("x", F.lit(".0"))).otherwise(F.col("x")))


@query("snk03_json_lines", "SELECT event_id, CAST(value IS NULL AS BOOLEAN) AS none FROM events")
def snk03(spark, d):
    j = table(spark, d, "events").select(F.to_json(F.struct("event_id", "value"), {"ignoreNullFields": "false"}).alias("value"))
    return sources.parse_lines(j, "event_id long, value double").select("event_id", F.col("value").isNull().alias("none"))


@query("scl01_math", f"WITH {EV} SELECT id, round(sqrt(value ** 2 + 9), 6) AS h, round(exp(-score), 6) AS e, round(ln(value + 1), 6) AS l, round(log2(value + 1), 6) AS l2, round(acos(greatest(-1, least(1, score * 2 - 1))), 6) AS a FROM ev")
def scl01(spark, d):
    v, s = F.col("value"), F.col("score")
    return ev(spark, d).select("id", F.round(F.hypot(v, F.lit(3.0)), 6).alias("h"), F.round(F.exp(-s), 6).alias("e"), F.round(F.ln(v + 1), 6).alias("l"), F.round(F.log2(v + 1), 6).alias("l2"), F.round(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s * 2 - 1))), 6).alias("a"))


@query("scl02_rounding", f"WITH {EV} SELECT id, round_even(id / 2, 0) AS half, round_even(id / 8, 2) AS eighth FROM ev")
def scl02(spark, d):
    return ev(spark, d).select("id", fn.half_even(F.col("id") / 2).alias("half"), fn.half_even(F.col("id") / 8, 2).alias("eighth"))


@query("scl03_ratios", f"WITH {EV} SELECT id, round(id / nullif(id % 5, 0), 6) AS a, round(coalesce(id / nullif(id % 5, 0), 0), 6) AS b FROM ev")
def scl03(spark, d):
    return ev(spark, d).select("id", F.round(fn.ratio(F.col("id"), F.col("id") % 5), 6).alias("a"), F.round(fn.ratio0(F.col("id"), F.col("id") % 5), 6).alias("b"))


@query("scl04_tolerant_casts", f"WITH {EV} SELECT id, CASE id % 5 WHEN 0 THEN id + 0.75 END AS x, CASE id % 5 WHEN 0 THEN id END AS n FROM ev")
def scl04(spark, d):
    i = F.col("id")
    t = F.when(i % 5 == 0, F.concat(F.lit(" "), i, F.lit(".75 "))).when(i % 5 == 1, "nan").when(i % 5 == 2, "inf").when(i % 5 == 3, "x").otherwise("")
    return ev(spark, d).select("id", fn.number(t).alias("x"), fn.whole(t).alias("n"))


@query("scl05_signs", f"WITH {EV} SELECT id, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS s FROM ev")
def scl05(spark, d):
    i = F.col("id")
    x = F.when(i % 4 == 0, 1e-13).when(i % 4 == 1, 0.5).when(i % 4 == 2, -0.5)
    return ev(spark, d).select("id", fn.sign_of(x).alias("s"))


@query("scl12_text", f"WITH {EV} SELECT id, lower(trim(' ' || upper(cls) || ' ')) AS low, lpad(CAST(id % 100 AS VARCHAR), 5, '0') AS padded, starts_with(cls, 'c') AS c, 'a' || id % 3 AS bare FROM ev")
def scl12(spark, d):
    return ev(spark, d).select("id", F.lower(F.trim(F.concat(F.lit(" "), F.upper("cls"), F.lit(" ")))).alias("low"), F.format_string("%05d", F.col("id") % 100).alias("padded"), F.startswith("cls", F.lit("c")).alias("c"), fn.bare_id(F.concat(F.lit("vid_a"), F.col("id") % 3)).alias("bare"))


@query("scl13_seed", f"WITH {EV} SELECT DISTINCT cls, (('0x' || substr(sha256(cls), 1, 8))::BIGINT + 20260822) % 4294967295 AS seed FROM ev")
def scl13(spark, d):
    return ev(spark, d).select("cls", fn.seed_of(F.col("cls"), 20260822).alias("seed")).distinct()


@query("scl14_canonical_json", "SELECT event_id, '{\"a\":' || event_id || ',\"b\":' || user_id || '}' AS j FROM events")
def scl14(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("a"), F.col("user_id").alias("b"))).alias("j"))


@query("scl15_times", f"WITH {EV} SELECT id, id / 1000 AS seconds, id / 30 AS at, CAST(id * 33 AS BIGINT) AS ms FROM ev")
def scl15(spark, d):
    return ev(spark, d).select("id", (F.col("id") / 1000).alias("seconds"), (F.col("id") / 30).alias("at"), (F.col("id") * 33).alias("ms"))


@query("scl16_arrays", "SELECT vec_id, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE)), 4) AS total, list_position(embedding, list_max(embedding)) AS best, round(list_avg(list_transform(embedding[1:4], lambda x: x::DOUBLE)), 6) AS mean FROM embeddings WHERE embedding IS NOT NULL")
def scl16(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, d, "embeddings").filter("embedding is not null").withColumn("e", e)
    total = F.aggregate(F.filter("e", lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.round(total, 4).alias("total"), F.array_position("e", F.array_max("e")).cast("int").alias("best"), F.round(F.aggregate(F.slice("e", 1, 4), F.lit(0.0), lambda a, x: a + x) / 4, 6).alias("mean"))


@query("scl24_progress", f"WITH {EV} SELECT video, least(1, count(*) / 50) AS progress FROM ev GROUP BY video")
def scl24(spark, d):
    return ev(spark, d).groupBy("video").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 50).alias("progress"))


def folder(spark) -> str:
    """A new folder where the session keeps its checkpoints; a temporary one only where none is set (tests)."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="rallyline-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def event_stream(spark, d) -> DataFrame:
    return streaming.parquet(spark, d, "events.parquet", table(spark, d, "events").schema)


@query("str01_rally_sessions", f"WITH {SESS}, l AS (SELECT max(ts) - INTERVAL 6 HOUR AS w FROM events), g AS (SELECT video, session, count(*) AS n, max(us) AS last FROM s GROUP BY ALL) SELECT video AS user_id, n FROM g WHERE make_timestamp(last) < (SELECT w FROM l)")
def str01(spark, d):
    """Sessions that the watermark has passed, from a stream over the event files."""
    out, state = folder(spark), folder(spark)
    e = event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    streaming.drain(streaming.sessions(e, "user_id", "ts", "6 hours"), out, state)
    return spark.read.schema("user_id long, session struct<start: timestamp, end: timestamp>, first timestamp, last timestamp, n long").parquet(out).select("user_id", "n")


@query("str07_latest_stream", f"WITH {EV} SELECT video AS user_id, max(id) AS event_id, arg_max(cls, id) AS event_type FROM ev GROUP BY video")
def str07(spark, d):
    out, state = folder(spark), folder(spark)
    e = event_stream(spark, d).select("user_id", "event_id", "event_type")
    streaming.drain_latest(streaming.latest(e, ["user_id"], "event_id"), out, state)
    return spark.read.parquet(out)


def frame_files(spark, d) -> tuple[str, DataFrame]:
    path = folder(spark)
    f = frames(spark, d).drop("models")
    f.write.parquet(path)
    return path, f


@query("str02_str08_shuttle_stream")
def str02(spark, d):
    """The shuttle's filter as a stream, reset at gaps; equal to the batch form but for each video's last row."""
    path, f = frame_files(spark, d)
    out, state = folder(spark), folder(spark)
    streaming.drain(streaming.follow_shuttle(spark.readStream.schema(f.schema).parquet(path), 30), out, state)
    return spark.read.parquet(out).select("video_id", "frame_idx", "tracking_state", "measurement_status")


@query("str03_track_stream")
def str03(spark, d):
    path, f = frame_files(spark, d)
    out, state = folder(spark), folder(spark)
    streaming.drain(streaming.track_players(spark.readStream.schema(f.schema).parquet(path)), out, state)
    return spark.read.parquet(out).select("video_id", "frame_idx", "side", "state", "source_frame")


@query("str04_evidence_stream")
def str04(spark, d):
    """Events and the frames within half a second of them, joined as two streams."""
    path, f = frame_files(spark, d)
    out, state = folder(spark), folder(spark)
    at = F.timestamp_seconds(F.col("timestamp_sec"))
    stream = spark.readStream.schema(f.schema).parquet(path)
    e = stream.filter("id % 3 = 0").select("video_id", F.col("id").alias("event"), at.alias("event_ts"))
    streaming.drain(streaming.evidence(e, stream.select("video_id", "frame_idx", at.alias("frame_ts")), 0.5), out, state)
    return spark.read.parquet(out).select("video_id", "event", "frame_idx")


@query("str05_peak_stream")
def str05(spark, d):
    from rallyline.operators import hits

    path = folder(spark)
    s = hits.score(frames(spark, d), 30).select("video_id", "frame_idx", "event_confidence")
    s.write.parquet(path)
    out, state = folder(spark), folder(spark)
    streaming.drain(streaming.peaks(spark.readStream.schema(s.schema).parquet(path), 12, hits.THRESHOLD), out, state)
    return spark.read.parquet(out)


@query("agg35_resampled_mean", f"WITH {EV}, de AS (SELECT cls AS metric, video, avg(value) AS delta FROM ev GROUP BY ALL), o AS (SELECT metric, delta, row_number() OVER (PARTITION BY metric ORDER BY video) - 1 AS i, count(*) OVER (PARTITION BY metric) AS k FROM de), r AS (SELECT metric, rep, ('0x' || substr(md5('7:' || rep || ':' || i), 1, 8))::BIGINT % k AS pick FROM o CROSS JOIN range(1000) t(rep)), es AS (SELECT r.metric, rep, avg(delta) AS e FROM r JOIN o ON o.metric = r.metric AND o.i = r.pick GROUP BY ALL) SELECT metric, round(quantile_cont(e, 0.025), 5) AS ci_low, round(quantile_cont(e, 0.975), 5) AS ci_high FROM es GROUP BY metric")
def agg35(spark, d):
    m = ev(spark, d).groupBy(F.col("cls").alias("metric"), "video").agg(F.avg("value").alias("delta"))
    return resample.bootstrap(m, ["metric"], "delta", ["video"], "7", 1000).select("metric", F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"))


@query("join03_forward", f"WITH {EV} SELECT a.id AS id_a, b.id AS id_b FROM ev a JOIN ev b ON a.video = b.video AND a.side <> b.side AND b.frame - a.frame BETWEEN 10 AND 240")
def join03(spark, d):
    e = ev(spark, d)
    a, b = e.select("video", F.col("id").alias("id_a"), F.col("side").alias("sa"), F.col("frame").alias("fa")), e.select("video", F.col("id").alias("id_b"), F.col("side").alias("sb"), F.col("frame").alias("fb"))
    return joins.forward_join(a, b, "video", "fa", "fb", 10, 240).filter("sa <> sb").select("id_a", "id_b")
