"""Annotation: append-only revisions, their latest state, workflow rules, agreement, queues, rallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import COURT_L, COURT_W, STROKES, ratio
from rallyline.operators import joins
from rallyline.schemas import SPOT

#: States of a revision and what may be said in one.
STATUSES = ("unreviewed", "gold", "rejected", "uncertain", "double_checked", "adjudicated")
REVIEWED = ("double_checked", "adjudicated")
GOLD = ("gold", "double_checked", "adjudicated")
LABEL_SOURCES = ("machine_review", "manual")
LANDING_KINDS, LANDING_STATUSES, CONFIDENCES = ("next_contact", "terminal"), ("observed", "out", "caught", "unobservable"), ("high", "medium", "low")
#: The kinds of landing of a semantic gold file and of the annotation tables.
KIND_OF_FILE = {"next_contact": "next_contact", "terminal": "ground_contact"}
TARGETS = {"hitter_agreement": 0.98, "hit_frame_within_3_agreement": 0.95, "stroke_cohen_kappa": 0.8}


def latest(revisions: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """The row of each key with the highest revision."""
    rest = [c for c in revisions.columns if c not in key]
    top = revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("_r"))
    return top.select(*key, "_r.*")


def next_revision(revisions: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows numbered after what there is: the highest revision of their key and one; a key's new rows in order of ``created_at``."""
    top = revisions.groupBy(*key).agg(F.max("revision").alias("_top"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("created_at"))
    return new.join(top, key, "left").withColumn("revision", (F.coalesce("_top", F.lit(0)) + place).cast("long")).drop("_top")


def spot(json: Column) -> Column:
    return F.from_json(json, SPOT)


def valid_spot(p: Column) -> Column:
    """No point, or one on the court with a known source and both or neither of its image places."""
    image = (p["image_x"].isNull() & p["image_y"].isNull()) | ((p["image_x"] >= 0) & (p["image_y"] >= 0))
    ok = image & p["court_x"].between(0, COURT_W) & p["court_y"].between(0, COURT_L) & p["source"].isin("video", "court")
    return p.isNull() | F.coalesce(ok, F.lit(False))


def serialised(revisions: DataFrame) -> DataFrame:
    """Revisions as they are served: seconds, parsed points and predictions."""
    return revisions.withColumn("candidate_time", F.col("candidate_time_ms") / 1000).withColumns({
        "hit_position": spot(F.col("hit_position_json")), "landing_position": spot(F.col("landing_position_json")),
        "machine_prediction": F.from_json("machine_prediction_json", "map<string, string>"),
    }).drop("candidate_time_ms", "hit_position_json", "landing_position_json", "machine_prediction_json")


def payload_error(rows: DataFrame) -> DataFrame:
    """``error``: why a submitted event can't be taken, or null."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad_time = F.col("candidate_time").isNull() | F.isnan("candidate_time") | (F.col("candidate_time") < 0) | F.col("candidate_frame").isNull() | (F.col("candidate_frame") < 0)
    error = (
        F.when(blank("video_id") | blank("event_id"), "video_id and event_id are required")
        .when(bad_time, "candidate time and frame must be non-negative")
        .when(~F.coalesce(F.trim("hitter").isin("A", "B"), F.lit(False)), "hitter must be A or B")
        .when(blank("stroke"), "stroke is required")
        .when(~F.coalesce(F.trim("status").isin(*STATUSES), F.lit(False)), "invalid status")
        .when(~F.coalesce(F.trim("label_source"), F.lit("machine_review")).isin(*LABEL_SOURCES), "invalid label_source")
        .when(~valid_spot(F.col("hit_position")) | ~valid_spot(F.col("landing_position")), "hit_position and landing_position must be valid court coordinates")
    )
    return rows.withColumn("error", error)


def semantic_error(rows: DataFrame) -> DataFrame:
    """``error``: why a submitted semantic label can't be taken, or null."""
    no = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    gold, seen = F.col("status") == "gold", F.col("landing_status") == "observed"
    error = (
        F.when((F.coalesce("video_id", F.lit("")) == "") | (F.coalesce("anchor_id", F.lit("")) == "") | F.col("hit_frame").isNull() | (F.col("hit_frame") < 0), "invalid anchor")
        .when(no("hitter", ("upper", "lower", "unknown")) | no("status", ("gold", "uncertain")) | no("confidence", CONFIDENCES), "invalid categorical field")
        .when(~F.coalesce(F.col("uncertainty_frames").between(0, 30), F.lit(False)), "invalid uncertainty")
        .when(gold & no("stroke_type", STROKES), "stroke_type is not one of the 18")
        .when(gold & no("landing_kind", LANDING_KINDS), "invalid landing_kind")
        .when(gold & no("landing_status", LANDING_STATUSES), "invalid landing_status")
        .when(gold & seen & ~F.coalesce(F.col("landing_area").between(1, 9), F.lit(False)), "an observed landing needs an area")
        .when(gold & ~seen & F.col("landing_area").isNotNull(), "only an observed landing has an area")
    )
    return rows.withColumn("error", error)


def complete_gold() -> Column:
    """A gold label with a stroke and a landing that is out, caught, unobservable, or observed in an area."""
    settled = F.col("landing_status").isin("out", "caught", "unobservable") | ((F.col("landing_status") == "observed") & F.col("landing_area").isNotNull())
    return F.coalesce((F.col("status") == "gold") & (F.coalesce("stroke_type", F.lit("")) != "") & settled, F.lit(False))


def transition_error(before: Column, status: Column, annotator: Column, reviewer: Column, actor: Column) -> Column:
    """Why a state can't follow the one before, or null; checks and adjudications need another person."""
    fresh = ~before.eqNullSafe(status)
    return (
        F.when((before == "adjudicated") & (status != "adjudicated"), "adjudicated events cannot be downgraded")
        .when((before == "double_checked") & ~status.isin(*REVIEWED), "double-checked events can only advance to adjudicated")
        .when(fresh & (status == "double_checked") & ~F.coalesce(before.isin("gold", "uncertain"), F.lit(False)), "double check requires a Gold or uncertain revision")
        .when(fresh & (status == "adjudicated") & ~F.coalesce(before.isin("double_checked", "uncertain"), F.lit(False)), "adjudication requires a double-checked or uncertain revision")
        .when(fresh & (status == "double_checked") & actor.isNotNull() & (annotator == actor), "double check requires another annotator")
        .when(fresh & (status == "adjudicated") & actor.isNotNull() & (reviewer == actor), "adjudication requires another reviewer")
    )


def workflow_violations(revisions: DataFrame, key: list[str]) -> DataFrame:
    """Revisions that their predecessor doesn't allow, with the reason. ``actor_id`` names who made a revision."""
    w = Window.partitionBy(*key).orderBy("revision")
    error = transition_error(F.lag("status").over(w), F.col("status"), F.lag("annotator_id").over(w), F.lag("reviewer_id").over(w), F.col("actor_id"))
    return revisions.withColumn("error", error).filter(F.col("error").isNotNull())


def pilot_metrics(revisions: DataFrame, target: int = 50) -> DataFrame:
    """Per video, counts of the latest states, progress to the target, candidate precision and estimated recall."""
    target = min(target, 10_000) if target > 0 else 50
    e = latest(revisions, ["video_id", "event_id"])
    s, machine = F.col("status"), F.col("label_source") == "machine_review"
    gold = s.isin(*GOLD)
    n = {
        "reviewed": s != "unreviewed", "gold": gold, "machine_gold": gold & machine, "manual_gold": gold & (F.col("label_source") == "manual"), "machine_rejected": (s == "rejected") & machine,
        "uncertain": s == "uncertain", "annotated": s == "gold", "double_checked": s == "double_checked", "adjudicated": s == "adjudicated",
    }
    out = e.groupBy("video_id").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    out = out.join(revisions.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_revisions")), "video_id")
    return out.withColumns({
        "target_gold": F.lit(target), "progress": F.least(F.lit(1.0), F.col("gold") / target), "candidate_precision": ratio(F.col("machine_gold"), F.col("machine_gold") + F.col("machine_rejected")),
        "estimated_recall": ratio(F.col("machine_gold"), F.col("machine_gold") + F.col("manual_gold")),
    })


def comparisons(revisions: DataFrame) -> DataFrame:
    """Each event's last double check with a base (else its last adjudication with one) beside that base."""
    key = ["video_id", "event_id"]
    r = revisions.filter(F.col("review_base_revision").isNotNull() & F.col("status").isin(*REVIEWED))
    pick = r.groupBy(*key).agg(F.max(F.struct((F.col("status") == "double_checked").alias("_d"), F.col("revision"), F.col("review_base_revision"), "hitter", "candidate_frame", "stroke", "reviewer_id", "review_note")).alias("review"))
    base = revisions.select(*key, F.col("revision").alias("base_revision"), F.struct("hitter", "candidate_frame", "stroke").alias("base"))
    return pick.withColumn("base_revision", F.col("review.review_base_revision")).join(base, [*key, "base_revision"])


def kappa(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labellings by key; null where chance agreement is complete."""
    counts = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(*keys, F.col(a).alias("_l")).agg(F.sum("n").alias("ln"))
    right = counts.groupBy(*keys, F.col(b).alias("_l")).agg(F.sum("n").alias("rn"))
    chance = left.join(right, [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("ln") * F.col("rn")).alias("c"))
    out = total.join(chance, keys, "left") if keys else total.crossJoin(chance)
    po, pe = ratio(F.col("same"), F.col("t")), F.coalesce(ratio(F.col("c"), F.col("t") * F.col("t")), F.lit(0.0))
    return out.select(*keys, F.col("t").alias("n"), po.alias("agreement"), F.when(F.abs(1 - pe) >= 1e-12, (po - pe) / (1 - pe)).alias("kappa"))


def agreement(revisions: DataFrame) -> DataFrame:
    """Per video: sample size, agreement on hitter, frame (within 3) and stroke, kappa of strokes, disagreements, adjudicated events."""
    c = comparisons(revisions)
    near = F.abs(F.col("base.candidate_frame") - F.col("review.candidate_frame")) <= 3
    same_hitter, same_stroke = F.col("base.hitter") == F.col("review.hitter"), F.col("base.stroke") == F.col("review.stroke")
    n = F.count(F.lit(1))
    out = c.groupBy("video_id").agg(
        n.alias("sample_size"), ratio(F.count_if(same_hitter), n).alias("hitter_agreement"), ratio(F.count_if(near), n).alias("hit_frame_within_3_agreement"),
        ratio(F.count_if(same_stroke), n).alias("stroke_agreement"), F.count_if(~(same_hitter & near & same_stroke)).alias("disagreements_count"),
    )
    k = kappa(c.select("video_id", F.col("base.stroke").alias("a"), F.col("review.stroke").alias("b")), ["video_id"], "a", "b").select("video_id", F.col("kappa").alias("stroke_cohen_kappa"))
    done = latest(revisions, ["video_id", "event_id"]).groupBy("video_id").agg(F.count_if(F.col("status") == "adjudicated").alias("adjudicated_count"))
    return done.join(out, "video_id", "left").join(k, "video_id", "left").na.fill(0, ["sample_size", "disagreements_count"])


def disagreements(revisions: DataFrame) -> DataFrame:
    """Events whose review changed something, with what changed."""
    c = comparisons(revisions)
    changed = F.array(
        F.when(F.col("base.hitter") != F.col("review.hitter"), "hitter"), F.when(F.abs(F.col("base.candidate_frame") - F.col("review.candidate_frame")) > 3, "hit_frame"),
        F.when(F.col("base.stroke") != F.col("review.stroke"), "stroke"),
    )
    c = c.withColumn("changed_fields", F.filter(changed, lambda x: x.isNotNull())).filter(F.size("changed_fields") > 0)
    return c.select("video_id", "event_id", "base_revision", F.col("review.revision").alias("review_revision"), "changed_fields", F.col("base").alias("original"), F.struct("review.hitter", "review.candidate_frame", "review.stroke").alias("review"), F.col("review.reviewer_id").alias("reviewer_id"), F.col("review.review_note").alias("review_note"))


def merged_events(machine: DataFrame, reviews: DataFrame) -> DataFrame:
    """Machine events overridden by their latest review; events known by review alone come too."""
    m = machine.select("video_id", "event_id", F.col("rally").alias("_rally"), F.col("time").alias("_time"), F.col("hitter").alias("_hitter"), F.col("stroke").alias("_stroke"), F.col("confidence").alias("_confidence"), F.col("status").alias("_status"), F.lit(True).alias("_m"))
    r = reviews.withColumn("_r", F.lit(True))
    both = m.join(r, ["video_id", "event_id"], "full_outer")
    known = F.col("_r").isNotNull()
    rally = F.when(known & ~((F.col("rally_id") == "Model pilot") & F.col("_rally").isNotNull()), F.col("rally_id")).otherwise(F.col("_rally"))
    pick = lambda a, b: F.when(known, F.col(a)).otherwise(F.col(b))
    said = F.coalesce(F.get_json_object("machine_prediction_json", "$.confidence").try_cast("double"), F.lit(0.0))
    return both.select(
        "video_id", "event_id", rally.alias("rally"), pick("candidate_time", "_time").alias("time"), pick("hitter", "_hitter").alias("hitter"), pick("stroke", "_stroke").alias("stroke"),
        F.coalesce("_confidence", said).alias("confidence"), pick("status", "_status").alias("status"), "revision", F.col("_m").isNull().alias("review_only"),
    )


def player_at(events: DataFrame, assignments: DataFrame) -> DataFrame:
    """``player``: who plays on the event's side at its frame, by the last assignment in force; A above and B below without one."""
    side = assignments.select("video_id", F.col("effective_frame").alias("candidate_frame"), F.struct("upper_player", "lower_player").alias("_who"), "version")
    out = joins.as_of_join(events, side, "video_id", "candidate_frame", "_who", "version")
    s = F.col("hitter_side")
    name = F.when(s == "lower", F.coalesce("as_of.lower_player", F.lit("B"))).when(s.isNotNull(), F.coalesce("as_of.upper_player", F.lit("A")))
    return out.withColumn("player", name).drop("as_of")


def queue(events: DataFrame, kind: str) -> DataFrame:
    """Events of a work queue: ``pending``, ``review`` or ``all``."""
    kinds = {"pending": ("unreviewed",), "review": ("gold", "uncertain", "double_checked")}
    return events.filter(F.col("status").isin(*kinds[kind])) if kind in kinds else events


def next_item(events: DataFrame, kind: str = "pending") -> DataFrame:
    """Per event (unique by video and time), the next one of a queue: the first later one, else the first of all, for pending the next of any state."""
    w = Window.partitionBy("video_id").orderBy("time", "event_id")
    later, every = w.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("video_id").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.col("status") == "unreviewed" if kind == "pending" else F.col("status").isin("gold", "uncertain", "double_checked")
    found = F.first(F.when(wanted, F.col("event_id")), ignorenulls=True).over(later)
    if kind == "pending":
        wrap = F.coalesce(F.lead("event_id").over(w), F.first("event_id").over(every))
    else:
        first = F.first(F.when(wanted, F.col("event_id")), ignorenulls=True).over(every)
        wrap = F.when(first != F.col("event_id"), first)
    return events.select("video_id", "event_id", F.coalesce(found, wrap).alias("next_event_id"))


def renumber(events: DataFrame) -> DataFrame:
    """Rallies numbered by their first appearance in time."""
    start = events.groupBy("video_id", "rally").agg(F.min(F.struct("time", "event_id")).alias("_s"))
    place = start.select("video_id", "rally", F.format_string("Rally %02d", F.dense_rank().over(Window.partitionBy("video_id").orderBy("_s"))).alias("_name"))
    return events.join(place, ["video_id", "rally"]).withColumn("rally", F.col("_name")).drop("_name")


def split_before(events: DataFrame, video: str, event: str) -> DataFrame:
    """The rally of an event cut before it, rallies numbered anew; as it was if the event begins its rally."""
    w = Window.partitionBy("video_id").orderBy("time", "event_id")
    rows = events.withColumn("_before", F.lag("rally").over(w))
    at = rows.filter((F.col("video_id") == video) & (F.col("event_id") == event) & (F.col("_before") == F.col("rally"))).select(F.col("rally").alias("_r"), F.struct("time", "event_id").alias("_from"))
    rows = rows.drop("_before").join(F.broadcast(at), (F.col("video_id") == video) & (F.col("rally") == F.col("_r")) & (F.struct("time", "event_id") >= F.col("_from")), "left")
    cut = F.col("_r").isNotNull()
    return renumber(rows.withColumn("rally", F.when(cut, F.concat("rally", F.lit(f"__split_{event}"))).otherwise(F.col("rally"))).drop("_r", "_from"))


def merge_with_previous(events: DataFrame, video: str, rally: str) -> DataFrame:
    """A rally joined to the one before it in time, rallies numbered anew."""
    start = events.filter(F.col("video_id") == video).groupBy("rally").agg(F.min(F.struct("time", "event_id")).alias("_s"))
    before = start.withColumn("_p", F.lag("rally").over(Window.orderBy("_s"))).filter(F.col("rally") == rally).select(F.col("rally").alias("_r"), "_p")
    rows = events.join(F.broadcast(before), (F.col("video_id") == video) & (F.col("rally") == F.col("_r")), "left")
    return renumber(rows.withColumn("rally", F.coalesce("_p", "rally")).drop("_r", "_p"))


def annotation_csv(events: DataFrame) -> DataFrame:
    """Columns of the downloadable annotation table, all text."""
    point = lambda c, k: F.coalesce(F.col(f"{c}.court_{k}").cast("string"), F.lit(""))
    return events.select(
        "event_id", F.regexp_replace("rally", " ", "_").alias("rally_id"), F.format_string("%.3f", "time").alias("hit_time"), F.col("hitter").alias("player"), F.col("stroke").alias("stroke_type"),
        F.format_string("%.2f", "confidence").alias("stroke_type_confidence"), point("hit_position", "x").alias("hit_x"), point("hit_position", "y").alias("hit_y"), point("landing_position", "x").alias("landing_x"),
        point("landing_position", "y").alias("landing_y"), F.coalesce("label_source", F.lit("machine_review")).alias("label_source"), F.col("status").alias("annotation_status"), F.lit("hit-rules-0.2.0").alias("model_version"),
    )
