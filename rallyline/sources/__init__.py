"""Readers: JSON lines, gold and prediction tables, bundles, manifests, discovery of files.

Every reader gives a schema; what does not fit raises an error when the rows are used,
naming the file. Readers look at files through Spark, so any store that it reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline.functions import COURT_L, COURT_W, STROKES, filled, number
from rallyline.schemas import HIT_GOLD, SEMANTIC_GOLD, names

HITTERS = ("upper", "lower", "unknown")
KINDS = ("next_contact", "ground_contact")
SURE = ("high", "medium", "low")
VIDEOS = ("mp4", "mov", "mkv")


def require(rows: DataFrame, problem: Column) -> DataFrame:
    """The rows, raising the problem's text for the first that has one."""
    return rows.withColumn("_ok", F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True)).filter("_ok").drop("_ok")


def parse_lines(lines: DataFrame, schema: str, strict: bool = True, value: str = "value") -> DataFrame:
    """Objects out of lines of JSON, blank ones skipped. Strict: a line that is no object raises an error, else it gives nulls."""
    rows = lines.filter(F.trim(value) != "")
    parsed = F.from_json(value, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.withColumn("_j", parsed)
    if strict:
        bad = F.col("_j._corrupt").isNotNull() | ~F.startswith(F.ltrim(F.col(value)), F.lit("{"))
        where = F.col("_file") if "_file" in lines.columns else F.lit("input")
        line = F.concat(F.lit(":"), F.col("_line").cast("string")) if "_line" in lines.columns else F.lit("")
        rows = require(rows, F.when(bad, F.concat(F.lit("invalid JSON object at "), where, line, F.lit(": "), F.substring(value, 1, 80))))
    return rows.select("_j.*").drop("_corrupt")


def jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False, line_numbers: bool = False) -> DataFrame:
    """JSON-lines files. With line numbers each file is read whole, so that errors can name the line."""
    if line_numbers:
        whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\n")).alias("_line", "value"))
        lines = whole.withColumn("_line", F.col("_line") + 1)
    else:
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"))
    return parse_lines(lines, schema, strict)


def csv_text(spark: SparkSession, paths: str | list[str], required: set[str]) -> DataFrame:
    """A CSV table with a header, all columns text; a byte-order mark is no part of the first name."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(paths)
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    missing = required - set(df.columns)
    if missing:
        raise ValueError(f"CSV lacks the columns {sorted(missing)}")
    return df


def text(df: DataFrame, name: str, default: str = "") -> Column:
    """A column's trimmed text, the default where the column or the value is missing or blank."""
    c = F.trim(F.col(name)) if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def integer(df: DataFrame, name: str, default: str | None = None) -> Column:
    c = F.nullif(F.trim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(c, F.lit(default)).try_cast("long")


def unique(key: list[str], what: str) -> Column:
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return F.when(n > 1, F.concat(F.lit(f"{what}: repeated "), F.concat_ws("/", *key)))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def hit_gold(raw: DataFrame) -> DataFrame:
    """Checked hit labels: whole non-negative frames, known hitters, unique by video and frame."""
    r = raw.select(
        text(raw, "video_id").alias("video_id"), integer(raw, "hit_frame").alias("hit_frame"), F.lower(text(raw, "hitter", "unknown")).alias("hitter"), text(raw, "rally_id", "unknown").alias("rally_id"),
        text(raw, "confidence", "unknown").alias("confidence"), integer(raw, "uncertainty_frames", "0").alias("uncertainty_frames"), text(raw, "notes").alias("notes"),
    )
    c = F.col
    problem = (
        F.when(c("video_id") == "", "empty video_id").when(c("hit_frame").isNull() | c("uncertainty_frames").isNull(), "invalid frame value")
        .when((c("hit_frame") < 0) | (c("uncertainty_frames") < 0), "negative frame value").when(~c("hitter").isin(*HITTERS), F.concat(F.lit("invalid hitter "), c("hitter")))
    )
    return require(r, F.coalesce(problem, unique(["video_id", "hit_frame"], "hit gold"))).select(*names(HIT_GOLD))


def read_hit_gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return not_empty(hit_gold(csv_text(spark, paths, {"video_id", "hit_frame", "hitter"})), "hit gold")


def semantic_gold(raw: DataFrame) -> DataFrame:
    """Checked semantic labels: known strokes and kinds, landings on the court and not before the hit."""
    given = F.trim(F.col("landing_frame")) != "" if "landing_frame" in raw.columns else F.lit(False)
    r = raw.select(
        text(raw, "video_id").alias("video_id"), text(raw, "rally_id", "unknown").alias("rally_id"), integer(raw, "hit_frame").alias("hit_frame"), F.lower(text(raw, "hitter", "unknown")).alias("hitter"),
        F.lower(text(raw, "stroke_type")).alias("stroke_type"), number(F.col("landing_x")).alias("landing_x"), number(F.col("landing_y")).alias("landing_y"), integer(raw, "landing_frame").alias("landing_frame"),
        F.lower(text(raw, "landing_kind")).alias("landing_kind"), text(raw, "confidence", "unknown").alias("confidence"), integer(raw, "uncertainty_frames", "0").alias("uncertainty_frames"), text(raw, "notes").alias("notes"),
        F.coalesce(given, F.lit(False)).alias("_given"),
    )
    c = F.col
    problem = (
        F.when((c("video_id") == "") | c("hit_frame").isNull() | (c("hit_frame") < 0), "invalid video_id/hit_frame").when(c("uncertainty_frames").isNull() | (c("uncertainty_frames") < 0), "negative uncertainty")
        .when(c("_given") & c("landing_frame").isNull(), "landing_frame must be an integer").when(~c("hitter").isin(*HITTERS), "invalid hitter").when(~c("stroke_type").isin(*STROKES), F.concat(F.lit("unsupported stroke_type "), c("stroke_type")))
        .when(~c("landing_kind").isin(*KINDS), "invalid landing_kind").when(c("landing_x").isNull() | c("landing_y").isNull(), "landing must be numeric and finite")
        .when(~c("landing_x").between(0, COURT_W) | ~c("landing_y").between(0, COURT_L), "destination is outside the court").when(c("landing_frame") < c("hit_frame"), "landing_frame precedes hit_frame")
    )
    return require(r, F.coalesce(problem, unique(["video_id", "hit_frame"], "semantic gold"))).select(*names(SEMANTIC_GOLD))


def read_semantic_gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return not_empty(semantic_gold(csv_text(spark, paths, {"video_id", "rally_id", "hit_frame", "hitter", "stroke_type", "landing_x", "landing_y", "landing_kind"})), "semantic gold")


def semantic_template(hits: DataFrame) -> DataFrame:
    """Hit labels as an empty form for semantic ones."""
    given = {"video_id": "", "rally_id": "unknown", "hit_frame": "", "hitter": "unknown", "confidence": "unknown", "uncertainty_frames": "0", "notes": ""}
    return hits.select(*[(F.coalesce(F.col(n).cast("string"), F.lit(given[n])) if n in given and n in hits.columns else F.lit(given.get(n, ""))).alias(n) for n in names(SEMANTIC_GOLD)])


def gold_events(gold: DataFrame) -> DataFrame:
    """Semantic labels as events, numbered by frame within each video."""
    k = F.row_number().over(Window.partitionBy("video_id").orderBy("hit_frame"))
    return gold.select(
        "*", F.format_string("gold_semantic_%06d", k).alias("event_id"), F.col("hit_frame").alias("candidate_frame"), F.col("hitter").alias("predicted_hitter"), F.col("hitter").alias("human_hitter"),
        F.col("stroke_type").alias("human_stroke_type"), F.lit("human_semantic_gold").alias("label_source"),
    )


def predictions(raw: DataFrame) -> DataFrame:
    """Predictions of either format under one set of names: the first name that has a value wins."""
    have = set(raw.columns)
    first = lambda *cs: filled(*[F.col(c) for c in cs if c in have]) if have & set(cs) else F.lit(None).cast("string")
    frame = F.coalesce(*[F.col(c).cast("string") for c in ("hit_frame", "candidate_frame") if c in have]).try_cast("long")
    r = raw.select(
        F.coalesce(first("video_id"), F.lit("")).alias("video_id"), first("event_id").alias("event_id"), frame.alias("candidate_frame"), F.coalesce(first("predicted_hitter", "player"), F.lit("unknown")).alias("predicted_hitter"),
        F.lower(F.trim(F.coalesce(first("predicted_stroke_type", "stroke_type"), F.lit("unknown")))).alias("predicted_stroke_type"), first("predicted_landing_x", "landing_x").cast("double").alias("predicted_landing_x"),
        first("predicted_landing_y", "landing_y").cast("double").alias("predicted_landing_y"),
    )
    return require(r, F.when(F.col("candidate_frame").isNull(), "prediction has an invalid hit frame"))


PREDICTED = "video_id string, event_id string, hit_frame string, candidate_frame string, predicted_hitter string, player string, predicted_stroke_type string, stroke_type string, predicted_landing_x string, landing_x string, predicted_landing_y string, landing_y string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or JSON-lines file of predictions, by its suffix, in order of video and frame."""
    raw = csv_text(spark, path, set()) if path.lower().endswith(".csv") else jsonl(spark, path, PREDICTED)
    return not_empty(predictions(raw), "prediction file").orderBy("video_id", "candidate_frame")


def read_candidates(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return not_empty(jsonl(spark, paths, schema), "candidate file").orderBy("video_id", "candidate_frame")


HIT = "struct<videoId: string, hitFrame: string, uncertaintyFrames: string, hitter: string, confidence: string, rallyId: string, notes: string>"
BUNDLE = f"schemaVersion string, batchId string, videos array<struct<videoId: string, frameCount: string, hits: array<{HIT}>>>"


def bundle_hits(bundles: DataFrame) -> DataFrame:
    """Hits out of bundles (text column ``value``), with batch, frame count and every rule on them checked."""
    b = bundles.select(F.from_json("value", BUNDLE).alias("b")).select("b.*")
    b = require(b, F.when(~F.coalesce(F.col("schemaVersion") == "shuttlelab-gold-bundle-1", F.lit(False)), "unsupported Gold bundle schema").when(F.coalesce("batchId", F.lit("")) == "", "Gold bundle has no batchId").when(F.coalesce(F.size("videos"), F.lit(0)) <= 0, "Gold bundle contains no videos"))
    v = b.select("batchId", F.explode("videos").alias("v")).select("batchId", "v.*").withColumn("_count", F.col("frameCount").try_cast("long"))
    label = F.coalesce("videoId", F.lit(""))
    v = require(v, F.when(label == "", "invalid or duplicate videoId").when(~F.coalesce(F.col("_count") > 0, F.lit(False)), F.concat(label, F.lit(" frameCount must be positive"))).when(F.coalesce(F.size("hits"), F.lit(0)) <= 0, F.concat(label, F.lit(" contains no hit annotations"))))
    v = require(v, unique(["batchId", "videoId"], "bundle"))
    h = v.select("batchId", "videoId", "_count", F.explode("hits").alias("h"))
    h = h.select(
        F.col("batchId").alias("batch_id"), F.col("videoId").alias("video_id"), F.col("_count").alias("frame_count"), F.col("h.videoId").alias("_of"), F.coalesce("h.rallyId", F.lit("unknown")).alias("rally_id"),
        F.col("h.hitFrame").try_cast("long").alias("hit_frame"), F.coalesce("h.hitter", F.lit("")).alias("hitter"), F.coalesce("h.confidence", F.lit("")).alias("confidence"),
        F.col("h.uncertaintyFrames").try_cast("long").alias("uncertainty_frames"), F.coalesce("h.notes", F.lit("")).alias("notes"),
    )
    wrong = (
        F.when(~F.col("video_id").eqNullSafe(F.col("_of")), "a hit has a mismatched videoId").when(~F.coalesce((F.col("hit_frame") >= 0) & (F.col("hit_frame") < F.col("frame_count")), F.lit(False)), "a hit has an invalid or duplicate frame")
        .when(~F.coalesce(F.col("uncertainty_frames") >= 0, F.lit(False)) | ~F.col("hitter").isin(*HITTERS) | ~F.col("confidence").isin(*SURE), "a hit has invalid categorical data")
    )
    h = require(h, F.when(wrong.isNotNull(), F.concat("video_id", F.lit(": "), wrong)))
    return require(h, unique(["video_id", "hit_frame"], "a hit has an invalid or duplicate frame")).drop("_of")


def read_bundles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return bundle_hits(spark.read.text(paths, wholetext=True))


def bundle_report(hits: DataFrame) -> DataFrame:
    """Per video: frames, hits, first and last hit."""
    return hits.groupBy("batch_id", "video_id").agg(F.max("frame_count").alias("frame_count"), F.count(F.lit(1)).alias("hit_count"), F.min("hit_frame").alias("first_hit_frame"), F.max("hit_frame").alias("last_hit_frame"))


def segment_manifest(manifests: DataFrame) -> DataFrame:
    """Closed spans out of manifests (text columns ``name`` and ``value``); a bad span or a manifest without any is an error."""
    m = manifests.select("name", F.from_json("value", "segments array<struct<start_frame: long, end_frame: long>>").alias("m"))
    m = require(m, F.when(F.coalesce(F.size("m.segments"), F.lit(0)) <= 0, F.concat(F.lit("main-view manifest has no segments: "), F.col("name"))))
    s = m.select("name", F.explode("m.segments").alias("s")).select("name", "s.*")
    bad = ~F.coalesce((F.col("start_frame") >= 0) & (F.col("end_frame") >= F.col("start_frame")), F.lit(False))
    return require(s, F.when(bad, F.concat(F.lit("invalid main-view segment in "), F.col("name"))))


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return segment_manifest(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("name"), "value"))


def analysis_tables(spark: SparkSession, paths: str | list[str], pattern: str = r"/([^/]+)/dataset/[^/]+$") -> DataFrame:
    """One table out of a CSV per match, all text, with the match's id taken from its path."""
    extra = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(paths).select("*", extra.alias("_video"))
    raw = raw.toDF(*[c.lstrip("﻿").strip('"') for c in raw.columns])
    return raw.drop("video_id").withColumnRenamed("_video", "video_id")


def files(spark: SparkSession, paths: str | list[str], pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, length and time of the files under folders; their contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths).select("path", "length", "modificationTime")


def discover_videos(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Video files by extension, one per name without regard to case, in that order."""
    found = files(spark, paths, "*", recursive).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*VIDEOS))
    one = found.groupBy(F.lower("path").alias("_k")).agg(F.max_by(F.struct("path", "length"), "path").alias("f"))
    return one.orderBy("_k").select("f.*")


def discover_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Folders of datasets below a root: itself, or ``*/dataset`` and ``*``, by their manifest."""
    found = files(spark, root, "manifest.json", True).select(F.regexp_replace("path", "/manifest.json$", "").alias("folder"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace(F.regexp_replace("folder", r"^[a-z]+:/*", ""), f"^{base}/?", "")
    own = found.withColumn("_below", below)
    if not own.filter("_below = ''").isEmpty():
        return own.filter("_below = ''").select("folder")
    return own.filter(F.col("_below").rlike(r"^[^/]+(/dataset)?$")).select("folder").distinct().orderBy("folder")


def prefix_state(lines: DataFrame, spans: DataFrame, video: str, stride: int, most: int = 0) -> DataFrame:
    """How far an interrupted output is a clean prefix of the expected frames: one row with ``rows`` and ``safe``.

    ``lines``: position (from 0), value, closed (whether the line ended); ``spans``: closed
    start_frame, end_frame. An unclosed or broken last line is left out; any other
    difference makes the output unsafe, with 0 rows.
    """
    at = F.sequence(F.col("start_frame") + F.pmod(-F.col("start_frame"), F.lit(stride)), F.col("end_frame"), F.lit(stride).cast("long"))
    expected = spans.filter(F.col("start_frame") + F.pmod(-F.col("start_frame"), F.lit(stride)) <= F.col("end_frame")).select(F.explode(at).alias("want"))
    expected = expected.withColumn("position", F.row_number().over(Window.orderBy("want")) - 1)
    rows = lines.withColumn("_last", F.max("position").over(Window.partitionBy()))
    parsed = F.from_json("value", "video_id string, frame_idx long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.withColumn("_j", parsed)
    tail = (F.col("position") == F.col("_last")) & (~F.col("closed") | F.col("_j._corrupt").isNotNull())
    rows = rows.filter(~tail)
    rows = rows.filter(F.col("position") < most) if most else rows
    j = rows.join(expected, "position", "left")
    good = (F.col("_j.video_id") == video) & (F.col("_j.frame_idx") == F.col("want")) & F.col("_j._corrupt").isNull() & F.col("closed")
    safe = F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(True))
    return j.agg(safe.alias("safe"), F.when(safe, F.count(F.lit(1))).otherwise(0).alias("rows"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """position, value and closed of a file's lines, the file read whole."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.posexplode(F.split("value", "\n")).alias("position", "value"), F.size(F.split("value", "\n")).alias("_n"))
    rows = parts.withColumn("closed", F.col("position") < F.col("_n") - 1)
    return rows.filter((F.col("position") < F.col("_n") - 1) | (F.col("value") != "")).drop("_n")
