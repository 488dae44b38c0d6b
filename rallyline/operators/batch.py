"""Integrity of tables: strict union, keys, references, duplicates, upserts, catalogs, batch states and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tables of a dataset with their keys and order, and what is in its folder.
KEYS = {"videos": ["video_id"], "calibrations": ["video_id", "version"], "frames": ["video_id", "frame_idx"], "dataset_rows": ["video_id", "event_id"]}
ORDER = {"videos": ["video_id"], "calibrations": ["video_id", "version"], "frames": ["video_id", "frame_idx"], "dataset_rows": ["video_id", "hit_frame", "event_id"]}
ARTIFACTS = {"videos": "videos.parquet", "calibrations": "calibrations.parquet", "frames": "frames.parquet", "dataset_rows": "dataset_rows.parquet", "dictionary": "data_dictionary.json", "quality": "quality.json"}


def strict_union(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with the very same columns and types; any other schema is an error."""
    first = tables[0]
    for i, t in enumerate(tables[1:], 1):
        if t.dtypes != first.dtypes:
            raise ValueError(f"schema mismatch in table {i}: {t.dtypes} instead of {first.dtypes}")
    out = first
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def undeclared(df: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Keys of a table that are not declared."""
    return df.select(key).distinct().join(declared.select(key).distinct(), key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether both tables hold the same single key, and only that."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count() and x.limit(2).count() == 1


def overlap(a: DataFrame, b: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """How many keys are in both, only in one, only in the other; by some of the key's columns if asked."""
    j = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(b.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return j.groupBy(*(by or [])).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both_n"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` in place of what the table has under its keys."""
    return table.join(new.select(*key).distinct(), key, "left_anti").select(*table.columns).unionByName(new)


def catalog_problems(records: DataFrame) -> DataFrame:
    """Records (name, video_id, checksum) whose name isn't their id, that lack a checksum, or that share an id or a checksum."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    rows = records.withColumn("_i", n("video_id")).withColumn("_c", n("checksum"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    why = F.when(blank("video_id") | blank("checksum") | (F.col("name") != F.col("video_id")), "video record identity/checksum mismatch").when((F.col("_i") > 1) | (F.col("_c") > 1), "duplicate video id or checksum")
    return rows.withColumn("problem", why).filter(F.col("problem").isNotNull()).drop("_i", "_c")


def exclude_variants(videos: DataFrame, folder: str = "main_view_outputs", suffix: str = "_主视角") -> DataFrame:
    """Videos with ``status``: a derived file in that folder whose original is also there is excluded, and stays listed."""
    name = F.element_at(F.split("source_path", "/"), -1)
    parent = F.lower(F.try_element_at(F.split("source_path", "/"), F.lit(-2)))
    derived = F.coalesce(parent == folder, F.lit(False))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    original = F.when(derived & F.endswith(stem, F.lit(suffix)), F.lower(F.concat(F.expr(f"left(_stem, length(_stem) - {len(suffix)})"), F.col("_ext"))))
    rows = videos.withColumns({"_name": name, "_derived": derived, "_stem": stem, "_ext": ext}).withColumn("_original", original)
    known = rows.filter(~F.col("_derived")).groupBy(F.lower("_name").alias("_original")).agg(F.max("source_path").alias("canonical_source_path"))
    rows = rows.join(known, "_original", "left")
    gone = F.col("_original").isNotNull() & F.col("canonical_source_path").isNotNull()
    status = F.when(gone, "excluded_source_variant").otherwise(F.col("status") if "status" in videos.columns else F.lit("pending"))
    return rows.withColumn("status", status).drop("_name", "_derived", "_stem", "_ext", "_original")


def status_counts(videos: DataFrame) -> DataFrame:
    """One row: all, processable, completed (warnings among them), waiting, failed, pending, excluded."""
    s = F.col("status")
    kept = s != "excluded_source_variant"
    named = ("completed", "completed_with_warning", "waiting_court_review", "failed")
    return videos.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("processable_total"), F.count_if(s.isin("completed", "completed_with_warning")).alias("completed"), F.count_if(s == "completed_with_warning").alias("warnings"),
        F.count_if(s == "waiting_court_review").alias("waiting_review"), F.count_if(s == "failed").alias("failed"), F.count_if(kept & ~s.isin(*named)).alias("pending"), F.count_if(~kept).alias("excluded"),
    )


def batch_status(counts: DataFrame) -> DataFrame:
    """The batch's state out of its counts; ``ready`` where all can be merged."""
    c = F.col
    ready = (c("completed") == c("processable_total")) & (c("processable_total") > 0)
    state = F.when(ready & (c("warnings") > 0), "completed_with_warning").when(ready, "completed").when((c("waiting_review") > 0) & (c("failed") == 0), "waiting_court_review").when(c("failed") > 0, "partial_failure").otherwise("incomplete")
    return counts.withColumn("ready", ready).withColumn("status", state)


def latest_calibration(calibrations: DataFrame) -> DataFrame:
    """The accepted calibration of each video with the highest version."""
    ok = calibrations.filter(F.col("quality_status") == "accepted")
    rest = [c for c in ok.columns if c != "video_id"]
    return ok.groupBy("video_id").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("video_id", "_r.*")


def accepted_for(calibration: Column, frames_video: Column, calibration_video: Column) -> Column:
    """Raises unless the calibration is accepted and its video is the frames'."""
    from rallyline.functions import ids_match

    wrong = F.when(~F.coalesce(calibration == "accepted", F.lit(False)), "calibration is not accepted").when(~F.coalesce(ids_match(frames_video, calibration_video), F.lit(False)), "calibration video_id does not match frame video_id")
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))


def storage(files: DataFrame) -> DataFrame:
    """One row of bytes: sources, those not excluded, and generated files (path, bytes, kind, status)."""
    k = F.col("kind")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    return files.agg(total(k == "source").alias("source_bytes"), total((k == "source") & (F.coalesce("status", F.lit("")) != "excluded_source_variant")).alias("canonical_source_bytes"), total(k != "source").alias("generated_bytes"))


def merge_problems(tables: dict[str, DataFrame], declared: DataFrame, expected: dict[str, int]) -> list[str]:
    """Why merged tables can't be taken: undeclared videos, other row counts, repeated keys; empty if they can."""
    out = []
    for name, t in tables.items():
        strays = [r[0] for r in undeclared(t, declared, "video_id").limit(20).collect()]
        if strays:
            out.append(f"{name} contains undeclared video IDs: {sorted(strays)}")
        n = t.count()
        if n != expected[name]:
            out.append(f"{name} row count differs from input manifests: {n} != {expected[name]}")
        if name in ("frames", "dataset_rows", "videos") and duplicate_keys(t, KEYS[name]).limit(1).count():
            out.append(f"duplicate ({', '.join(KEYS[name])}) keys in {name}")
    return out


def side_counts(events: DataFrame, key: list[str], at: str, start: int, end: int) -> DataFrame:
    """Events in [start, end) by key."""
    return events.groupBy(*key).agg(F.count_if((F.col(at) >= start) & (F.col(at) < end)).alias("visible"))
