"""Writers: typed tables, text tables, JSON documents, manifests with hashes, locks, catalogs."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline import sources
from rallyline.sources import media

DICTIONARY = {
    "coordinate_systems": {"image": "pixels, origin top left", "court": "metres, 6.1 x 13.4, origin at the upper left corner"},
    "unknown": "unknown numbers are null, unknown categories are 'unknown'",
    "player": "a side of the court, not a person",
    "shuttle": "a shuttle in flight is not on the court plane; events carry no projected place of it",
    "predictions": "predictions are not truth unless a human confirmed them",
}


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """Compact lines of JSON; nulls are written."""
    df.write.option("ignoreNullFields", False).json(path)


def significant(x: Column, digits: int = 15) -> Column:
    """A double as text with that many significant digits, without trailing zeros; NaN and infinite give the empty text."""
    e = F.format_string(f"%.{digits - 1}e", x)
    back = e.cast("double")
    plain = F.regexp_replace(F.regexp_replace(e.cast("decimal(38,19)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(e, r"\.?0*e", "e")
    fits = (F.abs(back) >= 1e-4) & (F.abs(back) < 10.0**digits)
    text = F.when(back == 0, F.lit("0")).when(fits, plain).otherwise(power)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("")).otherwise(text)


def text_table(tables: list[DataFrame]) -> DataFrame:
    """Rows of several tables as text under all their columns, in order of first appearance; missing values are empty."""
    order: list[str] = []
    for t in tables:
        order += [c for c in t.columns if c not in order]
    out = None
    for t in tables:
        kinds = dict(t.dtypes)
        one = t.select(*[(F.lit("") if c not in kinds else significant(F.col(c)) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in order])
        out = one if out is None else out.unionByName(one)
    return out


def _single(spark: SparkSession, folder: str, target: str, head: bytes = b"") -> None:
    """Parts of a written folder as one file, by the store's own streams."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(conf)
    out = fs.create(path(target), True)
    out.write(bytearray(head))
    parts = sorted(s.getPath().toString() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    for p in parts:
        part = fs.open(path(p))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 65536, False)
        part.close()
    out.close()
    fs.delete(path(folder), True)


def bom_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file with a byte-order mark and a header; quotes only where they are needed, empty values empty."""
    rows = df.orderBy(*order) if order else df
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    rows.write.option("emptyValue", "").option("nullValue", "").csv(folder)
    _single(df.sparkSession, folder, path, ("﻿" + ",".join(df.columns) + "\n").encode())


def atomic_json(value, path: str) -> None:
    """A document on the driver's disk, never seen half-written."""
    part = f"{path}.tmp"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(part, "w", encoding="utf-8", newline="\n") as out:
        json.dump(value, out, ensure_ascii=False, indent=2)
        out.write("\n")
    os.replace(part, path)


def dictionary(tables: dict[str, DataFrame]) -> dict:
    return {"schema_version": "1.0", **DICTIONARY, "tables": {name: {f.name: f.dataType.simpleString() for f in t.schema} for name, t in tables.items()}}


def artifacts(spark: SparkSession, named: dict[str, str]) -> dict[str, dict]:
    """Bytes and hash of files and folders: a folder's is that of its parts' names and hashes, in order."""
    out = {}
    for name, path in named.items():
        found = media.digests(sources.files(spark, path, "[!_.]*", True)).orderBy("path").collect()
        if len(found) == 1:
            out[name] = {"path": path, "size_bytes": found[0].size_bytes, "sha256": found[0].sha256}
        else:
            whole = spark.createDataFrame([(";".join(f"{r.path.rsplit('/', 1)[-1]}={r.sha256}" for r in found),)], "t string").select(F.sha2("t", 256)).first()[0]
            out[name] = {"path": path, "size_bytes": sum(r.size_bytes for r in found), "sha256": whole}
    return out


def manifest(spark: SparkSession, rows: dict[str, int], named: dict[str, str], **more) -> dict:
    return {"schema_version": "1.0", "generated_at": now(), **more, "rows": rows, "artifacts": artifacts(spark, named)}


def batch_manifest(spark: SparkSession, rows: dict[str, int], named: dict[str, str], inputs: list[dict], quality: dict) -> dict:
    """A manifest with the lineage of its inputs (video_id, manifest, manifest_sha256)."""
    ids = sorted(i["video_id"] for i in inputs)
    return manifest(spark, rows, named, dataset_version="local-visual-batch-v0.1", batch_id=f"batch_{uuid.uuid4()}", video_ids=ids, quality=quality, inputs=inputs)


def changed_artifacts(spark: SparkSession, declared: dict[str, dict]) -> list[str]:
    """Names of artifacts that are missing or whose hash is not the declared one."""
    out = []
    for name, spec in declared.items():
        try:
            found = artifacts(spark, {name: spec["path"]})[name]["sha256"]
        except Exception:  # noqa: BLE001
            found = None
        if found != spec["sha256"]:
            out.append(name)
    return out


def review_csvs(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Matched events, false positives and false negatives as three tables of text."""
    out = {}
    for name, t in tables.items():
        flat = t.select(*[c for c, k in t.dtypes if not k.startswith(("array", "struct", "map"))])
        out[name] = f"{folder}/{name}.csv"
        bom_csv(text_table([flat]), out[name])
    return out


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def lock(spark: SparkSession, named: dict[str, str], path: str, **more) -> dict:
    """A lock on files' hashes: written once; the same files again are fine, changed ones are an error."""
    current = {n: a["sha256"] for n, a in artifacts(spark, named).items()}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = {r["path"]: r["sha256"] for r in json.load(f)["files"]}
        if before != current:
            raise ValueError("Gold lock already exists and file hashes have changed")
    else:
        atomic_json({"schema_version": "1.0", "locked_at": now(), **more, "files": [{"path": n, "sha256": h} for n, h in sorted(current.items())]}, path)
    return current


def semantic_catalog(gold: DataFrame, videos: DataFrame) -> DataFrame:
    """A row per registered video with gold: its data and its anchors in order of frame."""
    anchor = F.struct(
        F.col("hit_frame").alias("hitFrame"), F.concat_ws(":", "video_id", "hit_frame").alias("anchorId"), F.coalesce("rally_id", F.lit("unknown")).alias("rallyId"), F.coalesce("hitter", F.lit("unknown")).alias("hitter"),
        F.coalesce("confidence", F.lit("unknown")).alias("confidence"), F.coalesce("uncertainty_frames", F.lit(0)).alias("uncertaintyFrames"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
    a = gold.groupBy("video_id").agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))
    v = videos.select("video_id", F.coalesce("file_name", F.element_at(F.split("path", "/"), -1), F.lit("video.mp4")).alias("fileName"), F.coalesce("fps", F.lit(30.0)).alias("fps"), F.coalesce("frame_count", F.lit(0)).alias("frameCount"), F.coalesce("duration_sec", F.lit(0.0)).alias("durationSec"))
    return a.join(F.broadcast(v), "video_id").select(F.col("video_id").alias("videoId"), "fileName", "fps", "frameCount", "durationSec", F.size("anchors").alias("anchorCount"), "anchors")


def run_record(video: dict, path: str, stage: str = "video_ingest") -> dict:
    """What a stage did with a video: input, output and times."""
    return {
        "run_id": f"run_{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:6]}", "pipeline_stage": stage, "schema_version": "1.0", "status": "completed", "completed_at": now(),
        "input": {"path": video["path"], "checksum": video["checksum"], "size_bytes": video["file_size_bytes"]}, "output": {"video_id": video["video_id"], "record": path},
    }


def public_manifest(video: dict, run: dict, path: str) -> None:
    atomic_json({"schema_version": "1.0", "generated_at": now(), "video": video, "latest_run": run}, path)


def npz(samples: DataFrame, arrays: dict[str, Column], path: str, most: int = 100_000) -> dict[str, list[int]]:
    """Dense arrays of samples in one compressed file on the driver, at most ``most`` of them; more belong in Parquet."""
    import numpy as np

    n = samples.count()
    if n > most:
        raise ValueError(f"{n} samples are too many for one file; write them as Parquet")
    table = samples.orderBy("candidate_frame", "event_id").select(*[c.alias(k) for k, c in arrays.items()]).toArrow()
    held = {k: np.array(table[k].to_pylist()) for k in arrays}
    np.savez_compressed(path, **held)
    return {k: list(v.shape) for k, v in held.items()}
