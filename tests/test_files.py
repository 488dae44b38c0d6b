"""Discovery, fan-in, manifests, fetched assets, tensors and records on disk."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyline import orchestration, sinks, sources
from rallyline.operators import profile
from rallyline.sources import media


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_dataset_folders(spark, tmp_path):
    for name in ("a/dataset", "b", "c/d/e"):
        put(tmp_path / name / "manifest.json", "{}")
    found = [r.folder.rsplit(tmp_path.name, 1)[1] for r in sources.discover_datasets(spark, str(tmp_path)).collect()]
    assert found == ["/a/dataset", "/b"]
    assert [r.folder.rsplit("/", 1)[1] for r in sources.discover_datasets(spark, str(tmp_path / "b")).collect()] == ["b"]


def test_match_tables_fan_in(spark, tmp_path):
    row = "event_id,rally_id,stroke_index,hit_time,player,stroke_type,player_location_x,player_location_y,opponent_location_x,opponent_location_y,landing_x,landing_y\n"
    paths = [put(tmp_path / v / "dataset" / "dataset_rows.csv", "﻿" + row + f"e1,r1,1,0.5,upper,smash,1,1,2,12,3,12\ne2,r1,2,{t},lower,lob,1,12,2,1,9,1\n") for v, t in (("vid_a", "1.5"), ("vid_b", "x"))]
    raw = sources.analysis_tables(spark, paths)
    dim = spark.createDataFrame([(v, "upper", "o", "c") for v in ("vid_a", "vid_b")], "video_id string, focal_side string, opponent string, competition string")
    got = {(r.video_id, r.event_id): r for r in profile.normalise(raw, dim).collect()}
    assert len(got) == 4 and got["vid_a", "e1"].athlete == "focal" and got["vid_a", "e1"].macro_type == "后场进攻"
    assert got["vid_b", "e2"].hit_time is None and got["vid_a", "e2"].landing_x is None and got["vid_a", "e1"].landing_zone9 == "后场-中路"
    a = profile.audit(raw).first()
    assert (a.raw_rows, a.invalid_landing_x, a.missing_hit_time) == (4, 2, 1)


def test_predictions_by_suffix(spark, tmp_path):
    c = put(tmp_path / "p.csv", "video_id,hit_frame,player,stroke_type,landing_x\nv,9,upper, Clear ,1.5\nv,3,,,\n")
    j = put(tmp_path / "p.jsonl", '{"video_id": "v", "candidate_frame": 9, "predicted_stroke_type": "drop", "stroke_type": "x"}\n')
    rows = sources.read_predictions(spark, c).collect()
    assert [(r.candidate_frame, r.predicted_hitter, r.predicted_stroke_type, r.predicted_landing_x) for r in rows] == [(3, "unknown", "unknown", None), (9, "upper", "clear", 1.5)]
    assert sources.read_predictions(spark, j).first().predicted_stroke_type == "drop"
    with pytest.raises(Exception, match="invalid hit frame"):
        sources.read_predictions(spark, put(tmp_path / "q.csv", "video_id,hit_frame\nv,x\n")).collect()


def test_segment_manifests(spark, tmp_path):
    p = put(tmp_path / "s.json", json.dumps({"segments": [{"start_frame": 1, "end_frame": 5}]}))
    assert tuple(sources.read_segments(spark, p).select("start_frame", "end_frame").first()) == (1, 5)
    for bad, why in (({"segments": []}, "no segments"), ({"segments": [{"start_frame": 5, "end_frame": 1}]}, "invalid main-view segment")):
        with pytest.raises(Exception, match=why):
            sources.read_segments(spark, put(tmp_path / "bad" / f"{len(why)}.json", json.dumps(bad))).collect()


def test_models_are_verified(spark, tmp_path):
    good = b"weights"
    put(tmp_path / "a.onnx", good)
    put(tmp_path / "b.onnx", b"other")
    sha = hashlib.sha256(good).hexdigest()
    models = spark.createDataFrame([("a", "a.onnx", 7, sha), ("b", "b.onnx", 5, sha), ("c", "c.onnx", 7, sha), ("d", "a.onnx", 8, sha)], "name string, filename string, size_bytes long, sha256 string")
    got = {r.name: r.problem for r in media.manifest_problems(spark, models, str(tmp_path)).collect()}
    assert got == {"b": "SHA-256 mismatch", "c": "missing", "d": "unexpected size"}
    report = orchestration.verify(spark, [str(tmp_path / "none")], models.filter("name = 'a'"), str(tmp_path))
    assert report == {"ok": False, "missing": [str(tmp_path / "none")], "models": []}


def test_fetched_assets(tmp_path):
    source = put(tmp_path / "s.bin", b"0123456789")
    target = str(tmp_path / "t.bin")
    sha = hashlib.sha256(b"0123456789").hexdigest()
    assert open(media.fetch(f"file://{source}", target, 10, sha), "rb").read() == b"0123456789"
    with pytest.raises(ValueError, match="differ"):
        media.fetch(f"file://{source}", str(tmp_path / "u.bin"), 10, "0" * 64)
    assert not (tmp_path / "u.bin").exists() and not (tmp_path / "u.bin.part").exists()


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "i int, x double")
    d = sinks.dictionary({"t": df})
    assert d["tables"] == {"t": {"i": "int", "x": "double"}}
    sinks.csv(df, f"{tmp_path}/c")
    sinks.append(df, f"{tmp_path}/a")
    sinks.append(df, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["i", "x"]
    video = {"video_id": "v", "path": "p", "checksum": "c", "file_size_bytes": 3}
    run = sinks.run_record(video, "r")
    sinks.public_manifest(video, run, f"{tmp_path}/public.json")
    assert json.loads((tmp_path / "public.json").read_text())["latest_run"]["output"]["video_id"] == "v"
    m = sinks.batch_manifest(spark, {"t": 1}, {"t": f"{tmp_path}/c"}, [{"video_id": "v", "manifest": "m", "manifest_sha256": "s"}], {"status": "ok"})
    assert m["video_ids"] == ["v"] and m["artifacts"]["t"]["size_bytes"] > 0
    paths = sinks.review_csvs({"false_positives": df}, str(tmp_path))
    assert open(paths["false_positives"], encoding="utf-8-sig").read() == "i,x\n1,0.5\n"


def test_tensors_in_one_file(spark, tmp_path):
    df = spark.createDataFrame([("e1", 5, [[1.0, 2.0]]), ("e0", 3, [[3.0, 4.0]])], "event_id string, candidate_frame long, xy array<array<double>>")
    shapes = sinks.npz(df, {"xy": F.col("xy"), "frame": F.col("candidate_frame")}, f"{tmp_path}/a.npz")
    held = np.load(f"{tmp_path}/a.npz")
    assert shapes == {"xy": [2, 1, 2], "frame": [2]} and held["frame"].tolist() == [3, 5] and held["xy"][0].tolist() == [[3.0, 4.0]]
    with pytest.raises(ValueError, match="too many"):
        sinks.npz(df, {"xy": F.col("xy")}, f"{tmp_path}/b.npz", 1)
