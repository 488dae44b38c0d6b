"""Video files: boxes of the container, checksums, registration records, fetched assets."""

from __future__ import annotations

import hashlib
import os
import struct
import urllib.request
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Bytes of a container's index that are read; a larger one gives no metadata.
MOST_INDEX = 1 << 28
METADATA = "duration_sec double, width long, height long, fps double, frame_count long, has_audio boolean, container string"


def headers(stream: BinaryIO, low: int, high: int) -> Iterator[tuple[str, int, int]]:
    """(kind, first byte of the payload, end) of the boxes between two places of a stream."""
    while low + 8 <= high:
        stream.seek(low)
        head = stream.read(16)
        if len(head) < 8:
            return
        size, kind = struct.unpack(">I4s", head[:8])
        skip = 8
        if size == 1:
            if len(head) < 16:
                return
            size, skip = struct.unpack(">Q", head[8:16])[0], 16
        elif size == 0:
            size = high - low
        if size < skip or low + size > high:
            return
        yield kind.decode("latin-1"), low + skip, low + size
        low += size


def payload(stream: BinaryIO, low: int, high: int, *path: str) -> bytes | None:
    """Bytes of the first box down a path of kinds."""
    for kind, a, z in headers(stream, low, high):
        if kind == path[0]:
            if len(path) == 1:
                stream.seek(a)
                return stream.read(min(z - a, MOST_INDEX))
            found = payload(stream, a, z, *path[1:])
            if found is not None:
                return found
    return None


def duration(box: bytes | None) -> float | None:
    """Seconds of a movie or media header, in either width."""
    if not box or len(box) < 20:
        return None
    scale, ticks = struct.unpack(">IQ", box[20:32]) if box[0] == 1 and len(box) >= 32 else struct.unpack(">II", box[12:20])
    return ticks / scale if scale else None


def media(stream: BinaryIO, size: int, container: str) -> dict:
    """Metadata of an MP4 or MOV stream, from its index alone; nothing known gives nulls."""
    out = {"duration_sec": None, "width": None, "height": None, "fps": None, "frame_count": None, "has_audio": False, "container": container}
    movie = next(((a, z) for kind, a, z in headers(stream, 0, size) if kind == "moov"), None)
    if movie is None:
        return out
    seconds = duration(payload(stream, *movie, "mvhd"))
    for kind, a, z in headers(stream, *movie):
        handler = payload(stream, a, z, "mdia", "hdlr") if kind == "trak" else None
        what = handler[8:12] if handler and len(handler) >= 12 else b""
        if what == b"soun":
            out["has_audio"] = True
        if what != b"vide":
            continue
        head = payload(stream, a, z, "tkhd")
        if head and len(head) >= 8:
            out["width"], out["height"] = (round(v / 65536) for v in struct.unpack(">II", head[-8:]))
        sizes = payload(stream, a, z, "mdia", "minf", "stbl", "stsz")
        if sizes and len(sizes) >= 12:
            out["frame_count"] = struct.unpack(">I", sizes[8:12])[0]
        own = duration(payload(stream, a, z, "mdia", "mdhd")) or seconds
        if out["frame_count"] is not None and own:
            out["fps"] = round(out["frame_count"] / own, 6)
        seconds = own if seconds is None else seconds
        break
    out["duration_sec"] = None if seconds is None else round(seconds, 6)
    return out


def opened(path: str):
    """A seekable stream of a file in any store that Arrow reads, and its size."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    stream = store.open_input_file(inner)
    return stream, stream.size()


def sha256(path: str) -> tuple[str, int]:
    stream, size = opened(path)
    digest = hashlib.sha256()
    with stream:
        while block := stream.read(BLOCK):
            digest.update(block)
    return digest.hexdigest(), size


def probe(paths: DataFrame) -> DataFrame:
    """path -> checksum, size and metadata, each file read in blocks where it is probed."""
    columns = f"path string, checksum string, file_size_bytes long, {METADATA}"

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for path in pdf["path"]:
                checksum, size = sha256(path)
                kind = path.rsplit(".", 1)[-1].lower()
                stream, _ = opened(path)
                with stream:
                    found = media(stream, size, kind) if kind in ("mp4", "mov") else {"has_audio": False, "container": kind}
                rows.append({"path": path, "checksum": checksum, "file_size_bytes": size, **found})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")]).astype({"width": "Int64", "height": "Int64", "frame_count": "Int64"})

    return paths.select("path").mapInPandas(run, columns)


def digests(paths: DataFrame) -> DataFrame:
    """path -> size_bytes, sha256."""
    def run(frames):
        import pandas as pd

        for pdf in frames:
            found = [(p, *sha256(p)[::-1]) for p in pdf["path"]]
            yield pd.DataFrame(found, columns=["path", "size_bytes", "sha256"])

    return paths.select("path").mapInPandas(run, "path string, size_bytes long, sha256 string")


def registered(probed: DataFrame, match_id: str = "pilot-001", source: str = "local", domain: str = "fixed-camera-singles", redistribution: str = "private") -> DataFrame:
    """Registration records; a video's id is the first 12 digits of its checksum."""
    nobody = F.struct(F.lit("unknown").alias("A"), F.lit("unknown").alias("B"))
    return probed.select(
        F.concat(F.lit("vid_"), F.substring("checksum", 1, 12)).alias("video_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "checksum", F.lit("sha256").alias("checksum_algorithm"),
        *[c for c in probed.columns if c not in ("path", "checksum")], F.lit(match_id).alias("match_id"), nobody.alias("players"), F.lit(source).alias("source"), F.lit(domain).alias("domain"),
        F.lit(redistribution).alias("redistribution"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("registered_at"), F.lit("registered").alias("status"),
    )


def manifest_problems(spark: SparkSession, models: DataFrame, folder: str) -> DataFrame:
    """Declared files (name, filename, size_bytes, sha256) that are missing or differ, with the reason."""
    from rallyline import sources

    have = sources.files(spark, folder).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    there = digests(have.join(F.broadcast(models.select("filename")), "filename").select("path")).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    j = models.join(there.select("filename", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha")), "filename", "left")
    why = F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size_bytes"), "unexpected size").when(F.col("_sha") != F.col("sha256"), "SHA-256 mismatch")
    return j.withColumn("problem", why).filter(F.col("problem").isNotNull()).select("name", "filename", "problem")


def fetch(url: str, target: str, size: int, checksum: str, member: tuple[int, int] | None = None) -> str:
    """An asset written beside its target, verified, and renamed; ``member`` asks for a range of bytes only."""
    request = urllib.request.Request(url)  # noqa: S310
    if member:
        request.add_header("Range", f"bytes={member[0]}-{member[1]}")
    part = f"{target}.part"
    with urllib.request.urlopen(request) as answer, open(part, "wb") as out:  # noqa: S310
        if member and getattr(answer, "status", 206) == 200:
            answer.read(member[0])
        left = member[1] - member[0] + 1 if member else None
        while block := answer.read(BLOCK if left is None else min(BLOCK, left)):
            out.write(block)
            left = None if left is None else left - len(block)
    found, n = sha256(part)
    if (found, n) != (checksum, size):
        os.remove(part)
        raise ValueError(f"{url}: size or SHA-256 differ")
    os.replace(part, target)
    return target
