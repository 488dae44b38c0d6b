"""Shared pieces: scratch tables on shared storage, and word hashing over Arrow buffers.

Scratch tables are Parquet files under the folder named by ``spark.checkpoint.dir``
(shared by driver and executors), so a lost executor never loses them. Operators
delete their scratch tables once their result is checkpointed.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Multiplier of the polynomial byte hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1
#: Bytes hashed at once; bounds a worker's memory whatever the length of a text.
CHUNK = 1 << 20
#: Bytes of a batch of rows that Spark hands to a worker; a longer row is a batch of its own.
HANDED = 8 << 20


def hand_little(spark: SparkSession) -> None:
    """Let Spark hand rows to workers by bytes, not by 10 000 rows whatever their length: executor and worker each hold such a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(HANDED))


def give_back() -> None:
    """Give freed memory back to the system; workers are used again, by other stages too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rallyline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Scratch:
    """Scratch tables of one operator call."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag, self.paths = spark, tag, []
        self.root = scratch_dir(spark)
        hand_little(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
        path = f"{self.root}/{self.tag}-{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch = path  # noqa: SLF001
        self.paths.append(path)
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch", None)
        if path in self.paths:
            self._delete(path)
            self.paths.remove(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001

    def release(self) -> None:
        """Let the driver forget finished shuffles, so that their files are removed."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # noqa: SLF001

    def finish(self, df: DataFrame) -> DataFrame:
        """Checkpoint the result on the shared folder and delete all scratch tables."""
        out = df.checkpoint(eager=True)
        for path in self.paths:
            self._delete(path)
        self.paths.clear()
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its ``n + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = sum of data[j] * BASE**j for j < i; H has one more entry than data."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


#: The ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of all words of the texts, and how many words each text has.

    A word is a run of bytes outside the ASCII white space.
    """
    n = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(n, np.int64)
    gap = SPACE[data]
    first = np.zeros(len(data), bool)
    starts_of = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:]
    start = np.flatnonzero(begin)
    if not len(start):
        return none, none, np.zeros(n, np.int64)
    last = np.zeros(len(data), bool)
    last[np.append(starts_of[1:] - 1, len(data) - 1)] = True
    over = ~gap
    over[:-1] &= gap[1:] | last[:-1]
    return start, np.flatnonzero(over) + 1, np.diff(np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of the words at the spans, A-Z folded to a-z if asked.

    Texts are hashed in runs of about CHUNK bytes, cut only between words.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK)))
        low, high = start[at], stop[to - 1]
        piece = data[low:high]
        hashes = prefix_hash(LOWER[piece] if fold else piece)
        _, down = powers(len(piece))
        a, b = start[at:to] - low, stop[at:to] - low
        out[at:to] = mix((hashes[b] - hashes[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many words each text has."""
    start, stop, counts = word_spans(data, offsets)
    return span_hashes(data, start, stop, fold), counts


def starts(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums of counts, with the total at the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def planes(values: np.ndarray) -> bytes:
    """64-bit values as eight planes of bytes, lowest first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def bucket_of(g: np.ndarray, bits: int) -> np.ndarray:
    """The range of hashes, out of 2**bits (bits > 0), that each n-gram lies in."""
    return (g >> np.uint64(64 - bits)).astype(np.int64)


def batches(iterator, limit: int = 2 << 20):
    """Record batches in slices of about ``limit`` bytes of text, at least a row each.

    Arrays made of a slice take some twenty times its bytes, which bounds a worker's memory;
    what is freed is given back at the end, and before, what other stages left.
    """
    give_back()
    try:
        for batch in iterator:
            rows = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            del batch
    finally:
        give_back()
