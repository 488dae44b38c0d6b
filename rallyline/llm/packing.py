"""Harmonic packing of token sequences.

A length L belongs to class k when C / (k + 1) < L <= C / k for capacity C, and a bin of
class k holds exactly k pieces, whatever they are: no bin looks at another, so each
worker fills the bins of its own rows. Documents are cut so that pieces lie close under
their class's bound C / k: full sequences first, then pieces of C // (k + 1) until what
is left wastes at most ``tolerance`` of a bin. Padding is thus small by construction.

What a worker leaves in bins that are not full is packed by class over all workers: its
place follows from counts by worker and class. Only the last, unfilled bin of a class
(fewer than k pieces, however large the input) is then packed without regard to classes.

Null text is empty text; empty text still has the closing id. Every row of the input is
packed, repeated rows too; an empty table gives no pieces. Only doc_id and text of the
input are looked at. A text of any length is tokenised word by word, through a bounded
cache of words.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch, batches, load, span_hashes, starts, utf8, word_spans

CAPACITY = 2048
TOLERANCE = 1 / 64
#: Pieces shorter than this are cut off only where nothing else can be.
SHORTEST = 16
END_ID = 1
#: Words whose ids a worker keeps.
CACHED_WORDS = 2_000_000
#: Bytes of text, and words, looked up at once; bounds a worker's memory.
BATCH = 1 << 20
RUN = 1 << 18
#: ASCII letters and digits, and ASCII punctuation but the bar.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
STOP = np.zeros(256, bool)
STOP[0x21:0x7F] = True
STOP[ALNUM] = False
STOP[0x7C] = False
#: A pretoken of its own that separates words encoded together.
MARK = "\x00"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, sequence_id long, offset long, pid int, place int"


class WordIds:
    """Ids of texts, through a bounded cache of words.

    The vocabulary's normaliser and pretokeniser never join characters across white
    space and drop the white space itself, so a text's ids are its words' ids in order.
    A pretoken never runs from an ASCII letter or digit on to ASCII punctuation, so words
    are parted there too (but before a bar, which special tokens hold), and words of
    ASCII alone are known in lower case. Words are told apart by a 64-bit hash of their
    bytes (with CACHED_WORDS words, two meet with a chance of 1e-7), kept in a sorted array;
    unknown words of a batch are encoded together.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(MARK)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, some: list[str]) -> list[np.ndarray]:
        if len(self.mark) == 1 and not any(MARK in w for w in some):
            ids = np.array(self._ids(f" {MARK} ".join(some)), np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) == len(some) - 1:
                begins = np.append(0, ends + 1)
                return [ids[a:b] for a, b in zip(begins.tolist(), np.append(ends, len(ids)).tolist(), strict=True)]
        return [np.array(self._ids(w), np.uint32) for w in some]

    def _learn(self, hashes: np.ndarray, found: list[str]) -> None:
        """Take up words with ascending hashes, none of them known."""
        got = [x for at in range(0, len(found), 4096) for x in self._encoded(found[at : at + 4096])]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        need = int(sizes.sum())
        while len(self.pool) < self.used + need:
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        if need:
            self.pool[self.used : self.used + need] = np.concatenate(got)
        at = np.searchsorted(self.known, hashes)
        self.first = np.insert(self.first, at, self.used + starts(sizes)[:-1])
        self.size = np.insert(self.size, at, sizes)
        self.known = np.insert(self.known, at, hashes)
        self.used += need

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashes)
        return at, np.append(self.known, np.uint64(0))[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after the other, and how many each text has."""
        data, offsets = utf8(column)
        start, stop, _ = word_spans(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut_at = np.flatnonzero(ALNUM[data[:-1]] & STOP[data[1:]]) + 1
        inside = np.searchsorted(start, cut_at, "right") - 1
        cut_at = cut_at[(cut_at > start[inside]) & (cut_at < stop[inside])]
        start, stop = np.sort(np.append(start, cut_at)), np.sort(np.append(stop, cut_at))
        beyond = np.append(0, np.cumsum(data > 127, dtype=np.int32))
        plain = beyond[stop] == beyond[start]
        hashes = np.where(plain, span_hashes(data, start, stop), span_hashes(data, start, stop, fold=False)) if not plain.all() else span_hashes(data, start, stop)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        _, have = self._find(distinct)
        if len(self.known) + int((~have).sum()) > CACHED_WORDS:
            self._clear()
            have = np.zeros(len(distinct), bool)
        new = at[~have]
        self._learn(distinct[~have], [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
        number, _ = self._find(distinct)
        number = number[which]
        size = self.size[number].astype(np.int64)
        end = np.cumsum(size)
        ids = np.empty(int(end[-1]), np.uint32)
        for low in range(0, len(size), RUN):
            s, e = size[low : low + RUN], end[low : low + RUN]
            base = e[0] - s[0]
            ids[base : e[-1]] = self.pool[np.repeat(self.first[number[low : low + RUN]] - (e - s), s) + np.arange(base, e[-1])]
        return ids, np.diff(np.append(0, end)[np.searchsorted(start, offsets)])


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def cut(tokens: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in its order."""
    out = [(capacity, 1)] * (tokens // capacity)
    left = tokens % capacity
    while left:
        k = capacity // left
        if left * k >= capacity * (1 - tolerance) or left <= 2 * SHORTEST:
            out.append((left, k))
            break
        m = k + 1
        while left - capacity // m < SHORTEST:
            m += 1
        out.append((capacity // m, m))
        left -= capacity // m
    return out


def piece_rows(path: str, capacity: int, tolerance: float):
    """Of Arrow batches with doc_id and text: pieces, those of full bins with their place."""

    def run(iterator):
        ids = word_ids(path)
        end = np.array([END_ID], np.uint32)
        pid = TaskContext.get().partitionId()
        open_bins: dict[int, list[list]] = {}
        bins = 0
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def batch(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

        for got in batches(iterator, BATCH):
            done, low = [], 0
            all_ids, sizes = ids.texts(got.column(1))
            for doc_id, size in zip(got.column(0).to_pylist(), sizes.tolist(), strict=True):
                view = memoryview(np.append(all_ids[low : low + size], end).astype("<u4").tobytes())
                low += size
                n, start = size + 1, 0
                for length, k in cut(n, capacity, tolerance):
                    row = [doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, k, None, None, pid, None]
                    start += length
                    held = open_bins.setdefault(k, [])
                    held.append(row)
                    if len(held) == k:
                        place = 0
                        for x in held:
                            x[6], x[7] = (pid << 36) + bins, place
                            place += x[2]
                        bins += 1
                        done += held
                        open_bins[k] = []
            if done:
                yield batch(done)
        for held in open_bins.values():
            for i, x in enumerate(held):
                x[9] = i
            if held:
                yield batch(held)

    return run


def last_bins(capacity: int):
    """Pack the classes' last bins by first fit; their number of pieces is bounded by the classes."""

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        sequence, offset = [], []
        for length in pdf["length"]:
            b = next((i for i, x in enumerate(room) if x >= length), len(room))
            if b == len(room):
                room.append(capacity)
            sequence.append((1 << 62) + (1 << 61) + b)
            offset.append(capacity - room[b])
            room[b] -= length
        pdf["sequence_id"], pdf["offset"] = sequence, offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(piece_rows(tokenizer, capacity, tolerance), PIECES), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = pieces.filter(F.col("sequence_id").isNull())
    held = rest.groupBy("klass", "pid").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("klass").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("klass")
    held = held.select("klass", "pid", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"), F.sum("held").over(whole).alias("all_held"))
    rest = rest.join(held, ["klass", "pid"]).withColumn("at", F.col("ahead") + F.col("place"))
    rest = rest.withColumn("bin", F.floor(F.col("at") / F.col("klass")))
    full = (F.col("bin") + 1) * F.col("klass") <= F.col("all_held")
    in_bin = Window.partitionBy("klass", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    second = rest.filter(full).withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    second = second.withColumn("sequence_id", F.lit(1 << 62) + F.col("klass").cast("long") * F.lit(1 << 44) + F.col("bin"))
    third = rest.filter(~full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).alias("one")).groupBy("one").applyInPandas(
        last_bins(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    out = pieces.filter(F.col("sequence_id").isNotNull()).select(*columns).unionByName(second.select(*columns)).unionByName(third.select(*columns))
    return scratch.finish(out)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())
