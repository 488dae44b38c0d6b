"""Removal of byte strings that occur more than once, by suffix sorting.

Every string of ``width`` bytes has a minimiser: the place of its least hashed GRAM-byte
string. Equal strings have equal minimisers at equal places, so a run of string starts
with one minimiser (a segment) only needs comparing with the segments of that minimiser.
Segments whose minimiser occurs once are done. Segments equal as a whole are repeated as
a whole. Of the distinct segments left of a minimiser, runs of strings whose hash does not
occur again there are cut off (equal strings have equal hashes), runs with equal bytes are
taken together, and the distinct ones are suffix-sorted: a string is repeated when a
neighbour in suffix order starts with the same bytes.

Suffixes are sorted by linear grouping (see ``suffix_order``). A minimiser with more than
MOST distinct segments (near copies of one passage in very many documents) is not brought
together: its segments are first cut anew by the minimisers of LONG_GRAM bytes, which
leaves groups of strings that are nearly equal. Should one still be larger than MOST, its
strings are counted by two independent 64-bit hashes instead, over all tasks.

Null text is empty; a text shorter than ``width`` loses nothing. Equal rows are copies of
each other. Rows are told apart by doc_id and text together, and other columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import BASE, CHUNK, Scratch, batches, fresh, load, mix, powers, prefix_hash, signed, starts, utf8

WIDTH = 200
GRAM = 64
LONG_GRAM = 160
#: Distinct segments of a minimiser that are sorted together.
MOST = 1024
#: Bytes of segments whose groups are looked through together.
GROUPED = 1 << 18
PLACE = np.uint64((1 << 21) - 1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, in one pass forwards and one backwards over blocks of w."""
    n = len(v) - w + 1
    pad = -len(v) % w
    full = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM):
    """(text number, start, strings, minimiser, hash of the segment) of all segments, in arrays."""
    out = []
    gram = min(gram, width)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    for low in range(0, max(0, len(data) - width + 1), CHUNK):
        high = min(low + CHUNK, len(data) - width + 1)
        piece = data[low : high + width - 1]
        sums = prefix_hash(piece)
        _, down = powers(len(piece))
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1])
        least = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        valid = end_of[low:high] - np.arange(low, high) >= width
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        if not len(first):
            continue
        breaks = np.flatnonzero(new | ~valid)
        stop = np.append(breaks, len(least))[np.searchsorted(breaks, first, "right")]
        n = stop - first
        at = (least[first] & PLACE).astype(np.int64)
        whole = mix((sums[stop + width - 1] - sums[first]) * down[first] + n.astype(np.uint64) * np.uint64(BASE) + (at - first).astype(np.uint64))
        start = first + low
        doc = np.searchsorted(offsets, start, "right") - 1
        out.append((doc, start - offsets[doc], n, grams[at], whole))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def segment_rows(width: int):
    """key, text -> key, start, n, h, seg."""

    def run(iterator):
        for batch in batches(iterator, 2 << 20):
            doc, start, n, h, seg = segments(*utf8(batch.column(1)), width)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(start), pa.array(n), pa.array(signed(h)), pa.array(signed(seg))], names=["key", "start", "n", "h", "seg"])

    return run


def suffix_order(s: list[int]) -> list[int]:
    """Suffix array of ``s``, whose last symbol is smaller than all others, in linear grouping.

    First, suffixes are grouped by their first symbol, and groups are gone through from
    the highest down. A suffix of the group at hand points to the nearest earlier suffix
    of a lower group; the suffixes pointed to leave their group for new ones just above
    it, the higher the more suffixes of the group at hand point to them. In the end a
    group holds the suffixes with one Lyndon prefix. Then the array is gone through from
    its front: the suffix before the one found, and those that it points to in turn, get
    the next free places of their groups. Nothing is renamed and nothing recurs.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        if at and s[i] != s[order[at - 1]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    before = [-1] * n
    high = n - 1
    while high >= 0:
        low = group[order[high]]
        if low == high:  # the commonest case, written out
            i = order[low]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0 and size[g := group[p]] > 1:
                size[g] -= 1
                end, at = g + size[g], place[p]
                other = order[end]
                order[at], place[other] = other, at
                order[end], place[p] = p, end
                group[p], size[end] = end, 1
            high = low - 1
            continue
        pointed: dict[int, int] = {}
        for i in sorted(order[low : high + 1]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by_count.setdefault(c, []).append(p)
            levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for level in levels:
            for p in level:
                g = group[p]
                size[g] -= 1
                end, at = g + size[g], place[p]
                other = order[end]
                order[at], place[other] = other, at
                order[end], place[p] = p, end
            fresh = [group[p] + size[group[p]] for p in level]
            for p, g in zip(level, fresh, strict=True):
                group[p] = g
            for g in fresh:
                size[g] += 1
        high = low - 1
    out, free, done = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = True
            i = before[i]
    return out


def repeated(texts: list[bytes], width: int) -> list[list[int]]:
    """For each text, the starts of its strings of ``width`` bytes that occur in all texts more than once."""
    k = len(texts)
    symbols: list[int] = []
    owner: list[int] = []
    joined = bytearray()
    for i, t in enumerate(texts):
        symbols += [b + k for b in t]
        symbols.append(k - 1 - i)
        owner.append(len(joined))
        joined += t + b"\x00"
    joined_bytes = bytes(joined)
    order = suffix_order(symbols)
    last = [False] * len(symbols)
    for i, t in enumerate(texts):
        for at in range(owner[i], owner[i] + len(t) - width + 1):
            last[at] = True
    out: list[list[int]] = [[] for _ in texts]
    found = set()
    for a, b in zip(order, order[1:], strict=False):
        if last[a] and last[b] and joined_bytes[a : a + width] == joined_bytes[b : b + width]:
            found.add(a)
            found.add(b)
    edges = np.array(owner)
    for a in sorted(found):
        i = int(np.searchsorted(edges, a, "right")) - 1
        out[i].append(a - owner[i])
    return out


def runs(places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in places:
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], s + 1)
        else:
            out.append((s, s + 1))
    return out


def candidates(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, end of starts) of runs of strings whose hash occurs again in their group.

    Equal strings have equal hashes, so that no repeated string is left out; whether
    those named are repeated is for the suffix order to say.
    """
    hashes, texts, places = [], [], []
    for low in range(0, len(data) - width + 1, CHUNK):
        high = min(low + CHUNK, len(data) - width + 1)
        piece = data[low : high + width - 1]
        sums = prefix_hash(piece)
        _, down = powers(len(piece))
        at = np.arange(low, high)
        text = np.searchsorted(offsets, at, "right") - 1
        fits = offsets[text + 1] - at >= width
        hashes.append(mix((sums[width:] - sums[:-width]) * down[: high - low] + group[text])[fits])
        texts.append(text[fits])
        places.append((at - offsets[text])[fits])
    if not hashes:
        z = np.zeros(0, np.int64)
        return z, z, z
    h, text, place = np.concatenate(hashes), np.concatenate(texts), np.concatenate(places)
    ranked = np.sort(h)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    kept = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h if len(again) else np.zeros(len(h), bool)
    text, place = text[kept], place[kept]
    if not len(text):
        return text, place, place
    new = np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1))
    first = np.flatnonzero(new)
    return text[first], place[first], place[np.append(first[1:], len(place)) - 1] + 1


def group_spans(h: np.ndarray, c: np.ndarray, key: np.ndarray, start: np.ndarray, raw: pa.Array, width: int) -> pa.RecordBatch:
    """Spans (key, low, high) of whole groups of segments; those of segments with c > 1 are known already."""
    data, offsets = utf8(raw)
    text, low, high = candidates(h.view(np.uint64), data, offsets, width)
    rows = []
    pieces = zip(h[text].tolist(), c[text].tolist(), key[text].tolist(), (start[text] + low).tolist(), (offsets[text] + low).tolist(), (high - low).tolist(), strict=True)
    for _, mine in groupby(pieces, key=lambda r: r[0]):
        places: dict[bytes, list] = {}
        for _, copies, k, at, begin, n in mine:
            places.setdefault(data[begin : begin + n - 1 + width].tobytes(), []).append((copies, k, at))
        several = {t: len(x) > 1 or x[0][0] > 1 for t, x in places.items()}
        again = dict(zip(places, repeated(list(places), width), strict=True)) if len(places) > 1 and not all(several.values()) else {}
        for t, found in places.items():
            spans = [(0, len(t) - width + 1)] if several[t] else runs(again.get(t, []))
            rows += [(k, at + a, at + b - 1 + width) for copies, k, at in found if copies == 1 for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["key", "low", "high"])


def sorted_groups(width: int):
    """Rows (h, c, key, start, bytes) sorted by h -> spans (key, low, high) of segments with c = 1.

    Whole groups are taken together, about GROUPED bytes of them at a time.
    """

    def spans(rows: pa.RecordBatch):
        h, sizes = rows.column(0).to_numpy(zero_copy_only=False), np.diff(utf8(rows.column(4))[1])
        edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        ends, low = starts(sizes)[edges], 0
        while low < len(edges) - 1:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + GROUPED, "right")) - 1)
            some = rows.slice(edges[low], edges[high] - edges[low])
            yield group_spans(*[some.column(i).to_numpy(zero_copy_only=False) for i in range(4)], some.column(4), width)
            low = high

    def run(iterator):
        held: list[pa.RecordBatch] = []
        for batch in iterator:
            if not batch.num_rows:
                continue
            held.append(batch)
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if h[0] == h[-1]:  # the group may go on
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            edge = whole.num_rows - batch.num_rows + int(np.searchsorted(h, h[-1]))
            held = [whole.slice(edge)]
            yield from spans(whole.slice(0, edge))
        if held:
            yield from spans(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def split_rows(width: int):
    """Rows (h, c, key, start, bytes) cut anew by longer minimisers: (h, seg, c, key, start, bytes)."""

    def run(iterator):
        for batch in iterator:
            raw = batch.column(4)
            data, offsets = utf8(raw)
            doc, start, n, h, seg = segments(data, offsets, width, LONG_GRAM)
            old = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[doc]
            c, key, first = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (1, 2, 3))
            low = offsets[doc] + start
            pieces = [data[a:b].tobytes() for a, b in zip(low.tolist(), (low + n - 1 + width).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(mix(h + old))), pa.array(signed(seg)), pa.array(c), pa.array(key), pa.array(first + start), pa.array(pieces, pa.binary())], names=["h", "seg", "c", "key", "start", "bytes"])

    return run


def string_rows(width: int):
    """Rows (h, c, key, start, bytes) -> a row per string: its two hashes, c, key, place."""

    def run(iterator):
        for batch in iterator:
            for h, c, key, start, raw in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                data = np.frombuffer(raw, np.uint8)
                _, down = powers(len(data))
                n = len(data) - width + 1
                one, two = prefix_hash(data), prefix_hash(data ^ np.uint8(0x5A))
                first = mix((one[width:] - one[:-width]) * down[:n])
                second = mix((two[width:] - two[:-width]) * down[:n] + np.uint64(h & ((1 << 64) - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(first)), pa.array(signed(second)), pa.array(np.full(n, c)), pa.array(np.full(n, key)), pa.array(np.arange(start, start + n))], names=["one", "two", "c", "key", "low"])

    return run


def row_key() -> Column:
    """What rows share only if doc_id and text are equal."""
    return F.xxhash64("doc_id", "text")


def repeated_spans(docs: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(key, spans): the byte ranges of each text covered by strings that occur elsewhere too."""
    texts = docs.select(row_key().alias("key"), "text")
    every = scratch.write(texts.mapInArrow(segment_rows(width), "key long, start long, n long, h long, seg long"), "segments")
    shared = scratch.write(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "common")  # apart, so that a common one can be split in the join
    some = scratch.write(every.join(shared, "h", "left_semi"), "shared")
    for table in (every, shared):
        scratch.drop(table)
    kinds = some.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start", "n")).alias("rep"))
    kinds = scratch.write(kinds.select("h", "seg", "c", "rep.key", "rep.start", "rep.n"), "kinds")
    scratch.release()
    whole = some.join(kinds.filter("c > 1").select("h", "seg"), ["h", "seg"], "left_semi").select("key", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + width).alias("high"))
    open_groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")).filter("kinds > 1 and least = 1").select("h", "kinds")
    wanted = kinds.join(open_groups, "h").select("h", "c", "key", "start", "n", "kinds")
    raw = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") - 1 + width)
    found = texts.join(wanted, "key").select("h", "c", "key", "start", raw.alias("bytes"), "kinds")
    found = scratch.write(found.dropDuplicates(["h", "key", "start"]), "bytes")
    scratch.release()
    columns = ["h", "c", "key", "start", "bytes"]
    few = found.filter(F.col("kinds") <= MOST).select(columns)
    many = found.filter(F.col("kinds") > MOST).select(columns)
    finer = scratch.write(many.mapInArrow(split_rows(width), "h long, seg long, c long, key long, start long, bytes binary"), "finer")
    totals = finer.groupBy("h", "seg").agg(F.sum("c").alias("t"))
    open_finer = totals.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    finer = finer.join(totals, ["h", "seg"])
    alike = finer.filter("c = 1 and t > 1").select("key", F.col("start").alias("low"), (F.col("start") + F.length("bytes")).alias("high"))
    finer = finer.dropDuplicates(["h", "seg"]).join(open_finer.filter("kinds > 1"), "h").select("h", F.col("t").alias("c"), "key", "start", "bytes", "kinds")
    few = few.unionByName(finer.filter(F.col("kinds") <= MOST).select(columns)).repartition("h").sortWithinPartitions("h")
    spans = few.mapInArrow(sorted_groups(width), "key long, low long, high long")
    strings = finer.filter(F.col("kinds") > MOST).select(columns).mapInArrow(string_rows(width), "one long, two long, c long, key long, low long")
    counted = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two")
    rest = strings.filter("c = 1").join(counted, ["one", "two"], "left_semi").select("key", "low", (F.col("low") + width).alias("high"))
    spans = whole.unionByName(alike).unionByName(spans).unionByName(rest)
    spans = scratch.write(spans.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    for table in (some, kinds, found):
        scratch.drop(table)
    scratch.release()
    return spans


def union(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def removed(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    cuts = union(spans)
    kept, at = [], 0
    for low, high in cuts:
        kept.append(raw[at:low])
        at = high
    kept.append(raw[at:])
    return b"".join(kept), cuts


def digest_rows(iterator):
    """doc_id, text, spans -> what is left of each text."""
    for batch in batches(iterator):
        rows = []
        for doc_id, text, spans in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, cuts = removed(raw, spans)
            rows.append((doc_id, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch, width)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    rows = texts.join(spans, "key", "left").select("doc_id", "text", "spans")
    return scratch.finish(rows.mapInArrow(digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def cut_rows(text: int, spans: int):
    def run(iterator):
        for batch in batches(iterator):
            kept = [None if t is None else removed(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            columns = [pa.array(kept, pa.string()) if i == text else c for i, c in enumerate(batch.columns) if i != spans]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != spans])

    return run


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without their repeated bytes (and without characters cut in two), other columns as they were."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = scratch.finish(repeated_spans(docs, scratch, width))
    key, covered = fresh(docs, "_key"), fresh(docs, "_spans")
    spans = spans.select(F.col("key").alias(key), F.col("spans").alias(covered))
    rows = docs.withColumn(key, row_key()).join(spans, key, "left").select(*docs.columns, covered)
    out = rows.mapInArrow(cut_rows(docs.columns.index("text"), len(docs.columns)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir, "documents"))
