"""Jaccard self-join of documents on word n-grams, by T-occurrence search.

Two sets of sizes m and n have Jaccard similarity t or more exactly when they share
T = ceil(t * (m + n) / (1 + t)) shingles. Documents with equal sets form a class, and one
of each class is joined on. In one order of all shingles (frequent ones last, then by
hash), similar sets share a shingle among their first n - ceil(t * n) + 1; those inverted
lists bring documents together. For the documents met, inverted lists over whole sets are
searched as in DivideSkip: the short lists are merged by a heap, documents found there
at least T - L times are looked up in the L long lists by binary search, and those found
T times are linked.

Only classes are compared, and only as far as components need it: first each document of
a list with the first of its list (one pair a document, so a list of any length stays
linear), then, across components only, the remaining pairs. No link between different
components is lost, and no group is expanded into all its pairs.

Which of the first shingles other documents have too is found packed: documents are put in
batches, and each batch sends its shingles, sorted and stored as differences by byte planes,
to as many ranges of hashes; a range answers each batch with a bit a shingle. Only shared
shingles become rows. Whole sets are made of those documents only that are in a pair to be
verified; their texts are found by a broadcast of their numbers up to a documented size, and
by a shuffled semi-join beyond it.

The frequent shingles are known to the tasks as a bit map of fixed size, made from counts
of all shingles in as many buckets; its collisions change the order alike for all
documents, so they cannot change the result. Each set also has a parity sketch: every member
flips one of m bits, m being the next power of two to its size, 256 at least, so two sets
differ in at least as many members as their sketches differ in bits. A sketch folds to any
smaller power of two. Folded to 256 bits (the signature) it drops pairs within the joins,
before they become rows; at full length, a fortieth of the sets, it drops most of the rest
before whole sets are moved. Neither drops a similar pair.

Null or white text has an empty set and links with nothing; fewer words than a shingle
count as one shingle of all words. Repeated rows form a class. A doc_id on several rows is
one node: where its texts differ, each row is searched with its own text, under a hash of
doc_id and text, and the components of one doc_id's rows are joined. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch, batches, bucket_of, fresh, load, mix, planes, signed, starts, unplaned, utf8, words
from rallyline.llm._graph import components

WIDTH = 5
#: Similarity as a whole number of hundredths.
PERCENT = 80
#: A shingle whose bucket counts this many more than LOAD mean buckets is ordered last.
FREQUENT = 32
LOAD = 4
#: Buckets of the counts, and bits of the map, of frequent shingles.
MAP_BITS = 1 << 21
#: Buckets in a row of counts.
SLICE = 1 << 15
#: Longs of a parity signature.
LANES = 4
#: Documents searched with one query at a time.
COLLECTION = 256
#: First shingles in a batch, and batches' shingles in a range of hashes, about.
GRAMS = 1 << 18
#: So many doc_ids at most are broadcast to find their texts (8 MB of numbers).
NAMED = 1 << 20
#: Orders in which documents are first compared with the first of their lists.
ROUNDS = 2
FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    hashes, counts = words(data, offsets)
    at = starts(counts)
    joined = hashes.copy()
    for back in range(1, width):
        joined = joined[: len(hashes) - back] * FOLD + hashes[back:] if len(hashes) > back else joined[:0]
    joined = mix(joined)
    out = []
    for low, n in zip(at[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(joined[low : low + n - width + 1]))
        elif n:
            short = np.uint64(n)
            for h in hashes[low : low + n]:
                short = np.uint64((int(short) * int(FOLD) + int(h)) & ((1 << 64) - 1))
            out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(m: int, n: int, percent: int) -> int:
    """Shingles that sets of m and n members share if they are similar."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def lists_of(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(starts(np.array([len(s) for s in sets], np.int64)), pa.int32()), pa.array(flat))


def sketch_of(members: np.ndarray) -> np.ndarray:
    """Longs of a set's parity sketch; each member flips one bit."""
    bits = max(64 * LANES, 1 << max(0, len(members) - 1).bit_length())
    spot = (mix(members ^ FOLD) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, longs), axis=0)


def class_rows(width: int):
    """doc_id, text -> doc_id, n, two sums that tell sets apart; at a task's end its counts of shingles by bucket.

    A row of counts has a slice's number and SLICE counts of two bytes each; slices without any are left out.
    """
    names = ["doc_id", "n", "one", "two", "slice", "counts"]

    def run(iterator):
        total = np.zeros(MAP_BITS, np.uint32)
        for batch in batches(iterator):
            sets = shingle_sets(batch.column(1), width)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            np.add.at(total, (flat % np.uint64(MAP_BITS)).astype(np.int64), 1)
            n = [len(s) for s in sets]
            one = signed(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64))
            two = signed(np.array([mix(s ^ FOLD).sum(dtype=np.uint64) for s in sets], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        for k, part in enumerate(total.reshape(-1, SLICE)):
            if part.any():
                none = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*none, pa.array([k], pa.int32()), pa.array([np.minimum(part, 65535).astype("<u2").tobytes()], pa.binary())], names=names)

    return run


def slice_bits(least: float):
    """slice, counts of all tasks -> slice, bits of the buckets with more than ``least``."""

    def run(iterator):
        total: dict[int, np.ndarray] = {}
        for batch in iterator:
            for k, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = total.setdefault(k, np.zeros(SLICE, np.int64))
                part += np.frombuffer(counts, "<u2")
        for k, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part > least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    return run


def first_rows(percent: int, width: int, bits: bytes):
    """doc_id, text -> doc_id, n, first shingles with frequent ones last, sketch, signature."""
    frequent = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)

    def run(iterator):
        for batch in batches(iterator):
            sets = shingle_sets(batch.column(1), width)
            first = []
            for s in sets:
                late = frequent[(s % np.uint64(MAP_BITS)).astype(np.int64)]
                first.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)] if len(s) else s)
            sketches = [sketch_of(x) for x in sets]
            short = np.array([folded(x, LANES) for x in sketches], np.uint64).reshape(-1, LANES)
            lanes = [pa.array(signed(np.ascontiguousarray(short[:, k]))) for k in range(LANES)]
            full = pa.array([x.tobytes() for x in sketches], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), lists_of(first), full, *lanes], names=["doc_id", "n", "first", "sketch", *[f"s{k}" for k in range(LANES)]])

    return run


def pack_rows(iterator):
    """Rows of ``first_rows`` -> batches of about GRAMS first shingles, a row each, numbered by task."""
    k = TaskContext.get().partitionId() << 32
    held, grams = [], 0
    for batch in iterator:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        low = 0
        while low < batch.num_rows:
            room = np.cumsum(sizes[low:]) + grams
            high = low + int(np.searchsorted(room, GRAMS)) + 1  # with the row that fills the batch
            held.append(batch.slice(low, high - low))
            grams = int(room[min(high, batch.num_rows) - low - 1])
            low = min(high, batch.num_rows)
            if grams >= GRAMS:
                yield packed(k, held)
                k, held, grams = k + 1, [], 0
    if held:
        yield packed(k, held)


def packed(k: int, held: list) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    first = table["first"].combine_chunks()
    sizes = first.value_lengths().cast(pa.int64())
    columns = {"doc_id": table["doc_id"], "n": table["n"], "size": sizes, "first": first.flatten(), "sketch": table["sketch"], **{f"s{j}": table[f"s{j}"] for j in range(LANES)}}
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *lists], names=["batch", *columns])


PACKED = "batch long, doc_id array<long>, n array<long>, size array<long>, first array<long>, sketch array<binary>, " + ", ".join(f"s{j} array<long>" for j in range(LANES))


def range_rows(bits: int):
    """batch, first shingles -> batch, bucket, differences of its distinct shingles there, a bit where the batch has it twice."""

    def run(iterator):
        for batch in iterator:
            for k, first in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, n = np.unique(first.values.to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
                cuts = np.searchsorted(bucket_of(h, bits), np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[i], cuts[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), k), pa.int64()),
                        pa.array(some, pa.int32()),
                        pa.array([planes(np.diff(h[x], prepend=np.uint64(0))) for x in spans], pa.binary()),
                        pa.array([np.packbits(n[x] > 1).tobytes() for x in spans], pa.binary()),
                    ],
                    names=["batch", "bucket", "grams", "twice"],
                )

    return run


def shared_rows(rows: pa.Table) -> pa.Table:
    """A bucket's rows of all batches -> batch, bucket, a bit for each shingle of the row that two documents have."""
    grams = [np.cumsum(unplaned(x.as_py()), dtype=np.uint64) for x in rows["grams"]]
    sizes = [len(x) for x in grams]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(rows["twice"], sizes, strict=True)]
    every, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(place, minlength=len(every))
    total[place[np.concatenate(twice).astype(bool)]] += 1
    shared = total[place] > 1
    at = starts(np.array(sizes, np.int64))
    masks = [shared[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    some = np.array([bool(x.any()) for x in masks])
    out = rows.select(["batch", "bucket"]).filter(pa.array(some))
    return out.append_column("mask", pa.array([np.packbits(x).tobytes() for x, yes in zip(masks, some, strict=True) if yes], pa.binary()))


def post_rows(bits: int):
    """A batch and its answers -> doc_id, n, signature, pos, h of its shared shingles."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        row = {name: batch[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in batch.column_names if name not in ("batch", "sketch")}
        flat, sizes = row["first"].view(np.uint64), row["size"]
        h, place = np.unique(flat, return_inverse=True)
        cuts = np.searchsorted(bucket_of(h, bits), np.arange((1 << bits) + 1))
        shared = np.zeros(len(h), bool)
        for k, mask in zip(answers["bucket"].to_pylist(), answers["mask"], strict=True):
            low, high = cuts[k], cuts[k + 1]
            shared[low:high] = np.unpackbits(np.frombuffer(mask.as_py(), np.uint8), count=high - low)
        at = np.flatnonzero(shared[place])
        doc = np.repeat(np.arange(len(sizes)), sizes)[at]
        pos = (at - starts(sizes)[doc]).astype(np.int32)
        lanes = {f"s{j}": row[f"s{j}"][doc] for j in range(LANES)}
        return pa.table({"doc_id": row["doc_id"][doc], "n": row["n"][doc], **lanes, "pos": pos, "h": row["first"][at]})

    return run


def shared_posts(firsts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, signature, pos, h) of the first shingles that two documents or more have; rows (doc_id, n, sketch)."""
    packs = scratch.write(firsts.mapInArrow(pack_rows, PACKED), "packs")
    scratch.release()
    grams = packs.agg(F.sum(F.size("first").cast("long")).alias("n")).first().n or 0
    bits = max(6, (4 * grams // GRAMS).bit_length())
    ranges = packs.select("batch", "first").mapInArrow(range_rows(bits), "batch long, bucket int, grams binary, twice binary")
    answers = ranges.groupBy("bucket").applyInArrow(shared_rows, "batch long, bucket int, mask binary")
    lanes = ", ".join(f"s{j} long" for j in range(LANES))
    sketches = scratch.write(packs.select(F.explode(F.arrays_zip("doc_id", "n", "sketch")).alias("x")).select("x.*"), "sketches")
    posts = packs.drop("sketch").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(post_rows(bits), f"doc_id long, n long, {lanes}, pos int, h long")
    posts = scratch.write(posts, "posts")
    scratch.drop(packs)
    scratch.release()
    return posts, sketches


def set_rows(width: int):
    """doc_id, text -> doc_id, whole set by hash."""

    def run(iterator):
        for batch in batches(iterator):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(shingle_sets(batch.column(1), width))], names=["doc_id", "members"])

    return run


def divide_skip(query: np.ndarray, collection: list[np.ndarray], percent: int) -> list[int]:
    """Numbers of the collection's sets that are similar to the query."""
    need = [needed(len(query), len(s), percent) for s in collection]
    least = min(need)
    every = np.concatenate(collection)
    owner = np.repeat(np.arange(len(collection)), [len(s) for s in collection])
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    low, high = np.searchsorted(every, query, "left"), np.searchsorted(every, query, "right")
    found = high > low
    low, high = low[found], high[found]
    by_length = np.argsort(low - high, kind="stable")  # long lists first
    longest = int((high - low).max(initial=1))
    long_lists = min(max(0, least - 1), len(low), int(least / (0.01 * math.log2(longest + 1) + 1)))
    long_at, short_at = by_length[:long_lists], by_length[long_lists:]
    counts: dict[int, int] = {}
    for k in heapq.merge(*[owner[low[i] : high[i]].tolist() for i in short_at]):
        counts[k] = counts.get(k, 0) + 1
    if least <= long_lists:
        counts = {k: counts.get(k, 0) for k in range(len(collection))}
    out = []
    for k, c in counts.items():
        if c >= need[k] - long_lists:
            for i in long_at:
                a, b = low[i], high[i]
                at = a + np.searchsorted(owner[a:b], k) if b - a > 1 else a
                c += at < b and owner[at] == k
            if c >= need[k]:
                out.append(k)
    return out


def search_rows(percent: int):
    """Rows sorted by (query, part, role): the query's own set, then the sets to search. Gives links."""

    def run(iterator):
        key, query, names, sets = None, None, [], []

        def found():
            links = [names[k] for k in divide_skip(query, sets, percent)] if sets else []
            names.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(links), pa.int64()), pa.array(links, pa.int64())], names=["a", "b"])

        for batch in iterator:
            members = batch.column(4)
            if not batch.num_rows:
                continue
            flat, at = members.values.to_numpy(zero_copy_only=False).view(np.uint64), members.offsets.to_numpy()
            for i, (q, part, role, doc) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)):
                mine = flat[at[i] : at[i + 1]].copy()
                if role == 0:
                    if sets:
                        yield found()
                    key, query = (q, part), mine
                else:
                    names.append(doc)
                    sets.append(mine)
                    if len(sets) == COLLECTION:
                        yield found()
        if sets:
            yield found()

    return run


def close_rows(percent: int):
    """q, b, their sizes and sketches -> the pairs whose sketches don't differ too much."""

    def run(iterator):
        for batch in iterator:
            kept = []
            for m, n, x, y in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                longs = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum())
                kept.append(differ <= m + n - 2 * needed(m, n, percent))
            yield batch.select(["q", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (q, b) that are similar, as links (a, b).

    Pairs whose sketches differ too much go first. Then q's set meets those of its partners
    b, in parts of about COLLECTION partners, so that it travels once a part. Whole sets are
    made of the documents in these pairs only.
    """
    pairs = pairs.join(sketches.toDF("q", "m", "x"), "q").join(sketches.toDF("b", "n", "y"), "b").select("q", "b", "m", "n", "x", "y")
    pairs = scratch.write(pairs.mapInArrow(close_rows(percent), "q long, b long").distinct(), "close")
    scratch.release()
    ids = pairs.select(F.explode(F.array("q", "b")).alias("doc_id")).distinct()
    ids = scratch.write(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= NAMED else ids
    sets = scratch.write(texts.join(ids, "doc_id", "left_semi").mapInArrow(set_rows(width), "doc_id long, members array<long>"), "sets")
    many = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / COLLECTION).alias("parts")).filter("parts > 1")
    pairs = pairs.join(many, "q", "left").select("q", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    own = pairs.select("q", "part").distinct().join(sets.withColumnRenamed("doc_id", "q"), "q").select("q", "part", F.lit(0).alias("role"), F.col("q").alias("doc"), "members")
    other = pairs.join(sets.withColumnRenamed("doc_id", "b"), "b").select("q", "part", F.lit(1).alias("role"), F.col("b").alias("doc"), "members")
    rows = own.unionByName(other).repartition("q", "part").sortWithinPartitions("q", "part", "role")
    links = scratch.write(rows.mapInArrow(search_rows(percent), "a long, b long"), "links")
    scratch.drop(sets)
    scratch.release()
    return links


def frequent_bits(every: DataFrame) -> bytes:
    """The bit map of frequent shingles, from the counts of all tasks; its size is fixed."""
    total = every.agg(F.sum("n").alias("n")).first().n or 0
    counts = every.filter("slice is not null").select("slice", "counts").repartition(MAP_BITS // SLICE, "slice")
    rows = counts.mapInArrow(slice_bits(FREQUENT + LOAD * total / MAP_BITS), "slice int, bits binary").collect()
    out = bytearray(MAP_BITS // 8)
    for r in rows:
        out[r.slice * SLICE // 8 : (r.slice + 1) * SLICE // 8] = r.bits
    return bytes(out)


def ngram_jaccard(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    if distinct_texts_share(docs):
        return scratch.finish(by_rows(docs, percent, width, scratch))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = scratch.write(texts.mapInArrow(class_rows(width), "doc_id long, n long, one long, two long, slice int, counts binary"), "every")
    rows = every.filter("slice is null").select("doc_id", "n", "one", "two")
    classes = scratch.write(rows.filter("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep")), "classes")
    bits = frequent_bits(every)
    scratch.release()
    lanes = [f"s{k}" for k in range(LANES)]
    firsts = texts.mapInArrow(first_rows(percent, width, bits), f"doc_id long, n long, first array<long>, sketch binary, {', '.join(f'{s} long' for s in lanes)}")
    posts, sketches = shared_posts(firsts.filter("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), scratch)
    posts = posts.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))))
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    can = (F.least("n", "n2") >= need) & (1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1) >= need)
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(LANES)), F.lit(0))
    can &= differ <= F.col("n") + F.col("n2") - 2 * need
    tried = known = None
    named = posts.withColumn("component", F.col("doc_id"))
    for k in range(ROUNDS):  # each with the documents that come first in another order
        first = F.struct(F.xxhash64("doc_id", F.lit(k)).alias("key"), "doc_id", "n", "pos", "component", *lanes)
        heads = named.groupBy("h", "band").agg(F.min(first).alias("head"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        star = named.join(heads.select("h", "band", F.col("head.doc_id").alias("a"), F.col("head.n").alias("n2"), F.col("head.pos").alias("pos2"), F.col("head.component").alias("c2"), *[F.col(f"head.s{j}").alias(f"t{j}") for j in range(LANES)]), ["h", "band"])
        star = star.filter(F.col("component") != F.col("c2")).filter(can).select(F.col("a").alias("q"), F.col("doc_id").alias("b"))
        star = star.groupBy(F.least("q", "b").alias("low"), F.greatest("q", "b").alias("high")).agg(F.min(F.struct("q", "b")).alias("pair")).select("low", "high", "pair.q", "pair.b")
        if tried is not None:
            star = star.join(tried, ["low", "high"], "left_anti")
        star = scratch.write(star, "star")
        links = verified(star.select("q", "b"), texts, sketches, percent, width, scratch)
        star = star.select("low", "high")
        tried = star if tried is None else tried.unionByName(star)
        links = links if known is None else links.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        known = scratch.write(components(links, scratch), "known")
        scratch.release()
        named = posts.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("h")
    named = scratch.write(named.join(mixed, "h", "left_semi").select("h", "doc_id", "n", "pos", "component", *lanes), "named")
    other = named.select("h", F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("c2"), *[F.col(f"s{j}").alias(f"t{j}") for j in range(LANES)])
    rest = named.join(other, "h").filter((F.col("doc_id") < F.col("b")) & (F.col("component") != F.col("c2"))).filter(can)
    rest = rest.select(F.col("doc_id").alias("low"), F.col("b").alias("high")).distinct().join(tried, ["low", "high"], "left_anti")
    rest = scratch.write(rest.select(F.col("low").alias("q"), F.col("high").alias("b")), "rest")
    more = verified(rest, texts, sketches, percent, width, scratch)
    if not more.isEmpty():
        known = scratch.write(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch), "all")
    by_class = classes.select("n", "one", "two", "rep").join(known.select(F.col("node").alias("rep"), F.col("component").alias("found")), "rep", "left")
    by_class = by_class.select("n", "one", "two", F.coalesce("found", "rep").alias("component"))
    out = rows.select("doc_id", "n", "one", "two").join(by_class, ["n", "one", "two"], "left")
    return scratch.finish(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def distinct_texts_share(docs: DataFrame) -> bool:
    """Whether different texts have one doc_id."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    text = F.xxhash64("text")
    return not ids.agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low < high").isEmpty()


def by_rows(docs: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """``ngram_jaccard`` of a table in which different texts have one doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.write(rows.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("row")), "rows")
    found = ngram_jaccard(rows.select(F.col("row").alias("doc_id"), "text"), percent, width)
    found = scratch.write(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part")).distinct(), "found")
    named = scratch.write(rows.select("doc_id", "row").join(found.filter("row is not null"), "row", "left"), "named")
    parts = named.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("low"))
    links = named.filter("part is not null").select("doc_id", "part").distinct().join(parts, "part").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    whole = components(links, scratch)
    out = named.join(whole.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    unnamed = docs.filter(F.col("doc_id").isNull()).select("text").mapInArrow(size_rows(width), "n_shingles long")
    out = out.filter("doc_id is not null").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(unnamed.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def size_rows(width: int):
    """text -> size of its set."""

    def run(iterator):
        for batch in batches(iterator):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(batch.column(0), width)], pa.int64())], names=["n_shingles"])

    return run


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with its columns as they were: that with the smallest doc_id, null last.

    Rows are told apart by doc_id and text together, so that rows of a null or a repeated
    doc_id are each searched with their own text; documents without a word all stay.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    texts = keyed.select(F.col(row).alias("row"), "doc_id", "text")
    found = ngram_jaccard(texts.select(F.col("row").alias("doc_id"), "text"), **options).filter("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("row"), "component_id").distinct()
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    found = found.join(several, "component_id", "left_semi").join(texts.select("row", "doc_id").distinct(), "row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    kept = found.groupBy("component_id").agg(F.min(order).alias("kept")).select(F.col("kept.row").alias("row"))
    gone = scratch.finish(found.select("row").join(kept, "row", "left_anti"))
    rows = keyed.join(gone.withColumnRenamed("row", row), row, "left_anti")
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return rows.filter(worded).dropDuplicates([row]).unionByName(rows.filter(~worded)).select(*docs.columns)


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(load(spark, sf_dir, "documents"))
