"""Language-model scores of documents by stupid backoff, computed relationally.

Each document is scored against all others: its own counts are taken off first. A word
after another scores ln(c(a b) / c(a)) where other documents have the bigram, else
ln(0.4 * c(b) / N), and ln(0.4 / N) where none has the word; a document's first word
counts as unseen after its (missing) predecessor. A document's score is the mean over its
words.

Documents are dealt by hash to blocks of about BLOCK bytes. A block's n-grams (of two, one
and no words; the last gives N) are counted within the block and then over all, in count
tables partitioned by hash: a row holds one block's n-grams and counts within one range of
hashes (a bucket), so the most frequent n-gram has an entry a block, not a row a document.
Within a row n-grams are sorted and stored as differences, byte plane by byte plane, which
the shuffle's own compression shortens. A bucket answers each block with what the other
blocks count, in the order of the block's own row, so that no n-gram travels back; rows
without a count elsewhere are left out. There the totals meet the exploded n-grams of each
document, whose own counts are taken off, and are summed by document.

Null or white text has no words and a null score; equal texts are documents of their own
and score each other's bigrams. Rows with one doc_id are scored as one document's parts.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch, bucket_of, load, mix, planes, starts, unplaned, utf8, words

ALPHA = 0.4
#: Bytes of text in a block; bounds a worker's memory.
BLOCK = 8 << 20
#: Words scored at once, but for a longer document, which is scored whole.
WORDS = 1 << 18
FOLD = np.uint64(0xA24BAED4963EE407)
ONE = np.uint64(0x9FB21C651E98DF25)


def grams_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and bigrams (0 for a text's first word) at each position, the position's text, words a text."""
    hashes, counts = words(*utf8(column))
    heads = starts(counts)[:-1][counts > 0]
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])[: len(hashes)]
    two = mix(before * FOLD + hashes)
    two[heads] = 0
    return mix(hashes ^ ONE), two, np.repeat(np.arange(len(counts)), counts), counts


def counted(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's sorted n-grams and their counts.

    The empty n-gram is 0, the first, and counts all words; a text's first word has it for a bigram.
    """
    g, n = np.unique(np.concatenate([one, two]), return_counts=True)
    if len(g):
        n[0] = len(one)
    return g, n


def count_rows(bits: int):
    """A block's documents -> block, bucket, differences of its n-grams there, their counts."""

    def run(docs: pa.Table) -> pa.Table:
        one, two, _, _ = grams_of(docs["text"])
        g, n = counted(one, two)
        cuts = np.searchsorted(bucket_of(g, bits), np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(cuts))
        parts = [(g[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]) for k in some]
        return pa.table({
            "block": pa.array(np.full(len(some), docs["block"][0].as_py(), np.int32)),
            "bucket": pa.array(some, pa.int32()),
            "grams": pa.array([planes(np.diff(x, prepend=np.uint64(0))) for x, _ in parts], pa.binary()),
            "n": pa.array([planes(x) for _, x in parts], pa.binary()),
        })

    return run


def other_rows(rows: pa.Table) -> pa.Table:
    """A bucket's rows of all blocks -> block, bucket, counts of the other blocks in the order of the block's row."""
    grams = [np.cumsum(unplaned(x.as_py()), dtype=np.uint64) for x in rows["grams"]]
    n = [unplaned(x.as_py()).astype(np.int64) for x in rows["n"]]
    every, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, place, np.concatenate(n))
    at = starts(np.array([len(x) for x in grams], np.int64))
    other = [total[place[a:b]] - x for a, b, x in zip(at[:-1], at[1:], n, strict=True)]
    some = np.array([bool(x.any()) for x in other])
    out = rows.select(["block", "bucket"]).filter(pa.array(some))
    return out.append_column("other", pa.array([planes(x) for x, yes in zip(other, some, strict=True) if yes], pa.binary()))


def run_scores(alpha: float, g: np.ndarray, total: np.ndarray, one: np.ndarray, two: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of scores of some of a block's documents; ``size`` counts the words that others have."""
    place = np.searchsorted(g, np.concatenate([one, two]))
    _, mine, often = np.unique(np.tile(text, 2) * len(g) + place, return_inverse=True, return_counts=True)
    rest = (total[place] - often[mine]).astype(np.float64)
    word, pair = rest[: len(one)], rest[len(one) :]
    seen = (two != 0) & (pair > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        backed = np.log(alpha * np.maximum(word, 1) / np.maximum(size[text], 1))
        score = np.where(seen, np.log(pair / np.concatenate([np.ones(1), word[:-1]])[: len(word)]), backed)
    return np.bincount(text, weights=score, minlength=len(size))


def block_scores(alpha: float, bits: int):
    """A block's documents and the other blocks' counts -> doc_id, n_words, sum of scores."""

    def run(docs: pa.Table, others: pa.Table) -> pa.Table:
        one, two, text, counts = grams_of(docs["text"])
        g, total = counted(one, two)
        cuts = np.searchsorted(g, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(g)]
        for k, other in zip(others["bucket"].to_pylist(), others["other"], strict=True):
            low, high = cuts[k : k + 2]
            total[low:high] += unplaned(other.as_py()).astype(np.int64)
        size = (total[0] if len(g) else 0) - counts
        at, low, sums = starts(counts), 0, np.zeros(len(counts))
        while low < len(counts):
            high = max(low + 1, int(np.searchsorted(at, at[low] + WORDS, "right")) - 1)
            here = slice(at[low], at[high])
            sums[low:high] = run_scores(alpha, g, total, one[here], two[here], text[here] - low, size[low:high])
            low = high
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(counts, pa.int64()), "total": pa.array(sums, pa.float64())})

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, score."""
    scratch = Scratch(docs.sparkSession, "scoring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0) // BLOCK))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    texts = texts.repartition(max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")  # one exchange, used twice
    bits = max(6, (4 * blocks - 1).bit_length())
    grams = texts.groupBy("block").applyInArrow(count_rows(bits), "block int, bucket int, grams binary, n binary")
    others = grams.groupBy("bucket").applyInArrow(other_rows, "block int, bucket int, other binary")
    parts = texts.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(block_scores(alpha, bits), "doc_id long, n_words long, total double")
    scores = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(scores, "doc_id", "left")
    score = F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words"), 6))
    return scratch.finish(out.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), score.alias("score")))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return backoff_scores(load(spark, sf_dir, "documents"))


SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS b, unnest(range(len(w))) AS i FROM l),
p AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM t),
u AS (SELECT doc_id, b, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT b, sum(n) AS k FROM u GROUP BY b),
g AS (SELECT doc_id, a, b, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT a, b, sum(n) AS c FROM g WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS size FROM u GROUP BY doc_id),
r AS (
  SELECT g.doc_id, g.n, s.size, c.c - g.n AS both_n, ka.k - ua.n AS ca, kb.k - ub.n AS cb
  FROM g JOIN s USING (doc_id) LEFT JOIN c ON c.a = g.a AND c.b = g.b
  LEFT JOIN k ka ON ka.b = g.a LEFT JOIN u ua ON ua.doc_id = g.doc_id AND ua.b = g.a
  JOIN k kb ON kb.b = g.b JOIN u ub ON ub.doc_id = g.doc_id AND ub.b = g.b),
o AS (
  SELECT doc_id, sum(n) AS n_words, sum(n * CASE WHEN both_n > 0 THEN ln(both_n / ca)
    ELSE ln(0.4::DOUBLE * greatest(cb, 1) / greatest((SELECT sum(n) FROM u) - size, 1)) END) / sum(n) AS score
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, round(score, 6) AS score
FROM documents d LEFT JOIN o USING (doc_id)
"""
