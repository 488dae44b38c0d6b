"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and every run of non-letters becomes one space. A model of order
four is counted per language on a bounded, hash-chosen sample of labelled documents
(``per_lang`` documents a language, ``most_langs`` languages at most); counting is a
distributed aggregation. All probabilities are worked out beforehand and stored in
sorted arrays of n-gram hashes, a row of log-probabilities (one per language) beside
each, so that one binary search serves every language. Every text is scored whole, by
the lowest mean cross-entropy per character.

A part of the sample (one document in five) is kept from the counts and calibrates both
the temperature that turns cross-entropies into a score in [0, 1] and, for each language, the
cross-entropy beyond which a text is rejected as none of the languages: that which the share
FALSE_REJECTION of the language's own calibration documents exceeds. A language with fewer
than ENOUGH of them takes the limit of all languages' together, and one with fewer than
five the spread (and, with none, the mean) of the others. With no language of five nothing is rejected.

Null text and text without a letter give ``und`` with score 0 and are rejected. With no
labelled document at all every text is ``und``; nothing can be told of it, so that a
filter by language then keeps every document. Ties go to the language first in order.
Repeated rows are scored alike; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rallyline.llm._base import batches, hand_little, load, mix

ORDER = 4
PER_LANG = 1000
MOST_LANGS = 256
UNKNOWN = "und"
#: Share of a learned language's documents that its limit may reject.
FALSE_REJECTION = 0.01
#: Calibration documents from which on a language has a limit of its own.
ENOUGH = 100
#: Symbols scored at once, and bytes of text taken at once; bound a worker's memory.
PIECE = 1 << 17
BATCH = 1 << 20

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _LETTER.append(table)
    return _LETTER[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each character (0 before a text begins), its text's number, letters per text.

    Characters beyond the basic plane are folded into 16 bits.
    """
    lowered = [(t or "").lower().replace("\x00", " ") for t in texts]
    points = np.frombuffer(("\x00\x00\x00" + "\x00\x00\x00".join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 3 for t in lowered], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    pad = points == 0
    letter = letters()[points]
    code = np.where(letter, (points ^ (points >> np.uint32(16))) & np.uint32(0xFFFF), np.uint32(32))
    code[pad] = 0
    keep = letter | pad
    keep[1:] |= letter[:-1]
    count = np.bincount(doc[letter], minlength=len(texts))
    return code[keep].astype(np.uint64), doc[keep], count


def grams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Key of the n-gram ending at each symbol: 16 bits a symbol, the last one lowest."""
    key = code.copy()
    for back in range(1, order):
        key[back:] |= code[:-back] << np.uint64(16 * back)
    return key


def count_grams(iterator):
    """(part, lang, key, n) of sample documents; part 0 trains, the texts of part 1 calibrate."""
    for batch in iterator:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for at in range(0, len(mine), 64):
                code, _, _ = symbols(mine[at : at + 64])
                if len(code):
                    keys, n = np.unique(grams(code)[code > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])


class Table:
    """Sorted hashes of keys, with a row of values for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(keys), bool)


def low(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


class Model:
    """Log-probabilities of n-grams under each language, and of backing off from contexts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        self.langs, self.order = sorted(counts), order
        per = {x: {order: counts[x]} for x in self.langs}
        for x in self.langs:
            for n in range(order - 1, 0, -1):  # continuation counts
                keys, _ = per[x][n + 1]
                per[x][n] = np.unique(keys & low(n), return_counts=True)
        alphabet = max(2, len(np.unique(np.concatenate([per[x][1][0] for x in self.langs]))))
        self.floor = -np.log(alphabet + 1.0)
        self.grams: dict[int, Table] = {}
        self.backoff: dict[int, Table] = {}
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([per[x][n][0] for x in self.langs]))
            contexts = np.unique(keys >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
            direct = np.zeros((len(keys), len(self.langs)))
            weight = np.ones((len(contexts), len(self.langs)))
            for k, x in enumerate(self.langs):
                own, c = per[x][n]
                if not len(own):
                    continue
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                at = np.searchsorted(contexts, own >> np.uint64(16)) if n > 1 else np.zeros(len(own), np.int64)
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                weight[seen, k] = discount * kinds[seen] / total[seen]
                direct[np.searchsorted(keys, own), k] = np.maximum(c - discount, 0) / total[at]
            lower = np.full((len(keys), len(self.langs)), 1.0 / (alphabet + 1)) if n == 1 else np.exp(self.score(keys & low(n - 1), n - 1))
            at = np.searchsorted(contexts, keys >> np.uint64(16)) if n > 1 else np.zeros(len(keys), np.int64)
            self.backoff[n] = Table(contexts, np.log(np.maximum(weight, 1e-12)))
            self.grams[n] = Table(keys, np.log(np.maximum(direct + weight[at] * lower, 1e-30)))

    def score(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log-probability of the last symbol of each key given the n - 1 before it, by language."""
        if n == 0:
            return np.full((len(keys), len(self.langs)), self.floor)
        table = self.grams[n]
        at, found = table.find(keys)
        out = table.values[at] if len(table.values) else np.zeros((len(keys), len(self.langs)))
        if not found.all():
            missing = keys[~found]
            back = self.backoff[n]
            where, known = back.find(missing >> np.uint64(16) if n > 1 else np.zeros(len(missing), np.uint64))
            out[~found] = np.where(known[:, None], back.values[where], 0.0) + self.score(missing & low(n - 1), n - 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean cross-entropy per symbol of each text by language, and its letters."""
        total = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts), np.int64)
        code, doc, count = symbols(texts)
        for at in range(0, len(code), PIECE):
            first = max(0, at - self.order + 1)
            real = code[at : at + PIECE] > 0
            keys = grams(code[first : at + PIECE], self.order)[at - first :][real]
            if not len(keys):
                continue
            mine = doc[at : at + PIECE][real]
            begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            total[mine[begin]] -= np.add.reduceat(self.score(keys, self.order), begin, axis=0)
            size[mine[begin]] += np.diff(np.append(begin, len(mine)))
        return total / np.maximum(size, 1)[:, None], count


class Calibration:
    """Temperature of the score and limits of the cross-entropy, from documents not counted."""

    def __init__(self, model: Model, entropies: np.ndarray, letter_counts: np.ndarray, langs: list[str]) -> None:
        truth = np.array([model.langs.index(x) for x in langs], np.int64)
        ok = letter_counts > 0
        entropies, letter_counts, truth = entropies[ok], letter_counts[ok], truth[ok]
        own = entropies[np.arange(len(truth)), truth] if len(truth) else np.zeros(0)
        best = (np.inf, 8.0)
        for heat in 2.0 ** np.arange(0, 8):
            if len(truth):
                z = -heat * (entropies - own[:, None])
                top = z.max(axis=1)
                loss = float(np.mean(top + np.log(np.exp(z - top[:, None]).sum(axis=1))))
                best = min(best, (loss, float(heat)))
        self.heat = best[1]
        langs, least = range(len(model.langs)), 4.0
        mine = [own[truth == k] for k in langs]
        size = [0.05 + 1 / np.sqrt(letter_counts[truth == k]) for k in langs]
        self.mean = np.array([np.median(x) if len(x) else np.nan for x in mine])
        self.spread = np.array([max(1e-3, float(np.median(np.abs(mine[k] - self.mean[k]) / size[k]))) if len(mine[k]) >= 5 else np.nan for k in langs])
        if np.isnan(self.spread).all():
            self.mean, self.spread, self.limit = np.full(len(langs), np.inf), np.ones(len(langs)), np.full(len(langs), np.inf)
            return
        known = ~np.isnan(self.spread)
        self.mean = np.where(np.isnan(self.mean), np.median(self.mean[known]), self.mean)
        self.spread = np.where(known, self.spread, np.median(self.spread[known]))
        units = [(mine[k] - self.mean[k]) / size[k] / self.spread[k] for k in langs]
        limit = lambda x: max(least, float(np.quantile(x, 1 - FALSE_REJECTION)))
        pooled = limit(np.concatenate(units))
        self.limit = np.array([limit(x) if len(x) >= ENOUGH else pooled for x in units])

    def rejects(self, best: np.ndarray, entropy: np.ndarray, letter_counts: np.ndarray) -> np.ndarray:
        unit = (entropy - self.mean[best]) / (0.05 + 1 / np.sqrt(np.maximum(letter_counts, 1))) / self.spread[best]
        return (letter_counts == 0) | (unit > self.limit[best])


def train(docs: DataFrame, usable: Column, per_lang: int = PER_LANG) -> tuple[Model, Calibration] | None:
    """Model and calibration from a bounded sample of the labelled documents."""
    spark = docs.sparkSession
    hand_little(spark)
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy("order", "doc_id")
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("order"))
    ids = ids.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= per_lang)
    rows = ids.select("doc_id", "lang", "nth").orderBy("lang", "nth").limit(per_lang * MOST_LANGS).collect()
    if not rows:
        return None
    chosen = spark.createDataFrame([(r.doc_id, r.lang, int(r.nth % 5 == 0)) for r in rows], "doc_id long, lang string, part int")
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    counted = sample.filter("part = 0").select("lang", "text").mapInArrow(count_grams, "lang string, key long, n long")
    table = counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    names, keys, n = table["lang"].to_numpy(zero_copy_only=False), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    counts = {}
    for lang in sorted(set(names.tolist())):
        mine = names == lang
        order = np.argsort(keys[mine])
        counts[lang] = (keys[mine][order], n[mine][order])
    if not counts:
        return None
    model = Model(counts)
    held = sample.filter("part = 1").filter(F.col("lang").isin(model.langs)).select("lang", "text").mapInArrow(
        entropy_rows(model), "lang string, letters long, entropies array<double>"
    ).collect()
    entropies = np.array([r.entropies for r in held]).reshape(len(held), len(model.langs))
    return model, Calibration(model, entropies, np.array([r.letters for r in held], np.int64), [r.lang for r in held])


def entropy_rows(model: Model):
    def run(iterator):
        for batch in batches(iterator, BATCH):
            entropies, count = model.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(entropies.tolist(), pa.list_(pa.float64()))], names=["lang", "letters", "entropies"])

    return run


def predict_rows(trained):
    """doc_id, text -> doc_id, lang_pred, score, cross_entropy, rejected."""

    def run(iterator):
        for batch in batches(iterator, BATCH):
            texts = batch.column(1).to_pylist()
            if trained is None:
                lang, score, best_entropy, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
            else:
                model, calibration = trained.value
                entropies, count = model.entropies(texts)
                best = entropies.argmin(axis=1)
                low_entropy = entropies[np.arange(len(texts)), best]
                z = np.exp(-calibration.heat * (entropies - low_entropy[:, None]))
                known = count > 0
                score = np.where(known, 1 / z.sum(axis=1), 0.0)
                lang = [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                best_entropy = [e if k else None for e, k in zip(low_entropy.tolist(), known.tolist(), strict=True)]
                rejected = calibration.rejects(best, low_entropy, count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(best_entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return run


def identify(docs: DataFrame, usable: Column, per_lang: int = PER_LANG) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score, cross_entropy, rejected."""
    trained = train(docs, usable, per_lang)
    if trained is not None:  # some MB, bounded by the sample
        trained = docs.sparkSession.sparkContext.broadcast(trained)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predict_rows(trained), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def kept_rows(trained, text: int):
    """The rows of whole batches whose text is not rejected."""

    def run(iterator):
        for batch in batches(iterator, BATCH):
            model, calibration = trained.value
            entropies, count = model.entropies(batch.column(text).to_pylist())
            best = entropies.argmin(axis=1)
            rejected = calibration.rejects(best, entropies[np.arange(len(best)), best], count)
            yield batch.filter(pa.array(~rejected))

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns as they were; all where no document has a label."""
    trained = train(docs, ~held_out())
    if trained is None:
        return docs
    trained = docs.sparkSession.sparkContext.broadcast(trained)
    return docs.mapInArrow(kept_rows(trained, docs.columns.index("text")), docs.schema)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = identify(docs, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
