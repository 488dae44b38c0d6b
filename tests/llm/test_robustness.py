"""Clashing columns, repeated rows and ids, long and deep inputs, plain statements of the rules, and the whole pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rallyline.llm import _base, html, itq, jaccard, langid, mixing, packing, suffix, topk

WORDS = "ash birch cedar elm fir hazel holly larch lime maple oak pine rowan spruce willow yew".split()
CLASH = ["_key", "_row", "_spans", "_nth", "_whole", "_used", "_place", "_id", "_size", "_taken", "_position", "passes", "key", "row", "size"]


def docs(spark, texts, ids=None, extra=()):
    rows = [(ids[i] if ids else i, t, ["en", "de"][i % 2], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(extra):
        df = df.withColumn(c, F.lit(k))
    return df


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    make = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 60)) for _ in range(n))
    base = [make(n) for n in (150, 120, 90, 80, 200)]
    near = base[0].split(" ")
    near[3] = "changed"
    passage = make(60)
    return [*base, " ".join(near), base[1], f"{make(40)} {passage} {make(40)}", f"{make(30)} {passage} {make(50)}", None, "", "\n a  b\tc"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_with_clashing_columns(spark, texts, stage):
    df = docs(spark, texts, extra=CLASH)
    out = stage(spark, df, "")
    assert out.columns == df.columns and {r["_key"] for r in out.collect()} <= {0}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_of_empty_tables(spark, texts, stage):
    assert stage(spark, docs(spark, texts).limit(0), "").count() == 0


def test_without_labels_every_document_stays(spark, texts):
    df = docs(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(df).count() == len(texts)
    assert {r.lang_pred for r in langid.identify(df, F.lit(True)).collect()} == {"und"}


def test_one_id_on_different_texts(spark, texts):
    rnd = random.Random(4)
    other = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 60)) for _ in range(70))
    # 1 has two texts: one like 5's, one like 9's; so 1, 5 and 9 belong together
    df = docs(spark, [texts[0], other, texts[5], other + " end", texts[2], None], [1, 1, 5, 9, 12, 1])
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.ngram_jaccard(df).collect()}
    assert {d: c for (d, _), c in got.items()} == {1: 1, 5: 1, 9: 1, 12: 12} and len(got) == 6
    kept = jaccard.keep_one_of_each(docs(spark, [texts[0], other, "lone words of their own here"], [1, 1, 1]))
    assert kept.count() == 3


def test_repeated_rows(spark, texts):
    twice = docs(spark, texts[:3]).unionByName(docs(spark, texts[:3]))
    mix = mixing.mixed_documents(twice)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in mix.collect()) == pytest.approx(1.5 * 2 * sum(map(words, texts[:3])), abs=3)
    assert {r.n_removed for r in suffix.suffix_dedup(twice).collect()} == {len(t) for t in texts[:3]}
    pieces = packing.pack(twice, packing.tokenizer_path()).collect()
    per = Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces)
    assert set(per.values()) == {2}
    assert langid.identify(twice, F.lit(True)).count() == 6


def test_cut_texts_keep_their_first_words(spark):
    df = docs(spark, ["\n a  b\tc d e f"] * 1 + ["x " * 50], [1, 2]).withColumn("source", F.col("doc_id").cast("string"))
    cut = mixing.mixed_documents(df, share=0.9, cap=0.5).filter("doc_id = 1").first()
    assert cut.text == "a b c"


def test_long_texts(spark):
    rnd = random.Random(2)
    big = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 9999)) for _ in range(300_000))
    df = docs(spark, [big, big + " end", "short one here"])
    assert {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(df).collect()} == {0: 0, 1: 0, 2: 2}
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.suffix_dedup(df).collect()}
    assert got[0] == (len(big), len(big)) and got[1][1] >= len(big)
    pieces = packing.pack(df, packing.tokenizer_path())
    assert pieces.groupBy("doc_id").agg(F.sum("length") == F.max("doc_tokens")).filter("doc_id < 3").count() == 3


def plain_kneser_ney(counts, order, langs):
    """P(last | before) of interpolated Kneser-Ney, with one discount an order, by definition."""
    alphabet = max(2, len({g[-1] for x in langs for g in counts[x]}))
    models = {}
    for x in langs:
        per = {order: dict(counts[x])}
        for n in range(order - 1, 0, -1):
            per[n] = Counter(g[1:] for g in per[n + 1])
        stats = {}
        for n in per:
            ones, twos = sum(c == 1 for c in per[n].values()), sum(c == 2 for c in per[n].values())
            total, kinds = Counter(), Counter()
            for g, c in per[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            stats[n] = (ones / (ones + 2 * twos) if ones else 0.5, total, kinds)
        models[x] = (per, stats)

    def p(x, gram):
        if not gram:
            return 1 / (alphabet + 1)
        per, stats = models[x]
        discount, total, kinds = stats[len(gram)]
        before = gram[:-1]
        if not total[before]:
            return p(x, gram[1:])
        return max(per[len(gram)].get(gram, 0) - discount, 0) / total[before] + discount * kinds[before] / total[before] * p(x, gram[1:])

    return p


def test_language_models_by_definition():
    rnd = random.Random(9)
    langs = ["aa", "bb"]
    counts = {x: Counter("".join(rnd.choice("abc " if x == "aa" else "abd ") for _ in range(3)) + rnd.choice("abcd") for _ in range(120)) for x in langs}
    arrays = {}
    for x in langs:
        keys = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big") for g in counts[x]], np.uint64)
        order = np.argsort(keys)
        arrays[x] = (keys[order], np.array(list(counts[x].values()), np.int64)[order])
    model, p = langid.Model(arrays), plain_kneser_ney(counts, 4, langs)
    asked = ["".join(rnd.choice("abcd ") for _ in range(4)) for _ in range(300)]
    keys = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big") for g in asked], np.uint64)
    got = np.exp(model.score(keys, 4))
    seen = {x: {g[i] for g in counts[x] for i in (3,)} for x in langs}
    for g, row in zip(asked, got, strict=True):
        for k, x in enumerate(langs):
            if g[-1] in seen["aa"] | seen["bb"]:
                assert row[k] == pytest.approx(p(x, g), rel=1e-6), (g, x)


def test_rejection_of_ties_is_stable():
    # equal models: the first language in order wins
    keys = np.arange(1, 40, dtype=np.uint64)
    model = langid.Model({"b": (keys, np.ones(39, np.int64)), "a": (keys, np.ones(39, np.int64))})
    e, _ = model.entropies(["abc abc"])
    assert model.langs == ["a", "b"] and e[0].argmin() == 0


@pytest.mark.parametrize("size", [4, 16, 64, 128])
def test_itq_finds_links_near_the_threshold(spark, size):
    rng = np.random.default_rng(size)
    base = rng.standard_normal((150, size))
    angle = rng.uniform(0.02, 0.24, (4, 150))
    side = rng.standard_normal((4, 150, size))
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    side -= (side * unit(base)).sum(-1, keepdims=True) * unit(base)
    near = np.cos(angle)[..., None] * unit(base) + np.sin(angle)[..., None] * unit(side)
    v = np.concatenate([unit(base), near.reshape(-1, size)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").withColumn("k", F.lit(1))
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(df).collect()}
    w = unit(v.astype(np.float64))
    want = ((w @ w.T) >= itq.COSINE).sum(1) - 1
    found = sum(min(got[i], want[i]) for i in got)
    assert all(got[i] <= want[i] for i in got) and found >= 0.95 * want.sum() > 100


def test_vectors_with_clashing_columns_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 90, rng.standard_normal(6).tolist(), 0) for i in range(100)] + [(201, rng.standard_normal(3).tolist(), 0), (150, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("v", "d", "size", "code", "weight", "rank", "score", "task", "n")})
    got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and all(r.vec_id != r.query_id for r in got)
    assert itq.near_duplicates(df).count() == len(rows)


def test_lengths_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 1)
    rows = [(i, [float(i % 7), 1.0, 2.0][: 2 + i % 2]) for i in range(0, 100, 5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q, v in rows:
        if q % 50 == 0:
            every = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)))[:3]
            assert got[q] == [(-s, i) for s, i in every]


def page(title, blocks, host="h", extra=""):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f"<html><head><title>x</title></head><body><div class=top><ul><li>Home</li><li>News</li></ul></div><div class=x1><h1>{title}</h1><div class=text>{body}</div>{extra}</div><div class=legal>{'All rights are reserved by the owner of this page. ' * 8}</div></body></html>"


def test_pages_without_article_give_what_varies(spark):
    rnd = random.Random(8)
    want, rows = {}, []
    for i in range(12):
        blocks = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 5))]
        want[i] = "\n".join([f"Title {i}", *blocks])
        rows.append((i, f"http://h.example/{i}", page(f"Title {i}", blocks), 1, "p"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, path string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == want
    again = html.extract(df.unionByName(df))
    assert again.count() == 24 and {r.text for r in again.collect()} == set(want.values())


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "core text" + "</div>" * 3000
    inline = "<article><p>" + "<b>" * 3000 + "bold" + "</b>" * 3000 + "</p></article>"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, "http://a/1", deep), (2, "http://b/1", inline), (3, "http://c/1", long), (4, None, None), (5, "http://d", "<p>open")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "core text" and got[2] == "bold" and got[3].count("\n") == 19_999 and got[4] == "" and got[5] == "open"


def test_fresh_names(spark):
    df = spark.range(1).select(F.col("id").alias("_KEY"), F.col("id").alias("_key_"))
    assert _base.fresh(df, "_key") == "_key__"


def test_pipeline(spark, tmp_path):
    rnd = random.Random(21)
    vocabulary = {"en": "the of and to in that is was for with".split(), "de": "der die und von mit den ist war nicht auch".split()}

    def text(lang, n):
        return " ".join(rnd.choice(vocabulary[lang]) + "".join(rnd.choice("abcdefghijklmnop") for _ in range(2)) for _ in range(n))

    passage = text("en", 70)
    rows = []
    for i in range(240):
        lang = ["en", "de"][i % 2]
        rows.append([i, text(lang, 60), lang, ["a", "b", "c"][i % 3]])
    rows[10][1] = f"{text('en', 60)} {passage} {text('en', 60)}"
    rows[12][1] = f"{text('en', 60)} {passage} {text('en', 60)}"
    rows[20][1] = rows[4][1] + " end"
    rows[30][1] = "漢字仮名 " * 40
    rows[31][1] = "12 34 !!"
    rows[32][1] = None
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stages, now = {}, df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == df.columns
        stages[name] = now.collect()
    first = {r.doc_id for r in stages["language_id"]}
    assert not first & {30, 31, 32} and len(first) >= 0.9 * 237
    second = {r.doc_id for r in stages["ngram_jaccard"]}
    assert second == first - ({20} if {4, 20} <= first else set())
    third = {r.doc_id: r.text for r in stages["suffix_dedup"]}
    assert set(third) == second
    if {10, 12} <= second:
        assert passage not in third[10] and passage not in third[12]
    assert all(third[d] == rows[d][1] for d in second - {10, 12})
    size = lambda t: len(t.split())
    taken = sum(size(r.text) for r in stages["mixing"])
    assert taken == pytest.approx(1.5 * sum(map(size, third.values())), rel=0.01)
    assert all(third[r.doc_id].startswith(r.text[:40]) for r in stages["mixing"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = packing.word_ids(packing.tokenizer_path())
    texts = [r.text for r in stages["mixing"]]
    flat, sizes = ids.texts(pa.array(texts))
    want, at = Counter(), 0
    for n in sizes.tolist():
        want[zlib.crc32(np.append(flat[at : at + n], np.array([1], np.uint32)).astype("<u4").tobytes())] += 1
        at += n
    whole = Counter(r.ids_crc32 for r in pieces if r.start == 0 and r.length == r.doc_tokens)
    assert not whole - want and sum(r.length for r in pieces) == int(sizes.sum()) + len(sizes)
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    _base.Scratch(spark, "test")
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(iterator):
        for batch in _base.batches(iterator, 1 << 30):
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    got = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 40 and max(r.size for r in got) <= _base.HANDED + (2 << 20)
