"""Brute force on small fixtures, and nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyline.llm import html, itq, jaccard, langid, licenses, mixing, packing, suffix, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, key string, text2 string"
WORDS = "ash birch cedar elm fir hazel holly larch lime maple oak pine rowan spruce willow yew".split()


def make(spark, texts, sources=None):
    rows = [(i, t, "en" if i % 2 else "de", (sources or ["a", "b", None])[i % 3], None, 7, 7, "k", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n)) for n in (120, 90, 60, 200, 3, 4, 5, 1)]
    near = base[0].split(" ")
    near[7] = "changed"
    return [*base, " ".join(near), base[1], base[1] + " tail", None, "", "  \n\t ", "é" * 130 + base[2] + "é" * 130, "ha " * 200, "x" + base[3][40:900] + "y", "a b c", "A B C", "long " * 30_000]


def test_suffix_order():
    rnd = random.Random(1)
    for _ in range(300):
        s = [rnd.randint(1, rnd.choice([2, 3, 9])) for _ in range(rnd.randint(1, 50))] + [0]
        assert suffix.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts, width=200):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - width + 1):
            seen[r[i : i + width]] = seen.get(r[i : i + width], 0) + 1
    out = []
    for r in raws:
        cover = [False] * len(r)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                cover[i : i + width] = [True] * width
        kept = bytes(b for b, c in zip(r, cover) if not c)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(r), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1024, 1])
def test_suffix_dedup(spark, texts, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST", most)
    short = [t for t in texts if t is None or len(t) < 20_000]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.suffix_dedup(make(spark, short)).collect()}
    assert [got[i] for i in range(len(short))] == brute_repeats(short)


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return [(len(s), c) for s, c in zip(sets, comp)]


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(make(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    rows = packing.pack(make(spark, texts), path).collect()
    ids = {i: Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    room = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= packing.CAPACITY


def test_mixing(spark, texts):
    rows = mixing.mix_sources(make(spark, texts)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for i, t in enumerate(texts):
        per.setdefault(["a", "b", None][i % 3], []).append(size(t))
    names = ["a", "b", None]
    weight, room, target = [3.0, 1.0, 2.0], 1.5 * sum(map(size, texts)), {}
    left = list(range(3))
    while left:
        share = {k: room * weight[k] / sum(weight[j] for j in left) for k in left}
        over = [k for k in left if share[k] > 2 * sum(per[names[k]])]
        for k in over or left:
            target[k] = 2.0 * sum(per[names[k]]) if over else share[k]
            room -= target[k] if over else 0
        left = [k for k in left if k not in over] if over else []
    taken = {}
    for r in rows:
        k = r.doc_id % 3
        assert r.size == size(texts[r.doc_id]) and abs(r.target - target[k]) < 1e-6 and r.taken <= 2 * r.size
        taken[k] = taken.get(k, 0) + r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)


def test_topk_and_itq(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((300, 16)).round(1)
    x[50:90] = x[7] + rnd.standard_normal((40, 16)) * 0.05
    x[100:120] = x[9]
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    rows += [(300, None, 1), (301, [float("nan")] * 16, 1), (302, [0.0] * 16, 1), (303, [], 0), (304, [1.0] * 16, None), (305, [None] * 16, 0)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in topk.top_k(topk.whole_vectors(emb), F.col("vec_id") % 50 == 0).collect())
    w = {i: np.floor(256 * np.array(v)) for i, v, _ in rows if i < 300 or i in (302, 304)}
    want = []
    for q in w:
        if q % 50 == 0:
            best = sorted((-int(w[q] @ w[i]), i) for i in w if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    u = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[:300]}
    out = {r.vec_id: r for r in itq.near_duplicates(emb).collect()}
    links = {i: [j for j in u if j != i and j % 3 == i % 3 and u[i] @ u[j] >= 0.98] for i in u}
    found = sum(out[i].n_links for i in u)
    assert found >= 0.9 * sum(map(len, links.values())) and all(out[i].n_links <= len(links[i]) for i in u)
    assert all(out[i].n_links == 0 and out[i].kept for i in range(300, 306))


def test_langid(spark):
    en, de = "the cat sat on the mat and then went over there".split(), "der hund und die katze gehen über straße ich nicht".split()
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices((en, de)[i % 2], k=30)), ("en", "de")[i % 2]) for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 --", "en"), (203, "the mat " * 20_000, None), (204, "字" * 400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, ~langid.held_out()).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] and 0 <= got[i].score <= 1 for i in range(120))
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (200, 201, 202))
    assert got[203].lang_pred == "en" and got[204].rejected and not any(got[i].rejected for i in range(120))


def test_langid_limits():
    rnd = np.random.default_rng(4)
    langs = ["a"] * 200 + ["b"] * 200 + ["c"] * 3
    model = type("M", (), {"langs": ["a", "b", "c", "d"]})
    entropies = rnd.normal(2.0, 0.05, (len(langs), 4))
    entropies[0, 0] = 30.0  # one junk document under a label
    cal = langid.Calibration(model, entropies, np.full(len(langs), 400, np.int64), langs)
    letters = np.full(4, 400, np.int64)
    assert cal.rejects(np.arange(4), np.full(4, 4.0), letters).all()  # languages of few or no calibration documents too
    assert not cal.rejects(np.arange(4), np.full(4, 2.1), letters).any()
    fresh = rnd.normal(2.0, 0.05, 5000)
    assert cal.rejects(np.zeros(5000, int), fresh, np.full(5000, 400, np.int64)).mean() <= 0.02


def test_licenses(spark):
    texts = ["Intro\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", None, "", "word", "We like the license plate of this car."]
    got = {(r.doc_id, r.license, r.kind) for r in licenses.scan(make(spark, texts)).collect()}
    # the three lines of document 0 have six bigrams, four of them the statement's: 2 * 4 / (6 + 4) = 0.8
    assert got == {(0, "MIT", "line"), (0, "MIT", "paragraph"), (1, "Apache-2.0", "line")}


def test_html(spark):
    page = "<html><body><nav><ul><li>Home {0}</li></ul></nav><div class='ad'>Buy</div><article><h1>T{0}</h1><p><b>One &amp; {0}<br><p>Two\n  words</p><div class=\"comments\"><p>hi</p></div></article><footer>f</footer>"
    rows = [(i, "http://h.example/x" if i < 4 else None, page.format(i)) for i in range(5)] + [(5, "http://h.example/", None), (6, "http://h.example/", ""), (7, "u", "<p>a<p>b")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"T{i}\nOne & {i}\nTwo words" for i in range(5)]
    assert got[5] == got[6] == "" and got[7] == "a\nb"


def extracted(spark, pages):
    rows = [(i, "http://h.example/x", p) for i, p in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).orderBy("page_id").collect()]


def test_html_keeps_all_varying_text(spark):
    page = "<body><div class=top><p>Site</div><div class=page><h1>T{0}</h1><div class=summary>S{0}</div><div class=body><p>{1}<p>and {1}</div></div>"
    long = ["many words of text " * 20 + str(i) for i in range(4)]
    assert extracted(spark, [page.format(i, x) for i, x in enumerate(long)]) == [f"T{i}\nS{i}\n{x}\nand {x}" for i, x in enumerate(long)]
    # a part that only one page has is not known to be template; an article does not hide what varies beside it
    page = "<body><div class=top><p>Site</div><div class=page>{1}<article><p>A{0}</article></div>"
    assert extracted(spark, [page.format(i, "<div class=summary>S</div>" if i == 2 else "") for i in range(4)]) == ["A0", "A1", "S\nA2", "A3"]


def test_html_long_template_and_unique_ids(spark):
    legal = "terms and conditions of this host " * 20
    page = "<body><div class=legal>" + legal + "{0}</div><div class=body><p>B{1}</p></div>"
    assert extracted(spark, [page.format("", i) for i in range(4)]) == [f"B{i}" for i in range(4)]
    assert extracted(spark, [page.format(i, i) for i in range(4)]) == [f"{legal}{i}\nB{i}" for i in range(4)]
    # more page-unique siblings than a wrapper node keeps apart
    page = "<body><div class=wrap>" + "".join(f"<section id=x{j}-{{0}}>S{{0}}-{j}</section>" for j in range(5)) + "<div class=body><p>B{0}</div></div>"
    want = ["\n".join([*[f"S{i}-{j}" for j in range(5)], f"B{i}"]) for i in range(40)]
    assert extracted(spark, [page.format(i) for i in range(40)]) == want
    root = None
    for i in range(200):
        tree = html.digested(html.shape(html.parse(f"<body><div class=a><div id=post-{i}><p>X{i}</div><section class=same><p>Y{i}</section></div>")))
        root = tree if root is None else html.merge(root, tree)
    inner = root[3][0][3][0][3]
    assert len(inner) <= html.FANOUT + 2 and sum(x[2] for x in inner) == 400 and "section same" in [x[0] for x in inner]


def test_html_drops_template_and_keeps_slots(spark):
    page = "<body><article><h1>T{0}</h1><div class=x7>Buy <b>now</b></div><section id=discussion><p>D{0}</section><div class=side-effects>E{0}</div><div class=notice>N</div><p>A{0}<div class=ad>ad{0}</div></article>"
    assert extracted(spark, [page.format(i) for i in range(6)]) == [f"T{i}\nD{i}\nE{i}\nA{i}" for i in range(6)]


def test_null_and_repeated_ids_stay(spark):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(60)) for _ in range(6)]
    rows = [(None, base[0]), (None, base[1]), (7, base[2]), (7, base[3]), (9, base[4]), (8, base[4]), (None, base[4]), (None, base[5]), (None, base[5]), (None, ""), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 1, 1, "k", "x") for i, t in rows], DOC)
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_of_each(docs).collect()), key=repr)
    assert got == sorted([(None, base[0]), (None, base[1]), (7, base[2]), (7, base[3]), (8, base[4]), (None, base[5]), (None, ""), (None, None), (3, "")], key=repr)
    read = [(r.doc_id, r.text) for r in mixing.mixed_documents(docs, share=2.0).collect()]
    assert sorted(read, key=repr) == sorted([r for r in rows if r[1]] * 2, key=repr)


def test_empty_tables(spark):
    docs = make(spark, ["x"]).filter("doc_id < 0")
    for f in (suffix.suffix_dedup, jaccard.ngram_jaccard, mixing.mix_sources, licenses.scan, mixing.mixed_documents, suffix.without_repeats, jaccard.keep_one_of_each, langid.keep_identified):
        assert f(docs).count() == 0
    assert packing.pack(docs, packing.tokenizer_path()).count() == 0
    assert langid.identify(docs, F.lit(True)).count() == 0
    emb = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq.near_duplicates(emb).count() == 0 and topk.top_k(topk.whole_vectors(emb), F.lit(True)).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_rows(spark):
    docs = make(spark, ["one two three four five six " * 12] * 2)
    docs = docs.unionByName(docs)
    assert {tuple(r) for r in jaccard.ngram_jaccard(docs).select("doc_id", "component_id").collect()} == {(0, 0), (1, 0)}
    assert all(r.n_removed == r.n_bytes for r in suffix.suffix_dedup(docs).collect())
