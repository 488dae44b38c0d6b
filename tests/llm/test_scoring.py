"""Stupid backoff against a plain count of n-grams."""

import math
import re
from collections import Counter

import pytest

from rallyline.llm import scoring

SCHEMA = "doc_id long, text string, g long, n long, block string"
TEXTS = ["the cat sat on the mat", "the cat ran", "a cat sat", "THE  cat\tsat on", "the cat ran", "odd", "", " \n", None, "la " * 3000 + "the cat"]


def brute(texts):
    split = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) for t in texts]
    one = Counter(w for s in split for w in s)
    two = Counter(p for s in split for p in zip(s, s[1:]))
    total = sum(one.values())
    for s in split:
        own, pairs, score = Counter(s), Counter(zip(s, s[1:])), 0.0
        for i, w in enumerate(s):
            p = (s[i - 1], w) if i else None
            if p and two[p] > pairs[p]:
                score += math.log((two[p] - pairs[p]) / (one[p[0]] - own[p[0]]))
            else:
                score += math.log(0.4 * max(one[w] - own[w], 1) / max(total - len(s), 1))
        yield len(s), round(score / len(s), 6) if s else None


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK", block)
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: (r.n_words, r.score) for r in scoring.backoff_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = dict(enumerate(brute(TEXTS)))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (n, score) in want.items():
        assert (got[k][1] is None) if score is None else got[k][1] == pytest.approx(score, abs=2e-6)


def test_empty_and_null_ids(spark):
    assert scoring.backoff_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    got = scoring.backoff_scores(spark.createDataFrame([(None, "a b", 1, 1, "x"), (1, None, 1, 1, "x"), (2, "a b", 1, 1, None)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 0), (1, 0), (2, 2)]
