"""Each query against its SQL over the smallest tables, and hand-worked cases of the operators."""

import hashlib
import itertools
import math
import os
import random
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyline import functions as fn
from rallyline.operators import draws, evaluation, joins, resample, sequence
from rallyline.plans import registry

SF = "/root/testdata/sf0.001"


def plain(rows):
    def one(v):
        if v is None or isinstance(v, (bool, str)):
            return v
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return None if math.isnan(v) else round(float(v), 5) + 0.0
        return v

    return sorted(([one(v) for v in r] for r in rows), key=repr)


def answers(spark, name):
    """A query's rows and, where there is one, its SQL's."""
    con = duckdb.connect()
    con.execute("set threads = 2")
    for t in "events lineitem embeddings conversations".split():
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in registry.SQL:
        return rows, None
    named = ", ".join('"' + c + '"' for c in columns)
    return rows, con.execute(f"select {named} from ({registry.SQL[name]})").fetchall()


@pytest.fixture(scope="module")
def every(spark):
    """All queries, eight at a time."""
    with ThreadPoolExecutor(8) as pool:
        yield {name: pool.submit(answers, spark, name) for name in sorted(registry.QUERIES)}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(every, name):
    rows, want = every[name].result()
    if want is not None:
        assert plain(rows) == plain(want)
    elif name not in MAY_BE_EMPTY:
        assert rows


#: Queries whose rows the smallest tables need not give.
MAY_BE_EMPTY = {"win28_terminal_contact", "win30_31_labelled"}


def one_to_one(found, gold, reach):
    """The best of all order-keeping matchings: (pairs, -error)."""
    best = (0, 0)
    for k in range(1, min(len(gold), len(found)) + 1):
        for a in itertools.combinations(range(len(gold)), k):
            for b in itertools.combinations(range(len(found)), k):
                e = [abs(gold[x] - found[y]) for x, y in zip(a, b, strict=True)]
                if all(v <= reach[x] for v, x in zip(e, a, strict=True)):
                    best = max(best, (k, -sum(e)))
    return best


def test_matching_is_optimal():
    rnd = random.Random(5)
    for _ in range(200):
        gold, found = (sorted(rnd.sample(range(40), rnd.randint(1, 5))) for _ in range(2))
        reach = [rnd.randint(0, 8) for _ in gold]
        pairs = joins.solve_matching(found, gold, reach)
        errors = [abs(found[i] - gold[j]) for i, j in pairs]
        assert all(e <= reach[j] for e, (_, j) in zip(errors, pairs, strict=True)) and pairs == sorted(pairs)
        assert (len(pairs), -sum(errors)) == one_to_one(found, gold, reach)


def test_small_parts_match_as_large_ones(monkeypatch):
    rnd = random.Random(8)
    cases = []
    for _ in range(200):
        gold, found = (sorted(rnd.choices(range(30), k=rnd.randint(0, 8))) for _ in range(2))
        cases.append((found, gold, [rnd.randint(0, 8) for _ in gold]))
    small = [joins.solve_small(*c) for c in cases]
    monkeypatch.setattr(joins, "SMALL", -1)
    assert small == [joins.solve_matching(*c) for c in cases]


def test_parts_are_solved_in_batches(spark):
    # one call of Python for many parts, not one each
    rows = [("v", k, 100 * k + k % 3) for k in range(50)]
    c = spark.createDataFrame(rows, "video string, event_id long, candidate_frame long")
    g = spark.createDataFrame([("v", 100 * k, 0) for k in range(50)], "video string, hit_frame long, uncertainty_frames long")
    m = evaluation.match(c, g, (1, 5))
    assert "FlatMapGroups" not in m._jdf.queryExecution().executedPlan().toString()
    want = {(t, "v", k, 100 * k, at) for t in (1, 5) for _, k, at in rows if k % 3 <= t}
    assert {(r.tolerance, r.video, r.event_id, r.hit_frame, r.candidate_frame) for r in m.collect()} == want


def test_matching_ties_from_the_end():
    # equal errors either way: the last candidate is left out before the last gold is
    assert joins.solve_matching([10, 12], [11], [5]) == [(1, 0)]
    assert joins.solve_matching([11], [10, 12], [5, 5]) == [(0, 1)]


def test_bootstrap_repetitions(spark):
    values = [3.0, -1.0, 4.5, 0.25, 7.0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, delta double")
    n = len(values)
    pick = lambda rep, i: int(hashlib.md5(f"7:{rep}:{i}".encode()).hexdigest()[:8], 16) % n
    means = [sum(values[pick(rep, i)] for i in range(n)) / n for rep in range(10_000)]
    want = pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=2e-6)
    assert tuple(resample.bootstrap(df, [], "delta", ["i"]).first()) == want
    assert tuple(resample.drawn_means(df, [], "delta", ["i"], "7", 10_000).first()) == want
    assert tuple(resample.bootstrap(df.limit(1), [], "delta", ["i"]).first()) == (3.0, 3.0)


def test_draws_by_blocks():
    for seed, low, high, n in (("7", 8, 103, 97), ("block", 998, 1002, 20_011), ("s" * 60, 9, 11, 12)):
        got = {r: [] for r in range(low, high)}
        for first, end, at in draws.picks(seed, low, high, n):
            for r in range(first, end):
                got[r] += at[r - first].tolist()
        assert got == {r: [int(hashlib.md5(f"{seed}:{r}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for r in range(low, high)}


def test_bootstrap_in_pieces(spark, monkeypatch):
    # more values than are held as one array: any key, the tendency too
    values = {"a": [float(i * 37 % 101 - 50) for i in range(150)], "b": [1.0, 0.0, -1.0]}
    df = spark.createDataFrame([(k, i, v) for k in values for i, v in enumerate(values[k])], "k string, i long, delta double")
    monkeypatch.setattr(resample, "HELD", 4)
    monkeypatch.setattr(resample, "PIECE", 1)
    monkeypatch.setattr(resample, "TASK", 100)
    for statistic, of in ((resample.mean, float), (resample.tendency, lambda v: 50.0 * ((v > 0) + (v >= 0)))):
        got = {r.k: (r.ci_low, r.ci_high) for r in resample.bootstrap(df, ["k"], "delta", ["i"], "9", 60, statistic).collect()}
        for k, v in values.items():
            pick = lambda rep, i: int(hashlib.md5(f"9:{rep}:{i}".encode()).hexdigest()[:8], 16) % len(v)  # noqa: E731, B023
            means = [sum(of(v[pick(rep, i)]) for i in range(len(v))) / len(v) for rep in range(60)]
            assert got[k] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)


def test_block_bootstrap_in_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(b, rnd.choice("xyz"), rnd.choice("pq?")) for b in range(150) for _ in range(rnd.randint(0, 4))]
    monkeypatch.setattr(resample, "PIECE", 1)
    shares, _, _ = resample.block_bootstrap(spark.createDataFrame(rows, "b long, r string, c string"), ["b"], "r", "c", ["x", "y"], ["p", "q"], "s", 40)
    assert "Window" not in shares._jdf.queryExecution().optimizedPlan().toString()
    seen = [t for t in rows if t[1] in "xy" and t[2] in "pq"]
    blocks = sorted({t[0] for t in seen})
    of = [[t for t in seen if t[0] == b] for b in blocks]
    pick = lambda rep, i: int(hashlib.md5(f"s:{rep}:{i}".encode()).hexdigest()[:8], 16) % len(of)
    draws_ = [[t for i in range(len(of)) for t in of[pick(rep, i)]] for rep in range(40)]
    got = {(t.r, t.c): t for t in shares.collect()}
    assert len(got) == 4
    for (r, c), t in got.items():
        share = [sum(x[1:] == (r, c) for x in d) / sum(x[1] == r for x in d) for d in draws_]
        assert (t.ci_low, t.ci_high) == pytest.approx(tuple(np.quantile(share, [0.025, 0.975])))
        assert (t.block_count, t.stroke_count) == (len(blocks), sum(x[1:] == (r, c) for x in seen))


def test_matched_scores(spark):
    # two golds near one found: one match, not two recalled
    c = spark.createDataFrame([("v", 3, 105), ("v", 4, 900), ("v", 5, 901)], "video string, event_id long, candidate_frame long")
    g = spark.createDataFrame([("v", 100, 0), ("v", 110, 0)], "video string, hit_frame long, uncertainty_frames long")
    assert evaluation.match(c, g, (120,)).count() == 1
    totals = lambda g, f: spark.createDataFrame([(g, f)], "gold long, found long")
    assert tuple(registry.scores(evaluation.match(c, g, (120,)), totals(2, 3)).first()) == (0.333333, 0.5, 0.4)
    assert tuple(registry.scores(evaluation.match(c, g.limit(0), (120,)), totals(0, 3)).first()) == (0.0, 0.0, 0.0)


def test_labelled_windows(spark):
    rnd = random.Random(6)
    rows = [(v, t, f"{t}", rnd.choice([0, 0, 0, 0, 1, 2])) for v in (1, 2) for t in [*range(10, 45), *range(50, 70), *range(72, 80)]]
    got = {(r.video, r.at): (r.window, r.window_label) for r in sequence.labelled_windows(spark.createDataFrame(rows, "video int, at int, cls string, label int"), ["video"], "at", "cls", "label").collect()}
    label = {(v, t): x for v, t, _, x in rows}
    want = {}
    for v, t in label:
        if all((v, t + k) in label for k in range(12)):
            found = {label[v, t + k] for k in range(6, 12)} - {0}
            want[v, t] = ([f"{t + k}" for k in range(12)], -1 if len(found) > 1 else next(iter(found), 0))
    assert got == want and {x for _, x in want.values()} == {-1, 0, 1, 2}


def test_sessions_gap(spark):
    df = spark.createDataFrame([("v", 1.0, 1), ("v", 1.5, 2), ("v", 10.0, 3)], "video string, t double, id int")
    assert [r.session for r in sequence.sessions(df, ["video"], "t", "id", 6.0).orderBy("id").collect()] == [1, 1, 2]


def test_tolerant_number(spark):
    df = spark.createDataFrame([(" 3.0 ",), ("",), ("nan",), ("inf",), ("x",), (None,)], "t string")
    assert [r.v for r in df.select(fn.number(F.col("t")).alias("v")).collect()] == [3.0, None, None, None, None, None]
