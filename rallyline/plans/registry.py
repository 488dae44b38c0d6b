"""Queries over the driver's tables, by operator, each beside its SQL.

``events`` stands for a rally stream: user_id is the video, minutes are frames,
event_type the stroke class, and the parity of event_id the side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyline import functions as fn
from rallyline.operators import evaluation, hits, joins, resample, sequence

QUERIES: dict = {}
SQL: dict = {}
CLASSES = ["click", "error", "purchase", "signup", "view"]

EV = """ev AS (SELECT user_id AS video, event_id AS id, event_type AS cls, epoch_us(ts) AS us, epoch_us(ts) // 60000000 AS frame,
  CASE WHEN event_id % 2 = 0 THEN 'upper' ELSE 'lower' END AS side, least(value / 600, 1) AS score, value FROM events)"""
SESS = EV + """, s0 AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY video ORDER BY us, id)),
s1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY video ORDER BY us, id) AS BIGINT) AS session FROM s0),
s AS (SELECT *, row_number() OVER (PARTITION BY video, session ORDER BY us, id) AS place FROM s1)"""
COUNTS = EV + ", c AS (SELECT video, cls, count(*) AS n FROM ev GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    side = F.when(F.col("event_id") % 2 == 0, "upper").otherwise("lower")
    return table(spark, d, "events").select(
        F.col("user_id").alias("video"), F.col("event_id").alias("id"), F.col("event_type").alias("cls"), us.alias("us"),
        F.floor(us / 60000000).alias("frame"), side.alias("side"), F.least(F.col("value") / 600, F.lit(1.0)).alias("score"), "value",
    )


def sess(spark, d):
    return sequence.sessions(ev(spark, d), ["video"], "us", "id", 21_600_000_000)


def dense(counts: DataFrame, key: list[str], spark) -> DataFrame:
    """Counts by key and class, zero-filled to the fixed classes."""
    grid = counts.select(*key).distinct().withColumn("cls", F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    return grid.join(counts, [*key, "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("win16_17_sessions", f"WITH {SESS} SELECT video, id, session, place FROM s")
def win16(spark, d):
    return sess(spark, d).select("video", "id", "session", "place")


DENSE = COUNTS + ", k AS (SELECT unnest(['click','error','purchase','signup','view']) AS cls), g AS (SELECT v.video, k.cls, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY v.video) AS total FROM (SELECT DISTINCT video FROM c) v CROSS JOIN k LEFT JOIN c ON c.video = v.video AND c.cls = k.cls)"


def profile(spark, d) -> DataFrame:
    counts = ev(spark, d).groupBy("video", "cls").agg(F.count(F.lit(1)).alias("n"))
    return dense(counts, ["video"], spark).withColumn("total", F.sum("n").over(Window.partitionBy("video")))


@query("agg14_category_profile", f"WITH {DENSE} SELECT video, cls, n, round(n / total, 6) AS share FROM g")
def agg14(spark, d):
    return profile(spark, d).select("video", "cls", "n", F.round(fn.ratio(F.col("n"), F.col("total")), 6).alias("share"))


@query("agg15_shares", f"WITH {EV} SELECT video, round(count(*) FILTER (WHERE cls = 'click') / count(*), 6) AS click_share, round(count(*) FILTER (WHERE cls = 'purchase') / nullif(count(*) FILTER (WHERE cls <> 'error'), 0), 6) AS purchase_share FROM ev GROUP BY video")
def agg15(spark, d):
    good = F.count_if(F.col("cls") != "error")
    return ev(spark, d).groupBy("video").agg(F.round(fn.ratio(F.count_if(F.col("cls") == "click"), F.count(F.lit(1))), 6).alias("click_share"), F.round(fn.ratio(F.count_if(F.col("cls") == "purchase"), good), 6).alias("purchase_share"))


@query("agg23_entropy", f"WITH {DENSE} SELECT video, round(sum(CASE WHEN n > 0 THEN -(n / total) * ln(n / total) ELSE 0 END) / ln(5), 6) AS entropy FROM g GROUP BY video")
def agg23(spark, d):
    return profile(spark, d).groupBy("video").agg(F.round(F.sum(fn.plogp(F.col("n"), F.col("total"))) / math.log(5), 6).alias("entropy"))


@query("agg25_coverage", f"WITH {EV} SELECT video, round(count(DISTINCT cls) / 5, 6) AS coverage FROM ev GROUP BY video")
def agg25(spark, d):
    return ev(spark, d).groupBy("video").agg(F.round(F.count_distinct("cls") / 5, 6).alias("coverage"))


TRANS = SESS + ", p AS (SELECT video, lag(cls) OVER (PARTITION BY video, session ORDER BY us, id) AS a, cls AS b FROM s), t AS (SELECT video, a, b, count(*) AS n FROM p WHERE a IS NOT NULL AND a <> 'error' AND b <> 'error' GROUP BY ALL)"


def transitions(spark, d):
    """Pairs of neighbours in a session; an unknown class (error) breaks the sequence."""
    w = sequence.by(["video", "session"], "us", "id")
    p = sess(spark, d).select("video", F.lag("cls").over(w).alias("a"), F.col("cls").alias("b"))
    return p.filter("a is not null and a <> 'error' and b <> 'error'").groupBy("video", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("agg26_transitions", f"WITH {TRANS} SELECT video, a, b, n FROM t")
def agg26(spark, d):
    return transitions(spark, d)


@query("agg27_predictability", f"WITH {TRANS}, r AS (SELECT *, sum(n) OVER (PARTITION BY video, a) AS ra, sum(n) OVER (PARTITION BY video) AS tot FROM t) SELECT video, round(1 - sum(-(n / tot) * ln(n / ra)) / ln(4), 6) AS predictability FROM r GROUP BY video")
def agg27(spark, d):
    t = transitions(spark, d)
    t = t.withColumn("ra", F.sum("n").over(Window.partitionBy("video", "a"))).withColumn("tot", F.sum("n").over(Window.partitionBy("video")))
    return t.groupBy("video").agg(F.round(1 - F.sum(-fn.ratio(F.col("n"), F.col("tot")) * F.ln(fn.ratio(F.col("n"), F.col("ra")))) / math.log(4), 6).alias("predictability"))


def flagship(spark, sf_dir: str):
    shares = agg15(spark, sf_dir)
    return shares.join(agg27(spark, sf_dir), "video", "left").join(sess(spark, sf_dir).groupBy("video").agg(F.max("session").alias("sessions")), "video")


@query("agg28_divergence", f"WITH {DENSE}, o AS (SELECT cls, sum(n) / sum(sum(n)) OVER () AS q FROM g GROUP BY cls), m AS (SELECT video, n / total AS p, q, (n / total + q) / 2 AS m FROM g JOIN o USING (cls)) SELECT video, round(sum(CASE WHEN p > 0 THEN p * ln(p / m) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) / 2 ELSE 0 END), 6) AS divergence FROM m GROUP BY video")
def agg28(spark, d):
    g = profile(spark, d)
    o = g.groupBy("cls").agg(F.sum("n").alias("k")).withColumn("q", F.col("k") / F.sum("k").over(Window.partitionBy()))
    m = g.join(F.broadcast(o.select("cls", "q")), "cls").withColumn("p", F.col("n") / F.col("total")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / F.col("m")) / 2).otherwise(0.0)
    return m.groupBy("video").agg(F.round(F.sum(half("p") + half("q")), 6).alias("divergence"))


@query("agg29_clr", f"WITH {DENSE} SELECT video, cls, round(ln(n + 0.5) - avg(ln(n + 0.5)) OVER (PARTITION BY video), 6) AS clr FROM g")
def agg29(spark, d):
    x = F.ln(F.col("n") + F.lit(0.5))
    return profile(spark, d).select("video", "cls", F.round(x - F.avg(x).over(Window.partitionBy("video")), 6).alias("clr"))


@query("agg30_cramers_v", f"WITH {EV}, c AS (SELECT side, cls, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY side) AS r, sum(n) OVER (PARTITION BY cls) AS k, sum(n) OVER () AS t FROM c), x AS (SELECT sum(n * n / (r * k / t)) - max(t) AS chi, max(t) AS t FROM m) SELECT round(sqrt(greatest(chi, 0) / t), 4) AS v FROM x")
def agg30(spark, d):
    c = ev(spark, d).groupBy("side", "cls").agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = c.withColumn("r", F.sum("n").over(Window.partitionBy("side"))).withColumn("k", F.sum("n").over(Window.partitionBy("cls"))).withColumn("t", F.sum("n").over(Window.partitionBy()))
    x = m.agg((F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("k") / F.col("t"))) - F.max("t")).alias("chi"), F.max("t").alias("t"))
    return x.select(F.round(F.sqrt(F.greatest("chi", F.lit(0.0)) / F.col("t")), 4).alias("v"))


@query("agg02_05_percentiles", f"WITH {EV}, a AS (SELECT video, list(value ORDER BY value) AS v, quantile_cont(value, 0.9) AS lin FROM ev GROUP BY video) SELECT video, v[CAST(round_even((len(v) - 1) * 0.9::DOUBLE, 0) AS INT) + 1] AS nearest, v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] AS truncated, v[CAST(ceil((len(v) - 1) * 0.9::DOUBLE) AS INT) + 1] AS higher, round(lin, 6) AS linear FROM a")
def agg02(spark, d):
    wanted = {"nearest": (0.9, "nearest"), "truncated": (0.9, "truncated"), "higher": (0.9, "higher")}
    lin = ev(spark, d).groupBy("video").agg(F.percentile("value", F.lit(0.9)).alias("lin"))
    return fn.order_statistics(ev(spark, d), ["video"], "value", wanted).join(lin, "video").select("video", "nearest", "truncated", "higher", F.round("lin", 6).alias("linear"))


@query("agg06_median_mad", f"WITH {EV}, m AS (SELECT video, median(value) AS med FROM ev GROUP BY video) SELECT video, round(max(med), 6) AS med, round(median(abs(value - med)), 6) AS mad FROM ev JOIN m USING (video) GROUP BY video")
def agg06(spark, d):
    e = ev(spark, d).withColumn("med", F.median("value").over(Window.partitionBy("video")))
    return e.groupBy("video").agg(F.round(F.max("med"), 6).alias("med"), F.round(F.median(F.abs(F.col("value") - F.col("med"))), 6).alias("mad"))


@query("agg32_summary", f"WITH {EV} SELECT cls, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM ev GROUP BY cls")
def agg32(spark, d):
    iqr = F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))
    return ev(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(iqr, 6).alias("iqr"))


DELTA = EV + ", dl AS (SELECT video, avg(value) FILTER (WHERE side = 'upper') - avg(value) FILTER (WHERE side = 'lower') AS delta FROM ev GROUP BY video HAVING count(DISTINCT side) = 2)"


def deltas(spark, d):
    e = ev(spark, d).groupBy("video").agg(F.avg(F.when(F.col("side") == "upper", F.col("value"))).alias("u"), F.avg(F.when(F.col("side") == "lower", F.col("value"))).alias("l"))
    return e.filter("u is not null and l is not null").select("video", (F.col("u") - F.col("l")).alias("delta"))


@query("agg33_34_paired", f"WITH {DELTA} SELECT count(*) AS n, round(avg(delta), 6) AS mean, round(median(delta), 6) AS med, count(*) FILTER (WHERE delta > 1e-12) AS pos, count(*) FILTER (WHERE delta < -1e-12) AS neg, round(100 * avg(CASE WHEN delta > 1e-12 THEN 1 WHEN delta < -1e-12 THEN 0 ELSE 0.5 END), 6) AS tendency FROM dl")
def agg33(spark, d):
    x = F.col("delta")
    return deltas(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("med"), F.count_if(x > 1e-12).alias("pos"), F.count_if(x < -1e-12).alias("neg"), F.round(100 * F.avg(F.when(x > 1e-12, 1.0).when(x < -1e-12, 0.0).otherwise(0.5)), 6).alias("tendency"))


@query("agg40_leave_one_out", f"WITH {DELTA}, a AS (SELECT video, (sum(delta) OVER () - delta) / nullif(count(*) OVER () - 1, 0) AS m, sum(delta) OVER () AS t FROM dl) SELECT video, round(m, 6) AS rest_mean, sign(m) = sign(t) AS stable FROM a")
def agg40(spark, d):
    t = deltas(spark, d)
    whole = t.agg(F.sum("delta").alias("t"), F.count(F.lit(1)).alias("k"))
    t = t.crossJoin(F.broadcast(whole)).withColumn("m", fn.ratio(F.col("t") - F.col("delta"), F.col("k") - 1))
    return t.select("video", F.round("m", 6).alias("rest_mean"), (F.signum("m") == F.signum("t")).alias("stable"))


@query("agg35_bootstrap", f"WITH {DELTA}, o AS (SELECT row_number() OVER (ORDER BY video) - 1 AS i, delta, count(*) OVER () AS k FROM dl), r AS (SELECT rep, ('0x' || substr(md5('7:' || rep || ':' || i), 1, 8))::BIGINT % k AS pick FROM o CROSS JOIN range(10000) t(rep)), m AS (SELECT rep, avg(delta) AS mean FROM r JOIN o ON o.i = r.pick GROUP BY rep) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m")
def agg35(spark, d):
    """Percentile interval of the mean over 10 000 resamples, drawn by a hash, so that reruns agree."""
    out = resample.bootstrap(deltas(spark, d), [], "delta", ["video"])
    return out.select(F.round("ci_low", 6).alias("low"), F.round("ci_high", 6).alias("high"))


@query("win01_stencil", f"WITH {EV}, w AS (SELECT video, id, value, lag(value) OVER o AS a, lead(value) OVER o AS b, frame - lag(frame) OVER o AS g1, lead(frame) OVER o - frame AS g2 FROM ev WINDOW o AS (PARTITION BY video ORDER BY us, id)) SELECT video, id, round(abs(b - 2 * value + a) / greatest(abs(value - a), abs(b - value), 1), 6) AS change FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND g1 <= 600 AND g2 <= 600")
def win01(spark, d):
    w = sequence.by(["video"], "us", "id")
    e = ev(spark, d).select("video", "id", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"), (F.col("frame") - F.lag("frame").over(w)).alias("g1"), (F.lead("frame").over(w) - F.col("frame")).alias("g2"))
    e = e.filter("a is not null and b is not null and g1 <= 600 and g2 <= 600")
    v, a, b = F.col("value"), F.col("a"), F.col("b")
    return e.select("video", "id", F.round(F.abs(b - 2 * v + a) / F.greatest(F.abs(v - a), F.abs(b - v), F.lit(1.0)), 6).alias("change"))


@query("win07_local_maxima", f"WITH {EV}, m AS (SELECT *, max(score) OVER (PARTITION BY video ORDER BY us, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM ev) SELECT video, id, score FROM m WHERE score = top")
def win07(spark, d):
    return sequence.local_maxima(ev(spark, d), ["video"], ["us", "id"], "score").select("video", "id", "score")


@query("win12_nearby", f"WITH {EV} SELECT video, id, count(*) OVER (PARTITION BY video ORDER BY frame RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS near FROM ev")
def win12(spark, d):
    return ev(spark, d).select("video", "id", F.count(F.lit(1)).over(Window.partitionBy("video").orderBy("frame").rangeBetween(-300, 300)).alias("near"))


@query("win14_merge", f"WITH {EV}, a AS (SELECT *, max(frame + 200) OVER (PARTITION BY video ORDER BY frame, frame + 200 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM ev), b AS (SELECT *, sum(CASE WHEN h IS NULL OR frame > h + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame, frame + 200 ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT video, min(frame) AS low, max(frame + 200) AS high, count(*) AS n FROM b GROUP BY video, i")
def win14(spark, d):
    e = ev(spark, d).select("video", F.col("frame").alias("lo"), (F.col("frame") + 200).alias("hi"))
    return sequence.merge_intervals(e, ["video"], "lo", "hi")


@query("win18_runs", f"WITH {EV}, f AS (SELECT *, score > 0.1 AS flag FROM ev), g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY us, id) - row_number() OVER (PARTITION BY video, flag ORDER BY us, id) AS k FROM f) SELECT video, flag, min(us) AS first, max(us) AS last, count(*) AS n FROM g GROUP BY video, flag, k")
def win18(spark, d):
    return sequence.runs(ev(spark, d).withColumn("flag", F.col("score") > 0.1), ["video"], ["us", "id"], "flag")


@query("win25_midpoints", f"WITH {SESS}, m AS (SELECT video, id, frame, lag(frame) OVER o AS a, lead(frame) OVER o AS b FROM s WINDOW o AS (PARTITION BY video, session ORDER BY us, id)) SELECT video, id, coalesce((a + frame) // 2, frame - 30) AS low, coalesce((frame + b) // 2, frame + 30) AS high FROM m")
def win25(spark, d):
    w = sequence.by(["video", "session"], "us", "id")
    m = sess(spark, d).select("video", "id", "frame", F.lag("frame").over(w).alias("a"), F.lead("frame").over(w).alias("b"))
    return m.select("video", "id", F.expr("coalesce((a + frame) div 2, frame - 30)").alias("low"), F.expr("coalesce((frame + b) div 2, frame + 30)").alias("high"))


@query("win30_31_windows", f"WITH {EV}, w AS (SELECT video, id, list(cls) OVER o AS c, count(DISTINCT cls) OVER o AS k FROM ev WINDOW o AS (PARTITION BY video ORDER BY us, id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) SELECT video, id, array_to_string(c, ',') AS classes FROM w WHERE len(c) = 12")
def win30(spark, d):
    w = sequence.by(["video"], "us", "id").rowsBetween(0, 11)
    return ev(spark, d).withColumn("c", F.collect_list("cls").over(w)).filter("size(c) = 12").select("video", "id", F.concat_ws(",", "c").alias("classes"))


@query("win30_31_labelled")
def win30_labelled(spark, d):
    """Windows of 12 contiguous rows (none bridges two sessions), with the label of a purchase's side (1 lower, 2 upper) at offsets 6 to 11."""
    w = sequence.by(["video"], "us", "id")
    side = F.when(F.col("cls") != "purchase", 0).when(F.col("side") == "lower", 1).otherwise(2)
    e = sess(spark, d).withColumn("at", F.row_number().over(w) + F.col("session")).withColumn("label", side)
    return sequence.labelled_windows(e, ["video"], "at", "cls", "label").select("video", "id", F.concat_ws(",", "window").alias("classes"), "window_label")


@query("win32_percentile_rank", f"WITH {EV}, r AS (SELECT video, id, rank() OVER (PARTITION BY video ORDER BY score) AS r, count(*) OVER (PARTITION BY video, score) AS t, count(*) OVER (PARTITION BY video) AS n FROM ev) SELECT video, id, round((r + (t - 1) / 2 - 1) / nullif(n - 1, 0), 6) AS p FROM r")
def win32(spark, d):
    e = ev(spark, d)
    r, t, n = F.rank().over(sequence.by(["video"], "score")), F.count(F.lit(1)).over(Window.partitionBy("video", "score")), F.count(F.lit(1)).over(Window.partitionBy("video"))
    return e.select("video", "id", F.round(fn.ratio(r + (t - 1) / 2 - 1, n - 1), 6).alias("p"))


@query("win40_latest", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def win40(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("win43_zscore", f"WITH {EV}, z AS (SELECT video, id, value - avg(value) OVER w AS c, stddev_samp(value) OVER w AS sd FROM ev WINDOW w AS (PARTITION BY video)) SELECT video, id, round(c / CASE WHEN sd IS NULL OR sd = 0 THEN 1 ELSE sd END, 5) AS z FROM z")
def win43(spark, d):
    w = Window.partitionBy("video")
    sd = F.stddev_samp("value").over(w)
    return ev(spark, d).select("video", "id", F.round((F.col("value") - F.avg("value").over(w)) / F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd), 5).alias("z"))


@query("win45_ordering", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) = count(*) AS valid FROM lineitem GROUP BY l_orderkey")
def win45(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("l_linenumber") == F.count(F.lit(1))).alias("valid"))


PAIR = EV + ", gold AS (SELECT * FROM ev WHERE cls = 'purchase'), found AS (SELECT * FROM ev WHERE cls = 'click')"


def two(spark, d):
    e = ev(spark, d)
    return e.filter("cls = 'purchase'").select("video", F.col("id").alias("gold_id"), F.col("frame").alias("gold")), e.filter("cls = 'click'").select("video", F.col("id").alias("found_id"), F.col("frame").alias("found"))


@query("join02_band", f"WITH {PAIR} SELECT g.video, g.id AS gold_id, f.id AS found_id FROM gold g JOIN found f ON g.video = f.video AND abs(g.frame - f.frame) <= 120")
def join02(spark, d):
    g, f = two(spark, d)
    return joins.band_join(g, f, "video", "gold", "found", 120).select("video", "gold_id", "found_id")


@query("join03_alternating", f"WITH {EV} SELECT a.video, a.id AS id_a, b.id AS id_b FROM ev a JOIN ev b ON a.video = b.video AND a.side <> b.side AND b.frame - a.frame BETWEEN 10 AND 240")
def join03(spark, d):
    e = ev(spark, d).select("video", F.col("id").alias("id_a"), F.col("side").alias("sa"), F.col("frame").alias("fa"))
    o = ev(spark, d).select("video", F.col("id").alias("id_b"), F.col("side").alias("sb"), F.col("frame").alias("fb"))
    return joins.forward_join(e, o, "video", "fa", "fb", 10, 240).filter("sa <> sb").select("video", "id_a", "id_b")


@query("join04_containment", SQL["win14_merge"].replace("SELECT video, min", ", iv AS (SELECT video, min").rstrip() + ") SELECT e.video, e.id, iv.low FROM ev e LEFT JOIN iv ON iv.video = e.video AND e.frame + 100 BETWEEN iv.low AND iv.high")
def join04(spark, d):
    points = ev(spark, d).select("video", "id", (F.col("frame") + 100).alias("x"))
    return joins.contains_join(points, win14(spark, d), "video", "x", "low", "high").select("video", "id", "low")


@query("join05_06_neighbours", f"WITH {SESS} SELECT video, id, lag(id) OVER o AS prev_id, lead(id) OVER o AS next_id FROM s WINDOW o AS (PARTITION BY video, session ORDER BY us, id)")
def join05(spark, d):
    w = sequence.by(["video", "session"], "us", "id")
    return sess(spark, d).select("video", "id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


@query("join11_unmatched", f"WITH {PAIR} SELECT video, id AS gold_id FROM gold g WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.video = g.video AND abs(f.frame - g.frame) <= 120)")
def join11(spark, d):
    g, _ = two(spark, d)
    return g.join(join02(spark, d).select("video", "gold_id").distinct(), ["video", "gold_id"], "left_anti").select("video", "gold_id")


@query("join12_ambiguous", f"WITH {PAIR} SELECT g.video, g.id AS gold_id, count(*) AS n FROM gold g JOIN found f ON g.video = f.video AND abs(g.frame - f.frame) <= 120 GROUP BY ALL HAVING count(*) > 1")
def join12(spark, d):
    return join02(spark, d).groupBy("video", "gold_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("join15_as_of", f"WITH {PAIR} SELECT g.video, g.id, (SELECT f.side FROM found f WHERE f.video = g.video AND f.us <= g.us ORDER BY f.us DESC, f.id DESC LIMIT 1) AS as_of FROM gold g")
def join15(spark, d):
    e = ev(spark, d)
    left = e.filter("cls = 'purchase'").select("video", "id", "us")
    right = e.filter("cls = 'click'").select("video", "us", "side", F.col("id").alias("version"))
    return joins.as_of_join(left, right, "video", "us", "side", "version").select("video", "id", "as_of")


@query("join16_full_outer", f"WITH {EV}, a AS (SELECT video, max(value) AS machine FROM ev WHERE cls = 'click' GROUP BY video), b AS (SELECT video, max(value) AS review FROM ev WHERE cls = 'signup' GROUP BY video) SELECT video, coalesce(review, machine) AS merged, machine IS NULL AS review_only FROM a FULL JOIN b USING (video)")
def join16(spark, d):
    e = ev(spark, d)
    a = e.filter("cls = 'click'").groupBy("video").agg(F.max("value").alias("machine"))
    b = e.filter("cls = 'signup'").groupBy("video").agg(F.max("value").alias("review"))
    return a.join(b, "video", "full_outer").select("video", F.coalesce("review", "machine").alias("merged"), F.col("machine").isNull().alias("review_only"))


@query("join24_grid", "SELECT a.x AS link, b.y AS roll, c.z AS ratio FROM (VALUES (1), (2), (3)) a(x), (VALUES (0.15::DOUBLE), (0.35), (0.55)) b(y), (VALUES (0.25::DOUBLE), (0.75)) c(z)")
def join24(spark, d):
    link, roll, part = (spark.createDataFrame([(v,) for v in vs], s) for vs, s in (((1, 2, 3), "link int"), ((0.15, 0.35, 0.55), "roll double"), ((0.25, 0.75), "ratio double")))
    return link.crossJoin(F.broadcast(roll)).crossJoin(F.broadcast(part))


@query("join09_matching")
def join09(spark, d):
    """Most pairs within the tolerance, then least error; too sequential for SQL, tested by brute force."""
    e = ev(spark, d)
    c = e.filter("cls = 'click'").select("video", F.col("id").alias("event_id"), F.col("frame").alias("candidate_frame"))
    g = e.filter("cls = 'purchase'").select("video", F.col("frame").alias("hit_frame"), F.lit(0).alias("uncertainty_frames"))
    m = evaluation.match(c, g, (120,))
    return m.select("video", F.col("event_id").alias("found_id"), F.col("hit_frame").alias("gold"), (F.col("candidate_frame") - F.col("hit_frame")).alias("error"))


@query("win08_separation", f"WITH RECURSIVE {EV}, o AS (SELECT video, id, us, frame, score, row_number() OVER (PARTITION BY video ORDER BY frame, id) AS k FROM ev), r AS (SELECT video, k, id, frame, score, 1 AS grp FROM o WHERE k = 1 UNION ALL SELECT o.video, o.k, CASE WHEN o.frame - r.frame >= 600 OR o.score > r.score THEN o.id ELSE r.id END, CASE WHEN o.frame - r.frame >= 600 OR o.score > r.score THEN o.frame ELSE r.frame END, CASE WHEN o.frame - r.frame >= 600 OR o.score > r.score THEN o.score ELSE r.score END, CASE WHEN o.frame - r.frame >= 600 THEN r.grp + 1 ELSE r.grp END FROM r JOIN o ON o.video = r.video AND o.k = r.k + 1) SELECT video, arg_max(id, k) AS id FROM r GROUP BY video, grp")
def win08(spark, d):
    return hits.separate(ev(spark, d).select("video", "id", "frame", "score"), ["video"], "frame", "score", 600, "id").select("video", "id")


@query("win34_anchored", f"WITH RECURSIVE {EV}, o AS (SELECT video, id, frame, row_number() OVER (PARTITION BY video ORDER BY frame, id) AS k FROM ev), r AS (SELECT video, k, id, frame AS first, 1 AS grp FROM o WHERE k = 1 UNION ALL SELECT o.video, o.k, o.id, CASE WHEN o.frame - r.first > 600 THEN o.frame ELSE r.first END, CASE WHEN o.frame - r.first > 600 THEN r.grp + 1 ELSE r.grp END FROM r JOIN o ON o.video = r.video AND o.k = r.k + 1) SELECT video, id, CAST(grp AS BIGINT) AS grp FROM r")
def win34(spark, d):
    return sequence.anchored(ev(spark, d).select("video", "id", "frame"), ["video"], "frame", "id", 600).select("video", "id", "grp")


@query("agg01_quality", f"WITH {EV} SELECT count(*) AS rows_all, count(DISTINCT video) AS videos, round(count(*) FILTER (WHERE score >= 0.1) / nullif(count(*), 0), 6) AS coverage, round(avg(score), 6) AS mean_score FROM ev")
def agg01(spark, d):
    return ev(spark, d).agg(F.count(F.lit(1)).alias("rows_all"), F.count_distinct("video").alias("videos"), F.round(fn.ratio(F.count_if(F.col("score") >= 0.1), F.count(F.lit(1))), 6).alias("coverage"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("agg07_precision_recall", f"WITH {PAIR}, m AS (SELECT g.id AS g, f.id AS f FROM gold g JOIN found f ON g.video = f.video AND abs(g.frame - f.frame) <= 120) SELECT round((SELECT count(DISTINCT f) FROM m) / greatest((SELECT count(*) FROM found), 1), 6) AS covered_found, round((SELECT count(DISTINCT g) FROM m) / greatest((SELECT count(*) FROM gold), 1), 6) AS recall")
def agg07(spark, d):
    m = join02(spark, d).agg(F.count_distinct("gold_id").alias("g"), F.count_distinct("found_id").alias("f"))
    t = ev(spark, d).agg(F.count_if(F.col("cls") == "purchase").alias("gold"), F.count_if(F.col("cls") == "click").alias("found"))
    return m.crossJoin(t).select(F.round(F.col("f") / F.greatest("found", F.lit(1)), 6).alias("covered_found"), F.round(F.col("g") / F.greatest("gold", F.lit(1)), 6).alias("recall"))


def scores(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """precision, recall and f1 of one-to-one matches, out of ``gold`` and ``found`` events; 0 where there are none."""
    m = matches.agg(F.count(F.lit(1)).alias("m")).crossJoin(totals)
    share = lambda n: F.when(F.col(n) > 0, F.col("m") / F.col(n)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("m") > 0, 2 * F.col("m") / (F.col("gold") + F.col("found"))).otherwise(F.lit(0.0))
    return m.select(F.round(share("found"), 6).alias("precision"), F.round(share("gold"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("agg07_matched_f1")
def agg07_matched(spark, d):
    """Precision, recall and F1 of join09's optimal one-to-one matches; tested by brute force."""
    t = ev(spark, d).agg(F.count_if(F.col("cls") == "purchase").alias("gold"), F.count_if(F.col("cls") == "click").alias("found"))
    return scores(join09(spark, d), t)


@query("agg18_event_rate", f"WITH {SESS}, r AS (SELECT video, session, count(*) AS n, max(us) - min(us) AS dur FROM s GROUP BY ALL HAVING count(*) >= 2 AND max(us) > min(us)) SELECT video, round(median(n / (dur / 3600000000)), 6) AS rate FROM r GROUP BY video")
def agg18(spark, d):
    r = sess(spark, d).groupBy("video", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("dur")).filter("n >= 2 and dur > 0")
    return r.groupBy("video").agg(F.round(F.median(F.col("n") / (F.col("dur") / 3600000000)), 6).alias("rate"))


@query("agg19_long_rallies", f"WITH {SESS}, r AS (SELECT video, session, count(*) AS n FROM s GROUP BY ALL) SELECT video, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS two, round(count(*) FILTER (WHERE n >= 4) / count(*), 6) AS four FROM r GROUP BY video")
def agg19(spark, d):
    r = sess(spark, d).groupBy("video", "session").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("video").agg(*[F.round(F.count_if(F.col("n") >= k) / F.count(F.lit(1)), 6).alias(name) for k, name in ((2, "two"), (4, "four"))])


@query("agg21_entry", f"WITH {SESS}, l AS (SELECT video, session, cls, lead(cls) OVER o AS a, lead(cls, 2) OVER o AS b FROM s WINDOW o AS (PARTITION BY video, session ORDER BY us, id)), r AS (SELECT video, session, bool_or(a = 'purchase' OR coalesce(b = 'purchase', false)) AS hit FROM l WHERE cls = 'view' AND (coalesce(a <> 'error', false) OR coalesce(b <> 'error', false)) GROUP BY ALL) SELECT video, round(count(*) FILTER (WHERE hit) / count(*), 6) AS entry FROM r GROUP BY video")
def agg21(spark, d):
    """Sessions in which a view is followed by a purchase within two events, of those where a classified event (not an error) follows."""
    w = sequence.by(["video", "session"], "us", "id")
    e = sess(spark, d).select("video", "session", "cls", F.lead("cls").over(w).alias("a"), F.lead("cls", 2).over(w).alias("b"))
    e = e.filter("cls = 'view' and (coalesce(a <> 'error', false) or coalesce(b <> 'error', false))")
    yes = F.coalesce(F.col("a") == "purchase", F.lit(False)) | F.coalesce(F.col("b") == "purchase", F.lit(False))
    r = e.groupBy("video", "session").agg(F.bool_or(yes).alias("hit"))
    return r.groupBy("video").agg(F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("entry"))


@query("agg45_kappa", f"WITH {EV}, c AS (SELECT side, score > 0.1 AS y, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE (side = 'upper') = y) AS agree, sum(n) FILTER (WHERE side = 'upper') AS u, sum(n) FILTER (WHERE y) AS p FROM c), k AS (SELECT agree / t AS po, (u / t) * (p / t) + (1 - u / t) * (1 - p / t) AS pe FROM t) SELECT round(po, 6) AS agreement, CASE WHEN abs(1 - pe) < 1e-12 THEN NULL ELSE round((po - pe) / (1 - pe), 6) END AS kappa FROM k")
def agg45(spark, d):
    u, y = F.col("side") == "upper", F.col("score") > 0.1
    t = ev(spark, d).agg(F.count(F.lit(1)).alias("t"), F.count_if(u == y).alias("agree"), F.count_if(u).alias("u"), F.count_if(y).alias("p"))
    u, p = fn.ratio(F.col("u"), F.col("t")), fn.ratio(F.col("p"), F.col("t"))
    t = t.select(fn.ratio(F.col("agree"), F.col("t")).alias("po"), (u * p + (1 - u) * (1 - p)).alias("pe"))
    return t.select(F.round("po", 6).alias("agreement"), F.when(F.abs(1 - F.col("pe")) < 1e-12, None).otherwise(F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6)).alias("kappa"))


@query("agg52_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg52(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("scl13_14_json_seed", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, ('0x' || substr(sha256(event_type), 1, 8))::BIGINT AS seed FROM events")
def scl13(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.conv(F.substring(F.sha2("event_type", 256), 1, 8), 16, 10).cast("long").alias("seed"))


@query("scl19_edges", "SELECT vec_id, label, round(embedding[3]::DOUBLE - embedding[1]::DOUBLE, 6) AS dx, round(embedding[4]::DOUBLE - embedding[2]::DOUBLE, 6) AS dy FROM embeddings")
def scl19(spark, d):
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(at(3) - at(1), 6).alias("dx"), F.round(at(4) - at(2), 6).alias("dy"))


@query("set01_07_overlap", f"WITH {EV}, a AS (SELECT DISTINCT video FROM ev WHERE cls = 'purchase'), b AS (SELECT DISTINCT video FROM ev WHERE cls = 'signup') SELECT count(*) FILTER (WHERE a.video IS NOT NULL AND b.video IS NOT NULL) AS both_n, count(*) FILTER (WHERE b.video IS NULL) AS only_a, count(*) FILTER (WHERE a.video IS NULL) AS only_b FROM a FULL JOIN b ON a.video = b.video")
def set07(spark, d):
    e = ev(spark, d).groupBy("video").agg(F.bool_or(F.col("cls") == "purchase").alias("a"), F.bool_or(F.col("cls") == "signup").alias("b"))
    return e.agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


@query("srt02_top_per_group", f"WITH {EV}, r AS (SELECT video, id, score, row_number() OVER (PARTITION BY video ORDER BY score DESC, id) AS k FROM ev) SELECT video, id, score, k FROM r WHERE k <= 5")
def srt02(spark, d):
    r = ev(spark, d).withColumn("k", F.row_number().over(sequence.by(["video"], F.col("score").desc(), "id")))
    return r.filter("k <= 5").select("video", "id", "score", "k")


@query("srt08_argmax", f"WITH {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, cls) AS k FROM c) SELECT video, cls, n FROM r WHERE k = 1")
def srt08(spark, d):
    c = ev(spark, d).groupBy("video", "cls").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(sequence.by(["video"], F.col("n").desc(), "cls"))).filter("k = 1").select("video", "cls", "n")


@query("flt14_complete_case", f"WITH {EV}, c AS (SELECT video, side, count(*) AS n FROM ev GROUP BY ALL) SELECT video, min(n) AS least FROM c GROUP BY video HAVING count(*) = 2 AND min(n) >= 5")
def flt14(spark, d):
    c = ev(spark, d).groupBy("video", "side").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("video").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).filter("k = 2 and least >= 5").select("video", "least")


from rallyline.plans import frames, labels, matches  # noqa: E402, F401
