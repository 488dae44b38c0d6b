"""Queries of the match analysis over ``lineitem``, which stands for strokes: an order is a rally, 24 matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline import functions as fn
from rallyline.operators import profile, resample
from rallyline.plans.registry import query, table

RAW = [*fn.MACRO_OF, "driven flight", ""]
SPOTS = {"player_location_x": (7, 13, 640), "player_location_y": (11, 37, 1400), "opponent_location_x": (17, 5, 640), "opponent_location_y": (3, 41, 1400), "landing_x": (23, 29, 640), "landing_y": (31, 19, 1400)}


def raw(spark, d) -> DataFrame:
    """Strokes as text, as a match's table has them."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("e"), F.col("l_quantity").cast("long").alias("q"),
    )
    side = F.when(F.col("s") % 10 == 0, "Referee").when((F.col("p") + F.col("k")) % 2 == 0, " Upper").otherwise("lower")
    types = F.array(*[F.lit(t) for t in RAW])
    spots = [F.when(F.col("q") % 7 == i % 7, F.lit("")).otherwise(((F.col("p") * a + F.col("k") * b + F.col("s") * 3) % m / 100).cast("string")).alias(n) for i, (n, (a, b, m)) in enumerate(SPOTS.items())]
    return li.select(
        F.concat(F.lit("vid_"), F.col("o") % 24).alias("video_id"), F.concat_ws("-", "o", "k", "p", "s", "e").alias("event_id"), F.concat(F.lit("r"), "o").alias("rally_id"), F.col("k").cast("string").alias("stroke_index"),
        (F.col("k") * 1.25 + F.col("p") % 8 * 0.125).cast("string").alias("hit_time"), side.alias("player"), F.get(types, (F.col("p") % len(RAW)).cast("int")).alias("stroke_type"), *spots,
    )


def matches(spark) -> DataFrame:
    n = F.col("id")
    return spark.range(24).select(F.concat(F.lit("vid_"), n).alias("video_id"), F.when(n % 2 == 0, "upper").otherwise("lower").alias("focal_side"), F.concat(F.lit("op"), n % 7).alias("opponent"), F.concat(F.lit("c"), n % 3).alias("competition"))


def strokes(spark, d) -> DataFrame:
    return profile.normalise(raw(spark, d), matches(spark))


def case(column: str, pairs, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE {other} END"


def third(expr: str, names) -> str:
    return f"CASE WHEN {expr} < 1::DOUBLE / 3 THEN '{names[0]}' WHEN {expr} < 2::DOUBLE / 3 THEN '{names[1]}' WHEN {expr} <= 1 THEN '{names[2]}' END"


def width(x: str) -> str:
    return f"CASE WHEN {x} < 6.1::DOUBLE / 3 THEN '左侧' WHEN {x} < 2 * 6.1::DOUBLE / 3 THEN '中路' WHEN {x} IS NOT NULL THEN '右侧' END"


_SPOT_SQL = ", ".join(f"CASE WHEN q % 7 = {i % 7} OR (p * {a} + k * {b} + s * 3) % {m} / 100 > {6.1 if m == 640 else 13.4}::DOUBLE THEN NULL ELSE (p * {a} + k * {b} + s * 3) % {m} / 100 END AS {n}" for i, (n, (a, b, m)) in enumerate(zip(("ox", "oy", "px", "py", "lx", "ly"), SPOTS.values(), strict=True)))
STROKES = f"""li AS (SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS k, l_partkey AS p, l_suppkey AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
 s0 AS (SELECT 'vid_' || (o % 24) AS video, 'op' || (o % 24 % 7) AS opponent, concat_ws('-', o, k, p, s, e) AS id, 'r' || o AS rally, k, k * 1.25::DOUBLE + p % 8 * 0.125::DOUBLE AS t, CASE WHEN (p + k) % 2 = 0 THEN 'upper' ELSE 'lower' END AS side,
  CASE WHEN (o % 24) % 2 = 0 THEN 'upper' ELSE 'lower' END AS focal, [{', '.join(f"'{r or 'unknown'}'" for r in RAW)}][CAST(p % {len(RAW)} AS INT) + 1] AS stroke, {_SPOT_SQL} FROM li WHERE s % 10 <> 0),
 s1 AS (SELECT *, CASE WHEN side = focal THEN 'focal' ELSE 'opponent' END AS who, {case('stroke', fn.MACRO_OF.items(), "'unknown'")} AS macro,
  CASE WHEN side = 'upper' THEN oy ELSE 13.4::DOUBLE - oy END / 6.7::DOUBLE AS od, CASE WHEN side = 'lower' THEN py ELSE 13.4::DOUBLE - py END / 6.7::DOUBLE AS pd, CASE WHEN side = 'lower' THEN ly ELSE 13.4::DOUBLE - ly END / 6.7::DOUBLE AS ld FROM s0),
 st AS (SELECT *, {third('od', fn.DEPTHS)} AS own_depth, {third('pd', fn.DEPTHS)} AS far_depth, {third('ld', fn.DEPTHS)} || '-' || {width('lx')} AS zone,
  CASE WHEN lx - ox < -(6.1::DOUBLE / 6) THEN '左偏' WHEN lx - ox > 6.1::DOUBLE / 6 THEN '右偏' WHEN lx - ox IS NOT NULL THEN '中路' END AS line, CASE WHEN k <= 3 THEN '开局阶段' WHEN k <= 6 THEN '组织阶段' ELSE '延长阶段' END AS phase FROM s1)"""
KNOWN = "macro <> 'unknown'"
MACRO_LIST = ", ".join(f"'{m}'" for m in fn.MACROS)
ORDERED = f"""{STROKES}, ord AS (SELECT *, lead(macro) OVER w AS m1, lead(macro, 2) OVER w AS m2, lag(macro) OVER w AS m0 FROM st WINDOW w AS (PARTITION BY video, rally, who ORDER BY k, t, id)),
 fl AS (SELECT *, coalesce(m1 <> 'unknown', false) OR coalesce(m2 <> 'unknown', false) AS fol, coalesce(m1 = '后场进攻', false) OR coalesce(m2 = '后场进攻', false) AS att, coalesce(m1 = '网前/前场', false) OR coalesce(m2 = '网前/前场', false) AS nets FROM ord)"""
RALLY = f"""{ORDERED}, al AS (SELECT video, rally, count(*) AS n, max(t) - min(t) AS span, arg_max(macro, (k, t, id)) AS last_macro, arg_max(who, (k, t, id)) AS last_who FROM st GROUP BY ALL),
 ra AS (SELECT f.video, f.who, f.rally, count(*) AS own, any_value(a.n) AS n, any_value(a.span) AS span, any_value(a.last_macro) AS last_macro, any_value(a.last_who) AS last_who,
  bool_or(fol AND macro IN ('网前/前场', '高远/挑球', '平抽/推挡', '吊球')) AS entry, bool_or(fol AND att AND macro IN ('网前/前场', '高远/挑球', '平抽/推挡', '吊球')) AS entered, bool_or(fol AND macro = '高远/挑球') AS defence, bool_or(fol AND att AND macro = '高远/挑球') AS turned,
  count(*) FILTER (WHERE fol AND macro = '网前/前场') AS net, count(*) FILTER (WHERE fol AND nets AND macro = '网前/前场') AS netted FROM fl f JOIN al a USING (video, rally) GROUP BY ALL)"""


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def metrics(spark, d, **rule) -> DataFrame:
    return profile.player_metrics(strokes(spark, d), **rule)


def own(df: DataFrame, *names: str) -> DataFrame:
    return df.select("video_id", "athlete", *r6(*names))


def share(cond: str, base: str) -> str:
    return f"round(count(*) FILTER (WHERE {cond}) / nullif(count(*) FILTER (WHERE {base}), 0), 6)"


BY = "video AS video_id, who AS athlete"


@query("prj08_normalise", f"WITH {STROKES} SELECT id AS event_id, {BY}, opponent, stroke AS stroke_type, macro AS macro_type, ox AS own_x, oy AS own_y, px AS opponent_x, py AS opponent_y, lx AS landing_x, ly AS landing_y, own_depth, far_depth AS opponent_depth, zone AS landing_zone9, line AS line_class, t AS hit_time, k AS stroke_index FROM st")
def prj08(spark, d):
    return strokes(spark, d).select("event_id", "video_id", "athlete", "opponent", "stroke_type", "macro_type", "own_x", "own_y", "opponent_x", "opponent_y", "landing_x", "landing_y", "own_depth", "opponent_depth", "landing_zone9", "line_class", "hit_time", "stroke_index")


@query("prj09_older_normalise", f"WITH {STROKES} SELECT id AS event_id, {BY}, CASE WHEN macro = 'unknown' THEN '未分类' ELSE macro END AS macro_type, phase, own_depth FROM st WHERE side = focal")
def prj09(spark, d):
    e = profile.normalise(raw(spark, d).distinct(), matches(spark), nulling=False, focal_only=True, unmapped="未分类")
    return e.select("event_id", "video_id", "athlete", "macro_type", "phase", "own_depth")


@query("flt07_08_audit", f"WITH li AS (SELECT CAST(l_linenumber AS BIGINT) AS k, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT count(*) AS raw_rows, count(*) FILTER (WHERE s % 10 = 0) AS non_upper_lower_player, " + ", ".join(f"count(*) FILTER (WHERE s % 10 <> 0 AND q % 7 <> {i % 7} AND (p * {a} + k * {b} + s * 3) % {m} / 100 > {6.1 if m == 640 else 13.4}::DOUBLE) AS invalid_{n}" for i, (n, (a, b, m)) in enumerate(zip(profile.AXES, SPOTS.values(), strict=True))) + " FROM li")
def flt07(spark, d):
    return profile.audit(raw(spark, d)).select("raw_rows", "non_upper_lower_player", *[f"invalid_{n}" for n in profile.AXES])


@query("agg15_share_metrics", f"WITH {STROKES} SELECT {BY}, {share(chr(39).join(['stroke IN (', 'smash', ', ', 'wrist smash', ')']), KNOWN)} AS smash_share, {share(chr(39).join(['stroke IN (', 'drop', ', ', 'passive drop', ')']), KNOWN)} AS drop_share, {share(chr(39).join(['macro = ', '网前/前场', '']), KNOWN)} AS net_share, {share(chr(39).join(['macro = ', '平抽/推挡', '']), KNOWN)} AS drive_share FROM st GROUP BY video, who")
def agg15(spark, d):
    return own(metrics(spark, d), "smash_share", "drop_share", "net_share", "drive_share")


@query("agg16_backcourt", f"WITH {STROKES} SELECT {BY}, round(count(*) FILTER (WHERE own_depth = '后场') / nullif(count(own_depth), 0), 6) AS backcourt_tendency FROM st GROUP BY video, who")
def agg16(spark, d):
    return own(metrics(spark, d), "backcourt_tendency")


@query("agg17_early_active", f"WITH {STROKES} SELECT {BY}, round(count(*) FILTER (WHERE k <= 3 AND macro IN ('后场进攻', '网前/前场', '平抽/推挡')) / nullif(count(*) FILTER (WHERE k <= 3 AND {KNOWN}), 0), 6) AS early_active_share FROM st GROUP BY video, who")
def agg17(spark, d):
    return own(metrics(spark, d), "early_active_share")


@query("agg18_own_event_rate", f"WITH {RALLY} SELECT {BY}, round(median(own / span) FILTER (WHERE n >= 2 AND span > 0), 6) AS event_rate_proxy FROM ra GROUP BY video, who")
def agg18(spark, d):
    return own(metrics(spark, d), "event_rate_proxy")


@query("agg19_long_rally_share", f"WITH {RALLY} SELECT {BY}, " + ", ".join(f"round(count(*) FILTER (WHERE n >= {k}) / count(*), 6) AS long_rally_share_{k}" for k in (8, 10, 12)) + " FROM ra GROUP BY video, who")
def agg19(spark, d):
    return own(metrics(spark, d), "long_rally_share_8", "long_rally_share_10", "long_rally_share_12")


@query("agg20_terminal_attack", f"WITH {RALLY} SELECT {BY}, round(count(*) FILTER (WHERE last_macro = '后场进攻' AND last_who = who) / nullif(count(*) FILTER (WHERE last_macro <> 'unknown'), 0), 6) AS terminal_attack_event_share FROM ra GROUP BY video, who")
def agg20(spark, d):
    return own(metrics(spark, d), "terminal_attack_event_share")


@query("agg21_attack_entry", f"WITH {RALLY} SELECT {BY}, round(count(*) FILTER (WHERE entered) / nullif(count(*) FILTER (WHERE entry), 0), 6) AS attack_entry_proxy, round(count(*) FILTER (WHERE turned) / nullif(count(*) FILTER (WHERE defence), 0), 6) AS defense_to_attack_proxy FROM ra GROUP BY video, who")
def agg21(spark, d):
    return own(metrics(spark, d), "attack_entry_proxy", "defense_to_attack_proxy")


@query("agg22_net_continuation", f"WITH {RALLY} SELECT {BY}, round(sum(netted) / nullif(sum(net), 0), 6) AS net_continuation_proxy FROM ra GROUP BY video, who")
def agg22(spark, d):
    return own(metrics(spark, d), "net_continuation_proxy")


def entropy_sql(column: str, k: int) -> str:
    return f"SELECT video, who, sum(-(n / t) * ln(n / t)) / ln({k}) AS h, count(*) AS kinds FROM (SELECT video, who, {column}, count(*) AS n, sum(count(*)) OVER (PARTITION BY video, who) AS t FROM st WHERE {column} IS NOT NULL GROUP BY video, who, {column}) GROUP BY video, who"


SPACE = f"{STROKES}, zo AS ({entropy_sql('zone', 9)}), ln_ AS ({entropy_sql('line', 3)})"


@query("agg24_spatial_diversity", f"WITH {SPACE} SELECT {BY}, round((zo.h + ln_.h) / 2, 6) AS spatial_diversity, round(zo.h, 6) AS landing_entropy, round(ln_.h, 6) AS line_entropy, round(zo.kinds / 9, 6) AS landing_coverage FROM (SELECT DISTINCT video, who FROM st) LEFT JOIN zo USING (video, who) LEFT JOIN ln_ USING (video, who)")
def agg24(spark, d):
    return own(metrics(spark, d), "spatial_diversity", "landing_entropy", "line_entropy", "landing_coverage")


CHAIN = f"{ORDERED}, tr AS (SELECT video, who, m0 AS a, macro AS b, count(*) AS n FROM ord WHERE m0 <> 'unknown' AND {KNOWN} GROUP BY ALL)"


@query("agg26_player_transitions", f"WITH {CHAIN} SELECT {BY}, a AS source, b AS target, n FROM tr")
def agg26(spark, d):
    r, order = profile.rally_order(strokes(spark, d), ["rally_key", "athlete"], "own")
    return profile.transitions(r.filter("_ok_own"), ["video_id"], order, "macro_type", fn.MACROS)


@query("agg26_bridged_transitions", f"WITH {STROKES}, kn AS (SELECT *, lag(macro) OVER (PARTITION BY video, rally ORDER BY k, id) AS m0 FROM st WHERE {KNOWN}), c AS (SELECT m0 AS a, macro AS b, count(*) AS n FROM kn WHERE m0 IS NOT NULL GROUP BY ALL), g AS (SELECT a, b FROM (SELECT unnest([{MACRO_LIST}]) AS a), (SELECT unnest([{MACRO_LIST}]) AS b)), x AS (SELECT g.a, g.b, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.a) AS t FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b) SELECT a AS from_macro, b AS to_macro, n, round(coalesce(n / nullif(t, 0), 0), 6) AS proportion FROM x")
def agg26b(spark, d):
    return profile.bridged_transitions(strokes(spark, d)).withColumn("proportion", F.round("proportion", 6))


@query("agg27_sequence_predictability", f"WITH {CHAIN}, w AS (SELECT *, sum(n) OVER (PARTITION BY video, who, a) AS ra, sum(n) OVER (PARTITION BY video, who) AS tt FROM tr) SELECT {BY}, round(1 - sum(-(n / tt) * ln(n / ra)) / ln(6), 6) AS sequence_predictability FROM w GROUP BY video, who")
def agg27(spark, d):
    return own(metrics(spark, d), "sequence_predictability").filter("sequence_predictability is not null")


MACRO_COUNTS = f"{STROKES}, c AS (SELECT video, who, m.macro, count(*) FILTER (WHERE st.macro = m.macro) AS n FROM st CROSS JOIN (SELECT unnest([{MACRO_LIST}]) AS macro) m GROUP BY ALL), sh AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY video, who), 0) AS p, sum(n) OVER (PARTITION BY who, macro) / nullif(sum(n) OVER (PARTITION BY who), 0) AS q FROM c)"


@query("agg28_composition_divergence", f"WITH {MACRO_COUNTS} SELECT {BY}, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) / 2 ELSE 0 END), 6) AS jsd FROM sh GROUP BY video, who")
def agg28(spark, d):
    return profile.composition(metrics(spark, d))[0].select("video_id", "athlete", F.round("jsd_from_athlete_overall", 6).alias("jsd"))


@query("agg28_divergence_bits", f"WITH {STROKES}, c AS (SELECT video, m.macro, count(*) FILTER (WHERE st.macro = m.macro) AS n FROM st CROSS JOIN (SELECT unnest([{MACRO_LIST}]) AS macro) m GROUP BY ALL), sh AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY video), 0) AS p, sum(n) OVER (PARTITION BY macro) / sum(n) OVER () AS q FROM c) SELECT video AS video_id, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 6) AS jsd FROM sh GROUP BY video")
def agg28b(spark, d):
    return profile.group_profiles(strokes(spark, d), "video_id", "unknown").select("video_id", F.round("jsd_macro_to_overall", 6).alias("jsd"))


@query("agg29_composition_clr", f"WITH {MACRO_COUNTS} SELECT {BY}, macro, round(ln(n + 0.5::DOUBLE) - avg(ln(n + 0.5::DOUBLE)) OVER (PARTITION BY video, who), 6) AS clr FROM c")
def agg29(spark, d):
    clr = profile.composition(metrics(spark, d))[1]
    rows = F.array(*[F.struct(F.lit(m).alias("macro"), F.round(f"clr_{m}", 6).alias("clr")) for m in fn.MACROS])
    return clr.select("video_id", "athlete", F.explode(rows).alias("r")).select("video_id", "athlete", "r.*")


CONTEXT = f"{STROKES}, g AS (SELECT a, b FROM (SELECT unnest(['前场', '中场', '后场']) AS a), (SELECT unnest([{MACRO_LIST}]) AS b)), c AS (SELECT g.a, g.b, count(st.id) AS n FROM g LEFT JOIN st ON st.own_depth = g.a AND st.macro = g.b GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS t FROM c)"
DEPTH_ORDER = list(fn.DEPTHS[::-1])


@query("agg30_contingency", f"WITH {CONTEXT} SELECT CAST(max(t) AS BIGINT) AS n, round(sqrt(sum(CASE WHEN r * k > 0 THEN (n - r * k / t) ** 2 / (r * k / t) ELSE 0 END) / max(t) / 2), 6) AS v FROM m")
def agg30(spark, d):
    return profile.contingency(strokes(spark, d), "own_depth", DEPTH_ORDER).select("n", F.round("v", 6).alias("v"))


@query("agg31_row_proportions", f"WITH {CONTEXT} SELECT a AS own_depth, b AS macro_type, n, round(coalesce(n / nullif(r, 0), 0), 6) AS proportion FROM m")
def agg31(spark, d):
    return profile.context_profile(strokes(spark, d), "own_depth", DEPTH_ORDER).withColumn("proportion", F.round("proportion", 6))


@query("agg14_macro_profile", f"WITH {STROKES}, c AS (SELECT m.macro AS category, count(st.id) AS n FROM (SELECT unnest([{MACRO_LIST}]) AS macro) m LEFT JOIN st USING (macro) GROUP BY ALL) SELECT category, n AS count, round(n / sum(n) OVER (), 6) AS proportion FROM c")
def agg14(spark, d):
    return profile.category_profile(strokes(spark, d).filter("macro_type <> 'unknown'"), "macro_type", list(fn.MACROS)).withColumn("proportion", F.round("proportion", 6))


TWO = f"{STROKES}, me AS (SELECT video, who, {share(chr(39).join(['macro = ', '网前/前场', '']), KNOWN).replace(', 6)', ', 15)')} AS net_share, count(*) FILTER (WHERE own_depth = '后场') / nullif(count(own_depth), 0) AS backcourt_tendency, count(*) FILTER (WHERE {KNOWN}) AS n1, count(own_depth) AS n2 FROM st GROUP BY ALL), lo AS (SELECT video, who, 'net_share' AS metric, net_share AS value, n1 AS n, n1 < 50 AS low FROM me UNION ALL SELECT video, who, 'backcourt_tendency', backcourt_tendency, n2, n2 < 50 FROM me), de AS (SELECT video, metric, max(value) FILTER (WHERE who = 'focal') - max(value) FILTER (WHERE who = 'opponent') AS delta FROM lo GROUP BY ALL)"
PICKED = ("net_share", "backcourt_tendency")


def picked(spark, d) -> DataFrame:
    return profile.long_form(metrics(spark, d), ["video_id"], PICKED)


@query("agg32_metric_summary", f"WITH {TWO} SELECT metric, who AS athlete, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n_valid_matches, CAST(sum(n) AS BIGINT) AS n_observations, count(*) FILTER (WHERE low) AS low_n_matches, count(value) >= 18 AS main_eligible FROM lo GROUP BY metric, who")
def agg32(spark, d):
    return profile.summary(picked(spark, d)).select("metric", "athlete", *r6("mean", "median", "sd", "iqr", "min", "max"), "n_valid_matches", "n_observations", "low_n_matches", "main_eligible")


@query("agg33_paired_summary", f"WITH {TWO} SELECT metric, round(avg(delta), 6) AS paired_delta_mean, round(median(delta), 6) AS paired_delta_median, count(*) FILTER (WHERE delta > 0) AS n_positive, count(*) FILTER (WHERE delta = 0) AS n_equal, count(*) FILTER (WHERE delta < 0) AS n_negative, count(*) AS n_valid_matches, count(*) >= 18 AS main_eligible FROM de WHERE delta IS NOT NULL GROUP BY metric")
def agg33(spark, d):
    return profile.paired(profile.deltas(picked(spark, d))).select("metric", *r6("paired_delta_mean", "paired_delta_median"), "n_positive", "n_equal", "n_negative", "n_valid_matches", "main_eligible")


@query("agg34_tendency", f"WITH {TWO} SELECT metric, round(100 * (count(*) FILTER (WHERE delta > 0) + 0.5 * count(*) FILTER (WHERE delta = 0)) / count(*), 6) AS tendency_score FROM de WHERE delta IS NOT NULL GROUP BY metric")
def agg34(spark, d):
    return profile.paired(profile.deltas(picked(spark, d))).select("metric", *r6("tendency_score"))


@query("join14_focal_pairs", f"WITH {TWO} SELECT video AS video_id, metric, round(delta, 6) AS delta FROM de WHERE delta IS NOT NULL")
def join14(spark, d):
    return profile.deltas(picked(spark, d)).withColumn("delta", F.round("delta", 6))


DRAW = "('0x' || substr(md5('{seed}:' || rep || ':' || i), 1, 8))::BIGINT % k"


def boot(seed: str, reps: int, value: str) -> str:
    return f"o AS (SELECT metric, delta, row_number() OVER (PARTITION BY metric ORDER BY video) - 1 AS i, count(*) OVER (PARTITION BY metric) AS k FROM de WHERE delta IS NOT NULL), r AS (SELECT metric, rep, {DRAW.format(seed=seed)} AS pick FROM o CROSS JOIN range({reps}) t(rep)), es AS (SELECT r.metric, rep, {value} AS e FROM r JOIN o ON o.metric = r.metric AND o.i = r.pick GROUP BY ALL)"


@query("agg35_paired_interval", f"WITH {TWO}, {boot('paired', 10_000, 'avg(delta)')} SELECT metric, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high FROM es GROUP BY metric")
def agg35(spark, d):
    return resample.bootstrap(profile.deltas(picked(spark, d)), ["metric"], "delta", ["video_id"], "paired").select("metric", *r6("ci_low", "ci_high"))


@query("agg35_tendency_interval", f"WITH {TWO}, {boot('score', 10_000, '100 * avg(CASE WHEN delta > 0 THEN 1 WHEN delta = 0 THEN 0.5 ELSE 0 END)')} SELECT metric, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high FROM es GROUP BY metric")
def agg35s(spark, d):
    return resample.bootstrap(profile.deltas(picked(spark, d)), ["metric"], "delta", ["video_id"], "score", statistic=resample.tendency).select("metric", *r6("ci_low", "ci_high"))


@query("agg36_cluster_bootstrap", f"WITH {TWO}, cl AS (SELECT metric, 'op' || (CAST(substr(video, 5) AS INT) % 7) AS opponent, sum(delta) AS s, count(*) AS c FROM de WHERE delta IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY opponent) - 1 AS i, count(*) OVER (PARTITION BY metric) AS k FROM cl), r AS (SELECT metric, rep, {DRAW.format(seed='cluster')} AS pick FROM o CROSS JOIN range(10000) t(rep)), es AS (SELECT r.metric, rep, sum(s) / sum(c) AS e FROM r JOIN o ON o.metric = r.metric AND o.i = r.pick GROUP BY ALL) SELECT metric, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high FROM es GROUP BY metric")
def agg36(spark, d):
    dl = profile.deltas(picked(spark, d)).join(F.broadcast(matches(spark)), "video_id")
    return resample.cluster_bootstrap(dl, ["metric"], "opponent", "delta", "cluster").select("metric", *r6("ci_low", "ci_high"))


def blocks(spark, d, reps: int = 200):
    return resample.block_bootstrap(strokes(spark, d).withColumn("block", F.expr("cast(substring(rally_id, 2) as bigint) % 97")), ["block"], "own_depth", "macro_type", DEPTH_ORDER, list(fn.MACROS), "block", reps)


@query("agg37_block_bootstrap")
def agg37(spark, d):
    """Rally blocks are resampled 1 000 times by default; tested by brute force."""
    return resample.block_bootstrap(strokes(spark, d), ["video_id", "rally_id"], "own_depth", "macro_type", DEPTH_ORDER, list(fn.MACROS), "block", 200)[0]


@query("agg37_association_interval")
def agg37v(spark, d):
    return blocks(spark, d)[1]


@query("agg38_context_contrasts")
def agg38(spark, d):
    return resample.contrasts(blocks(spark, d)[2], "own_depth", "macro_type", [("后场", "前场"), ("后场", "中场")])


@query("agg39_display_scores", f"WITH {TWO}, e AS (SELECT metric, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM lo GROUP BY metric) SELECT {BY}, metric, CASE WHEN value IS NULL THEN NULL WHEN abs(e.hi - e.lo) < 1e-12 THEN 50 ELSE round(greatest(0, least(1, (value - e.lo) / (e.hi - e.lo))) * 100, 5) END AS display_score FROM lo JOIN e USING (metric)")
def agg39(spark, d):
    rows = picked(spark, d)
    return profile.display_scores(rows, rows).select("video_id", "athlete", "metric", F.round("display_score", 5).alias("display_score"))


@query("agg40_leave_one_match_out", f"WITH {TWO}, x AS (SELECT metric, (sum(delta) OVER w - delta) / nullif(count(*) OVER w - 1, 0) AS rest, avg(delta) OVER w AS m FROM de WHERE delta IS NOT NULL WINDOW w AS (PARTITION BY metric)) SELECT metric, round(min(rest), 6) AS low, round(max(rest), 6) AS high, coalesce(bool_and((CASE WHEN abs(rest) <= 1e-12 THEN 0 WHEN rest > 0 THEN 1 ELSE -1 END) = (CASE WHEN abs(m) <= 1e-12 THEN 0 WHEN m > 0 THEN 1 ELSE -1 END)), false) AS stable FROM x GROUP BY metric")
def agg40(spark, d):
    return profile.leave_one_out(profile.deltas(picked(spark, d))).select("metric", *r6("low", "high"), "stable")


@query("agg41_next_class_accuracy", f"WITH {CHAIN}, al AS (SELECT who, a, b, sum(n) AS n FROM tr GROUP BY ALL), v AS (SELECT DISTINCT video FROM st), re AS (SELECT v.video, al.who, al.a, al.b, al.n - coalesce(tr.n, 0) AS n FROM v CROSS JOIN al LEFT JOIN tr ON tr.video = v.video AND tr.who = al.who AND tr.a = al.a AND tr.b = al.b), pi AS (SELECT *, row_number() OVER (PARTITION BY video, who, a ORDER BY n DESC, b) AS k FROM re WHERE n > 0), g AS (SELECT tr.video, tr.who, sum(tr.n) AS n, sum(CASE WHEN tr.b = pi.b THEN tr.n ELSE 0 END) AS ok FROM tr JOIN pi ON pi.k = 1 AND pi.video = tr.video AND pi.who = tr.who AND pi.a = tr.a GROUP BY ALL) SELECT v.video AS video_id, w.who AS athlete, round(ok / nullif(n, 0), 6) AS accuracy, CAST(coalesce(n, 0) AS BIGINT) AS n FROM v CROSS JOIN (SELECT unnest(['focal', 'opponent']) AS who) w LEFT JOIN g ON g.video = v.video AND g.who = w.who")
def agg41(spark, d):
    return profile.next_class_accuracy(strokes(spark, d)).select("video_id", "athlete", F.round("sequence_predictability", 6).alias("accuracy"), F.col("sequence_predictability_n").alias("n"))


@query("agg42_sensitivity")
def agg42(spark, d):
    """All of S1 to S9; each variant's metrics have SQL of their own or brute-force tests."""
    return profile.sensitivity(strokes(spark, d), 1000)


@query("set08_variants", f"WITH {TWO} SELECT 'base' AS variant, metric, round(avg(delta), 6) AS value FROM de WHERE delta IS NOT NULL GROUP BY metric UNION ALL SELECT 'first half', metric, round(avg(delta), 6) FROM de WHERE delta IS NOT NULL AND CAST(substr(video, 5) AS INT) < 12 GROUP BY metric")
def set08(spark, d):
    dl = profile.deltas(picked(spark, d))
    half = profile.paired_mean(dl, matches(spark).filter("cast(substring(video_id, 5) as int) < 12"))
    return profile.paired_mean(dl).withColumn("variant", F.lit("base")).unionByName(half.withColumn("variant", F.lit("first half"))).select("variant", "metric", *r6("value"))


@query("agg43_match_profiles", f"WITH {STROKES}, c AS (SELECT video, count(*) AS n, count(*) FILTER (WHERE {KNOWN}) AS known FROM st GROUP BY video), m AS (SELECT video, macro, count(*) AS k, sum(count(*)) OVER (PARTITION BY video) AS t FROM st WHERE {KNOWN} GROUP BY video, macro) SELECT video AS video_id, c.n AS stroke_events, known AS classified_strokes, round((SELECT sum(-(k / t) * ln(k / t)) / ln(6) FROM m WHERE m.video = c.video), 6) AS entropy_macro FROM c")
def agg43(spark, d):
    return profile.group_profiles(strokes(spark, d), "video_id", "unknown").select("video_id", "stroke_events", "classified_strokes", *r6("entropy_macro"))


@query("agg43_opponent_profiles", f"WITH {STROKES} SELECT opponent, count(DISTINCT video) AS matches, count(*) AS stroke_events, round(count(*) FILTER (WHERE macro = '吊球') / nullif(count(*) FILTER (WHERE {KNOWN}), 0), 6) AS drops FROM st GROUP BY opponent")
def agg43o(spark, d):
    return profile.group_profiles(strokes(spark, d), "opponent", "unknown").select("opponent", "matches", "stroke_events", F.round("吊球", 6).alias("drops"))


@query("srt04_top_opponents", f"WITH {STROKES} SELECT opponent, count(*) FILTER (WHERE {KNOWN}) AS classified_strokes FROM st GROUP BY opponent ORDER BY 2 DESC, 1 LIMIT 3")
def srt04(spark, d):
    return profile.top_groups(profile.group_profiles(strokes(spark, d), "opponent", "unknown"), "opponent", 3).select("opponent", "classified_strokes")


@query("agg63_overall", f"WITH {STROKES} SELECT count(DISTINCT video) AS video_count, count(DISTINCT opponent) AS opponent_count, count(DISTINCT (video, rally)) AS rally_count, count(*) AS stroke_events, count(*) FILTER (WHERE {KNOWN}) AS classified_strokes, count(own_depth) AS valid_own_position, count(zone) AS valid_landing FROM st")
def agg63(spark, d):
    return profile.overall(strokes(spark, d), "unknown").select("video_count", "opponent_count", "rally_count", "stroke_events", "classified_strokes", "valid_own_position", "valid_landing")


WIDE = RALLY.replace("coalesce(m1 = '后场进攻', false) OR coalesce(m2 = '后场进攻', false) AS att", "coalesce(m1 = '后场进攻' OR t1 = 'rush', false) OR coalesce(m2 = '后场进攻' OR t2 = 'rush', false) AS att").replace("lag(macro) OVER w AS m0", "lag(macro) OVER w AS m0, lead(stroke) OVER w AS t1, lead(stroke, 2) OVER w AS t2").replace("macro IN ('网前/前场', '高远/挑球', '平抽/推挡', '吊球')", "macro IN ('网前/前场', '高远/挑球', '平抽/推挡', '吊球') AND stroke <> 'rush'").replace("arg_max(macro, (k, t, id)) AS last_macro", "arg_max(CASE WHEN stroke = 'rush' THEN '后场进攻' ELSE macro END, (k, t, id)) AS last_macro")


@query("agg57_wide_attack", f"WITH {WIDE} SELECT {BY}, round(count(*) FILTER (WHERE entered) / nullif(count(*) FILTER (WHERE entry), 0), 6) AS attack_entry_proxy, round(count(*) FILTER (WHERE turned) / nullif(count(*) FILTER (WHERE defence), 0), 6) AS defense_to_attack_proxy, round(count(*) FILTER (WHERE last_macro = '后场进攻' AND last_who = who) / nullif(count(*) FILTER (WHERE last_macro <> 'unknown'), 0), 6) AS terminal_attack_event_share FROM ra GROUP BY video, who")
def agg57(spark, d):
    return own(metrics(spark, d, wide_attack=True), "attack_entry_proxy", "defense_to_attack_proxy", "terminal_attack_event_share")


@query("agg57_line_divisor", f"WITH {STROKES.replace('6.1::DOUBLE / 6)', '6.1::DOUBLE / 4)').replace('> 6.1::DOUBLE / 6 ', '> 6.1::DOUBLE / 4 ')}, ln_ AS ({entropy_sql('line', 3)}) SELECT {BY}, round(h, 6) AS line_entropy FROM ln_")
def agg57l(spark, d):
    return own(metrics(spark, d, divisor=4), "line_entropy").filter("line_entropy is not null")


@query("agg57_unknown_class", f"WITH {ORDERED}, tr AS (SELECT video, who, m0 AS a, macro AS b, count(*) AS n FROM ord WHERE m0 IS NOT NULL GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY video, who, a) AS ra, sum(n) OVER (PARTITION BY video, who) AS tt FROM tr), p AS (SELECT video, who, 1 - sum(-(n / tt) * ln(n / ra)) / ln(7) AS pr FROM w GROUP BY ALL) SELECT {BY}, round(count(*) FILTER (WHERE macro = '网前/前场') / count(*), 6) AS net_share, round(any_value(pr), 6) AS sequence_predictability FROM st LEFT JOIN p USING (video, who) GROUP BY video, who")
def agg57u(spark, d):
    return own(metrics(spark, d, with_unknown=True), "net_share", "sequence_predictability")


@query("agg57_raw_sequence", f"WITH {STROKES}, o AS (SELECT *, lag(stroke) OVER (PARTITION BY video, rally, who ORDER BY k, t, id) AS z FROM st), tr AS (SELECT video, who, z AS a, stroke AS b, count(*) AS n FROM o WHERE z NOT IN ('unknown', 'driven flight') AND stroke NOT IN ('unknown', 'driven flight') GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY video, who, a) AS ra, sum(n) OVER (PARTITION BY video, who) AS tt FROM tr) SELECT {BY}, round(1 - sum(-(n / tt) * ln(n / ra)) / ln(17), 6) AS sequence_predictability FROM w GROUP BY video, who")
def agg57r(spark, d):
    return own(metrics(spark, d, raw_sequence=True), "sequence_predictability").filter("sequence_predictability is not null")


@query("agg58_allowed_delta", f"WITH {TWO} SELECT metric, round(avg(delta), 6) AS value FROM de WHERE delta IS NOT NULL AND CAST(substr(video, 5) AS INT) < 12 GROUP BY metric")
def agg58(spark, d):
    allowed = matches(spark).filter("cast(substring(video_id, 5) as int) < 12")
    return profile.paired_mean(profile.deltas(picked(spark, d)), allowed).select("metric", *r6("value"))


RADAR = f"{STROKES}, kn AS (SELECT *, lead(macro) OVER w AS m1, lead(macro, 2) OVER w AS m2, lead(own_depth) OVER w AS d1 FROM st WHERE {KNOWN} WINDOW w AS (PARTITION BY video, who, rally ORDER BY k, t, id))"


@query("agg56_radar_metrics", f"WITH {RADAR} SELECT {BY}, round(count(*) FILTER (WHERE m1 = '后场进攻' AND macro IN ('网前/前场', '高远/挑球', '平抽/推挡', '吊球')) / nullif(count(*) FILTER (WHERE m1 IS NOT NULL AND macro IN ('网前/前场', '高远/挑球', '平抽/推挡', '吊球')), 0), 6) AS attack_build_proxy, round(count(*) FILTER (WHERE m1 IS NULL AND macro = '后场进攻') / nullif(count(*) FILTER (WHERE m1 IS NULL), 0), 6) AS attack_finish_proxy, round(count(*) FILTER (WHERE macro = '高远/挑球' AND (m1 = '后场进攻' OR m2 = '后场进攻')) / nullif(count(*) FILTER (WHERE macro = '高远/挑球'), 0), 6) AS defense_to_attack_proxy, round(count(*) FILTER (WHERE macro = '网前/前场' AND m1 IS NOT NULL AND d1 IN ('前场', '中场')) / nullif(count(*) FILTER (WHERE macro = '网前/前场' AND m1 IS NOT NULL), 0), 6) AS net_continuation_proxy, round(count(*) FILTER (WHERE k <= 3 AND macro IN ('后场进攻', '网前/前场', '平抽/推挡')) / nullif(count(*) FILTER (WHERE k <= 3), 0) - count(*) FILTER (WHERE macro IN ('后场进攻', '网前/前场', '平抽/推挡')) / count(*), 6) AS first_three_bias FROM kn GROUP BY video, who")
def agg56(spark, d):
    return profile.radar_metrics(strokes(spark, d)).filter("classified_strokes > 0").select("video_id", "athlete", *r6("attack_build_proxy", "attack_finish_proxy", "defense_to_attack_proxy", "net_continuation_proxy", "first_three_bias"))


@query("agg59_radar_aggregate", f"WITH {TWO}, o AS (SELECT who, metric, value, row_number() OVER (PARTITION BY who, metric ORDER BY video) - 1 AS i, count(*) OVER (PARTITION BY who, metric) AS k FROM lo WHERE value IS NOT NULL), r AS (SELECT who, metric, rep, {DRAW.format(seed='radar')} AS pick FROM o CROSS JOIN range(1000) t(rep)), es AS (SELECT r.who, r.metric, rep, avg(value) AS e FROM r JOIN o ON o.who = r.who AND o.metric = r.metric AND o.i = r.pick GROUP BY ALL), ci AS (SELECT who, metric, quantile_cont(e, 0.025) AS lo_, quantile_cont(e, 0.975) AS hi_ FROM es GROUP BY ALL) SELECT who AS athlete, metric, round(avg(value), 6) AS raw_mean, round(median(value), 6) AS raw_median, round(any_value(lo_), 6) AS ci_low, round(any_value(hi_), 6) AS ci_high, count(*) AS n_total_matches, count(value) AS n_valid_matches, CAST(sum(n) AS BIGINT) AS n_observations FROM lo LEFT JOIN ci USING (who, metric) GROUP BY who, metric")
def agg59(spark, d):
    return profile.radar_aggregate(picked(spark, d)).select("athlete", "metric", *r6("raw_mean", "raw_median", "ci_low", "ci_high"), "n_total_matches", "n_valid_matches", "n_observations")


@query("flt14_valid_matches", f"WITH {STROKES}, c AS (SELECT video, who, count(zone) AS v, count(*) AS n FROM st GROUP BY ALL) SELECT video AS video_id FROM c GROUP BY video HAVING count(*) = 2 AND bool_and(v >= 50 AND v / n >= 0.3)")
def flt14(spark, d):
    return profile.complete_cases(metrics(spark, d))


@query("flt18_locked_counts", f"WITH {STROKES} SELECT count(DISTINCT video) AS matches, count(DISTINCT (video, who)) AS match_player_rows, count(*) FILTER (WHERE who = 'focal') AS focal_events, count(*) FILTER (WHERE who = 'focal' AND {KNOWN}) AS focal_classified, count(DISTINCT (video, rally)) FILTER (WHERE who = 'focal') AS focal_rallies, count(zone) FILTER (WHERE who = 'focal') AS focal_valid_landing, count(*) AS valid_side_events FROM st")
def flt18(spark, d):
    e = strokes(spark, d)
    return profile.locked_counts(profile.player_metrics(e), e).select("matches", "match_player_rows", "focal_events", "focal_classified", "focal_rallies", "focal_valid_landing", "valid_side_events")


@query("win44_phase", f"WITH {STROKES} SELECT phase, count(*) AS n FROM st GROUP BY phase")
def win44(spark, d):
    return strokes(spark, d).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("win45_rally_order", f"WITH {STROKES}, dup AS (SELECT video, rally, count(*) OVER (PARTITION BY video, rally, k, t, id) AS n FROM st) SELECT video AS video_id, rally AS rally_id, max(n) = 1 AS valid FROM dup GROUP BY ALL")
def win45(spark, d):
    r, _ = profile.rally_order(strokes(spark, d), ["rally_key"], "all")
    return r.groupBy("video_id", "rally_id").agg(F.bool_and("_ok_all").alias("valid"))


@query("join13_match_dim", f"WITH {STROKES} SELECT opponent, count(*) AS n FROM st GROUP BY opponent")
def join13(spark, d):
    return strokes(spark, d).groupBy("opponent").agg(F.count(F.lit(1)).alias("n"))


@query("set05_distinct_events", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS e FROM lineitem)")
def set05(spark, d):
    return profile.distinct_events(raw(spark, d), ["video_id", "event_id"]).agg(F.count(F.lit(1)).alias("n"))


@query("set06_leave_out", "SELECT DISTINCT l_orderkey % 24 AS m FROM lineitem WHERE l_orderkey % 24 NOT IN (SELECT l_orderkey % 24 FROM lineitem WHERE l_orderkey % 24 < 3)")
def set06(spark, d):
    m = table(spark, d, "lineitem").select((F.col("l_orderkey") % 24).alias("m"))
    return m.exceptAll(m.filter("m < 3")).distinct()


@query("scl06_depth_zone", f"WITH {STROKES} SELECT side, own_depth AS depth, count(*) AS n FROM st GROUP BY ALL")
def scl06(spark, d):
    return strokes(spark, d).groupBy(F.col("player_side").alias("side"), F.col("own_depth").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("scl08_zone9", f"WITH {STROKES} SELECT zone, count(*) AS n FROM st GROUP BY ALL")
def scl08(spark, d):
    return strokes(spark, d).groupBy(F.col("landing_zone9").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("scl09_line_class", f"WITH {STROKES} SELECT line, count(*) AS n FROM st GROUP BY ALL")
def scl09(spark, d):
    return strokes(spark, d).groupBy(F.col("line_class").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("scl10_macro_map", f"WITH {STROKES} SELECT stroke, macro, count(*) AS n FROM st GROUP BY ALL")
def scl10(spark, d):
    return strokes(spark, d).groupBy(F.col("stroke_type").alias("stroke"), F.col("macro_type").alias("macro")).agg(F.count(F.lit(1)).alias("n"))
