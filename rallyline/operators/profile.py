"""Match analysis: normalised strokes, metrics by match and athlete, comparisons, sensitivity.

Strokes are rows of one match (video_id) and athlete. Every metric follows from two
groupings: strokes by rally, with windows for neighbours in it, and rallies by match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import (
    COURT_L, COURT_W, DEPTHS, LINES, MACRO_OF, MACROS, UNKNOWN, ZONES, depth_zone, inside, line_class, macro_of, number, opposite, phase, ratio, sign_of, whole, width_zone, zone9,
)
from rallyline.operators import resample

FOCAL, OTHER = "focal", "opponent"
#: Names of classes that the metrics count, and least observations.
NET, ATTACK, DRIVE = MACROS[1], MACROS[2], MACROS[4]
SMASHES, DROPS = ("smash", "wrist smash"), ("drop", "passive drop")
ACTIVE = (MACROS[2], MACROS[1], MACROS[4])
NEUTRAL = (MACROS[1], MACROS[3], MACROS[4], MACROS[5])
DEFENCE = (MACROS[3],)
STYLE = ("smash_share", "drop_share", "net_share", "drive_share", "backcourt_tendency", "event_rate_proxy", "spatial_diversity", "sequence_predictability")
PROCESS = ("early_active_share", "attack_entry_proxy", "terminal_attack_event_share", "net_continuation_proxy", "defense_to_attack_proxy")
AUXILIARY = ("long_rally_share_10", "long_rally_share_8", "long_rally_share_12", "landing_entropy", "line_entropy", "landing_coverage", "classified_rate")
METRICS = STYLE + PROCESS + AUXILIARY
LOW_N = {
    "smash_share": 50, "drop_share": 50, "net_share": 50, "drive_share": 50, "backcourt_tendency": 50, "event_rate_proxy": 30, "spatial_diversity": 50,
    "sequence_predictability": 50, "early_active_share": 50, "attack_entry_proxy": 20, "terminal_attack_event_share": 20, "net_continuation_proxy": 20, "defense_to_attack_proxy": 20,
}
LEAST_MATCHES = 18
#: Columns of strokes that the metrics look at.
STROKE = ("video_id", "opponent", "athlete", "rally_key", "event_id", "stroke_index", "hit_time", "stroke_type", "macro_type", "own_depth", "own_x", "landing_x", "landing_zone9", "line_class")
AXES = {"own_x": ("player_location_x", COURT_W), "own_y": ("player_location_y", COURT_L), "opponent_x": ("opponent_location_x", COURT_W), "opponent_y": ("opponent_location_y", COURT_L), "landing_x": ("landing_x", COURT_W), "landing_y": ("landing_y", COURT_L)}


def distinct_events(raw: DataFrame, key: list[str]) -> DataFrame:
    """Identical repeats of a key go; rows that share a key and differ raise an error. Rows are dealt out once, by key."""
    rows = raw.repartition(*key).dropDuplicates()
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    clash = F.when(n > 1, F.raise_error(F.concat(F.lit("inconsistent duplicate event: "), F.concat_ws(":", *key))).cast("int")).otherwise(F.lit(1))
    return rows.withColumn("_ok", clash).filter("_ok = 1").drop("_ok")


def normalise(raw: DataFrame, matches: DataFrame, nulling: bool = True, focal_only: bool = False, unmapped: str = UNKNOWN) -> DataFrame:
    """Strokes of the sides upper and lower: numbers cast, places off the court nulled, classes, zones and lines.

    ``raw`` has text columns and video_id; ``matches`` (video_id, focal_side, opponent,
    competition) is a small table. The older forms keep places as they are (``nulling``
    false), take the focal side only, and name rallies without an id after the event.
    """
    side = F.lower(F.trim(F.coalesce("player", F.lit(""))))
    rows = raw.withColumn("player_side", side).filter(F.col("player_side").isin("upper", "lower"))
    stray = F.concat_ws(":", "video_id", F.lit("row"), F.col("row_number") if "row_number" in raw.columns else F.xxhash64(*raw.columns))
    rows = rows.withColumn("event_id", F.coalesce(F.nullif(F.trim("event_id"), F.lit("")), stray))
    if nulling:
        rows = distinct_events(rows, ["video_id", "event_id"])
    rows = rows.join(F.broadcast(matches.select("video_id", F.lower(F.trim("focal_side")).alias("focal_side"), "opponent", "competition")), "video_id")
    if focal_only:
        rows = rows.filter(F.col("player_side") == F.col("focal_side"))
    rows = rows.withColumns({f"_{n}": number(F.col(c)) for n, (c, _) in AXES.items()})
    values = {n: (inside(F.col(f"_{n}"), limit) if nulling else F.col(f"_{n}")) for n, (_, limit) in AXES.items()}
    stroke = F.lower(F.trim(F.coalesce(F.nullif("stroke_type", F.lit("")), F.lit(UNKNOWN))))
    rally = F.nullif(F.trim(F.coalesce("rally_id", F.lit(""))), F.lit(""))
    rally = rally if nulling else F.coalesce(rally, F.concat(F.lit("event-"), F.col("event_id")))
    rows = rows.select(
        "video_id", "opponent", "competition", "focal_side", "player_side", F.when(F.col("player_side") == F.col("focal_side"), FOCAL).otherwise(OTHER).alias("athlete"), "event_id",
        F.coalesce(rally, F.lit("")).alias("rally_id"), F.when(rally.isNotNull(), F.concat_ws("::", "video_id", rally)).alias("rally_key"), whole(F.col("stroke_index")).alias("stroke_index"),
        number(F.col("hit_time")).alias("hit_time"), F.coalesce(F.nullif(stroke, F.lit("")), F.lit(UNKNOWN)).alias("stroke_type"), *[v.alias(n) for n, v in values.items()],
    )
    macro = macro_of(F.col("stroke_type"))
    rows = rows.withColumn("macro_type", F.when(macro == UNKNOWN, unmapped).otherwise(macro))
    own, far = F.col("player_side"), opposite(F.col("player_side"))
    rows = rows.withColumns({
        "own_depth": depth_zone(own, F.col("own_y")), "opponent_depth": depth_zone(far, F.col("opponent_y")), "own_width": width_zone(F.col("own_x")), "opponent_width": width_zone(F.col("opponent_x")),
        "landing_zone9": zone9(depth_zone(far, F.col("landing_y")), width_zone(F.col("landing_x"))), "line_class": line_class(F.col("own_x"), F.col("landing_x")), "phase": phase(F.col("stroke_index")),
    })
    return rows.withColumns({"own_zone9": zone9(F.col("own_depth"), F.col("own_width")), "opponent_zone9": zone9(F.col("opponent_depth"), F.col("opponent_width"))})


def audit(raw: DataFrame) -> DataFrame:
    """One row: rows in all, rows of no side, and how many of the others lack or misplace what."""
    good = F.lower(F.trim(F.coalesce("player", F.lit("")))).isin("upper", "lower")
    off = lambda c, limit: good & number(F.col(c)).isNotNull() & inside(number(F.col(c)), limit).isNull()
    blank = lambda c: good & (F.trim(F.coalesce(c, F.lit(""))) == "")
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(~good).alias("non_upper_lower_player"), *[F.count_if(off(c, limit)).alias(f"invalid_{n}") for n, (c, limit) in AXES.items()],
        F.count_if(blank("event_id")).alias("missing_event_id"), F.count_if(blank("rally_id")).alias("missing_rally_id"),
        F.count_if(good & whole(F.col("stroke_index")).isNull()).alias("missing_stroke_index"), F.count_if(good & number(F.col("hit_time")).isNull()).alias("missing_hit_time"),
    )


def rally_order(df: DataFrame, key: list[str], tag: str) -> tuple[DataFrame, list[Column]]:
    """With ``_ok_<tag>`` (whether the group can be ordered: all have an index, or all a time, none repeats) and the order."""
    w = Window.partitionBy(*key)
    by_index, by_time = F.bool_and(F.col("stroke_index").isNotNull()).over(w), F.bool_and(F.col("hit_time").isNotNull()).over(w)
    same = F.count(F.lit(1)).over(Window.partitionBy(*key, "stroke_index", "hit_time", "event_id"))
    df = df.withColumn(f"_i_{tag}", by_index).withColumn(f"_t_{tag}", by_time).withColumn("_same", same)
    df = df.withColumn(f"_ok_{tag}", (F.col(f"_i_{tag}") | F.col(f"_t_{tag}")) & (F.max("_same").over(w) == 1)).drop("_same", f"_t_{tag}")
    late = F.when((F.col("hit_time").isNull()) | (F.col("hit_time") == 0), math.inf).otherwise(F.col("hit_time"))
    return df, [F.when(F.col(f"_i_{tag}"), F.col("stroke_index")), F.when(F.col(f"_i_{tag}"), late).otherwise(F.col("hit_time")), F.col("event_id")]


def entropy_of(counts: list[Column], categories: int) -> Column:
    """Normalised entropy of counts over a fixed number of categories, null without any."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return F.when(total > 0, sum(terms[1:], terms[0]) / math.log(categories))


def transitions(ordered: DataFrame, keys: list[str], order: list[Column], value: str, categories: tuple[str, ...]) -> DataFrame:
    """Counts (source, target) of neighbouring strokes of an athlete's rally, both among the categories."""
    w = Window.partitionBy("rally_key", "athlete").orderBy(*order)
    return pair_counts(ordered.select(*keys, "athlete", F.lag(value).over(w).alias("source"), F.col(value).alias("target")), keys, categories)


def pair_counts(pairs: DataFrame, keys: list[str], categories: tuple[str, ...]) -> DataFrame:
    return pairs.filter(F.col("source").isin(*categories) & F.col("target").isin(*categories)).groupBy(*keys, "athlete", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def predictability(pairs: DataFrame, keys: list[str], categories: int) -> DataFrame:
    """1 - H(target | source) / ln(categories), and the number of pairs."""
    own = Window.partitionBy(*keys, "athlete")
    t = pairs.withColumn("_r", F.sum("n").over(Window.partitionBy(*keys, "athlete", "source"))).withColumn("_t", F.sum("n").over(own))
    h = F.sum(-(F.col("n") / F.col("_t")) * F.ln(F.col("n") / F.col("_r")))
    return t.groupBy(*keys, "athlete").agg((1 - h / math.log(categories)).alias("sequence_predictability"), F.sum("n").alias("sequence_predictability_n"))


def neighbours(events: DataFrame) -> DataFrame:
    """Strokes of rallies with the classes before and after them of the same athlete, the rally's size, times and last stroke, and whether rally and athlete can be ordered."""
    r, all_order = rally_order(events.filter(F.col("rally_key").isNotNull()), ["rally_key"], "all")
    r, own_order = rally_order(r, ["rally_key", "athlete"], "own")
    w_all = Window.partitionBy("rally_key")
    last = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(all_order)], F.col("macro_type"), F.col("stroke_type"), F.col("athlete").alias("who"))).over(w_all)
    r = r.withColumn("_n", F.count(F.lit(1)).over(w_all)).withColumn("_times", F.count("hit_time").over(w_all)).withColumn("_span", F.max("hit_time").over(w_all) - F.min("hit_time").over(w_all)).withColumn("_last", last)
    w = Window.partitionBy("rally_key", "athlete").orderBy(*own_order)
    beside = {f"_{tag}{k}": F.lead(c, k).over(w) for tag, c in (("m", "macro_type"), ("s", "stroke_type")) for k in (1, 2)}
    r = r.withColumns(beside | {"_m0": F.lag("macro_type").over(w), "_s0": F.lag("stroke_type").over(w)})
    return r.select("video_id", "athlete", "rally_key", "macro_type", "stroke_type", "_n", "_times", "_span", "_last.macro_type", "_last.stroke_type", "_last.who", *beside, "_m0", "_s0", "_ok_all", "_ok_own").toDF(
        "video_id", "athlete", "rally_key", "macro_type", "stroke_type", "_n", "_times", "_span", "_last_macro", "_last_stroke", "_last_who", *beside, "_m0", "_s0", "_ok_all", "_ok_own"
    )


def stroke_shares(events: DataFrame, keys: list[str], divisor: int = 6, with_unknown: bool = False) -> DataFrame:
    """Counts and shares of strokes per match and athlete that need no order."""
    e = events
    if divisor != 6:
        e = e.withColumn("line_class", line_class(F.col("own_x"), F.col("landing_x"), divisor))
    known = F.col("macro_type").isin(*MACROS)
    early = known & (F.col("stroke_index") <= 3)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    zone, line = [n(F.col("landing_zone9") == z) for z in ZONES], [n(F.col("line_class") == z) for z in LINES]
    classified, total = n(known), F.count(F.lit(1))
    base = total if with_unknown else classified
    smash, drop = (n(F.col("stroke_type").isin(*names) & (F.lit(with_unknown) | known)) for names in (SMASHES, DROPS))
    position, landing, lines = (n(F.col(c).isNotNull()) for c in ("own_depth", "landing_zone9", "line_class"))
    covered = sum((F.when(c > 0, 1).otherwise(0) for c in zone[1:]), F.when(zone[0] > 0, 1).otherwise(0))
    return e.groupBy(*keys, "athlete").agg(
        total.alias("stroke_events"), classified.alias("classified_strokes"), (total - classified).alias("unknown_strokes"), position.alias("valid_own_position"), landing.alias("valid_landing"),
        lines.alias("valid_line"), ratio(smash, base).alias("smash_share"), ratio(drop, base).alias("drop_share"),
        ratio(n(F.col("macro_type") == NET), base).alias("net_share"), ratio(n(F.col("macro_type") == DRIVE), base).alias("drive_share"),
        ratio(n(F.col("own_depth") == DEPTHS[0]), position).alias("backcourt_tendency"), entropy_of(zone, 9).alias("landing_entropy"), entropy_of(line, 3).alias("line_entropy"),
        ratio(covered, F.lit(9)).alias("landing_coverage"), ratio(n(early & F.col("macro_type").isin(*ACTIVE)), n(early)).alias("early_active_share"),
        n(early).alias("early_active_share_n"), ratio(classified, total).alias("classified_rate"), *[n(F.col("macro_type") == m).alias(f"macro_{i + 1}_{m}") for i, m in enumerate(MACROS)],
    ).withColumn("spatial_diversity", (F.col("landing_entropy") + F.col("line_entropy")) / 2)


def rally_metrics(ahead: DataFrame, keys: list[str], wide_attack: bool = False) -> DataFrame:
    """Rates, successes and ends of rallies per match and athlete, out of ``neighbours``."""
    own = [*keys, "athlete"]
    hits = lambda m, s: F.coalesce((m == ATTACK) | (F.lit(wide_attack) & (s == "rush")), F.lit(False))
    follows = F.coalesce(F.col("_m1") != UNKNOWN, F.lit(False)) | F.coalesce(F.col("_m2") != UNKNOWN, F.lit(False))
    attacks = hits(F.col("_m1"), F.col("_s1")) | hits(F.col("_m2"), F.col("_s2"))
    nets = F.coalesce(F.col("_m1") == NET, F.lit(False)) | F.coalesce(F.col("_m2") == NET, F.lit(False))
    entry = follows & F.col("macro_type").isin(*NEUTRAL) & ~hits(F.col("macro_type"), F.col("stroke_type"))
    defence, net = follows & F.col("macro_type").isin(*DEFENCE), follows & (F.col("macro_type") == NET)
    ended = F.col("_last_macro") != UNKNOWN
    finished = ended & (F.col("_last_who") == F.col("athlete")) & hits(F.col("_last_macro"), F.col("_last_stroke"))
    rally = ahead.filter("_ok_all and _ok_own").groupBy(*own, "rally_key").agg(
        F.count(F.lit(1)).alias("own"), F.max("_n").alias("n"), F.max("_times").alias("times"), F.max("_span").alias("span"), F.bool_or(ended).alias("ended"), F.bool_or(finished).alias("finished"), F.bool_or(entry).alias("entry"),
        F.bool_or(entry & attacks).alias("entered"), F.bool_or(defence).alias("defence"), F.bool_or(defence & attacks).alias("turned"), F.count_if(net).alias("net"), F.count_if(net & nets).alias("netted"),
    )
    timed = (F.col("times") >= 2) & (F.col("span") > 0)
    return rally.groupBy(*own).agg(
        F.median(F.when(timed, F.col("own") / F.col("span"))).alias("event_rate_proxy"), F.count_if(timed).alias("event_rate_proxy_n"), F.count_if((F.col("times") >= 2) & (F.col("span") <= 0)).alias("nonpositive_duration_rallies"),
        *[F.count_if(F.col("n") >= k).alias(f"_long{k}") for k in (8, 10, 12)], F.count_if("ended").alias("terminal_attack_event_share_n"), F.count_if("finished").alias("terminal_attack_events"),
        F.count_if("entry").alias("attack_entry_proxy_n"), F.count_if("entered").alias("attack_entry_successes"), F.count_if("defence").alias("defense_to_attack_proxy_n"),
        F.count_if("turned").alias("defense_to_attack_successes"), F.sum("net").alias("net_continuation_proxy_n"), F.sum("netted").alias("net_continuation_successes"), F.count(F.lit(1)).alias("_ordered"),
    ).withColumns({m: ratio(F.col(a), F.col(f"{m}_n")) for m, a in (
        ("attack_entry_proxy", "attack_entry_successes"), ("terminal_attack_event_share", "terminal_attack_events"), ("net_continuation_proxy", "net_continuation_successes"), ("defense_to_attack_proxy", "defense_to_attack_successes"),
    )})


def sequence_metrics(ahead: DataFrame, keys: list[str], with_unknown: bool = False, raw_sequence: bool = False) -> DataFrame:
    """Predictability of the next class per match and athlete, out of ``neighbours``."""
    before, value, classes = ("_s0", "stroke_type", tuple(sorted(MACRO_OF))) if raw_sequence else ("_m0", "macro_type", MACROS + ((UNKNOWN,) if with_unknown else ()))
    pairs = ahead.filter("_ok_all and _ok_own").select(*keys, "athlete", F.col(before).alias("source"), F.col(value).alias("target"))
    return predictability(pair_counts(pairs, keys, classes), keys, len(classes))


def player_metrics(events: DataFrame, keys: list[str] | None = None, wide_attack: bool = False, divisor: int = 6, with_unknown: bool = False, raw_sequence: bool = False, ahead: DataFrame | None = None) -> DataFrame:
    """A wide row per match and athlete: 20 metrics, the number behind each (``_n``) and whether it is low (``_low_n``).

    ``keys`` are the match's columns; none pools all matches. Variants change one rule: an
    attack may be a rush too, lines have another divisor, unknown strokes are a seventh
    class, sequences are of raw strokes. ``ahead`` are the events' ``neighbours``, if they are there.
    """
    keys = ["video_id"] if keys is None else keys
    own = [*keys, "athlete"]
    ahead = neighbours(events) if ahead is None else ahead
    flat = stroke_shares(events, keys, divisor, with_unknown)
    rallies = events.select(*own, "rally_key").distinct().groupBy(*own).agg(F.count("rally_key").alias("rally_count"))
    out = flat.join(rallies, own).join(rally_metrics(ahead, keys, wide_attack), own, "left").join(sequence_metrics(ahead, keys, with_unknown, raw_sequence), own, "left")
    counts = [
        "event_rate_proxy_n", "nonpositive_duration_rallies", "_long8", "_long10", "_long12", "terminal_attack_event_share_n", "terminal_attack_events", "attack_entry_proxy_n", "attack_entry_successes",
        "defense_to_attack_proxy_n", "defense_to_attack_successes", "net_continuation_proxy_n", "net_continuation_successes", "_ordered", "sequence_predictability_n",
    ]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    c = F.col
    out = out.withColumns({
        "invalid_order_rallies": c("rally_count") - c("_ordered"),
        **{f"long_rally_share_{k}": ratio(c(f"_long{k}"), c("rally_count")) for k in (8, 10, 12)}, **{f"long_rally_share_{k}_n": c("rally_count") for k in (8, 10, 12)},
        **{f"{m}_n": c("classified_strokes") for m in ("smash_share", "drop_share", "net_share", "drive_share")}, "backcourt_tendency_n": c("valid_own_position"),
        "spatial_diversity_n": F.least("valid_landing", "valid_line"), "landing_entropy_n": c("valid_landing"), "line_entropy_n": c("valid_line"), "landing_coverage_n": c("valid_landing"), "classified_rate_n": c("stroke_events"),
    })
    low = {f"{m}_low_n": (c(f"{m}_n") < LOW_N[m]) if m in LOW_N else F.lit(False) for m in METRICS}
    return out.withColumns(low).drop("_long8", "_long10", "_long12", "_ordered")


def long_form(wide: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """(keys, athlete, metric, value, n, low_n), a row per metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_n").cast("long").alias("n"), F.col(f"{m}_low_n").alias("low_n")) for m in metrics])
    return wide.select(*keys, "athlete", F.explode(rows).alias("r")).select(*keys, "athlete", "r.*")


def summary(long: DataFrame) -> DataFrame:
    """Per metric and athlete over matches: mean, median, spread, range, counts, and whether there are enough matches."""
    x = F.col("value")
    got = long.filter(x.isNotNull()).groupBy("metric", "athlete").agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("sd"), (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias("iqr"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.count(F.lit(1)).alias("n_valid_matches"), F.sum("n").alias("n_observations"), F.count_if("low_n").alias("low_n_matches"),
    )
    out = long.select("metric", "athlete").distinct().join(got, ["metric", "athlete"], "left")
    out = out.na.fill(0, ["n_valid_matches", "n_observations", "low_n_matches"])
    return out.withColumn("main_eligible", F.col("n_valid_matches") >= LEAST_MATCHES)


def deltas(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(match, metric, delta): focal less opponent in matches where both have a value."""
    keys = keys or ["video_id"]
    d = long.groupBy(*keys, "metric").agg(F.max(F.when(F.col("athlete") == FOCAL, F.col("value"))).alias("_f"), F.max(F.when(F.col("athlete") == OTHER, F.col("value"))).alias("_o"))
    return d.filter(F.col("_f").isNotNull() & F.col("_o").isNotNull()).select(*keys, "metric", (F.col("_f") - F.col("_o")).alias("delta"))


def paired(d: DataFrame) -> DataFrame:
    """Per metric: mean and median difference, signs, tendency score."""
    x = F.col("delta")
    tendency = 100 * (F.count_if(x > 0) + 0.5 * F.count_if(x == 0)) / F.count(F.lit(1))
    out = d.groupBy("metric").agg(
        F.avg(x).alias("paired_delta_mean"), F.median(x).alias("paired_delta_median"), F.count_if(x > 0).alias("n_positive"), F.count_if(x == 0).alias("n_equal"), F.count_if(x < 0).alias("n_negative"),
        F.count(F.lit(1)).alias("n_valid_matches"), tendency.alias("tendency_score"),
    )
    return out.withColumn("main_eligible", F.col("n_valid_matches") >= LEAST_MATCHES)


def paired_mean(d: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Mean difference per metric, over the allowed matches (a table of video_id) if given."""
    if allowed is not None:
        d = d.join(allowed.select("video_id").distinct(), "video_id", "left_semi")
    return d.groupBy("metric").agg(F.avg("delta").alias("value"))


def paired_with_intervals(d: DataFrame, opponents: DataFrame, repetitions: int = resample.REPETITIONS) -> DataFrame:
    """``paired`` with bootstrap intervals of the mean, of the tendency score, and over opponents as clusters."""
    named = lambda df, p: df.withColumnsRenamed({"ci_low": f"{p}_ci_low", "ci_high": f"{p}_ci_high"})
    mean = resample.bootstrap(d, ["metric"], "delta", ["video_id"], "paired", repetitions)
    score = resample.bootstrap(d, ["metric"], "delta", ["video_id"], "score", repetitions, resample.tendency)
    grouped = d.join(F.broadcast(opponents.select("video_id", "opponent")), "video_id")
    cluster = resample.cluster_bootstrap(grouped, ["metric"], "opponent", "delta", "cluster", repetitions)
    return paired(d).join(named(mean, "paired_delta"), "metric").join(named(score, "tendency_score"), "metric").join(named(cluster, "cluster"), "metric")


def leave_one_out(d: DataFrame, allowed_metrics=STYLE + PROCESS) -> DataFrame:
    """Per metric, range and mean of the differences' mean without each match, and whether its sign never changes.

    Matches that have no value for a metric leave its mean as it is. With a single match
    there is nothing left and no sign.
    """
    w = Window.partitionBy("metric")
    d = d.filter(F.col("metric").isin(*allowed_metrics))
    rest = ratio(F.sum("delta").over(w) - F.col("delta"), F.count(F.lit(1)).over(w) - 1)
    rows = d.withColumn("rest", rest).withColumn("_m", F.avg("delta").over(w))
    same = F.bool_and(F.when(F.col("rest").isNotNull(), sign_of(F.col("rest")) == sign_of(F.col("_m"))))
    return rows.groupBy("metric").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.avg("rest").alias("mean"), F.coalesce(same, F.lit(False)).alias("stable"))


def next_class_accuracy(events: DataFrame) -> DataFrame:
    """Per match and athlete, how often the commonest next class of the athlete's other matches is right.

    Counts without a match are the total less its own; ties go to the first name.
    """
    r, order = rally_order(events.filter(F.col("rally_key").isNotNull()), ["rally_key", "athlete"], "own")
    return guessed_classes(transitions(r.filter("_ok_own"), ["video_id"], order, "macro_type", MACROS), events.select("video_id", "opponent").distinct())


def guessed_classes(own: DataFrame, opponents: DataFrame) -> DataFrame:
    """``next_class_accuracy`` of the matches' counted pairs; ``opponents`` has the matches, each with its opponents."""
    every = own.groupBy("athlete", "source", "target").agg(F.sum("n").alias("_all"))
    grid = opponents.select("video_id").distinct().join(every)
    rest = grid.join(own, ["video_id", "athlete", "source", "target"], "left").withColumn("_rest", F.col("_all") - F.coalesce("n", F.lit(0))).filter("_rest > 0")
    pick = rest.groupBy("video_id", "athlete", "source").agg(F.min(F.struct((-F.col("_rest")).alias("o"), F.col("target"))).alias("p")).select("video_id", "athlete", "source", F.col("p.target").alias("guess"))
    test = own.join(pick, ["video_id", "athlete", "source"])
    got = test.groupBy("video_id", "athlete").agg(F.sum("n").alias("sequence_predictability_n"), F.sum(F.when(F.col("guess") == F.col("target"), F.col("n")).otherwise(0)).alias("_right"))
    every_one = opponents.crossJoin(own.sparkSession.createDataFrame([(FOCAL,), (OTHER,)], "athlete string"))
    out = every_one.join(got, ["video_id", "athlete"], "left").na.fill(0, ["sequence_predictability_n", "_right"])
    return out.select("video_id", "opponent", "athlete", ratio(F.col("_right"), F.col("sequence_predictability_n")).alias("sequence_predictability"), "sequence_predictability_n")


def complete_cases(wide: DataFrame, least: int = 50, share: float = 0.30) -> DataFrame:
    """Matches in which both athletes have enough valid landings, in number and share."""
    ok = (F.col("valid_landing") >= least) & (F.col("valid_landing") / F.greatest("stroke_events", F.lit(1)) >= share)
    return wide.groupBy("video_id").agg(F.count(F.lit(1)).alias("_k"), F.bool_and(ok).alias("_ok")).filter("_k = 2 and _ok").select("video_id")


def composition(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Jensen-Shannon divergence of each match's classes from the athlete's, in nats, with the shares; centred log-ratios)."""
    names = [f"macro_{i + 1}_{m}" for i, m in enumerate(MACROS)]
    whole_ = wide.groupBy("athlete").agg(*[F.sum(n).alias(f"_o{i}") for i, n in enumerate(names)])
    t = wide.join(F.broadcast(whole_), "athlete")
    own = [ratio(F.col(n), sum((F.col(m) for m in names[1:]), F.col(names[0]))) for n in names]
    all_ = [ratio(F.col(f"_o{i}"), sum((F.col(f"_o{j}") for j in range(1, 6)), F.col("_o0"))) for i in range(6)]
    shares = t.select("video_id", "athlete", F.lit(None).cast("double").alias("jsd_from_athlete_overall"), *[p.alias(f"share_{m}") for p, m in zip(own, MACROS, strict=True)], *[q.alias(f"_q{i}") for i, q in enumerate(all_)])
    shares = shares.withColumn("jsd_from_athlete_overall", divergence([F.col(f"share_{m}") for m in MACROS], [F.col(f"_q{i}") for i in range(6)])).drop(*[f"_q{i}" for i in range(6)])
    logs = [F.ln(F.col(n) + 0.5) for n in names]
    middle = sum(logs[1:], logs[0]) / len(logs)
    return shares, t.select("video_id", "athlete", *[(v - middle).alias(f"clr_{m}") for v, m in zip(logs, MACROS, strict=True)])


def divergence(p: list[Column], q: list[Column], base: str = "e") -> Column:
    """Jensen-Shannon divergence of two distributions, in nats or bits (base "2"); null where one of them is."""
    log = F.ln if base == "e" else F.log2
    part = lambda a, b: F.when(a > 0, a * log(a / ((a + b) / 2)) / 2).when(a.isNotNull(), 0.0)
    terms = [part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)]
    return sum(terms[1:], terms[0])


def cramers_v(table: Column, rows: int, columns: int) -> Column:
    """Cramer's V of a dense table (array of rows), by the fixed numbers of rows and columns; 0 for an empty table."""
    cell = lambda i, j: F.get(F.get(table, i), j)
    r = [sum((cell(i, j) for j in range(1, columns)), cell(i, 0)) for i in range(rows)]
    c = [sum((cell(i, j) for i in range(1, rows)), cell(0, j)) for j in range(columns)]
    n = sum(r[1:], r[0])
    expected = lambda i, j: ratio(r[i] * c[j], n)
    terms = [F.coalesce(ratio((cell(i, j) - expected(i, j)) * (cell(i, j) - expected(i, j)), expected(i, j)), F.lit(0.0)) for i in range(rows) for j in range(columns)]
    chi = sum(terms[1:], terms[0])
    least = min(rows - 1, columns - 1)
    return F.coalesce(F.sqrt(ratio(chi, n) / least), F.lit(0.0)) if least > 0 else F.lit(0.0)


def contingency(events: DataFrame, context: str, contexts: list[str], category: str = "macro_type", categories=MACROS) -> DataFrame:
    """One row: the dense table of counts, its sum and Cramer's V."""
    cells = F.array(*[F.array(*[F.count_if((F.col(context) == r) & (F.col(category) == c)).cast("double") for c in categories]) for r in contexts])
    t = events.agg(cells.alias("table"))
    n = F.aggregate(F.flatten("table"), F.lit(0.0), lambda a, x: a + x)
    return t.select("table", n.cast("long").alias("n"), cramers_v(F.col("table"), len(contexts), len(categories)).alias("v"))


def context_profile(events: DataFrame, context: str, contexts: list[str], category: str = "macro_type", categories=MACROS) -> DataFrame:
    """Counts and row proportions (0 for an empty row) of each context and class, zero-filled."""
    spark = events.sparkSession
    grid = F.broadcast(spark.createDataFrame([(a, b) for a in contexts for b in categories], f"{context} string, {category} string"))
    counts = events.groupBy(context, category).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(counts, [context, category], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(context))
    return out.withColumn("proportion", F.coalesce(ratio(F.col("n"), total), F.lit(0.0)))


def category_profile(events: DataFrame, key: str, categories: list[str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Count and proportion of each category, zero-filled to the given ones."""
    rows = events.filter(F.col(key).isNotNull() & (F.col(key) != "") & ~F.col(key).isin(*drop)) if drop else events.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    counts = rows.groupBy(F.col(key).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_t"))
    if categories is not None:
        counts = events.sparkSession.createDataFrame([(c,) for c in categories], "category string").join(counts, "category", "left").na.fill(0, ["n"])
    return counts.crossJoin(F.broadcast(total)).select("category", F.col("n").alias("count"), F.coalesce(ratio(F.col("n"), F.col("_t")), F.lit(0.0)).alias("proportion"))


def bridged_transitions(events: DataFrame, categories=MACROS) -> DataFrame:
    """Dense counts and row proportions of neighbours once unknown strokes are left out (the older rule)."""
    known = events.filter(F.col("macro_type").isin(*categories))
    w = Window.partitionBy("video_id", "rally_id").orderBy(F.coalesce("stroke_index", F.lit(10**9)), "event_id")
    pairs = known.select(F.lag("macro_type").over(w).alias("from_macro"), F.col("macro_type").alias("to_macro")).filter("from_macro is not null")
    return context_profile(pairs, "from_macro", list(categories), "to_macro", categories)


def group_profiles(events: DataFrame, key: str, unmapped: str = "未分类") -> DataFrame:
    """Per match or opponent: counts, shares of the classes, entropy, and divergence in bits from all strokes."""
    counts = [F.count_if(F.col("macro_type") == m) for m in MACROS]
    base = events.groupBy(key).agg(
        F.count_distinct("video_id").alias("matches"), F.count(F.lit(1)).alias("stroke_events"), F.count_if(F.col("macro_type") != unmapped).alias("classified_strokes"),
        *[F.count(c).alias(n) for c, n in (("own_depth", "valid_own_position"), ("opponent_depth", "valid_opponent_position"), ("landing_zone9", "valid_landing"))], *[c.alias(f"_c{i}") for i, c in enumerate(counts)],
    )
    whole_ = base.agg(*[F.sum(f"_c{i}").alias(f"_o{i}") for i in range(6)])
    t = base.crossJoin(F.broadcast(whole_))
    total = sum((F.col(f"_c{i}") for i in range(1, 6)), F.col("_c0"))
    every = sum((F.col(f"_o{i}") for i in range(1, 6)), F.col("_o0"))
    own, all_ = [ratio(F.col(f"_c{i}"), total) for i in range(6)], [ratio(F.col(f"_o{i}"), every) for i in range(6)]
    out = t.withColumn("unclassified_strokes", F.col("stroke_events") - F.col("classified_strokes")).withColumn("entropy_macro", F.coalesce(entropy_of([F.col(f"_c{i}") for i in range(6)], 6), F.lit(0.0)))
    out = out.withColumn("jsd_macro_to_overall", divergence(own, all_, "2")).withColumns({m: F.coalesce(own[i], F.lit(0.0)) for i, m in enumerate(MACROS)})
    return out.drop(*[f"_{c}{i}" for c in "co" for i in range(6)])


def overall(events: DataFrame, unmapped: str = "未分类") -> DataFrame:
    """One row on all strokes of an athlete: distinct matches, opponents, rallies, valid places, medians over matches."""
    per = group_profiles(events, "video_id", unmapped)
    med = per.agg(F.median("jsd_macro_to_overall").alias("median_match_jsd"), F.median("entropy_macro").alias("median_match_entropy"))
    rally = F.when(F.col("rally_id") != "", F.struct("video_id", "rally_id"))
    counts = [F.count_if(F.col("macro_type") == m) for m in MACROS]
    own = events.agg(
        F.count_distinct("video_id").alias("video_count"), F.count_distinct("opponent").alias("opponent_count"), F.count_distinct(rally).alias("rally_count"), F.count(F.lit(1)).alias("stroke_events"),
        F.count_if(F.col("macro_type") != unmapped).alias("classified_strokes"), *[F.count(c).alias(n) for c, n in (("own_depth", "valid_own_position"), ("opponent_depth", "valid_opponent_position"), ("landing_zone9", "valid_landing"))],
        F.coalesce(entropy_of(counts, 6), F.lit(0.0)).alias("overall_macro_entropy"),
    )
    return own.crossJoin(F.broadcast(med))


def top_groups(profiles: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The groups with most classified strokes; equals by name."""
    return profiles.orderBy(F.col("classified_strokes").desc(), key).limit(n)


def radar_metrics(events: DataFrame) -> DataFrame:
    """The older metrics per match and side: sequences bridge unknown strokes, rates count opportunities."""
    own = ["video_id", "athlete"]
    order = [F.coalesce("stroke_index", F.lit(10**12)), F.coalesce("hit_time", F.lit(1e12)), F.col("event_id")]
    known = F.col("macro_type").isin(*MACROS)
    c = events.filter(known)
    w = Window.partitionBy(*own, "rally_id").orderBy(*order)
    c = c.withColumns({"_m1": F.lead("macro_type").over(w), "_m2": F.lead("macro_type", 2).over(w), "_d1": F.lead("own_depth").over(w)})
    hit = lambda x: F.coalesce(x == ATTACK, F.lit(False))
    more = F.col("_m1").isNotNull()
    build, guard, net = more & F.col("macro_type").isin(*NEUTRAL), F.col("macro_type").isin(*DEFENCE), more & (F.col("macro_type") == NET)
    early = F.col("stroke_index") <= 3
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    seq = c.groupBy(*own).agg(
        n(build).alias("attack_build_proxy_n"), n(build & hit(F.col("_m1"))).alias("_built"), n(~more & hit(F.col("macro_type"))).alias("_finished"), n(~more).alias("attack_finish_proxy_n"),
        n(guard).alias("defense_to_attack_proxy_n"), n(guard & (hit(F.col("_m1")) | hit(F.col("_m2")))).alias("_turned"), n(net).alias("net_continuation_proxy_n"),
        n(net & F.col("_d1").isin(DEPTHS[2], DEPTHS[1])).alias("_netted"), F.count(F.lit(1)).alias("classified_strokes"), n(F.col("macro_type").isin(*ACTIVE)).alias("_active"), n(early).alias("opening_forward_share_n"),
        n(early & F.col("macro_type").isin(*ACTIVE)).alias("_opened"), n(F.col("macro_type") == NET).alias("_net"), n(F.col("stroke_type").isin(*SMASHES)).alias("_smash"), n(F.col("stroke_type").isin(*DROPS)).alias("_drop"), n(F.col("macro_type") == DRIVE).alias("_drive"),
    )
    pairs = c.filter(more).groupBy(*own, F.col("macro_type").alias("source"), F.col("_m1").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    chain = predictability(pairs, ["video_id"], len(MACROS))
    whole_ = Window.partitionBy("video_id", "rally_id")
    r = events.withColumn("_all", F.count(F.lit(1)).over(whole_)).withColumn("_times", F.count("hit_time").over(whole_)).withColumn("_span", F.max("hit_time").over(whole_) - F.min("hit_time").over(whole_))
    r = r.groupBy(*own, "rally_id").agg(F.count(F.lit(1)).alias("_own"), F.max("_all").alias("_all"), F.max("_times").alias("_times"), F.max("_span").alias("_span"))
    timed = (F.col("_times") >= 2) & (F.col("_span") > 0)
    rally = r.groupBy(*own).agg(F.median(F.when(timed, F.col("_own") / F.col("_span"))).alias("rally_tempo"), F.count_if(timed).alias("rally_tempo_n"), ratio(F.count_if(F.col("_all") >= 10), F.count(F.lit(1))).alias("long_rally_share"), F.count(F.lit(1)).alias("rally_count"))
    zone, line = [n(F.col("landing_zone9") == z) for z in ZONES], [n(F.col("line_class") == z) for z in LINES]
    flat = events.groupBy(*own).agg(
        F.count(F.lit(1)).alias("stroke_events"), ratio(n(F.col("own_depth") == DEPTHS[0]), n(F.col("own_depth").isNotNull())).alias("backcourt_tendency"), entropy_of(zone, 9).alias("landing_entropy"),
        entropy_of(line, 3).alias("line_entropy"), (F.count_distinct("landing_zone9") / 9).alias("space_coverage_proxy"), n(F.col("landing_zone9").isNotNull()).alias("valid_landing"), n(F.col("line_class").isNotNull()).alias("valid_line"),
    )
    out = flat.join(rally, own).join(seq, own, "left").join(chain, own, "left")
    k = F.col
    of = lambda a, b: ratio(k(a), k(b))
    out = out.withColumns({
        "smash_share": of("_smash", "classified_strokes"), "drop_share": of("_drop", "classified_strokes"), "net_share": of("_net", "classified_strokes"), "drive_share": of("_drive", "classified_strokes"),
        "net_engagement": of("_net", "classified_strokes"), "initiative_proxy": of("_active", "classified_strokes"), "opening_forward_share": of("_opened", "opening_forward_share_n"),
        "attack_build_proxy": of("_built", "attack_build_proxy_n"), "attack_finish_proxy": of("_finished", "attack_finish_proxy_n"), "defense_to_attack_proxy": of("_turned", "defense_to_attack_proxy_n"),
        "net_continuation_proxy": of("_netted", "net_continuation_proxy_n"),
        "spatial_diversity": F.coalesce((k("landing_entropy") + k("line_entropy")) / 2, k("landing_entropy"), k("line_entropy")),
    })
    return out.withColumn("first_three_bias", k("opening_forward_share") - k("initiative_proxy")).drop("_built", "_finished", "_turned", "_netted", "_active", "_opened", "_net", "_smash", "_drop", "_drive")


def radar_aggregate(long: DataFrame, repetitions: int = 1000) -> DataFrame:
    """Per athlete and metric: mean, median, interval, valid and all matches, observations. ``long``: video_id, athlete, metric, value, n."""
    x = F.col("value")
    key = ["athlete", "metric"]
    out = long.groupBy(*key).agg(F.avg(x).alias("raw_mean"), F.median(x).alias("raw_median"), F.count(F.lit(1)).alias("n_total_matches"), F.count(x).alias("n_valid_matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_observations"))
    return out.join(resample.bootstrap(long, key, "value", ["video_id"], "radar", repetitions), key, "left")


def display_scores(values: DataFrame, reference: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Values placed between the 5 % and 95 % quantiles of the reference's, 0 to 100; 50 where they meet."""
    ends = reference.groupBy(metric).agg(F.percentile(value, F.lit(0.05)).alias("_lo"), F.percentile(value, F.lit(0.95)).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    score = F.when(F.col(value).isNull() | span.isNull(), None).when(F.abs(span) < 1e-12, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(value) - F.col("_lo"), span))) * 100)
    return values.join(F.broadcast(ends), metric, "left").withColumn("display_score", score).drop("_lo", "_hi")


def locked_counts(wide: DataFrame, events: DataFrame) -> DataFrame:
    """One row of the totals that a locked analysis compares with its constants."""
    f = F.col("athlete") == FOCAL
    total = lambda c: F.coalesce(F.sum(F.when(f, F.col(c))), F.lit(0))
    out = wide.agg(
        F.count_distinct("video_id").alias("matches"), F.count(F.lit(1)).alias("match_player_rows"), total("stroke_events").alias("focal_events"), total("classified_strokes").alias("focal_classified"),
        total("unknown_strokes").alias("focal_unknown"), total("rally_count").alias("focal_rallies"), total("valid_own_position").alias("focal_valid_position"), total("valid_landing").alias("focal_valid_landing"),
    )
    return out.crossJoin(F.broadcast(events.agg(F.count(F.lit(1)).alias("valid_side_events"))))


def assert_locked(counts: DataFrame, expected: dict[str, int]) -> None:
    """Raise unless the one row of counts has all expected values."""
    row = counts.first().asDict()
    wrong = {k: (v, row.get(k)) for k, v in expected.items() if row.get(k) != v}
    if wrong:
        raise ValueError(f"locked data counts changed (expected, found): {wrong}")


def sensitivity(events: DataFrame, repetitions: int = resample.REPETITIONS) -> DataFrame:
    """The checks S1 to S9 as one long table: metric, variant, both differences, sign, threshold, status.

    Strokes and their neighbours are worked out once and kept while the variants are counted,
    each in what its rule changes. What is left has a row per match, athlete and metric at most
    and is kept too, so that the checks join nothing else.
    """
    events = events.select(*STROKE).cache()
    ahead = neighbours(events).cache()
    base_wide = player_metrics(events, ahead=ahead).localCheckpoint()
    opponents = events.select("video_id", "opponent").distinct().localCheckpoint()
    base_long = long_form(base_wide, ["video_id"])
    d = deltas(base_long).localCheckpoint()
    base = paired_mean(d).withColumnRenamed("value", "base").localCheckpoint()
    main = STYLE + PROCESS

    def check(test: str, variant: str, values: DataFrame, metrics, ok: Column | None = None) -> DataFrame:
        rows = events.sparkSession.createDataFrame([(m,) for m in metrics], "metric string").join(F.broadcast(base), "metric", "left").join(values, "metric", "left")
        same = sign_of(F.col("value")) == sign_of(F.col("base"))
        near = F.coalesce(F.abs(F.col("value") - F.col("base")) <= 0.10, F.lit(False)) if ok is None else F.coalesce(ok, F.lit(False))
        rows = rows.withColumn("direction_consistent", same).withColumn("threshold_ok", near)
        status = F.when(F.col("direction_consistent") & F.col("threshold_ok"), "PASS").otherwise("FAIL")
        return rows.select(F.lit(test).alias("test"), "metric", F.lit(variant).alias("variant"), F.col("base").alias("base_paired_delta"), F.col("value").alias("variant_paired_delta"), "direction_consistent", "threshold_ok", status.alias("status"))

    def values(wide: DataFrame, *metrics: str, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return wide.select(*keys, "athlete", F.explode(rows).alias("r")).select(*keys, "athlete", "r.*")

    def variant(wide: DataFrame, *metrics: str) -> DataFrame:
        return paired_mean(deltas(values(wide, *metrics))).localCheckpoint()

    names = {"shares": ("smash_share", "drop_share", "net_share", "drive_share"), "chain": ("sequence_predictability",), "space": ("spatial_diversity",), "attack": ("attack_entry_proxy", "terminal_attack_event_share", "defense_to_attack_proxy")}
    pooled = stroke_shares(events, []).join(rally_metrics(ahead, []), "athlete", "left").join(sequence_metrics(ahead, []), "athlete", "left")
    p = values(pooled, *main, keys=()).localCheckpoint().groupBy("metric").agg((F.max(F.when(F.col("athlete") == FOCAL, F.col("value"))) - F.max(F.when(F.col("athlete") == OTHER, F.col("value")))).alias("value"))
    scale = F.greatest(F.abs(F.coalesce("base", F.lit(0.0))), F.abs(F.coalesce("value", F.lit(0.0))), F.lit(1e-12))
    off = F.abs(F.col("value") - F.col("base"))
    s1 = F.when(F.col("metric") == "event_rate_proxy", off / scale <= 0.20).otherwise(off <= 0.10)
    out = check("S1", "pooled_events", p, main, s1)
    seventh = variant(stroke_shares(events, ["video_id"], with_unknown=True), *names["shares"]).unionByName(variant(sequence_metrics(ahead, ["video_id"], with_unknown=True), *names["chain"]))
    out = out.unionByName(check("S2", "unknown_as_seventh", seventh, names["shares"] + names["chain"]))
    long10 = base.filter("metric = 'long_rally_share_10'").select(F.col("base").alias("base_paired_delta"))
    for k in (8, 12):
        v = base.filter(f"metric = 'long_rally_share_{k}'").select(F.col("base").alias("variant_paired_delta"))
        row = long10.crossJoin(F.broadcast(v)).withColumn("direction_consistent", sign_of(F.col("variant_paired_delta")) == sign_of(F.col("base_paired_delta")))
        row = row.select(F.lit("S3").alias("test"), F.lit("long_rally_share_10").alias("metric"), F.lit(f"threshold_{k}").alias("variant"), "base_paired_delta", "variant_paired_delta", "direction_consistent", F.lit(True).alias("threshold_ok"), F.lit("PASS").alias("status"))
        out = out.unionByName(row)
    for k in (8, 4):
        out = out.unionByName(check("S4", f"court_width_div_{k}", variant(stroke_shares(events, ["video_id"], divisor=k), *names["space"]), names["space"]))
    out = out.unionByName(check("S5", "raw_stroke_sequence", variant(sequence_metrics(ahead, ["video_id"], raw_sequence=True), *names["chain"]), names["chain"]))
    pairs = ahead.filter("_ok_own").select("video_id", "athlete", F.col("_m0").alias("source"), F.col("macro_type").alias("target"))
    guess = guessed_classes(pair_counts(pairs, ["video_id"], MACROS).localCheckpoint(), opponents).select("video_id", "athlete", F.lit("sequence_predictability").alias("metric"), F.col("sequence_predictability").alias("value"))
    out = out.unionByName(check("S5", "leave_one_match_out_next_class_accuracy", paired_mean(deltas(guess)).localCheckpoint(), names["chain"], F.col("value").isNotNull()))
    out = out.unionByName(check("S6", "attack_plus_rush", variant(rally_metrics(ahead, ["video_id"], wide_attack=True), *names["attack"]), names["attack"]))
    ahead.unpersist()
    events.unpersist()
    out = out.unionByName(check("S7", "complete_case", paired_mean(d, complete_cases(base_wide)), ("spatial_diversity",)))
    grouped = d.filter(F.col("metric").isin(*main)).join(opponents, "video_id")
    cluster = resample.cluster_bootstrap(grouped, ["metric"], "opponent", "delta", "cluster", repetitions).join(F.broadcast(base), "metric")
    lo, hi = sign_of(F.col("ci_low")), sign_of(F.col("ci_high"))
    ok = F.when((lo != 0) & (hi != 0), lo == hi).otherwise(True)
    out = out.unionByName(cluster.select(F.lit("S8").alias("test"), "metric", F.lit("opponent_cluster_bootstrap").alias("variant"), F.col("base").alias("base_paired_delta"), F.col("base").alias("variant_paired_delta"), F.lit(True).alias("direction_consistent"), ok.alias("threshold_ok"), F.when(ok, "PASS").otherwise("CAUTION").alias("status")))
    loo = leave_one_out(d).join(F.broadcast(base), "metric")
    return out.unionByName(loo.select(F.lit("S9").alias("test"), "metric", F.lit("leave_one_match_out").alias("variant"), F.col("base").alias("base_paired_delta"), F.col("mean").alias("variant_paired_delta"), F.col("stable").alias("direction_consistent"), F.col("stable").alias("threshold_ok"), F.when(F.col("stable"), "PASS").otherwise("FAIL").alias("status")))


def stability(checks: DataFrame) -> DataFrame:
    """STABLE or UNSTABLE per metric: a failed check, of those that count, makes it unstable."""
    counted = checks.filter(~F.col("test").isin("S3", "S8"))
    return counted.groupBy("metric").agg(F.when(F.bool_or(F.col("status") == "FAIL"), "UNSTABLE").otherwise("STABLE").alias("stability"))
