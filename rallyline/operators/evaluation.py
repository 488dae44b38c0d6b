"""Machine events against human gold: optimal matching, precision and recall, labels, landings, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.functions import bare_id, order_statistics, ratio, ratio0
from rallyline.operators import joins

TOLERANCES = (3, 5, 8, 10, 12, 15)


def compatible_ids(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs of identifiers, one of which begins with the other once ``vid_`` is taken off.

    Joined on as many first characters as the shortest identifier has.
    """
    a = a.select(F.col(x)).distinct().filter(F.length(bare_id(F.col(x))) > 0).withColumn("_a", bare_id(F.col(x)))
    b = b.select(F.col(y)).distinct().filter(F.length(bare_id(F.col(y))) > 0).withColumn("_b", bare_id(F.col(y)))
    least = a.select(F.length("_a").alias("n")).unionByName(b.select(F.length("_b").alias("n"))).agg(F.min("n").alias("_n"))
    a = a.crossJoin(F.broadcast(least)).withColumn("_k", F.expr("left(_a, _n)"))
    b = b.crossJoin(F.broadcast(least)).withColumn("_k", F.expr("left(_b, _n)"))
    return a.drop("_n").join(b.drop("_n"), "_k").filter(F.startswith(F.col("_a"), F.col("_b")) | F.startswith(F.col("_b"), F.col("_a"))).select(x, y)


def variants(tolerances=TOLERANCES, reaction: int = 0) -> Column:
    """Structs of tolerance and allowance, with and without the reaction."""
    kinds = sorted({(t, r) for t in tolerances for r in (0, reaction)})
    return F.array(*[F.struct(F.lit(t).cast("long").alias("tolerance"), F.lit(r).cast("long").alias("allowance")) for t, r in kinds])


def match(candidates: DataFrame, gold: DataFrame, tolerances=(5,), reaction: int = 0) -> DataFrame:
    """Optimal one-to-one matches: (tolerance, allowance, video, event_id, hit_frame, candidate_frame).

    ``candidates``: video, event_id, candidate_frame; ``gold``: video, hit_frame,
    uncertainty_frames. As many pairs as possible, then the least total error; a label's
    tolerance is the base one, its uncertainty and the reaction allowance together. Among
    equals a match goes before leaving out the candidate, and that before leaving out the
    gold, from the end. Series are cut where no pair can reach across; the parts are
    solved apart, so that their tables stay small.
    """
    c = candidates.select("video", F.col("candidate_frame").cast("long").alias("at"), F.lit(1).alias("role"), F.col("event_id").alias("id"), F.lit(0).cast("long").alias("doubt"))
    g = gold.select("video", F.col("hit_frame").cast("long").alias("at"), F.lit(0).alias("role"), F.lit(None).cast(dict(candidates.dtypes)["event_id"]).alias("id"), F.coalesce(F.col("uncertainty_frames"), F.lit(0)).cast("long").alias("doubt"))
    rows = c.unionByName(g).withColumn("v", F.explode(variants(tolerances, reaction))).select("*", "v.*").drop("v")
    rows = rows.withColumn("reach", F.when(F.col("role") == 0, F.col("tolerance") + F.col("allowance") + F.col("doubt")))
    key = ["tolerance", "allowance", "video"]
    w = Window.partitionBy(*key).orderBy("at", "role", "id")
    widest = F.max("reach").over(Window.partitionBy(*key))
    rows = rows.withColumn("_cut", F.coalesce((F.col("at") - F.lag("at").over(w) > widest).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut", "doubt")
    kinds = {n: t for n, t in rows.dtypes}
    out = f"tolerance long, allowance long, video {kinds['video']}, event_id {kinds['id']}, candidate_frame long, hit_frame long"
    held = F.array_sort(F.collect_list(F.struct("at", "role", "id", "reach")))
    parts = rows.groupBy(*key, "part").agg(held.alias("rows"), F.count("reach").alias("_g"), F.count(F.lit(1)).alias("_n"))
    parts = parts.filter((F.col("_g") > 0) & (F.col("_g") < F.col("_n"))).select(*key, "rows")
    return parts.mapInArrow(joins.solve_parts(key), out)


def errors(matches: DataFrame, key: list[str]) -> DataFrame:
    """Median absolute and signed error, its MAD, and the 90 % residual around the signed median."""
    e = matches.withColumn("_e", (F.col("candidate_frame") - F.col("hit_frame")).cast("double"))
    med = e.groupBy(*key).agg(F.median(F.abs("_e")).alias("median_absolute_frame_error"), F.median("_e").alias("median_signed_frame_error"))
    r = e.join(med, key).withColumn("_r", F.abs(F.col("_e") - F.col("median_signed_frame_error")))
    mad = r.groupBy(*key).agg(F.median("_r").alias("signed_frame_error_mad"))
    p90 = order_statistics(r.select(*key, "_r"), key, "_r", {"offset_normalized_p90_residual_frames": (0.9, "nearest")})
    return med.join(mad, key).join(p90, key)


def prf(df: DataFrame, tp: str, predicted: str, gold: str, digits: int | None = 6) -> DataFrame:
    """With precision, recall and f1; 0 where nothing can be divided."""
    p, r = ratio0(F.col(tp), F.col(predicted)), ratio0(F.col(tp), F.col(gold))
    cut = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    return df.withColumns({"precision": cut(p), "recall": cut(r), "f1": cut(ratio0(2 * p * r, p + r))})


def evaluate(candidates: DataFrame, gold: DataFrame, tolerances=TOLERANCES, reaction: int = 0) -> DataFrame:
    """A row per (tolerance, allowance, video) with counts, scores, errors, conditional accuracies and ambiguity.

    ``candidates`` also carry predicted_hitter and rally_id, ``gold`` hitter and rally_id;
    labels that are ``unknown`` are not scored.
    """
    key = ["tolerance", "allowance", "video"]
    m = match(candidates, gold, tolerances, reaction)
    c = candidates.select("video", "event_id", F.coalesce("predicted_hitter", F.lit("unknown")).alias("ph"), F.coalesce("rally_id", F.lit("unknown")).alias("pr"))
    g = gold.select("video", "hit_frame", F.col("hitter").alias("gh"), F.col("rally_id").alias("gr"))
    rows = m.join(c, ["video", "event_id"]).join(g, ["video", "hit_frame"])
    got = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("matched_count"), F.count_if(F.col("gh") != "unknown").alias("hitter_scored_count"), F.count_if((F.col("gh") != "unknown") & (F.col("gh") == F.col("ph"))).alias("_h"),
        F.count_if(F.col("gr") != "unknown").alias("rally_scored_count"), F.count_if((F.col("gr") != "unknown") & (F.col("gr") == F.col("pr"))).alias("_r"),
    )
    totals = candidates.groupBy("video").agg(F.count(F.lit(1)).alias("candidate_count")).join(gold.groupBy("video").agg(F.count(F.lit(1)).alias("gold_count")), "video", "full_outer")
    totals = totals.na.fill(0, ["candidate_count", "gold_count"]).withColumn("v", F.explode(variants(tolerances, reaction))).select("video", "candidate_count", "gold_count", "v.*")
    out = totals.join(got, key, "left").na.fill(0, ["matched_count", "hitter_scored_count", "rally_scored_count", "_h", "_r"])
    out = prf(out, "matched_count", "candidate_count", "gold_count").join(errors(m, key), key, "left").join(ambiguous(candidates, gold, tolerances, reaction), key, "left")
    return out.select(
        *key, "candidate_count", "gold_count", "matched_count", (F.col("candidate_count") - F.col("matched_count")).alias("false_positive_count"),
        (F.col("gold_count") - F.col("matched_count")).alias("false_negative_count"), "precision", "recall", "f1", "median_absolute_frame_error", "median_signed_frame_error",
        "signed_frame_error_mad", "offset_normalized_p90_residual_frames", F.coalesce("ambiguous_gold_count", F.lit(0)).alias("ambiguous_gold_count"),
        F.bround(ratio(F.col("_h"), F.col("hitter_scored_count")), 6).alias("hitter_accuracy"), "hitter_scored_count",
        F.bround(ratio(F.col("_r"), F.col("rally_scored_count")), 6).alias("rally_id_accuracy"), "rally_scored_count",
    )


def ambiguous(candidates: DataFrame, gold: DataFrame, tolerances=TOLERANCES, reaction: int = 0) -> DataFrame:
    """Labels with more than one candidate within their tolerance, by (tolerance, allowance, video).

    Candidates up to a label's near and far ends are counted by a running number, not joined.
    """
    key = ["tolerance", "allowance", "video"]
    g = gold.withColumn("v", F.explode(variants(tolerances, reaction))).select("video", F.col("hit_frame").cast("long").alias("hit"), F.coalesce("uncertainty_frames", F.lit(0)).cast("long").alias("doubt"), "v.*")
    g = g.withColumn("reach", F.col("tolerance") + F.col("allowance") + F.col("doubt"))
    ends = g.withColumn("e", F.explode(F.array(F.struct((F.col("hit") - F.col("reach") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("hit") + F.col("reach")).alias("at"), F.lit(1).alias("sign")))))
    ends = ends.select(*key, "hit", "doubt", "e.*")
    seen = candidates.select("video", F.col("candidate_frame").cast("long").alias("at"), F.lit(1).alias("_one"))
    both = ends.unionByName(seen, allowMissingColumns=True)
    upto = Window.partitionBy("video").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_n", F.count("_one").over(upto)).filter("sign is not null")
    near = counted.groupBy(*key, "hit", "doubt").agg(F.sum(F.col("sign") * F.col("_n")).alias("near"))
    return near.groupBy(*key).agg(F.count_if(F.col("near") > 1).alias("ambiguous_gold_count"))


def micro(evaluations: DataFrame, key: list[str]) -> DataFrame:
    """Scores of summed counts over videos."""
    s = evaluations.groupBy(*key).agg(F.sum("matched_count").alias("tp"), F.sum("candidate_count").alias("predicted"), F.sum("gold_count").alias("gold"))
    s = prf(s, "tp", "predicted", "gold", None)
    return s.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("gold") - F.col("tp")})


def review_tables(candidates: DataFrame, gold: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Matched events, false positives and false negatives of one variant of the matching."""
    m = matches.select("video", "event_id", "hit_frame")
    matched = m.join(candidates, ["video", "event_id"]).join(gold.select("video", "hit_frame", F.col("hitter").alias("gold_hitter"), F.col("rally_id").alias("gold_rally_id")), ["video", "hit_frame"])
    matched = matched.withColumn("frame_error", F.col("candidate_frame") - F.col("hit_frame")).withColumn("absolute_frame_error", F.abs("frame_error"))
    return {
        "matched_events": matched, "false_positives": candidates.join(m.select("video", "event_id"), ["video", "event_id"], "left_anti"),
        "false_negatives": gold.join(m.select("video", "hit_frame"), ["video", "hit_frame"], "left_anti"),
    }


def class_scores(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Support, precision, recall and f1 of each class among the truths."""
    labels = pairs.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("tp"))
    said = pairs.groupBy(F.col(guess).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    return prf(labels.join(said, "label", "left").na.fill(0, ["predicted"]), "tp", "predicted", "support", None)


def macro_f1(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    return class_scores(pairs, truth, guess).agg(F.bround(F.avg("f1"), 6).alias("macro_f1"))


def window_macro_f1(pairs: DataFrame, truth: str, guess: str, classes: int = 3) -> DataFrame:
    """Mean over a fixed number of classes of 2 tp / (true + predicted), 0 for an empty class."""
    each = []
    for k in range(classes):
        t, g = F.col(truth) == k, F.col(guess) == k
        each.append(ratio0(2 * F.count_if(t & g), F.count_if(t) + F.count_if(g)))
    return pairs.agg((sum(each[1:], each[0]) / classes).alias("macro_f1"))


def class_weights(labels: DataFrame, label: str, classes: int = 3) -> DataFrame:
    """Count of each class and its balanced weight n / (classes * count), an absent class counting as one."""
    n = labels.filter(F.col(label).between(0, classes - 1))
    counts = n.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    total = n.agg(F.count(F.lit(1)).alias("_all"))
    out = grid.join(counts, "label", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))
    return out.select("label", "n", (F.col("_all") / (classes * F.greatest("n", F.lit(1)))).alias("weight"))


def semantics(pairs: DataFrame) -> DataFrame:
    """One row on matched pairs (gold_type, predicted_type, gold_x, gold_y, x, y): type, landing and both together."""
    right = F.col("gold_type") == F.col("predicted_type")
    p = pairs.withColumn("_e", F.hypot(F.col("x") - F.col("gold_x"), F.col("y") - F.col("gold_y")))
    n, scored = F.count(F.lit(1)), F.count("_e")
    cut = lambda a, b: F.bround(ratio(a, b), 6)
    out = p.agg(
        n.alias("matched_count"), F.coalesce(cut(F.count_if(F.col("predicted_type") != "unknown"), n), F.lit(0.0)).alias("type_coverage"), cut(F.count_if(right), n).alias("type_accuracy"),
        F.coalesce(cut(scored, n), F.lit(0.0)).alias("landing_coverage"), F.bround(F.avg("_e"), 6).alias("mean_error_m"), cut(F.count_if(F.col("_e") <= 0.5), scored).alias("within_0_5m"),
        cut(F.count_if(F.col("_e") <= 1.0), scored).alias("within_1_0m"), cut(F.count_if(right & (F.col("_e") <= 0.5)), n).alias("joint_0_5m"), cut(F.count_if(right & (F.col("_e") <= 1.0)), n).alias("joint_1_0m"),
    ).withColumn("_one", F.lit(1))
    ranks = order_statistics(p.select(F.lit(1).alias("_one"), "_e"), ["_one"], "_e", {"median_error_m": (0.5, "nearest"), "p90_error_m": (0.9, "nearest")})
    out = out.join(ranks, "_one", "left").crossJoin(F.broadcast(macro_f1(pairs, "gold_type", "predicted_type"))).drop("_one")
    return out.withColumns({c: F.bround(c, 6) for c in ("median_error_m", "p90_error_m")})


def integrity(gold: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Per video: pairs and triples of neighbouring gold hits of a rally, those wholly found, and those found by neighbouring candidates; hits and matches by side."""
    rank = F.row_number().over(Window.partitionBy("video").orderBy("candidate_frame", "event_id"))
    place = candidates.select("video", "event_id", rank.alias("_k"))
    g = gold.join(matches.select("video", "event_id", "hit_frame").join(place, ["video", "event_id"]).drop("event_id"), ["video", "hit_frame"], "left")
    w = Window.partitionBy("video", "rally_id").orderBy("hit_frame")
    k = [F.col("_k"), F.lead("_k").over(w), F.lead("_k", 2).over(w)]
    g = g.select("video", "hitter", k[0].alias("a"), k[1].alias("b"), k[2].alias("c"), F.lead("hit_frame").over(w).isNotNull().alias("two"), F.lead("hit_frame", 2).over(w).isNotNull().alias("three"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    pair, triple = F.col("two") & a.isNotNull() & b.isNotNull(), F.col("three") & a.isNotNull() & b.isNotNull() & c.isNotNull()
    sides = [x for s in ("upper", "lower") for x in (F.count_if(F.col("hitter") == s).alias(f"gold_{s}"), F.count_if((F.col("hitter") == s) & a.isNotNull()).alias(f"matched_{s}"))]
    out = g.groupBy("video").agg(
        F.count_if("two").alias("gold_pairs"), F.count_if(pair).alias("both_detected"), F.count_if(pair & (b == a + 1)).alias("clean_adjacent_pairs"),
        F.count_if("three").alias("gold_triples"), F.count_if(triple).alias("all_three_detected"), F.count_if(triple & (b == a + 1) & (c == b + 1)).alias("clean_adjacent_triples"), *sides,
    )
    return out.withColumns({
        "clean_pair_fraction": ratio(F.col("clean_adjacent_pairs"), F.col("gold_pairs")), "clean_triple_fraction": ratio(F.col("clean_adjacent_triples"), F.col("gold_triples")),
        "upper_detection_recall": ratio(F.col("matched_upper"), F.col("gold_upper")), "lower_detection_recall": ratio(F.col("matched_lower"), F.col("gold_lower")),
    })


def typed_scores(evaluation: DataFrame, accuracy: float = 0.85) -> DataFrame:
    """Detection scores times an assumed accuracy of types."""
    return evaluation.withColumn("typed_micro_precision", F.col("precision") * accuracy).withColumn("typed_micro_recall", F.col("recall") * accuracy)
