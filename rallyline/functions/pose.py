"""Poses of 17 keypoints and shuttle detections, as expressions over arrays and structs.

A player is a struct of identity, bbox_xyxy, keypoints_xy, keypoint_scores,
keypoint_missing and, once projected, court_xy_m.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of the wrists and the ankles among the keypoints, and two skeletons.
WRISTS, ANKLES, JOINTS = (9, 10), (15, 16), 17
SKELETON = (
    (0, 1), (0, 2), (1, 3), (2, 4),
    (5, 6), (5, 7), (7, 9), (6, 8), (8, 10),
    (5, 11), (6, 12), (11, 12),
    (11, 13), (13, 15), (12, 14), (14, 16),
)
LEAST_SCORE = 0.2


def distance(a: Column, b: Column) -> Column:
    return F.hypot(F.get(a, 0) - F.get(b, 0), F.get(a, 1) - F.get(b, 1))


def xy(point: Column) -> tuple[Column, Column]:
    """Both coordinates of a point, null unless it has two."""
    whole = F.size(point) >= 2
    return F.when(whole, F.get(point, 0).cast("double")), F.when(whole, F.get(point, 1).cast("double"))


def keypoint(player: Column, i: int, least: float = LEAST_SCORE) -> Column:
    """The player's keypoint where it is there, not missing and scored at least ``least``."""
    seen = ~F.get(player["keypoint_missing"], i) & (F.get(player["keypoint_scores"], i) >= least)
    return F.when(F.coalesce(seen, F.lit(False)), F.get(player["keypoints_xy"], i))


def foot_point(player: Column) -> Column:
    """Mean of the valid ankles, else the middle of the box's lower edge."""
    ankles = F.filter(F.array(*[keypoint(player, i) for i in ANKLES]), lambda p: p.isNotNull())

    def mean(k: int) -> Column:
        return F.aggregate(ankles, F.lit(0.0), lambda acc, p: acc + F.get(p, k)) / F.size(ankles)

    box = player["bbox_xyxy"]
    under = F.array((F.get(box, 0) + F.get(box, 2)) / 2, F.get(box, 3))
    return F.when(F.size(ankles) > 0, F.array(mean(0), mean(1))).otherwise(under)


def ankle_confidence(player: Column) -> Column:
    """Mean score of the ankles that are not missing, 0 without any."""
    scores = F.filter(F.array(*[F.when(~F.get(player["keypoint_missing"], i), F.get(player["keypoint_scores"], i)) for i in ANKLES]), lambda s: s.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores)).otherwise(F.lit(0.0))


def of_side(players: Column, side: str) -> Column:
    """The first player with that identity, or null."""
    return F.get(F.filter(players, lambda p: p["identity"] == side), 0)


def wrists(player: Column) -> Column:
    return F.filter(F.array(*[keypoint(player, i) for i in WRISTS]), lambda p: p.isNotNull())


def nearest_wrist(players: Column, point: Column) -> Column:
    """Struct of distance and identity of the wrist nearest to a point, the first of equals; null without wrists."""
    found = F.flatten(F.transform(players, lambda p, i: F.transform(
        F.filter(F.array(*[F.struct(F.lit(k).alias("k"), keypoint(p, j).alias("at")) for k, j in enumerate(WRISTS)]), lambda s: s["at"].isNotNull()),
        lambda s: F.struct(distance(s["at"], point).alias("distance"), (i * 2 + s["k"]).alias("order"), p["identity"].alias("identity")),
    )))
    return F.array_min(found)


def wrist_motion(before: Column, after: Column) -> Column:
    """Longest way of a wrist that is valid in both rows, of players seen in both; 0 without any."""
    ways = []
    for side in ("upper", "lower"):
        a, b = of_side(before, side), of_side(after, side)
        ways += [distance(keypoint(a, i), keypoint(b, i)) for i in WRISTS]
    return F.coalesce(F.greatest(*ways), F.lit(0.0))


def poses(people: Column, least: float = LEAST_SCORE, most: int = 12) -> Column:
    """Players out of a detector's people (structs of points and scores).

    Scores under ``least`` are missing, the box spans what is visible. People without 17
    joints or with nothing visible go; the others are ordered by the box's lower edge (as
    they came, where equal), and ``most`` are kept.
    """
    cut = F.transform(people, lambda p: F.struct(F.slice(p["points"], 1, JOINTS).alias("points"), F.slice(p["scores"], 1, JOINTS).alias("scores")))
    cut = F.filter(cut, lambda p: (F.size(p["points"]) == JOINTS) & (F.size(p["scores"]) == JOINTS))

    def one(p: Column, i: Column) -> Column:
        absent = F.transform(p["scores"], lambda s: s < least)
        seen = F.filter(F.transform(p["points"], lambda q, j: F.when(~F.get(absent, j), q)), lambda q: q.isNotNull())
        xs, ys = (F.transform(seen, lambda q, k=k: F.get(q, k).cast("double")) for k in (0, 1))
        box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
        return F.struct(F.array_max(ys).alias("bottom"), i.alias("i"), box.alias("bbox_xyxy"), p["points"].alias("keypoints_xy"), p["scores"].alias("keypoint_scores"), absent.alias("keypoint_missing"))

    found = F.filter(F.transform(cut, one), lambda p: p["bottom"].isNotNull())
    found = F.slice(F.array_sort(found), 1, most)
    return F.transform(found, lambda p, i: F.struct(F.concat(F.lit("candidate_"), i.cast("string")).alias("identity"), *[p[n].alias(n) for n in ("bbox_xyxy", "keypoints_xy", "keypoint_scores", "keypoint_missing")]))


def shuttle_candidates(confidences: Column, boxes: Column, k: int = 5) -> Column:
    """The k most confident boxes with their middles; equals stay in the detector's order."""
    n = F.least(F.size(confidences), F.size(boxes))
    rows = F.transform(F.slice(confidences, 1, n), lambda c, i: F.struct((-c).alias("o"), i.alias("detector_index"), c.alias("confidence"), F.get(boxes, i).alias("bbox_xyxy")))
    rows = F.slice(F.array_sort(rows), 1, k)

    def middle(b: Column) -> Column:
        return F.array((F.get(b, 0) + F.get(b, 2)) / 2, (F.get(b, 1) + F.get(b, 3)) / 2)

    return F.transform(rows, lambda r: F.struct(middle(r["bbox_xyxy"]).alias("raw_xy"), r["confidence"].alias("confidence"), r["bbox_xyxy"].alias("bbox_xyxy"), r["detector_index"].alias("detector_index")))


def measurements(shuttle: Column, least: float | None = None) -> Column:
    """Ranked candidates of a shuttle record; the single raw point where there are none."""

    def row(rank: Column, point: Column, confidence: Column) -> Column:
        return F.struct(rank.cast("int").alias("rank"), F.get(point, 0).cast("double").alias("x"), F.get(point, 1).cast("double").alias("y"), confidence.cast("double").alias("confidence"))

    def usable(point: Column, confidence: Column) -> Column:
        return (F.coalesce(F.size(point), F.lit(0)) >= 2) & confidence.isNotNull()

    ranked = F.filter(F.transform(shuttle["candidates"], lambda c, i: F.when(usable(c["raw_xy"], c["confidence"]), row(i, c["raw_xy"], c["confidence"]))), lambda r: r.isNotNull())
    single = row(F.lit(0), shuttle["raw_xy"], shuttle["confidence"])
    none = F.filter(F.array(single), lambda r: F.lit(False))
    out = F.when(F.size(ranked) > 0, ranked).when(usable(shuttle["raw_xy"], shuttle["confidence"]), F.array(single)).otherwise(none)
    return out if least is None else F.filter(out, lambda m: m["confidence"] >= least)


def normalised_pose(player: Column, least: float = LEAST_SCORE) -> Column:
    """Struct of 17 points relative to the box over its diagonal (0, 0 where not valid) and their share that is valid."""
    box = player["bbox_xyxy"]
    diagonal = F.hypot(F.get(box, 2) - F.get(box, 0), F.get(box, 3) - F.get(box, 1))
    fits = (F.size(box) == 4) & (F.size(player["keypoints_xy"]) == JOINTS) & (F.size(player["keypoint_scores"]) == JOINTS) & (F.size(player["keypoint_missing"]) == JOINTS) & (diagonal > 1e-6)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    points = [F.when(keypoint(player, i, least).isNotNull(), F.array(*[(F.get(keypoint(player, i, least), k) - F.get(box, k)) / diagonal for k in (0, 1)])).otherwise(zero) for i in range(JOINTS)]
    valid = sum((keypoint(player, i, least).isNotNull().cast("int") for i in range(JOINTS)), F.lit(0))
    fits = F.coalesce(fits, F.lit(False))
    return F.struct(F.when(fits, F.array(*points)).otherwise(F.array(*[zero] * JOINTS)).alias("points"), F.when(fits, valid / JOINTS).otherwise(F.lit(0.0)).alias("coverage"))


def bones(points: Column, pairs=SKELETON) -> Column:
    """Vectors from the first to the second joint of each pair; a component is 0 where either joint's is 0."""

    def part(a: int, b: int, k: int) -> Column:
        u, v = F.get(F.get(points, a), k), F.get(F.get(points, b), k)
        return F.when((u != 0) & (v != 0), v - u).otherwise(F.lit(0.0))

    return F.array(*[F.array(part(a, b, 0), part(a, b, 1)) for a, b in pairs])


def masked_edges(points: Column, mask: Column, pairs=SKELETON) -> Column:
    """Vectors between joints that are both valid, null for the others."""

    def edge(a: int, b: int) -> Column:
        ok = F.get(mask, a) & F.get(mask, b)
        return F.when(ok, F.array(*[F.get(F.get(points, b), k) - F.get(F.get(points, a), k) for k in (0, 1)]))

    return F.array(*[edge(a, b) for a, b in pairs])


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def top_classes(probabilities: Column, names: list[str], k: int = 3) -> Column:
    """The k most probable classes, by probability and then by place."""
    table = F.array(*[F.lit(n) for n in names])
    rows = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("o"), i.alias("i"))))
    return F.transform(F.slice(rows, 1, k), lambda r: F.struct(F.get(table, r["i"]).alias("raw_class"), F.bround(-r["o"], 6).alias("probability")))
