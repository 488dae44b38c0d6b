"""Column builders: scalars, zones, classes and order statistics; all JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Court width and length in metres.
COURT_W, COURT_L = 6.1, 13.4
#: Thirds of a half court from the baseline on, thirds of the width, and lines.
DEPTHS = ("后场", "中场", "前场")
WIDTHS = ("左侧", "中路", "右侧")
LINES = ("左偏", "中路", "右偏")
ZONES = tuple(f"{d}-{w}" for d in DEPTHS[::-1] for w in WIDTHS)
PHASES = ("开局阶段", "组织阶段", "延长阶段")
#: Macro classes in order, and the macro class of each raw stroke type.
MACROS = ("发球", "网前/前场", "后场进攻", "高远/挑球", "平抽/推挡", "吊球")
MACRO_OF = {
    "short service": "发球",
    "long service": "发球",
    "net shot": "网前/前场",
    "return net": "网前/前场",
    "rush": "网前/前场",
    "cross-court net shot": "网前/前场",
    "smash": "后场进攻",
    "wrist smash": "后场进攻",
    "lob": "高远/挑球",
    "defensive return lob": "高远/挑球",
    "clear": "高远/挑球",
    "drive": "平抽/推挡",
    "defensive return drive": "平抽/推挡",
    "back-court drive": "平抽/推挡",
    "push": "平抽/推挡",
    "drop": "吊球",
    "passive drop": "吊球",
}
UNKNOWN = "unknown"
#: The vocabulary of semantic labels.
STROKES = (
    "net shot", "return net", "smash", "wrist smash", "lob", "defensive return lob", "clear", "drive", "driven flight",
    "back-court drive", "drop", "passive drop", "push", "rush", "defensive return drive", "cross-court net shot",
    "short service", "long service",
)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def number(text: Column) -> Column:
    """Tolerant cast: blank, invalid, NaN and infinite give null."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), None).otherwise(x)


def whole(text: Column) -> Column:
    """Tolerant cast to an integer by way of a double: '3.9' gives 3."""
    return number(text).cast("long")


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def sign_of(x: Column, tolerance: float = 1e-12) -> Column:
    """-1, 0 or 1; 0 for null and within the tolerance."""
    return F.when(x.isNull() | (F.abs(x) <= tolerance), 0).when(x > 0, 1).otherwise(-1)


def opposite(side: Column) -> Column:
    return F.when(side == "upper", "lower").when(side == "lower", "upper")


def inside(x: Column, limit: float) -> Column:
    """x where it lies on the court's axis of that length, else null."""
    return F.when(x.between(0, limit), x)


def depth_zone(side: Column, y: Column, strict: bool = True, length: float = COURT_L) -> Column:
    """Third of the side's own half, half-open from its baseline on; null beyond the net and off the court.

    Not ``strict``: any side but upper counts as lower.
    """
    lower = F.lit(length) - y
    share = F.when(side == "upper", y).when(side == "lower", lower) if strict else F.when(side == "upper", y).otherwise(lower)
    share = share / (length / 2)
    on = y.between(0, length) & share.between(0, 1)
    return F.when(on & (share < 1 / 3), DEPTHS[0]).when(on & (share < 2 / 3), DEPTHS[1]).when(on, DEPTHS[2])


def width_zone(x: Column, width: float = COURT_W) -> Column:
    on = x.between(0, width)
    return F.when(on & (x < width / 3), WIDTHS[0]).when(on & (x < 2 * width / 3), WIDTHS[1]).when(on, WIDTHS[2])


def zone9(depth: Column, width: Column) -> Column:
    return F.when(depth.isNotNull() & width.isNotNull(), F.concat_ws("-", depth, width))


def line_class(own_x: Column, landing_x: Column, divisor: float = 6, width: float = COURT_W) -> Column:
    """Whether the landing lies left or right of the player by more than width / divisor."""
    shift = landing_x - own_x
    return F.when(shift < -width / divisor, LINES[0]).when(shift > width / divisor, LINES[2]).when(shift.isNotNull(), LINES[1])


def macro_of(stroke: Column) -> Column:
    """Macro class of a raw stroke type; ``unknown`` for all others and null."""
    table = F.create_map(*[F.lit(v) for pair in MACRO_OF.items() for v in pair])
    return F.coalesce(table[F.coalesce(stroke, F.lit(UNKNOWN))], F.lit(UNKNOWN))


def phase(stroke_index: Column) -> Column:
    """Opening (to 3), build-up (to 6) or extended phase of a rally."""
    return F.when(stroke_index <= 3, PHASES[0]).when(stroke_index <= 6, PHASES[1]).when(stroke_index.isNotNull(), PHASES[2])


def collapse_class(raw: Column) -> Column:
    """``Top_x`` and ``Bottom_x`` without their side; ``unknown`` where there is no side."""
    return F.when(F.instr(raw, "_") > 0, F.regexp_replace(raw, "^[^_]*_", "")).otherwise(UNKNOWN)


def stroke_status(label: Column, confidence: Column, quality: Column) -> Column:
    """``unknown``, ``low_confidence`` (confidence under 0.35 or quality under 0.55) or ``predicted``."""
    return F.when(label == UNKNOWN, UNKNOWN).when((confidence < 0.35) | (quality < 0.55), "low_confidence").otherwise("predicted")


def bare_id(video: Column) -> Column:
    return F.regexp_replace(video, "^vid_", "")


def ids_match(a: Column, b: Column) -> Column:
    """Without ``vid_``, one identifier begins with the other."""
    return F.startswith(bare_id(a), bare_id(b)) | F.startswith(bare_id(b), bare_id(a))


def seed_of(label: Column, base: int) -> Column:
    """Seed from the first 8 hex digits of the label's SHA-256."""
    return (F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("long") + base) % (2**32 - 1)


def plogp(n: Column, total: Column) -> Column:
    p = ratio(n, total)
    return F.when(n > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding with ties to even."""
    return F.bround(x, digits)


def frames_of(seconds: float, fps: float, least: int = 0) -> int:
    """Seconds as frames, rounded half to even."""
    return max(least, round(fps * seconds))


def nearest_rank(values: Column, f: float) -> Column:
    """sorted[round((n - 1) * f)], half to even."""
    return F.element_at(values, (F.bround((F.size(values) - 1) * F.lit(f), 0).cast("int") + 1))


def truncated_rank(values: Column, f: float) -> Column:
    return F.element_at(values, (F.floor((F.size(values) - 1) * F.lit(f)).cast("int") + 1))


def higher_rank(values: Column, f: float) -> Column:
    return F.element_at(values, (F.ceil((F.size(values) - 1) * F.lit(f)).cast("int") + 1))


RANKS = {"nearest": lambda x: F.bround(x, 0), "truncated": F.floor, "higher": F.ceil}


def order_statistics(df: DataFrame, key: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Per key, values at rank (n - 1) * f of the sorted ones; ranks ``nearest``, ``truncated`` or ``higher``.

    Nulls are left out. Rows are ranked by a window that spills, so that no key's values
    are brought together in one row.
    """
    rows = df.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*key).orderBy(value)
    rows = rows.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    out = [F.max(F.when(F.col("_at") == RANKS[rule]((F.col("_n") - 1) * F.lit(f)).cast("long"), F.col(value))).alias(name) for name, (f, rule) in wanted.items()]
    return rows.groupBy(*key).agg(*out)
