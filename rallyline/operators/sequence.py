"""Ordered analytics over (key, order) columns: windows, islands, sessions, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: list[str], *order):
    return Window.partitionBy(*key).orderBy(*order)


def sessions(df: DataFrame, key: list[str], t: str, tie: str, gap) -> DataFrame:
    """A new session where t is more than ``gap`` after the row before; numbered from 1, with the row's place."""
    w = by(key, t, tie)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(1))
    df = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("place", F.row_number().over(by([*key, "session"], t, tie))).drop("_new")


def runs(df: DataFrame, key: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of equal flags: key, run, flag, first and last of the order's first column, n."""
    place = F.row_number().over(by(key, *order))
    same = F.row_number().over(by([*key, flag], *order))
    df = df.withColumn("_g", place - same)
    out = df.groupBy(*key, flag, "_g").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.drop("_g")


def islands(df: DataFrame, key: list[str], low: str, high: str, adjacent: int = 1) -> DataFrame:
    """Rows with the number ``_i`` of the island of closed intervals they belong to; ends that are ``adjacent`` apart meet."""
    w = by(key, low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", (before.isNull() | (F.col(low) > before + adjacent)).cast("int"))
    return df.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, key: list[str], low: str, high: str, adjacent: int = 1) -> DataFrame:
    """Union of closed integer intervals."""
    df = islands(df, key, low, high, adjacent)
    return df.groupBy(*key, "_i").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n")).drop("_i")


def local_maxima(df: DataFrame, key: list[str], order: list[str], value: str, radius: int = 2) -> DataFrame:
    """Rows that no row within ``radius`` rows exceeds; ties are kept."""
    w = by(key, *order).rowsBetween(-radius, radius)
    return df.withColumn("_max", F.max(value).over(w)).filter(F.col(value) == F.col("_max")).drop("_max")


def labelled_windows(df: DataFrame, key: list[str], at: str, value: str, label: str, size: int = 12, first: int = 6) -> DataFrame:
    """Rows that begin ``size`` contiguous places: ``window`` of values, and ``window_label``.

    The label is the only one other than 0 at offsets ``first`` to the end, 0 if there is none
    and -1 if several differ. A window over a gap or a repeated place is none.
    """
    w = by(key, at)
    held, late = w.rowsBetween(0, size - 1), w.rowsBetween(first, size - 1)
    found = F.collect_set(F.when(F.col(label) != 0, F.col(label))).over(late)
    df = df.withColumn("_step", (F.col(at) - F.lag(at).over(w) == 1).cast("int"))
    df = df.withColumn("_steps", F.sum("_step").over(w.rowsBetween(1, size - 1))).withColumn("_n", F.count(F.lit(1)).over(held))
    df = df.withColumn("window", F.collect_list(value).over(held)).withColumn("_found", found)
    df = df.filter((F.col("_n") == size) & (F.col("_steps") == size - 1))
    one = F.when(F.size("_found") > 1, -1).when(F.size("_found") == 1, F.element_at("_found", 1)).otherwise(0)
    return df.withColumn("window_label", one).drop("_step", "_steps", "_n", "_found")


def anchored(df: DataFrame, key: list[str], at: str, tie: str, span: int) -> DataFrame:
    """Rows with ``grp``: groups that reach at most ``span`` beyond their first row, numbered from 1 by key.

    Rows are cut where neighbours lie more than ``span`` apart, for a group begins there
    whatever came before; each run is folded by an expression.
    """
    w = by(key, at, tie)
    df = df.withColumn("_cut", F.coalesce((F.col(at) - F.lag(at).over(w) > span).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs_ = df.groupBy(*key, "_run").agg(F.sort_array(F.collect_set(at)).alias("_ats"))
    first = F.slice("_ats", 1, 1)

    def step(anchors: Column, t: Column) -> Column:
        return F.when(t - F.element_at(anchors, -1) > span, F.concat(anchors, F.array(t))).otherwise(anchors)

    runs_ = runs_.select(*key, "_run", F.aggregate("_ats", first, step).alias("_anchors"))
    before = F.sum(F.size("_anchors")).over(by(key, "_run").rowsBetween(Window.unboundedPreceding, -1))
    runs_ = runs_.withColumn("_before", F.coalesce(before, F.lit(0)))
    df = df.join(runs_, [*key, "_run"])
    mine = F.size(F.filter("_anchors", lambda a: a <= F.col(at)))
    return df.withColumn("grp", (F.col("_before") + mine).cast("long")).drop("_cut", "_run", "_anchors", "_before")
