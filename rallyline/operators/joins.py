"""Band, interval and as-of joins without cartesian products; optimal one-to-one matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Pairs of a part up to which it is matched by plain numbers.
SMALL = 64


def band_join(a: DataFrame, b: DataFrame, key: str, x: str, y: str, radius: int) -> DataFrame:
    """Pairs with equal keys and |x - y| <= radius: buckets as wide as the band, b in three of them."""
    width = max(1, radius)
    a = a.withColumn("_b", F.floor(F.col(x) / width))
    b = b.withColumn("_b", F.explode(F.array(*[F.floor(F.col(y) / width) + k for k in (-1, 0, 1)])))
    return a.join(b, [key, "_b"]).filter(F.abs(F.col(x) - F.col(y)) <= radius).drop("_b")


def forward_join(a: DataFrame, b: DataFrame, key: str, x: str, y: str, low: int, high: int) -> DataFrame:
    """Pairs with equal keys and low <= y - x <= high (low >= 0): buckets as wide as the band, a in two of them."""
    width = max(1, high - low)
    first = F.floor((F.col(x) + low) / width)
    a = a.withColumn("_b", F.explode(F.array(first, first + 1)))
    b = b.withColumn("_b", F.floor(F.col(y) / width))
    return a.join(b, [key, "_b"]).filter((F.col(y) - F.col(x)).between(low, high)).drop("_b")


def contains_join(points: DataFrame, intervals: DataFrame, key: str, x: str, low: str, high: str, carry: list[str] | None = None) -> DataFrame:
    """Points in closed intervals that don't overlap: the last interval begun, if it still runs, as ``low`` and its ``carry``."""
    carry = carry or []
    rows = points.withColumn("_low", F.col(x)).withColumn("_point", F.lit(1)).withColumn("_high", F.lit(None).cast("long"))
    other = intervals.select(key, F.col(low).alias("_low"), F.col(high).alias("_high"), F.lit(0).alias("_point"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    w = Window.partitionBy(key).orderBy("_low", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other, allowMissingColumns=True)
    begun = F.struct("_low", "_high", *[f"_c_{c}" for c in carry])
    both = both.withColumn("_at", F.last(F.when(F.col("_point") == 0, begun), ignorenulls=True).over(w))
    runs = F.col("_at._high") >= F.col(x)
    both = both.filter("_point = 1").withColumn("low", F.when(runs, F.col("_at._low")))
    both = both.withColumns({c: F.when(runs, F.col(f"_at._c_{c}")) for c in carry}) if carry else both
    return both.drop("_low", "_point", "_high", "_at", *[f"_c_{c}" for c in carry])


def as_of_join(left: DataFrame, right: DataFrame, key: str, t: str, value: str, version: str) -> DataFrame:
    """Last value of ``right`` at or before t, by (t, version)."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[version])).withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(key, t, F.col(version).alias("_v"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(t, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("as_of", F.last(F.when(F.col("_side") == 0, F.col("_value")), ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side", "_v", "_value")


def solve_matching(found: list[int], gold: list[int], reach: list[int]) -> list[tuple[int, int]]:
    """Order-keeping one-to-one pairs (found, gold) within each gold's reach: most pairs, then least total error.

    The best value of each prefix is one integer (pairs before error), and a row of the
    table follows from the one before in three vector steps. The way back prefers a match,
    then leaving out the last found, then the last gold.
    """
    if len(found) * len(gold) <= SMALL:
        return solve_small(found, gold, reach)
    import numpy as np

    at, limit = np.array(gold, np.int64), np.array(reach, np.int64)
    unit = np.int64(1) << 40
    table = np.zeros((len(found) + 1, len(gold) + 1), np.int64)
    for i, f in enumerate(found):
        error = np.abs(at - f)
        taken = np.where(error <= limit, table[i, :-1] + unit - error, -1)
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], taken))
    out, i, j = [], len(found), len(gold)
    while i and j:
        error = abs(gold[j - 1] - found[i - 1])
        if error <= reach[j - 1] and table[i, j] == table[i - 1, j - 1] + unit - error:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def solve_small(found: list[int], gold: list[int], reach: list[int]) -> list[tuple[int, int]]:
    """The same by plain numbers, which is faster for a few rows."""
    if len(found) == len(gold) == 1:
        return [(0, 0)] if abs(gold[0] - found[0]) <= reach[0] else []
    unit, n = 1 << 40, len(gold)
    table = [[0] * (n + 1)]
    for f in found:
        last, row = table[-1], [0]
        for j in range(n):
            best = last[j + 1] if last[j + 1] > row[j] else row[j]
            error = abs(gold[j] - f)
            if error <= reach[j] and last[j] + unit - error > best:
                best = last[j] + unit - error
            row.append(best)
        table.append(row)
    out, i, j = [], len(found), n
    while i and j:
        error = abs(gold[j - 1] - found[i - 1])
        if error <= reach[j - 1] and table[i][j] == table[i - 1][j - 1] + unit - error:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def solve_parts(key: list[str]):
    """Matches of parts, a row each: ``key`` and ``rows``, sorted structs of at, role (0 gold, 1 found), id and the gold's reach."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch["rows"]
            ends, flat = lists.offsets.to_numpy(), lists.values
            first = int(ends[0])
            flat = flat.slice(first, int(ends[-1]) - first)
            ends = (ends - first).tolist()
            at, role, ids, reach = (flat.field(k) for k in range(4))
            ats, roles, reaches = at.to_pylist(), role.to_pylist(), reach.to_pylist()
            part, f, g = [], [], []
            for p in range(batch.num_rows):
                span = range(ends[p], ends[p + 1])
                gold, found = [k for k in span if not roles[k]], [k for k in span if roles[k]]
                for i, j in solve_matching([ats[k] for k in found], [ats[k] for k in gold], [reaches[k] for k in gold]):
                    part.append(p)
                    f.append(found[i])
                    g.append(gold[j])
            part, f, g = (pa.array(np.array(x, np.int64)) for x in (part, f, g))
            yield pa.RecordBatch.from_arrays([*[pc.take(batch[c], part) for c in key], pc.take(ids, f), pc.take(at, f), pc.take(at, g)], names=[*key, "event_id", "candidate_frame", "hit_frame"])

    return run
