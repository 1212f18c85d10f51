"""Order-aware relational operators: scans, compaction, segmented top-k, first-wins arg-min and de-duplication.

All take an explicit order, since rows have none of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.session import written


def argmin_first(df: DataFrame, segment: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """The row with the least score of each segment; ties go to the first in order. One partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in segment]
    key = [score, *order]
    least = F.min(F.struct(*key, *[c for c in rest if c not in key]))
    return df.groupBy(*segment).agg(least.alias("__w")).select(*segment, *[F.col(f"__w.{c}").alias(c) for c in rest])


def segmented_topk(df: DataFrame, segment: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """First k rows of each segment, with their rank; Catalyst limits groups before the shuffle."""
    w = Window.partitionBy(*segment).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def compact(df: DataFrame, flag: Column, index: str) -> DataFrame:
    """Indices of true flags, numbered from 0 in ascending order (by a parallel scan)."""
    kept = df.filter(flag).select(index, F.lit(1).cast("long").alias("__one"))
    return exclusive_scan(kept, "__one", [index], into="slot").drop("__one")


def segmented_scan(df: DataFrame, value: str, segment: Sequence[str], order: Sequence[str], into: str = "offset") -> DataFrame:
    """Exclusive prefix sums by segment, for segments that fit into a task; ``exclusive_scan`` with a segment splits them."""
    w = Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has such columns."""
    out = []
    for n in names:
        while n in df.columns:
            n += "_"
        out.append(n)
    return out


def exclusive_scan(df: DataFrame, value: str, order: Sequence[str], into: str = "offset", segment: Sequence[str] = ()) -> DataFrame:
    """Exclusive prefix sum over all rows (or by segment, however large one is) without bringing them into one task.

    Rows are dealt into ranges of segment and order, with a window inside each range, and written once with the range's number: ranges
    come from a sample, so a plan that is run again may cut them elsewhere. The table then gives each range's sum, and a scan of
    those sums, a row for each range and segment, starts each range."""
    part, inside, total, start = _free(df, "__part", "__inside", "__sum", "__start")
    dealt = df.repartitionByRange(*[F.col(c) for c in (*segment, *order)]).withColumn(part, F.spark_partition_id())
    along = Window.partitionBy(part, *segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = written(dealt.withColumn(inside, F.coalesce(F.sum(value).over(along), F.lit(0))), "scan")
    sums = d.groupBy(part, *segment).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*segment).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select(part, *segment, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    names = [part, *segment]
    right = starts.select(*[F.col(c).alias(f"{c}__s") for c in names], start)
    same = [d[c].eqNullSafe(right[f"{c}__s"]) for c in names]
    return d.join(right, same).withColumn(into, F.col(start) + F.col(inside)).select(*df.columns, into)


def previous(df: DataFrame, value: Column, order: Sequence[str], into: str) -> DataFrame:
    """The value of the row before, over all rows in order, without bringing them into one task: a lag inside each range, and each range's last
    row for the next one's first."""
    part, last, told = _free(df, "__part", "__last", "__told")
    d = written(df.withColumn(told, value).repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()), "previous")
    ends = d.groupBy(part).agg(F.max_by(told, F.struct(*order)).alias(last))
    over = Window.orderBy(part)  # a row for each range
    ends = ends.select(F.col(part).alias(f"{part}p"), F.lag(last).over(over).alias(last))
    inside = Window.partitionBy(part).orderBy(*order)
    first = F.row_number().over(inside) == 1
    d = d.join(ends, d[part] == ends[f"{part}p"])
    return d.withColumn(into, F.when(first, F.col(last)).otherwise(F.lag(told).over(inside))).select(*df.columns, into)


def violations(df: DataFrame, order: Sequence[str], start: str, length: str) -> DataFrame:
    """Rows that don't begin where the row before ends."""
    d = previous(df, F.col(start) + F.col(length), order, "expected")
    return d.filter(F.col("expected").isNotNull() & (F.col(start) != F.col("expected")))


def dedup_first(df: DataFrame, key: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row in order of each key, by a partial aggregate."""
    names = [f"__k{i}" for i in range(len(key))]
    d = df.select("*", *[k.alias(n) for k, n in zip(key, names, strict=True)])
    rest = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*order, *rest))
    return d.groupBy(*names).agg(first.alias("__f")).select(*[F.col(f"__f.{c}").alias(c) for c in df.columns])


def skyline(df: DataFrame, lower: Sequence[str], higher: Sequence[str]) -> DataFrame:
    """Rows that no other row dominates: as good everywhere and better somewhere. Of all rows that agree in every measure but the last only the best of that one can decide, so rows meet one row for each
    of these, found by a partial aggregate, in a nested loop: for tables of means (a row a profile). Rows with a null or NaN measure dominate nothing and stay."""
    names = [*lower, *higher]
    *rest, last = names
    real = df.select(*names).filter(reduce(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names]))
    b = real.groupBy(*rest).agg((F.min if last in lower else F.max)(last).alias(last)).alias("b")
    a = df.alias("a")
    le = [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in lower] + [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in higher]
    lt = [F.col(f"b.{c}") < F.col(f"a.{c}") for c in lower] + [F.col(f"b.{c}") > F.col(f"a.{c}") for c in higher]
    return a.join(b, reduce(Column.__and__, le) & reduce(Column.__or__, lt), "left_anti")


def largest_remainder(df: DataFrame, weight: str, total: int, segment: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole shares of total in proportion to weight, by segment; what rounding leaves goes to the largest fractions."""
    seg = Window.partitionBy(*segment)
    d = df.withColumn("__exact", F.coalesce(F.try_divide(F.col(weight) * F.lit(float(total)), F.sum(weight).over(seg)), F.lit(0.0)))
    d = d.withColumn("__floor", F.floor("__exact").cast("long"))
    left = F.lit(total) - F.sum("__floor").over(seg)
    rank = F.row_number().over(seg.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), *order))
    return d.withColumn("budget", F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).drop("__exact", "__floor")


def capped_shares(df: DataFrame, weight: str, cap: str, target: str, segment: Sequence[str], order: Sequence[str], into: str = "share") -> DataFrame:
    """Whole shares of target (a column, one value a segment) in proportion to weight, none above the row's cap; what caps leave is shared again among the others until no share is above its own.

    That end is a water level: with rows by cap / weight, the level is the largest of (target - caps before) / (weights from here on), and a row gets the less of its cap and level * weight. Rounding
    goes to the largest fractions below a cap, ties by order. Shares sum to the target, or to all caps where these are less. A segment's windows are sorted and spill; weights
    below 1e-9, null and negative ones count as 1e-9."""
    w, c, exact, floor = _free(df, "__w", "__c", "__exact", "__floor")
    seg = Window.partitionBy(*segment)
    d = df.withColumn(w, F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-9))).withColumn(c, F.greatest(F.coalesce(F.col(cap).cast("long"), F.lit(0)), F.lit(0)))
    line = seg.orderBy(F.col(c) / F.col(w), *order)
    before = F.coalesce(F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(w).over(line.rowsBetween(0, Window.unboundedFollowing))
    goal = F.least(F.greatest(F.col(target).cast("long"), F.lit(0)), F.sum(c).over(seg))
    level = _free(df, "__level")[0]
    d = d.withColumn(level, (goal - before) / rest).withColumn(level, F.max(level).over(seg))
    d = d.withColumn(exact, F.least(F.col(c).cast("double"), F.greatest(F.col(level), F.lit(0.0)) * F.col(w)))
    d = d.withColumn(floor, F.least(F.col(c), F.floor(F.col(exact) + 1e-9).cast("long")))
    left = goal - F.sum(floor).over(seg)
    full = F.col(floor) >= F.col(c)
    rank = F.row_number().over(seg.orderBy(full, F.desc(F.round(F.col(exact) - F.col(floor), 7)), *order))
    return d.withColumn(into, F.col(floor) + F.when((rank <= left) & ~full, 1).otherwise(0)).drop(w, c, level, exact, floor)


def tile_budgets(df: DataFrame, weight: str, cap: str, pixels: str, bits_per_pixel: float, segment: Sequence[str], order: Sequence[str], tile_bits: int = 32, primitive_bits: int = 72) -> DataFrame:
    """Primitives that each tile may have: one, and its share of those that the segment's bits pay for (pixels is the segment's size on every row), up to its cap."""
    extra, most = _free(df, "__extra", "__most")
    n = F.count(F.lit(1)).over(Window.partitionBy(*segment))
    paid = F.floor(F.greatest(F.lit(0.0), F.col(pixels) * F.lit(float(bits_per_pixel)) - n * tile_bits) / primitive_bits).cast("long")
    d = df.withColumn(extra, paid).withColumn(most, F.greatest(F.col(cap).cast("long"), F.lit(1)) - 1)
    return capped_shares(d, weight, most, extra, segment, order, "budget").withColumn("budget", F.col("budget") + 1).drop(extra, most)
