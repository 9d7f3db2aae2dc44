"""Positions within a group that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetward.staging import measured

CELLS = 256


def count_below(ascending: Column, x: Column, most: int) -> Column:
    """How many elements of an ascending array of at most so many are less than x, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in range(max(most, 1).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(ascending)) & (F.get(ascending, at + s - 1) < x), at + s).otherwise(at))


def _celled(df: DataFrame, keys: list[str], value: str, cells: int) -> DataFrame:
    """Adds __cell, which rises with the value: how many of the group's quantiles are less.

    Quantiles follow the values however they are spread; equal values share a cell. Null comes first (-1), infinity
    and NaN in the last cells. The quantiles are one array for each group; they are broadcast if groups are few
    enough, which is counted.
    """
    x = F.col(value).cast("double")
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    shares = F.array(*(F.lit(k / cells) for k in range(1, cells)))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(finite, shares, F.lit(20 * cells)).alias("__cuts"))
    cuts = measured(cuts, "quantiles", 64 + 8 * cells)
    held = df.join(cuts, on=_same(df, cuts, keys), how="inner").drop(*(cuts[k] for k in keys))
    cell = F.when(F.col(value).isNull(), -1).when(F.col("__cuts").isNull(), 0).otherwise(count_below(F.col("__cuts"), x, cells))
    return held.withColumn("__cell", cell.cast("int")).drop("__cuts")


def positions(df: DataFrame, keys: list[str], value: str, ties: list[str] | None = None, name: str = "position", cells: int = CELLS) -> DataFrame:
    """Adds name: 1 for the least value within keys, and so on; also n, the rows of the group.

    Two steps: a group's values are cut into cells at their quantiles, whose counts give each cell its first
    position, and rows are numbered within their cell. The counts are one row for each cell; a device that has most
    of the rows is spread over its cells. Null values come first. Rows of one value are numbered in one task: where
    many are equal, count them (see running_sums) instead.
    """
    held = _celled(df, keys, value, cells)
    counts = held.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__cell", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("n"))
    inside = Window.partitionBy(*keys, "__cell").orderBy(value, *(ties or []))
    own = [*keys, "__cell"]
    out = held.join(counts, on=_same(held, counts, own), how="inner").drop(*(counts[k] for k in own))
    return out.withColumn(name, F.col("__before") + F.row_number().over(inside)).drop("__cell", "__before")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys, null with null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], descending: bool = False, cells: int = CELLS) -> DataFrame:
    """Adds, for each new name, the sum of a column over rows of the group that come before in value order.

    df holds one row for each value of a group. The same two steps as positions(): sums by cell, then inside the cell.
    """
    held = _celled(df, keys, value, cells)
    if descending:
        held = held.withColumn("__cell", -F.col("__cell"))
    totals = held.groupBy(*keys, "__cell").agg(*(F.sum(c).alias(f"__t_{new}") for new, c in sums.items()))
    upto = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__cell", *(F.coalesce(F.sum(f"__t_{new}").over(upto), F.lit(0)).alias(f"__b_{new}") for new in sums))
    inside = Window.partitionBy(*keys, "__cell").orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, -1)
    own = [*keys, "__cell"]
    out = held.join(totals, on=_same(held, totals, own), how="inner").drop(*(totals[k] for k in own))
    for new, c in sums.items():
        out = out.withColumn(new, F.col(f"__b_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("__cell", *(f"__b_{new}" for new in sums))
