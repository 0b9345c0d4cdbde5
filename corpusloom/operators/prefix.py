"""Running sums over an ordered numeric column without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the ordering column, about equal in rows: the table of their sums has so many rows at most, and one more for NaN and nulls.
RANGES = 256


def cuts(df: DataFrame, order: str, ranges: int = RANGES) -> list[float]:
    """Quantiles of a numeric column, rising and distinct; none of an empty one."""
    x = F.col(order).cast("double")
    shares = [k / ranges for k in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.when(~F.isnan(x), x), shares, F.lit(10000)).alias("cuts")).first()
    return sorted(set(row[0] or []))


def range_of(x: Column, at: list[float]) -> Column:
    """How many cuts are smaller than x, by halving; one range more for NaN and nulls."""

    def find(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(x <= at[mid], find(a, mid)).otherwise(find(mid + 1, b))

    return F.when(x.isNull() | F.isnan(x), len(at) + 1).otherwise(find(0, len(at)))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds for each (name, column) the sum of the column over all rows up to this one, `order` being distinct.

    Rows are dealt by quantiles of the ordering column, so that an outlier doesn't put all others into one
    range; a range's own running sum starts from the total of the ranges before it, which is a broadcast
    table of RANGES + 1 rows at most. NaN orders last, as in Spark.
    """
    dealt = df.withColumn("_range", range_of(F.col(order).cast("double"), cuts(df, order)))
    by = F.desc("_range") if descending else F.asc("_range")
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(before), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *(f"_{n}" for n in sums))
