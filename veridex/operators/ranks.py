"""Running sums and ranks over all rows of a group, without a window that holds the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def bucket_of(order: Column, bounds: list[float]) -> Column:
    """How many (rising) bounds lie at or below the value. The bounds are literals, so a row's bucket never changes.

    A binary search over the value as a variable: however costly order is, it is worked out once a row.
    """

    def search(x: Column, low: int, high: int) -> Column:
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(x < bounds[mid], search(x, low, mid)).otherwise(search(x, mid + 1, high))

    return F.coalesce(F.transform(F.array(order), lambda x: search(x, 0, len(bounds)))[0], F.lit(0))


def range_bounds(df: DataFrame, order: str, buckets: int = BUCKETS) -> list[float]:
    """Values that cut the column into ranges of about equal size; they decide balance alone, not results."""
    found = df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return sorted(set(found))


def with_ahead(df: DataFrame, by: list[str], order: str, value: str | None = None, even: bool = False, ties: tuple[str, ...] = (), name: str = "ahead") -> DataFrame:
    """df with the sum of value (or the number of rows) over the rows before it in its group, by order, then ties.

    Rows are dealt out by ranges of order, and each range adds what lies in the ranges before it: one number a group
    and range. A window holds one range of one group. even: order lies evenly in [0, 1), so ranges need no look at it.
    """
    n = F.col(value) if value else F.lit(1).cast("long")
    at = F.col(order).cast("double")
    bucket = F.floor(at * BUCKETS).cast("int") if even else bucket_of(at, range_bounds(df, order))
    dealt = df.withColumns({"_bucket": bucket, "_n": n})
    inner = F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_total"))
    ahead = F.sum("_total").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_range"), F.coalesce(ahead, F.lit(0)).alias("_offset"))
    offsets = offsets if by else F.broadcast(offsets)  # without groups at most BUCKETS rows
    # the range is compared as an expression, as Spark would else infer a filter on the bounds for the other side, and fail
    same = [F.col(c) == F.col(f"_by_{c}") for c in by] + [F.col("_bucket") == F.pmod("_range", F.lit(1 << 20))]
    out = dealt.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(offsets, same)
    return out.withColumn(name, F.col("_inner") + F.col("_offset")).select(*df.columns, name)
