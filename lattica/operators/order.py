"""Global numbering and running sums without a single-task window: rows are sorted by ranges, each range is numbered or
summed by itself, and ranges are shifted by what lies before them (one small row for each range)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

_PART, _AT = "_range", "_place"


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with the number of their range and their place in it, written, so that both stay as they are."""
    named = df.withColumns({f"_order{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"_order{i}") for i in range(len(order))]
    ranged = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return saved(ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """df with `name`: the place of each row in the ascending order, from `first`. Ties are numbered in any order."""
    r = _ranges(df, order)
    sizes = r.groupBy(_PART).agg(F.count("*").alias("_n"))
    # as many rows as there are ranges
    before = sizes.select(_PART, (F.coalesce(F.sum("_n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    return r.join(F.broadcast(before), _PART).select(*[f"`{c}`" for c in df.columns], (F.col("_before") + F.col(_AT) + first).cast("long").alias(name))


def running(df: DataFrame, keys: list[str], order: list[Column], value: str, before: str, total: str) -> DataFrame:
    """df with the sum of `value` over the rows of the same keys that come earlier, and over all of them. A key that
    holds most rows is spread over many ranges."""
    r = _ranges(df, [*[F.col(k) for k in keys], *order])
    w = Window.partitionBy(*keys, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(*keys, _PART).agg(F.sum(value).alias("_sum"))  # a row for each key and range
    all_ = Window.partitionBy(*keys)
    sums = sums.select(*keys, _PART, F.coalesce(F.sum("_sum").over(all_.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"), F.sum("_sum").over(all_).alias(total))
    out = r.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0))).join(sums, [*keys, _PART])
    return out.select(*[f"`{c}`" for c in df.columns], (F.col("_own") + F.col("_shift")).alias(before), total)
