"""Joins on ranges, intervals and time, as equality joins on bins or as windows: no pair is looked at but those that share a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bins(low: Column, high: Column, width: float) -> Column:
    """The bins that a closed range touches; none for an empty one."""
    first, last = F.floor(low / width), F.floor(high / width)
    return F.when(low <= high, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Each point with the ranges that hold it, low <= value < high. A range is in every bin of ``width`` that it touches, a point in one,
    so each pair meets once."""
    held = ranges.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(_bins(F.col(low), F.col(high), width)))
    at = points.withColumn("_bin", F.floor(F.col(value) / width))
    return at.join(held, "_bin").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")


def interval_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of closed intervals that overlap, of equal keys ``on``. A pair counts in the first bin that both touch."""
    (a0, a1), (b0, b1) = a_range, b_range
    x = a.withColumn("_bin", F.explode(_bins(F.col(a0), F.col(a1), width)))
    y = b.withColumn("_bin", F.explode(_bins(F.col(b0), F.col(b1), width)))
    met = x.join(y, ["_bin", *on]).where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)))
    return met.where(F.col("_bin") == F.floor(F.greatest(a0, b0) / width)).drop("_bin")


def as_of_join(left: DataFrame, right: DataFrame, time: str, on: tuple[str, ...], take: tuple[str, ...], prefix: str = "last_") -> DataFrame:
    """Each left row with columns ``take`` of the latest right row of its key that isn't later; of right rows at one time, the greatest.

    Both sides go through one shuffle as one stream of rows in the order of time, and the last right row is carried along.
    """
    own = F.struct(*[F.col(c).alias(c) for c in take])
    tag = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(own.alias("s")).schema["s"].dataType).alias("_r"))
    other = right.select(*on, time, F.lit(0).alias("_side"), own.alias("_r"))
    by = Window.partitionBy(*on).orderBy(time, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    seen = tag.unionByName(other, allowMissingColumns=True).withColumn("_last", F.last("_r", ignorenulls=True).over(by)).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_last.{c}").alias(f"{prefix}{c}") for c in take])
