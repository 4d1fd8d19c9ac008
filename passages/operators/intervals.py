"""Points joined with the intervals that hold them, as tables on both sides.

An interval of length n is filed under the level 2^k just above n, where it lies in at most two bins; a point looks into one bin of
every level that occurs. So the join is on equal keys (sequence, level, bin) whatever the lengths are: long and short intervals do not
share bins, a long sequence is spread over its bins, and what is copied is at most two rows an interval and one a level and point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """All pairs of a point and an interval of its keys with ``start <= point < end``: the columns of both, keys once.

    Places are whole numbers. Empty intervals and rows with a null key or place meet nothing; columns of the two tables must not
    share names beside the keys."""
    keys = list(keys)
    length = F.col(end) - F.col(start)
    filed = intervals.filter(length > 0).withColumn("__level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    levels = [r[0] for r in filed.select("__level").distinct().orderBy("__level").collect()]  # at most 64 values
    bins = F.sequence(_bin(F.col(start), F.col("__level")), _bin(F.col(end) - 1, F.col("__level")))
    filed = filed.withColumn("__bin", F.explode(bins))
    asked = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asked = asked.withColumn("__bin", _bin(F.col(point), F.col("__level")))
    met = asked.join(filed, [*keys, "__level", "__bin"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))
    return met.drop("__level", "__bin")
