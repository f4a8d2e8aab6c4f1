"""Joins of points to the intervals that hold them, as an equality: intervals are cut at fixed marks, and a point has one mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark(at: Column, width: int) -> Column:
    """The number of the last multiple of ``width`` that is not beyond an integer."""
    at = at.cast("long")
    return F.floor((at - F.pmod(at, F.lit(width).cast("long"))).cast("decimal(20,0)") / F.lit(width)).cast("long")  # exact


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int | None = None, how: str = "inner") -> DataFrame:
    """Each point with each interval of its ``keys`` for which ``start <= at < stop``, once; ``how`` is inner or left.

    Bounds and points are integers. Intervals are cut every ``width``, by default their mean length, so there are at most
    twice as many pieces as intervals; points and pieces meet by keys and mark, whatever a key holds of either. Intervals
    that end before they begin, or lack a bound, hold nothing; null keys are equal to none. Other columns keep their
    names, which points and intervals must not share.
    """
    whole = intervals.where(F.col(stop) > F.col(start))
    if width is None:
        mean = whole.agg(F.avg(F.col(stop) - F.col(start))).first()[0]  # one number
        width = max(1, round(mean or 1))
    pieces = whole.withColumn("__mark", F.explode(F.sequence(mark(F.col(start), width), mark(F.col(stop) - 1, width))))
    named = pieces.select(*[F.col(k).alias(f"__{k}") for k in keys], "__mark", *[c for c in intervals.columns if c not in keys])
    marked = points.withColumn("__point", mark(F.col(at), width))
    on = (F.col("__point") == F.col("__mark")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return marked.join(named, on, how).drop("__point", "__mark", *[f"__{k}" for k in keys])
