"""Class scores in arrays: softmax, the winning class, and stamps of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Shares that sum to 1; the largest score is taken off first, so that nothing overflows."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def winner(scores: Column) -> Column:
    """The place of the largest score, from 0; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def epoch_seconds(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO stamp; null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(stamp, "Z$", "+00:00")))
