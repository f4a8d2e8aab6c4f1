"""Latency of a plan: warm-up runs, measured runs, and their nearest-rank percentiles as tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.operators.metrics import nearest_rank
from flowframe.sources.sinks import write_table


def measured(spark: SparkSession, name: str, run: Callable[[], object], warmups: int = 50, measurements: int = 500) -> DataFrame:
    """``name, measurement, milliseconds`` of ``run``, after ``warmups`` runs that do not count."""
    took = []
    for i in range(-warmups, measurements):
        began = time.perf_counter_ns()
        run()
        if i >= 0:
            took.append((name, i + 1, (time.perf_counter_ns() - began) / 1e6))
    return spark.createDataFrame(took, "name string, measurement int, milliseconds double")


def summary(times: DataFrame, rows: int = 1) -> DataFrame:
    """``name, n, p50, p95, mean, per_second`` where a run treats ``rows`` rows."""
    found = nearest_rank(times, ["name"], "milliseconds")
    return found.withColumn("per_second", F.round(F.try_divide(F.lit(1000.0 * rows), F.col("mean")), 6))


def write_benchmark(times: DataFrame, folder: str, rows: int = 1) -> None:
    """The measurements and their summary as CSV."""
    write_table(times, f"{folder}/measurements")
    write_table(summary(times, rows), f"{folder}/summary")
