"""Loaders: contract-checked samples of a folder of files, of which only the row groups asked for are read."""

from __future__ import annotations

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.functions.hashing import sample_id
from flowframe.operators import sampling
from flowframe.sources.flows import ContractError, with_provenance
from flowframe.sources.row_groups import file_row_groups, read_slices


def placed_rows(spark: SparkSession, path: str, table: DataFrame, rows_read: Accumulator | None = None) -> DataFrame:
    """The rows of the row groups in ``table`` with provenance, ``file_id``, ``row_id``, ``row_group`` and their ``inside`` place in it.

    ``table`` is that of ``file_row_groups``, or slices of it (``first``, ``take``). Places come with the files.
    """
    return with_provenance(read_slices(spark, path, table, rows_read=rows_read), "path", "row_id").drop("path")


def read_groups(spark: SparkSession, path: str, manifest: DataFrame, rows_read: Accumulator | None = None) -> DataFrame:
    """The rows of the groups in ``manifest`` with ``group_id`` and ``split``; row groups without a group are not opened."""
    table = file_row_groups(spark, path).select("file_id", "row_group", "start", "path")
    named = manifest.select("file_id", "row_group", F.col("offset").alias("first"), F.col("n_rows").alias("take"), "group_id", "split")
    return placed_rows(spark, path, named.join(table, ["file_id", "row_group"]), rows_read)


def _whole(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sample_id``, if no two have the same."""
    named = rows.withColumn("sample_id", sample_id(F.col("__source_file_id"), F.col("__source_row_id")))
    twice = named.groupBy("sample_id").count().where("count > 1").count()
    if twice:
        raise ContractError(f"{twice} rows share their identity with others")
    return named


def load_sample(spark: SparkSession, path: str, per_file: int, row_groups: int, seed: int, rows_read: Accumulator | None = None) -> DataFrame:
    """``per_file`` seeded rows of each file, from row groups spread over it; repeated identities are an error."""
    table = file_row_groups(spark, path)
    chosen = sampling.spread_row_groups(table.groupBy("file_id").agg(F.count("*").alias("total")), row_groups)
    rows = placed_rows(spark, path, table.drop("n_rows").join(chosen, ["file_id", "row_group"]), rows_read)
    return _whole(sampling.sample_rows(rows, per_file, seed).drop("inside"))


def load_slices(spark: SparkSession, path: str, samples: int, seed: int, min_run: int, most: int = 4, rows_read: Accumulator | None = None) -> DataFrame:
    """Contiguous slices of each file, in runs of ``min_run`` rows or more; repeated identities are an error."""
    table = file_row_groups(spark, path)
    plan = sampling.slice_plan(table, samples, seed, min_run, most).join(table.select("file_id", "row_group", "start", "path"), ["file_id", "row_group"])
    return _whole(placed_rows(spark, path, plan, rows_read).drop("inside"))
