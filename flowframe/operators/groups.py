"""Contiguous groups of rows, and the manifest of whole groups inside row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.functions.hashing import SPLITS, sample_id, stream_split
from flowframe.operators.order import places
from flowframe.sources.flows import ContractError, require

GROUP_ROWS = 64


def with_groups(flows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``group_id`` (file and block of rows) and ``sample_id``; negative rows are an error."""
    require(flows, ["file_id", "row_id"], "groups")
    row = F.when(F.col("row_id") < 0, F.raise_error(F.lit("row ids must not be negative"))).otherwise(F.col("row_id"))
    block = F.expr(f"row_id div {group_rows}")
    group = F.concat(F.col("file_id"), F.lit("::block="), F.when(row.isNotNull(), block).cast("string"))
    return flows.withColumns({"group_id": group, "sample_id": sample_id(F.col("file_id"), F.col("row_id"))})


def group_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("group_id").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def row_groups(flows: DataFrame, rows_per_group: int) -> DataFrame:
    """``file_id, row_group, rows`` as a footer would tell; row groups hold ``rows_per_group`` rows, the last one the rest."""
    files = flows.groupBy("file_id").agg(F.count("*").alias("total"))
    numbered = files.select("file_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {rows_per_group}"))).alias("row_group"))
    return numbered.select("file_id", "row_group", F.least(F.lit(rows_per_group), F.col("total") - F.col("row_group") * rows_per_group).cast("long").alias("n_rows"))


def group_manifest(row_group_table: DataFrame, group_rows: int, outer: float, seed: int) -> DataFrame:
    """One row for each group: its place inside a row group, its id and its split. Data is not read."""
    offsets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(group_rows).cast("long")))
    cut = row_group_table.select("file_id", "row_group", F.col("n_rows").alias("whole"), offsets.alias("offset"))
    cut = cut.withColumn("n_rows", F.least(F.lit(group_rows), F.col("whole") - F.col("offset")).cast("long")).drop("whole")
    name = F.concat("file_id", F.lit("::rg="), F.col("row_group").cast("string"), F.lit("::offset="), F.col("offset").cast("string"), F.lit("::rows="), F.col("n_rows").cast("string"))
    named = cut.withColumn("group_id", name)
    return named.withColumn("split", stream_split(F.col("group_id"), outer, seed))


def require_splits(manifest: DataFrame) -> DataFrame:
    """``manifest``, if it has groups of all three splits."""
    found = {r["split"] for r in manifest.select("split").distinct().collect()}  # three at most
    if found != set(SPLITS):
        raise ContractError(f"the manifest lacks groups of {sorted(set(SPLITS) - found)}")
    return manifest


def rows_of_groups(flows: DataFrame, manifest: DataFrame, rows_per_group: int, group_rows: int, few: bool = False) -> DataFrame:
    """The rows of each group: the interval join turned into an equality of (file, row group, offset).

    ``few`` says that the manifest has a few groups of each file: then only the rows near them are numbered.
    """
    low = F.col("row_group") * rows_per_group + F.col("offset")
    asked = manifest.select("file_id", low.alias("low"), (low + F.col("n_rows")).alias("high")) if few else None
    at = places(flows, "file_id", "row_id", wanted=asked).withColumns({
        "row_group": F.expr(f"place div {rows_per_group}"), "offset": F.expr(f"(place % {rows_per_group}) div {group_rows} * {group_rows}"),
    })
    return at.drop("place").join(manifest, ["file_id", "row_group", "offset"])


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(
        F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("group_id").alias("n_ids"),
    )
