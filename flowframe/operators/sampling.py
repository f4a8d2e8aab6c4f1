"""Deterministic samples: spread row groups, contiguous slices, seeded rows, whole-group reservoirs and epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowframe.functions.hashing import leading_64, seeded_hash
from flowframe.operators.order import places


def spread_row_groups(totals: DataFrame, desired: int) -> DataFrame:
    """For each file the indices of ``desired`` row groups spread evenly from the first to the last.

    ``totals`` has ``file_id`` and ``total`` (row groups). Halves round to even, equal indices count once.
    """
    k = F.least(F.lit(desired), F.col("total"))
    step = F.when(k > 1, (F.col("total") - 1) / (k - 1)).otherwise(F.lit(0.0))
    at = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.bround(i * F.col("step"), 0).cast("long"))
    return totals.withColumn("step", step.cast("double")).select("file_id", F.explode(F.array_sort(F.array_distinct(at))).alias("row_group"))


def slice_plan(row_group_table: DataFrame, samples: int, seed: int, min_run: int, most: int = 4) -> DataFrame:
    """For each file the slice of each chosen row group: ``first`` (place in the row group) and ``take`` rows."""
    files = row_group_table.groupBy("file_id").agg(F.count("*").alias("total"))
    number = F.least(F.col("total"), F.lit(max(1, min(most, samples // min_run))))
    chosen = files.withColumn("k", number)
    step = F.when(F.col("k") > 1, (F.col("total") - 1) / (F.col("k") - 1)).otherwise(F.lit(0.0)).cast("double")
    at = F.transform(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")), lambda i: F.bround(i * F.col("step"), 0).cast("long"))
    spread = chosen.withColumn("step", step).select("file_id", "k", F.posexplode(F.array_sort(F.array_distinct(at))).alias("place", "row_group"))
    quota = F.expr(f"{samples} div k") + F.when(F.col("place") < F.lit(samples) % F.col("k"), 1).otherwise(0)
    sized = spread.join(row_group_table, ["file_id", "row_group"]).withColumn("take", F.least(quota, F.col("n_rows")).cast("long"))
    room = F.col("n_rows") - F.col("take")
    drawn = (leading_64(seeded_hash(seed, F.col("file_id"), F.col("row_group"))) % (room + 1).cast("decimal(20,0)")).cast("long")
    aligned = F.expr(f"drawn div {min_run} * {min_run}")
    return sized.withColumn("drawn", drawn).select("file_id", "row_group", F.least(aligned, room).alias("first"), "take")


def slice_rows(flows: DataFrame, plan: DataFrame, rows_per_group: int) -> DataFrame:
    """The rows of the planned slices, in source order within their file."""
    low = F.col("row_group") * rows_per_group + F.col("first")
    asked = plan.select("file_id", low.alias("low"), (low + F.col("take")).alias("high"))
    at = places(flows, "file_id", "row_id", wanted=asked).withColumn("row_group", F.expr(f"place div {rows_per_group}"))
    inside = F.col("place") % rows_per_group
    return at.join(plan, ["file_id", "row_group"]).where((inside >= F.col("first")) & (inside < F.col("first") + F.col("take"))).drop("place", "first", "take")


def spread_sample(flows: DataFrame, row_group_table: DataFrame, per_file: int, desired: int, seed: int, rows_per_group: int) -> DataFrame:
    """``per_file`` seeded rows of each file, from ``desired`` row groups spread over it."""
    chosen = spread_row_groups(row_group_table.groupBy("file_id").agg(F.count("*").alias("total")), desired)
    low = F.col("row_group") * rows_per_group
    asked = chosen.select("file_id", low.alias("low"), (low + rows_per_group).alias("high"))
    at = places(flows, "file_id", "row_id", wanted=asked).withColumn("row_group", F.expr(f"place div {rows_per_group}"))
    return sample_rows(at.join(chosen, ["file_id", "row_group"]).drop("place"), per_file, seed)


def sample_rows(flows: DataFrame, per_file: int, seed: int) -> DataFrame:
    """``per_file`` rows of each file, those with the smallest seeded hash."""
    order = Window.partitionBy("file_id").orderBy(seeded_hash(seed, F.col("file_id"), F.col("row_id")), "row_id")
    return flows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_file).drop("place")


def reservoir(manifest: DataFrame, groups: int, seed: int) -> DataFrame:
    """``groups`` whole groups for each file and split."""
    order = Window.partitionBy("file_id", "split").orderBy(seeded_hash(seed, F.col("group_id")), "group_id")
    return manifest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= groups).drop("place")


def epoch_schedule(manifest: DataFrame, epochs: int, seed: int) -> DataFrame:
    """Every training group once an epoch, in an order that seed and epoch decide.

    Places are counted in 256 ranges of the hash, so that no task orders a whole epoch.
    """
    train = manifest.where("split = 'train'").select("group_id", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    drawn = train.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), "group_id"), 256)).withColumn("range", F.substring("h", 1, 2))
    counts = drawn.groupBy("epoch", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("epoch", "range", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("epoch", "range").orderBy("h", "group_id"))
    return drawn.withColumn("inside", inside).join(starts, ["epoch", "range"]).select("epoch", (F.col("start") + F.col("inside") - 1).alias("place"), "group_id")
