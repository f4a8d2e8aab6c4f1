"""Running sums over a whole table's order, without a task that holds it: ranges first, then sums inside and over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowframe.sources.staging import staged


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sums (new name: column) of all rows up to and with each in the order of ``order``, which has no ties.

    Rows are dealt into ranges of the order and staged; the ranges' totals, one row a partition, are summed apart.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"start_{n}") for n in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(starts), "range")
    return summed.select(*df.columns, *[(F.col(n) + F.col(f"start_{n}")).alias(n) for n in sums])


def hashed_totals(df: DataFrame, key: str, digest: str, sums: dict[str, str]) -> DataFrame:
    """As ``running_totals`` within each ``key``, in the order of a hex ``digest``: its first two digits are the range."""
    dealt = df.withColumn("range", F.substring(digest, 1, 2))
    totals = dealt.groupBy(key, "range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a key
    starts = totals.select(key, "range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"start_{n}") for n in sums])
    inside = Window.partitionBy(key, "range").orderBy(digest).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(starts, [key, "range"])
    return summed.select(*df.columns, *[(F.col(n) + F.col(f"start_{n}")).alias(n) for n in sums])


def places(df: DataFrame, key: str, row: str, name: str = "place", block: int = 65_536, wanted: DataFrame | None = None) -> DataFrame:
    """``df`` with each row's place among its key's rows in the order of ``row``, from 0; counted in blocks of row numbers.

    ``wanted`` (key, ``low``, ``high``; a few rows a key) says which places are needed: then only rows of blocks that hold
    places from ``low`` to before ``high`` are dealt, and come back. Rows are counted once without being dealt.
    """
    dealt = df.withColumn("range", F.expr(f"{row} div {block}"))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    counts = staged(dealt.groupBy(key, "range").agg(F.count("*").alias("n")), "block_counts")
    starts = counts.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if wanted is not None:
        asked = wanted.select(F.col(key).alias("of"), "low", "high")
        meets = (F.col(key) == F.col("of")) & (F.col("n_before") < F.col("high")) & (F.col("n_before") + F.col("n") > F.col("low"))
        starts = staged(starts.join(asked, meets, "left_semi"), "blocks")
        dealt = dealt.join(starts.select(key, "range"), [key, "range"], "left_semi")
    inside = F.row_number().over(Window.partitionBy(key, "range").orderBy(row))
    placed = dealt.withColumn(name, inside).join(starts.drop("n"), [key, "range"])
    return placed.select(*df.columns, (F.col(name) + F.col("n_before") - 1).alias(name))
