"""Column profiles, histograms and parse checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowframe.functions.cleaning import is_infinite, unparsable


def unpivoted(row: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each column of a one-row table."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(key), F.col(f"`{c}`").alias(value)) for c in row.columns])).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``label, n, fraction``: counts with nulls, and shares of the rows that are not null (null for the null row)."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    known = counts.where("label is not null").agg(F.sum("n").alias("known"))
    return counts.crossJoin(F.broadcast(known)).select("label", "n", F.when(F.col("label").isNotNull(), F.round(F.col("n") / F.col("known"), 9)).alias("fraction"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_missing, n_infinite`` of columns that have any, in one pass."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    stats = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.coalesce(F.sum((F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False))).cast("long")), F.lit(0)).alias("n_missing"),
            F.coalesce(F.sum(F.coalesce(is_infinite(F.col(c)) if c in numeric else F.lit(False), F.lit(False)).cast("long")), F.lit(0)).alias("n_infinite"),
        )
        for c in columns
    ]).alias("all"))
    return stats.select(F.explode("all").alias("x")).select("x.*").where("n_missing > 0 or n_infinite > 0")


def parse_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_failed``: texts that are no numbers."""
    return unpivoted(df.agg(*[F.coalesce(F.sum(unparsable(F.col(c)).cast("long")), F.lit(0)).alias(c) for c in columns]), "column_name", "n_failed")


def failures(df: DataFrame, parsed: Column) -> DataFrame:
    """``n_rows, n_failed``: rows, and those whose value is null after parsing, nulls before included."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(parsed.isNull().cast("long")), F.lit(0)).alias("n_failed"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct(key)).alias("n_repeated"))
