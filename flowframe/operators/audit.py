"""Audits: label coverage by split, rare labels, and leakage between windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.functions.hashing import SPLITS
from flowframe.operators.splits import leakage


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    """``split, label, n`` over every row, null labels too."""
    return rows.groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def label_audit(rows: DataFrame, label: str) -> DataFrame:
    """For each split: rows, rows without a label, distinct labels, and the sorted vocabulary of all splits."""
    counts = label_counts(rows, label)
    words = counts.agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("vocabulary"))
    per = counts.groupBy("split").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("n_unlabelled"), F.count("label").alias("n_labels"))
    return per.crossJoin(F.broadcast(words))


def missing_labels(rows: DataFrame, label: str) -> DataFrame:
    """``split, label``: labels of the vocabulary that a split lacks."""
    counts = label_counts(rows, label).where("label is not null")
    every = counts.select("label").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    return every.join(counts, ["split", "label"], "left_anti").select("split", "label")


def rare_labels(grouped: DataFrame, label: str, least: int = 3) -> DataFrame:
    """``label, n_groups``: labels in fewer than ``least`` groups, which cannot be in every split."""
    return grouped.groupBy(F.col(label).alias("label")).agg(F.countDistinct("group_id").alias("n_groups")).where(F.col("n_groups") < least)


def window_leakage(windows: DataFrame) -> DataFrame:
    """``kind, pair, shared``: groups and rows that windows of different splits share. Needs split, group_id, steps."""
    groups = leakage(windows.select("split", "group_id"), "group_id").withColumn("kind", F.lit("group"))
    rows = leakage(windows.select("split", F.explode("steps.sample_id").alias("sample_id")), "sample_id").withColumn("kind", F.lit("sample"))
    return groups.unionByName(rows).select("kind", "pair", "shared")
