"""Fit on the training split, apply everywhere: feature choice, medians, bounds, scaling and label codes.

Fitted values are a few numbers a column, so a fit is one or two aggregations and a transform is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowframe.functions.cleaning import min_max, number
from flowframe.operators.groups import rows_of_groups
from flowframe.operators.outlier import IsolationForest
from flowframe.operators.quantiles import exact_quantiles
from flowframe.operators.sampling import reservoir
from flowframe.sources.flows import ContractError
from flowframe.sources.staging import staged


def candidates(columns: list[str], excluded: set[str]) -> list[str]:
    """Columns that may be features: all but labels, identifiers, provenance and other non-numeric ones."""
    return [c for c in columns if c not in excluded]


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as finite doubles, anything else null."""
    return df.withColumns({c: number(F.col(c)) for c in columns})


def choose_features(train: DataFrame, columns: list[str], row_key: list[str]) -> dict[str, str]:
    """For each column ``kept``, ``empty``, ``duplicate of X`` or ``constant``, judged in that order.

    Columns with equal digests (order-free sums of hashes of key and value) are compared value by value before one
    counts as a duplicate; the first occurrence stays.
    """
    def digest(c: str):
        return F.sum(F.xxhash64(*row_key, c).cast("decimal(38,0)"))

    first = train.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), digest(c).alias("digest")).alias(c) for c in columns]).first()
    out = {c: "empty" for c in columns if first[c]["n"] == 0}
    pairs, seen = [], {}
    for c in columns:
        if c not in out:
            seen.setdefault(first[c]["digest"], []).append(c)
    for same in seen.values():
        pairs += [(a, b) for i, b in enumerate(same) for a in same[:i]]
    if pairs:
        equal = train.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        for i, (a, b) in enumerate(pairs):
            if equal[f"p{i}"] and b not in out and a not in out:
                out[b] = f"duplicate of {a}"
    for c in columns:
        if c not in out:
            out[c] = "constant" if first[c]["low"] == first[c]["high"] else "kept"
    return {c: out[c] for c in columns}


def medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, median``: exact, between the middle values where two are; null without values."""
    doubles = train.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return exact_quantiles(doubles, columns, 0.5).withColumnRenamed("quantile", "median")


@dataclass(frozen=True)
class Fitted:
    """What the training split taught: decisions, medians, bounds, label codes, and the forest that tells outliers."""

    decisions: dict[str, str]
    median: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    labels: list[str] = field(default_factory=list)
    forest: IsolationForest | None = None

    @property
    def features(self) -> list[str]:
        return list(self.median)


def fit(df: DataFrame, columns: list[str], row_key: list[str], label: str, inlier: str | None = None, forest: dict | None = None, vocabulary: DataFrame | None = None) -> Fitted:
    """Learns from ``split = 'train'``; bounds come from the training rows that are no outliers.

    Outliers are the rows that ``inlier`` does not mark and, if ``forest`` gives its settings, those that an isolation
    forest finds among the imputed training rows. Labels are those of ``vocabulary``, by default of ``df``. The training
    rows are made once and staged, with what the passes over them need.
    """
    train = coerced(df.where("split = 'train'"), columns)
    marked = F.coalesce(F.expr(inlier), F.lit(False)) if inlier else F.lit(True)
    train = staged(train.select(*dict.fromkeys([*row_key, *columns]), marked.alias("__inside")), "training")
    decisions = choose_features(train, columns, row_key)
    kept = [c for c in columns if decisions[c] == "kept"]
    found = {r["column_name"]: r["median"] for r in medians(train, kept).collect()} if kept else {}
    middle = {c: found[c] for c in kept}
    inside = train.where("__inside")
    filled = inside.withColumns({c: F.coalesce(c, F.lit(middle[c])) for c in kept})
    grown = IsolationForest.fit(filled, kept, row_key, **forest) if forest is not None and kept else None
    if grown:
        filled = grown.inliers(filled)
    bounds = filled.agg(*[f(c).alias(f"{c}_{n}") for c in kept for n, f in (("low", F.min), ("high", F.max))]).first() if kept else {}
    if kept and bounds[f"{kept[0]}_low"] is None:
        raise ValueError("no training row is left")
    labels = sorted(r[0] for r in (df if vocabulary is None else vocabulary).select(label).where(F.col(label).isNotNull()).distinct().collect())
    return Fitted(decisions, middle, {c: bounds[f"{c}_low"] for c in kept}, {c: bounds[f"{c}_high"] for c in kept}, labels, grown)


def fit_on_reservoir(flows: DataFrame, manifest: DataFrame, groups: int, seed: int, rows_per_group: int, group_rows: int, columns: list[str], label: str, **more) -> Fitted:
    """A fit on ``groups`` whole training groups of each file, with the labels of all flows."""
    few = reservoir(manifest.where("split = 'train'"), groups, seed)
    return fit(rows_of_groups(flows, few, rows_per_group, group_rows, few=True), columns, ["file_id", "row_id"], label, vocabulary=flows, **more)


def transform(df: DataFrame, fitted: Fitted, inlier: str | None = None, clip: bool = False) -> DataFrame:
    """Imputed and scaled features; outliers leave the training split only, so other splits keep all rows."""
    rows = df.where((F.col("split") != "train") | F.expr(inlier)) if inlier else df
    filled = coerced(rows, fitted.features).withColumns({c: F.coalesce(c, F.lit(fitted.median[c])) for c in fitted.features})
    if fitted.forest:
        filled = fitted.forest.inliers(filled.where("split = 'train'")).unionByName(filled.where("split <> 'train'"))
    return filled.withColumns({c: min_max(F.col(c), F.lit(fitted.low[c]), F.lit(fitted.high[c]), clip=clip) for c in fitted.features})


def clip_counts(scaled: DataFrame, columns: list[str]) -> DataFrame:
    """``split, n_values, n_outside``: feature values beyond the bounds of training, by split."""
    outside = sum((((F.col(c) < 0) | (F.col(c) > 1)).cast("long") for c in columns), F.lit(0))
    return scaled.groupBy("split").agg((F.count("*") * len(columns)).alias("n_values"), F.sum(outside).cast("long").alias("n_outside"))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``label, code``: labels in sorted order, from 0."""
    names = df.select(F.col(label).alias("label")).where("label is not null").distinct()
    return names.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))  # one row a label


def unknown_label(label: Column) -> Column:
    """An error that names the label."""
    return F.raise_error(F.concat(F.lit("label outside the vocabulary: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("long")


def require_known(df: DataFrame, label: str, known: list[str]) -> None:
    """Raises where ``df`` has labels beside the known ones, and names the first 20 of them in order; null is none of them."""
    unknown = df.select(F.col(label).cast("string").alias("label")).where("label is not null").distinct()
    names = F.array(*[F.lit(x) for x in known]).cast("array<string>")
    first = [r["label"] for r in unknown.where(~F.array_contains(names, F.col("label"))).orderBy("label").limit(20).collect()]
    if first:
        raise ContractError(f"label outside the vocabulary: {', '.join(first)}")


def encoded(df: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    """``df`` with ``code``; a label without one is an error."""
    joined = df.join(codes.withColumnRenamed("label", "known"), F.col(label) == F.col("known"), "left").drop("known")
    return joined.withColumn("code", F.when(F.col("code").isNull(), unknown_label(F.col(label))).otherwise(F.col("code")))
