"""Isolation forest: trees grown on small seeded samples, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.functions.hashing import seeded_hash
from flowframe.operators.quantiles import exact_quantiles
from flowframe.sources.staging import staged

#: Trees, rows of a tree, share of outliers, and Euler's constant in the expected depth.
TREES, TREE_ROWS, CONTAMINATION = 100, 256, 0.01
EULER = 0.5772156649015329


def expected_depth(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int, depth: int = 0) -> tuple:
    """A tree of (column, cut, left, right), or the depth that a leaf stands for."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else ()
    if depth >= limit or not len(spread):
        return (depth + expected_depth(len(x)),)
    column = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    left = x[:, column] < cut
    return column, cut, grow(x[left], rng, limit, depth + 1), grow(x[~left], rng, limit, depth + 1)


def depths(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = depths(tree[2], x[left]), depths(tree[3], x[~left])
    return out


@dataclass(frozen=True)
class IsolationForest:
    columns: tuple[str, ...]
    trees: tuple[tuple, ...]
    expected: float
    threshold: float

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], key: list[str], seed: int = 42, trees: int = TREES, tree_rows: int = TREE_ROWS, contamination: float = CONTAMINATION) -> IsolationForest:
        """Grows the trees on a sample of about ``trees * tree_rows`` rows (the bound of what reaches the driver), and
        sets the threshold at the ``contamination`` quantile of the training scores."""
        total, slots = train.count(), 1 << 30
        share = min(slots, slots * trees * tree_rows // max(1, total) + 1)
        few = train.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(slots)) < share).select(*columns, seeded_hash(seed, *[F.col(c) for c in key]).alias("h"))
        x = few.toPandas().sort_values("h")[columns].fillna(0.0).to_numpy(float)
        rng, n = np.random.default_rng(seed), min(tree_rows, len(x))
        limit = int(np.ceil(np.log2(max(2, n))))
        grown = tuple(grow(x[rng.choice(len(x), n, replace=False)], rng, limit) for _ in range(trees)) if n else ()
        forest = cls(tuple(columns), grown, expected_depth(n) or 1.0, 2.0)
        scores = staged(forest.score(train).select("score"), "scores") if n else None
        at = exact_quantiles(scores, ["score"], 1.0 - contamination).first()["quantile"] if n else 2.0
        return cls(forest.columns, grown, forest.expected, float(at))

    def score(self, rows: DataFrame, name: str = "score", flag: str = "outlier") -> DataFrame:
        """``rows`` with ``name`` (towards 1: easily isolated) and ``flag``; missing values count as 0."""
        columns, trees, expected = list(self.columns), self.trees, self.expected

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[columns].fillna(0.0).to_numpy(float)
                mean = np.mean([depths(t, x) for t in trees], axis=0) if trees else np.zeros(len(x))
                yield batch.assign(**{name: 2.0 ** (-mean / expected)})

        scored = rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))
        return scored.withColumn(flag, F.col(name) > self.threshold)

    def inliers(self, rows: DataFrame) -> DataFrame:
        """The rows that are no outliers, with their own columns."""
        return self.score(rows, "__isolation", "__outlier").where("not __outlier").select(*rows.columns)

    def document(self) -> dict:
        return {"columns": self.columns, "trees": self.trees, "expected": self.expected, "threshold": self.threshold}

    @classmethod
    def from_document(cls, made: dict) -> IsolationForest:
        def tree(x: list) -> tuple:
            return tuple(tree(y) if isinstance(y, list) else y for y in x)

        return cls(tuple(made["columns"]), tuple(tree(t) for t in made["trees"]), made["expected"], made["threshold"])
