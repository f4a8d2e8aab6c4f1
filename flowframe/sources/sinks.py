"""Sinks: documents, split manifests, window tables, fitted parameters and metric tables.

Data goes through Spark's writers and their commit protocol; a document is one row of text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowframe.operators.outlier import IsolationForest
from flowframe.operators.preprocess import Fitted
from flowframe.sources.flows import read_json

#: Columns of a split manifest, of which those that exist are written.
MANIFEST = ("sample_id", "group_id", "split", "file_id", "row_id", "label")


def write_json(spark: SparkSession, content: Mapping[str, Any], path: str) -> None:
    """One JSON document, replaced as a whole."""
    text = json.dumps(content, indent=1, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_split_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*[c for c in MANIFEST if c in rows.columns]).write.mode("overwrite").csv(path, header=True)


def write_windows(windows: DataFrame, path: str) -> None:
    """Nested windows and graphs by split, compressed."""
    windows.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def write_table(df: DataFrame, path: str, digits: int = 6) -> None:
    """A metric table as CSV with a header, its doubles rounded."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def save_fitted(spark: SparkSession, fitted: Fitted, path: str) -> str:
    """Fitted parameters as a document; returns the hash of the feature order, which it also holds."""
    order = hashlib.sha256(json.dumps(fitted.features).encode()).hexdigest()
    write_json(spark, {"decisions": fitted.decisions, "features": fitted.features, "median": fitted.median, "low": fitted.low, "high": fitted.high, "labels": fitted.labels, "order": order, "forest": fitted.forest and fitted.forest.document()}, path)
    return order


def load_fitted(spark: SparkSession, path: str, order: str | None = None) -> Fitted:
    """The parameters again; another feature order than ``order`` is refused."""
    d = read_json(spark, path)
    if order is not None and d["order"] != order:
        raise ValueError("fitted for another order of features")
    pick = lambda name: {c: d[name][c] for c in d["features"]}
    return Fitted(d["decisions"], pick("median"), pick("low"), pick("high"), d["labels"], IsolationForest.from_document(d["forest"]) if d.get("forest") else None)
