"""Sources: contract-checked Parquet with provenance, and the event table read as a flow table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Provenance columns.
PROVENANCE = ("__capture_day", "__source_file_id", "__source_row_id")


class ContractError(ValueError):
    """A table or its manifests break the agreed contract."""


def canonical_columns(df: DataFrame) -> DataFrame:
    """Trims column names; names that become equal are an error."""
    names = [c.strip() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ContractError(f"columns collide after trimming: {twice}")
    return df.toDF(*names)


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raises where a column is missing, and names all that are."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ContractError(f"{what}: missing columns {lacking}")


def role(columns: Iterable[str], candidates: Iterable[str], what: str) -> str:
    """The one candidate that is a column."""
    found = [c for c in candidates if c in set(columns)]
    if len(found) != 1:
        raise ContractError(f"{what}: exactly one of {list(candidates)} must be a column, found {found}")
    return found[0]


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields]).encode()).hexdigest()


#: Hex digits of a word of a table's digest, exact in a long, and words.
WORD, WORDS = 15, 4


def digest_words(df: DataFrame) -> DataFrame:
    """``n_rows, word_1 .. word_4``: sums over the rows of parts of each row's SHA-256, as text.

    The same for the same rows in any order and partitioning, repeated rows counted; columns count by name.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    word = lambda k: F.conv(F.substring("row", 1 + k * WORD, WORD), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(word(k)), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"word_{k + 1}") for k in range(WORDS)]
    return df.select(row.alias("row")).agg(F.count("*").alias("n_rows"), *sums)


def table_digest(df: DataFrame) -> str:
    """A digest of a table's columns, their types and its rows, whatever their order."""
    columns = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(json.dumps([columns, list(digest_words(df).first())]).encode()).hexdigest()


def config_hash(config: Mapping[str, Any]) -> str:
    """The same for the same settings, whatever their order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the settings of ``over``, mappings merged in depth."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON document from any file system that Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_flows(spark: SparkSession, path: str, expected_files: int | None = None) -> DataFrame:
    """All Parquet files below ``path`` with trimmed names and, where they are absent, provenance columns.

    ``__file_path`` and ``__row_index`` come last. The file name and the row's place in the file are the identity; the folder is the capture day.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    meta = df.select("*", F.col("_metadata.file_path").alias("__file_path"), F.col("_metadata.row_index").alias("__row_index"))
    out = canonical_columns(meta)
    if expected_files is not None:
        found = out.select("__file_path").distinct().count()
        if found != expected_files:
            raise ContractError(f"expected {expected_files} files, found {found}")
    return with_provenance(out, "__file_path", "__row_index")


def with_provenance(rows: DataFrame, file: str, row: str) -> DataFrame:
    """``rows`` with those provenance columns that they lack, from the columns that hold a row's file and place in it."""
    derived = {"__source_file_id": F.col(file), "__source_row_id": F.col(row), "__capture_day": F.element_at(F.split(file, "/"), -2)}
    return rows.withColumns({c: derived[c] for c in PROVENANCE if c not in rows.columns})


def validate_manifests(spark: SparkSession, folder: str, expected: Mapping[str, Any], labels: Iterable[str], timestamps: Iterable[str]) -> dict[str, Any]:
    """Checks the dataset's manifests against ``expected`` and resolves the label and timestamp columns.

    ``expected`` may name source_file_count, original_column_count, output_column_count and schema_hash.
    """
    summary, report, schema = (read_json(spark, f"{folder}/{n}.json") for n in ("dataset_summary", "validation_report", "column_schema"))
    wrong = []
    if report.get("status") != "passed" or report.get("error_count") != 0:
        wrong.append("validation did not pass")
    found = summary | schema
    wrong += [f"{k}: expected {v}, found {found.get(k)}" for k, v in expected.items() if found.get(k) != v]
    wrong += [f"missing provenance column {c}" for c in PROVENANCE if c not in schema.get("provenance_columns_appended", [])]
    if wrong:
        raise ContractError("; ".join(wrong))
    columns = [c.strip() for c in schema["original_columns"]]
    return {"label": role(columns, labels, "label"), "timestamp": role(columns, timestamps, "timestamp"), "rows": summary.get("total_rows")}


#: Values beyond this are outliers of the event table; their rows leave gaps.
OUTLIER_VALUE = 250.0


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table in the roles of a flow table: one file a day, the event id as row, user and key as endpoints."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("day="), F.date_format("ts", "yyyy-MM-dd")).alias("file_id"), F.col("event_id").alias("row_id"),
        F.col("event_type").alias("label"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("k"), key).alias("dst"),
        "value", F.hour("ts").cast("long").alias("hour"), "user_id", key.cast("long").alias("k"), (F.col("value") <= OUTLIER_VALUE).alias("inlier"),
    )
