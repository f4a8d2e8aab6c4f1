"""Settings: a base document with a mode's overrides, checked before anything runs; and the choice of a dataset root."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.sources.flows import merged

#: Allowed outer training fractions.
OUTER = (0.7, 0.8)
#: Settings that are lists of column names, and settings with one value that is supported.
NAMES = ("data.labels", "data.timestamps", "data.provenance", "data.identifiers", "data.non_numeric")
ONLY = {
    "windows.target": "last", "windows.missing_endpoint": "drop", "windows.direction": "directed", "model.best_by": "macro_f1",
    "training.device": "cpu", "training.mixed_precision": False, "training.deterministic": True,
}
#: Points of a dataset root for a matching name, a data folder and a validation report.
POINTS = {"hint": 100, "data": 50, "report": 20}


def load_settings(spark: SparkSession, base: str, mode: str | None = None) -> dict[str, Any]:
    """YAML settings from any file system that Spark reads; ``mode`` overrides ``base`` in depth."""
    read = lambda path: yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())) or {}
    return check_settings(merged(read(base), read(mode) if mode else {}))


def check_settings(s: Mapping[str, Any], sections: tuple[str, ...] = ()) -> dict[str, Any]:
    """``s`` if all its values are in range and it has these sections; every fault is named."""
    get = lambda path, default: _at(s, path.split("."), default)
    faults = [f"{path} must be positive" for path in ("data.group_rows", "splits.attempts", "windows.length", "windows.stride") if not get(path, 1) > 0]
    faults += ["splits.outer must be 0.7 or 0.8"] * (get("splits.outer", 0.7) not in OUTER)
    faults += ["splits.validation_share must lie between 0 and 1"] * (not 0 < get("splits.validation_share", 0.1) < 1)
    faults += ["preprocessing.contamination must lie between 0 and 0.5"] * (not 0 < get("preprocessing.contamination", 0.01) < 0.5)
    faults += ["preprocessing.missing must be median"] * (get("preprocessing.missing", "median") != "median")
    low, high = get("preprocessing.scale", [0.0, 1.0])
    faults += ["preprocessing.scale must ascend"] * (not low < high)
    faults += ["windows.length must not exceed data.group_rows"] * (get("windows.length", 16) > get("data.group_rows", 4096))
    faults += ["windows.length must be 2 at least"] * (get("windows.length", 16) < 2)
    faults += [f"section {name} is missing" for name in sections if name not in s]
    faults += ["splits.outer_fractions must be 0.7 and 0.8"] * (sorted(get("splits.outer_fractions", OUTER)) != sorted(OUTER))
    faults += [f"{path} must be a list of names" for path in NAMES if not isinstance(get(path, []), list) or any(not isinstance(x, str) for x in get(path, []))]
    faults += [f"{path} must be {only}" for path, only in ONLY.items() if get(path, only) != only]
    faults += [f"{path} must be a name" for path in ("windows.source", "windows.destination", "windows.namespace") if not isinstance(get(path, "-"), str) or not get(path, "-").strip()]
    faults += [f"model.{name} must be positive" for name, size in (get("model.sizes", {}) or {}).items() if not size > 0]
    faults += ["model.dropout must lie between 0 and 1, 1 excluded"] * (not 0 <= get("model.dropout", 0.0) < 1)
    faults += ["model.outer must be 0.7 or 0.8"] * (get("model.outer", 0.7) not in OUTER)
    if faults:
        raise ValueError("; ".join(faults))
    return dict(s)


def _at(s: Any, keys: list[str], default: Any) -> Any:
    for k in keys:
        if not isinstance(s, Mapping) or k not in s:
            return default
        s = s[k]
    return s


def rank_roots(files: DataFrame, hint: str) -> DataFrame:
    """``root, points``: folders above a data folder of Parquet files, the likeliest first, deeper ones first of equals.

    ``files`` has ``path``. A root's name may match the hint, and a validation report may lie beside its data.
    """
    parts = F.split("path", "/data/")
    roots = files.where(F.col("path").endswith(".parquet") & F.contains("path", F.lit("/data/"))).select(parts[0].alias("root")).distinct()
    reports = files.where(F.col("path").endswith("validation_report.json")).select(F.regexp_replace("path", "(/manifests)?/validation_report.json$", "").alias("root")).distinct().withColumn("report", F.lit(POINTS["report"]))
    named = F.when(F.contains(F.lower("root"), F.lit(hint.lower())), POINTS["hint"]).otherwise(0)
    scored = roots.join(reports, "root", "left").select("root", (named + POINTS["data"] + F.coalesce("report", F.lit(0))).alias("points"))
    return scored.orderBy(F.desc("points"), F.desc(F.size(F.split("root", "/"))), "root")
