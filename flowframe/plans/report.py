"""Report tables from what a run left behind; tables whose inputs are missing are skipped and named, never made up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.functions.hashing import SPLITS
from flowframe.operators import metrics
from flowframe.sources.sinks import write_table



def attention(weights: DataFrame, position: str) -> DataFrame:
    """Mean ``weight`` by sample and position, 0 where there is none; a column for each position."""
    return weights.groupBy("sample_index").pivot(position).agg(F.avg("weight")).fillna(0.0).orderBy("sample_index")


#: Each table: the inputs it needs, and how it is made from them.
TABLES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "confusion": (("predictions",), lambda p: metrics.confusion(p, "actual", "predicted")),
    "per_class": (("predictions",), lambda p: metrics.per_class(p, "actual", "predicted")),
    "overall": (("predictions",), lambda p: metrics.overall(metrics.per_class(p, "actual", "predicted"))),
    "roc": (("scores",), lambda s: metrics.curves(s, ["label"], "score", F.col("actual") == F.col("label"))),
    "auc": (("scores",), lambda s: metrics.auc(s, ["label"], "score", F.col("actual") == F.col("label"))),
    "average_precision": (("scores",), lambda s: metrics.average_precision(metrics.curves(s, ["label"], "score", F.col("actual") == F.col("label")), ["label"])),
    "class_distribution": (("rows",), lambda r: metrics.class_distribution(r, "label", SPLITS)),
    "learning_curve": (("history",), lambda h: metrics.running_best(h, "epoch", "score")),
    "latency": (("latencies",), lambda t: metrics.nearest_rank(t, ["name"], "milliseconds")),
    "importance": (("importance",), lambda i: i.orderBy(F.desc("importance"), "feature").limit(30)),
    "rate_schedule": (("history",), lambda h: h.select("epoch", "rate").orderBy("epoch")),
    "epoch_time": (("history",), lambda h: h.select("epoch", "seconds").orderBy("epoch")),
    "convergence": (("convergence",), lambda c: c.orderBy(F.desc("fitness"), "iteration").limit(30)),
    "spatial_attention": (("spatial_attention",), lambda a: attention(a, "node_index")),
    "temporal_attention": (("temporal_attention",), lambda a: attention(a, "timestep")),
    "ablation": (("ablation",), lambda a: a.orderBy(F.desc("macro_f1"), "variant").limit(30)),
}


def generate(inputs: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Writes every table whose inputs are there; returns for each table ``written`` or what it lacks."""
    out = {}
    for name, (needs, make) in TABLES.items():
        lacking = [n for n in needs if n not in inputs]
        if not lacking:
            write_table(make(*[inputs[n] for n in needs]), f"{folder}/{name}")
        out[name] = f"skipped: no {', '.join(lacking)}" if lacking else "written"
    return out
