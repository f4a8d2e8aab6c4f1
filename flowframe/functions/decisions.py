"""What to do next about a run: an ordered cascade of rules over its states and counters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the rules: seconds and counts.
LIMITS = {"stale_seconds": 7200.0, "guard_seconds": 1800.0, "attempts": 8, "stagnant": 3}


def next_session(run: Mapping[str, Column], limits: Mapping[str, float] = LIMITS) -> Column:
    """A struct of ``push`` and ``reason``; the first rule that holds decides.

    ``run`` has force, known (is there a run at all), status, kernel, silent (seconds since the last sign of life, null
    if there was none), since_push (seconds, null if never), attempts, and stagnant.
    """
    alive = F.coalesce(run["silent"] < limits["stale_seconds"], F.lit(True))
    rules = [
        (run["force"], True, F.lit("forced")),
        (run["status"] == "completed", False, F.lit("complete")),
        (run["kernel"].isin("running", "queued"), False, F.concat(F.lit("kernel "), run["kernel"])),
        ((run["status"] == "running") & (run["kernel"] == "unknown") & alive, False, F.lit("not silent for long")),
        (run["since_push"] < limits["guard_seconds"], False, F.lit("pushed lately")),
        (run["attempts"] >= limits["attempts"], False, F.lit("attempts used up")),
        (run["stagnant"] >= limits["stagnant"], False, F.lit("no progress")),
        (run["status"] == "paused", True, F.lit("paused")),
        (~run["known"], True, F.lit("no run")),
    ]
    out = F
    for holds, push, reason in rules:
        out = out.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(push).alias("push"), reason.alias("reason")))
    return out.otherwise(F.struct(F.lit(True).alias("push"), F.concat(F.lit("incomplete, kernel "), run["kernel"]).alias("reason")))
