"""Row windows over gap-free runs, and the small directed graph of each window.

Rows are dealt by group once; runs, windows and graphs all stay on that partitioning. A row belongs to at most
ceil(length / stride) windows, so windows are built by grouping, not by a frame for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowframe.functions.cleaning import stripped, valid_endpoint
from flowframe.functions.hashing import endpoint_hash
from flowframe.operators.intervals import interval_join
from flowframe.operators.order import running_totals
from flowframe.sources.flows import require
from flowframe.sources.staging import staged

LENGTH, STRIDE, NAMESPACE = 16, 8, "flowframe"


def with_runs(grouped: DataFrame) -> DataFrame:
    """Adds ``run`` (equal within rows that follow each other) and ``run_pos`` (from 0). A repeated row is an error."""
    require(grouped, ["group_id", "row_id"], "windows")
    by_row = Window.partitionBy("group_id").orderBy("row_id")
    runs = grouped.withColumn("run", F.col("row_id") - F.row_number().over(by_row))
    twice = F.lag("row_id").over(by_row) == F.col("row_id")
    runs = runs.withColumn("run", F.when(twice, F.raise_error(F.lit("source rows repeat within a group")).cast("long")).otherwise(F.col("run")))
    return runs.withColumn("run_pos", F.row_number().over(Window.partitionBy("group_id", "run").orderBy("row_id")) - 1)


def run_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("group_id", "run").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n_rows"))


def windows(runs: DataFrame, columns: dict[str, Column], length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """``group_id, run, window, first_row, steps``: full windows only, starting anew at each run.

    ``steps`` is an array of structs in row order: ``row_id`` and the given columns.
    """
    last = F.expr(f"run_pos div {stride}")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("run_pos") - (length - 1)) / stride).cast("long"))
    dealt = runs.select("group_id", "run", F.struct(F.col("row_id"), *[c.alias(n) for n, c in columns.items()]).alias("step"), F.explode(F.sequence(first, last)).alias("window"))
    made = dealt.groupBy("group_id", "run", "window").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return made.where(F.size("steps") == length).select("group_id", "run", "window", F.col("steps")[0]["row_id"].alias("first_row"), "steps")


def endpoints_valid(steps: str = "steps") -> Column:
    return F.forall(steps, lambda s: valid_endpoint(s["src"]) & valid_endpoint(s["dst"]))


def with_graph(made: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Adds ``nodes`` (sorted distinct endpoint hashes), ``edges`` (one a step: time, src, dst), and ``target``.

    The steps need src, dst and label. Indices count from 0; loops and repeated edges stay.
    """
    hashed = made.withColumn("ends", F.transform("steps", lambda s: F.struct(endpoint_hash(stripped(s["src"]), namespace).alias("s"), endpoint_hash(stripped(s["dst"]), namespace).alias("d"))))
    nodes = F.sort_array(F.array_distinct(F.concat(F.transform("ends", lambda e: e["s"]), F.transform("ends", lambda e: e["d"]))))
    hashed = hashed.withColumn("nodes", nodes)
    edge = F.transform("ends", lambda e, t: F.struct(t.alias("time"), (F.array_position(F.col("nodes"), e["s"]) - 1).alias("src"), (F.array_position(F.col("nodes"), e["d"]) - 1).alias("dst")))
    return hashed.withColumns({"edges": edge, "target": F.element_at("steps", -1)["label"]}).drop("ends")


# Every window has nodes and edges, so the outer forms give the same rows; the others would add a filter on the arrays' sizes,
# for which the optimizer makes the arrays a second time, the nodes once for each edge.


def node_rows(graphs: DataFrame) -> DataFrame:
    return graphs.select("group_id", "first_row", F.posexplode_outer("nodes").alias("node", "node_hash"))


def edge_rows(graphs: DataFrame) -> DataFrame:
    return graphs.select("group_id", "first_row", F.inline_outer("edges"))


def pointers(graphs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``group_id, first_row, node_start, node_stop, edge_start, edge_stop``: places in the flat node and edge lists.

    Windows follow each other by group and first row; sums run inside ranges of that order and over the ranges. The sizes
    are staged, since dealing into ranges reads them twice; ``graphs`` may have them as ``n_nodes`` in place of ``nodes``.
    """
    size = F.col("n_nodes") if "n_nodes" in graphs.columns else F.size("nodes")
    sized = staged(graphs.select("group_id", "first_row", size.cast("long").alias("n"), F.lit(1).cast("long").alias("one")), "sizes")
    placed = running_totals(sized, ["group_id", "first_row"], {"stop": "n", "nth": "one"})
    stop, nth = F.col("stop"), F.col("nth")
    return placed.select("group_id", "first_row", (stop - F.col("n")).alias("node_start"), stop.alias("node_stop"), ((nth - 1) * length).alias("edge_start"), (nth * length).alias("edge_stop"))


def flat_edges(graphs: DataFrame, placed: DataFrame) -> DataFrame:
    """``place, src, dst``: the edges of all windows in one list, their ends numbered in one list of all nodes."""
    met = graphs.select("group_id", "first_row", "edges").join(placed, ["group_id", "first_row"])  # windows meet, not their edges
    edges = met.select("edge_start", "node_start", F.inline_outer("edges"))
    return edges.select((F.col("edge_start") + F.col("time")).alias("place"), (F.col("node_start") + F.col("src")).alias("src"), (F.col("node_start") + F.col("dst")).alias("dst"))


def edges_of_windows(flat: DataFrame, placed: DataFrame) -> DataFrame:
    """``group_id, first_row, time, src, dst`` again, from a flat list and the pointers of the windows wanted."""
    found = interval_join(flat, placed, [], "place", "edge_start", "edge_stop")
    local = lambda c: (F.col(c) - F.col("node_start")).alias(c)
    return found.select("group_id", "first_row", (F.col("place") - F.col("edge_start")).cast("int").alias("time"), local("src"), local("dst"))


def pointer_integrity(placed: DataFrame) -> DataFrame:
    """``n_windows, n_nodes, n_edges, n_node_gaps, n_edge_gaps``: gaps are starts other than 0 at which no window stops.

    ``placed`` is that of ``pointers``; every window has nodes and edges.
    """
    gaps = []
    for kind in ("node", "edge"):
        starts = placed.select(F.col(f"{kind}_start").alias("at")).where("at <> 0")
        gaps.append(starts.join(placed.select(F.col(f"{kind}_stop").alias("at")), "at", "left_anti").agg(F.count("*").alias(f"n_{kind}_gaps")))
    totals = placed.agg(F.count("*").alias("n_windows"), F.coalesce(F.max("node_stop"), F.lit(0)).alias("n_nodes"), F.coalesce(F.max("edge_stop"), F.lit(0)).alias("n_edges"))
    return totals.crossJoin(F.broadcast(gaps[0])).crossJoin(F.broadcast(gaps[1]))  # one row each


def integrity(graphs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``n_windows, n_broken, n_outside, n_short``: windows, those whose rows do not follow each other, those with an edge
    whose ends are not among their nodes, and those whose steps or edges are not ``length``."""
    gaps = F.exists(F.sequence(F.lit(1), F.greatest(F.size("steps") - 1, F.lit(1))), lambda i: F.get(F.col("steps"), i)["row_id"] - F.get(F.col("steps"), i - 1)["row_id"] != 1)
    inside = lambda x: (x >= 0) & (x < F.size("nodes"))
    outside = F.exists("edges", lambda e: ~(F.coalesce(inside(e["src"]) & inside(e["dst"]), F.lit(False))))
    short = (F.size("steps") != length) | (F.size("edges") != length)
    counted = [F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in (("n_broken", gaps), ("n_outside", outside), ("n_short", short))]
    return graphs.agg(F.count("*").alias("n_windows"), *counted)


def message_means(graphs: DataFrame, value: str = "value") -> DataFrame:
    """For each window and node the mean of ``value`` over the edges that come in and over those that go out (0 without any)."""
    edges = graphs.select("group_id", "first_row", F.posexplode_outer(F.arrays_zip("edges", "steps")).alias("t", "x"))
    edges = edges.select("group_id", "first_row", F.col("x.edges.src").alias("src"), F.col("x.edges.dst").alias("dst"), F.col(f"x.steps.{value}").alias("value"))
    ends = edges.select("group_id", "first_row", "value", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(False).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(True).alias("into")))).alias("end"))
    total = lambda into: F.sum(F.when(F.col("end.into") == into, F.col("value").cast("decimal(18,2)")))
    count = lambda into: F.greatest(F.sum((F.col("end.into") == into).cast("int")), F.lit(1))
    mean = lambda into: F.round(F.coalesce(total(into), F.lit(0)).cast("double") / count(into), 6)
    return ends.groupBy("group_id", "first_row", F.col("end.node").alias("node")).agg(mean(True).alias("mean_in"), mean(False).alias("mean_out"))


def window_summary(graphs: DataFrame, dropped: Column, length: int = LENGTH) -> DataFrame:
    """Counters of a table of windows; ``dropped`` marks windows that do not count as kept."""
    kept = ~dropped
    return graphs.agg(
        F.sum(kept.cast("long")).alias("n_windows"), F.sum(F.when(kept, F.lit(length)).otherwise(0)).cast("long").alias("n_edges"),
        F.sum(F.when(kept, F.size("nodes")).otherwise(0)).cast("long").alias("n_nodes"), F.countDistinct(F.when(kept, F.col("group_id"))).alias("n_groups"),
        F.sum(dropped.cast("long")).alias("n_dropped"),
    )
