"""The library's queries over the driver tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.functions import cleaning, decisions, hashing, scores
from flowframe.operators import audit, groups, metrics, preprocess, profile, sampling, splits, windows
from flowframe.operators.outlier import IsolationForest
from flowframe.operators.intervals import interval_join
from flowframe.plans import report
from flowframe.sources.flows import digest_words, event_flows, read_flows, role
from flowframe.sources.loaders import load_sample, load_slices, read_groups
from flowframe.sources.packed import read_packed, write_packed
from flowframe.sources.row_groups import file_row_groups, read_row_groups
from flowframe.sources.settings import rank_roots
from flowframe.sources.sinks import load_fitted, read_table, save_fitted, write_split_manifest, write_windows
from flowframe.sources.staging import new_folder, staged
from flowframe.streaming import epochs
from flowframe.streaming.ingest import conserved, guard_contract, ingest, ingest_windows, stream_flows
from flowframe.streaming.ingest import stream_split_counts as run_stream

SEED, OUTER = 42, 0.7
ROW_GROUP, MANIFEST_ROWS = 128, 48
ATTEMPTS = 128

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.with_groups(event_flows(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).withColumn("split", hashing.stream_split(F.col("group_id"), OUTER, SEED))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_manifest(groups.row_groups(event_flows(spark, sf_dir), ROW_GROUP), MANIFEST_ROWS, OUTER, SEED)


def _burst(rows: DataFrame) -> DataFrame:
    """A label that is rare: events of very large value are bursts."""
    return rows.withColumn("label", F.when(F.col("value") > 400, "burst").otherwise(F.col("label")))


# Identity, groups, manifests


@query
def sample_ids(spark, sf_dir):
    return _grouped(spark, sf_dir).select("file_id", "row_id", "sample_id")


@query
def duplicate_sample_ids(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(hashing.sample_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("sample_id"))
    return profile.duplicate_keys(lines, "sample_id")


@query
def unit_interval_split(spark, sf_dir):
    ids = _grouped(spark, sf_dir).select("group_id").distinct()
    return ids.select("group_id", hashing.unit_interval(F.col("group_id"), SEED).alias("u"), hashing.stream_split(F.col("group_id"), 0.7, SEED).alias("split_70"), hashing.stream_split(F.col("group_id"), 0.8, SEED).alias("split_80"))


@query
def contiguous_groups(spark, sf_dir):
    return groups.group_sizes(_grouped(spark, sf_dir))


@query
def group_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query
def manifest_rows(spark, sf_dir):
    rows = groups.rows_of_groups(event_flows(spark, sf_dir), _manifest(spark, sf_dir), ROW_GROUP, MANIFEST_ROWS)
    return rows.groupBy("group_id", "split").agg(F.count("*").alias("n_read"), F.min("row_id").alias("first_row"), F.max("n_rows").alias("n_rows"))


@query
def manifest_summary(spark, sf_dir):
    return groups.manifest_summary(_manifest(spark, sf_dir))


# Footers and row groups of the event table's own file


def _footer_manifest(spark, sf_dir):
    return groups.group_manifest(file_row_groups(spark, f"{sf_dir}/events.parquet"), 64, OUTER, SEED)


@query
def footer_row_groups(spark, sf_dir):
    """The row groups of three tables, without reading rows."""
    found = [file_row_groups(spark, f"{sf_dir}/{t}.parquet").drop("path") for t in ("events", "orders", "lineitem")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def footer_manifest(spark, sf_dir):
    return _footer_manifest(spark, sf_dir)


@query
def footer_group_rows(spark, sf_dir):
    """What the test groups hold, from their row groups alone."""
    rows = read_groups(spark, f"{sf_dir}/events.parquet", _footer_manifest(spark, sf_dir).where("split = 'test'"))
    return rows.groupBy("group_id").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query
def footer_slices(spark, sf_dir):
    """Contiguous slices of the table's row groups."""
    rows = load_slices(spark, f"{sf_dir}/events.parquet", 640, SEED, 16)
    return rows.select("row_group", "row_id", "event_id", "event_type")


@query
def row_group_range(spark, sf_dir):
    """Two columns of the rows between two values, from the row groups that can hold them."""
    rows = read_row_groups(spark, f"{sf_dir}/events.parquet", ["user_id", "value"], between={"value": [200.0, 300.0]})
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.max("row_id").alias("last_row"))


@query
def interval_rows(spark, sf_dir):
    """For each outlying event the rows that follow it, the more the larger its value; stretches overlap."""
    flows = event_flows(spark, sf_dir)
    stretches = flows.where("not inlier").select("file_id", F.col("row_id").alias("first_row"), (F.col("row_id") + 1 + F.floor(F.col("value") / 5).cast("long")).alias("stop_row"))
    held = interval_join(flows.select("file_id", "row_id", "value"), stretches, ["file_id"], "row_id", "first_row", "stop_row")
    return held.groupBy("file_id", "first_row", "stop_row").agg(F.count("*").alias("n_rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


# Samples


@query
def row_group_indices(spark, sf_dir):
    totals = groups.row_groups(event_flows(spark, sf_dir), 16).groupBy("file_id").agg(F.count("*").alias("total"))
    return sampling.spread_row_groups(totals, 8)


@query
def contiguous_slice_sample(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    plan = sampling.slice_plan(groups.row_groups(flows, ROW_GROUP), 160, SEED, 16)
    return sampling.slice_rows(flows, plan, ROW_GROUP).select("file_id", "row_group", "row_id")


@query
def hash_row_sample(spark, sf_dir):
    return sampling.sample_rows(event_flows(spark, sf_dir), 32, SEED).select("file_id", "row_id", "label")


@query
def spread_row_sample(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return sampling.spread_sample(flows, groups.row_groups(flows, 16), 32, 8, SEED, 16).select("file_id", "row_group", "row_id")


@query
def reservoir_groups(spark, sf_dir):
    return sampling.reservoir(_manifest(spark, sf_dir), 1, SEED).select("file_id", "split", "group_id", "n_rows")


@query
def epoch_schedule(spark, sf_dir):
    return sampling.epoch_schedule(_manifest(spark, sf_dir), 3, SEED)


# Profiles


@query
def label_histogram(spark, sf_dir):
    return profile.histogram(_table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P"))), "status")


@query
def label_audit(spark, sf_dir):
    return audit.label_audit(_burst(_split(spark, sf_dir)), "label")


@query
def labels_missing_by_split(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return audit.missing_labels(rows.withColumn("label", F.concat("label", F.expr("CASE WHEN value > 330 THEN concat('/', cast(cast(value / 10 AS bigint) AS string)) ELSE '' END"))), "label")


@query
def rare_group_labels(spark, sf_dir):
    rows = _grouped(spark, sf_dir).withColumn("label", F.concat("label", F.expr("CASE WHEN value > 330 THEN concat('/', cast(cast(value / 10 AS bigint) AS string)) ELSE '' END")))
    return audit.rare_labels(rows, "label")


def _dirty(spark, sf_dir):
    """Line items with missing and infinite numbers where tax and discount are zero."""
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", F.expr("CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END").alias("discount"),
        F.expr("CASE WHEN l_tax = 0 THEN cast('Infinity' AS double) WHEN l_tax = 0.01 THEN cast('NaN' AS double) ELSE l_tax END").alias("tax"), "l_extendedprice",
    )


@query
def column_profile(spark, sf_dir):
    return profile.column_profile(_dirty(spark, sf_dir), ["l_orderkey", "l_quantity", "discount", "tax", "l_extendedprice"])


@query
def timestamp_parse_failures(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderpriority").startswith("1"), "n/a").when(F.col("o_orderpriority").startswith("2"), None).otherwise(F.date_format("o_orderdate", cleaning.DAY_FIRST))
    return profile.failures(o.select(text.alias("stamp")), cleaning.day_first(F.col("stamp")))


@query
def parse_failures(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"), F.expr("CASE WHEN o_orderstatus = 'F' THEN '-' ELSE cast(o_custkey AS string) END").alias("customer"))
    return profile.parse_failures(o, ["price", "priority", "customer"])


# Preprocessing

FEATURES = ["value", "value_again", "hour", "user_id", "k", "one", "one_again", "nothing"]


def _features(spark, sf_dir):
    return _split(spark, sf_dir).select(
        "file_id", "row_id", "split", "label", "inlier", F.expr("CASE WHEN k = 7 THEN cast('Infinity' AS double) WHEN k = 8 THEN NULL ELSE value END").alias("value"),
        F.expr("CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN cast('NaN' AS double) ELSE value END").alias("value_again"), "hour", "user_id", "k",
        F.lit(1.0).alias("one"), F.lit(1.0).alias("one_again"), F.lit(None).cast("double").alias("nothing"),
    )


def _fitted(spark, sf_dir):
    return preprocess.fit(_features(spark, sf_dir), FEATURES, ["file_id", "row_id"], "label", "inlier")


def _decisions(spark, sf_dir):
    train = preprocess.coerced(_features(spark, sf_dir).where("split = 'train'"), FEATURES)
    return preprocess.choose_features(train, FEATURES, ["file_id", "row_id"])


@query
def feature_decisions(spark, sf_dir):
    made = _decisions(spark, sf_dir)
    return spark.createDataFrame(list(made.items()), "column_name string, decision string")


@query
def duplicate_columns(spark, sf_dir):
    made = [(c, d.removeprefix("duplicate of ")) for c, d in _decisions(spark, sf_dir).items() if d.startswith("duplicate")]
    return spark.createDataFrame(made, "column_name string, same_as string")


@query
def constant_columns(spark, sf_dir):
    made = [(c,) for c, d in _decisions(spark, sf_dir).items() if d == "constant"]
    return spark.createDataFrame(made, "column_name string")


@query
def median_impute(spark, sf_dir):
    train = preprocess.coerced(_features(spark, sf_dir).where("split = 'train'"), ["value", "hour", "user_id", "k"])
    return preprocess.medians(train, ["value", "hour", "user_id", "k"])


@query
def minmax_scale(spark, sf_dir):
    fitted = _fitted(spark, sf_dir)
    scaled = preprocess.transform(_features(spark, sf_dir), fitted, "inlier")
    return scaled.select("row_id", "split", *[F.round(c, 9).alias(f"{c}_scaled") for c in fitted.features])


@query
def minmax_clip(spark, sf_dir):
    fitted = _fitted(spark, sf_dir)
    scaled = preprocess.transform(_features(spark, sf_dir), fitted, "inlier", clip=True)
    return scaled.select("row_id", "split", *[F.round(c, 9).alias(f"{c}_clipped") for c in fitted.features])


@query
def reservoir_bounds(spark, sf_dir):
    """What a fit on one whole training group of each file learns."""
    columns = ["value", "hour", "user_id", "k"]
    flows = event_flows(spark, sf_dir)
    fitted = preprocess.fit_on_reservoir(flows, groups.require_splits(_manifest(spark, sf_dir)), 1, SEED, ROW_GROUP, MANIFEST_ROWS, columns, "label")
    made = [(c, fitted.median[c], fitted.low[c], fitted.high[c], len(fitted.labels)) for c in fitted.features]
    return spark.createDataFrame(made, "column_name string, median double, low double, high double, n_labels int")


@query
def clip_counts(spark, sf_dir):
    fitted = _fitted(spark, sf_dir)
    return preprocess.clip_counts(preprocess.transform(_features(spark, sf_dir), fitted, "inlier"), fitted.features)


@query
def label_encode(spark, sf_dir):
    rows = _burst(event_flows(spark, sf_dir))
    return preprocess.encoded(rows, preprocess.label_codes(rows, "label"), "label").groupBy("label", "code").agg(F.count("*").alias("n"))


# Splits


@query
def seeded_group_order(spark, sf_dir):
    sizes = groups.group_sizes(_grouped(spark, sf_dir))
    manifest = sizes.select("group_id", F.lit("train").alias("split"))
    return sampling.epoch_schedule(manifest, 1, SEED).select("place", "group_id")


def _attempts(spark, sf_dir):
    """The table's rows, and for every attempt its groups with their splits and labels."""
    grouped = _burst(_grouped(spark, sf_dir))
    return grouped, splits.assigned_groups(splits.group_table(grouped), ATTEMPTS, SEED, OUTER)


@query
def greedy_test_groups(spark, sf_dir):
    """What each attempt takes: groups, rows, and an order-free digest of the groups' ids."""
    number = F.conv(F.substring(F.sha2("group_id", 256), 1, 8), 16, 10).cast("long")
    chosen = _attempts(spark, sf_dir)[1].where("split <> 'train'")
    return chosen.groupBy("attempt", "split").agg(F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"), F.sum(number).alias("digest"))


@query
def split_score_search(spark, sf_dir):
    grouped, assigned = _attempts(spark, sf_dir)
    return splits.scores(grouped, assigned, OUTER)


@query
def assigned_splits(spark, sf_dir):
    grouped, assigned = _attempts(spark, sf_dir)
    best = splits.best_attempt(splits.scores(grouped, assigned, OUTER))
    rows = splits.assign(grouped, assigned.select("attempt", "group_id", "split"), best)
    return rows.groupBy("group_id", "split").agg(F.count("*").alias("n_rows"))


@query
def split_leakage(spark, sf_dir):
    rows = _split(spark, sf_dir)
    by_group = splits.leakage(rows, "group_id").withColumn("kind", F.lit("group"))
    by_user = splits.leakage(rows, "user_id").withColumn("kind", F.lit("user"))
    return by_group.unionByName(by_user)


# Windows and graphs


def _runs(spark, sf_dir):
    return windows.with_runs(_grouped(spark, sf_dir).where("inlier"))


def _windows(spark, sf_dir, split: bool = False):
    """Windows over the inlying rows; endpoints of the smallest keys are blank, so their windows are dropped."""
    rows = _split(spark, sf_dir) if split else _grouped(spark, sf_dir)
    rows = windows.with_runs(rows.where("inlier"))
    columns = {c: F.col(c) for c in ("label", "src", "sample_id", "value")}
    columns["dst"] = F.when(F.col("k") == 0, " NaN\t").when(F.col("k") == 1, "").when(F.col("k") == 2, "\t\u00a0").when(F.col("k") == 3, F.concat(F.lit("\n"), "dst", F.lit("\t"))).otherwise(F.col("dst"))
    made = windows.windows(rows, columns)
    return made


def _graphs(spark, sf_dir):
    return windows.with_graph(_windows(spark, sf_dir).where(windows.endpoints_valid()))


@query
def contiguous_runs(spark, sf_dir):
    return windows.run_sizes(_runs(spark, sf_dir)).select("group_id", "first_row", "last_row", "n_rows")


@query
def sliding_windows(spark, sf_dir):
    made = windows.windows(_runs(spark, sf_dir), {"label": F.col("label"), "src": F.col("src"), "dst": F.col("dst")})
    ends = F.concat(F.transform("steps", lambda s: s["src"]), F.transform("steps", lambda s: s["dst"]))
    return made.select(
        "group_id", "first_row", F.element_at("steps", -1)["row_id"].alias("last_row"), F.element_at("steps", -1)["label"].alias("target"),
        F.array_join(F.transform("steps", lambda s: s["label"]), ",").alias("labels"), F.size(F.array_distinct(ends)).cast("long").alias("n_nodes"))


@query
def valid_endpoint_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("group_id", "first_row", windows.endpoints_valid().alias("kept"))


@query
def endpoint_hashes(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    ends = flows.select(F.explode(F.array("src", "dst")).alias("endpoint")).distinct()
    return ends.select("endpoint", hashing.endpoint_hash(F.col("endpoint"), windows.NAMESPACE).alias("node_hash"))


@query
def window_graph_nodes(spark, sf_dir):
    return windows.node_rows(_graphs(spark, sf_dir))


@query
def window_graph_edges(spark, sf_dir):
    return windows.edge_rows(_graphs(spark, sf_dir))


@query
def csr_pointers(spark, sf_dir):
    return windows.pointers(_graphs(spark, sf_dir))


@query
def edges_by_pointer(spark, sf_dir):
    """The flat edge list of all windows, cut into windows again by their pointers."""
    graphs = staged(_graphs(spark, sf_dir).select("group_id", "first_row", F.size("nodes").alias("n_nodes"), "edges"), "graphs")
    placed = staged(windows.pointers(graphs), "pointers")
    return windows.edges_of_windows(staged(windows.flat_edges(graphs, placed), "flat"), placed)


@query
def pointer_integrity(spark, sf_dir):
    return windows.pointer_integrity(windows.pointers(_graphs(spark, sf_dir)))


@query
def graph_message_mean(spark, sf_dir):
    return windows.message_means(_graphs(spark, sf_dir))


@query
def window_metadata(spark, sf_dir):
    graphs = windows.with_graph(_windows(spark, sf_dir))
    short = windows.run_sizes(_runs(spark, sf_dir)).where(F.col("n_rows") < windows.LENGTH).agg(F.count("*").alias("n_short_runs"))
    return windows.window_summary(graphs, ~windows.endpoints_valid()).crossJoin(F.broadcast(short))  # one row each


@query
def graph_integrity(spark, sf_dir):
    graphs = windows.with_graph(_windows(spark, sf_dir, split=True).where(windows.endpoints_valid()))
    torn = splits.in_two_splits(_split(spark, sf_dir)).agg(F.count("*").alias("n_torn_groups"))
    return windows.integrity(graphs).crossJoin(F.broadcast(torn))  # one row each


@query
def sequence_leakage(spark, sf_dir):
    made = _windows(spark, sf_dir, split=True)
    return audit.window_leakage(made.withColumn("split", hashing.stream_split(F.col("group_id"), OUTER, SEED)))


# Metrics


def _judged(spark, sf_dir):
    """Return flags, and a guess at them from status and quantity."""
    guess = F.expr("CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("actual"), guess.alias("predicted"), "l_quantity", "l_discount", "l_tax")


def _by_class(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(s).cast("double").alias("score")) for c, s in (("A", "l_discount"), ("N", "l_tax"), ("R", "l_quantity"))])
    return rows.select("actual", F.explode(each).alias("x")).select("actual", "x.label", "x.score")


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir), "actual", "predicted")


@query
def per_class_metrics(spark, sf_dir):
    return metrics.per_class(_judged(spark, sf_dir), "actual", "predicted")


@query
def macro_weighted_metrics(spark, sf_dir):
    return metrics.overall(metrics.per_class(_judged(spark, sf_dir), "actual", "predicted"))


@query
def auc_ovr(spark, sf_dir):
    return metrics.auc(_by_class(spark, sf_dir), ["label"], "score", F.col("actual") == F.col("label"))


@query
def macro_auc(spark, sf_dir):
    return metrics.macro_auc(metrics.auc(_by_class(spark, sf_dir), ["label"], "score", F.col("actual") == F.col("label")))


@query
def evaluation(spark, sf_dir):
    return metrics.evaluation(_judged(spark, sf_dir), "actual", "predicted", _by_class(spark, sf_dir), "score", F.col("actual") == F.col("label"))


@query
def roc_points(spark, sf_dir):
    return metrics.curves(_by_class(spark, sf_dir), ["label"], "score", F.col("actual") == F.col("label")).select("label", "score", "tpr", "fpr")


@query
def roc_corners(spark, sf_dir):
    """The ROC points at which the curve may bend; scores are coarse, so that some lie on straight lines."""
    scored = _by_class(spark, sf_dir).withColumn("score", F.floor(F.col("score") * 100))
    return metrics.roc_corners(scored, ["label"], "score", F.col("actual") == F.col("label"))


@query
def pr_points(spark, sf_dir):
    return metrics.curves(_by_class(spark, sf_dir), ["label"], "score", F.col("actual") == F.col("label")).select("label", "score", "tpr", "precision_at")


@query
def average_precision(spark, sf_dir):
    return metrics.average_precision(metrics.curves(_by_class(spark, sf_dir), ["label"], "score", F.col("actual") == F.col("label")), ["label"])


@query
def winning_class(spark, sf_dir):
    """Softmax shares of three scores, the winner, and how often it is right."""
    rows = _judged(spark, sf_dir)
    three = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50)
    won = rows.select("actual", scores.softmax(three).alias("shares")).withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in "ANR"]), scores.winner(F.col("shares")) + 1))
    return won.groupBy("actual", "predicted").agg(F.count("*").alias("n"), F.round(F.sum(F.array_max("shares").cast("decimal(28,9)")).cast("double") / F.count("*"), 6).alias("mean_share"))


@query
def concatenated_pointers(spark, sf_dir):
    """Windows of two tables put one after the other, with pointers counted anew."""
    graphs = _graphs(spark, sf_dir)
    again = graphs.withColumn("group_id", F.concat(F.lit("~"), "group_id"))
    return windows.pointers(graphs.unionByName(again))


@query
def class_weights(spark, sf_dir):
    return metrics.class_weights(_burst(event_flows(spark, sf_dir)), "label")


@query
def class_distribution(spark, sf_dir):
    return metrics.class_distribution(_burst(_split(spark, sf_dir)), "label", hashing.SPLITS)


@query
def latency_percentiles(spark, sf_dir):
    return metrics.nearest_rank(event_flows(spark, sf_dir), ["label"], "value")


@query
def online_means(spark, sf_dir):
    return metrics.weighted_mean(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


def _daily(spark, sf_dir):
    return event_flows(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("n"), F.sum((F.col("label") == "error").cast("long")).alias("errors"))


@query
def running_best(spark, sf_dir):
    return metrics.running_best(_daily(spark, sf_dir), "file_id", "errors")


@query
def stagnation(spark, sf_dir):
    """Days whose (errors, rows) do not surpass the day before, in lexicographic order."""
    from pyspark.sql import Window

    days = _daily(spark, sf_dir).withColumn("progress", F.struct("errors", "n"))
    before = F.lag("progress").over(Window.orderBy("file_id"))  # one row a day
    return days.select("file_id", "errors", "n", F.coalesce(F.col("progress") <= before, F.lit(False)).alias("stagnant"))


@query
def topk_importance(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    return flows.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("importance")).orderBy(F.desc("importance"), "user_id").limit(30)


@query
def attention_pivot(spark, sf_dir):
    flows = event_flows(spark, sf_dir)
    labels = [r[0] for r in flows.select("label").distinct().orderBy("label").collect()]
    table = flows.groupBy("hour").pivot("label", labels).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value"))
    return table.fillna(0.0).select("hour", *[F.col(label).alias(f"mean_{label}") for label in labels])


@query
def status_decision(spark, sf_dir):
    """A state from free text, and what to do about it: an ordered cascade of rules."""
    o = _table(spark, sf_dir, "orders")
    words = F.expr("CASE o_orderstatus WHEN 'O' THEN 'Still RUNNING' WHEN 'F' THEN 'job Failed' ELSE concat('is ', substr(o_orderpriority, 3), ' pending') END")
    state = o.select("o_orderkey", cleaning.state_of(words).alias("state"), F.expr("o_custkey % 7").alias("attempts"))
    decision = F.when(F.col("state") == "running", "wait: running").when(F.col("state") == "queued", "wait: queued").when(F.col("attempts") >= 5, "stop: attempts used up").otherwise("push: incomplete")
    return state.withColumn("decision", decision).groupBy("state", "decision").agg(F.count("*").alias("n"))


@query
def session_decision(spark, sf_dir):
    """The whole cascade, over orders as runs: status and kernel from the order, counters from its numbers."""
    o = _table(spark, sf_dir, "orders")
    run = {
        "force": F.expr("o_orderkey % 31 = 0"), "known": F.expr("o_custkey % 10 <> 0"),
        "status": F.expr("CASE o_custkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'completed' WHEN 2 THEN 'paused' WHEN 3 THEN 'paused' WHEN 4 THEN 'failed' ELSE 'running' END"),
        "kernel": cleaning.state_of(F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'Now Running' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'has failed' WHEN 3 THEN 'complete' ELSE 'gone' END")),
        "silent": F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 11) * 1000.0 END").cast("double"),
        "since_push": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 13) * 500.0 END").cast("double"),
        "attempts": F.expr("o_orderkey % 9"), "stagnant": F.expr("o_custkey % 4"),
    }
    return o.select(decisions.next_session(run).alias("d")).groupBy("d.push", "d.reason").agg(F.count("*").alias("n"))


@query
def cosine_rates(spark, sf_dir):
    """Each day of the event table as an epoch."""
    from pyspark.sql import Window

    days = _daily(spark, sf_dir).withColumn("epoch", F.row_number().over(Window.orderBy("file_id")) - 1)  # one row a day
    return metrics.cosine_rates(days, "epoch", 1e-3, 1e-6).select("file_id", "epoch", "rate")


# Files: what is read by contract, and what is written and read again


@query
def flow_provenance(spark, sf_dir):
    """A folder read by contract: as many files as have footers, rows with their place in their file."""
    path = f"{sf_dir}/lineitem.parquet"
    rows = read_flows(spark, path, expected_files=file_row_groups(spark, path).select("path").distinct().count())
    label = role(rows.columns, ["l_returnflag", "label"], "label")
    place = F.col("__source_row_id")
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"), F.min(place).alias("first_row"), F.max(place).alias("last_row"), F.sum(place).alias("places"))


@query
def file_row_sample(spark, sf_dir):
    """Seeded rows from row groups spread over a file, which alone are read."""
    return load_sample(spark, f"{sf_dir}/events.parquet", 500, 8, SEED).select("file_id", "row_group", "row_id", "event_id", "event_type")


@query
def split_manifest_file(spark, sf_dir):
    """Every row's identity, group and split, through the manifest's file."""
    path = new_folder(spark, "manifest")
    write_split_manifest(_split(spark, sf_dir), path)
    return read_table(spark, path, "sample_id string, group_id string, split string, file_id string, row_id long, label string")


@query
def window_table(spark, sf_dir):
    """Windows with their graphs written by split, of which the evaluated splits' folders are read again."""
    path = new_folder(spark, "windows")
    write_windows(_graphs(spark, sf_dir).withColumn("split", hashing.stream_split(F.col("group_id"), OUTER, SEED)), path)
    evaluated = spark.read.parquet(path).where("split <> 'train'")
    return evaluated.select("split", "group_id", "first_row", "target", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"))


@query
def stored_fit(spark, sf_dir):
    """A fit through its document, which the hash of its feature order guards, and then applied."""
    path = new_folder(spark, "fitted")
    fitted = load_fitted(spark, path, save_fitted(spark, _fitted(spark, sf_dir), path))
    scaled = preprocess.transform(_features(spark, sf_dir), fitted, "inlier", clip=True)
    return scaled.select("row_id", "split", *[F.round(c, 9).alias(f"{c}_clipped") for c in fitted.features])


@query
def rounded_tables(spark, sf_dir):
    """A report's table by class as its file holds it, with doubles of six digits."""
    folder, judged = new_folder(spark, "report"), _judged(spark, sf_dir)
    report.generate({"predictions": judged}, folder)
    return read_table(spark, f"{folder}/per_class", metrics.per_class(judged, "actual", "predicted").schema)


@query
def ranked_roots(spark, sf_dir):
    """Where a dataset may lie, by a listing of files that the orders name."""
    root = F.concat(F.lit("/lake/"), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("/c"), (F.col("o_custkey") % 50).cast("string"))
    data = F.concat(root, F.lit("/data/"), F.col("o_orderkey").cast("string"), F.lit(".parquet"))
    found = F.when(F.col("o_orderkey") % 97 == 0, F.concat(root, F.lit("/manifests/validation_report.json")))
    files = _table(spark, sf_dir, "orders").select(F.explode(F.array(data, found)).alias("path")).where("path is not null")
    return rank_roots(files, "urgent")


@query
def iso_epochs(spark, sf_dir):
    """ISO stamps of several spellings in seconds; broken ones are null."""
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
        WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'") ELSE date_format(ts, "'at' HH:mm") END""")
    seconds = _table(spark, sf_dir, "events").select("event_type", scores.epoch_seconds(text).alias("seconds"))
    return seconds.groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count("seconds").alias("n_stamps"), F.min("seconds").alias("first_second"), F.max("seconds").alias("last_second"), F.sum("seconds").alias("total"))


# Streams and models


@query
def resumed_stream(spark, sf_dir):
    """A stream that is run again under the same contract and on the same rows: none is lost, none comes twice."""
    folder = new_folder(spark, "resumed")
    events = _table(spark, sf_dir, "events")
    for _ in range(2):
        guard_contract(spark, folder, {"seed": SEED, "outer": OUTER}, events.select("event_id", "event_type"))
        ingest(stream_flows(spark, sf_dir), f"{folder}/rows", f"{folder}/progress", SEED, OUTER)
    return conserved(events, spark.read.parquet(f"{folder}/rows"))


@query
def streamed_windows(spark, sf_dir):
    """The stream as scaled, encoded windows, by what a fit on the training rows learned."""
    folder = new_folder(spark, "streamed")
    fitted = preprocess.fit(_split(spark, sf_dir), ["value", "user_id"], ["file_id", "row_id"], "label", "inlier")
    ingest_windows(stream_flows(spark, sf_dir, files=1000), fitted, f"{folder}/windows", f"{folder}/progress", SEED, OUTER, windows.LENGTH, windows.STRIDE)
    last = F.element_at("steps", -1)
    made = spark.read.parquet(f"{folder}/windows").select("split", last["code"].alias("code"), "group_id", "first_row", last["value"].alias("value"))
    return made.groupBy("split", "code").agg(
        F.count("*").alias("n_windows"), F.countDistinct("group_id").alias("n_groups"), F.sum("first_row").alias("first_rows"),
        F.sum(F.round("value", 6).cast("decimal(18,6)")).cast("double").alias("last_values"))


@query
def table_digest(spark, sf_dir):
    """An order-free digest of a table's rows."""
    return digest_words(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query
def packed_windows(spark, sf_dir):
    """Graphs of windows written as packed arrays with pointers, and read again."""
    graphs = _graphs(spark, sf_dir)
    flat = graphs.select("group_id", "first_row", "target", "nodes", F.col("edges.src").alias("src"), F.col("edges.dst").alias("dst"))
    path = new_folder(spark, "packed")
    write_packed(flat, path)
    again = read_packed(spark, path)
    return again.select("group_id", "first_row", "target", F.sha2(F.array_join("nodes", ","), 256).alias("nodes_digest"), F.array_join(F.col("src").cast("array<string>"), ",").alias("src"), F.array_join(F.col("dst").cast("array<string>"), ",").alias("dst"))


@query
def epoch_windows(spark, sf_dir):
    """Two epochs of the training groups, streamed by their row groups through the shuffle buffer."""
    path, folder = f"{sf_dir}/events.parquet", new_folder(spark, "epochs")
    schedule = epochs.write_schedule(spark, path, _footer_manifest(spark, sf_dir), 2, SEED)
    rows = epochs.read_epochs(spark, path, schedule, ["event_type", "value", "user_id"], 4096)
    made = epochs.buffered(epochs.cut_windows(rows, "event_type", ["value", "user_id"], windows.LENGTH, windows.STRIDE), SEED)
    epochs.run_epochs(made, schedule, f"{folder}/windows", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/windows").groupBy("epoch", "target").agg(
        F.count("*").alias("n_windows"), F.countDistinct("group_id").alias("n_groups"), F.sum("first_row").alias("first_rows"),
        F.sum(F.element_at("features", -2).cast("decimal(18,2)")).cast("double").alias("last_values"), F.sum(F.element_at("features", 2)).cast("long").alias("first_users"),
    )


@query
def stream_split_counts(spark, sf_dir):
    return run_stream(spark, sf_dir, SEED, OUTER)


@query
def isolation_outliers(spark, sf_dir):
    rows = preprocess.coerced(_split(spark, sf_dir), ["value", "hour", "user_id", "k"])
    forest = IsolationForest.fit(rows.where("split = 'train'"), ["value", "hour", "user_id", "k"], ["file_id", "row_id"], seed=SEED)
    return forest.score(rows).select("row_id", "split", F.round("score", 9).alias("score"), "outlier")
