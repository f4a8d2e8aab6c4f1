import pytest
from pyspark.sql import functions as F

from flowframe.functions.scores import epoch_seconds, softmax, winner
from flowframe.operators import preprocess as P
from flowframe.operators import splits
from flowframe.plans import benchmark, report
from flowframe.plans.queries import _windows
from flowframe.sources import sinks
from flowframe.sources.flows import read_json
from flowframe.sources.settings import check_settings, load_settings, rank_roots
from flowframe.sources.staging import new_folder
from flowframe.streaming.ingest import ingest_windows, stream_flows

SF = "/root/testdata/sf0.001"


def test_documents_and_parameters_round_trip(spark, tmp_path):
    sinks.write_json(spark, {"b": [1, 2], "a": None}, f"{tmp_path}/doc")
    assert read_json(spark, f"{tmp_path}/doc") == {"a": None, "b": [1, 2]}
    fitted = P.Fitted({"x": "kept", "y": "constant"}, {"x": 1.5}, {"x": 0.0}, {"x": 2.0}, ["A"])
    order = sinks.save_fitted(spark, fitted, f"{tmp_path}/fitted")
    assert sinks.load_fitted(spark, f"{tmp_path}/fitted", order) == fitted
    with pytest.raises(ValueError):
        sinks.load_fitted(spark, f"{tmp_path}/fitted", "other")


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456789), ("b", None)], "k string, v double")
    sinks.write_table(df, f"{tmp_path}/t")
    assert sorted(map(tuple, sinks.read_table(spark, f"{tmp_path}/t", df.schema.simpleString()[7:-1].replace(":", " ")).collect())) == [("a", 1.234568), ("b", None)]
    sinks.write_split_manifest(df.withColumn("split", F.lit("train")), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns == ["split"]


def test_windows_by_split(spark, tmp_path):
    made = _windows(spark, SF, split=True).withColumn("split", F.lit("train"))
    sinks.write_windows(made, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w").where("split = 'train'").count() == made.count() > 0


def test_reports_skip_what_is_missing(spark, tmp_path):
    made = report.generate({"predictions": spark.createDataFrame([("a", "a"), ("a", "b")], "actual string, predicted string")}, str(tmp_path))
    assert {k for k, v in made.items() if v == "written"} == {"confusion", "per_class", "overall"} and made["roc"] == "skipped: no scores"
    assert spark.read.csv(f"{tmp_path}/confusion", header=True).count() == 4


def test_reports_of_training_and_attention(spark, tmp_path):
    history = spark.createDataFrame([(1, 0.5, 1e-3, 9.0), (2, 0.4, 1e-4, 8.0)], "epoch int, score double, rate double, seconds double")
    weights = spark.createDataFrame([(0, 0, 0.5), (0, 0, 1.0), (1, 2, 0.25)], "sample_index int, timestep int, weight double")
    ablation = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "variant string, macro_f1 double")
    made = report.generate({"history": history, "temporal_attention": weights, "ablation": ablation}, str(tmp_path))
    assert {k for k, v in made.items() if v == "written"} == {"learning_curve", "rate_schedule", "epoch_time", "temporal_attention", "ablation"}
    rows = spark.read.csv(f"{tmp_path}/temporal_attention", header=True).collect()
    assert [tuple(r) for r in rows] == [("0", "0.75", "0.0"), ("1", "0.0", "0.25")]
    assert [r["variant"] for r in spark.read.csv(f"{tmp_path}/ablation", header=True).collect()] == ["b", "a"]


def test_benchmark_tables(spark, tmp_path):
    calls = []
    times = benchmark.measured(spark, "m", lambda: calls.append(1), warmups=3, measurements=7)
    assert len(calls) == 10 and times.count() == 7
    benchmark.write_benchmark(times, str(tmp_path), rows=4)
    found = spark.read.csv(f"{tmp_path}/summary", header=True).first()
    assert found["n"] == "7" and float(found["p50"]) <= float(found["p95"])


def test_fits_with_a_forest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("train", i, float(i % 9), "A") for i in range(60)], "split string, row_id long, x double, label string")
    fitted = P.fit(df, ["x"], ["row_id"], "label", forest={"trees": 5, "tree_rows": 16})
    sinks.save_fitted(spark, fitted, f"{tmp_path}/f")
    assert sinks.load_fitted(spark, f"{tmp_path}/f") == fitted and fitted.forest


def test_settings(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("splits:\n  outer: 0.7\n  attempts: 128\nwindows: {length: 16}\n")
    (tmp_path / "mode.yaml").write_text("splits: {outer: 0.8}\n")
    assert load_settings(spark, f"{tmp_path}/base.yaml", f"{tmp_path}/mode.yaml")["splits"] == {"outer": 0.8, "attempts": 128}
    with pytest.raises(ValueError, match="outer.*scale"):
        check_settings({"splits": {"outer": 0.5}, "preprocessing": {"scale": [1.0, 0.0]}})
    good = {"data": {"labels": ["Label"]}, "splits": {"outer_fractions": [0.8, 0.7]}, "windows": {"target": "last", "source": "src"}, "model": {"sizes": {"layers": 2}, "dropout": 0.1}, "training": {"device": "cpu"}}
    assert check_settings(good, ("data", "splits")) == good
    for part, word in [
        ({"data": {"labels": "Label"}}, "names"), ({"splits": {"outer_fractions": [0.7]}}, "outer_fractions"), ({"windows": {"length": 1}}, "length"), ({"windows": {"target": "first"}}, "target"),
        ({"windows": {"direction": "both"}}, "direction"), ({"windows": {"source": " "}}, "source"), ({"model": {"sizes": {"layers": 0}}}, "layers"), ({"model": {"dropout": 1.0}}, "dropout"), ({"training": {"device": "gpu"}}, "device"),
    ]:
        with pytest.raises(ValueError, match=word):
            check_settings(part)
    with pytest.raises(ValueError, match="section windows"):
        check_settings({"data": {}}, ("data", "windows"))


def test_roots_are_ranked(spark):
    paths = ["/a/x/data/f.parquet", "/a/x/manifests/validation_report.json", "/a/flows-v1/data/g.parquet", "/b/data/h.parquet", "/c/other.parquet"]
    got = [(r["root"], r["points"]) for r in rank_roots(spark.createDataFrame([(p,) for p in paths], "path string"), "FLOWS").collect()]
    assert got == [("/a/flows-v1", 150), ("/a/x", 70), ("/b", 50)]


def test_scores_and_stamps(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "x array<double>")
    got = df.select(softmax(F.col("x")).alias("s"), winner(F.col("x")).alias("w")).collect()
    assert [r["w"] for r in got] == [1, 0] and all(abs(sum(r["s"]) - 1) < 1e-12 for r in got)
    stamps = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("bad",), (None,)], "t string")
    assert [r[0] for r in stamps.select(epoch_seconds(F.col("t"))).collect()] == [1704067200, None, None]


def test_streamed_windows_equal_batch_windows(spark):
    from flowframe.operators.groups import with_groups
    from flowframe.functions.hashing import stream_split
    from flowframe.operators.windows import windows, with_runs
    from flowframe.sources.flows import event_flows

    rows = with_groups(event_flows(spark, SF)).withColumn("split", stream_split(F.col("group_id"), 0.7, 42))
    fitted = P.fit(rows, ["value", "user_id"], ["file_id", "row_id"], "label")
    folder = new_folder(spark, "windows")
    ingest_windows(stream_flows(spark, SF), fitted, f"{folder}/out", f"{folder}/progress", 42, 0.7, 16, 8)
    streamed = spark.read.parquet(f"{folder}/out")
    batch = windows(with_runs(rows), {"value": F.col("value")}, 16, 8)
    assert streamed.count() == batch.count() > 0
    assert all(r["shared"] == 0 for r in splits.leakage(streamed.select("split", "group_id"), "group_id").collect())
    small = P.Fitted(fitted.decisions, fitted.median, fitted.low, fitted.high, ["click"])
    forest = P.fit(rows, ["value", "user_id"], ["file_id", "row_id"], "label", forest={"trees": 10, "tree_rows": 64, "contamination": 0.05})
    ingest_windows(stream_flows(spark, SF), forest, f"{folder}/forest", f"{folder}/forest-progress", 42, 0.7, 16, 8)
    kept = windows(with_runs(P.transform(rows, forest)), {"value": F.col("value")}, 16, 8)
    assert spark.read.parquet(f"{folder}/forest").count() == kept.count() < batch.count()
    with pytest.raises(Exception, match="vocabulary: (error|purchase|signup|view)"):
        ingest_windows(stream_flows(spark, SF), small, f"{folder}/bad", f"{folder}/bad-progress", 42, 0.7, 16, 8)
