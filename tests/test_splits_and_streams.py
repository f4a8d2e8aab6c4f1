import hashlib

import pytest
from pyspark.sql import functions as F

from flowframe.functions.hashing import stream_split, unit_interval
from flowframe.operators import audit, groups, metrics, sampling, splits
from flowframe.operators.outlier import IsolationForest
from flowframe.sources.staging import new_folder, staged
from flowframe.streaming.ingest import conserved, guard_contract, ingest, stream_flows

SF = "/root/testdata/sf0.001"


def files(spark, n=6, rows=60):
    data = [(f"f{f}", r, "AB"[(r // 10 + f) % 2]) for f in range(n) for r in range(rows)]
    return spark.createDataFrame(data, "file_id string, row_id long, label string")


def greedy(order, target):
    taken, now = [], 0
    for g, n in order:
        if taken and abs(now - target) <= abs(now + n - target):
            continue
        taken.append(g)
        now += n
    return taken[:-1] if len(taken) == len(order) > 1 and taken[-1] == order[-1][0] else taken


@pytest.mark.parametrize("digits", [None, 1, 3])
def test_search_equals_a_python_model(spark, digits):
    grouped = groups.with_groups(files(spark), 10)
    sizes = groups.group_sizes(grouped)
    found = sorted(splits.attempts_table(sizes, 8, 42, 0.7, digits=digits).collect(), key=lambda r: r["h"])
    chosen = {a: {s: [r["group_id"] for r in found if (r["attempt"], r["split"]) == (a, s)] for s in ("test", "validation")} for a in range(8)}
    n = {r["group_id"]: r["n_rows"] for r in sizes.collect()}
    for a in range(8):
        def order(pool, seed):
            return sorted(((g, n[g]) for g in pool), key=lambda x: hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest())

        test = greedy(order(n, 42 + a * 104729), 360 * (1.0 - 0.7))
        validation = greedy(order(set(n) - set(test), 43 + a * 104729), 360 * (0.7 * 0.1))
        assert chosen[a] == {"test": test, "validation": validation}


@pytest.mark.parametrize("digits", [0, 1, 2])
@pytest.mark.parametrize("target", [300.0, 40.5, 2500.0, 1e9])
def test_greedy_choice_of_groups_of_all_sizes(spark, target, digits):
    import random

    rng = random.Random(4)
    pools = {a: [(f"g{i}", rng.choice([1, 2, 5, 40, 90, 700])) for i in range(n)] for a, n in enumerate([60, 60, 60, 1, 2, 5, 30, 200, 200])}
    pools[9] = [(f"g{i}", 6 if i % 17 else 1) for i in range(150)]
    hashed = [(a, g, n, hashlib.sha256(f"{a}:{g}".encode()).hexdigest()) for a, pool in pools.items() for g, n in pool]
    got = splits.greedy(spark.createDataFrame(hashed, "attempt int, group_id string, n_rows long, h string"), target, digits).collect()
    for a in pools:
        order = sorted(((h, g, n) for b, g, n, h in hashed if a == b))
        assert sorted((r["h"], r["group_id"]) for r in got if r["attempt"] == a) == [(h, g) for h, g, _ in order if g in set(greedy([(g, n) for _, g, n in order], target))]
    assert splits.greedy(spark.createDataFrame([], "attempt int, group_id string, n_rows long, h string"), target).count() == 0


def test_few_groups_are_opened_and_none_is_stored(spark, monkeypatch):
    """With ranges of few groups, what is walked one by one is a small part of groups times attempts."""
    table = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("group_id"), (F.col("id") % 50 + 1).alias("n_rows"))
    walked = spark.sparkContext.accumulator(0)
    inner = splits._walked

    def counted(target):
        run = inner(target)

        def walk(groups):
            walked.add(len(groups))
            return run(groups)

        return walk

    monkeypatch.setattr(splits, "_walked", counted)
    written = []
    monkeypatch.setattr(splits, "staged", lambda df, name: written.append(name) or staged(df, name))
    narrow = splits.assigned_groups(table, 16, 42, 0.7, digits=2)
    shares = {(r["attempt"], r["split"]): r["n"] for r in narrow.groupBy("attempt", "split").agg(F.sum("n_rows").alias("n")).collect()}
    total = sum(i % 50 + 1 for i in range(3000))
    assert all(abs(shares[a, "test"] - total * (1.0 - 0.7)) <= 25 and abs(shares[a, "validation"] - total * (0.7 * 0.1)) <= 25 for a in range(16))
    assert walked.value < 3000 * 16 / 4 and written == ["groups"]
    assert "Exchange" not in narrow._jdf.queryExecution().sparkPlan().toString()
    wide = splits.assigned_groups(table, 16, 42, 0.7, digits=0)
    assert wide.exceptAll(narrow).count() == 0 == narrow.exceptAll(wide).count()


def test_labels_are_summed_as_after_a_join(spark):
    grouped = groups.with_groups(files(spark), 10).withColumn("label", F.when(F.col("row_id") % 13 > 0, F.col("label")))
    every = splits.assigned_groups(splits.group_table(grouped), 5, 42, 0.7)
    one = {r["attempt"]: r["score"] for r in splits.scores(grouped, every, 0.7).collect()}
    two = {r["attempt"]: r["score"] for r in splits.scores(grouped, every.drop("cells"), 0.7).collect()}
    assert one == pytest.approx(two) and len(one) == 5


def test_best_split_has_the_fractions_and_leaks_nothing(spark):
    grouped = groups.with_groups(files(spark), 10)
    sizes = groups.group_sizes(grouped)
    assigned = splits.attempt_groups(splits.attempts_table(sizes, 16, 42, 0.7), sizes, 16)
    rows = splits.assign(grouped, assigned, splits.best_attempt(splits.scores(grouped, assigned, 0.7)))
    shares = {r["split"]: r["count"] / 360 for r in rows.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.63) < 0.03 and abs(shares["validation"] - 0.07) < 0.03 and abs(shares["test"] - 0.30) < 0.03
    assert all(r["shared"] == 0 for r in splits.leakage(rows, "group_id").collect())
    assert all(r["shared"] == 0 for r in splits.leakage(rows, "sample_id").collect())


def test_leakage_is_found(spark):
    df = spark.createDataFrame([("train", 1), ("test", 1), ("train", 2), ("validation", 3)], "split string, key long")
    assert {r["pair"]: r["shared"] for r in splits.leakage(df, "key").collect()} == {"train_validation": 0, "train_test": 1, "validation_test": 0}


def test_unit_interval_equals_python(spark):
    keys = [f"g{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", unit_interval(F.col("k"), 7).alias("u"), stream_split(F.col("k"), 0.7, 7).alias("s"))
    for r in df.collect():
        assert r["u"] == int.from_bytes(hashlib.sha256(f"7:{r['k']}".encode()).digest()[:8], "big") / 2.0**64
    assert {r["s"] for r in df.collect()} == {"train", "validation", "test"}
    with pytest.raises(ValueError):
        stream_split(F.col("k"), 0.5, 7)


def test_manifest_covers_all_rows_and_epochs_differ(spark):
    flows = files(spark, 3, 96)
    manifest = groups.group_manifest(groups.row_groups(flows, 24), 12, 0.7, 42)
    assert groups.manifest_summary(manifest).agg(F.sum("n_rows"), F.sum("n_ids")).first()[:] == (288, 24)
    assert groups.rows_of_groups(flows, manifest, 24, 12).count() == 288
    train = manifest.where("split = 'train'").count()
    plan = sampling.epoch_schedule(manifest, 2, 1).orderBy("epoch", "place").collect()
    one, two = ([r["group_id"] for r in plan if r["epoch"] == e] for e in (1, 2))
    assert len(one) == len(set(one)) == train and sorted(one) == sorted(two) and one != two
    assert [r["place"] for r in plan] == list(range(train)) * 2
    kept = sampling.reservoir(manifest, 1, 1)
    assert kept.groupBy("file_id", "split").count().where("count > 1").count() == 0 and kept.where("n_rows = 12").count() == kept.count()


def test_contiguous_sample(spark):
    flows = files(spark, 1, 1000)
    plan = sampling.slice_plan(groups.row_groups(flows, 200), 160, 42, 16)
    ids = sorted(r["row_id"] for r in sampling.slice_rows(flows, plan, 200).collect())
    assert len(ids) == 160 and sum(b - a != 1 for a, b in zip(ids, ids[1:], strict=False)) <= 3


def test_rare_label_is_in_the_vocabulary(spark):
    df = files(spark).withColumn("split", F.when(F.col("row_id") < 50, "train").otherwise("test")).withColumn("label", F.when((F.col("file_id") == "f5") & (F.col("row_id") > 57), "RARE").otherwise(F.col("label")))
    assert {r["vocabulary"] for r in audit.label_audit(df, "label").collect()} == {"A,B,RARE"}
    assert ("train", "RARE") in {(r["split"], r["label"]) for r in audit.missing_labels(df, "label").collect()}


def test_streaming_equals_batch_and_goes_on(spark):
    sf = "/root/testdata/sf0.001"
    folder = new_folder(spark, "test-stream")
    for _ in range(2):  # the second run finds nothing new
        ingest(stream_flows(spark, sf, size=1 << 20), f"{folder}/rows", f"{folder}/progress", 42, 0.7)
    rows = spark.read.parquet(f"{folder}/rows")
    assert conserved(spark.read.parquet(f"{sf}/events.parquet"), rows).first()["conserved"]
    assert rows.select("sample_id").distinct().count() == rows.count()
    guard_contract(spark, folder, {"seed": 42})
    guard_contract(spark, folder, {"seed": 42})
    with pytest.raises(ValueError):
        guard_contract(spark, folder, {"seed": 43})


def test_metrics_on_small_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion(df, "t", "p").collect()}
    assert len(cells) == 9 and cells["b", "b"] == 2 and cells["c", "c"] == 0
    total = metrics.overall(metrics.per_class(df, "t", "p")).first()
    assert total["accuracy"] == 0.6 and abs(total["macro_recall"] - 0.5) < 1e-6
    ranked = spark.createDataFrame([("x", 0.5, 1), ("x", 0.5, 0), ("x", 0.9, 1), ("y", 0.1, 1)], "k string, s double, y int")
    found = {r["k"]: r["auc"] for r in metrics.auc(ranked, ["k"], "s", F.col("y") == 1).collect()}
    assert found == {"x": 0.75, "y": None}
    times = spark.createDataFrame([("m", float(i)) for i in range(1, 12)], "k string, v double")
    got = metrics.nearest_rank(times, ["k"], "v").first()
    assert (got["p50"], got["p95"], got["mean"]) == (6.0, 11.0, 6.0)


def test_a_run_that_reaches_its_deadline_goes_on_later(spark):
    sf = "/root/testdata/sf0.001"
    folder = new_folder(spark, "deadline")
    assert not ingest(stream_flows(spark, sf), f"{folder}/rows", f"{folder}/progress", 42, 0.7, seconds=0.01)
    assert ingest(stream_flows(spark, sf), f"{folder}/rows", f"{folder}/progress", 42, 0.7, seconds=120)
    rows = spark.read.parquet(f"{folder}/rows")
    assert conserved(spark.read.parquet(f"{sf}/events.parquet"), rows).first()["conserved"] and rows.select("sample_id").distinct().count() == rows.count()


def test_running_sums_and_places(spark):
    from flowframe.operators import order

    df = spark.createDataFrame([(f"f{i % 3}", i, 1 + i % 5) for i in range(500)], "f string, i long, n long")
    got = {r["i"]: (r["upto"], r["nth"]) for r in order.running_totals(df.withColumn("one", F.lit(1)), ["f", "i"], {"upto": "n", "nth": "one"}).collect()}
    total = 0
    for place, (_, i) in enumerate(sorted((f"f{i % 3}", i) for i in range(500))):
        total += 1 + i % 5
        assert got[i] == (total, place + 1)
    assert {r["i"]: r["place"] for r in order.places(df, "f", "i", block=16).collect()} == {i: i // 3 for i in range(500)}
    asked = spark.createDataFrame([("f1", 40, 60), ("f2", 0, 1)], "f string, low long, high long")
    few = order.places(df, "f", "i", block=16, wanted=asked).collect()
    assert all(r["place"] == r["i"] // 3 for r in few) and len(few) < 50
    assert {("f1", p) for p in range(40, 60)} | {("f2", 0)} <= {(r["f"], r["place"]) for r in few} and {r["f"] for r in few} == {"f1", "f2"}
    assert order.running_totals(df.where("false"), ["i"], {"upto": "n"}).count() == 0


def test_groups_in_two_splits_and_missing_splits_are_found(spark):
    from flowframe.sources.flows import ContractError

    rows = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "test")], "group_id string, split string")
    assert [r["group_id"] for r in splits.in_two_splits(rows).collect()] == ["g"]
    with pytest.raises(ContractError, match="validation"):
        groups.require_splits(rows)
    with pytest.raises(ContractError, match="row_id"):
        groups.with_groups(rows.withColumnRenamed("group_id", "file_id"))


def test_forest_equals_a_plain_walk_of_its_trees(spark):
    import numpy as np

    from flowframe.plans import queries as Q

    rows = Q.preprocess.coerced(Q._split(spark, SF), names := ["value", "hour", "user_id", "k"])
    forest = IsolationForest.fit(rows.where("split = 'train'"), names, ["file_id", "row_id"], seed=Q.SEED)
    data = {r["row_id"]: r for r in rows.collect()}

    def walk(tree, x):
        while len(tree) > 1:
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
        return tree[0]

    scores = {i: 2.0 ** (-np.mean([walk(t, [r[c] or 0.0 for c in names]) for t in forest.trees]) / forest.expected) for i, r in data.items()}
    cut = np.percentile([s for i, s in scores.items() if data[i]["split"] == "train"], 99)
    for r in Q.isolation_outliers(spark, SF).collect():
        assert abs(r["score"] - scores[r["row_id"]]) < 2e-9 and r["outlier"] == (scores[r["row_id"]] > cut) or abs(scores[r["row_id"]] - cut) < 1e-12
    again = IsolationForest.from_document(__import__("json").loads(__import__("json").dumps(forest.document())))
    assert again == forest


def test_forest_finds_the_far_point(spark):
    data = [(i, float(i % 10), float(i % 7)) for i in range(400)] + [(400, 500.0, -300.0)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    forest = IsolationForest.fit(df, ["a", "b"], ["id"], trees=40, tree_rows=64)
    scored = forest.score(df).collect()
    assert max(scored, key=lambda r: r["score"])["id"] == 400
    again = IsolationForest.fit(df.repartition(3), ["a", "b"], ["id"], trees=40, tree_rows=64).score(df).collect()
    assert {r["id"]: r["score"] for r in again} == {r["id"]: r["score"] for r in scored}


def test_groups_are_dealt_over_all_tasks(spark):
    """Every pass makes attempts times as many rows as there are groups, so the small table must not lie in one file."""
    table = spark.range(0, 200, 1, 1).groupBy(F.concat(F.lit("g"), "id").alias("group_id")).agg(F.count("*").alias("n_rows"))
    assigned = splits.assigned_groups(table, 3, 1, 0.7)
    assert len(assigned.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions")) and assigned.count() == 600
