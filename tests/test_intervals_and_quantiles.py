import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowframe.operators import quantiles
from flowframe.operators.intervals import interval_join, mark


def test_marks_are_whole_multiples(spark):
    values = [0, 1, 6, 7, 8, -1, -7, -8, 2**62 + 3, -(2**62)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", mark(F.col("v"), 7).alias("m")).collect()
    assert [r["m"] for r in got] == [r["v"] // 7 for r in got]


@pytest.mark.parametrize("width", [None, 1, 5, 1000])
def test_points_meet_each_interval_once(spark, width):
    draw = random.Random(1)
    points = [(draw.choice("ab"), draw.randrange(-50, 400), i) for i in range(300)] + [("a", None, -1), (None, 3, -2)]
    spans = [(draw.choice("abc"), s, s + draw.choice([0, -3, 1, 2, 9, 40, 700]), i) for i, s in enumerate(draw.randrange(-60, 300) for _ in range(60))]
    spans += [("a", None, 5, -1), ("b", 5, None, -2), (None, 0, 9, -3)]
    p = spark.createDataFrame(points, "k string, at long, point long")
    s = spark.createDataFrame(spans, "k string, lo long, hi long, span long")
    got = sorted((r["point"], r["span"]) for r in interval_join(p, s, ["k"], "at", "lo", "hi", width).collect())
    holds = lambda x, y: None not in (x[0], x[1], y[1], y[2]) and x[0] == y[0] and y[1] <= x[1] < y[2]
    assert got == sorted((x[2], y[3]) for x in points for y in spans if holds(x, y))
    left = interval_join(p, s, ["k"], "at", "lo", "hi", width, how="left")
    assert left.select("point").distinct().count() == len(points)
    assert interval_join(p, s.where("false"), ["k"], "at", "lo", "hi", width).count() == 0


def test_intervals_without_keys_and_a_long_one(spark):
    s = spark.createDataFrame([(0, 10_000, 0), *[(i, i + 1, i) for i in range(1, 100)]], "lo long, hi long, span long")
    got = interval_join(spark.range(5000).withColumnRenamed("id", "at"), s, [], "at", "lo", "hi").groupBy("span").count().collect()
    assert {r["span"]: r["count"] for r in got} == {0: 5000} | {i: 1 for i in range(1, 100)}


def test_no_all_pairs_plan(spark):
    s = spark.createDataFrame([(0, 5, 1)], "lo long, hi long, span long")
    plan = interval_join(spark.range(10), s, [], "id", "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, few, share):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(4)
    n = 4001
    columns = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "one": np.ones(n), "skewed": np.where(rng.random(n) < 0.7, 0.0, rng.exponential(size=n))}
    rows = [tuple(None if c == "ties" and i % 3 == 0 else float(v[i]) for c, v in columns.items()) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", nothing double").repartition(5)
    got = {r["column_name"]: r["quantile"] for r in quantiles.exact_quantiles(df, df.columns, share).collect()}
    expected = {c: np.quantile([r[i] for r in rows if r[i] is not None], share) for i, c in enumerate(columns)}
    assert got.pop("nothing") is None
    assert got == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_brackets_hold_the_rank_of_many_values(spark):
    df = spark.range(300_000).select(((F.col("id") * 7919) % 300_007).cast("double").alias("v"), (F.col("id") % 10).cast("double").alias("w"))
    around = quantiles.brackets(df, ["v", "w"], 0.5)
    assert around["v"][2] - around["v"][1] < 300 and around["w"][0] == 300_000
    values = sorted((i * 7919) % 300_007 for i in range(300_000))
    got = {r["column_name"]: r["quantile"] for r in quantiles.exact_quantiles(df, ["v", "w"], 0.5).collect()}
    assert got == {"v": (values[149_999] + values[150_000]) / 2, "w": 4.5}


def test_rows_are_not_multiplied(spark):
    df = spark.range(1000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    assert {r["column_name"] for r in quantiles.exact_quantiles(df, ["a", "b"], 0.5).collect()} == {"a", "b"}
    assert quantiles.exact_quantiles(df.where("false"), ["a"], 0.5).collect()[0]["quantile"] is None
    assert quantiles.exact_quantiles(df, [], 0.5).collect() == []
