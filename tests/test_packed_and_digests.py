"""Packed arrays, table digests, contracts, bends of ROC curves, labels outside the vocabulary."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowframe.operators import metrics, preprocess
from flowframe.sources import packed
from flowframe.sources.flows import ContractError, digest_words, table_digest
from flowframe.sources.staging import create, new_folder, remove
from flowframe.streaming.ingest import guard_contract

SCHEMA = "id long, x double, f float, ok boolean, name string, numbers array<int>, weights array<double>, words array<string>"


def rows(n):
    draw = random.Random(n)
    return [(
        i, draw.random(), 0.5 * i, i % 3 == 0, draw.choice(["", "é漢", "plain", "a\0b"]), [draw.randrange(9) for _ in range(draw.randrange(4))],
        [draw.random() for _ in range(i % 3)], [draw.choice(["", "ß", "two words"]) for _ in range(draw.randrange(3))],
    ) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [7, 100_000])
def test_packed_tables_come_back(spark, shard_rows):
    path, data = new_folder(spark, "packed"), rows(50)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    packed.write_packed(df, path, shard_rows=shard_rows)
    again = packed.read_packed(spark, path)
    assert again.columns == ["row", *df.columns] and again.select(*df.columns).schema.simpleString() == df.schema.simpleString()
    got = again.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(50))
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
    some = packed.rows_at(path, 13, 31).to_pylist()
    assert [tuple(r.values()) for r in some] == [tuple(r)[1:] for r in got[13:31]]
    assert packed.rows_at(path, 50, 60).num_rows == 0


def test_bases_make_local_pointers_global(spark):
    path = new_folder(spark, "packed")
    df = spark.createDataFrame(rows(40), SCHEMA).repartition(4)
    packed.write_packed(df, path)
    manifest, flat, at = packed._manifest(path), [], []
    for s in manifest["shards"]:
        arrays = packed._arrays(path, s)
        at += (arrays["numbers.ptr"][:-1] + s["base"]["numbers"]).tolist()
        flat += arrays["numbers"].tolist()
    at.append(len(flat))
    by_row = [r["numbers"] for r in packed.read_packed(spark, path).orderBy("row").collect()]
    assert [flat[a:b] for a, b in zip(at, at[1:], strict=False)] == by_row and manifest["values"]["numbers"] == len(flat)


def test_a_failed_task_leaves_nothing(spark):
    path = new_folder(spark, "packed")
    local = path.removeprefix("file://")
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") != 99, F.lit("x")).alias("name"))
    with pytest.raises(Exception, match="nulls"):
        packed.write_packed(bad, path, shard_rows=5)
    assert not glob.glob(f"{local}/*")
    with pytest.raises(Exception, match="no manifest"):
        packed.read_packed(spark, path)
    packed.write_packed(spark.range(3), path)
    with pytest.raises(Exception, match="exists"):
        packed.write_packed(spark.range(4), path)
    packed.write_packed(spark.range(4), path, overwrite=True)
    assert packed.read_packed(spark, path).count() == 4 and len(glob.glob(f"{local}/manifest.json")) == 1
    with pytest.raises(ContractError, match="row"):
        packed.write_packed(spark.range(1).withColumnRenamed("id", "row"), path)
    with pytest.raises(Exception, match="cannot be packed"):
        packed.write_packed(spark.range(1).select(F.create_map("id", "id").alias("m")), new_folder(spark, "packed"))


def test_an_empty_table_is_a_table(spark):
    path = new_folder(spark, "packed")
    packed.write_packed(spark.createDataFrame([], SCHEMA), path)
    again = packed.read_packed(spark, path)
    assert again.count() == 0 and again.columns[1:] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_a_shard_holds_so_many_bytes_at_most(spark):
    path, text = new_folder(spark, "packed"), "é" * 50_000
    df = spark.range(0, 1000, 1, 1).select("id", F.lit(text).alias("text"), F.array(F.lit("a"), F.lit("")).alias("words"))
    packed.write_packed(df, path)
    shards = packed._manifest(path)["shards"]
    assert len(shards) >= 6 and sum(s["rows"] for s in shards) == 1000
    assert all(len(packed._arrays(path, s)["text"]) <= packed.SHARD_BYTES for s in shards)
    got = packed.read_packed(spark, path).where(F.col("text") == text).where("words[0] = 'a' and words[1] = '' and size(words) = 2 and id = row")
    assert got.count() == 1000


def test_digest_knows_rows_and_columns_not_their_order(spark):
    data = [(1, "a", None), (1, "a", None), (2, None, 0.5), (None, "", -1.0)]
    df = spark.createDataFrame(data, "i long, s string, d double")
    same = [df.repartition(3), df.orderBy(F.desc("i")).coalesce(1), df.select("d", "s", "i")]
    assert {table_digest(x) for x in same} == {table_digest(df)}
    other = [
        df.dropDuplicates(), df.unionAll(df.limit(1)), df.withColumn("s", F.coalesce("s", F.lit(""))), df.withColumnRenamed("s", "t"),
        df.withColumn("i", F.col("i").cast("int")), df.where("false"), spark.createDataFrame([(1, None, None), *data[1:3], (None, "a", -1.0)], df.schema),
    ]
    assert len({table_digest(x) for x in [df, *other]}) == len(other) + 1
    assert digest_words(df.where("false")).first()[:] == (0, "0", "0", "0", "0")


def test_a_contract_holds_settings_and_rows(spark):
    folder, table = new_folder(spark, "contract"), spark.range(5)
    guard_contract(spark, folder, {"seed": 1}, table)
    guard_contract(spark, folder, {"seed": 1}, table.repartition(3))
    for contract, rows_ in (({"seed": 2}, table), ({"seed": 1}, spark.range(6)), ({"seed": 1}, None)):
        with pytest.raises(ValueError, match="other"):
            guard_contract(spark, folder, contract, rows_)
    assert create(spark, f"{folder}/x", "é") and not create(spark, f"{folder}/x", "other")
    assert spark.read.text(f"{folder}/x").first()[0] == "é"
    remove(spark, f"{folder}/x")
    assert create(spark, f"{folder}/x", "again")


@pytest.mark.parametrize("n", [1, 2, 3, 40, 2000])
def test_corners_equal_second_differences(spark, n):
    draw = random.Random(n)
    data = [(k, round(draw.random() * (n if k == "a" else 9)), draw.random() < 0.4) for k in "ab" for _ in range(n)]
    data += [("c", 1, True), ("c", 2, True)]
    df = spark.createDataFrame(data, "k string, s long, y boolean")
    got = {}
    for r in metrics.roc_corners(df, ["k"], "s", F.col("y")).collect():
        got.setdefault(r["k"], []).append((r["score"], r["tp"], r["fp"]))
    for k in "abc":
        own = [(s, y) for kk, s, y in data if kk == k]
        scores = sorted({s for s, _ in own}, reverse=True)
        tp = np.cumsum([sum(y for s, y in own if s == x) for x in scores])
        fp = np.cumsum([sum(not y for s, y in own if s == x) for x in scores])
        if not len(scores) or not tp[-1] or not fp[-1]:
            assert k not in got
            continue
        keep = np.ones(len(scores), bool)
        if len(scores) > 2:
            keep[1:-1] = (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0)
        expected = [(scores[i], tp[i], fp[i]) for i in np.flatnonzero(keep)]
        assert sorted(got[k], reverse=True) == expected
        area = lambda pts: np.trapezoid([0, *[p[1] for p in pts]], [0, *[p[2] for p in pts]])
        assert area(expected) == area([(0, t, f) for t, f in zip(tp, fp, strict=True)])


def test_the_first_unknown_labels_are_named(spark):
    df = spark.createDataFrame([(f"l{i:02}",) for i in range(30)] + [(None,)], "label string")
    preprocess.require_known(df, "label", [f"l{i:02}" for i in range(30)])
    with pytest.raises(ContractError) as error:
        preprocess.require_known(df, "label", ["l03"])
    assert str(error.value).endswith(": " + ", ".join(f"l{i:02}" for i in range(21) if i != 3))
