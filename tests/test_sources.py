import json
import random

import pytest
from pyspark.sql import functions as F

from flowframe.operators import groups
from flowframe.sources import loaders, row_groups
from flowframe.sources.flows import ContractError, canonical_columns, config_hash, merged, read_flows, role, schema_hash, validate_manifests
from flowframe.sources.staging import staged


def test_names_are_trimmed_and_must_not_collide(spark):
    df = spark.createDataFrame([(1, 2.0, "z", True)], ["size ", "\trate", "kind", " ok "])
    assert canonical_columns(df).columns == ["size", "rate", "kind", "ok"]
    with pytest.raises(ContractError, match="rate"):
        canonical_columns(spark.createDataFrame([(1, 2, 3)], ["rate\n", "x", "  rate"]))


def test_roles():
    assert role(["a", "Label"], ["Label", "label"], "label") == "Label"
    for columns in (["a"], ["Label", "label"]):
        with pytest.raises(ContractError):
            role(columns, ["Label", "label"], "label")


def test_files_give_provenance(spark, tmp_path):
    for day in ("mon", "tue"):
        spark.range(5).select(F.lit("x").alias(" Label"), "id").coalesce(1).write.parquet(str(tmp_path / "data" / day))
    df = read_flows(spark, str(tmp_path / "data"), expected_files=2)
    assert {"Label", "id", "__capture_day", "__source_file_id", "__source_row_id", "__file_path", "__row_index"} == set(df.columns)
    rows = df.orderBy("__capture_day", "__source_row_id").collect()
    assert [r["__source_row_id"] for r in rows] == [0, 1, 2, 3, 4] * 2 and {r["__capture_day"] for r in rows} == {"mon", "tue"}
    with pytest.raises(ContractError):
        read_flows(spark, str(tmp_path / "data"), expected_files=3)


def test_manifests(spark, tmp_path):
    columns = [" Label", " Timestamp", "f"]
    made = {
        "dataset_summary": {"source_file_count": 5, "total_rows": 70, "schema_hash": "d41"},
        "validation_report": {"status": "passed", "error_count": 0, "errors": []},
        "column_schema": {"original_column_count": 3, "output_column_count": 6, "schema_hash": "d41", "original_columns": columns, "provenance_columns_appended": ["__capture_day", "__source_file_id", "__source_row_id"]},
    }
    for name, content in made.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    expected = {"source_file_count": 5, "original_column_count": 3, "schema_hash": "d41"}
    found = validate_manifests(spark, str(tmp_path), expected, ["Label"], ["Timestamp"])
    assert found == {"label": "Label", "timestamp": "Timestamp", "rows": 70}
    with pytest.raises(ContractError):
        validate_manifests(spark, str(tmp_path), expected | {"schema_hash": "other"}, ["Label"], ["Timestamp"])
    for report in ({"status": "ok", "error_count": 0}, {"status": "passed"}, {"status": "passed", "error_count": 1}):
        (tmp_path / "validation_report.json").write_text(json.dumps(report))
        with pytest.raises(ContractError, match="did not pass"):
            validate_manifests(spark, str(tmp_path), expected, ["Label"], ["Timestamp"])


@pytest.fixture
def two_files(tmp_path):
    """Files of 1000 and 130 rows in row groups of 200 and 70."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, n, size in (("0", 1000, 200), ("sub/1", 130, 70)):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({" Label": ["AB"[i % 2] for i in range(n)], "i": list(range(n)), "x": [None if i % 7 == 0 else i / 4 for i in range(n)]}), tmp_path / "t" / f"{name}.parquet", row_group_size=size)
    (tmp_path / "t" / "_hidden").write_text("no Parquet")
    return str(tmp_path / "t")


def test_row_groups_come_from_footers(spark, two_files):
    table = row_groups.file_row_groups(spark, two_files)
    found = sorted((r["file_id"], r["row_group"], r["start"], r["n_rows"]) for r in table.collect())
    assert found == [*[("0.parquet", g, g * 200, 200) for g in range(5)], ("sub/1.parquet", 0, 0, 70), ("sub/1.parquet", 1, 70, 60)]
    one = row_groups.file_row_groups(spark, f"{two_files}/sub/1.parquet").collect()
    assert [r["file_id"] for r in one] == ["1.parquet"] * 2
    manifest = groups.require_splits(groups.group_manifest(table, 12, 0.7, 42))
    assert groups.manifest_summary(manifest).agg(F.sum("n_rows")).first()[0] == 1130
    rows = loaders.placed_rows(spark, two_files, table)
    assert rows.where("i <> row_id or inside <> i % if(file_id = '0.parquet', 200, 70) or row_group <> i div if(file_id = '0.parquet', 200, 70)").count() == 0 and rows.count() == 1130
    assert {r["__capture_day"] for r in rows.select("__capture_day").distinct().collect()} == {"t", "sub"}


def test_files_with_other_columns_are_refused(spark, two_files):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"other": [1]}), f"{two_files}/2.parquet")
    with pytest.raises(ContractError, match="columns"):
        row_groups.file_row_groups(spark, two_files)


def test_samples_decode_only_their_row_groups(spark, two_files):
    """The rows decoded are those of the row groups asked for, up to the last slice's batch."""
    decoded = spark.sparkContext.accumulator(0)
    few = loaders.load_sample(spark, two_files, 20, 2, 42, decoded).collect()
    assert sorted({(r["file_id"], r["row_group"]) for r in few}) == [("0.parquet", 0), ("0.parquet", 4), ("sub/1.parquet", 0), ("sub/1.parquet", 1)]
    assert sum(r["file_id"] == "0.parquet" for r in few) == sum(r["file_id"] != "0.parquet" for r in few) == 20
    assert decoded.value % (2 * 200 + 130) == 0 and decoded.value <= 2 * (2 * 200 + 130)  # identities are counted, then rows are given
    decoded = spark.sparkContext.accumulator(0)
    slices = loaders.load_slices(spark, two_files, 32, 42, 16, most=2, rows_read=decoded).where("file_id = '0.parquet'").collect()
    ids = sorted(r["i"] for r in slices)
    assert len(ids) == 32 and sum(b - a != 1 for a, b in zip(ids, ids[1:], strict=False)) <= 1
    assert decoded.value <= 2 * (2 * 200 + 130)


def test_slices_may_overlap_and_reading_stops_behind_them(spark, two_files, monkeypatch):
    plan = row_groups.file_row_groups(spark, two_files).where("file_id = '0.parquet' and row_group = 3").drop("n_rows")
    plan = plan.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("first"), F.lit(t).cast("long").alias("take"), F.lit(n).alias("name")) for a, t, n in ((5, 10, "a"), (8, 4, "b"), (150, 0, "c"))])))
    decoded = spark.sparkContext.accumulator(0)
    rows = row_groups.read_slices(spark, two_files, plan.select("*", "s.*").drop("s"), ["i"], decoded)
    assert rows.columns == ["file_id", "row_group", "row_id", "inside", "path", "name", "i"]
    got = sorted((r["name"], r["row_id"], r["i"], r["inside"]) for r in rows.collect())
    assert got == [*[("a", 600 + k, 600 + k, k) for k in range(5, 15)], *[("b", 600 + k, 600 + k, k) for k in range(8, 12)]]


def test_groups_of_a_manifest_are_read_whole(spark, two_files):
    manifest = groups.group_manifest(row_groups.file_row_groups(spark, two_files), 64, 0.7, 42)
    decoded = spark.sparkContext.accumulator(0)
    test = manifest.where("split = 'test'")
    rows = loaders.read_groups(spark, two_files, test, decoded)
    sizes = {r["group_id"]: r["n"] for r in rows.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {r["group_id"]: r["n_rows"] for r in test.collect()}
    touched = test.select("file_id", "row_group").distinct().join(row_groups.file_row_groups(spark, two_files), ["file_id", "row_group"]).agg(F.sum("n_rows")).first()[0]
    assert decoded.value == touched


def test_row_group_format_leaves_out_what_cannot_match(spark, two_files):
    every = row_groups.read_row_groups(spark, two_files)
    assert every.columns == ["file_id", "row_group", "row_id", "Label", "i", "x"] and every.count() == 1130 and every.rdd.getNumPartitions() == 7
    few = row_groups.read_row_groups(spark, two_files, ["x"], between={"i": (390, 610)})
    assert few.columns == ["file_id", "row_group", "row_id", "x"] and few.rdd.getNumPartitions() == 3
    assert sorted(r["row_id"] for r in few.collect()) == list(range(390, 611))
    assert row_groups.read_row_groups(spark, two_files, files=["1.parquet"], row_groups=[1]).count() == 60
    assert row_groups.read_row_groups(spark, two_files, between={"row_id": (None, 3)}).count() == 8
    assert row_groups.read_row_groups(spark, two_files, between={"x": (0, None)}).count() == sum(i % 7 > 0 for n in (1000, 130) for i in range(n))
    assert every.where("row_group = 0").count() == 270 and every.count() == 1130


def test_repeated_identities_are_refused(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1)], "__source_file_id string, __source_row_id long").coalesce(1).write.parquet(str(tmp_path / "d"))
    with pytest.raises(ContractError, match="identity"):
        loaders.load_sample(spark, str(tmp_path / "d"), 5, 1, 1)


def test_settings():
    assert merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4}}) == {"a": {"b": 1, "c": 4}, "d": 3}
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1}) != config_hash({"a": 1, "b": 3})


def test_staged_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("x", F.lit(random.random()))
    again = staged(df, "t")
    assert again.schema.simpleString() == df.schema.simpleString() and again.count() == 10
    assert schema_hash(df) == schema_hash(again)


def test_an_applications_tables_are_removed_at_its_end(tmp_path):
    """A process of its own: its staged tables are gone when it ends, whether it stops its session or not."""
    import subprocess
    import sys

    code = """
from flowframe.session import get_session
from flowframe.sources.staging import new_folder, staged
import sys
spark = get_session("local[1]", 1, spark__checkpoint__dir="file://" + sys.argv[1], spark__driver__memory="1g")
print(staged(spark.range(3), "t").count(), len(list(__import__("pathlib").Path(sys.argv[1]).rglob("*.parquet"))) > 0)
if sys.argv[2] == "stop":
    spark.stop()
"""
    for end in ("stop", "leave"):
        done = subprocess.run([sys.executable, "-c", code, str(tmp_path), end], capture_output=True, text=True, timeout=300)
        assert done.stdout.split()[-2:] == ["3", "True"], done.stderr[-500:]
        assert not list(tmp_path.rglob("*.parquet"))
