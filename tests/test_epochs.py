"""The stream of groups: each group once an epoch, resumed runs equal unbroken ones, bounded buffers, nothing lost."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowframe.operators import groups
from flowframe.sources.flows import ContractError
from flowframe.sources.row_groups import file_row_groups
from flowframe.sources.staging import new_folder
from flowframe.streaming import epochs as E
from flowframe.streaming.ingest import whole_files, write_observed


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    """Two files in row groups of 300; groups of 32 rows; and the epochs' schedule."""
    folder = tmp_path_factory.mktemp("flows")
    for f, n in enumerate((1500, 700)):
        pq.write_table(pa.table({" label": ["AB"[i // 9 % 2] for i in range(n)], "v": [float(i) for i in range(n)], "w": [i % 7 for i in range(n)]}), folder / f"{f}.parquet", row_group_size=300)
    manifest = groups.group_manifest(file_row_groups(spark, str(folder)), 32, 0.7, 42)
    return str(folder), manifest, E.write_schedule(spark, str(folder), manifest, 3, 42)


def windows_of(manifest):
    return sum(max(0, (r["n_rows"] - 8) // 4 + 1) for r in manifest.where("split = 'train'").collect())


def stream(spark, flows, batch=9, capacity=40, buffers=4):
    rows = E.read_epochs(spark, flows[0], flows[2], ["label", "v", "w"], batch)
    return E.buffered(E.cut_windows(rows, "label", ["v", "w"], 8, 4), 42, capacity, buffers)


def run(spark, flows, batches=None, folder=None, **more):
    folder = folder or new_folder(spark, "epochs")
    done = E.run_epochs(stream(spark, flows, **more), flows[2], f"{folder}/out", f"{folder}/progress", batches=batches)
    return folder, done


def rows_of(spark, folder):
    return sorted((r["batch"], r["buffer"], r["turn"], r["epoch"], r["group_id"], r["first_row"], r["target"], tuple(r["features"]), r["n_held"]) for r in spark.read.parquet(f"{folder}/out").collect())


@pytest.fixture(scope="module")
def unbroken(spark, flows):
    folder, done = run(spark, flows)
    assert done
    return rows_of(spark, folder)


def test_every_window_comes_once_an_epoch_in_another_order(flows, unbroken):
    manifest, n = flows[1], windows_of(flows[1])
    keys = {e: [(r[4], r[5]) for r in unbroken if r[3] == e] for e in (1, 2, 3)}
    assert all(len(k) == len(set(k)) == n for k in keys.values())
    assert set(keys[1]) == set(keys[2]) == set(keys[3]) and keys[1] != keys[2] != keys[3]
    assert {k[0] for k in keys[1]} <= {r["group_id"] for r in manifest.where("split = 'train'").collect()}
    for r in unbroken[:50]:
        at = r[5]
        assert r[7] == tuple(x for i in range(at, at + 8) for x in (float(i), float(i % 7))) and r[6] == "AB"[(at + 7) // 9 % 2]


def test_buffers_are_bounded_and_mix_batches(unbroken):
    assert max(r[8] for r in unbroken) == 10
    last = {e: max(r[0] for r in unbroken if r[3] == e) for e in (1, 2, 3)}
    assert all(r[8] == 0 for r in unbroken if r[0] in last.values())
    assert sum(r[0] == last[1] for r in unbroken if r[3] == 1) >= 40  # what was held is let out


def test_a_stopped_run_goes_on_as_if_it_was_not(spark, flows, unbroken):
    folder, runs = new_folder(spark, "stopped"), 0
    while not run(spark, flows, 5, folder)[1]:
        runs += 1
        assert runs < 20
    assert runs >= 1 and rows_of(spark, folder) == unbroken


def test_other_batches_give_the_same_windows(spark, flows, unbroken):
    folder, _ = run(spark, flows, batch=1000, capacity=1, buffers=1)
    got = rows_of(spark, folder)
    assert sorted(r[3:8] for r in got) == sorted(r[3:8] for r in unbroken) and {r[0] for r in got} == {0, 1, 2}


def test_a_lost_row_stops_the_run_before_the_commit(spark, flows):
    folder = new_folder(spark, "loss")
    lose = lambda rows: rows.where("not (epoch = 2 and turn = 0 and buffer = 1)")
    with pytest.raises(Exception, match="rows came"):
        E.run_epochs(stream(spark, flows), flows[2], f"{folder}/out", f"{folder}/progress", make=lose)
    kept = rows_of(spark, folder)
    assert {r[3] for r in kept} == {1} and len(glob.glob(f"{folder.removeprefix('file://')}/progress/commits/[0-9]*")) == len({r[0] for r in kept})
    assert E.run_epochs(stream(spark, flows), flows[2], f"{folder}/out", f"{folder}/progress")
    assert len(rows_of(spark, folder)) == 3 * windows_of(flows[1])


def test_repeated_groups_and_empty_schedules_are_refused(spark, flows):
    with pytest.raises(ContractError, match="twice"):
        E.write_schedule(spark, flows[0], flows[1].unionByName(flows[1].limit(1)), 1, 1)
    none = E.write_schedule(spark, flows[0], flows[1].where("split = 'test'"), 1, 1)
    with pytest.raises(ContractError, match="no training group"):
        E.read_epochs(spark, flows[0], none, ["v"], 3)


def test_observed_writes(spark):
    folder = new_folder(spark, "observed")
    assert write_observed(spark.range(10), f"{folder}/a") == 10 and spark.read.parquet(f"{folder}/a").count() == 10
    assert write_observed(spark.range(0), f"{folder}/b") == 0
    with pytest.raises(ContractError, match="10 rows came and 20 went"):
        write_observed(spark.range(10), f"{folder}/c", lambda rows: rows.select("id", F.explode(F.array(F.lit(1), F.lit(2)))))
    assert not glob.glob(f"{folder.removeprefix('file://')}/c")


def test_a_file_in_two_batches_is_refused(spark):
    folder = new_folder(spark, "files")
    days = lambda *names: spark.createDataFrame([(n,) for n in names], "file_id string")
    whole_files(days("mon", "tue"), 0, folder)
    whole_files(days("wed"), 1, folder)
    whole_files(days("wed", "wed"), 1, folder)  # tried again
    with pytest.raises(ContractError, match="tue"):
        whole_files(days("thu", "tue"), 2, folder)


def test_batches_read_the_laid_out_rows_only(spark, tmp_path):
    """Row groups are opened while rows are laid out, not once for each of their groups; groups cross the reader's batches."""
    pq.write_table(pa.table({"label": ["AB"[i // 9 % 2] for i in range(70_000)], "v": [float(i) for i in range(70_000)]}), tmp_path / "0.parquet")
    manifest = groups.group_manifest(file_row_groups(spark, str(tmp_path)), 70, 0.7, 42)
    schedule = E.write_schedule(spark, str(tmp_path), manifest, 2, 42)
    train = {r["group_id"]: r["offset"] for r in manifest.where("split = 'train'").collect()}
    assert schedule.groups == len(train) > E.CHUNK
    rows = E.read_epochs(spark, str(tmp_path), schedule, ["label", "v"], 400)
    (tmp_path / "0.parquet").unlink()
    folder = new_folder(spark, "epochs")
    assert E.run_epochs(E.buffered(E.cut_windows(rows, "label", ["v"], 8, 4), 42, 40, 4), schedule, f"{folder}/out", f"{folder}/progress")
    found = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r["epoch"], r["group_id"], r["first_row"]) for r in found) == sorted((e, g, first + i) for e in (1, 2) for g, first in train.items() for i in range(0, 63, 4))
    assert all(r["features"] == [float(r["first_row"] + i) for i in range(8)] for r in found)
