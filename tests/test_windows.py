import pytest
from pyspark.sql import functions as F

from flowframe.operators import windows as W


def rows(spark, ids, group="g", bad=()):
    data = [(group, i, f"10.0.0.{n % 3 + 1}", " nan " if i in bad else f"10.0.1.{n % 2 + 1}", str(n % 2), f"{group}:{i}", float(n)) for n, i in enumerate(ids)]
    return spark.createDataFrame(data, "group_id string, row_id long, src string, dst string, label string, sample_id string, value double")


def made(spark, ids, length, stride, **more):
    columns = {c: F.col(c) for c in ("src", "dst", "label", "sample_id", "value")}
    return W.windows(W.with_runs(rows(spark, ids, **more)), columns, length, stride)


def test_three_windows_twelve_edges(spark):
    graphs = W.with_graph(made(spark, range(8), 4, 2))
    assert graphs.count() == 3 and W.edge_rows(graphs).count() == 12
    nodes = W.node_rows(graphs).collect()
    assert all(len(n["node_hash"]) == 64 for n in nodes) and not any("10.0." in n["node_hash"] for n in nodes)
    stops = [r["edge_stop"] for r in W.pointers(graphs, 4).orderBy("first_row").collect()]
    assert stops == [4, 8, 12]


def test_broken_graphs_and_pointers_are_counted(spark):
    graphs = W.with_graph(made(spark, range(8), 4, 2))
    assert W.integrity(graphs, 4).first()[:] == (3, 0, 0, 0)
    outside = graphs.withColumn("edges", F.transform("edges", lambda e: F.struct(e["time"], F.lit(99).alias("src"), e["dst"].alias("dst"))))
    assert W.integrity(outside, 4).first()[:] == (3, 0, 3, 0) and W.integrity(graphs, 5).first()[:] == (3, 0, 0, 3)
    torn = graphs.withColumn("steps", F.reverse("steps"))
    assert W.integrity(torn, 4).first()["n_broken"] == 3
    placed = W.pointers(graphs, 4)
    assert W.pointer_integrity(placed).first()[-2:] == (0, 0)
    assert W.pointer_integrity(placed.where("edge_start <> 4")).first()[-2:] == (1, 1)


def test_windows_do_not_bridge_gaps(spark):
    got = made(spark, [0, 1, 2, 4, 5, 6], 3, 1).orderBy("first_row").collect()
    assert [[s["row_id"] for s in r["steps"]] for r in got] == [[0, 1, 2], [4, 5, 6]]


def test_stride_restarts_at_each_run(spark):
    got = made(spark, [0, 1, 2, 3, 4, 10, 11, 12, 13], 2, 2).orderBy("first_row").collect()
    assert [r["first_row"] for r in got] == [0, 2, 10, 12]


def test_a_bad_endpoint_drops_its_windows_only(spark):
    got = made(spark, range(8), 4, 2, bad={1}).select("first_row", W.endpoints_valid().alias("ok")).orderBy("first_row").collect()
    assert [(r["first_row"], r["ok"]) for r in got] == [(0, False), (2, True), (4, True)]


def test_repeated_rows_are_an_error(spark):
    with pytest.raises(Exception, match="repeat"):
        made(spark, [0, 1, 1, 2], 2, 1).collect()


def test_partitioning_does_not_matter(spark):
    columns = {"label": F.col("label")}
    base = rows(spark, range(40))
    one, many = (W.windows(W.with_runs(base.repartition(n)), columns, 5, 3).orderBy("first_row").collect() for n in (1, 7))
    assert one == many and len(one) == 12


def test_empty_and_short(spark):
    assert made(spark, [], 3, 1).count() == 0 and made(spark, [1, 2], 3, 1).count() == 0


def test_pointers_make_their_windows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    graphs = spark.range(0, 500, 1, 4).selectExpr("concat('g', lpad(id, 4, '0')) as group_id", "id as first_row", "int(id % 5 + 1) as n_nodes", "array(named_struct('time', 0, 'src', 0L, 'dst', id % 5)) as edges")
    placed = W.pointers(graphs.mapInArrow(count, graphs.schema), 1)
    ends = [r["node_stop"] for r in placed.orderBy("group_id").collect()]
    assert made.value == 500 and ends == [sum(i % 5 + 1 for i in range(k + 1)) for k in range(500)]
    edges = W.edges_of_windows(W.flat_edges(graphs, placed), placed).collect()
    assert sorted((r["first_row"], r["time"], r["src"], r["dst"]) for r in edges) == [(i, 0, 0, i % 5) for i in range(500)]
