"""Epochs of whole groups as a stream: a source with a cursor, windows, and a bounded shuffle buffer.

The schedule of all epochs is a table; the stream's offsets are (epoch, place) in it. The groups' rows are laid out once in
the schedule's order: every row group is opened once, and a batch, so many whole groups of one epoch, reads only the
chunks that hold its places. So an epoch gives every group once, and a run that was stopped goes on behind the last
group of its last batch. Windows are cut while a group passes. Buffers hold a bounded number of them in the state
store and let out what is beyond that in a seeded order; the last group of an epoch empties them. A buffer counts what
it takes in and lets out, and a batch what it made and wrote: where they differ the batch fails before it is committed.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowframe.operators.sampling import epoch_schedule
from flowframe.sources.flows import ContractError
from flowframe.sources.row_groups import BATCH_ROWS, _opened, _trimmed, file_row_groups
from flowframe.sources.staging import exists, new_folder
from flowframe.streaming.ingest import write_observed

#: Columns that the source adds; ``closing`` marks the last row of an epoch.
PLACE = T.StructType([
    T.StructField("epoch", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("group_id", T.StringType()),
    T.StructField("row_id", T.LongType()), T.StructField("closing", T.BooleanType()),
])
#: Windows that all buffers hold at most, and buffers.
CAPACITY, BUFFERS = 8192, 8
#: Groups of a chunk, a file that holds places of an epoch that follow each other.
CHUNK = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER, PARTS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


@dataclass(frozen=True)
class Schedule:
    """Where the table of all epochs' groups is, and how many there are."""

    path: str
    groups: int
    epochs: int


def write_schedule(spark: SparkSession, path: str, manifest: DataFrame, epochs: int, seed: int) -> Schedule:
    """Writes every epoch's order of the training groups of ``manifest`` (made from the footers below ``path``)."""
    order = epoch_schedule(manifest, epochs, seed)
    twice = manifest.groupBy("group_id").count().where("count > 1").limit(1).count()
    if twice:
        raise ContractError("a group occurs twice in the manifest")
    starts = file_row_groups(spark, path).select("file_id", "row_group", "start", F.col("path").alias("file"))
    groups = manifest.join(starts, ["file_id", "row_group"]).select("group_id", "file", "row_group", "start", F.col("offset").alias("first"), F.col("n_rows").alias("take"))
    target = new_folder(spark, "schedule")
    order.join(groups, "group_id").repartitionByRange("epoch", "place").sortWithinPartitions("epoch", "place").write.parquet(target)
    return Schedule(target, manifest.where("split = 'train'").count(), epochs)


def _slices(found, row_group: int, names: list[str], slices: list[dict]) -> Iterator[tuple[list[dict], np.ndarray, pa.Table]]:
    """Slices of a row group, which is read once: those that a batch completes, how many rows each has, and the rows."""
    slices, have, low, at = sorted(slices, key=lambda s: s["first"]), None, 0, 0

    def cut(done: list[dict]) -> tuple[list[dict], np.ndarray, pa.Table]:
        runs = [np.arange(s["first"] - low, min(s["first"] + s["take"], at) - low) for s in done]
        return done, np.array([len(r) for r in runs]), have.take(np.concatenate(runs))

    for batch in found.iter_batches(BATCH_ROWS, [row_group], names):
        part = pa.Table.from_batches([batch])
        have, at = part if have is None else pa.concat_tables([have, part]), at + batch.num_rows
        if done := [s for s in slices if s["first"] + s["take"] <= at]:
            yield cut(done)
            slices = [s for s in slices if s["first"] + s["take"] > at]
        if not slices:
            return
        gone = min(slices[0]["first"], at) - low
        have, low = have.slice(gone), low + gone
    if rest := [s for s in slices if s["first"] < at]:
        yield cut(rest)


def _lay_out(spark: SparkSession, schedule: Schedule, schema: T.StructType, target: str) -> None:
    """Writes a row for each place of the schedule, its group's values as lists, in a file for each chunk of an epoch.

    A row group is opened once, by one task, for all groups and epochs.
    """
    wanted = [f for f in schema if f.name not in PLACE.names]
    turns = F.collect_list(F.struct("epoch", "place")).alias("turns")
    plan = spark.read.parquet(schedule.path).groupBy("group_id", "file", "row_group", "start", "first", "take").agg(turns)
    turn = T.ArrayType(T.StructType([PLACE["epoch"], PLACE["place"]]))
    made = T.StructType([T.StructField("turns", turn), PLACE["group_id"], T.StructField("first_row", T.LongType()), *[T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(wanted)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, own = to_arrow_schema(made), to_arrow_schema(T.StructType(wanted))

        def group(slices: list[dict]) -> Iterator[pa.RecordBatch]:
            found, file = _opened(slices[0]["file"])
            with file:
                names = {n.strip(): n for n in found.schema_arrow.names}
                for done, sizes, rows in _slices(found, slices[0]["row_group"], [names[f.name] for f in wanted], slices):
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, rows.column(names[f.name]).combine_chunks().cast(f.type)) for f in own]
                    given = [[s["turns"] for s in done], [s["group_id"] for s in done], [s["start"] + s["first"] for s in done], *lists]
                    yield pa.RecordBatch.from_arrays([x.cast(k.type) if isinstance(x, pa.Array) else pa.array(x, k.type) for x, k in zip(given, kinds, strict=True)], schema=kinds)

        now: list[dict] = []
        for batch in batches:
            for s in batch.to_pylist():
                if now and (s["file"], s["row_group"]) != (now[0]["file"], now[0]["row_group"]):
                    yield from group(now)
                    now = []
                now.append(s)
        if now:
            yield from group(now)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = plan.repartition(parts, "file", "row_group").sortWithinPartitions("file", "row_group", "first").mapInArrow(run, made)
    each = read.select(F.inline("turns"), "group_id", "first_row", *[f"c{i}" for i in range(len(wanted))]).withColumn("chunk", F.expr(f"place div {CHUNK}"))
    each.withColumn("of", F.col("epoch")).repartition(parts, "of", "chunk").sortWithinPartitions("of", "chunk", "place").write.partitionBy("of", "chunk").parquet(target)


@dataclass
class _Bundle(D.InputPartition):
    epoch: int
    start: int
    stop: int


class _GroupReader(D.DataSourceStreamReader):
    """Groups by their places; the next batch begins where the last planned one ends."""

    def __init__(self, options: dict, schema: T.StructType):
        self.schema, self.path = schema, options["rows"]
        self.groups, self.epochs, self.batch, self.tasks = (int(options[k]) for k in ("groups", "epochs", "batch", "tasks"))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"epoch": 1, "place": 0}

    def latestOffset(self) -> dict:
        at = self._next(self.at or self.initialOffset())
        return {"epoch": at["epoch"], "place": min(self.groups, at["place"] + self.batch)}

    def _next(self, at: dict) -> dict:
        """The offset at which reading goes on: behind an epoch's last group the next epoch begins."""
        return {"epoch": at["epoch"] + 1, "place": 0} if at["place"] >= self.groups and at["epoch"] < self.epochs else at

    def partitions(self, start: dict, end: dict) -> list[_Bundle]:
        self.at, start = end, self._next(start)  # a query that starts again plans its last batch first
        size = max(1, -(-(end["place"] - start["place"]) // self.tasks))
        return [_Bundle(start["epoch"], i, min(i + size, end["place"])) for i in range(start["place"], end["place"], size)]

    def read(self, partition: _Bundle) -> Iterator[pa.RecordBatch]:
        at = partition.start
        while at < partition.stop:
            chunk = at // CHUNK
            stop = min(partition.stop, (chunk + 1) * CHUNK)
            yield from self._rows(partition.epoch, chunk, at, stop)
            at = stop

    def _rows(self, epoch: int, chunk: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        """The rows of the groups at the places from ``start`` to before ``stop``, which lie in one chunk."""
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        system, inner = fs.FileSystem.from_uri(f"{self.path}/of={epoch}/chunk={chunk}")
        files = [f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.path.endswith(".parquet")]
        found = [pq.read_table(f, filesystem=system, partitioning=None, coerce_int96_timestamp_unit="us") for f in files]
        rows = pa.concat_tables(found).sort_by("place") if found else pa.table({"place": pa.array([], pa.int64())})
        asked = (rows["place"].to_numpy() >= start) & (rows["place"].to_numpy() < stop)
        rows = rows.filter(pa.array(asked))
        if rows["place"].to_pylist() != list(range(start, stop)):
            raise ContractError(f"the schedule lacks places from {start} to {stop} of epoch {epoch}")
        names = [f.name for f in kinds if f.name not in PLACE.names]
        for part in rows.combine_chunks().to_batches():
            lists = {n: part.column(f"c{i}") for i, n in enumerate(names)}
            counts = np.diff(next(iter(lists.values())).offsets.to_numpy())
            of, ends = np.repeat(np.arange(part.num_rows), counts), np.cumsum(counts)
            inside = np.arange(len(of)) - (ends - counts)[of]
            place = part.column("place").to_numpy()[of]
            made = {
                "epoch": np.full(len(of), epoch), "place": place, "group_id": part.column("group_id").take(pa.array(of)),
                "row_id": part.column("first_row").to_numpy()[of] + inside, "closing": (place == self.groups - 1) & (inside == counts[of] - 1),
            }
            made = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()} | {n: x.flatten() for n, x in lists.items()}
            yield from pa.Table.from_arrays([made[f.name].cast(f.type) for f in kinds], schema=kinds).to_batches(BATCH_ROWS)


class GroupEpochs(D.DataSource):
    """The streaming format ``group_epochs``."""

    @classmethod
    def name(cls) -> str:
        return "group_epochs"

    def streamReader(self, schema: T.StructType) -> _GroupReader:
        return _GroupReader(self.options, schema)


def read_epochs(spark: SparkSession, path: str, schedule: Schedule, columns: Sequence[str], groups_a_batch: int, tasks: int = 8) -> DataFrame:
    """The stream of the scheduled groups' rows: ``epoch, place, group_id, row_id, closing`` and ``columns``.

    A group's rows follow each other in one task. A batch has ``groups_a_batch`` groups, fewer at an epoch's end. The first
    call for some columns lays out their values in the schedule's order; later ones, as of runs that go on, find them.
    """
    if schedule.groups == 0:
        raise ContractError("no training group")
    spark.dataSource.register(GroupEpochs)
    own = _trimmed(spark.read.option("recursiveFileLookup", "true").parquet(path).schema)
    schema = T.StructType([*PLACE, *[own[c] for c in columns]])
    laid = f"{schedule.path}-rows-{hashlib.sha256(json.dumps([path, *columns]).encode()).hexdigest()[:16]}"
    if not exists(spark, f"{laid}/_SUCCESS"):
        _lay_out(spark, schedule, schema, laid)
    options = {"rows": laid, "groups": schedule.groups, "epochs": schedule.epochs, "batch": groups_a_batch, "tasks": tasks}
    return spark.readStream.format("group_epochs").schema(schema).options(**{k: str(v) for k, v in options.items()}).load()


def cut_windows(rows: DataFrame, label: str, features: Sequence[str], length: int, stride: int) -> DataFrame:
    """``epoch, group_id, first_row, target, features, closing`` of the full windows of each group, as its rows pass.

    ``features`` holds the window's values row by row. A row that has nothing but ``epoch`` and ``closing`` ends an epoch.
    """
    schema = T.StructType([
        T.StructField("epoch", T.IntegerType()), T.StructField("group_id", T.StringType()), T.StructField("first_row", T.LongType()),
        T.StructField("target", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("closing", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def bounds(rows: pa.Table) -> np.ndarray:
            """Where groups begin, and the end."""
            ids = rows["group_id"].combine_chunks()
            new = pc.not_equal(ids.slice(1), ids.slice(0, max(0, len(ids) - 1))).to_numpy(zero_copy_only=False).astype(bool)
            return np.concatenate([[0], np.flatnonzero(new) + 1, [len(ids)]])

        def cut(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The windows of whole groups, which lie between ``at``."""
            sizes = np.diff(at)
            n = np.maximum(0, (sizes - length) // stride + 1)
            of = np.repeat(np.arange(len(n)), n)
            first = at[:-1][of] + (np.arange(len(of)) - (np.cumsum(n) - n)[of]) * stride
            values = np.stack([rows[f].to_numpy().astype(float) for f in features], axis=1)
            steps = values[first[:, None] + np.arange(length)].ravel() if len(first) else np.empty(0)
            ends = pa.array(np.arange(len(first) + 1) * (length * len(features)), pa.int32())
            ids = rows.take(pa.array(first))
            made = [ids["epoch"], ids["group_id"], ids["row_id"], rows[label].take(pa.array(first + length - 1)), pa.ListArray.from_arrays(ends, pa.array(steps)), pa.array(np.zeros(len(first), bool))]
            yield from pa.Table.from_arrays([x.cast(k.type) for x, k in zip(made, kinds, strict=True)], schema=kinds).to_batches(10_000)
            if closing := sorted(set(rows.filter(rows["closing"])["epoch"].to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip([closing, *[[None] * len(closing)] * 4, [True] * len(closing)], kinds, strict=True)], schema=kinds)

        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
                at = bounds(held)
                if len(at) > 2:
                    yield from cut(held.slice(0, at[-2]), at[:-1])
                    held = held.slice(at[-2])
        if held is not None:
            yield from cut(held, bounds(held))

    return rows.mapInArrow(run, schema)


class ShuffleBuffer(StatefulProcessor):
    """Holds at most ``capacity`` windows of a buffer; lets out the rest by their hashes, and all at an epoch's end."""

    HELD = "h long, epoch int, group_id string, first_row long, target string, features array<double>"

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.HELD)
        self.counts = handle.getValueState("counts", "taken_in long, let_out long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.HELD.split(", ")]
        held = [tuple(r) for r in self.held.get()]
        taken_in, let_out = self.counts.get() if self.counts.exists() else (0, 0)
        closing = False
        for part in rows:
            closing |= bool(part["closing"].any())
            own = part[~part["closing"].astype(bool)]
            taken_in += len(own)
            held += [(int(h), int(e), g, int(f), t, list(map(float, x))) for h, e, g, f, t, x in zip(*[own[n] for n in names], strict=True)]
        held.sort(key=lambda r: r[:4])
        leave = len(held) if closing else max(0, len(held) - self.capacity)
        out, kept = held[:leave], held[leave:]
        let_out += len(out)
        if taken_in != let_out + len(kept):
            raise ContractError(f"buffer {key[0]} took in {taken_in} windows and let out {let_out}, {len(kept)} are held")
        if kept:
            self.held.put(kept)
        else:
            self.held.clear()
        self.counts.update((taken_in, let_out))
        yield pd.DataFrame([(int(key[0]), i, *r[1:], len(kept)) for i, r in enumerate(out)], columns=["buffer", "turn", *names[1:], "n_held"])

    def close(self) -> None:
        pass


def buffered(windows: DataFrame, seed: int, capacity: int = CAPACITY, buffers: int = BUFFERS) -> DataFrame:
    """The windows in a seeded order: ``buffer, turn, epoch, group_id, first_row, target, features, n_held``.

    Each of the ``buffers`` holds ``capacity / buffers`` windows at most (``n_held`` after the batch); ``turn`` is the
    order in which a buffer lets them out in a batch. At an epoch's end nothing is held.
    """
    number = F.xxhash64(F.lit(seed), "epoch", "group_id", "first_row")
    every = F.array(*[F.lit(b).cast("long") for b in range(buffers)])
    own = F.array(F.pmod(F.xxhash64(F.lit(seed + 1), "group_id", "first_row"), F.lit(buffers)).cast("long"))
    dealt = windows.withColumns({"h": number, "buffer": F.explode(F.when(F.col("closing"), every).otherwise(own))})
    schema = f"buffer long, turn long, {ShuffleBuffer.HELD.removeprefix('h long, ')}, n_held long"
    return dealt.groupBy("buffer").transformWithStateInPandas(ShuffleBuffer(max(1, capacity // buffers)), schema, "append", "none")


def run_epochs(stream: DataFrame, schedule: Schedule, target: str, checkpoint: str, seconds: float | None = None, batches: int | None = None, make=lambda rows: rows) -> bool:
    """Runs the stream to the end of its last epoch, or for ``seconds``, or until it has gone on by ``batches`` at least.

    Batches go to folders of ``target``. True at the end.

    What is not committed is read again by the next run with the same checkpoint, whose batches are those of a run that
    was never stopped. Windows that are held then stay in the state.
    """
    spark = stream.sparkSession
    own = {PROVIDER: ROCKS, PARTS: str(min(BUFFERS, int(spark.conf.get(PARTS))))}  # more would hold no buffer
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)  # read when the query starts
    try:
        query = stream.writeStream.foreachBatch(lambda batch, n: write_observed(batch, f"{target}/batch={n}", make)).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return _to_the_end(query, {"epoch": schedule.epochs, "place": schedule.groups}, seconds, batches)


def _to_the_end(query: StreamingQuery, last: dict, seconds: float | None, batches: int | None) -> bool:
    began, done, first, now = time.monotonic(), False, None, None
    while not done and (seconds is None or time.monotonic() - began < seconds) and (batches is None or now is None or now - first < batches - 1):
        if query.awaitTermination(0.2):
            break
        if progress := query.lastProgress:
            now = progress["batchId"]
            first = now if first is None else first
            done = _offset(progress["sources"][0]["endOffset"]) == last
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return done


def _offset(shown) -> dict[str, int]:
    """An offset as a progress report shows it."""
    return {name: int(value) for name, value in re.findall(r"(epoch|place)\W+(\d+)", str(shown))}
