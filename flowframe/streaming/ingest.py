"""Bounded, resumable ingestion with Structured Streaming: whole files, stateless splits, conservation of rows."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowframe.functions.hashing import stream_split
from flowframe.operators.groups import with_groups
from flowframe.operators.preprocess import Fitted, require_known, transform, unknown_label
from flowframe.operators.windows import windows, with_runs
from flowframe.sources.flows import ContractError, config_hash, read_json, table_digest
from flowframe.sources.staging import create, new_folder, remove


def finished(query: StreamingQuery, seconds: float | None) -> bool:
    """Waits for the end, or stops the query after ``seconds``; what is not committed then is read by the next run."""
    done = query.awaitTermination(seconds) if seconds is not None else query.awaitTermination() or True
    if not done:
        query.stop()
    return bool(done)


def write_observed(batch: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows, by: Sequence[str] = ()) -> int:
    """Writes what ``make`` does with a batch to ``folder``, replacing it; rows that got lost or came up on the way are an error.

    Both ends are counted while the rows pass, so the batch is read once. Returns the number of rows.
    """
    came, went = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    out = make(batch.observe(came, count)).observe(went, count)
    out.write.mode("overwrite").partitionBy(*by).parquet(folder)
    before, after = came.get.get("n", 0), went.get.get("n", 0)
    if before != after:
        remove(batch.sparkSession, folder)
        raise ContractError(f"{before} rows came and {after} went to {folder}")
    return after


def ingest(flows: DataFrame, target: str, checkpoint: str, seed: int, outer: float, seconds: float | None = None) -> bool:
    """Reads what is new, gives every row its group and split, and writes it by batch and split; then stops. True if all is read.

    Started again with the same checkpoint it goes on where it stopped, at the latest after ``seconds``. A group's split
    is drawn from its id, so no state passes between batches. A batch that loses a row fails and is not committed; one
    that is tried again replaces its folder.
    """
    def make(rows: DataFrame) -> DataFrame:
        return with_groups(rows).withColumn("split", stream_split(F.col("group_id"), outer, seed))

    query = flows.writeStream.foreachBatch(lambda batch, n: write_observed(batch, f"{target}/batch={n}", make, ["split"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return finished(query, seconds)


def whole_files(batch: DataFrame, number: int, folder: str) -> None:
    """Fails where a file of this batch has rows in another one, since its groups would be torn. ``folder`` has a row a file."""
    spark = batch.sparkSession
    batch.select("file_id").distinct().write.mode("overwrite").parquet(f"{folder}/batch={number}")
    seen = spark.read.parquet(folder)
    own = seen.where(F.col("batch") == number).select("file_id")
    torn = seen.where(F.col("batch") != number).join(own, "file_id").select("file_id").first()
    if torn:
        raise ContractError(f"file {torn['file_id']} lies in more than one batch, so groups would be torn")


def ingest_windows(flows: DataFrame, fitted: Fitted, target: str, checkpoint: str, seed: int, outer: float, length: int, stride: int, seconds: float | None = None) -> bool:
    """The stream as scaled, encoded windows by split: every batch is transformed with what the fit learned, nothing else.

    Training rows that the fitted forest calls outliers are left out before windows are cut. Flows need group_id's parts, label, and the fitted features. A label outside the fitted vocabulary stops the run.
    Batches must hold whole files, so that windows need no state: a file in two batches stops the run. A batch that is
    tried again replaces its own folder.
    """
    names = F.array(*[F.lit(x) for x in fitted.labels])

    def write(batch: DataFrame, number: int) -> None:
        whole_files(batch, number, f"{checkpoint.rstrip('/')}-files")
        require_known(batch, "label", fitted.labels)
        rows = with_groups(batch).withColumn("split", stream_split(F.col("group_id"), outer, seed))
        code = F.array_position(names, F.col("label")) - 1
        coded = transform(rows, fitted).withColumn("code", F.when(code >= 0, code).otherwise(unknown_label(F.col("label"))))
        columns = {c: F.col(c) for c in ("sample_id", "split", "code", *fitted.features)}
        made = windows(with_runs(coded), columns, length, stride)
        made.withColumn("split", F.col("steps")[0]["split"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return finished(flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), seconds)


def guard_contract(spark: SparkSession, folder: str, contract: dict, table: DataFrame | None = None) -> None:
    """Refuses to go on with a run whose settings, or whose ``table`` by its digest, differ from those it began with.

    The first run makes the contract, and of several first runs one.
    """
    if table is not None:
        contract = contract | {"table": table_digest(table)}
    place, now = f"{folder}/contract.json", config_hash(contract)
    if create(spark, place, json.dumps({"hash": now})):
        return
    if read_json(spark, place)["hash"] != now:
        raise ValueError("the run was begun with other settings or on other rows")


def conserved(source: DataFrame, target: DataFrame) -> DataFrame:
    """``n_source, n_target, conserved``."""
    both = source.agg(F.count("*").alias("n_source")).crossJoin(target.agg(F.count("*").alias("n_target")))  # one row each
    return both.withColumn("conserved", F.col("n_source") == F.col("n_target"))


def stream_flows(spark: SparkSession, sf_dir: str, files: int = 4, size: int | None = None) -> DataFrame:
    """The event table as a stream of files, with the identity columns of a flow table.

    A batch holds ``files`` files at most, or if ``size`` is given files of about so many bytes.
    """
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).schema
    bound = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", files)
    e = spark.readStream.schema(schema).option(*bound).option("pathGlobFilter", "*.parquet").parquet(os.path.join(sf_dir, "events.parquet*"))
    return e.select(F.concat(F.lit("day="), F.date_format("ts", "yyyy-MM-dd")).alias("file_id"), F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "value", "user_id")


def stream_split_counts(spark: SparkSession, sf_dir: str, seed: int, outer: float) -> DataFrame:
    """Ingests the event table and counts its rows by split and label, which a batch count must equal."""
    folder = new_folder(spark, "stream")
    guard_contract(spark, folder, {"seed": seed, "outer": outer})
    ingest(stream_flows(spark, sf_dir), f"{folder}/rows", f"{folder}/progress", seed, outer)
    return spark.read.parquet(f"{folder}/rows").groupBy("split", "label").agg(F.count("*").alias("n"))
