"""Parquet by row groups: footers tell where rows are, and only the row groups asked for are read.

Two ways lead there. A plan (a DataFrame of row groups and slices of them, as large as it likes) is dealt over tasks,
which open each row group once. ``spark.read.format("row_groups")`` plans a partition for each row group on the
driver and leaves out those that its options rule out: by file, by row group, by place in the file, and by the footers'
least and greatest values of a column. The options do what pushed filters would: Spark 4.1 keeps the reader of a Python
source with the filters of the table's first query, and gives later queries of that table its rows. Files have to be in
a file system that pyarrow opens by URI.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.sources.flows import ContractError

#: Rows that are held at once while a row group is read.
BATCH_ROWS = 65_536
#: Columns that the reader adds: the file, the row group in it, and the row's place in the file.
PLACE = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("row_group", T.LongType()), T.StructField("row_id", T.LongType())])

_FOOTER = "path string, row_group long, start long, n_rows long, columns string"


def _opened(name: str):
    """The Parquet file at a URI or local path, and what closes it."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(name) if ":" in name else (fs.LocalFileSystem(), name)
    file = system.open_input_file(inner)
    return pq.ParquetFile(file), file


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``path, row_group, start, n_rows, columns`` of every row group below ``path``.

    Files are listed without their contents, and tasks read the footers; ``start`` is the row group's first row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                found, file = _opened(name)
                with file:
                    shape, start = ", ".join(f"{f.name.strip()} {f.type}" for f in found.schema_arrow), 0
                    for g in range(found.metadata.num_row_groups):
                        n = found.metadata.row_group(g).num_rows
                        rows.append((name, g, start, n, shape))
                        start += n
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "row_group", "start", "n_rows", "columns"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("path")).mapInArrow(run, _FOOTER)


def _below(path: Column, root: str) -> Column:
    """The part of a file's URI below ``root``; its name where it is ``root`` itself."""
    bare = re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?", "", root.rstrip("/"))
    at = F.instr(path, bare + "/")
    name = F.when(path.endswith(bare), F.element_at(F.split(path, "/"), -1)).otherwise(path)
    return F.when(at > 0, path.substr(at + len(bare) + 1, F.length(path))).otherwise(name)


def file_row_groups(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, row_group, start, n_rows, path`` of the row groups that have rows; files with different columns are an error.

    ``file_id`` is the file's place below ``path``, so that ids drawn from it do not depend on where the table lies.
    """
    found = footers(spark, path)
    if found.select("columns").distinct().count() > 1:
        raise ContractError("files differ in their columns")
    return found.select(_below(F.col("path"), path).alias("file_id"), "row_group", "start", "n_rows", "path").where("n_rows > 0")


def _trimmed(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name.strip(), f.dataType, True, f.metadata) for f in schema])


def read_slices(spark: SparkSession, path: str, plan: DataFrame, columns: Sequence[str] | None = None, rows_read: Accumulator | None = None) -> DataFrame:
    """The rows of planned slices: ``file_id, row_group, row_id, inside``, the plan's further columns, and ``columns``.

    ``plan`` has file_id, row_group, start and path as ``file_row_groups`` tells them, and ``first`` and ``take`` (without them
    whole row groups). ``inside`` is the place in the row group. A row group is opened once, its batches are cut into the
    slices that they meet, and reading stops behind the last slice; a row in several slices comes once for each. Column
    names are trimmed. ``rows_read`` counts the rows that were decoded.
    """
    whole = _trimmed(spark.read.option("recursiveFileLookup", "true").parquet(path).schema)
    wanted = [f for f in whole if columns is None or f.name in columns]
    if "take" not in plan.columns:
        plan = plan.withColumns({"first": F.lit(0).cast("long"), "take": F.lit(1 << 62)})
    fixed = {"file_id", "row_group", "start", "first", "take", "row_id", "inside"}
    more = [f for f in plan.schema if f.name not in fixed]
    taken = fixed | {f.name for f in more}
    wanted = [f for f in wanted if f.name not in taken]
    schema = T.StructType([*PLACE, T.StructField("inside", T.LongType()), *more, *wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def group(slices: list[dict]) -> Iterator[pa.RecordBatch]:
            one = slices[0]
            found, file = _opened(one["path"])
            with file:
                names = {n.strip(): n for n in found.schema_arrow.names}
                last, at = max(s["first"] + s["take"] for s in slices), 0
                for batch in found.iter_batches(BATCH_ROWS, [one["row_group"]], [names[f.name] for f in wanted]):
                    if rows_read is not None:
                        rows_read.add(batch.num_rows)
                    for s in slices:
                        a, b = max(s["first"], at) - at, min(s["first"] + s["take"], at + batch.num_rows) - at
                        if a < b:
                            part, place = batch.slice(a, b - a), pa.array(range(at + a, at + b), pa.int64())
                            given = {"file_id": [one["file_id"]] * (b - a), "row_group": [one["row_group"]] * (b - a), "inside": place}
                            given["row_id"] = pa.array(range(one["start"] + at + a, one["start"] + at + b), pa.int64())
                            given |= {f.name: [s[f.name]] * (b - a) for f in more}
                            given |= {f.name: part.column(names[f.name]).cast(kinds.field(f.name).type) for f in wanted}
                            yield pa.RecordBatch.from_arrays([given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name], f.type) for f in kinds], schema=kinds)
                    at += batch.num_rows
                    if at >= last:
                        break

        now: list[dict] = []
        for batch in batches:
            for s in batch.to_pylist():
                if now and (s["file_id"], s["row_group"]) != (now[0]["file_id"], now[0]["row_group"]):
                    yield from group(now)
                    now = []
                now.append(s)
        if now:
            yield from group(now)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plan.repartition(parts, "file_id", "row_group").sortWithinPartitions("file_id", "row_group", "first")
    return dealt.mapInArrow(run, schema)


@dataclass
class _Group(D.InputPartition):
    file: str
    row_group: int
    start: int


@dataclass
class _Reader(D.DataSourceReader):
    """The row groups of the files below a path that may hold rows between bounds."""

    path: str
    schema: T.StructType
    files: list[str] | None
    row_groups: list[int] | None
    between: dict[str, list]

    def partitions(self) -> list[_Group]:
        names = [n for n in _listed(self.path) if self.files is None or n.endswith(tuple(self.files))]
        with ThreadPoolExecutor(16) as pool:
            return [g for found in pool.map(self._groups, names) for g in found]

    def _groups(self, name: str) -> list[_Group]:
        found, file = _opened(name)
        with file:
            out, start, names = [], 0, [n.strip() for n in found.schema_arrow.names]
            flat = len(names) == found.metadata.num_columns  # else columns of footers are parts of nested ones
            for g in range(found.metadata.num_row_groups):
                of = found.metadata.row_group(g)
                bounds = {"row_id": (start, start + of.num_rows - 1)}
                for i, n in enumerate(names if flat else ()):
                    stats = of.column(i).statistics
                    if stats is not None and stats.has_min_max and n not in bounds:
                        bounds[n] = (stats.min, stats.max)
                wanted = self.row_groups is None or g in self.row_groups
                if of.num_rows and wanted and all(_meet(bounds[c], asked) for c, asked in self.between.items() if c in bounds):
                    out.append(_Group(name, g, start))
                start += of.num_rows
            return out

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        found, file = _opened(partition.file)
        with file:
            names, at = {n.strip(): n for n in found.schema_arrow.names}, partition.start
            wanted = [f.name for f in kinds if f.name not in PLACE.names]
            for batch in found.iter_batches(BATCH_ROWS, [partition.row_group], [names[n] for n in wanted]):
                n = batch.num_rows
                given = {"file_id": pa.array([partition.file] * n), "row_group": pa.array([partition.row_group] * n, pa.int64()), "row_id": pa.array(range(at, at + n), pa.int64())}
                given |= {w: batch.column(names[w]).cast(kinds.field(w).type) for w in wanted}
                yield pa.RecordBatch.from_arrays([given[f.name] for f in kinds], schema=kinds)
                at += n


def _meet(has: tuple, asked: Sequence) -> bool:
    """Whether values from and to the one pair's can lie in the other's, where null is no bound; what does not compare might."""
    try:
        return (asked[0] is None or has[1] >= asked[0]) and (asked[1] is None or has[0] <= asked[1])
    except TypeError:
        return True


def _listed(path: str) -> list[str]:
    """URIs of the files below ``path``, hidden ones left out."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(inner)] if ":" in path else "file://"
    found = system.get_file_info(inner)
    every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = [f.path for f in every if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(inner) :].split("/") if p)]
    return sorted(prefix + p for p in shown)


class RowGroupSource(D.DataSource):
    """``spark.read.format("row_groups").load(path)``: ``file_id, row_group, row_id`` and the files' columns.

    A schema given to the reader says which columns are read. The options ``files`` (ends of their names), ``row_groups``
    and ``between`` (column: least and greatest value, or null) are JSON; ``between`` leaves out row groups, not rows.
    """

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        names = _listed(self.options["path"])
        if not names:
            raise ContractError(f"no file below {self.options['path']}")
        found, file = _opened(names[0])
        with file:
            own = _trimmed(from_arrow_schema(found.schema_arrow))
        return T.StructType([*PLACE, *[f for f in own if f.name not in PLACE.names]])

    def reader(self, schema: T.StructType) -> _Reader:
        given = {k: json.loads(self.options[k]) if k in self.options else None for k in ("files", "row_groups", "between")}
        return _Reader(self.options["path"], schema, given["files"], given["row_groups"], given["between"] or {})


def read_row_groups(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, files: Sequence[str] | None = None,
    row_groups: Sequence[int] | None = None, between: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Rows of chosen files and row groups whose columns lie between bounds (both inclusive); ``columns`` are read.

    Row groups that cannot hold such a row are not opened. Nulls lie between no bounds.
    """
    spark.dataSource.register(RowGroupSource)
    given = {"files": files, "row_groups": row_groups, "between": between}
    reader = spark.read.format("row_groups").options(**{k: json.dumps(v) for k, v in given.items() if v is not None})
    if columns is not None:
        own = _trimmed(spark.read.option("recursiveFileLookup", "true").parquet(path).schema)
        needed = {*columns, *(between or {})}
        reader = reader.schema(T.StructType([*PLACE, *[f for f in own if f.name in needed and f.name not in PLACE.names]]))
    rows = reader.load(path)
    for c, (low, high) in (between or {}).items():
        if low is not None:
            rows = rows.where(F.col(c) >= low)
        if high is not None:
            rows = rows.where(F.col(c) <= high)
    return rows if columns is None else rows.select(*PLACE.names, *columns)
