"""Tables as shards of packed arrays with pointers, as numeric code reads them: a data source that writes and reads them.

A task packs its rows: numbers and truth values as one array a column, strings and lists as one flat array with a
pointer array of one more entry than rows. The commit writes the manifest, which gives each shard the number of its first
row and the place of its first value in each flat column, so local pointers become pointers into the whole by adding a
base. Without the manifest there is no table; an abort removes the shards.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from flowframe.sources.flows import ContractError

MANIFEST = "manifest.json"
#: Rows of a shard at most, and bytes that its rows take before they are packed, about; a task begins another one then.
SHARD_ROWS, SHARD_BYTES = 100_000, 16 << 20

_NUMBERS = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8", "boolean": "?"}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _kind(field: T.StructField) -> tuple[str, str | None]:
    """How a column is packed (number, string, list of numbers, list of strings) and its numbers' type."""
    name = field.dataType.simpleString()
    if name in _NUMBERS:
        return "number", _NUMBERS[name]
    if name == "string":
        return "string", None
    if name.startswith("array<") and name[6:-1] in _NUMBERS:
        return "list", _NUMBERS[name[6:-1]]
    if name == "array<string>":
        return "strings", None
    raise ContractError(f"column {field.name}: {name} cannot be packed")


def _flat_strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and where each begins, and the end; no string is made on the way."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]].copy(), at - at[0]


def pack(table: pa.Table, schema: T.StructType) -> dict[str, np.ndarray]:
    """The arrays of a table: ``name``, for flat columns ``name.ptr``, and for lists of strings ``name.text_ptr``. Nulls are an error."""
    out: dict[str, np.ndarray] = {}
    for field in schema:
        column = table.column(field.name).combine_chunks()
        kind, number = _kind(field)
        if column.null_count or kind in ("list", "strings") and column.flatten().null_count:
            raise ContractError(f"column {field.name} has nulls")
        if kind == "number":
            out[field.name] = np.asarray(column.to_numpy(zero_copy_only=False), number)
        elif kind == "string":
            out[field.name], out[f"{field.name}.ptr"] = _flat_strings(column)
        else:
            sizes = np.diff(column.offsets.to_numpy())
            out[f"{field.name}.ptr"] = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            if kind == "list":
                out[field.name] = np.asarray(column.flatten().to_numpy(zero_copy_only=False), number)
            else:
                out[field.name], out[f"{field.name}.text_ptr"] = _flat_strings(column.flatten())
    return out


def _strings(data: np.ndarray, pointers: np.ndarray) -> pa.Array:
    low, high = int(pointers[0]), int(pointers[-1])
    offsets = np.ascontiguousarray(pointers - low, np.int64)
    return pa.LargeStringArray.from_buffers(len(pointers) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[low:high])))


def unpack(arrays: dict[str, np.ndarray], schema: T.StructType, start: int = 0, stop: int | None = None) -> pa.Table:
    """Rows from ``start`` to ``stop`` again, cut out of the arrays by their pointers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, kinds = [], to_arrow_schema(schema)
    for field, arrow in zip(schema, kinds, strict=True):
        kind, _ = _kind(field)
        if kind == "number":
            columns.append(pa.array(arrays[field.name][start:stop], arrow.type))
            continue
        pointers = arrays[f"{field.name}.ptr"][start : None if stop is None else stop + 1]
        if kind == "string":
            columns.append(_strings(arrays[field.name], pointers).cast(arrow.type))
            continue
        low, high = int(pointers[0]), int(pointers[-1])
        flat = pa.array(arrays[field.name][low:high], arrow.type.value_type) if kind == "list" else _strings(arrays[field.name], arrays[f"{field.name}.text_ptr"][low : high + 1]).cast(arrow.type.value_type)
        columns.append(pa.ListArray.from_arrays(pa.array(pointers - low, pa.int32()), flat).cast(arrow.type))
    return pa.Table.from_arrays(columns, schema=kinds)


@dataclass
class _Shards(D.WriterCommitMessage):
    shards: list[dict]


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, rows: int):
        self.path, self.schema, self.rows = path, schema, rows
        for field in schema:
            _kind(field)
        system, inner = _system(path)
        if overwrite:
            for name in [MANIFEST, *[s["file"] for s in _manifest(path)["shards"]]] if _exists(path) else []:
                system.delete_file(f"{inner}/{name}")
        elif _exists(path):
            raise ContractError(f"{path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Shards:
        from pyspark import TaskContext

        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        task, made, held = TaskContext.get().partitionId(), [], []

        def shard() -> None:
            arrays = pack(pa.Table.from_batches(held), self.schema)
            data, name = io.BytesIO(), f"shard-{task:06d}-{len(made):04d}-{uuid.uuid4().hex}.npz"
            np.savez_compressed(data, **arrays)
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(data.getvalue())
            made.append({"file": name, "task": task, "rows": sum(b.num_rows for b in held), "values": {k: len(v) for k, v in arrays.items() if not k.endswith("ptr")}})
            held.clear()

        try:
            for batch in iterator:
                step = max(1, min(self.rows, batch.num_rows * SHARD_BYTES // max(1, batch.nbytes)))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    if held and (sum(b.num_rows for b in held) + part.num_rows > self.rows or sum(b.nbytes for b in held) + part.nbytes > SHARD_BYTES):
                        shard()
                    held.append(part)
            if held:
                shard()
        except BaseException:
            _drop(self.path, made)
            raise
        return _Shards(made)

    def commit(self, messages: list[_Shards | None]) -> None:
        shards, row, values = [], 0, {}
        for s in sorted((s for m in messages if m for s in m.shards), key=lambda s: s["file"]):
            shards.append({"file": s["file"], "rows": s["rows"], "base_row": row, "base": {k: values.get(k, 0) for k in s["values"]}})
            row += s["rows"]
            values = {k: values.get(k, 0) + n for k, n in s["values"].items()}
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{MANIFEST}") as out:
            out.write(json.dumps({"schema": self.schema.jsonValue(), "rows": row, "values": values, "shards": shards}).encode())

    def abort(self, messages: list[_Shards | None]) -> None:
        for m in messages:
            if m:
                _drop(self.path, m.shards)


def _drop(path: str, shards: list[dict]) -> None:
    system, inner = _system(path)
    for s in shards:
        system.delete_file(f"{inner}/{s['file']}")


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = _system(path)
    return system.get_file_info(f"{inner}/{MANIFEST}").type == fs.FileType.File


def _manifest(path: str) -> dict:
    if not _exists(path):
        raise ContractError(f"no manifest below {path}")
    system, inner = _system(path)
    with system.open_input_stream(f"{inner}/{MANIFEST}") as file:
        return json.loads(file.read())


def _arrays(path: str, shard: dict) -> dict[str, np.ndarray]:
    system, inner = _system(path)
    with system.open_input_file(f"{inner}/{shard['file']}") as file, np.load(io.BytesIO(file.read()), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


@dataclass
class _Shard(D.InputPartition):
    shard: dict


class _Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_Shard]:
        return [_Shard(s) for s in _manifest(self.path)["shards"]] or [_Shard({})]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        if partition.shard:
            rows = unpack(_arrays(self.path, partition.shard), T.StructType([f for f in self.schema if f.name != "row"]))
            first = partition.shard["base_row"]
            number = pa.array(range(first, first + partition.shard["rows"]), pa.int64())
            yield from rows.add_column(0, "row", number).to_batches(10_000)


class PackedArrays(D.DataSource):
    """The format ``packed``: ``row``, the number in the whole table, and the columns that were written."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> T.StructType:
        own = T.StructType.fromJson(_manifest(self.options["path"])["schema"])
        return T.StructType([T.StructField("row", T.LongType()), *own])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("shardRows", SHARD_ROWS)))


def write_packed(df: DataFrame, path: str, overwrite: bool = False, shard_rows: int = SHARD_ROWS) -> None:
    """Writes numbers, strings, and lists of either; columns with nulls and others are an error. No column is called ``row``."""
    if "row" in df.columns:
        raise ContractError("row is the number that reading adds")
    df.sparkSession.dataSource.register(PackedArrays)
    df.write.format("packed").mode("overwrite" if overwrite else "append").option("shardRows", str(shard_rows)).save(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PackedArrays)
    return spark.read.format("packed").load(path)


def rows_at(path: str, start: int, stop: int) -> pa.Table:
    """Rows ``start`` to ``stop`` of a packed table by their numbers, from the shards that hold them."""
    manifest = _manifest(path)
    schema, parts = T.StructType.fromJson(manifest["schema"]), []
    for s in manifest["shards"]:
        a, b = max(start, s["base_row"]) - s["base_row"], min(stop, s["base_row"] + s["rows"]) - s["base_row"]
        if a < b:
            parts.append(unpack(_arrays(path, s), schema, a, b))
    return pa.concat_tables(parts) if parts else unpack(pack(pa.Table.from_pylist([], schema=_arrow(schema)), schema), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
