"""Helpers of the text operators: staged tables, Arrow mapping by column, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.sources.staging import staged

#: Bytes of text handed to a Python function at once.
BATCH_BYTES = 4 << 20
#: Rows with texts that a Python function gets at once where its table is staged.
TEXT_ROWS = 1200
#: Entries that a worker's cache of words holds at most; beyond it words are computed again.
CACHE_WORDS = 200_000
#: Characters beyond which a text's words are not held at once, and words then held.
LONG_CHARS, PIECE = 4 << 20, 200_000

#: What tells rows apart where ids may be null or repeat.
ROW = ["file", "row"]


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and ``carry`` as ``carried`` if named, whatever other columns ``docs`` has."""
    more = [docs[carry].alias("carried")] if carry else []
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *more)


def with_rows(docs: DataFrame, in_files: bool, name: str | None = None) -> DataFrame:
    """``docs`` with the longs ``file`` and ``row``, or a struct of them called ``name``, the same at each reading.

    ``in_files`` says that ``docs`` reads Parquet files with nothing but projections and filters on top: then they are
    a hash of the file's path and the place in the file, which do not depend on how the files are split into tasks.
    Any other table is numbered and written once to the shared folder, and read from there.
    """
    if in_files and "_metadata" not in docs.columns:
        file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
        return docs.withColumn(name, F.struct(file.alias("file"), row.alias("row"))) if name else docs.withColumns({"file": file, "row": row})
    number = F.monotonically_increasing_id()
    if name:
        return staged(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), number.alias("row"))), "rows", TEXT_ROWS)
    return staged(docs.withColumns({"file": F.lit(0).cast("long"), "row": number}), "rows", TEXT_ROWS)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8"))


def by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose strings in ``column`` hold about BATCH_BYTES; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes.astype(np.int64)) // BATCH_BYTES
    start = 0
    for end in [*(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


#: Cached functions whose values a worker keeps from task to task, by the module that uses them.
KEPT: dict[str, Callable] = {}


def free_others(module: str) -> None:
    """Frees what tasks of other operators have left in this worker process, and gives the memory back."""
    left = [f for name, f in KEPT.items() if name != module and f.cache_info().currsize]
    for f in left:
        f.cache_clear()
    if left:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
            ctypes.CDLL(None).malloc_trim(0)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], Iterable]]) -> DataFrame:
    """``df`` with columns computed from its text column, batch by batch.

    ``make()`` runs once a task and returns a function from a list of texts (no nulls) to one list or Arrow array
    per new field.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text_col)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        free_others(make.__module__)
        function, kinds = make(), [to_arrow_type(f.dataType) for f in fields]
        for whole in batches:
            for batch in by_bytes(whole, at):
                texts = [x or "" for x in batch.column(at).to_pylist()]
                new = [pa.array(x, kind) for x, kind in zip(function(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], size_col: str) -> DataFrame:
    """Rows of ``schema`` made from slices of ``df``; the function returns a list or array for each field."""
    at = df.columns.index(size_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        function, kinds = make(), to_arrow_schema(schema)
        for whole in batches:
            for batch in by_bytes(whole, at):
                made = function(batch)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def matches(pattern, text: str) -> Iterator[list[str]]:
    """All matches of a pattern without groups, in one list, or in lists of PIECE where the text is very long."""
    if len(text) <= LONG_CHARS:
        yield pattern.findall(text)
        return
    found = (m[0] for m in pattern.finditer(text))
    while some := list(islice(found, PIECE)):
        yield some


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen first."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    total = np.zeros(len(words) - n + 1, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * np.uint64(factor)
        factor = (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1
    return mixed(total)
