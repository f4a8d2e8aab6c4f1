"""Merkle manifest of a table: every row a leaf, a tree a source, one root over all, and a proof for every leaf.

Nodes are hashed in runs of three. The leaves of a tree are numbered in ranges of its order, so that a hot source is
dealt over tasks, and cut into aligned blocks. Going up, each block becomes one node, round by round, until every
tree is one node and the trees' nodes are one. Going down, a block's leaves are met one after the other: a treehash
stack for each level gathers the next run of that level while the present one is used, the stack with the lowest
unfinished node moving first, so that beside the block's digests only a few nodes a level are held. The path above a
block is the same for all its leaves; it comes to the block as a row that sorts before them and is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import with_rows
from flowframe.sources.staging import staged

#: Fixed value: nodes that become one.
RUN = 3
#: Levels of a block, which has RUN ** LEVELS leaves.
LEVELS = 7
#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "struct<left:string,right:string>"


def hashed(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, a null as a dash."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


class Treehash:
    """Gathers the nodes at ``level`` of one run from its leaves, taken one at a time; holds RUN - 1 nodes a level below."""

    def __init__(self, level: int, start: int, stop: int):
        self.level, self.at, self.stop = level, start, stop
        self.nodes: list[list[str]] = [[] for _ in range(level + 1)]

    @property
    def done(self) -> bool:
        return self.at >= self.stop

    @property
    def low(self) -> int:
        """The level of the lowest node that waits for others."""
        return next((k for k in range(self.level) if self.nodes[k]), self.level)

    def push(self, digest: str) -> None:
        nodes, k = self.nodes, 0
        nodes[0].append(digest)
        while k < self.level and len(nodes[k]) == RUN:
            nodes[k + 1].append(hashed(nodes[k]))
            nodes[k] = []
            k += 1

    def close(self) -> list[str]:
        """The nodes at ``level`` once no leaf is to come."""
        for k in range(self.level):
            if self.nodes[k]:
                self.nodes[k + 1].append(hashed(self.nodes[k]))
                self.nodes[k] = []
        return self.nodes[self.level]

    def step(self, leaves: Sequence[str]) -> None:
        self.push(leaves[self.at])
        self.at += 1
        if self.done:
            self.close()

    def run(self, leaves: Sequence[str]) -> list[str]:
        while not self.done:
            self.step(leaves)
        return self.nodes[self.level]

    def held(self) -> int:
        return sum(map(len, self.nodes))


class Traversal:
    """The paths of a block's leaves, one after the other.

    ``late`` counts leaves that a run still lacked when it was needed, ``most`` the nodes held at once.
    """

    def __init__(self, leaves: Sequence[str], height: int):
        self.leaves, self.height, self.late, self.most = leaves, height, 0, 0

    def _stack(self, level: int, start: int) -> Treehash:
        return Treehash(level, start, min(start + RUN ** (level + 1), len(self.leaves)))

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        leaves, height = self.leaves, self.height
        runs = [self._stack(k, 0).run(leaves) for k in range(height)]
        coming = [self._stack(k, RUN ** (k + 1)) for k in range(height)]
        path: list[tuple[str, str]] = [("", "")] * height
        for i in range(len(leaves)):
            if i:
                for _ in range(height):  # a leaf for each level
                    open_ = [s for s in coming if not s.done]
                    if not open_:
                        break
                    min(open_, key=lambda s: (s.low, s.level)).step(leaves)
            for k in range(height):
                if i % RUN**k:
                    break
                if i and i % RUN ** (k + 1) == 0:
                    self.late += coming[k].stop - coming[k].at
                    runs[k] = coming[k].run(leaves)
                    coming[k] = self._stack(k, i + RUN ** (k + 1))
                own = i // RUN**k % RUN
                path[k] = ("".join(runs[k][:own]), "".join(runs[k][own + 1 :]))
            self.most = max(self.most, sum(s.held() for s in coming) + sum(map(len, runs)))
            yield list(path)


def _height(total: int, levels: int) -> int:
    """Levels that a block adds: all of them, or in a tree's only block as many as it takes to one node."""
    if total > RUN**levels:
        return levels
    height, nodes = 0, total
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // RUN)
    return height


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of the batches that lie in one block, with the block; a block's slices follow each other."""
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                yield keys[start], batch.slice(start, end - start)
                start = end


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {RUN**levels}"))


def _block_nodes(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, pos, total, digest`` one round up: a row for each block."""
    def run(batches):
        now, stack, total = None, None, 0

        def node():
            size = 1 if total <= RUN**levels else -(-total // RUN**levels)
            return pa.RecordBatch.from_pylist([{"tree": now[0], "pos": now[1], "total": size, "digest": stack.close()[0]}], schema=kinds)

        for key, part in _by_block(batches):
            if key != now:
                if now is not None:
                    yield node()
                now, total = key, part.column("total")[0].as_py()
                stack = Treehash(_height(total, levels), 0, total)
            for digest in part.column("digest").to_pylist():
                stack.push(digest)
        if now is not None:
            yield node()

    kinds = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])
    wanted = _dealt(_with_block(nodes, levels).select("tree", "block", "pos", "total", "digest"))
    return wanted.mapInArrow(run, "tree string, pos long, total long, digest string")


def _paths(nodes: DataFrame, heads: DataFrame, levels: int, carry: Sequence[str] = ()) -> DataFrame:
    """``nodes`` with ``path``, ``subroot`` and ``root``; ``heads`` has what lies above each ``tree, block``."""
    above = ["upper", "subroot", "root"]
    kept = ["tree", "block", "pos", "total", "digest", *carry]
    rows = _with_block(nodes, levels).select(*kept, *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in above])
    first = heads.withColumn("pos", F.lit(-1).cast("long"))
    first = first.select(*[F.col(c) if c in first.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("path", T.ArrayType(T._parse_datatype_string(STEP))), *[heads.schema[c] for c in above[1:]]])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def block(parts):
            table = pa.Table.from_batches(parts)
            head = {c: table.column(c)[0].as_py() for c in above}
            own = table.slice(1).select(kept)
            upper = [(s["left"], s["right"]) for s in head["upper"]]
            made = Traversal(own.column("digest").to_pylist(), _height(own.column("total")[0].as_py(), levels))
            steps = [path + upper for path in made.paths()]
            flat = [s for path in steps for s in path]
            pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["left", "right"])
            n = len(flat) // len(steps)
            paths = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, n) if n else [0] * (len(steps) + 1), pa.int32()), pairs)
            ends = [pa.array([head[c]] * len(steps), pa.string()) for c in above[1:]]
            columns = [c.combine_chunks() for c in own.columns]
            return pa.Table.from_arrays([*columns, paths.cast(kinds.field("path").type), *ends], schema=kinds).to_batches()

        now, parts = None, []
        for key, part in _by_block(batches):
            if key != now:
                if parts:
                    yield from block(parts)
                now, parts = key, []
            parts.append(part)
        if parts:
            yield from block(parts)

    return _dealt(rows.unionByName(first)).mapInArrow(run, schema)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the place ``pos`` of each in its ``tree`` and the tree's ``total``, counted in ranges of the order."""
    ordered = with_rows(staged(rows, "leaves"), True)
    keys = ["tree", *order, "file", "row"]
    dealt = staged(ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("file", "row").withColumn("number", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("range", F.shiftright("number", 33))
    counts = dealt.groupBy("tree", "range").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("tree", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"), F.sum("n").over(whole).alias("total"))
    placed = dealt.join(staged(starts, "starts"), ["tree", "range"])
    return placed.withColumn("pos", F.col("number") + F.col("start")).drop("number", "start", "range")


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes, those of their blocks, and so on until each tree is one node."""
    tables, most = [nodes], nodes.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    while True:
        tables.append(staged(_block_nodes(tables[-1], levels), "nodes"))
        if most <= RUN**levels:
            return tables
        most = -(-most // RUN**levels)


def _descend(tables: list[DataFrame], heads: DataFrame, levels: int, carry: Sequence[str]) -> DataFrame:
    for nodes in reversed(tables[1:-1]):
        found = _paths(nodes, heads, levels)
        heads = staged(found.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot", "root"), "heads")
    return _paths(tables[0], heads, levels, carry)


def prove_documents(
    docs: DataFrame, leaf: Column | None = None, tree_col: str = "source", order_col: str = "doc_id",
    carry: dict[str, Column] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """``doc_id`` (the order column), ``leaf, subroot, root, path`` and the columns ``carry`` for every row.

    ``leaf`` is a row's digest (by default of COLUMNS). A tree's leaves ascend by ``order_col``, nulls first; rows alike
    in it by their leaf, and rows alike in both in any order. Trees ascend by the bytes of ``tree_col``, the null one
    first. A row's path is a step for each level to the root, with the digests left and right of its own. A lone leaf is
    its tree's root, a lone tree the root of all. An empty table gives an empty result; other columns are ignored.
    """
    carry = carry or {}
    named = docs.select(
        F.coalesce(F.concat(F.lit("s"), docs[tree_col].cast("string")), F.lit("")).alias("tree"), docs[order_col].alias("ordered_by"),
        (leaf_of(*[docs[c] for c in COLUMNS]) if leaf is None else leaf).alias("digest"), *[c.alias(f"carry_{n}") for n, c in carry.items()],
    )
    kept = ["ordered_by", *[f"carry_{n}" for n in carry]]
    trees = _rounds(_placed(named, ["ordered_by", "digest"]), levels)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = _rounds(_placed(tops, ["name"]), levels)
    over = forest[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(f"array<{STEP}>").alias("upper"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    found = _descend(forest, over, levels, ["name"])
    heads = staged(found.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("path").alias("upper"), F.col("digest").alias("subroot"), "root"), "heads")
    made = _descend(trees, heads, levels, kept)
    return made.select(F.col("ordered_by").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"carry_{n}").alias(n) for n in carry])
