"""Approximate nearest neighbours by an inverted multi-index, ranked by cosine.

Both halves of the unit vectors are quantised with their own centroids; a vector's cell is the pair. A query visits
cells in the order of the summed distances of its halves to the centroids, drawn from a heap, until it has seen the
number of entries that the index was calibrated to; the entries of visited cells are reranked with exact cosines.

Equal vectors are one entry with its smallest ids, so groups of copies are searched once. Neighbouring cells share
parts of bounded size (a large cell has several). A query goes to the parts that hold cells it visits, and there only
the entries of these cells are scored; of the queries that visit a part, each block of bounded size gets the part in
one task. What is shuffled thus grows with the visits, and no part is sent to queries that do not visit it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowframe.sources.staging import staged


#: Bound of the sample that centroids are fitted on, entries a cell on average, and bound of the centroids of a half.
SAMPLE, CELL_ENTRIES, MOST_CENTROIDS = 20_000, 4, 1024
ROUNDS = 12
#: Queries that the index is calibrated with against brute force, and the share of their neighbours to be visited.
CALIBRATION, RECALL = 128, 0.95
PART_ENTRIES, BLOCK_QUERIES = 4096, 4096

_FOUND = "q1 long, q2 long, score double, ids array<struct<vec_id:long,row:long>>, cell int"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, row, v, h1, h2`` of the rows that take part: an id, and a vector with finite components, not all zero.

    Vectors shorter than the longest are filled up with zeros, which leaves their lengths and products as they are.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than infinity
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = staged(rows, "vectors")
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))
    return rows.withColumn("v", F.transform(filled, lambda x: x + 0.0)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """One entry for equal vectors, with its ``k`` smallest ids; further ones could not be among k neighbours."""
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id", "row"))
    least = rows.withColumn("place", place).where(F.col("place") <= k)
    return least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"), F.first("v").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_line(centroids: np.ndarray) -> np.ndarray:
    """The centroids in the order of their main direction."""
    if not centroids.shape[1]:
        return centroids
    middle = centroids - centroids.mean(0)
    return centroids[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2.0 * x @ centroids.T


def fit_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """``k`` means of the rows of ``x``; a centroid that loses all its rows stays where it is."""
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(1)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return _in_line(centroids)


class Cells:
    """Centroids of both halves, and the entries of each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.counts = np.zeros(len(first) * len(second), np.int64)

    def of(self, unit: np.ndarray) -> np.ndarray:
        return _distances(unit[:, : self.half], self.first).argmin(1) * len(self.second) + _distances(unit[:, self.half :], self.second).argmin(1)

    def visits(self, unit: np.ndarray, entries: int) -> list[int]:
        """Cells that hold something, nearest pair of centroids first, until they hold ``entries``."""
        one = _distances(unit[None, : self.half], self.first)[0]
        two = _distances(unit[None, self.half :], self.second)[0]
        by_one, by_two = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
        a, b, width, counts = one.tolist(), two.tolist(), len(two), self.counts
        heap, out, seen = [(a[by_one[0]] + b[by_two[0]], 0, 0)], [], 0
        while heap and seen < entries:
            _, i, j = heapq.heappop(heap)
            cell = by_one[i] * width + by_two[j]
            if counts[cell]:
                out.append(cell)
                seen += int(counts[cell])
            if j + 1 < width:  # a row of pairs is entered from its first pair, and followed from there
                heapq.heappush(heap, (a[by_one[i]] + b[by_two[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(by_one):
                heapq.heappush(heap, (a[by_one[i + 1]] + b[by_two[0]], i + 1, 0))
        return out


def _found(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the ``k`` best of the entries in its ``visited`` cells (all, without that column), ties by id."""
    vectors, asked = _matrix(rows["v"]), _matrix(queries["v"])
    unit, directions = _unit(vectors), _unit(asked)
    first = np.array([x[0]["vec_id"] for x in rows["ids"]], np.int64)
    cell = rows["cell"].to_numpy()
    cells, which = np.unique(cell, return_inverse=True)
    places, scores = [], []
    for i, q in enumerate(asked):
        at = np.arange(len(cell))
        if "visited" in queries:
            visited = np.zeros(len(cells), bool)
            visited[np.searchsorted(cells, queries["visited"].iloc[i])] = True
            at = np.flatnonzero(visited[which])
        near = unit[at] @ directions[i]
        if len(at) > k:
            near_enough = near >= np.partition(near, len(at) - k)[len(at) - k] - 1e-12
            at = at[near_enough]
        some = vectors[at]
        scale = np.abs(some).max(axis=1, keepdims=True)
        some, q = some / scale, q / np.abs(q).max()  # squares of huge or tiny components stay finite
        exact = (some * q).sum(1) / (np.sqrt((some * some).sum(1)) * np.sqrt((q * q).sum()))
        best = np.lexsort((first[at], -exact))[:k]
        places.append(at[best]), scores.append(exact[best])
    n = [len(at) for at in places]
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return pd.DataFrame({
        "q1": np.repeat(queries["h1"].to_numpy(), n), "q2": np.repeat(queries["h2"].to_numpy(), n),
        "score": np.concatenate(scores) if scores else np.zeros(0), "ids": rows["ids"].to_numpy()[at], "cell": cell[at],
    })


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0]["vec_id"]))
    return found.withColumn("place", place).where(F.col("place") <= k)


class MultiIndex:
    """An inverted multi-index over all usable rows of a table, fitted on a bounded sample of them."""

    def __init__(self, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", cell_entries: int = CELL_ENTRIES, sample: int = SAMPLE):
        self.k, self.visited = k, 0.0  # the share of the entries that the last search visited for each query
        self.rows = usable(vectors, id_col, vector_col)
        entries = staged(entries_of(self.rows, k + 1), "entries")
        self.size = entries.count()
        self.cells, self.index = None, entries
        if not self.size:
            return
        slots = 1 << 30
        share = min(slots, slots * sample // self.size + 1)
        chosen = entries.where(F.pmod("h2", F.lit(slots)) < share).select("h1", "h2", "v").toPandas().sort_values(["h2", "h1"])
        unit = _unit(_matrix(chosen["v"] if len(chosen) else entries.limit(1).toPandas()["v"]))
        half = max(1, unit.shape[1] // 2) if unit.shape[1] > 1 else 1
        wanted = max(1, round((self.size / cell_entries) ** 0.5))
        parts = [np.unique(unit[:, :half], axis=0), np.unique(unit[:, half:], axis=0)]
        cells = Cells(*[fit_centroids(x, min(wanted, MOST_CENTROIDS, len(u))) for x, u in zip((unit[:, :half], unit[:, half:]), parts, strict=True)])

        def place(batches):
            for rows in batches:
                yield rows.assign(cell=cells.of(_unit(_matrix(rows["v"]))).astype(np.int32) if len(rows) else pd.Series([], dtype=np.int32))

        self.index = staged(entries.mapInPandas(place, entries.schema.simpleString()[7:-1] + ",cell:int"), "index")
        held = self.index.groupBy("cell").count().toArrow()  # MOST_CENTROIDS squared rows at most
        cells.counts[held["cell"].to_numpy()] = held["count"].to_numpy()
        self.cells = cells

    def calibrate(self, queries: DataFrame, recall: float = RECALL, most: int = CALIBRATION) -> int:
        """Entries to visit so that ``recall`` of the exact neighbours of about ``most`` queries are seen."""
        slots = 1 << 30
        share = min(slots, slots * most // max(1, queries.count()) + 1)
        asked = queries.where(F.pmod("h2", F.lit(slots)) < share).select("h1", "h2", "v").toPandas()
        if not len(asked):
            return self.size
        k = self.k + 1

        def exact(batches):
            for rows in batches:
                if len(rows):
                    yield _found(rows, asked, k)

        truth = _top(self.index.mapInPandas(exact, _FOUND), k).toPandas()
        counts, needs = self.cells.counts, []
        for (h1, h2), v in zip(asked[["h1", "h2"]].itertuples(index=False), _unit(_matrix(asked["v"])), strict=True):
            seen = dict(zip(order := self.cells.visits(v, self.size), np.cumsum(counts[order]).tolist(), strict=True))
            near = truth[(truth.q1 == h1) & (truth.q2 == h2) & (truth.score < 1 - 1e-12)]
            needs += [seen[c] for c in near["cell"]]
        needs.sort()
        return needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))] if needs else self.size

    def search(self, is_query: Column, entries: int | None = None) -> DataFrame:
        """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row that ``is_query`` (of vec_id) marks.

        Nearest first, ties to the smaller vec_id. Rows without an id or a usable vector take no part, on either
        side. Rows with equal ids are different rows; shorter vectors count as filled up with zeros. ``entries`` overrides the calibrated number to visit.
        """
        spark, k = self.rows.sparkSession, self.k
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.size:
            return spark.createDataFrame([], schema)
        askers = self.rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "h1", "h2", "v")
        queries = staged(askers.groupBy("h1", "h2").agg(F.first("v").alias("v")), "queries")
        budget = self.calibrate(queries) if entries is None else entries
        self.visited = min(1.0, budget / self.size)
        cells = self.cells
        pieces = np.maximum(1, -(-cells.counts // PART_ENTRIES)).astype(np.int64)  # of a cell; those of large cells are parts of their own
        before = np.cumsum(cells.counts) - cells.counts
        small = before // PART_ENTRIES  # cells that lie side by side share a part
        alone = int(small[-1]) + 1 + np.cumsum(np.where(pieces > 1, pieces, 0)) - np.where(pieces > 1, pieces, 0)
        first_part = np.where(pieces > 1, alone, small)

        def deal(batches):
            for rows in batches:
                cell = rows["cell"].to_numpy().astype(np.int64)
                yield rows.assign(part=first_part[cell] + (rows["h1"].to_numpy() & 0x7FFFFFFF) % pieces[cell])

        def probe(batches):
            for rows in batches:
                out = []
                for h1, h2, v, unit in zip(rows["h1"], rows["h2"], rows["v"], _unit(_matrix(rows["v"])) if len(rows) else [], strict=True):
                    visited = np.sort(np.array(cells.visits(unit, budget), np.int64))
                    cell = np.repeat(visited, pieces[visited])
                    piece = np.arange(len(cell)) - np.repeat(np.cumsum(pieces[visited]) - pieces[visited], pieces[visited])
                    part = first_part[cell] + piece
                    order = np.argsort(part, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        out.append((h1, h2, v, int(part[some[0]]), cell[some].astype(np.int32)))
                yield pd.DataFrame(out, columns=["h1", "h2", "v", "part", "visited"])

        index_schema = self.index.schema.simpleString()[7:-1]
        asked = staged(queries.mapInPandas(probe, "h1 long, h2 long, v array<double>, part long, visited array<int>"), "asked")
        blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))  # one row a part
        asked = asked.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("h2"), F.col("blocks")).cast("int")).drop("blocks")
        dealt = self.index.mapInPandas(deal, index_schema + ",part:long").join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def rerank(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(questions):
                return pd.DataFrame({"q1": [], "q2": [], "score": [], "ids": [], "cell": []}).astype({"q1": "int64", "q2": "int64", "score": float, "cell": "int32"})
            held = rows["cell"].unique()  # a piece of a cell may be empty
            questions = questions.assign(visited=[np.asarray(v)[np.isin(v, held)] for v in questions["visited"]])
            return _found(rows.reset_index(drop=True), questions[questions["visited"].map(len) > 0], k + 1)

        found = dealt.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(rerank, _FOUND)
        near = staged(_top(found, k + 1).select("q1", "q2", "score", "ids"), "near")
        each = askers.join(near, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))).select("query_id", "own", "score", F.explode("ids").alias("hit"))
        each = each.where("hit.row <> own")
        rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "hit.vec_id", "hit.row"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of an index built for this search; see ``MultiIndex``."""
    return MultiIndex(vectors, k, id_col, vector_col).search(is_query)
