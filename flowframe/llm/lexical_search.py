"""Ranked lexical search by MaxScore: every shard of the corpus gives its best documents for each item.

The items' terms are known beforehand, so documents are reduced to postings of these terms; corpus statistics come from
the postings of all documents. A shard is a batch of documents. There an item's lists are ordered by the most that they
can add to a score; the lists that together cannot lift a document to the item's current k-th best are non-essential:
only the documents of the others are candidates, and the non-essential lists are probed, largest bound first, for the
candidates that can still qualify. The best of a task's shards set the bar for its next ones. Scores are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import BATCH_BYTES, by_bytes, documents
from flowframe.operators.order import running_totals
from flowframe.sources.staging import staged

#: Fixed value: bytes that are not part of a term.
BETWEEN = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Terms (with repeats) of the items that are searched for together; an item with more is searched for alone.
BLOCK_TERMS = 1_000_000
#: The integer score's scale and parameters.
WEIGHT, SCALE, K1, B = 1000, 1_000_000_000, 12, 25


def _table() -> bytes:
    table = bytearray(range(256))
    for b in BETWEEN:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


LETTERS = _table()


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text with repeats, in lists of those of about BATCH_BYTES."""
    data = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= BATCH_BYTES else data.find(b" ", start + BATCH_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def weight(n_docs: int, df: int) -> int:
    """What a term counts that ``df`` of ``n_docs`` documents hold."""
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share in the score of documents that hold it ``tf`` times among ``length`` terms."""
    m = 100 - B + (B * length * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + K1 * m)


class Shard:
    """Postings of a batch of documents: for each term the documents in order, and their impacts."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.size = doc[order], impact[order], size
        self.terms, starts = np.unique(term[order], return_index=True)
        self.ends = [*starts.tolist(), len(order)]
        self.bounds = np.maximum.reduceat(self.impact, starts) if len(order) else np.zeros(0, np.int64)
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}

    def lists(self, item: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """``bound, list, factor`` of an item's ``(term, factor)``, the largest bound first."""
        found = [(int(self.bounds[at]) * factor, at, factor) for term, factor in item if factor and (at := self.place.get(term)) is not None]
        return sorted(found, reverse=True)

    def of(self, at: int) -> slice:
        return slice(self.ends[at], self.ends[at + 1])


@dataclass
class Best:
    """The best documents found for an item: ``(score, null id, id)``, at most k."""

    k: int
    rows: list

    @property
    def bar(self) -> int:
        """The least score with which a document can still be among them."""
        return max(1, self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            kept = np.flatnonzero(scores >= least).tolist()
            scores, ids = scores[kept], [ids[i] for i in kept]
        rows = [(s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True)]
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[0], r[1], 0 if r[1] else r[2]))[: self.k]


def max_score(shard: Shard, item: Sequence[tuple[int, int]], bar: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of the shard with a score of ``bar`` or more, their scores, and how many lists were non-essential."""
    lists = shard.lists(item)
    rest = np.cumsum([0] + [b for b, _, _ in reversed(lists)])[::-1]  # the most that a list and those after it add
    essential = int((rest[: len(lists)] >= bar).sum())
    scores = np.zeros(shard.size, np.int64)
    for _, at, factor in lists[:essential]:
        scores[shard.doc[shard.of(at)]] += shard.impact[shard.of(at)] * factor
    found = np.flatnonzero(scores)
    for k in range(essential, len(lists)):
        found = found[scores[found] + rest[k] >= bar]
        if not len(found):
            break
        _, at, factor = lists[k]
        docs, impact = shard.doc[shard.of(at)], shard.impact[shard.of(at)]
        place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        hit = docs[place] == found
        scores[found[hit]] += impact[place[hit]] * factor
    found = found[scores[found] >= bar]
    return found, scores[found], len(lists) - essential


def _counted(batch: pa.RecordBatch, column: int, keep: dict[bytes, int] | None) -> Iterator[tuple[int, dict]]:
    """For each text the number of its terms and the counts of those to keep."""
    for text in batch.column(column).to_pylist():
        n, counts = 0, Counter()
        for some in terms(text or ""):
            n += len(some)
            counts.update(some)
        yield n, counts if keep is None else {keep[w]: c for w, c in counts.items() if w in keep}


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (a number for each row), ``item_id, terms, tfs, n`` (terms with repeats)."""
    named = items.select(items[id_col].alias("item_id"), items[text_col].cast("string").alias("text"))
    rows = named.withColumn("item", F.monotonically_increasing_id())
    schema = T.StructType([rows.schema["item"], rows.schema["item_id"], T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("tfs", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            made = list(_counted(batch, batch.schema.get_field_index("text"), None))
            columns = [[list(c) for _, c in made], [list(c.values()) for _, c in made], [n for n, _ in made]]
            kinds = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return staged(rows.mapInArrow(run, schema), "items")


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items as rows, a bounded number of terms at a time."""
    asked = items.where("n > 0")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= BLOCK_TERMS:
        yield asked.collect()
        return
    summed = running_totals(asked.select("item", "n"), ["item"], {"upto": "n"})
    blocks = staged(summed.select("item", F.expr(f"upto div {BLOCK_TERMS}").alias("block")), "blocks")
    for block in sorted(r[0] for r in blocks.select("block").distinct().collect()):  # a row for each pass over the corpus
        yield asked.join(blocks.where(F.col("block") == block), "item").collect()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` of the documents that have terms: ``n`` counts all, the lists those of the vocabulary."""
    rows = documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of a block of items
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, 1):
                made = list(_counted(batch, 1, shared.value))
                rows = [i for i, (n, _) in enumerate(made) if n]
                columns = [[made[i][0] for i in rows], [list(made[i][1]) for i in rows], [list(made[i][1].values()) for i in rows]]
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return rows.mapInArrow(run, schema)


def _best(found: DataFrame, items: list, weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best of each task for each item."""
    asked = [(item, [(t, c * weights[t]) for t, c in pairs]) for item, pairs in items]
    shared = found.sparkSession.sparkContext.broadcast(asked)
    schema = T.StructType([T.StructField("item", T.LongType()), found.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        best = {item: Best(k, []) for item, _ in shared.value}
        for batch in batches:
            lists, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            length = batch.column("n").to_numpy()[doc]
            shard = Shard(doc, lists.flatten().to_numpy(), impacts(tfs, length, n_docs, n_terms), len(sizes))
            ids = batch.column("doc_id").to_pylist()
            for item, pairs in shared.value:
                at, scores, _ = max_score(shard, pairs, best[item].bar)
                if len(at):
                    best[item].add(scores, [ids[i] for i in at.tolist()])
        rows = [(item, i, s) for item, b in best.items() for s, _, i in b.rows]
        kinds = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(kinds)], schema=kinds)

    return found.mapInArrow(run, schema)


def search_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` the k best documents with a score above 0.

    A term is a run of ASCII letters and digits and of all characters beyond ASCII, A to Z in lower case. All documents
    are searched, and count in the statistics where they have a term. Equal scores rank by id, null ids last; repeated
    documents rank one by one, repeated items have the same answers each. Null texts have no terms; items without terms,
    and tables without rows, have no answers. Other columns are ignored.
    """
    spark = docs.sparkSession
    named = item_terms(items, item_col, item_text_col)
    result = None
    for rows in _blocks(named):
        vocabulary: dict[bytes, int] = {}
        asked = [(r["item"], [(vocabulary.setdefault(bytes(t), len(vocabulary)), c) for t, c in zip(r["terms"], r["tfs"], strict=True)]) for r in rows]
        found = staged(postings(docs, vocabulary, id_col, text_col), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r[0]: r[1] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # terms of the block
        weights = [weight(n_docs, holding.get(t, 0)) for t in range(len(vocabulary))]
        best = _best(found, asked, weights, n_docs, max(1, n_terms), k)
        result = best if result is None else result.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = staged(result, "best").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
