"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import TEXT_ROWS, WordHashes, append_columns, documents, fresh_name, matches, run_hashes
from flowframe.sources.staging import staged

#: Hash buckets of n-grams; weights are doubles, so a model takes 8 x BUCKETS bytes wherever it is sent.
BUCKETS = 1 << 18
#: Labelled documents learned from, their distinct n-grams in all (the bounds of what reaches the driver: 8 bytes for
#: each n-gram), and passes over them.
SAMPLE_ROWS, SAMPLE_NGRAMS, PASSES = 3_000, 8_000_000, 4
#: Per-coordinate rate and regularisation of FTRL-proximal.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.1
#: Factor of an n-gram's share in its text.
SCALE = 8.0

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str, hashes: WordHashes) -> np.ndarray:
    """Buckets of the text's words and punctuation runs, of their pairs, and of two word shapes; repeats stay.

    Shapes are the pseudo-words ``=`` for a word like the one before it, and ``^`` for a word in capitals.
    """
    found, capital = [], 0
    for words in matches(_TOKEN, text):
        found.append(hashes.of([w.lower() for w in words]))
        capital += sum(1 for w in words if len(w) > 1 and w.isupper())
    one = np.concatenate(found or [np.zeros(0, np.uint64)])
    if not len(one):
        return np.zeros(0, np.int64)
    again = np.flatnonzero(one[1:] == one[:-1])
    shapes = [hashes["="]] * len(again) + [hashes["^"]] * capital
    parts = [one, np.array(shapes, np.uint64)]
    if len(one) > 1:
        parts.append(run_hashes(one, 2))
    return (np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """Sparse weights: the buckets that have one, their weights, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to a list of scores."""
        dense, hashes = np.zeros(BUCKETS), WordHashes()
        dense[self.buckets] = self.weights

        def score(texts: list[str]) -> tuple[np.ndarray]:
            sums = np.empty(len(texts))
            for i, text in enumerate(texts):
                found = features(text, hashes)
                sums[i] = SCALE * dense[found].sum() / len(found) if len(found) else 0.0
            return (1.0 / (1.0 + np.exp(-np.clip(sums + self.bias, -35, 35))),)

        return score


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> QualityModel:
    """FTRL-proximal over (buckets, values, label) rows in the given order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        lead = z[at]
        return np.where(np.abs(lead) <= L1, 0.0, (np.sign(lead) * L1 - lead) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for found, values, label in rows:
            at, x = np.append(found, BUCKETS).astype(np.int64), np.append(values, 1.0)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    used = np.flatnonzero(w[:-1])
    return QualityModel(used, w[used], float(w[-1]))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``labelled, label``: one row for each of about ``rows`` ids, those with a hash below a share of all.

    Labels other than 0 and 1 and null ids are left out; an id with both labels gets the smaller.
    """
    one = labels.select(labels[id_col].alias("labelled"), labels[label_col].cast("int").alias("label"))
    one = one.where("labelled is not null and label in (0, 1)").groupBy("labelled").agg(F.min("label").alias("label"))
    share = min(1.0, rows / max(1, one.count()))
    return one.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_ngrams: int = SAMPLE_NGRAMS) -> QualityModel:
    """Learns from about ``sample_rows`` documents that ``labels`` (id, label) marks, in the order of their ids' hashes,
    and from no more of them than hold ``sample_ngrams`` distinct n-grams, counted for each document.

    The sampled labels are broadcast (their number is bounded by the parameter), so the documents are not shuffled;
    only hashed n-grams of the sample reach the driver. Of several rows with one id the smallest text counts. Null
    texts are empty texts. No rows, or one label only, give a model that says so.
    """
    sample = F.broadcast(sample_labels(labels, id_col, label_col, sample_rows))
    rows = documents(docs, id_col, text_col).join(sample, F.col("doc_id") == F.col("labelled"))
    rows = rows.groupBy("labelled", "label").agg(F.min("text").alias("text")).withColumn("hash", F.xxhash64("labelled"))

    def make():
        hashes = WordHashes()

        def run(texts: list[str]) -> tuple[list, list]:
            found = [np.unique(features(t, hashes), return_counts=True) for t in texts]
            return [f.astype(np.int32) for f, _ in found], [(SCALE * c / max(1, c.sum())).astype(np.float32) for _, c in found]

        return run

    kinds = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType()))]
    table = staged(append_columns(rows, "text", kinds, make).drop("text"), "ngrams", TEXT_ROWS)
    order = [("hash", "ascending"), ("labelled", "ascending")]
    sizes = table.select("hash", "labelled", F.size("buckets").alias("n")).toArrow().sort_by(order)
    enough = np.flatnonzero(np.cumsum(sizes["n"].to_numpy()) <= sample_ngrams)
    if max(1, len(enough)) < len(sizes):
        table = table.where(F.col("hash") <= sizes["hash"][max(0, len(enough) - 1)].as_py())  # one row at least
    found = table.select("hash", "labelled", "label", "buckets", "shares").toArrow().sort_by(order)
    lists = [found[c].combine_chunks() for c in ("buckets", "shares")]
    if not len(found):
        return follow_leader([])
    ends = lists[0].offsets.to_numpy().tolist()
    buckets, shares = (x.values.to_numpy(zero_copy_only=False) for x in lists)
    return follow_leader([(buckets[i:j], shares[i:j], y) for i, j, y in zip(ends, ends[1:], found["label"].to_pylist(), strict=False)])


def add_score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; null texts are empty, empty texts get the bias's score.

    Equal texts get equal scores, repeated rows one each; an empty table gives an empty result.
    """
    return append_columns(docs, text_col, [T.StructField(name, T.DoubleType())], model.scorer)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row, repeated ones too; a score of one half is predicted 1.

    Null and empty texts have the bias's score; other columns are ignored; an empty table gives an empty result.
    """
    scored = add_score(documents(docs, id_col, text_col), model)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, with their own columns only.

    Null and empty texts stay if the bias's score does; repeated rows stay or go together.
    """
    name = fresh_name(docs, "score")
    return add_score(docs, model, text_col, name).where(F.col(name) >= least).drop(name)
