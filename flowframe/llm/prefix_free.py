"""Removal of byte strings that occur more than once in a corpus, by prefix-free parsing.

A rolling hash over TRIGGER bytes picks the triggers of a text: in every string of ``length`` bytes the place with the
smallest hash (the last of equal ones), so that, other than with a hash modulo a number, no string is without one.
Triggers cut the text into phrases: what lies between two is a part of the text that depends on its content only. A
string is then an end of a phrase, up to its trigger, and a beginning of the parse's suffix at that trigger. Equal
strings have equal triggers at equal distances, so the corpus is ordered trigger by trigger, as independent tasks:

* the dictionary: phrases with their surroundings are counted by (trigger, content). One that occurs twice is repeated in
  full, and one whose trigger occurs nowhere else is not repeated at all; neither needs to be ordered;
* the suffix array of the parse, in the range of one trigger: the parse's suffixes that begin there, in the order of
  the text that they stand for, as deep as a string reaches, with the lengths that neighbours have in common;
* the suffix array of the dictionary, in the same range: the phrases that end there, ordered from their ends, so that
  those with a common suffix of any length stand together, with the lengths that neighbours have in common;
* both together place every string: at each distance from the trigger, strings with the same run in both arrays, cut
  at that depth, are neighbours in the corpus's order and equal.

Phrases hold at most ``length`` strings, parses are rows of a table, and triggers with very many distinct phrases
are decided string by string with a grouped count, so that no task holds more than a bounded number of phrases.
Contents are told apart by 128-bit hashes, what is ordered by its bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import ROW, TEXT_ROWS, by_bytes, documents, mixed, with_rows
from flowframe.sources.staging import staged

LENGTH, TRIGGER = 200, 48
#: Strings of a text parsed at once. Cuts fall inside phrases, which are then compared like any others.
SEGMENT = 1 << 19
#: Phrases compared in one task on average, and distinct phrases of a trigger beyond which strings are counted singly.
BIN_PHRASES, HOT_PHRASES = 4096, 16_384
_ROOM = np.uint64((1 << 20) - 1)
#: Columns that tell a phrase's content.
CONTENT = ["content", "check"]


@lru_cache(maxsize=4)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of an odd base, and powers of its inverse (modulo 2**64)."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 2**62)) * 4 + 3
    size = SEGMENT + 2 * 1024
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1), np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any substrings of ``data`` by prefix sums."""

    def __init__(self, data: np.ndarray, seed: int = 5):
        values, up, self.down = _powers(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def parse(data: bytes, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a text: (place, through, trigger hash, two content hashes) arrays.

    ``place`` packs the first string's start, the number of strings less one, and the trigger's distance from the
    first start, in 48, 8 and 8 bits. The strings of all phrases are all strings of ``length`` bytes, each once.
    Equal phrases that follow each other, as in text that repeats a word, are one; ``through`` is the start of the
    last string of the last of them.
    """
    places, triggers, contents, checks = [], [], [], []
    bytes_ = np.frombuffer(data, np.uint8)
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = bytes_[base : base + SEGMENT + length - 1]
        rolling = Rolling(part)
        grams = rolling.all(trigger)
        at = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((mixed(grams) & ~_ROOM) | (_ROOM - at), length - trigger + 1)
        where = (_ROOM - (least & _ROOM)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        last = np.append(first[1:], len(where)) - 1
        p = where[first]
        shape = ((last - first) * 256 + (p - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        places.append(((base + first) << 16) | ((last - first) << 8) | (p - first))
        triggers.append(grams[p].view(np.int64))
        for hashes, made in ((rolling, contents), (Rolling(part, 6), checks)):
            made.append(mixed(hashes(first, last + length) + shape).view(np.int64))
    if not places:
        return (np.zeros(0, np.int64),) * 5
    place, what, content, check = map(np.concatenate, (places, triggers, contents, checks))
    differs = (what[1:] != what[:-1]) | (content[1:] != content[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(np.concatenate([[True], differs]))
    through = np.append(place[first[1:]] >> 16, len(data) - length + 1) - 1
    return place[first], through, what[first], content[first], check[first]


def _parsed(base: DataFrame, length: int, trigger: int) -> DataFrame:
    """The parse: a row for each phrase of each text, in the text's order."""
    schema = "file long, row long, place long, through long, trigger long, content long, check long"

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in by_bytes(whole, 3):
                parts = [parse(t.encode("utf-8"), length, trigger) for t in batch.column(3).to_pylist()]
                rows = [np.repeat(batch.column(c).to_numpy(), [len(p[0]) for p in parts]) for c in (0, 1)]
                columns = [*rows, *(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*ROW, "place", "through", "trigger", "content", "check"])

    return base.mapInArrow(run, schema)


def _texts_of(base: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """The dictionary's phrases with ``bytes``: all that their strings cover."""
    wanted = dictionary.groupBy(*ROW).agg(F.collect_list(F.struct("place", "trigger", "copies")).alias("wanted"))
    schema = "file long, row long, place long, trigger long, copies long, bytes binary"

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in by_bytes(whole, 3):
                out: list[tuple] = []
                for file, row, text, asked in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                    data = text.encode("utf-8")
                    for x in asked:
                        start, more = x["place"] >> 16, x["place"] >> 8 & 255
                        out.append((file, row, x["place"], x["trigger"], x["copies"], data[start : start + more + length]))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], [*ROW, "place", "trigger", "copies", "bytes"])

    return base.join(wanted, ROW).mapInArrow(run, schema)


def suffix_array(keys: list, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of (key, text), and the bytes that each has in common with the one before, -1 if the keys differ."""
    order = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i].ljust(width, b"\0")))
    table = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    key = np.array(keys)[order]
    return np.array(order), np.concatenate([[-1], np.where(key[1:] == key[:-1], common, -1)])


def repeated_strings(rows: pd.DataFrame, length: int) -> np.ndarray:
    """For each phrase and each distance of its trigger from a string's start: does the string occur in another phrase?"""
    n = len(rows)
    places, data, triggers = rows["place"].to_numpy(), rows["bytes"].tolist(), rows["trigger"].tolist()
    most, least = places & 255, (places & 255) - (places >> 8 & 255)
    parse_order, parse_common = suffix_array(triggers, [d[o:] for d, o in zip(data, most.tolist(), strict=True)], length)
    ends_order, ends_common = suffix_array(triggers, [d[:o][::-1] for d, o in zip(data, most.tolist(), strict=True)], max(1, int(most.max())))
    found = np.zeros((n, int(most.max()) + 1), bool)
    suffix, end = np.empty(n, np.int64), np.empty(n, np.int64)
    for distance in range(found.shape[1]):
        valid = np.flatnonzero((least <= distance) & (distance <= most))
        if len(valid) < 2:
            continue
        suffix[parse_order] = np.cumsum(parse_common < length - distance)
        end[ends_order] = np.cumsum(ends_common < distance)
        _, which, count = np.unique(end[valid] * (n + 1) + suffix[valid], return_inverse=True, return_counts=True)
        found[valid, distance] = count[which] > 1
    return found


def _runs(rows: pd.DataFrame, found: np.ndarray, length: int) -> pd.DataFrame:
    """The bytes that the found strings cover, run by run."""
    start = (rows["place"].to_numpy() >> 16) + (rows["place"].to_numpy() & 255)  # of the trigger
    edge = np.diff(np.pad(found[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    who, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    widest = found.shape[1] - 1
    low = start[who] - (widest - first)
    return pd.DataFrame({**{c: rows[c].to_numpy()[who] for c in ROW}, "low": low, "high": low + (after - first) - 1 + length})


def _compared(phrases: DataFrame, bins: int, length: int) -> DataFrame:
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_strings(rows, length)
        found[rows["copies"].to_numpy() > 1] = False  # removed in full already
        return _runs(rows, found, length)

    return phrases.groupBy(F.pmod(F.xxhash64("trigger"), F.lit(bins)).alias("bin")).applyInPandas(compare, "file long, row long, low long, high long")


def _counted(phrases: DataFrame, length: int) -> DataFrame:
    """As ``_compared``, by a count of every single string's 128-bit hash."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for file, row, place, copies, data in zip(*(batch.column(c).to_pylist() for c in (*ROW, "place", "copies", "bytes")), strict=True):
                part = np.frombuffer(data, np.uint8)
                starts = np.arange(len(part) - length + 1)
                one, two = (Rolling(part, seed)(starts, starts + length).view(np.int64) for seed in (5, 6))
                out.append((np.full(len(starts), file), np.full(len(starts), row), starts + (place >> 16), np.full(len(starts), copies), one, two))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*ROW, "low", "copies", "one", "two"])

    strings = phrases.mapInArrow(run, "file long, row long, low long, copies long, one long, two long")
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return strings.join(twice, ["one", "two"]).where("copies = 1").select(*ROW, "low", (F.col("low") + length).alias("high"))


def repeated_spans(base: DataFrame, length: int, trigger: int) -> DataFrame:
    """``file, row, low, high``: byte ranges of the texts of ``base`` (file, row, doc_id, text) whose strings occur elsewhere."""
    parsed = _parsed(base, length, trigger)
    last = F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(255)
    copies = F.sum(F.when(F.col("through") > last, 2).otherwise(1))  # one, or more than one
    counts = parsed.groupBy("trigger").agg(copies.alias("n"), *[f(c).alias(f"{n}_{c}") for c in CONTENT for n, f in (("least", F.min), ("most", F.max))])
    alike = ((F.col("least_content") == F.col("most_content")) & (F.col("least_check") == F.col("most_check"))).alias("alike")
    # Staged, so that the join's inputs are plain exchanges and a hot trigger's phrases can be split over tasks.
    known = staged(counts.where("n > 1").select("trigger", alike), "triggers", TEXT_ROWS)
    shared = staged(parsed.join(known, "trigger"), "shared", TEXT_ROWS)
    differing = shared.where("not alike")
    dictionary = differing.groupBy("trigger", *CONTENT).agg(copies.alias("copies"), F.min(F.struct(*ROW, "place")).alias("one"))
    dictionary = staged(dictionary.select("trigger", *CONTENT, "copies", "one.*"), "dictionary")
    often = dictionary.where("copies > 1").select("trigger", *CONTENT)
    full = shared.where("alike").select(*ROW, "place", "through").unionByName(differing.join(often, ["trigger", *CONTENT]).select(*ROW, "place", "through"))
    spans = full.select(*ROW, F.shiftright("place", 16).alias("low"), (F.col("through") + length).alias("high"))
    hot = dictionary.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PHRASES).select("trigger")
    number, hot_number = dictionary.count(), hot.count()
    if number:
        cool = dictionary.join(hot, "trigger", "left_anti") if hot_number else dictionary
        spans = spans.unionByName(_compared(_texts_of(base, cool, length), -(-number // BIN_PHRASES), length))
    if hot_number:
        spans = spans.unionByName(_counted(_texts_of(base, dictionary.join(hot, "trigger", "left_semi"), length), length))
    return spans


def without(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """``data`` without the ranges, and the ranges joined where they touch."""
    joined: list[list[int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    kept, at = [], 0
    for low, high in joined:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in joined]


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, in_files: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row; the id may be a struct of columns.

    ``spans`` (array of low, high) are the maximal runs of UTF-8 bytes covered by a string of ``length`` bytes that
    also starts anywhere else in the table, the same text included; ``kept`` is the other bytes, joined (with
    ``as_text`` a string, without the characters that lost a part of their bytes). Every copy goes, the first too, and strings are judged on the input. Equal rows are copies of each other. Null texts are
    empty; texts shorter than ``length`` are kept whole. ``in_files``: see ``with_rows``. Other columns are ignored;
    an empty table gives an empty result.
    """
    if not 0 < trigger <= length <= 255:
        raise ValueError("trigger and length must satisfy 0 < trigger <= length <= 255")
    texts = documents(docs, id_col, text_col)
    base = with_rows(texts, in_files).select(*ROW, "doc_id", "text")
    spans = repeated_spans(base, length, trigger).groupBy(*ROW).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    span = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    schema = T.StructType([
        T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", span), T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for whole in batches:
            for batch in by_bytes(whole, 3):
                sizes, removed, found, kept = [], [], [], []
                for text, ranges in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    data = text.encode("utf-8")
                    rest, joined = without(data, [(x["low"], x["high"]) for x in ranges or ()])
                    sizes.append(len(data)), removed.append(len(data) - len(rest))
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                    found.append([{"low": a, "high": b} for a, b in joined])
                new = [pa.array(c, f.type) for c, f in zip((sizes, removed, found, kept), list(kinds)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(2), *new], schema=kinds)

    return base.join(spans, ROW, "left").mapInArrow(run, schema)
