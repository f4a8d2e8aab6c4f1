"""Similarity join of texts on the Jaccard similarity of their word n-grams, by MinHash banding.

Texts with the same n-gram set are one class. The classes' signatures are cut into bands, whose number and rows are
chosen for the target recall; band hashes are shuffled, and classes that share one are candidates. Candidates are
joined into candidate groups (without listing pairs). A small group is verified as a whole on the full n-gram sets. Of
a group beyond one block, either all pairs are verified, or, where that is less, those within its buckets (the classes
that share one band): so a long chain of classes, each like its neighbours only, costs what its buckets cost. What is
verified together is dealt by set size into blocks of bounded size, and those pairs of blocks verify their pairs whose
sizes are near enough for a link. Only sums and spanning edges leave a block, and no link is lost.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import TEXT_ROWS, WordHashes, append_columns, documents, fresh_name, matches, mixed, run_hashes, with_rows
from flowframe.llm.components import components
from flowframe.sources.staging import staged

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
#: Bounds of a block of a candidate group: classes, and n-grams of them all.
BLOCK_CLASSES, BLOCK_NGRAMS = 512, 1_000_000
#: Columns of the incidence matrix that are multiplied at once.
SLAB = 8192

_WORD = re.compile(r"\w+")


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the longest bands whose number stays within ``most`` hashes and reaches ``recall`` at ``similarity``.

    Raises where no bands do.
    """
    found = None
    for rows in range(1, most + 1):
        miss = 1.0 - similarity**rows
        bands = 1 if miss <= 0 else int(np.ceil(np.log(1.0 - recall) / np.log(miss)))
        if bands * rows > most:
            break
        found = (bands, rows)
    if found is None:
        raise ValueError(f"{most} hashes do not reach a recall of {recall} at a similarity of {similarity}")
    return found


def ngrams(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; shorter texts are one run, texts without words have none.

    Words are runs of letters, digits and underscores, without regard to case.
    """
    words = np.concatenate([hashes.of(some) for some in matches(_WORD, text.lower())] or [np.zeros(0, np.uint64)])
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else words


class Signer:
    """Digest, size and band hashes of an n-gram set."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.weights = rng.integers(1, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 2**63, bands, np.uint64)

    def bands_of(self, found: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(found), 256):
            products = found[start : start + 256, None] * self.factors
            products ^= products >> np.uint64(32)  # the high bits, which depend on all others, are folded down
            np.minimum(least, products.min(axis=0), out=least)
        return mixed((least.reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64) ^ self.salts).view(np.int64)


def signed_texts(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """``doc_id, copy, digest, ngrams, bands`` for each text, and ``carried`` if ``docs`` has it; digest and bands are null without words.

    ``copy`` is a hash of the text, by which the row is found again.
    """
    def make():
        hashes, signer = WordHashes(), Signer(bands, rows)

        def run(texts: list[str]) -> tuple[list, list, list]:
            digests, sizes, found = [], [], []
            for text in texts:
                grams = ngrams(text, words, hashes)
                sizes.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                found.append(signer.bands_of(grams) if len(grams) else None)
            return digests, sizes, found

        return run

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("ngrams", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return append_columns(docs, "text", fields, make).select("doc_id", F.xxhash64("text").alias("copy"), "digest", "ngrams", "bands", *[c for c in docs.columns if c == "carried"])


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with ``grams``, the packed n-gram set of the text, instead of the text."""
    def make():
        hashes = WordHashes()
        return lambda texts: ([ngrams(t, words, hashes).tobytes() for t in texts],)

    return append_columns(docs, "text", [T.StructField("grams", T.BinaryType())], make).drop("text")


def links_within(sets: list[np.ndarray], similarity: float, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of positions whose Jaccard similarity is at least ``similarity``.

    With ``left``, only pairs between the first ``left`` sets and the others.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.diff(flat, prepend=flat[:1]) != 0
    column = np.cumsum(fresh)
    shared = np.bincount(column)[column] > 1  # n-grams of one set only add nothing
    column, owner = column[shared], owner[shared]
    common = np.zeros((m, m), np.float32)
    if len(column):
        column = np.cumsum(np.diff(column, prepend=column[0]) != 0)
        for start in range(0, int(column[-1]) + 1, SLAB):
            a, b = np.searchsorted(column, [start, start + SLAB])
            slab = np.zeros((m, int(column[b - 1]) - start + 1), np.float32)
            slab[owner[a:b], column[a:b] - start] = 1.0
            common += slab @ slab.T
    common = common.astype(np.float64)
    total = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(common >= similarity * total, 1))
    if left is not None:
        cross = (i < left) & (j >= left)
        i, j = i[cross], j[cross]
    return i, j


def verified(rows: pd.DataFrame, similarity: float, first: int, second: int) -> pd.DataFrame:
    """For each class of a block pair: the smallest class it hangs together with there, and its linked documents.

    A link that several units hold is counted in the smallest of them (``units``: those that a class is in, if several).
    """
    rows = rows.drop_duplicates("digest")
    inner = first == second
    rows = rows.sort_values(["part", "digest"], kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
    i, j = links_within(sets, similarity, None if inner else int((rows["part"] == first).sum()))
    if len(i) and rows["units"][0] is not None:
        unit, units = rows["unit"][0], [set(u.tolist()) for u in rows["units"]]
        own = np.array([min(units[a] & units[b]) == unit for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[own], j[own]
    n = rows["copies"].to_numpy()
    links = np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))
    parent = list(range(len(rows)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    digests = rows["digest"].tolist()
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            low, high = (a, b) if digests[a] < digests[b] else (b, a)
            parent[high] = low
    return pd.DataFrame({"digest": digests, "root": [digests[top(x)] for x in range(len(rows))], "links": links.astype(np.int64)})


def _parts(n: str, grams: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK_CLASSES, F.col(grams) / BLOCK_NGRAMS)).cast("int").alias("parts")


def verified_units(members: DataFrame) -> DataFrame:
    """``digest, copies, one, ngrams, unit, parts, units``: which classes are verified together, and in how many parts.

    ``members`` are the classes of groups, with their bands. A unit is a group or one bucket of a large group, and
    ``units`` then all the buckets that the class is in. Buckets with the same classes are one.
    """
    columns = ["digest", "copies", "one", "ngrams"]
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("ngrams").alias("grams"))
    sizes = staged(sizes.select("group", "n", _parts("n", "grams")), "sizes")
    whole = members.join(sizes, "group").select(*columns, "group", "parts", "node", "bands", "n")
    in_band = whole.where("parts > 1").select(*columns, "group", "n", "node", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(
        F.max("group").alias("group"), F.max("n").alias("n"), F.count("*").alias("m"), F.sum("ngrams").alias("grams"),
        F.bit_xor("node").alias("mix"), F.sum(F.col("node").cast("decimal(38,0)")).alias("total"),
    ).where("m > 1")
    buckets = staged(buckets.groupBy("group", "n", "m", "grams", "mix", "total").agg(F.min("band").alias("unit")), "buckets")
    chains = buckets.groupBy("group", "n").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs")).where("pairs < cast(n as double) * n")
    chains = staged(chains.select("group"), "chains")
    groups = whole.join(chains, "group", "left_anti").select(*columns, F.col("group").alias("unit"), "parts", F.lit(None).cast("array<long>").alias("units"))
    of_chains = buckets.join(chains, "group", "left_semi").select("unit", _parts("m", "grams"))
    shared = staged(in_band.join(of_chains, in_band["band"] == of_chains["unit"]).select(*columns, "unit", "parts"), "shared")
    lists = staged(shared.groupBy("digest").agg(F.collect_list("unit").alias("units")), "lists")  # as many as bands at most
    return groups.unionByName(shared.join(lists, "digest"))


def in_parts(units: DataFrame, similarity: float) -> DataFrame:
    """``units`` with ``part``, and ``low_part`` to ``high_part``, the parts in which its classes may have links.

    A unit of several parts is cut along the sizes of its sets, a size of many sets by hash. The smaller set of a link
    has ``similarity`` of the larger one's n-grams at least, so a part meets the parts of near sizes only.
    """
    weight = F.greatest(F.lit(1.0 / BLOCK_CLASSES), F.col("ngrams") / BLOCK_NGRAMS)
    large = units.where("parts > 1")
    sizes = large.groupBy("unit", "ngrams").agg(F.count("*").alias("m")).withColumn("own", F.col("m") * weight)
    upto = Window.partitionBy("unit").orderBy("ngrams")  # one row a size
    ranges = staged(sizes.select("unit", "ngrams", "own", (F.sum("own").over(upto) - F.col("own")).alias("before")), "ranges")
    within = F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    cut = staged(large.join(ranges, ["unit", "ngrams"]).withColumn("part", F.floor(F.col("before") + F.col("own") * within).cast("int")).drop("own", "before"), "cut")
    spans = cut.groupBy("unit", "part").agg(F.min("ngrams").alias("low"), F.max("ngrams").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    meet = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.high") >= similarity * F.col("b.low")) & (F.col("b.high") >= similarity * F.col("a.low"))
    near = a.join(b, meet).groupBy("a.unit", "a.part").agg(F.min("b.part").alias("low_part"), F.max("b.part").alias("high_part"))
    alone = units.where("parts = 1").withColumns({c: F.lit(0) for c in ("part", "low_part", "high_part")})
    return alone.unionByName(cut.join(staged(near, "near_parts"), ["unit", "part"]))


def join_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", in_files: bool = False) -> DataFrame:
    """``doc_id, class_id, n_links, copies_of, n_copies`` for every row.

    ``n_links`` is the number of other rows whose n-gram sets have a Jaccard similarity of ``similarity`` or more
    with the row's; ``class_id`` is the smallest doc_id that the row hangs together with over such links,
    ``copies_of`` the smallest doc_id with the very same set, ``n_copies`` the number of rows with it. Texts without
    words (null and empty ones too) have no links, and their own doc_id as class. Equal rows are copies of each
    other. Null ids are never the smallest unless there are no others. An empty table gives an empty result; other columns are ignored.

    ``in_files`` (see ``with_rows``) tells rows apart that are alike in id and text, so that of such rows, however many,
    one is read again; without it all are, and dropped when verified.
    """
    place = fresh_name(docs, "place") if in_files else None
    texts = documents(with_rows(docs, True, place) if place else docs, id_col, text_col, place)
    same_row = ["carried"] if place else []
    bands, rows = bands_for(similarity, recall)
    signed = staged(signed_texts(texts, bands, rows, words), "signed", TEXT_ROWS)
    classes = staged(
        signed.where("digest is not null").groupBy("digest").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("copies_of"), F.min(F.struct("copy", "doc_id", *same_row)).alias("one"),
            F.first("ngrams").alias("ngrams"), F.first("bands").alias("bands"),
        ).withColumn("node", F.xxhash64("digest")),
        "classes",
    )
    band = classes.select("node", F.explode("bands").alias("band"))
    # Aggregates that are joined back are staged first: then a hot key's rows can be split over tasks.
    shared = band.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    near = band.join(staged(shared.select("band", "first"), "shared"), "band").where("node <> first").select("node", "first").distinct()
    groups = components(staged(near, "near"), "node", "first")
    members = staged(classes.join(groups.withColumnRenamed("root", "group"), "node"), "members")
    placed = staged(in_parts(staged(verified_units(members), "units"), similarity), "placed")
    # One row stands for a class, whichever copy.
    wanted = placed.select(F.col("one.copy").alias("copy"), F.col("one.doc_id").alias("id"), *[F.col(f"one.{c}").alias("at") for c in same_row], "digest", "copies", "unit", "units", "parts", "part", "low_part", "high_part")
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    on = (hashed["hash"] == wanted["copy"]) & hashed["doc_id"].eqNullSafe(wanted["id"])
    found = hashed.join(wanted, on & (hashed["carried"] == wanted["at"]) if place else on)
    sets = _sets(found.select("digest", "copies", "unit", "units", "parts", "part", "low_part", "high_part", "text"), words)
    # Small units share a bin; a unit of several parts is dealt out in pairs of parts that may have links.
    total = placed.where("parts = 1").agg(F.sum("ngrams"), F.count("*")).first()
    bins = max(1, -(-(total[0] or 0) // BLOCK_NGRAMS), -(-total[1] // (8 * BLOCK_CLASSES)))
    other = F.explode(F.sequence("low_part", "high_part"))
    dealt = sets.withColumn("other", other).withColumns({
        "low": F.least("part", "other"), "high": F.greatest("part", "other"),
        "bin": F.when(F.col("parts") == 1, F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(bins))).otherwise(F.col("unit")),
        "many": F.col("parts") > 1,
    })

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = [verified(g, similarity, key[2], key[3]) for _, g in rows.groupby("unit", sort=False)]
        return pd.concat(made, ignore_index=True)

    links = staged(dealt.groupBy("many", "bin", "low", "high").applyInPandas(verify, "digest binary, root binary, links long"), "links", TEXT_ROWS)
    roots = components(links.where("digest <> root"), "digest", "root")
    linked = links.groupBy("digest").agg(F.sum("links").alias("links"))
    whole = classes.select("digest", "copies", "copies_of").join(linked, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    whole = staged(whole.withColumn("root", F.coalesce("root", "digest")), "whole")
    ids = staged(whole.groupBy("root").agg(F.min("copies_of").alias("class_id")), "ids")
    result = staged(whole.join(ids, "root"), "result").select("digest", "class_id", "copies_of", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "digest").join(result, "digest", "left").select(
        "doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("copies_of")).alias("copies_of"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, in_files: bool = False) -> DataFrame:
    """The rows of ``docs``, one of each class of ``join_documents``: that with the smallest id (nulls last), of rows with
    one id any.

    Texts without words, null and empty ones too, all stay, and so do null ids that are no copies. ``in_files``: see
    ``with_rows``. An empty table gives an empty result; the columns are those of ``docs``.
    """
    row, key = fresh_name(docs, "row"), fresh_name(docs, "key")
    rows = with_rows(docs, in_files, row)
    keyed = rows.withColumn(key, F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")))
    classes = join_documents(keyed, similarity, id_col=key, text_col=text_col)
    dropped = classes.where("doc_id <> class_id").select(F.col("doc_id.row").alias(row))
    return rows.join(staged(dropped, "dropped"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
