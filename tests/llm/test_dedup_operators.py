"""Exact, near and substring dedup against SQL and brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from documents_of import rows
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from flowframe.llm import ngram_join as N
from flowframe.llm import prefix_free as S
from flowframe.llm.common import WordHashes, with_rows
from flowframe.llm.components import components
from flowframe.llm.digest_index import DigestIndex
from flowframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    assert_same(spark, QUERIES, ORACLES, name, "/root/testdata/sf0.01")


def test_longest_then_smallest_stays(spark, table):
    df = table([*rows(["a b", "ab", "a  b", "a\tb ", "c", None, "", " "]), (9, "a  b", *[None] * 9)])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in DigestIndex(spark).add(df).collect()}
    assert got[2] == (2, 5, True) and all(got[i] == (2, 5, False) for i in (0, 1, 3, 9)) and got[4] == (4, 1, True)
    assert got[7] == (7, 3, True) and got[5] == (7, 3, False)


def test_later_batches_meet_the_index(spark, table, empty):
    index = DigestIndex(spark, buckets=4)
    index.add(table(rows(["a", "b", "c c"])))
    later = table([(10, "longer than  b", *[None] * 9), (11, "c   c", *[None] * 9), (12, "d", *[None] * 9), (13, " d", *[None] * 9)])
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(later).collect()}
    assert got == {10: (10, True), 11: (2, False), 12: (13, False), 13: (13, True)}
    assert index.rows().count() == 5 and index.rows().select("digest").distinct().count() == 5
    assert index.add(empty).count() == 0 and index.rows().count() == 5


def test_a_batch_added_again_gets_the_same_answers(spark, table):
    index = DigestIndex(spark, buckets=4)
    one, two = table(rows(["a", "b", "c c", "b "])), table([(10, "a", *[None] * 9), (11, "d", *[None] * 9)])
    first, second = index.add(one, "one").collect(), index.add(two, "two").collect()
    assert sorted(map(str, index.add(two, "two").collect())) == sorted(map(str, second)) and index.rows().count() == 4
    # a failure that left half of a batch in the index
    index._append(spark.createDataFrame([(bytes.fromhex(r["text_sha256"]), r["keep_id"], "three") for r in first[:1]], "digest binary, keep_id long, batch string"), (half := DigestIndex(spark, buckets=4)).table)
    assert sorted(map(str, half.add(one, "three").collect())) == sorted(map(str, first)) and half.rows().count() == 3
    index.compact()
    again = table([(20, " a", *[None] * 9), (21, "e", *[None] * 9)])
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(again).collect()} == {20: (0, False), 21: (21, True)}
    index._append(index.rows(), index.spare)
    index.drop()  # as after a compaction that failed between its two last steps
    assert not any(r["kept"] for r in index.add(table([(30, "e ", *[None] * 9)])).collect()) and index.rows().count() == 5
    index.drop(), half.drop()


def test_parts_meet_in_the_index(spark, table, monkeypatch):
    """The anti-join drops the digests of later parts that are no better, and what it appends decides who stays."""
    draw = random.Random(8)
    texts = [" " * draw.randrange(4) + draw.choice(["a", "b", "c c", "d", "ee"]) + " " * draw.randrange(3) for _ in range(200)] + [None, "", "single"]
    df = table([*rows(texts), *[(None, "a", *[None] * 9)] * 3])
    met = []
    better = DigestIndex._better

    def counted(self, found):
        fresh = better(self, found)
        met.append((found.count(), fresh.count()))
        return fresh

    monkeypatch.setattr(DigestIndex, "_better", counted)
    with DigestIndex(spark, buckets=4) as index:
        got = sorted(index.add_parts(df, parts=4).collect(), key=str)
        held = index.rows().count()
        with pytest.raises(ValueError):
            index.add_parts(df)
    with DigestIndex(spark, buckets=4) as index:
        assert got == sorted(index.add(df).collect(), key=str)
    assert met[0][0] == met[0][1] and sum(a - b for a, b in met) > 5 and held == sum(b for _, b in met)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got}) == 7


def test_the_index_lies_in_the_shared_folder(spark, table):
    from pathlib import Path

    from flowframe.sources.staging import shared_dir

    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    before = set(warehouse.rglob("*")) if warehouse.exists() else set()
    index = DigestIndex(spark)
    index.add_parts(table(rows(["a", "b", "a "]))).collect()
    files = [f for f in index.rows().inputFiles()]
    assert files and all(f.removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/")) for f in files)
    assert (set(warehouse.rglob("*")) if warehouse.exists() else set()) == before
    index.drop()
    assert not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_tables_of_single_runs_are_dropped(spark, table):
    with DigestIndex(spark) as index:
        found = index.add(table(rows(["a", "a"])))
    assert not spark.catalog.tableExists(index.table) and sorted(r["kept"] for r in found.collect()) == [False, True]


def test_rows_keep_their_ids_however_files_are_split(spark):
    """Results that were begun before the number of tasks changed are finished after it."""
    setting, docs = "spark.sql.files.maxPartitionBytes", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    numbers = []
    for split in ("1m", "16k"):
        spark.conf.set(setting, split)
        numbers.append({r["doc_id"]: r["at"] for r in with_rows(docs.repartition(3), False, "at").select("doc_id", "at").collect()})
        numbers.append({r["doc_id"]: r["at"] for r in with_rows(docs, True, "at").select("doc_id", "at").collect()})
    assert numbers[1] == numbers[3] and all(len(set(map(str, n.values()))) == docs.count() for n in numbers)
    spark.conf.set(setting, "1m")
    lazy = [S.remove_repeats(docs, in_files=True).select("doc_id", "n_removed"), corpus_pipeline.exact_dedup(spark, docs, ""), corpus_pipeline.near_dedup(spark, docs, "")]
    spark.conf.set(setting, "16k")
    again = [S.remove_repeats(docs, in_files=True).select("doc_id", "n_removed"), corpus_pipeline.exact_dedup(spark, docs, ""), corpus_pipeline.near_dedup(spark, docs, "")]
    for a, b in zip(lazy, again, strict=True):
        assert sorted(map(tuple, a.select(a.columns[:2]).collect())) == sorted(map(tuple, b.select(b.columns[:2]).collect()))
    spark.conf.unset(setting)
    assert lazy[1].count() < docs.count() and lazy[0].where("n_removed > 0").count() > 0


def test_one_of_equal_rows_stays(spark, odd):
    got = DigestIndex(spark).add(odd, carry="n_chars").collect()
    assert len(got) == odd.count() and "n_chars" in got[0].asDict()
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}


def brute_links(texts, similarity=0.8):
    hashes = WordHashes()
    sets = [set(N.ngrams(t or "", 5, hashes).tolist()) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (top(i), links[i]) for i in range(len(texts))}


def near_texts(groups, members, seed=5):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 160))]
        for _ in range(members):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_all_links_are_found(spark, table, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_CLASSES", block)
    texts = [*near_texts(6, 12), *near_texts(1, 40, 6), "a b c", "A, b c!", "a b", "", None, "same words here for you now", "same words here for you now"]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join_documents(table(rows(texts))).collect()}
    assert got == brute_links(texts)


def test_chains_are_verified_by_their_buckets(table, monkeypatch):
    """Each text is like its neighbours only: all pairs of the chain need not be verified, and each link counts once."""
    monkeypatch.setattr(N, "BLOCK_CLASSES", 16)
    seen, units = [], N.verified_units
    monkeypatch.setattr(N, "verified_units", lambda members: seen.append(units(members)) or seen[-1])
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 400, 3)] + near_texts(1, 30, 8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join_documents(table(rows(texts))).collect()}
    assert got == brute_links(texts)
    kinds = [r["units"] is None for r in seen[0].collect()]
    assert any(kinds) and not all(kinds), "the near copies are a group, the chain is buckets"


def test_parts_meet_where_sizes_allow_links(spark, table, monkeypatch):
    """Texts that begin alike and differ in length only: every link is found, and parts of far sizes never meet."""
    monkeypatch.setattr(N, "BLOCK_CLASSES", 7)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:n]) for n in [*range(40, 300, 4), 5, 6, 7, *[44] * 3]] + near_texts(1, 30, 8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join_documents(table(rows(texts))).collect()}
    assert got == brute_links(texts)
    units = spark.createDataFrame([(f"{u}-{n}".encode(), n, u, 9 if u else 1) for u in (0, 1, 2) for n in ([20] * 30 + list(range(10, 90)) if u else [20, 90])], "digest binary, ngrams long, unit long, parts int")
    units = units.withColumn("digest", F.concat("digest", F.monotonically_increasing_id().cast("string").cast("binary")))
    placed = N.in_parts(units, 0.8).collect()
    assert len(placed) == units.count() and {r["part"] for r in placed if r["unit"] == 0} == {0}
    for a in placed:
        assert a["low_part"] <= a["part"] <= a["high_part"]
        for b in placed:
            if a["unit"] == b["unit"] and min(a["ngrams"], b["ngrams"]) >= 0.8 * max(a["ngrams"], b["ngrams"]):
                assert a["low_part"] <= b["part"] <= a["high_part"]
    parts = {r["part"] for r in placed if r["unit"] == 1}
    assert len(parts) > 9 and max(r["high_part"] - r["low_part"] for r in placed) < len(parts) / 2


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute_links([r["text"] for r in docs])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op3_ngram_join"](spark, sf).collect()}
    assert got == {docs[i]["doc_id"]: (docs[c]["doc_id"], n) for i, (c, n) in want.items()} and any(n for _, n in want.values())


def test_join_of_odd_rows(odd, empty):
    got = N.join_documents(odd).collect()
    assert len(got) == odd.count() and sum(r["n_links"] for r in got) == 3 * 2 + 2 * 1
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert by[3] == by[4] == {(3, 2)} and by[5] == {(5, 1)} and by[0] == {(0, 0)} and by[1] == {(1, 0)}
    assert N.join_documents(empty).count() == 0


def test_bands_reach_the_recall():
    bands, size = N.bands_for(0.8, 0.99999)
    assert 1 - (1 - 0.8**size) ** bands >= 0.99999 and bands * size <= 128
    with pytest.raises(ValueError, match="recall"):
        N.bands_for(0.05, 0.99999)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(100, rng.randint(101, 160)) for _ in range(80)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    assert got == {x: top(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                covered[i : i + length] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        out.append((len(d), int(covered.sum()), spans, np.frombuffer(d, np.uint8)[~covered].tobytes()))
    return out


@pytest.mark.parametrize(("hot", "length", "trigger", "segment"), [(10**6, 10, 4, 1 << 19), (3, 10, 4, 1 << 19), (10**6, 12, 12, 16), (10**6, 9, 1, 1 << 19)])
def test_removed_bytes_equal_brute_force(table, monkeypatch, hot, length, trigger, segment):
    monkeypatch.setattr(S, "HOT_PHRASES", hot)
    monkeypatch.setattr(S, "SEGMENT", segment)
    S._powers.cache_clear()
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé\0", weights=[5, 3, 1, 1], k=rng.randint(0, 60))) if rng.random() < 0.8 else "a" * rng.randint(0, 40) for _ in range(200)] + ["xyz" * 30] * 2 + ["", None]
    texts = [t.replace("\0", "~") if t else t for t in texts]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in S.remove_repeats(table(rows(texts)), length, trigger).collect()}
    S._powers.cache_clear()
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, length)


def test_parse_covers_each_string_once():
    data = ("abc" * 200 + "some words that go on " * 3 + "z" * 50).encode()
    place, through, *_ = S.parse(data, 50, 8)
    starts = [i for p, t in zip(place.tolist(), through.tolist(), strict=True) for i in range(p >> 16, t + 1)]
    assert starts == list(range(len(data) - 49))


def test_removal_from_odd_rows(odd, empty):
    got = S.remove_repeats(odd).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted(r["n_bytes"] for r in got) == sorted(len(t.encode()) for t in texts)
    longest = max(r["n_bytes"] for r in got)
    assert all(r["n_removed"] == r["n_bytes"] and len(r["spans"]) == 1 for r in got if r["n_bytes"] == longest)
    assert all(r["n_removed"] == 900 for r in got if r["n_bytes"] == 900)  # it holds itself, shifted
    assert S.remove_repeats(empty).count() == 0


def test_whole_table_of_real_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows_ = docs.orderBy("doc_id").collect()
    expected = brute_spans([r["text"] for r in rows_], 200)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in S.remove_repeats(docs).collect()}
    assert [got[r["doc_id"]] for r in rows_] == expected and sum(x[1] for x in expected) > 0


def test_rows_alike_in_id_and_text_are_read_again_once(spark, table, monkeypatch):
    """A hot group of null ids with one text gives one set, not one a row, and the same answers."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    df = table([(None, near, *[None] * 9)] * 40 + rows([near + " more", near, "quite another text of seven words here"]))
    read, sets = [], N._sets

    def counted(docs, words):
        read.append(docs.count())
        return sets(docs, words)

    monkeypatch.setattr(N, "_sets", counted)
    plain = sorted(N.join_documents(df).collect(), key=str)
    told = sorted(N.join_documents(df, in_files=True).collect(), key=str)
    assert told == plain and read[1] == 2 < read[0]
    assert {r["n_links"] for r in told if r["doc_id"] is None} == {41} and {r["class_id"] for r in told if r["doc_id"] is None} == {0}
