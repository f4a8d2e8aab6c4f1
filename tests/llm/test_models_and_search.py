"""Language, quality, neighbours and shards: held-out accuracy, recall and laws."""

import math
import zlib

import numpy as np
import pytest
import zstandard
from documents_of import rows
from pyspark.sql import functions as F

from flowframe.llm import language_id as L
from flowframe.llm import quality as K
from flowframe.llm import queries as Q
from flowframe.llm.multi_index import MultiIndex, nearest
from flowframe.llm.rendezvous import shard_documents

SF = "/root/testdata/sf0.01"


def test_languages_are_told_on_the_held_out_fold(spark):
    found = Q.op7_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert found.where("score < 0 or score > 1 or score is null or lang_pred is null").count() == 0 and found.count() == 1000


def test_every_sampled_text_is_learned_once(table):
    copies, long = "copied words " * 8, [f"mark{i}x " + f"some{i} words " * 2000 for i in range(40)]
    model = L.fit_languages(table(rows([copies] * 500 + long)), "lang")
    (_, content), = model.dictionaries
    assert content.count(copies.encode()) == 1 and all(f"mark{i}x".encode() in content for i in range(40))
    assert 0.99 * L.DICTIONARY_BYTES < len(content) <= L.DICTIONARY_BYTES


def test_texts_without_letters_are_unknown(odd, empty, table):
    model = L.fit_languages(table(rows(["the cat and the dog"] * 3) + [(9, "der hund und die katze", "de", *[None] * 8)]), "lang")
    assert [n for n, _ in model.dictionaries] == ["en", "de"]
    got = {r["doc_id"]: r for r in L.label_documents(odd, model).collect() if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (0, 1, 6)) and got[3]["lang_pred"] in ("en", "de")
    assert L.label_documents(empty, model).count() == 0
    nothing = L.fit_languages(empty, "lang")
    assert {r["lang_pred"] for r in L.label_documents(odd, nothing).collect()} == {"und"}


def test_quality_on_the_held_out_fold(spark):
    scored = Q.op10_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_of_odd_rows(spark, odd, empty, table):
    labels = spark.createDataFrame([(0, 1), (3, 1), (5, 0), (None, 1), (8, 0), (8, None), (3, 1), (4, 7)], "doc_id long, quality int")
    model = K.fit_quality(odd, labels, "quality")
    got = K.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert K.score_documents(empty, model).count() == 0
    assert K.keep_good(odd, model).columns == odd.columns
    nothing = K.fit_quality(empty, labels, "quality")
    assert {r["score"] for r in K.score_documents(odd, nothing).collect()} == {0.5}


def test_sample_is_bounded_by_its_ngrams(spark, table):
    texts = [f"good words {i} " * 3 if i % 2 else f"bad stuff {i} " * 3 for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, leader = [], K.follow_leader
    try:
        K.follow_leader = lambda rows_: seen.append(rows_) or leader(rows_)
        K.fit_quality(table(rows(texts)), labels, "quality")
        model = K.fit_quality(table(rows(texts)), labels, "quality", sample_ngrams=300)
    finally:
        K.follow_leader = leader
    assert len(seen[0]) == 200 and sum(len(b) for b, _, _ in seen[1]) <= 300 < sum(len(b) for b, _, _ in seen[0])
    assert 10 < len(seen[1]) < 200 and len(model.buckets)


def test_leader_equals_a_plain_loop():
    """FTRL-proximal weight by weight, in dictionaries."""
    rng = np.random.default_rng(7)
    data = []
    for _ in range(60):
        buckets = np.unique(rng.integers(0, 40, 12))
        data.append((buckets, rng.random(len(buckets)), int(rng.integers(0, 2))))
    z, n, bias = {}, {}, K.BUCKETS

    def weight(i):
        lead = z.get(i, 0.0)
        return 0.0 if abs(lead) <= K.L1 else (math.copysign(K.L1, lead) - lead) / ((K.BETA + math.sqrt(n.get(i, 0.0))) / K.ALPHA + K.L2)

    for _ in range(K.PASSES):
        for buckets, values, label in data:
            x = [*zip(buckets.tolist(), values.tolist(), strict=True), (bias, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1.0 / (1.0 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g, old = (p - label) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / K.ALPHA * w[i]
                n[i] = old + g * g
    model = K.follow_leader(data)
    assert np.isclose(model.bias, weight(bias)) and set(model.buckets) == {i for i in z if i != bias and weight(i)}
    assert np.allclose(model.weights, [weight(i) for i in model.buckets.tolist()])


def test_quality_query_equals_plain_scores(spark):
    """The query's scores, text by text from the model's weights, words cut by hand."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.quality_model(spark, docs, sf)
    weights, hashes = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True)), K.WordHashes()
    want = {}
    for r in docs.collect():
        found = K.features(r["text"] or "", hashes).tolist()
        total = model.bias + (K.SCALE * sum(weights.get(b, 0.0) for b in found) / len(found) if found else 0.0)
        want[r["doc_id"]] = (1.0 / (1.0 + math.exp(-total)), zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    got = {r["doc_id"]: r for r in Q.op10_quality_classifier(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (score, held) in want.items():
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9) and got[i]["held_out"] == held and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_language_query_equals_plain_compression(spark):
    """The query's answers, each text compressed with each language's dictionary, block by block."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    model = L.fit_languages(docs.where(F.col("doc_id").isin([i for i in ids if not held(i)])), "lang")
    got = {r["doc_id"]: r for r in Q.op7_language_id(spark, sf).collect()}
    for r in docs.collect():
        text, mine = r["text"] or "", got[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        sizes = []
        for name, content in model.dictionaries:
            total = 0
            for at in range(0, len(text), L.BLOCK_CHARS):
                coder = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
                total += len(coder.compress(text[at : at + L.BLOCK_CHARS].lower().encode()))
            sizes.append((total, name))
        best, second = sorted(sizes, key=lambda x: x[0])[:2]
        assert mine["held_out"] == held(r["doc_id"]) and mine["lang_pred"] in {n for s, n in sizes if s <= best[0] * 1.002}
        assert abs(mine["score"] - (1 - best[0] / second[0])) < 0.004


def test_leader_learns_a_word():
    rng = np.random.default_rng(0)
    rows_ = [(np.unique(np.append(rng.integers(10, 500, 8), 3 if y else 4)), None, y) for y in rng.integers(0, 2, 400)]
    model = K.follow_leader([(b, np.ones(len(b)), y) for b, _, y in rows_])
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert weights[3] > 0.5 and weights[4] < -0.5


def exact(ids, vectors, queries, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in queries:
        scores = unit @ unit[q]
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(scores[i], 12), ids[i]))[:k]
        out[ids[q]] = [ids[i] for i in order]
    return out


def test_recall_and_scores(spark):
    rows_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows_], np.array([r["embedding"] for r in rows_], float)
    truth = exact(ids, vectors, [i for i, v in enumerate(ids) if v % 50 == 0], 5)
    got = Q.op2_multi_index(spark, "/root/testdata/sf0.1").toPandas()
    found = got.groupby("query_id").vec_id.apply(list)
    assert sorted(found.index) == sorted(truth) and set(map(len, found)) == {5}
    assert np.mean([len(set(found[q]) & set(t)) / 5 for q, t in truth.items()]) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for r in got.itertuples():
        a, b = vectors[place[r.query_id]], vectors[place[r.vec_id]]
        assert math.isclose(r.score, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=1e-12)


def test_visiting_everything_is_exact_with_copies_and_ties(table):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 6))
    vectors = np.concatenate([base, np.repeat(base[:1], 30, axis=0), 2 * base[1:4], base[10:12] * 1e-160, base[20:22] * 1e150])
    data = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    bad = [(1000, None, "x", 1), (1001, [0.0] * 6, "x", 1), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1), (1003, [float("nan")] + [1.0] * 5, "x", 1), (1004, [float("inf")] + [1.0] * 5, "x", 1), (1051, [], "x", 1), (None, [1.0] * 6, "x", 1)]
    df = table(data + bad, "vec_id long, embedding array<double>, row string, cell int")
    index = MultiIndex(df, 5)
    got = index.search(F.col("vec_id") % 3 == 0, entries=10**9).orderBy("query_id", "rank").toPandas().groupby("query_id").vec_id.apply(list)
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    assert {q: v for q, v in got.items()} == exact(list(range(len(vectors))), unit, [i for i in range(len(vectors)) if i % 3 == 0], 5)


def test_short_vectors_count_as_filled_up_with_zeros(table):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=rng.integers(1, 6)).tolist()) for i in range(120)] + [(120, [0.0, 0.0]), (150, [-0.0, 1.0]), (151, [0.0, 2.0])]
    got = MultiIndex(table(data, "vec_id long, embedding array<double>"), 5).search(F.col("vec_id") % 50 == 0, entries=10**9).orderBy("query_id", "rank").toPandas()
    ids, vectors = [i for i, v in data if any(v)], np.array([v + [0.0] * (5 - len(v)) for _, v in data if any(v)])
    want = exact(ids, vectors, [n for n, i in enumerate(ids) if i % 50 == 0], 5)
    assert {q: list(v) for q, v in got.groupby("query_id").vec_id} == want and want[150][0] == 151


@pytest.mark.parametrize("part", [4096, 16])
def test_clusters_are_found_in_few_cells(table, monkeypatch, part):
    """Vectors around centres: the index meets its recall with a small share of the entries; a large cell has several parts."""
    monkeypatch.setattr("flowframe.llm.multi_index.PART_ENTRIES", part)
    monkeypatch.setattr("flowframe.llm.multi_index.BLOCK_QUERIES", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    index = MultiIndex(table([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), 5, cell_entries=30)
    got = index.search(F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(list)
    truth = exact(list(range(1500)), vectors, list(range(0, 1500, 50)), 5)
    assert np.mean([len(set(got[q]) & set(t)) / 5 for q, t in truth.items()]) >= 0.9 and index.visited < 0.25


def test_few_or_no_vectors(table):
    schema = "vec_id long, embedding array<float>"
    assert nearest(table([], schema, 1), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(table([(0, [1.0, 2.0])], schema, 1), F.col("vec_id") % 50 == 0).count() == 0
    two = nearest(table([(0, [1.0, 2.0]), (1, [2.0, 1.0])], schema, 1), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in two] == [(0, 1, 1, 0.8)]
    one = nearest(table([(0, [1.0]), (50, [-2.0]), (50, [3.0])], schema, 1), F.col("vec_id") % 50 == 0).collect()
    assert len(one) == 6


def test_new_shards_take_only_into_themselves(odd, empty, table):
    texts = [f"text {i}" for i in range(2000)]
    got = shard_documents(table(rows(texts)), 8).toPandas()
    moved = got[got.grown_shard != got["shard"]]
    assert set(moved.grown_shard) == {8} and 120 < len(moved) < 340
    grown = shard_documents(table(rows(texts)), 9).toPandas().set_index("doc_id")["shard"]
    assert (grown.loc[got.doc_id].to_numpy() == got.grown_shard.to_numpy()).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    heavy = shard_documents(table(rows(texts)), 3, [1.0, 1.0, 6.0]).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in heavy}[2] > 1350
    strange = shard_documents(odd, 8).toPandas()
    assert len(strange) == odd.count() and (strange["size"] >= 1).all() and shard_documents(empty, 8).count() == 0
    with pytest.raises(ValueError):
        shard_documents(odd, 2, [1.0, 0.0])
