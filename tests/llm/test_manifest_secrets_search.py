"""Merkle manifest, secret scan and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from documents_of import COLUMNS, rows
from oracle import assert_same
from pyspark.sql import functions as F

from flowframe.llm import lexical_search as search
from flowframe.llm import merkle
from flowframe.llm import queries as llm
from flowframe.llm import secret_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_lexical_search"])
def test_query_equals_sql(spark, name):
    assert_same(spark, llm.QUERIES, llm.ORACLES, name, SF)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, tampered=False):
    parts = []
    for c in merkle.COLUMNS:
        v = row[c]
        if c == "text" and v is not None and tampered:
            v = v.replace("\n", "")
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*parts)


def plain_tree(leaves):
    """The root, and for each leaf the (left, right) digests of each level."""
    paths, groups, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        for i, members in enumerate(groups):
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(nodes)))
            for m in members:
                paths[m].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        cuts = range(0, len(nodes), 3)
        groups = [sum(groups[i : i + 3], []) for i in cuts]
        nodes = [sha(*nodes[i : i + 3]) for i in cuts]
    return nodes[0], paths


def plain_manifest(docs):
    by_source = defaultdict(list)
    for row in docs:
        by_source[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            out.append((row["doc_id"], leaf, trees[s][0], root, tuple(path + top)))
    return sorted(out, key=repr)


def shown(proved):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"])) for r in proved.collect()), key=repr)


@pytest.mark.parametrize("height", [0, 1, 2, 3, 4])
def test_traversal_is_in_time_and_small(height):
    for n in {1, 2, 3, 4, 5, 8, 9, 10, 26, 27, 28, 80, 81}:
        if merkle._height(n, 9) == height:
            leaves = [sha(str(i)) for i in range(n)]
            walk = merkle.Traversal(leaves, height)
            assert list(walk.paths()) == plain_tree(leaves)[1]
            assert walk.late == 0
            assert walk.most <= 9 * max(1, height)


def test_large_block_holds_few_nodes():
    walk = merkle.Traversal([sha(str(i)) for i in range(3**7)], 7)
    for _ in walk.paths():
        pass
    assert walk.late == 0 and walk.most <= 9 * 7


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs_equal_plain_trees(table, levels):
    draw = random.Random(3)
    data = [(i, f"text {i}\nline", "en", draw.choice(["hot", "hot", "hot", None, "b", "Z", "é", ""]), i, 7, "d", "h", 0.5, "l", True) for i in range(97)]
    data += [data[0], data[1], (None, None, None, None, None, *[None] * 6), (None, "x", None, "hot", None, *[None] * 6)]
    docs = table(data)
    assert shown(merkle.prove_documents(docs, levels=levels)) == plain_manifest(docs.collect())


def test_odd_rows_and_empty_tables(odd, empty, table):
    assert shown(merkle.prove_documents(odd)) == plain_manifest(odd.collect())
    assert merkle.prove_documents(empty).collect() == []
    one = merkle.prove_documents(table(rows(["only"]))).first()
    assert one["path"] == [] and one["leaf"] == one["subroot"] == one["root"]


def test_tampered_rows_are_told(spark, tmp_path):
    texts = ["a\nb", "a b", None, "", "\n", "c\n\nd", "plain"]
    data = rows(texts)
    (folder := tmp_path / "sf").mkdir()
    spark.createDataFrame(data, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    got = {r["doc_id"]: r for r in llm.op11_merkle_manifest(spark, str(folder)).collect()}
    plain = {r[0]: r for r in plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d, strict=False)) for d in data])}
    for i, text in enumerate(texts):
        broken = zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (text or "")
        assert got[i]["verified"] is not broken
        assert (got[i]["folded_root"] == got[i]["root"]) is not broken
        assert got[i]["proof_sha256"] == sha(*[a + b for a, b in plain[i][4]])
    assert {got[i]["verified"] for i in got} == {True, False}


# Secret scan

RANDOM = "x7Kp2QvR9mLw4TzB8nYc3HdF"


def plain_base(text):
    out = []
    patterns = [
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    ]
    for k, (pattern, group, least) in enumerate(patterns):
        at = 0
        while m := re.compile(pattern).search(text, at):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end()))
            at = m.end()
    return sorted(out)


def scan(docs):
    found = secret_scan.scan_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.collect()


def test_base_spans_equal_plain_search(table, odd):
    draw = random.Random(5)
    bits = ["token", "PassWord", "api_key", "APIKEY", "ſecret", "toKen", " ", ":", "=", "\"", "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef01234567", "deadbeef", "Zz9", "é", "😀", "\n", "-", "."]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(30))) for _ in range(400)]
    for docs in (table(rows(texts)), odd):
        by_id = defaultdict(list)
        for r in docs.collect():
            by_id[r["doc_id"]].append(secret_scan.named(plain_base(r["text"] or "")))
        got = defaultdict(list)
        for r in scan(docs):
            got[r["doc_id"]].append(r["base_spans"])
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(r["base_spans"].count(f"{k}:") for k in ("assign", "access", "hex"))
        assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in got.items()}


def test_random_strings_are_found_and_known_ones_left(table):
    clean = [
        "d41d8cd98f00b204e9800998ecf8427e", "550e8400-e29b-41d4-a716-446655440000", "international_business_machines_corporation", "2024-01-02/03/04/05/06/07/08",
        f"https://example.org/{RANDOM}/page", f"{RANDOM}@example.org", "A sentence of ordinary words without anything in it.", "configuration_value_12_of_application", "=" * 40, "short1A",
    ]
    dirty = [f"the key {RANDOM} here", f"😀 {RANDOM}", f"({RANDOM}==)", f"token: {RANDOM}"]
    got = {r["doc_id"]: r for r in scan(table(rows(clean + dirty)))}
    assert [got[i]["n_random"] for i in range(len(clean))] == [0] * len(clean)
    for i, text in enumerate(dirty, len(clean)):
        start = text.index(RANDOM)
        assert f"random:{start}:{start + len(RANDOM)}" in got[i]["spans"].split(",")
    last = got[len(clean) + 3]
    assert last["spans"] == f"assign:0:{7 + len(RANDOM)},random:7:{7 + len(RANDOM)}" and last["n_assign"] == 1


def test_scan_of_very_long_and_missing_texts(table, empty):
    text = "word " * 900_000 + "secret=abcdef" + " AKIA" + "Z9" * 10
    got = {r["doc_id"]: r for r in scan(table(rows([text, None, ""])))}
    assert got[0]["base_spans"] == f"assign:{4_500_000}:{4_500_013},access:{4_500_014}:{4_500_038}"
    assert got[1]["spans"] == got[2]["spans"] == ""
    assert scan(empty) == []


def test_query_hashes_base_spans(spark):
    got = llm.op12_secret_scan(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert r["base_sha256"] == sha(secret_scan.named(plain_base(texts[r["doc_id"]] or "")))
        assert all(s in r["spans"].split(",") for s in secret_scan.named(plain_base(texts[r["doc_id"]] or "")).split(",") if s)


# Ranked search


def plain_terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, k=20):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in plain_terms(text) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, r, x[3], x[4]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, k=20):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search_documents(docs, items, k).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ÉA", "漢字", "x2y"]
    texts = [" ".join(words[min(int(draw.expovariate(0.03)), 303)].upper() if draw.random() < 0.3 else words[min(int(draw.expovariate(0.03)), 303)] for _ in range(draw.randrange(0, 60))) for _ in range(700)]
    texts[5:40] = [texts[5]] * 35
    asked = [" ".join(words[min(int(draw.expovariate(0.02)), 303)] for _ in range(draw.randrange(1, 25))) for _ in range(40)]
    return texts, [*asked, asked[0], None, "", "nowhere", "w0 w0 w0"]


@pytest.mark.parametrize("batch", [17, 10_000])
@pytest.mark.parametrize("block", [60, 1_000_000])
def test_ranks_equal_plain_search(spark, table, corpus, monkeypatch, batch, block):
    texts, asked = corpus
    docs, items = table([*rows(texts), (None, texts[5], *[None] * 9), (None, None, *[None] * 9), (3, texts[3], *[None] * 9)]), spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = found(docs, items)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], list(enumerate(asked)))


def test_non_essential_lists_are_probed_only_for_candidates():
    draw = np.random.default_rng(2)
    common, rare = np.arange(1000), np.sort(draw.choice(1000, 12, replace=False))
    doc = np.concatenate([common, rare])
    term = np.concatenate([np.zeros(1000, np.int64), np.ones(12, np.int64)])
    impact = np.concatenate([draw.integers(1, 10, 1000), draw.integers(50, 60, 12)])
    shard = search.Shard(doc, term, impact, 1000)
    whole = np.zeros(1000, np.int64)
    np.add.at(whole, doc, impact * np.where(term == 0, 1, 2))
    for bar in (1, 5, 10, 100, 109, 119, 1000):
        at, scores, left = search.max_score(shard, [(0, 1), (1, 2)], bar)
        assert at.tolist() == np.flatnonzero(whole >= bar).tolist() and scores.tolist() == whole[whole >= bar].tolist()
        assert left == (0 if bar <= 9 else 1 if bar <= int(shard.bounds[1]) * 2 + int(shard.bounds[0]) else 2)


def test_search_of_empty_tables_and_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two WORD7"), (None, "漢字 null"), (1, "one two WORD7")], "item_id long, text string")
    assert found(empty, items) == []
    assert found(odd, items.where("false")) == []
    assert found(odd, items) == plain_search([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    renamed = odd.select("*", F.lit(1).alias("item"), F.lit(2).alias("n"), F.lit(3).alias("terms"))
    assert found(renamed, items) == found(odd, items)


def test_very_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(search, "BATCH_BYTES", 7)
    text = "Alpha beta42 gammaÉ delta_epsilon ... zeta" * 9
    assert [w.decode() for some in search.terms(text) for w in some] == plain_terms(text)
