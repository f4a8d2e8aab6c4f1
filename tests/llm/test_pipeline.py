"""The pipeline's stages on whole tables and on odd rows."""

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from flowframe.llm import ngram_join as N
from flowframe.llm.common import WordHashes

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_do_their_work(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = {"input": docs.collect()}, docs.columns
    for name, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, SF), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"]}
    judged = [(labels[r["doc_id"]], r["doc_id"] in kept) for r in seen["input"] if r["doc_id"] in labels]
    bad = [k for y, k in judged if y == 0]
    assert all(k for y, k in judged if y == 1) and sum(bad) <= 0.3 * len(bad)  # about sixty labels teach it here
    bare = ["".join(r["text"].translate({c: None for c in (9, 10, 11, 12, 13, 32)})) for r in seen["exact_dedup"]]
    assert len(bare) == len(set(bare)) == len({"".join(r["text"].translate({c: None for c in (9, 10, 11, 12, 13, 32)})) for r in seen["quality"]})
    hashes = WordHashes()
    sets = [set(N.ngrams(r["text"], 5, hashes).tolist()) for r in seen["near_dedup"]]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a)
    assert len(seen["suffix_dedup"]) == len(seen["near_dedup"])
    data = [r["text"].encode() for r in seen["near_dedup"]]
    whole = {r["doc_id"]: len(r["text"].encode()) for r in seen["near_dedup"]}
    assert all(len(r["text"].encode()) <= whole[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in seen["suffix_dedup"]) and data
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["suffix_dedup"])
    assert sum(r["length"] for r in seen["packing"]) == tokens
    assert len({r["sequence_id"] for r in seen["packing"]}) <= -(-tokens // 4096) + 1
    assert np.array([r["length"] for r in seen["packing"]]).max() <= 4096


def test_odd_rows_pass_every_stage(spark, odd, empty):
    for start in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd, empty):
        docs = start
        for name, stage in C.STAGES:
            docs = C.staged(stage(spark, docs, SF), name)
            assert name == "packing" or docs.columns == start.columns
        docs.count()
