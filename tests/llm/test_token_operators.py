"""Token counts, byte-level BPE and packing against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowframe.llm import bin_packing as B
from flowframe.llm.byte_bpe import ByteBpe, char_spans, code_documents, decode_documents
from flowframe.llm.token_counts import Counter, count_tokens, margin_of

ALPHABET = [*"abcdefgh ABE  \n\t'srtve019.,!?-é漢😀́ΣİÅ\x1c\x85", "the ", "'re", "<|endoftext|>", "ing ", "a" * 30, " " * 12]
#: Texts around every character below 0x3000, every later block's first ones, and some that newer tables assign.
POINTS = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'{chr(c)}s" for c in [*range(0x3000), *range(0x3000, 0x110000, 97), 0xA7CE, 0x107BB, 0x10EC2, 0x3347A] if not 0xD800 <= c < 0xE000]


def strings(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.from_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize(("chunk", "overlap"), [(25, 2), (40, 8), (120, 30)])
def test_spliced_counts_are_whole_counts(chunk, overlap):
    definition = open(P.path("byte_bpe_50k.json")).read()
    counter, whole = Counter(definition, chunk, overlap), Tokenizer.from_str(definition)
    texts = strings(400, 150)
    assert counter.count(texts) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.widened > 0


def test_text_without_any_boundary_is_still_counted():
    definition = open(P.path("byte_bpe_50k.json")).read()
    text = "a" * 5000 + "b" * 3000
    assert Counter(definition, 100, 10).count([text]) == [len(Tokenizer.from_str(definition).encode(text).ids)]


def test_tokenizers_without_proof_encode_whole():
    assert margin_of(open(P.path("byte_bpe_50k.json")).read()) > 4 and margin_of(open(P.path("word_bpe_49k.json")).read()) is None


def test_counts_of_odd_rows(odd, empty):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in count_tokens(odd, P.path("byte_bpe_50k.json"), chunk=5000, overlap=50).collect())
    texts = [r["text"] or "" for r in odd.collect()]
    assert got == sorted((len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_bpe_equals_tiktoken(bpe):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    model, ours = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.coder()
    texts = [*strings(1500, 120), "a" * 9000, " " * 900, "\0", "a\0\0b \0c", *POINTS]
    ours.kept.most = 3000
    for i in range(0, len(texts), 500):
        for text, data in zip(some := texts[i : i + 500], ours.encode(some), strict=True):
            ids = np.frombuffer(data, "<u4").tolist()
            assert ids == model.encode_ordinary(text) and ours.decode(ids) == text.encode()


def test_counts_of_every_kind_of_character():
    definition = open(P.path("byte_bpe_50k.json")).read()
    counter, whole = Counter(definition, 25, 8), Tokenizer.from_str(definition)
    texts = [*POINTS, "a\0\0b \0c", *("".join(POINTS[i : i + 9]) for i in range(0, len(POINTS), 9))]
    assert counter.count(texts) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_spans_and_split_characters(bpe):
    text, coder = "héllo 漢😀 x", bpe.coder()
    ids = np.frombuffer(coder.encode([text])[0], "<u4")
    starts, ends = char_spans(text, ids, coder.lengths)
    assert starts[0] == 0 and ends[-1] == len(text) and all(a < b for a, b in zip(starts, ends, strict=True))
    assert "".join(coder.decode_pieces(ids.tolist())) == text and len(ids) > len({*zip(starts, ends, strict=True)})
    assert coder.inside[ids].sum() == sum(text.encode()[:b].decode(errors="ignore").encode() != text.encode()[:b] for b in np.cumsum(coder.lengths[ids])) > 0
    broken = [i for i in range(256) if coder.tokens[i] == b"\xe6"]
    assert coder.decode_pieces(broken) == ["", "�"]


def test_coded_rows(odd, empty, bpe):
    coded = code_documents(odd, bpe, spans=True, decoded=True)
    for r in decode_documents(coded, bpe).collect():
        assert r["decoded"] == r["decoded_bytes"] and r["decoded_text"].encode() == bytes(r["decoded"]) and len(r["ids"]) == 4 * r["n_tokens"] == len(r["char_starts"]) == len(r["char_ends"])
    assert sorted(bytes(r["decoded"]) for r in coded.collect()) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert code_documents(empty, bpe).count() == 0


def test_words_encode_like_whole_texts():
    encoder = B.WordwiseEncoder(open(P.path("word_bpe_49k.json")).read())
    texts = strings(1500, 120) + [f"A{chr(c)}b {chr(c)}'S{chr(c)} Σ{chr(c)}x" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert encoder.separable and encoder.encode(texts) == encoder.whole(texts)
    B.CACHE_WORDS, kept = 50, B.CACHE_WORDS
    for i in range(0, len(texts), 300):
        assert encoder.encode(texts[i : i + 300]) == encoder.whole(texts[i : i + 300])
    B.CACHE_WORDS = kept


def test_added_tokens_in_other_cases_are_plain_words():
    encoder = B.WordwiseEncoder(open(P.path("word_bpe_49k.json")).read())
    marks = [m for t in ("<|startoftext|>", "<|endoftext|>") for m in (t, t.upper(), t.title(), t[:3] + t[3].upper() + t[4:])]
    rng = random.Random(2)
    texts = [*marks, "<|ENDOFTEXT|> 漢", "a<|EndOfText|>b É", "<|ENDOFTEXT|><|endoftext|>Ab"]
    texts += ["".join(rng.choices([*marks, "Ab", " ", "É", "x", "!", "漢", "<|", "|>"], k=rng.randint(1, 12))) for _ in range(500)]
    assert encoder.separable and encoder.encode(texts) == encoder.whole(texts)


def test_very_long_texts_are_read_piece_by_piece(monkeypatch, bpe):
    from flowframe.llm import byte_bpe, common, ngram_join, quality

    texts = ["".join(strings(40, 120, seed)) + " word again" * 5 for seed in range(8)] + ["", "short"]
    coder, encoder, hashes = bpe.coder(), B.WordwiseEncoder(open(P.path("word_bpe_49k.json")).read()), common.WordHashes()
    whole = coder.encode(texts), encoder.whole(texts), [(ngram_join.ngrams(t, 5, hashes).tolist(), quality.features(t, hashes).tolist()) for t in texts]
    for module in (common, byte_bpe):
        monkeypatch.setattr(module, "LONG_CHARS", 100)
    monkeypatch.setattr(common, "PIECE", 7)
    monkeypatch.setattr(B, "LONG_CHARS", 100)
    assert (coder.encode(texts), encoder.encode(texts, 100), [(ngram_join.ngrams(t, 5, hashes).tolist(), quality.features(t, hashes).tolist()) for t in texts]) == whole
    assert encoder.encode([t.replace("\x1c", " ") for t in texts], 100) == encoder.whole([t.replace("\x1c", " ") for t in texts])


def fewest(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_bins_are_as_few_as_possible():
    rng, better = random.Random(3), 0
    for low, high, most in [(1, 50, 10)] * 150 + [(11, 26, 9)] * 250:
        sizes = [rng.randint(low, high) for _ in range(rng.randint(1, most))]
        bins = B.complete_bins(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 50 for b in bins)
        assert len(bins) == fewest(sizes, 50)
        better += len(bins) < len(B.best_fit(sorted(sizes, reverse=True), 50))
    assert better, "the search improves on best fit somewhere"


def test_bins_that_need_other_fillings_than_the_first_ones():
    for capacity, least, sizes in [
        (200, 3, [1, 17, 19, 21, 28, 56, 66, 70, 94, 99, 129]),
        (200, 3, [3, 9, 12, 19, 21, 21, 24, 29, 43, 54, 118, 121, 126]),
        (100, 3, [2, 5, 6, 7, 8, 11, 12, 19, 34, 45, 63, 88]),
        (100, 3, [4, 6, 21, 22, 22, 30, 31, 48, 51, 65]),
    ]:
        bins = B.complete_bins(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) == least


def test_packing_a_table_that_best_fit_does_not(spark):
    """Through the operator: the search needs three sequences where best fit needs four."""
    lengths = [1, 17, 19, 21, 28, 56, 66, 70, 94, 99, 129]
    assert len(B.best_fit(sorted(lengths, reverse=True), 200)) == 4
    packed = B.pack_pieces(spark.createDataFrame([(x,) for x in lengths], "length long"), 200).toPandas()
    assert packed.sequence_id.nunique() == 3 and sorted(packed.length) == lengths and packed.groupby("sequence_id").length.sum().max() <= 200


def test_the_query_packs_better_than_best_fit(spark, tmp_path):
    """Documents of these lengths need four sequences by best fit; the query's search finds the three that they fill."""
    lengths = [2332, 1140, 624, 483, 562, 3051, 1842, 93, 1182, 979]
    assert len(B.best_fit(sorted(lengths, reverse=True), 4096)) == 4 and sum(lengths) == 3 * 4096
    from flowframe.llm import queries as Q

    spark.createDataFrame([(i, "a " * (n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    packed = Q.op6_bin_completion(spark, str(tmp_path)).toPandas()
    assert packed.sort_values("doc_id").length.tolist() == lengths
    assert packed.sequence_id.nunique() == 3 and (packed.groupby("sequence_id").length.sum() == 4096).all()


def test_a_search_without_a_bound_ends_with_the_fewest_bins(spark):
    rng = random.Random(12)
    for _ in range(60):
        sizes = [rng.randint(11, 26) for _ in range(rng.randint(1, 9))]
        assert len(B.complete_bins(sizes, 50, nodes=None)) == fewest(sizes, 50)
    hard = [1, 17, 19, 21, 28, 56, 66, 70, 94, 99, 129]
    rows = spark.createDataFrame([(x,) for x in hard], "length long")
    assert len(B.complete_bins(hard, 200, nodes=-len(hard))) == 4  # no node: best fit
    assert B.pack_pieces(rows, 200, nodes=None).select("sequence_id").distinct().count() == 3


def test_added_tokens_in_other_cases_through_the_query(spark, tmp_path):
    from flowframe.llm import queries as Q

    marks = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>x", "y<|STARTOFTEXT|>", "<|endoftext|>", "É <|ENDOFTEXT|>", "<|endoftext|><|ENDOFTEXT|> Ab"]
    spark.createDataFrame(list(enumerate(marks)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in Q.op6_bin_completion(spark, str(tmp_path)).collect():
        ids = np.array([*tokenizer.encode(marks[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_fillings_are_undominated():
    sizes, counts = np.array([2, 3, 5, 8]), np.array([2, 1, 1, 1])
    assert B.fillings(sizes, counts, 8) == [(3,)] and B.fillings(sizes, counts, 1) == [()]
    made = B.fillings(sizes, counts, 7)
    assert made[0] in ((2, 0), (1, 0, 0)) and all(sum(sizes[list(f)]) <= 7 for f in made)


def test_packed_documents(odd, empty):
    path, cap = P.path("word_bpe_49k.json"), 512
    tokenizer = Tokenizer.from_file(path)
    rows = B.pack_documents(odd, path, cap).toPandas()
    pieces = []
    for r in odd.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(-1 if r["doc_id"] is None else r["doc_id"], s // cap, s, len(ids[s : s + cap]), zlib.crc32(ids[s : s + cap].tobytes())) for s in range(0, len(ids), cap)]
    made = rows.assign(doc_id=rows.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, made.to_numpy().tolist())) == sorted(pieces)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= cap and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // cap)
    assert B.pack_documents(empty, path, cap).count() == 0


def test_queries_over_a_whole_table(spark, bpe):
    from flowframe.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts = Q.op1_token_counts(spark, sf).collect()
    assert len(counts) == len(texts)
    for r in counts:
        n = len(whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)
    for r in Q.op8_byte_bpe(spark, sf).collect():
        ids = np.array(model.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        data, at, spans = texts[r["doc_id"]].encode(), 0, ([], [])
        for i in ids.tolist():
            end = at + len(model.decode_single_token_bytes(i))
            spans[0].append(len((data[:at] + b"?").decode(errors="ignore")) - 1)  # of the character that the byte is in
            spans[1].append(len((data[: end - 1] + b"?").decode(errors="ignore")))
            at = end
        assert r["spans_crc32"] == zlib.crc32(np.array(spans, "<u4").tobytes())
    packed = Q.op6_bin_completion(spark, sf)
    assert packed.select("doc_id").distinct().count() == len(texts)
    total, used = packed.agg(F.sum("length")).first()[0], packed.select("sequence_id").distinct().count()
    assert used <= -(-total // 4096) + 1


def test_a_worker_keeps_only_what_its_operator_uses():
    from flowframe.llm import common

    made = B._encoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    common.free_others(B.__name__)
    assert B._encoder.cache_info().currsize == 1 and made.encode(["a"])
    common.free_others("another")
    assert B._encoder.cache_info().currsize == 0
