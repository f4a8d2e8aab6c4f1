"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from flowframe.llm.bin_packing import pack_documents
from flowframe.llm.byte_bpe import ByteBpe, code_documents
from flowframe.llm.common import crc_of_id
from flowframe.llm.digest_index import DigestIndex
from flowframe.llm.language_id import fit_languages, label_documents
from flowframe.llm.lexical_search import search_documents
from flowframe.llm.merkle import COLUMNS, folded, leaf_of, path_digest, prove_documents
from flowframe.llm.multi_index import nearest
from flowframe.llm.ngram_join import join_documents
from flowframe.llm.prefix_free import remove_repeats
from flowframe.llm.quality import QualityModel, fit_quality, score_documents
from flowframe.llm.rendezvous import shard_documents
from flowframe.llm.secret_scan import scan_documents
from flowframe.llm.token_counts import count_tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(_docs(spark, sf_dir), in_files=True)


def op4_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_docs(spark, sf_dir), in_files=True)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    with DigestIndex(spark, expected=docs.count()) as index:
        return index.add_parts(docs)


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def _fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(crc_of_id(doc_id), F.lit(0)) % folds


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = _fold(F.col("doc_id"), 4) == 2
    model = fit_languages(docs.where(~held_out), "lang")
    found = label_documents(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = ByteBpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = code_documents(_docs(spark, sf_dir), codec, spans=True, decoded=True)
    spans = F.crc32(F.concat("char_starts", "char_ends")).alias("spans_crc32")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_inside", spans)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    """Learned from the labelled rows of ``docs`` outside the fold that is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(F.col("doc_id"), 3) != 1)
    return fit_quality(docs, labels, "quality")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scored = score_documents(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_docs(spark, sf_dir), shards=8)


#: The 256 steps of crc32, as a list in its one row ``crc(t)``.
_CRC_SQL = """steps AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8)"""


def _op9_sql(shards: int = 8) -> str:
    draw = "('0x' || substr(md5({}), 1, 13))::BIGINT"
    names = ", ".join(f"s{s}" for s in range(shards))
    scores = ", ".join(f"1.0 / -ln(({draw.format(f"key || '#{s}'")} + 0.5) / 4503599627370496.0) AS s{s}" for s in range(shards + 1))
    pick = " ".join(f"WHEN s{s} = greatest({names}) THEN {s}" for s in range(shards))
    return f"""
WITH RECURSIVE {_CRC_SQL}, bytes AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS data FROM documents
), rows AS (
  SELECT doc_id, key, len(data) + 1 AS size, xor(4294967295, list_reduce(list_transform(data, lambda x: ('0x' || x)::BIGINT),
         lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), 4294967295)) AS text_crc32
  FROM bytes, crc
), drawn AS (SELECT *, {draw.format('key')} AS hash, {scores} FROM rows),
placed AS (SELECT *, (CASE {pick} END)::INTEGER AS shard FROM drawn)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY hash // 1099511627776, text_crc32 % 16, hash, key, size, text_crc32) - 1 AS slot,
       (CASE WHEN s{shards} > greatest({names}) THEN {shards} ELSE shard END)::INTEGER AS grown_shard
FROM placed
"""



def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, held against rows of which some lost their line ends."""
    docs = _docs(spark, sf_dir)
    hit = F.coalesce(crc_of_id(F.col("doc_id")) % 2 == 0, F.lit(False))
    now = [F.when(hit, F.regexp_replace(c, "\n", "")).otherwise(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    proved = prove_documents(docs, carry={"now": leaf_of(*now)})
    made = proved.withColumns({"proof_sha256": path_digest(F.col("path")), "folded_root": folded(F.col("now"), F.col("path"))})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_SQL}, hit AS (
  SELECT *, coalesce(xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
         lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), 4294967295)) % 2 = 0, false) AS h FROM documents, crc
), leaves AS (
  SELECT source, doc_id, sha256({" || ".join(map(_field, COLUMNS))}) AS leaf,
         sha256({" || ".join(_field("CASE WHEN h THEN replace(text, chr(10), '') ELSE text END" if c == "text" else c) for c in COLUMNS)}) AS now FROM hit
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM leaves
), tree AS (
  SELECT 0 AS lvl, source, pos, leaf AS h, total AS n FROM placed
  UNION ALL
  SELECT lvl + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY lvl, source, pos // 3, n
), tops AS (
  SELECT source, lvl AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM tree WHERE n = 1
), forest AS (
  SELECT 0 AS lvl, place AS pos, subroot AS h, m AS n FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM forest WHERE n > 1 GROUP BY lvl, pos // 3, n
), sides AS (
  SELECT lvl, source, pos, n, string_agg(h, '' ORDER BY pos) OVER before AS l, string_agg(h, '' ORDER BY pos) OVER after AS r FROM tree WHERE n > 1
  WINDOW before AS (PARTITION BY lvl, source, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY lvl, source, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), upper AS (
  SELECT lvl, pos, string_agg(h, '' ORDER BY pos) OVER before AS l, string_agg(h, '' ORDER BY pos) OVER after AS r FROM forest WHERE n > 1
  WINDOW before AS (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), climb AS (
  SELECT source, pos AS row, pos AS spot, 0 AS lvl, now AS node, '' AS proof FROM placed
  UNION ALL
  SELECT c.source, row, spot // 3, c.lvl + 1, sha256(coalesce(l, '') || node || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '')
  FROM climb c JOIN sides s ON c.source IS NOT DISTINCT FROM s.source AND c.lvl = s.lvl AND c.spot = s.pos
), joined AS (
  SELECT c.source, row, place AS spot, 0 AS lvl, node, proof FROM climb c JOIN tops t ON c.source IS NOT DISTINCT FROM t.source AND c.lvl = t.height
  UNION ALL
  SELECT j.source, row, spot // 3, j.lvl + 1, sha256(coalesce(l, '') || node || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '')
  FROM joined j JOIN upper u ON j.lvl = u.lvl AND j.spot = u.pos
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source, (SELECT h AS root, lvl AS top FROM forest WHERE n = 1) f
JOIN joined j ON j.source IS NOT DISTINCT FROM p.source AND j.row = p.pos AND j.lvl = f.top
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms_sql(id_col: str, table: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"SELECT r, {id_col}, unnest({found}) AS term FROM (SELECT *, row_number() OVER () AS r FROM {table})"


OP13_SQL = f"""
WITH words AS MATERIALIZED ({_terms_sql("doc_id", "documents")}), asked AS MATERIALIZED ({_terms_sql("item_id", "benchmark")}),
lengths AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
counts AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term, docs),
shares AS (
  SELECT c.r, c.term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS share
  FROM counts c JOIN lengths l USING (r) JOIN weights USING (term), corpus
), scored AS (
  SELECT a.r AS item, a.item_id, s.r, any_value(s.doc_id) AS doc_id, sum(share)::BIGINT AS score FROM asked a JOIN shares s USING (term) GROUP BY a.r, a.item_id, s.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_multi_index": op2_multi_index,
    "op3_ngram_join": op3_ngram_join,
    "op4_prefix_free_dedup": op4_prefix_free_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bin_completion": op6_bin_completion,
    "op7_language_id": op7_language_id,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_rendezvous_sharding": op9_rendezvous_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_secret_scan": op12_secret_scan,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op9_rendezvous_sharding": _op9_sql(), "op11_merkle_manifest": OP11_SQL, "op13_lexical_search": OP13_SQL}
