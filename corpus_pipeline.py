"""The corpus pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; the last returns the pieces of the packed
sequences. ``docs`` are read from Parquet files; rows are told apart by their file and place in it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm.bin_packing import pack_documents
from flowframe.llm.common import fresh_name, with_rows
from flowframe.llm.digest_index import DigestIndex
from flowframe.llm.ngram_join import keep_one_of_each
from flowframe.llm.prefix_free import remove_repeats
from flowframe.llm.quality import keep_good
from flowframe.llm.queries import quality_model
from flowframe.sources.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (a score below one half).

    Null and empty texts get the score of the model's bias; repeated rows go or stay together.
    """
    return keep_good(docs, quality_model(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those whose texts differ in white space only: the longest, then the smallest doc_id.

    Null and empty texts are equal; of rows alike in length and id, one stays.
    """
    row = fresh_name(docs, "row")
    rows = with_rows(docs, True, row)
    with DigestIndex(spark, expected=docs.count()) as index:
        dropped = index.add_parts(rows, carry=row).where("not kept").select(row)
    return rows.join(staged(dropped, "dropped"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that hangs together by five-word Jaccard similarities of 0.8 or more.

    The smallest doc_id stays, nulls last, of rows with one id any. Texts without words are in no group.
    """
    return keep_one_of_each(docs, in_files=True)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of 200-byte strings that occur more than once; every document stays.

    Characters that lose some of their bytes go as a whole. ``n_chars`` follows the text; null texts stay null. Equal
    rows are copies of each other.
    """
    whole = fresh_name(docs, "whole")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.withColumn(whole, F.struct(*others, F.col("text").isNull().alias(whole), F.col("n_chars").alias("n_chars")))
    found = remove_repeats(rows, id_col=whole, as_text=True, in_files=True)
    text = F.when(~F.col(f"doc_id.{whole}"), F.col("kept"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("doc_id.n_chars").cast("long"))
    made = {"text": text, "n_chars": chars}
    return found.select(*[made.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens; a row for each piece.

    Null and empty texts are a piece of one token, the end id; every row is packed, repeated ones too. An empty table
    gives no piece.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: A trained classifier and tokenizers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
