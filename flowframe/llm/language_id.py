"""Language identification by compression.

Text of each language primes a zstandard compressor as a raw-content dictionary; a text belongs to the language
whose dictionary lets it be written shortest. Narrow margins are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import append_columns, documents

#: Bounds of the sample that is learned from, per language: documents, and bytes of the dictionary.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES = 400, 96 * 1024
#: Characters compressed at once; texts are compressed whole, block after block, each block with a fresh dictionary.
BLOCK_CHARS = 2048
LEVEL = 6
#: A lead over the second language, as a share of its bytes, below which the answer is not accepted.
MIN_MARGIN = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, the language with most learned rows first (ties: by name)."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = LEVEL

    def classifier(self):
        """A function from texts to (language, score, accepted) lists."""
        names = [name for name, _ in self.dictionaries]
        coders = []
        for _, content in self.dictionaries:
            primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=self.level)
            coders.append(zstandard.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_dict_id=False))

        def classify(texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
            languages, scores, accepted = [], [], []
            for text in texts:
                if not names or not _LETTER.search(text):
                    languages.append(UNKNOWN), scores.append(0.0), accepted.append(False)
                    continue
                blocks = [text[i : i + BLOCK_CHARS].lower().encode("utf-8", "replace") for i in range(0, len(text), BLOCK_CHARS)]
                sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])
                order = np.argsort(sizes, kind="stable")
                margin = 1.0 if len(names) == 1 else 1.0 - sizes[order[0]] / sizes[order[1]]
                languages.append(names[order[0]]), scores.append(float(margin)), accepted.append(bool(margin >= MIN_MARGIN))
            return languages, scores, accepted

        return classify


def _equal_share(sizes: list[int], room: int) -> int:
    """The most that each of ``sizes`` may count for so that their sum stays within ``room``."""
    for done, size in enumerate(sorted(sizes)):
        share = room // (len(sizes) - done)
        if size > share:
            return share
        room -= size
    return max(sizes, default=0)


def fit_languages(docs: DataFrame, lang: Column | str, text_col: str = "text", sample_documents: int = SAMPLE_DOCUMENTS, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """Dictionaries from a bounded sample: for each language the ``sample_documents`` texts with the smallest hash, equal
    texts once. Their beginnings are joined to ``dictionary_bytes``: the same number of bytes of each, or all of shorter
    texts, but no more than an eighth of ``dictionary_bytes`` characters.

    Rows without a language or without text are not learned from. No rows give a model that answers ``und``.
    """
    lang = docs[lang] if isinstance(lang, str) else lang
    rows = docs.select(lang.alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and length(text) > 0")
    rows = rows.select("lang", F.xxhash64("text").alias("hash"), "text")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return LanguageModel(())
    # Of each language about four times the sample is shuffled, whatever the table's size; the rank picks from that.
    slots = 1 << 30
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(slots, slots * 4 * sample_documents // r["texts"] + 1))])
    few = rows.where(F.pmod("hash", F.lit(slots)) < share[F.col("lang")])
    few = few.groupBy("lang", "hash").agg(F.min(F.substring("text", F.lit(1), F.lit(dictionary_bytes // 8))).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= sample_documents).collect()
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for row in chosen:
        parts.setdefault(row["lang"], []).append((row["rank"], row["text"].lower().encode("utf-8", "replace")))
    made = []
    for name in sorted(parts, key=lambda k: (-counts[k], k)):
        texts = [t for _, t in sorted(parts[name])]
        each = _equal_share([len(t) + 1 for t in texts], dictionary_bytes + 1)  # with the line end that follows
        made.append((name, b"\n".join(t[: max(1, each - 1)] for t in texts)[:dictionary_bytes]))
    return LanguageModel(tuple(made))


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """``docs`` with the language, its margin (0 to 1) and whether the margin is wide enough.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the language with most learned rows. The
    whole text counts, however long.
    """
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return append_columns(docs, text_col, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], model.classifier)


def label_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every row, repeated ones too; see ``predict_languages``.

    Null texts and texts without a letter are ``und``; an empty table gives an empty result; other columns are ignored.
    """
    return predict_languages(documents(docs, id_col, text_col), model).drop("text")
