"""Token counts of whole texts, huge ones by overlap resynchronisation.

A long text is encoded in overlapping chunks with offsets. Where two neighbouring chunks both begin a word (a match
of the pre-tokenizer) at the same character, and that character is far enough from the end of the first chunk, the
encodings agree with that of the whole text on either side, and the counts are spliced there:

* the first chunk begins at a word of the whole text; each match depends on what follows it only, by at most the
  length of the longest contraction or added token, so every word start before that margin is a word start of the
  whole text;
* from a common word start on, the second chunk is matched exactly as the whole text is.

If no common start lies in the overlap, the overlap is widened; if it reaches the last splice, the first chunk is.

Words are found by the pre-tokenizer's pattern and encoded by the library once while a worker keeps them; texts and
chunks with added tokens, or with characters on whose kind Unicode tables may differ, are encoded by the library as
they are.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import append_columns, documents
from flowframe.llm.words import Kept, Unassigned, WordIds

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
#: Fixed value: the pattern of a byte-level pre-tokenizer's words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def margin_of(definition: str) -> int | None:
    """Characters before a chunk's end whose word starts are not proven; None if the tokenizer allows no such proof."""
    d = json.loads(definition)
    before, model = d.get("pre_tokenizer") or {}, d.get("model", {})
    added = d.get("added_tokens") or []
    proven = (
        d.get("normalizer") is None and d.get("post_processor") is None and model.get("type") == "BPE" and not model.get("dropout")
        and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    )
    return max([4, *(len(t["content"]) + 1 for t in added)]) if proven else None


class Counter:
    """Counts tokens with one tokenizer; ``widened`` says how often an overlap had to grow."""

    def __init__(self, definition: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.margin = margin_of(definition)
        self.chunk, self.overlap, self.widened = max(2, chunk), max(1, overlap), 0
        self.added = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
        self.words, self.unassigned = regex.compile(WORD).findall, Unassigned()
        ids = WordIds(self.tokenizer.model)
        self.kept = Kept(lambda words: [len(x) // 4 for x in ids(words)])

    def _plain(self, text: str) -> bool:
        """Whether the text's words, encoded one by one, are the whole text's tokens."""
        return self.margin is not None and not any(t in text for t in self.added) and not self.unassigned(text)

    def _encoded(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where words start in text[start:end], and the tokens before each; the end comes last."""
        part = text[start:end]
        if self._plain(part):
            words = self.words(part)
            table = self.kept.of(words)
            begins = np.cumsum([start, *map(len, words)])
            return begins, np.cumsum([0, *map(table.__getitem__, words)])
        made = self.tokenizer.encode(part, add_special_tokens=False)
        words = np.array(made.word_ids, np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-1)) if len(words) else np.zeros(0, np.int64)
        begins = np.array([a for a, _ in made.offsets], np.int64)
        return np.append(begins[first] + start, end), np.append(first, len(words))

    def count_long(self, text: str) -> int:
        size, total, spliced = len(text), 0, 0
        end = min(size, self.chunk)
        starts, before = self._encoded(text, 0, end)
        while end < size:
            overlap = self.overlap
            proven = starts[(starts >= spliced) & (starts <= end - self.margin)]
            while True:
                begin, upto = max(spliced, end - overlap), min(size, end + self.chunk)
                following, tokens = self._encoded(text, begin, upto)
                common = np.intersect1d(proven, following[:-1])
                if begin == spliced or len(common := common[common > spliced]):
                    break
                overlap, self.widened = 2 * overlap, self.widened + 1
            at = int(common[-1]) if begin > spliced else spliced  # the chunk from the last splice on holds both
            total += int(before[np.searchsorted(starts, at)] - before[np.searchsorted(starts, spliced)])
            starts, before, end, spliced = following, tokens, upto, at
        return total + int(before[-1] - before[np.searchsorted(starts, spliced)])

    def count(self, texts: list[str]) -> list[int]:
        long = {i for i, t in enumerate(texts) if self.margin is not None and len(t) > self.chunk}
        plain = [i for i, t in enumerate(texts) if i not in long and self._plain(t)]
        split = [self.words(texts[i]) for i in plain]
        table = self.kept.of(set().union(*split))
        found = {i: sum(map(table.__getitem__, words)) for i, words in zip(plain, split, strict=True)}
        rest = [i for i in range(len(texts)) if i not in long and i not in found]
        found.update(zip(rest, map(len, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)), strict=True))
        return [self.count_long(t) if i in long else found[i] for i, t in enumerate(texts)]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row.

    Counts are those of the whole text under the tokenizer's defaults, without added begin or end tokens. Null texts
    are empty and have none. Tokenizers for which the proof above does not hold (see ``margin_of``) encode texts
    whole. Repeated rows are counted one by one; an empty table gives an empty result; other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()

    def make():
        counter = Counter(definition, chunk, overlap)
        return lambda texts: (counter.count(texts),)

    counted = append_columns(documents(docs, id_col, text_col), "text", [T.StructField("n_tokens", T.LongType())], make)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
