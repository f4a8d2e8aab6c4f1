"""Byte-level BPE from a file of ranks, by the tokenizers library over Arrow batches.

A text is cut into the matches of a pattern; the distinct matches of a batch are mapped from bytes to characters and
encoded by the library, once while a worker keeps them, and each text's ids are joined from its matches. Decoding maps
the characters of the ids' tokens back through the reversed byte table. A token may begin or end inside a character:
spans then take the whole character, and texts are decoded token by token with what is left over carried along.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowframe.llm.common import LONG_CHARS, append_columns, documents, matches
from flowframe.llm.words import Kept, WordIds


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + spare)
            spare += 1
    return [table[b] for b in range(256)]


@dataclass(frozen=True)
class ByteBpe:
    """A byte-level vocabulary: the tokenizers definition (its model only), and the pattern of a word."""

    definition: str
    pattern: str

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> ByteBpe:
        """Reads base64 token and rank a line. Any two tokens whose bytes join to a token merge, lowest rank first."""
        from tokenizers import Tokenizer, models

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        chars = byte_characters()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[a], shown[b]) for a, b in sorted(cuts, key=lambda c: (ranks[c[0]], ranks[c[1]]))]
        made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        return cls(made.to_str(), pattern)

    def coder(self) -> ByteCoder:
        from tokenizers import Tokenizer

        return ByteCoder(Tokenizer.from_str(self.definition), self.pattern)


class ByteCoder:
    """Encodes and decodes with a byte-level vocabulary; keeps the words it meets."""

    def __init__(self, tokenizer, pattern: str):
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern may only have groups that do not capture")
        self.kept = Kept(WordIds(tokenizer.model))
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = tokenizer.get_vocab()
        self.tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        #: Tokens that begin inside a character of a text.
        self.inside = np.array([len(t) > 0 and t[0] & 0xC0 == 0x80 for t in self.tokens], bool)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids (little-endian unsigned 32-bit) of whole texts."""
        short = [t if len(t) <= LONG_CHARS else "" for t in texts]
        split = [self.pattern.findall(t) for t in short]
        table = self.kept.of(set().union(*split))
        out = [b"".join(map(table.__getitem__, words)) for words in split]
        for i, text in enumerate(texts):
            if len(text) > LONG_CHARS:
                out[i] = b"".join([b"".join(map(self.kept.of(words).__getitem__, words)) for words in matches(self.pattern, text)])
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids. Unknown ids raise IndexError."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_pieces(self, ids: Iterable[int]) -> list[str]:
        """The text that each id completes: an id that ends inside a character gives what was complete before it."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.tokens[i]) for i in ids] + [x for x in [reader.decode(b"", True)] if x]


def char_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token; a token that holds part of a character spans all of it."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    of_byte = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    return of_byte[starts], of_byte[ends - 1] + 1


def code_documents(docs: DataFrame, codec: ByteBpe, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, n_inside, ids`` for every row; ``ids`` is little-endian unsigned 32-bit integers.

    ``n_inside`` counts the tokens that begin inside a character. ``spans`` adds ``char_starts`` and ``char_ends``,
    each token's first and one-past-last character, packed like the ids; ``decoded`` the bytes that the ids decode to. Null and empty texts have no ids. Whole texts are
    encoded, however long; repeated rows are coded alike, and characters that the pattern leaves out are left out.
    Other columns are ignored; an empty table gives an empty result.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_inside", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField(n, T.BinaryType()) for n in ("char_starts", "char_ends") if spans]
    fields += [T.StructField("decoded", T.BinaryType())] * decoded

    def make():
        coder = codec.coder()

        def run(texts: list[str]) -> list:
            packed = coder.encode(texts)
            ids = [np.frombuffer(x, "<u4") for x in packed]
            out: list = [[len(x) for x in ids], [int(coder.inside[x].sum()) for x in ids], packed]
            if spans:
                both = [char_spans(t, x, coder.lengths) for t, x in zip(texts, ids, strict=True)]
                out += [[x[k].astype("<u4").tobytes() for x in both] for k in (0, 1)]
            if decoded:
                out.append([coder.decode(x.tolist()) for x in ids])
            return out

        return run

    return append_columns(documents(docs, id_col, text_col), "text", fields, make).drop("text")


def decode_documents(coded: DataFrame, codec: ByteBpe, ids_col: str = "ids") -> DataFrame:
    """``coded`` with the bytes (``decoded_bytes``) and the text (``decoded_text``, broken characters replaced) of its ids.

    Null ids give empty results.
    """
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded_bytes", T.BinaryType()), T.StructField("decoded_text", T.StringType())])
    at = coded.columns.index(ids_col)

    def run(batches):
        coder = codec.coder()
        for batch in batches:
            data = [coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(at).to_pylist()]
            new = [pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return coded.mapInArrow(run, schema)
