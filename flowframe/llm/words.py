"""Ids of the words that a byte-level pre-tokenizer cuts a text into, each word encoded once and kept while it is used."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

#: Characters of the words that a worker keeps before it sets them aside; those set aside last are kept as well.
CACHE_CHARS = 2_000_000
#: Words encoded as one text.
GROUP = 1000
#: Fixed value: the character put between words that are encoded together; it is one token by itself.
BETWEEN = "\0"


class Kept:
    """Values of words, made many at once. Words used again outlive a generation, others are made again."""

    def __init__(self, make: Callable[[list[str]], Iterable], most: int = CACHE_CHARS):
        self.make, self.most, self.size = make, most, 0
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: Iterable[str]) -> dict:
        """A table that holds these words, and others."""
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        wanted = set(words).difference(self.young)
        again = wanted.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        fresh = list(wanted - again)
        self.young.update(zip(fresh, self.make(fresh), strict=True))
        self.size += sum(map(len, wanted))
        return self.young


class WordIds:
    """Packed ids (little-endian unsigned 32-bit) of single words by a byte-level model of the tokenizers library."""

    def __init__(self, model):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        to_characters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole, self.bare = Tokenizer(model), Tokenizer(model)
        self.whole.pre_tokenizer = to_characters
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(BETWEEN, "isolated"), to_characters])
        between = self.whole.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def _together(self, words: list[str]) -> list[bytes]:
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        out: list[bytes] = []
        for made in self.bare.encode_batch_fast([BETWEEN.join(g) for g in groups], add_special_tokens=False):
            ids = np.array(made.ids, "<u4")
            cuts = (np.flatnonzero(ids == self.between) * 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words that hold BETWEEN are encoded alone."""
        alone = {w: b"" for w in words if self.between is None or BETWEEN in w}
        for made, word in zip(self.whole.encode_batch_fast(list(alone), add_special_tokens=False), alone, strict=True):
            alone[word] = np.array(made.ids, "<u4").tobytes()
        rest = iter(self._together([w for w in words if w not in alone] if alone else words))
        return [alone[w] if w in alone else next(rest) for w in words]


class Unassigned:
    """Tells texts with characters that this interpreter's Unicode tables do not assign: libraries disagree on their kind."""

    def __init__(self):
        self.known: set[str] = set()

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return False
        fresh = set(text) - self.known
        self.known.update(c for c in fresh if unicodedata.category(c) != "Cn")
        return not fresh <= self.known
