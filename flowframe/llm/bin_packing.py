"""Packing tokenised documents into sequences by bin completion.

Documents become pieces of at most one sequence. Pieces are dealt into blocks of bounded size; in each block a
branch-and-bound search completes bins around the largest piece left: it prunes branches whose waste leaves no room for
an improvement and starts from the best-fit-decreasing packing as its incumbent. It first tries a few good fillings of
each bin, least waste first, then all that no other filling dominates, until a number of nodes is used up. Bins that stay poorly filled are dealt anew and packed again, so that
blocks do not each leave a partly filled bin.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import KEPT, LONG_CHARS, TEXT_ROWS, append_columns, documents
from flowframe.sources.staging import staged

SEQUENCE_TOKENS, END_ID = 4096, 1
#: Pieces of a block on average, and search nodes spent on a block before the incumbent is taken.
BLOCK_PIECES, NODES = 4096, 4000
#: Pairs of pieces that alternatives for a bin start from in the first search; the second tries all.
BRANCHES = 6
#: Words that a worker has at hand with their ids before it sets them aside; it keeps those set aside last.
CACHE_WORDS = 250_000

#: White space for str.split that is none for the tokenizer: such texts are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")
#: ASCII punctuation that starts no contraction and no added token.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Letters that normalisation only lowers.
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _lowered(text: str) -> str:
    """The text in lower case where that is all that normalisation does to its letters, else as it is."""
    try:
        return text.lower() if text.isascii() or text.encode("latin-1") else text
    except UnicodeEncodeError:
        return text


class WordwiseEncoder:
    """Packed ids of whole texts by a tokenizer that never looks across white space.

    ``separable`` says whether the tokenizer drops white space between words and has no added token with a space;
    only then is a text encoded by its words, which repeat, else as a whole.
    """

    def __init__(self, definition: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        d = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.bare = Tokenizer(self.tokenizer.model)  # the same model, for lowered letters, which are one match of the pre-tokenizer
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), d.get("model", {}).get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        before = d.get("pre_tokenizer") or {}
        first = (before.get("pretokenizers") or [before])[0]
        kinds = [n["type"] for n in (d.get("normalizer") or {}).get("normalizers", [])]
        self.separable = (
            first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed"
            and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
            and len(before.get("pretokenizers") or []) == 2 and before["pretokenizers"][1].get("type") == "ByteLevel"
            and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"} and d.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in d.get("added_tokens") or [])
        )
        self.added = [t["content"].lower() for t in d.get("added_tokens") or []]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _read(self, text: str) -> str:
        """The text lowered, unless that may make or break an added token: these are looked for before normalisation."""
        low = _lowered(text)
        return text if any(t in low for t in self.added) else low

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of lowered letters: many at once, told apart by the tokens that end a word."""
        out: list[bytes] = []
        groups = [words[i : i + 100] for i in range(0, len(words), 100)]
        for group, made in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] if len(cuts) == len(group) else self.whole(group)
        return out

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of these words, and of others. Of the words that are kept, those used again outlive a generation."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        split, odd, letters = [], set(), set()
        for word in words.difference(young):
            ids = old.get(word)
            if ids is not None:
                young[word] = ids
                continue
            core = word.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or _LATIN.fullmatch(core)):
                low, rest = core.lower(), word[len(core) :]
                letters.add(low)
                if low != word:
                    split.append((word, low, rest))
                    odd.add(rest)
            else:
                odd.add(word)
        for some, encoded in ((letters, self._letters), (odd, self.whole)):
            some = some.difference(young)
            young.update((w, ids) for w in some if (ids := old.get(w)) is not None)
            fresh = list(some.difference(young))
            young.update(zip(fresh, encoded(fresh), strict=True))
        young.update([(word, young[low] + young[rest]) for word, low, rest in split])
        return young

    def _long(self, text: str) -> bytes:
        """The ids of a very long text, from slices that begin at white space."""
        out, start = [], 0
        while start < len(text):
            space = _SPACE.search(text, min(len(text), start + LONG_CHARS))
            end = space.start() if space else len(text)
            out += self.encode([text[start:end]], LONG_CHARS + len(text))
            start = end
        return b"".join(out)

    def encode(self, texts: list[str], most: int = LONG_CHARS) -> list[bytes]:
        """The packed ids of whole texts; those of more than ``most`` characters are sliced where words are separable."""
        long = {i: self._long(t) for i, t in enumerate(texts) if len(t) > most and self.separable and not _ODD_SPACE.search(t)}
        if long:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in long], max(map(len, texts))))
            return [long[i] if i in long else next(rest) for i in range(len(texts))]
        odd = [i for i, t in enumerate(texts) if not self.separable or _ODD_SPACE.search(t)]
        out = dict(zip(odd, self.whole([texts[i] for i in odd]), strict=True))
        split = {i: self._read(t).split() for i, t in enumerate(texts) if i not in out}
        table = self._words(set().union(*split.values()))
        for i, words in split.items():
            out[i] = b"".join(map(table.__getitem__, words))
        return [out[i] for i in range(len(texts))]


@lru_cache(maxsize=1)
def _encoder(definition: str) -> WordwiseEncoder:
    """One encoder for all tasks of a worker process, which so keeps its words from task to task."""
    return WordwiseEncoder(definition)


KEPT[__name__] = _encoder


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the documents' ids and the end id, cut where longer than ``capacity``.

    Null and empty texts are one piece that holds the end id only. Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = _encoder(definition)

        def run(texts: list[str]) -> tuple[list]:
            out = []
            for ids in encoder.encode(texts):
                ids += end
                out.append([{"start": s // 4, "length": len(part := ids[s : s + 4 * capacity]) // 4, "ids_crc32": zlib.crc32(part)} for s in range(0, len(ids), 4 * capacity)])
            return (out,)

        return run

    piece = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    cut = append_columns(documents(docs, id_col, text_col), "text", [T.StructField("pieces", T.ArrayType(piece))], make)
    return cut.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions by best fit; ``sizes`` descend."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        insort(room, (free - size, b))
    return bins


def fillings(sizes: np.ndarray, counts: np.ndarray, room: int, branches: int = BRANCHES) -> list[tuple[int, ...]]:
    """A few undominated fillings of ``room``, least waste first, as indexes into ``sizes`` (ascending, distinct).

    A single piece that fits exactly dominates everything; a filling whose pieces fit into the pieces of another,
    one each or together into one, is dominated by it.
    """
    have = np.flatnonzero(counts > 0)
    have = have[: np.searchsorted(sizes[have], room, side="right")]
    if not len(have):
        return [()]
    top = int(have[-1])
    if sizes[top] == room:
        return [(top,)]
    s = sizes[have]
    second = np.searchsorted(s, room - s, side="right") - 1
    second = np.minimum(second, np.arange(len(s)))
    second -= (second == np.arange(len(s))) & (counts[have] < 2)
    ok = second >= 0
    sums = np.where(ok, s + s[second], 0)
    sums[sums <= s[-1]] = 0  # fits into the largest single piece
    best = np.argsort(-sums, kind="stable")[:branches]
    made: list[tuple[int, ...]] = [(top,)]
    for k in best[sums[best] > 0]:
        chosen = [int(have[k]), int(have[second[k]])]
        made.append(tuple(chosen))
    out = []
    for chosen in made:  # fill what is left with the largest pieces that fit
        left = room - int(sizes[list(chosen)].sum())
        taken = list(chosen)
        while left >= s[0]:
            at = int(np.searchsorted(s, left, side="right")) - 1
            while at >= 0 and counts[have[at]] <= taken.count(int(have[at])):
                at -= 1
            if at < 0:
                break
            taken.append(int(have[at]))
            left -= int(s[at])
        out.append((left, tuple(sorted(taken, reverse=True))))
    seen = dict.fromkeys(sorted(out, key=lambda x: (x[0], [-i for i in x[1]])))
    kept: list[tuple[int, tuple[int, ...]]] = []
    for left, chosen in seen:
        if not any(len(c) == len(chosen) and all(a >= b for a, b in zip(c, chosen, strict=True)) for _, c in kept):
            kept.append((left, chosen))
    return [c for _, c in kept]


def completions(sizes: np.ndarray, counts: np.ndarray, capacity: int, top: int, every: bool) -> Iterator[tuple[int, ...] | None]:
    """The bins to try around a piece of ``sizes[top]``: those of ``fillings``, and with ``every`` all others after them.

    The others are made one at a time, None standing for each step, so that the caller can bound them. Fillings that
    another piece fits into, or in which a larger piece could stand in for one, are dominated and left out. ``counts``
    is read when an item is asked for, and has to be then as it was first.
    """
    room = capacity - int(sizes[top])
    counts[top] -= 1
    first = fillings(sizes, counts, room)
    counts[top] += 1
    yield from [(top, *f) for f in first]
    if not every or first == [()] or (len(first[0]) == 1 and sizes[first[0][0]] == room):
        return
    own = counts.copy()
    own[top] -= 1
    have = [int(i) for i in np.flatnonzero((own > 0) & (sizes <= room))]
    s, free, seen = [int(sizes[i]) for i in have], [int(own[i]) for i in have], set(first)
    taken: list[int] = []  # places in ``have``, not ascending
    left, last = room, len(s) - 1
    while True:
        at = min(last, bisect_right(s, left) - 1)
        if at >= 0 and not free[at]:
            at -= 1  # only the piece taken last can be used up
        if at >= 0:
            taken.append(at)
            free[at] -= 1
            left, last = left - s[at], at
            continue
        yield None
        fits = any(free[j] for j in range(bisect_right(s, left)))
        if not fits and not any(free[j] for i in set(taken) for j in range(i + 1, bisect_right(s, s[i] + left))):
            made = tuple(have[i] for i in taken)
            if made not in seen:
                yield (top, *made)
        last = -1
        while taken and last < 0:
            at = taken.pop()
            free[at] += 1
            left, last = left + s[at], at - 1
        if last < 0:
            return


def complete_bins(lengths: list[int], capacity: int, nodes: int | None = NODES) -> list[list[int]]:
    """Bins of positions in ``lengths``, as few as the search finds; never more than best fit needs.

    The bins that look best are searched first, then, where that leaves nodes, all. The result is the least possible
    if the search ends, or meets the lower bound, before its ``nodes`` are used up; None bounds nothing, so that the
    result is always the least possible, whatever time it takes.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    incumbent = [[order[i] for i in b] for b in best_fit([lengths[i] for i in order], capacity)]
    total = sum(lengths)
    least = max(-(-total // capacity), sum(1 for x in lengths if 2 * x > capacity))
    if len(incumbent) <= least:
        return incumbent
    sizes, all_counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    most = math.inf if nodes is None else nodes + len(lengths)
    best: list[tuple[int, ...]] | None = None
    limit, spare, spent = len(incumbent), (len(incumbent) - 1) * capacity - total, 0
    for every in (False, True):
        counts = all_counts.astype(np.int64)
        chosen: list[tuple[int, ...]] = []
        wasted = 0
        stack: list[Iterator[tuple[int, ...] | None]] = []
        forward = True
        while limit > least and spent < most:
            if forward:
                left = np.flatnonzero(counts)
                if not len(left):
                    best, limit = list(chosen), len(chosen)
                    spare = (limit - 1) * capacity - total
                    forward = False
                    continue
                stack.append(completions(sizes, counts, capacity, int(left[-1]), every))
                spent += 1
            elif not stack:
                break
            elif chosen and len(chosen) == len(stack):
                undone = chosen.pop()
                np.add.at(counts, list(undone), 1)
                wasted -= capacity - int(sizes[list(undone)].sum())
            forward = False
            for option in stack[-1]:
                if option is None:
                    spent += 1
                    if spent >= most:
                        break
                    continue
                waste = capacity - int(sizes[list(option)].sum())
                if wasted + waste <= spare and len(chosen) + 1 < limit:
                    np.subtract.at(counts, list(option), 1)
                    chosen.append(option)
                    wasted += waste
                    forward = True
                    break
            else:
                stack.pop()
    if best is None:
        return incumbent
    places: dict[int, list[int]] = {}
    for i in order:
        places.setdefault(lengths[i], []).append(i)
    return [[places[int(sizes[k])].pop() for k in option] for option in best]


def _packed(pieces: DataFrame, blocks: int, capacity: int, first: int, nodes: int | None) -> DataFrame:
    schema = T.StructType([*[f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "filled")],
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("filled", T.LongType())])
    names = [f.name for f in schema.fields if f.name not in ("sequence_id", "offset", "filled")]

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[names].sort_values("row", kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset, filled = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        for b, members in enumerate(complete_bins(lengths, capacity, nodes)):
            at, total = 0, sum(lengths[i] for i in members)
            for i in members:
                sequence[i], offset[i], filled[i] = ((first + key[0]) << 32) + b, at, total
                at += lengths[i]
        return rows.assign(sequence_id=sequence, offset=offset, filled=filled)

    block = F.pmod(F.xxhash64("row", F.lit(first)), F.lit(blocks))
    return pieces.groupBy(block.alias("block")).applyInPandas(pack, schema)


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, block_pieces: int = BLOCK_PIECES, nodes: int | None = NODES) -> DataFrame:
    """``pieces`` (with ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``, gapless from 0.

    ``nodes`` bounds the search in a block (None: each block has as few sequences as can be). Every row is placed once, repeated rows too. An empty table gives an empty result.
    """
    rows = staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces", TEXT_ROWS)
    blocks = max(1, -(-rows.count() // block_pieces))
    once = staged(_packed(rows, blocks, capacity, 0, nodes), "packed")
    poor = F.col("filled") < capacity - capacity // 64
    again = max(1, -(-once.where(poor).count() // block_pieces))
    repacked = _packed(once.where(poor), again, capacity, blocks, nodes)
    return once.where(~poor).unionByName(repacked).drop("row", "filled")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = NODES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    Null and empty texts are one piece of the end id; repeated rows are packed one by one. An empty table gives an empty
    result; other columns are ignored. ``nodes``: see ``pack_pieces``.
    """
    return pack_pieces(cut_documents(docs, tokenizer_path, capacity, END_ID, id_col, text_col), capacity, nodes=nodes)
