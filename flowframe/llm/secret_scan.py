"""Secrets in texts: three patterns of known shapes, and random strings that a vocabulary tells.

A byte-pair vocabulary has learned the pieces of words, so a random string takes many more tokens than words of its
length. Long runs of key characters that mix letters and digits are encoded by tiktoken; those with few characters a
token count as secrets, unless they are known to be digests, identifiers, or parts of addresses.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowframe.llm.common import KEPT, append_columns, documents

#: The kinds in their order, their patterns, the group that is measured and its least characters.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = [kind for kind, *_ in BASE] + ["random"]

#: Characters of a run that is tested, and characters a token below which it is random.
SHORTEST, RATIO = 20, 2.2
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_DIGITS = frozenset((32, 40, 56, 64, 96, 128))
HEX = re.compile(r"[0-9A-Fa-f]+")
#: UUIDs, numbers with separators, and words or numbers of ordinary length joined by separators.
IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+|(?:[A-Za-z]+|[0-9]{1,8})(?:[-_/=+]+(?:[A-Za-z]+|[0-9]{1,8}))*[-_/=+]*")
#: What ends an address, and characters of it that are looked at.
BREAK, ADDRESS_CHARS = re.compile(r"[\s\"'<>()]"), 2048


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the leftmost matches of each pattern that are long enough; kinds are places in KINDS."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind != "assign" or ":" in text or "=" in text:
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={})


KEPT[__name__] = _encoding


def known(run: str) -> bool:
    """Whether a run is a digest by its digits, or an identifier by its shape."""
    return bool(len(run) in DIGEST_DIGITS and HEX.fullmatch(run) or IDENTIFIER.fullmatch(run))


def in_address(text: str, start: int, end: int) -> bool:
    """Whether the run stands in a URL or before the @ of a mail address."""
    before = BREAK.split(text[max(0, start - ADDRESS_CHARS) : start])[-1]
    return text[end : end + 1] == "@" or "://" in before


def random_spans(text: str, tokens: Callable[[str], int], ratio: float = RATIO) -> Iterator[tuple[int, int, int]]:
    for m in RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) >= SHORTEST and not known(run) and not in_address(text, m.start(), m.end()) and len(run) < ratio * tokens(run):
            start = m.start() + m[0].index(run)
            yield start, len(BASE), start + len(run)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans`` for every row.

    ``spans`` lists ``kind:start:end`` of all finds by start, then kind, comma-joined, ``base_spans`` those of the three
    patterns; places are code points, ends exclusive. ``ranks_path`` is a tiktoken file of ranks, ``pattern`` its words.
    Whole texts are read. Null and empty texts have no finds, repeated rows the same ones; an empty table gives an empty
    result; other columns are ignored.
    """
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(n, T.StringType()) for n in ("base_spans", "spans")]

    def make():
        def tokens(run: str) -> int:
            return len(_encoding(ranks, pattern).encode_ordinary(run))

        def run(texts: list[str]) -> list:
            base = [base_spans(t) for t in texts]
            every = [sorted([*b, *random_spans(t, tokens, ratio)]) for t, b in zip(texts, base, strict=True)]
            counts = [[sum(s[1] == k for s in spans) for spans in every] for k in range(len(KINDS))]
            return [*counts, [named(b) for b in base], [named(e) for e in every]]

        return run

    return append_columns(documents(docs, id_col, text_col), "text", fields, make).drop("text")
