"""Stable identities and orderings from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing part of an identity, and for the split names, in order.
MISSING = "<missing>"
SPLITS = ("train", "validation", "test")
#: Fixed value: share of the outer training fraction that validates.
VALIDATION_SHARE = 0.10


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def sample_id(file_id: Column, row_id: Column) -> Column:
    """Lowercase hex SHA-256 of ``file:row``; missing parts are spelled out."""
    return F.sha2(F.concat_ws(":", text_of(file_id), text_of(row_id)), 256)


def seeded_hash(seed: Column | int, *parts: Column) -> Column:
    """Hex digest that orders rows the same way for the same seed, on any partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat_ws(":", seed.cast("string"), *[p.cast("string") for p in parts]), 256)


def leading_64(digest: Column) -> Column:
    """The first 8 bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def unit_interval(key: Column, seed: int) -> Column:
    """A double in [0, 1) drawn by key and seed."""
    return leading_64(seeded_hash(seed, key)).cast("double") / F.lit(float(2**64))


def stream_split(key: Column, outer: float, seed: int, validation_share: float = VALIDATION_SHARE) -> Column:
    """The split of a group, decided from its id alone, so batch and stream agree."""
    if outer not in (0.7, 0.8):
        raise ValueError("the outer training fraction is 0.7 or 0.8")
    u, test = unit_interval(key, seed), 1.0 - outer
    return F.when(u < test, "test").when(u < test + outer * validation_share, "validation").otherwise("train")


def endpoint_hash(value: Column, namespace: str) -> Column:
    """SHA-256 of the namespace, a NUL and the endpoint, so that raw addresses need not be written."""
    return F.sha2(F.concat(F.lit(namespace + "\0"), value), 256)
