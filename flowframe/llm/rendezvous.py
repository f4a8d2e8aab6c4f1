"""Sharding by weighted rendezvous hashing of record keys, with DataFrame operations only.

Every key draws a hash for every shard; the shard with the best weighted draw takes the record. A new shard can
only take records into itself, since the other draws do not change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the key's hash, and of the content's checksum within them, that slots are counted in.
RANGES, PARTS = 4096, 16
#: Fixed value: hex digits of an MD5 that make a draw, 52 bits, exact in a double.
DIGITS = 13


def _draw(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")


def shard_of(df: DataFrame, key_col: str, weights: Sequence[float], prefix: str) -> tuple[DataFrame, Column, list[Column]]:
    """``df`` with a score column for each shard; the column that picks the shard; the scores."""
    names = [f"{prefix}{s}" for s in range(len(weights))]
    scored = df.withColumns({
        n: F.lit(float(w)) / -F.log((_draw(F.concat(F.col(key_col), F.lit(f"#{s}"))) + 0.5) / float(16**DIGITS))
        for s, (n, w) in enumerate(zip(names, weights, strict=True))
    })
    cols = [F.col(n) for n in names]
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return scored, F.coalesce(*[F.when(c == top, F.lit(s)) for s, c in enumerate(cols)]).cast("int"), cols


def shard_documents(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every row, its place there, and its shard were there one shard (of weight 1) more.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The key is the id written as text, so the
    same ids go to the same shard whatever table they are in; a null id counts as the empty key. Null and empty
    texts have size 1 and checksum 0. Slots run from 0 without gaps within a shard, in the order of (range of the
    key's hash, part of the checksum, hash, key, size, checksum); rows alike in all these may take each other's
    slots. The order is counted in RANGES x PARTS pieces a shard, so that no task ranks a whole shard. An empty
    table gives an empty result; other columns are ignored.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or min(weights, default=0) <= 0:
        raise ValueError("one positive weight a shard")
    data = F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "utf-8")
    rows = docs.select(docs[id_col].alias("doc_id"), data.alias("data")).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        (F.octet_length("data") + 1).cast("long").alias("size"), F.crc32("data").alias("text_crc32"),
    )
    scored, pick, scores = shard_of(rows, "key", weights, "score")
    top = F.greatest(*scores) if shards > 1 else scores[0]
    new = F.lit(1.0) / -F.log((_draw(F.concat(F.col("key"), F.lit(f"#{shards}"))) + 0.5) / float(16**DIGITS))
    placed = scored.select(
        "doc_id", "key", "size", "text_crc32", pick.alias("shard"), F.when(new > top, F.lit(shards)).cast("int").alias("moved"),
        _draw(F.col("key")).alias("hash"),
    ).withColumns({"range": (F.col("hash") / F.lit(16**DIGITS // RANGES)).cast("int"), "part": (F.col("text_crc32") % PARTS).cast("int")})
    piece = ["shard", "range", "part"]
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy(*piece).agg(F.count("*").alias("n"))  # RANGES x PARTS rows a shard at most
    starts = counts.select(*piece, F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy("hash", "key", "size", "text_crc32"))
    return (
        placed.withColumn("rank", rank).join(starts, piece)
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            F.coalesce("moved", "shard").alias("grown_shard"),
        )
    )
