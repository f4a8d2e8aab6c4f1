"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 digest of the normalised text, in the shared folder. A batch is
reduced to one row per digest (partial aggregation, so a hot text costs one row a task), anti-joined to the index by
sort-merge (the index side is read in its buckets, without a shuffle), and what is new is appended. Each row of the index
names the batch that brought it, so a batch that is added again, after a failure say, gets the same answers.

``add`` dedups a batch against all earlier ones, which win. ``add_parts`` dedups a table within itself: its parts go into
the index one after the other, a part's digest is appended if the index lacks it or has worse rows only, and the best row
of each digest in the index stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm.common import documents
from flowframe.sources.staging import new_folder, remove, staged

#: The characters that do not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]+"
#: Buckets of an index at least, and digests that one should hold at most (about 128 MB).
BUCKETS, BUCKET_DIGESTS = 16, 2_000_000
#: Parts in which a table is added.
PARTS = 3


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def _best() -> Column:
    """Of rows, the one with most code points, then the smallest doc_id (nulls last), then the first."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))


class DigestIndex:
    """Digests of all texts accepted so far, with the document that stands for each.

    ``table`` is a catalogue table name; it is made here unless it exists, with its files below ``folder`` (by default
    a new one in the shared folder). Buckets are fixed then, by the number of digests ``expected``. Without a name the
    index has a table of its own, which ``drop`` removes.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, expected: int = 0, buckets: int | None = None, folder: str | None = None):
        self.spark, self.buckets = spark, buckets or max(BUCKETS, -(-expected // BUCKET_DIGESTS))
        self.table = table or f"flowframe_digests_{uuid.uuid4().hex}"
        self.spare = f"{self.table}_compacted"
        self.folder = folder or new_folder(spark, "digests")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop()

    def rows(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def _append(self, rows: DataFrame, table: str) -> None:
        kinds = {"chars": "int", "row": "long"}  # of rows that are compared with later ones
        dealt = rows.select("digest", "keep_id", "batch", *[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).repartition(self.buckets, "digest")
        writer = dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        if not self.spark.catalog.tableExists(table):
            writer = writer.option("path", f"{self.folder}/{uuid.uuid4().hex}")
        writer.saveAsTable(table)

    def _open(self, keep_id: Column) -> None:
        """Makes the table where it does not exist: from a compaction that did not get to the end, or empty."""
        if self.spark.catalog.tableExists(self.table):
            return
        if self.spark.catalog.tableExists(self.spare):
            self.spark.sql(f"ALTER TABLE {self.spare} RENAME TO {self.table}")
            return
        none = self.spark.range(0)
        self._append(none.select(F.lit(b"").alias("digest"), keep_id.alias("keep_id"), F.lit("").alias("batch")), self.table)

    def compact(self) -> None:
        """Writes the files of all batches as one file a bucket, so that buckets are read in order again.

        Not to be run while a batch is added. After a failure the next ``add`` finds either table.
        """
        if self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.spare}")
            self._append(self.rows(), self.spare)
            self.drop()
            self.spark.sql(f"ALTER TABLE {self.spare} RENAME TO {self.table}")

    def drop(self) -> None:
        """Removes the table and its files."""
        if self.spark.catalog.tableExists(self.table):
            place = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {self.table}")
            remove(self.spark, place)

    def _rows(self, docs: DataFrame, id_col: str, text_col: str, carry: str | None) -> DataFrame:
        text = documents(docs, id_col, text_col, carry)
        return staged(
            text.select(
                F.monotonically_increasing_id().alias("row"), "doc_id", *([F.col("carried")] if carry else []), F.char_length("text").alias("chars"),
                F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
            ),
            "digests",
        )

    @staticmethod
    def _judged(rows: DataFrame, verdict: DataFrame, carry: str | None) -> DataFrame:
        # The verdict is staged, so that the join's inputs are plain exchanges and a hot digest's rows can be split over tasks.
        return rows.join(staged(verdict, "verdict"), "digest").select(
            "doc_id", "keep_id", "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), *([F.col("carried").alias(carry)] if carry else []),
        )

    def add_parts(self, docs: DataFrame, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
        """Adds a table in parts to an index that is empty, and says for each row whether it stays.

        Returns what ``add`` returns for a table that is one batch. Rows are dealt to the parts evenly; of a digest only
        a row better than all that the index holds is appended, so the index grows by what the anti-join lets through.
        """
        rows = self._rows(docs, id_col, text_col, carry)
        self._open(F.lit(None).cast(rows.schema["doc_id"].dataType))
        if self.rows().limit(1).count():
            raise ValueError("the index has rows of other tables")
        sizes = None
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)
            found = staged(own.groupBy("digest").agg(F.count("*").alias("n"), _best().alias("best")), "part")
            sizes = found.select("digest", "n") if sizes is None else sizes.unionByName(found.select("digest", "n"))
            self._append(self._better(found).withColumn("batch", F.lit(str(part))), self.table)
        stays = self.rows().select("digest", F.col("keep_id").alias("doc_id"), "chars", "row").groupBy("digest").agg(_best().alias("best"))
        verdict = sizes.groupBy("digest").agg(F.sum("n").alias("group_size")).join(stays, "digest")
        return self._judged(rows, verdict.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), carry)

    def _better(self, found: DataFrame) -> DataFrame:
        """The best rows of a part that are better than all that the index holds of their digest."""
        rank = lambda chars, doc_id, row: F.struct((-chars).alias("less"), doc_id.isNull().alias("none"), doc_id.alias("doc_id"), row.alias("row"))
        held = self.rows().select(F.col("digest").alias("held"), rank(F.col("chars"), F.col("keep_id"), F.col("row")).alias("held_best"))
        fresh = found.join(held.hint("merge"), (F.col("digest") == F.col("held")) & (F.col("held_best") <= F.col("best")), "left_anti")
        return fresh.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("chars"), F.col("best.row").alias("row"))

    def add(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
        """Adds a batch and says for each of its rows whether it stays.

        Returns ``doc_id, keep_id, group_size, kept, text_sha256``, and the column ``carry`` of the batch if named,
        from tables in the shared folder: the index is not needed to read it. ``group_size`` counts this batch's
        rows with that text. Of equal texts the one with most code points, then the smallest doc_id (nulls last)
        stays; of rows alike in both, exactly one. A text that an earlier batch brought is dropped in favour of that
        document. ``batch`` names the batch (by default a new name): one that is added again under its name has the
        verdicts of the first time, whatever part of it the index already holds. Null texts are empty texts and equal
        to each other; an empty table gives an empty result; other columns are ignored. Batches are added one after
        another.
        """
        name = batch or uuid.uuid4().hex
        rows = self._rows(docs, id_col, text_col, carry)
        found = staged(
            rows.groupBy("digest")
            .agg(F.count("*").alias("group_size"), _best().alias("best"))
            .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
            "batch",
        )
        self._open(F.lit(None).cast(found.schema["keep_id"].dataType))
        fresh = found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.withColumn("batch", F.lit(name)), self.table)
        known = self.rows().select("digest", F.col("keep_id").alias("known_id"), (F.col("batch") == name).alias("own"))
        verdict = found.join(known.hint("merge"), "digest").select(
            "digest", "group_size", F.when(F.col("own"), F.col("keep_id")).otherwise(F.col("known_id")).alias("keep_id"),
            F.when(F.col("own"), F.col("keep_row")).alias("keep_row"),
        )
        return self._judged(rows, verdict, carry)
