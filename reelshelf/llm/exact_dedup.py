"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the
normalised text. A batch is deduplicated by a sort-merge anti-join of its
distinct digests with the index, in which the index side is neither shuffled nor
rewritten, and the digests that are new are appended.

Defined results: a null text counts as empty; texts are equal after each run of
ASCII white space has become one space. Of equal rows the smallest id stays, and
a digest that an earlier batch holds keeps the id given then. Rows that repeat an
id as well are each returned and counted. A row without id is counted, and never
is the one that stays, unless ``drop_duplicates`` is told so. ``group_size`` counts the rows of the batch. Other columns
of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import attach, read_table, shuffle_partitions
from reelshelf.session import materialise, scratch_dir


def _digest(text: str) -> F.Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.sha2(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " "), 256))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, digest) with the binary SHA-256 of the normalised text."""
    return docs.select(F.col(doc_id).alias("doc_id"), _digest(text).alias("digest"))


class DigestIndex:
    """Digests seen so far: (digest, keep_id), bucketed and sorted by digest.

    The number of buckets is fixed when the index is created and kept beside it.
    A batch that is added again after a failure finds its own digests and appends
    only what is missing, so adding is safe to repeat.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        layout = spark.createDataFrame([(buckets or shuffle_partitions(spark),)], "buckets int")
        layout.write.mode("ignore").parquet(f"{self.path}/layout")
        self.buckets = spark.read.parquet(f"{self.path}/layout").first().buckets
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/digests'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> DataFrame:
        """Label rows (doc_id, digest) and append the digests that are new.

        Returns (doc_id, digest, keep_id, n_rows): the id that stays, and the rows
        of the batch with that digest.
        """
        rows = materialise(rows, "digests")
        groups = materialise(
            rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")),
            "groups",
        )
        new = groups.hint("merge").join(self.read(), "digest", "left_anti")
        # One task for each bucket, so that a batch adds one file to it.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        new.select("digest", F.col("first_id").alias("keep_id")).repartitionById(
            self.buckets, bucket.cast("int")
        ).write.insertInto(self.table)
        known = groups.hint("merge").join(self.read(), "digest").select("digest", "keep_id", "n_rows")
        return attach(rows, materialise(known, "known"), "digest")

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"{scratch_dir(spark)}/reelshelf/digest-index-{uuid.uuid4().hex}")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document, dropped ones too, labelled with the row that stays."""
    labelled = (index or fresh_index(docs.sparkSession)).add(digests(docs))
    return labelled.select(
        "doc_id",
        "keep_id",
        F.col("n_rows").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, unnamed: bool = False) -> DataFrame:
    """The documents that stay, with their own columns; one row for each text that is new.

    A row is named by its id and its digest, so ids that repeat with different texts
    lose none of them. With ``unnamed``, a row without id stays where no row of its
    text has one; an index can't tell such a row from one of an earlier batch. Of rows
    that repeat id and text the one with the smallest hash of its columns stays.
    """
    labelled = (index or fresh_index(docs.sparkSession)).add(digests(docs))
    kept = labelled.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.lit(unnamed) | F.col("doc_id").isNotNull()))
    kept = kept.select(F.col("digest").alias("_kept"), F.col("keep_id").alias("_kept_id")).distinct()
    whole = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.xxhash64(*whole).alias("_order"),
        _digest("text").alias("_digest"),
    )
    match = (F.col("_digest") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_kept_id"))
    rows = rows.join(kept, match, "left_semi")
    return rows.groupBy("_digest").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM digests
"""
