"""Operator 10: exact deduplication against a persistent digest index. DataFrame functions only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import base


def digest(text="text"):
    """SHA-256 (binary) of a text with A-Z lower-cased; null counts as empty."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(plain, 256))


class DigestIndex:
    """A table (digest, keep_id) with one row a distinct text, bucketed and sorted by digest.

    ``ingest`` keeps of a batch the digests that the index doesn't hold, by a sort-merge anti-join in which the
    index needs neither shuffle nor sort, and appends them. The table outlives the session: the folder holds it with
    its number of buckets, which rules whatever the session's settings are; another number asked for is refused."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/buckets")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(f"{folder}/buckets").first()[0]
            if buckets not in (None, held):
                raise ValueError(f"{folder} has {held} buckets, not {buckets}")
            buckets = held
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/buckets")
        self.buckets, self.name = buckets, f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}/rows'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, groups: DataFrame) -> None:
        """groups(digest, keep_id): one row a digest of the batch; those that the index lacks are appended."""
        fresh = groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.name)

    def close(self) -> None:
        """Take the table out of the catalogue. Its files stay, and so do DataFrames that rows() made."""
        self.spark.sql(f"DROP TABLE {self.name}")


def exact_rows(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256, stays of rows(row, doc_id, digest), which are read twice.

    stays holds for one row of each text that the index lacked: that of the largest doc_id, of equal ones (or where
    there are null ones alone) that of the smallest row."""
    spark = rows.sparkSession
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))  # counted before the shuffle
    groups = groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.row")).alias("best"), "group_size")
    groups = base.saved(groups, "groups")  # else the optimizer joins before it counts, and a hot digest's rows meet in one task
    index = DigestIndex(spark, folder or base.scratch(spark, "index"))
    index.ingest(groups)
    held = index.rows().withColumnRenamed("keep_id", "held")
    index.close()
    about = groups.hint("merge").join(held, "digest")
    about = about.withColumn("best", F.when(F.col("held").eqNullSafe(F.col("keep_id")), F.col("best")))
    about = about.select("digest", F.col("held").alias("keep_id"), "best", "group_size")
    out = base.looked_up(rows, about, "digest", "group_size", rows.count())
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return out.select("row", "doc_id", "keep_id", "group_size", same("doc_id", "keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), same("row", "best").alias("stays"))


def exact_dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays (null ids are smaller than all; a group of null ids alone keeps none). Rows repeated
    with their doc_id all carry kept = true if that id stays. ``folder`` holds the index; a new one under
    spark.checkpoint.dir by default. Where a batch before this one brought a text into the index, its row stays for
    good: keep_id is that row's, whatever ids come later. So a batch that is ingested twice is decided alike both
    times. group_size counts the rows of docs alone. Other columns are ignored; an empty table gives an empty result.
    Digests of texts with over 1/1000 of the rows of docs (so 1000 at most) are looked up by broadcast, the others
    by a sort-merge join.
    """
    rows = base.saved(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", digest().alias("digest")), "digests")
    return exact_rows(rows, folder).drop("row", "stays")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that stay: one of each text, that of the largest doc_id; of rows that repeat
    with it one. Null doc_ids are smaller than all, null texts are empty; no column of docs can clash."""
    rows, row = base.numbered(docs)

    def decided() -> DataFrame:
        digests = base.saved(rows.select(F.col(row).alias("row"), "doc_id", digest().alias("digest")), "digests")
        return exact_rows(digests).filter("stays").select(F.col("row").alias(row))

    return rows.join(base.settled(docs.sparkSession, decided, "stays"), row, "left_semi").select(docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(base.table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept, h AS text_sha256
FROM n WINDOW g AS (PARTITION BY h)
"""
