"""Exact dedup against a persistent digest index, in DataFrame functions only.

Each text is known by the SHA-256 of its normalised form.  The index is a table
of the digests seen so far with the row that was first, bucketed and sorted by
digest.  A batch is reduced to one row for each digest (combined before the
shuffle, so a large group of copies is small by then) and dealt like the index;
a sort-merge anti-join, to which the index comes without being shuffled, leaves
the digests that are new, and they are appended bucket by bucket.  The index is
opened again by its path in any later session, and adding a batch twice changes
nothing.

A batch's rows then look their digest up.  Groups of more than one row in
``HOT`` number fewer than ``HOT``, so these few are broadcast and their rows are
never shuffled by digest; the others' groups are small and are joined.

Defined results: a null text is the empty text.  Between batches the earlier one
stays; inside a batch the row with the smallest doc_id does (null last), and of
rows that repeat an id and a text one alone.  An empty table gives no rows.
Further columns are not returned, and none of them clashes.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.llm.tables import dropped, shared_dir, stored

# What the contract replaces by one space.
SPACES = "[\\x20\\x09-\\x0D]+"
#: A group with more than one row in so many is hot.
HOT = 1000
#: Rows for which a new index gets a bucket.
BUCKET_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digested(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest and row, a number that tells repeated rows apart; written
    down, so that texts are read and hashed once and numbers stay."""
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    return stored(df.select(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")))


class DigestIndex:
    """The index at ``path``, begun with ``buckets`` buckets if nothing is there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        # The number of buckets belongs to the files, so it is in their folder's name.
        self.path = f"{path}/digests-{buckets}"
        self.name = "digests_" + hashlib.md5(self.path.encode(), usedforsecurity=False).hexdigest()
        spark.sql(
            f"create table if not exists {self.name} (digest binary, keep_id bigint, batch string, row bigint) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _dealt(self, groups: DataFrame) -> DataFrame:
        return groups.repartition(self.buckets, "digest").hint("merge")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Appends the digests of ``rows`` (as ``digested``) that are not there."""
        # The digest is read from the aggregate: were it the grouping key, Spark
        # would push the anti-join below the aggregate and shuffle every row.
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "digest")).alias("first")
        groups = rows.groupBy("digest").agg(first).select("first.digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch"), "first.row")
        fresh = self._dealt(groups).join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "batch", "row").write.insertInto(self.name)

    def resolved(self, rows: DataFrame, hot: int = HOT) -> DataFrame:
        """doc_id, digest, keep_id, group_size (of ``rows``) and kept, one row for
        each of ``rows`` (as ``digested``, with their ``batch``), all of them added."""
        counted = self._dealt(rows.groupBy("digest").agg(F.count("*").alias("group_size")))
        held = self.table().select("digest", "keep_id", F.col("batch").alias("_batch"), F.col("row").alias("_row"))
        groups = stored(counted.join(held.hint("merge"), "digest"))
        most = -(-rows.count() // hot)
        many, few = F.broadcast(groups.where(F.col("group_size") > most)), groups.where(F.col("group_size") <= most)
        near = rows.join(many, "digest")
        far = rows.join(many.select("digest"), "digest", "left_anti").join(few, "digest")
        kept = (F.col("batch") == F.col("_batch")) & (F.col("row") == F.col("_row"))
        done = stored(near.unionByName(far).select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept")))
        dropped(groups)
        return done

    def removed(self) -> None:
        """Drops the table and its files."""
        self.spark.sql(f"drop table if exists {self.name}")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: the rows of ``df``, brought to a
    new index in ``batches`` by rising ids, as a corpus grows, so the smallest id
    of equal texts is the one that stays."""
    spark = df.sparkSession
    rows = digested(df, doc_id, text)
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    edges = [] if low is None else sorted({low + (high - low) * k // batches for k in range(1, batches)})
    batch = F.lit(0)
    for edge in edges:
        batch = batch + F.when(F.col("doc_id") <= edge, 0).otherwise(1)
    rows = rows.withColumn("batch", batch.cast("string"))
    index = DigestIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", buckets or max(8, -(-n // BUCKET_ROWS)))
    for k in range(len(edges) + 1):
        index.add(rows.where(F.col("batch") == str(k)), str(k))
    done = index.resolved(rows, hot)
    index.removed()
    dropped(rows)
    return done
