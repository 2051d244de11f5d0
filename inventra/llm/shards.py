"""Sharding by jump consistent hashing, in DataFrame functions only.

The id alone and the number of shards decide (law ``key``): a key jumps ahead
through a sequence that its own generator draws, and its shard is the last
landing below the number of shards.  No ring table is kept, and one more shard
takes only rows into itself, one in ``shards + 1``.

The generator works on 64 bits without sign; it is held as a decimal of up to
38 digits, in which the product of state and factor is exact, and is shifted by
an integral division.

Places in a shard go by id (null first), checksum and size.  Rows are dealt by
range of shard and these, sorted in their part and stored with their place in
it; a part of a shard begins where those before it end, so no shard and no group
of equal texts is ever in one task.

Defined results: a null id is the key -1 for the shard; a null text has no
bytes and the checksum of the empty text.  Equal ids share a shard whatever
their texts; repeated rows get places of their own.  An empty table gives none.
Further columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventra.llm.tables import stored

FACTOR, WORD = 2862933555777941757, 2**64
#: Rows of one part, about.
PART_ROWS = 200_000


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of an integer key among ``shards``."""
    wide = "decimal(38,0)"
    word = F.lit(str(WORD)).cast(wide)
    state = F.pmod(key.cast(wide), word).cast(wide)
    start = F.struct(state.alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def step(held: Column, _: Column) -> Column:
        state = F.pmod((held["state"].cast("decimal(20,0)") * F.lit(str(FACTOR)).cast("decimal(19,0)")).cast(wide) + F.lit(1).cast(wide), word).cast(wide)
        drawn = F.call_function("div", state, F.lit(str(2**33)).cast(wide)).cast("double") + 1.0
        ahead = F.floor((held["next"] + 1).cast("double") * (F.lit(float(2**31)) / drawn)).cast("long")
        moved = F.struct(state.alias("state"), held["next"].alias("shard"), ahead.alias("next"))
        return F.when(held["next"] < shards, moved).otherwise(held)

    # Each landing is beyond the one before, so so many steps are enough.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda held: held["shard"].cast("int"))


def sharded(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for
    each row of ``df``."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long"))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
    )
    parts = max(1, -(-df.count() // part_rows))
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    # The number of a row holds its partition and its place there.
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    placed = placed.join(begins, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("begin") + F.col("at") - F.col("first")).cast("long").alias("slot"), "grown_shard")
