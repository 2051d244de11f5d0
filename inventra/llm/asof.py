"""Tolerant as-of join: each left row meets the latest right row of its key at or
before its time and at most a tolerance earlier.

Time is cut into buckets as wide as the tolerance.  A right row is sent to its
own and the next bucket, so a left row finds all it may match under its key and
its own bucket; rows out of reach are filtered exactly and ``row_number`` takes
the latest.  Right rows of one key and time are put together first, combined
before the shuffle: the first by tie order and how many there are.

A bucket with many right rows would meet its left rows in pairs, their number
growing with the square of the key's share.  Such *dense* buckets are found by
counts and cut into cells of 2**k microseconds, narrower until none holds more
than ``LIMIT`` right rows.  To a cell go the rows in it and one carried row, the
latest before the cell, each marked with the time of the next one, so a left row
meets one of them.  Carried rows come by the same bucket join from cells that each
stand for themselves by their latest row, at most ``2 * 64`` of them in a bucket
for at most 64 cells, and so on in each cell's 64 narrower ones.  No key or
bucket thus makes more pairs than ``LIMIT`` for each of its left rows.

Left rows learn whether their bucket is dense from a set of at most ``SLOTS``
hash slots: this alone is broadcast and has that size whatever the input.  A
bucket whose slot is shared goes the dense way too, which gives the same rows.

Defined results: a left row without key or time, or without match, has nulls and
a count of 0.  A right row without key or time is never matched.  Repeated left
ids count once: the row with the smallest time, then key (null last) is it.
Null left ids are one id.  Empty tables are borne.  Columns of any name may
stand beside those that are named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventra.llm.tables import stored

#: Right rows that a cell or two neighbouring buckets may hold at most.
LIMIT = 64
#: Hash slots for dense buckets.
SLOTS = 1 << 15
#: Each cell is cut into 2 ** FAN narrower ones.
FAN = 6


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without zone is taken as UTC whatever the
    session's zone is."""
    if df.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(F.col(name))
    passed = F.col(name) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), passed)
    seconds = part("DAY").cast("long") * 86400 + part("HOUR").cast("long") * 3600 + part("MINUTE").cast("long") * 60
    return seconds * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def floored(time: Column, width: int) -> Column:
    return time - F.pmod(time, F.lit(width))


def _bucket(time: Column, width: int) -> Column:
    return F.call_function("div", floored(time, width), F.lit(width))


def _slot(bucket: str) -> Column:
    return F.pmod(F.xxhash64("key", bucket), F.lit(SLOTS)).cast("int")


def _both(df: DataFrame, width: int, time: str) -> DataFrame:
    """Each row in its own and the next bucket."""
    own = _bucket(F.col(time), width)
    return df.withColumn("bucket", F.explode(F.array(own, own + 1)))


def tied(right: DataFrame, key: str, time: str, rank: list[Column], carry: list[str]) -> DataFrame:
    """key, at, row (the first by ``rank``) and n: one row for each key and time."""
    named = [r.alias(f"r{i}") for i, r in enumerate(rank)]
    row = F.min(F.struct(*named, F.struct(*carry).alias("carry")))["carry"]
    return right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("key"), F.col(time).alias("at")).agg(row.alias("row"), F.count("*").alias("n"))


def _dense(points: DataFrame, width: int, limit: int) -> DataFrame:
    """The slots of buckets that, with the one before, may hold more than ``limit``."""
    own = points.groupBy("key", _bucket(F.col("at"), width).alias("own")).agg(F.count("*").alias("n")).where(F.col("n") > limit // 2)
    return own.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1))).select(_slot("bucket").alias("slot")).distinct()


def _latest(df: DataFrame, *by: str) -> DataFrame:
    """The latest row in each group, as ``last``; groups may have none."""
    return df.groupBy(*by).agg(F.max("last").alias("last"))


def _last() -> Column:
    return F.struct("at", "row", "n").alias("last")


def _cell(time: str, bits: int) -> Column:
    return F.shiftright(F.col(time), bits)


def _carried(rows: DataFrame, points: DataFrame, width: int, bits: int, deepest: int) -> DataFrame:
    """key, cell, last: what is carried into each cell of 2**deepest in which
    ``rows`` stand: the latest of ``points`` before it."""
    cells = rows.select("key", _cell("time", bits).alias("cell")).distinct()
    ends = _latest(points.select("key", _cell("at", bits).alias("cell"), _last()), "key", "cell")
    start = F.shiftleft(F.col("cell"), bits)
    # By buckets of the tolerance, as rows are, but with one row for a cell.
    into = cells.select("key", "cell", _bucket(start, width).alias("bucket"))
    ends = _both(ends.select("key", F.col("cell").alias("from"), "last", F.col("last.at").alias("at")), width, "at").select("key", "bucket", "from", "last")
    held = _latest(into.join(ends, (into["key"] == ends["key"]) & (into["bucket"] == ends["bucket"]) & (ends["from"] < into["cell"]), "left").select(into["key"], into["cell"], "last"), "key", "cell")
    while bits > deepest:
        step = min(FAN, bits - deepest)
        bits -= step
        cells = rows.select("key", _cell("time", bits).alias("cell")).distinct().withColumn("parent", F.shiftright("cell", step))
        ends = _latest(points.select("key", _cell("at", bits).alias("from"), _last()), "key", "from").withColumn("parent", F.shiftright("from", step))
        # What is carried into the whole is before all its parts.
        ends = ends.select("key", "parent", "from", "last").unionByName(held.select("key", F.col("cell").alias("parent"), F.shiftleft("cell", step).alias("from") - 1, "last").toDF("key", "parent", "from", "last"))
        held = _latest(cells.join(ends, (cells["key"] == ends["key"]) & (cells["parent"] == ends["parent"]) & (ends["from"] < cells["cell"]), "left").select(cells["key"], "cell", "last"), "key", "cell")
    return held


def asof_join(left: DataFrame, right: DataFrame, *, id: str, left_key: str, left_time: str, right_key: str, right_time: str, tolerance: int, rank: list[Column], carry: list[str], limit: int = LIMIT) -> DataFrame:
    """id, key, time, at (the matched time), row (``carry`` of the matched row), n
    (rows of the key at that time): one row for each id of ``left``.  Times are
    longs in one unit, as is ``tolerance``; of equal times the row that is first
    by ``rank`` is matched, then by ``carry``."""
    if tolerance < 1 or limit < 2:
        raise ValueError("a tolerance from 1 and a limit from 2 are asked for")
    if left.schema[left_key].dataType != right.schema[right_key].dataType:
        raise ValueError("keys have two types, so their hashes would differ")
    first = F.min(F.struct(F.col(left_time).isNull().alias("a"), F.col(left_time).alias("time"), F.col(left_key).isNull().alias("b"), F.col(left_key).alias("key"))).alias("first")
    rows = left.groupBy(F.col(id).alias("id")).agg(first).select("id", "first.key", "first.time")
    points = stored(tied(right, right_key, right_time, rank, carry))
    slots = stored(_dense(points, tolerance, limit))
    dense = F.broadcast(slots)
    some = not slots.isEmpty()

    usable = F.col("key").isNotNull() & F.col("time").isNotNull()
    rows = rows.withColumn("bucket", _bucket(F.col("time"), tolerance))
    if some:
        rows = rows.withColumn("slot", _slot("bucket")).join(dense.withColumn("dense", F.lit(True)), "slot", "left").withColumn("dense", F.coalesce("dense", F.lit(False)) & usable)
        rows = stored(rows.select("id", "key", "time", "bucket", "dense"))
    else:
        rows = rows.withColumn("dense", F.lit(False))
    asked = rows.where(usable).withColumnRenamed("bucket", "cell")
    sent = _both(points, tolerance, "at").withColumnRenamed("bucket", "cell")
    if some:
        sent = sent.withColumn("slot", _slot("cell")).join(dense, "slot", "left_anti")
        offered, bits = _in_cells(rows.where("dense"), _near(points, dense, tolerance), tolerance, limit)
        asked = asked.withColumn("cell", F.when(F.col("dense"), _cell("time", bits)).otherwise(F.col("cell")))
    none = F.lit(None).cast("long").alias("until")
    sent = sent.select("key", F.lit(False).alias("dense"), "cell", "at", none, "row", "n")
    sent = sent.unionByName(offered.withColumn("dense", F.lit(True))) if some else sent
    l, p = asked.alias("l"), sent.alias("p")
    same = [F.col(f"l.{c}") == F.col(f"p.{c}") for c in ("key", "dense", "cell")]
    within = (F.col("p.at") <= F.col("l.time")) & (F.col("l.time") - F.col("p.at") <= tolerance) & (F.col("p.until").isNull() | (F.col("l.time") < F.col("p.until")))
    pairs = l.join(p, reduce(Column.__and__, same) & within, "left").select("l.id", "l.key", "l.time", "p.at", "p.row", "p.n")
    best = Window.partitionBy("id").orderBy(F.col("at").desc_nulls_last())
    found = pairs.withColumn("place", F.row_number().over(best)).where("place = 1")
    absent = points.schema
    alone = rows.where(~usable).select("id", "key", "time", *(F.lit(None).cast(absent[c].dataType).alias(c) for c in ("at", "row", "n")))
    return found.select("id", "key", "time", "at", "row", "n").unionByName(alone).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _near(points: DataFrame, dense: DataFrame, width: int) -> DataFrame:
    """The points of dense buckets and of those before them."""
    own = points.withColumn("own", _bucket(F.col("at"), width)).withColumn("next", F.col("own") + 1)
    marked = own.withColumn("slot", _slot("own")).join(dense.withColumn("a", F.lit(1)), "slot", "left").drop("slot")
    marked = marked.withColumn("slot", _slot("next")).join(dense.withColumn("b", F.lit(1)), "slot", "left")
    return stored(marked.where("a = 1 or b = 1").select("key", "at", "row", "n"))


def _in_cells(rows: DataFrame, points: DataFrame, width: int, limit: int) -> tuple[DataFrame, int]:
    """key, cell, at, until, row, n: the points of each cell and what is carried
    into it, each with the time of the next one in the cell; and the cells' bits."""
    bits = first = max(0, width.bit_length() - FAN)
    # Narrower until no cell is full; cells of one unit hold one point.
    while bits and (points.groupBy("key", _cell("at", bits).alias("cell")).count().agg(F.max("count")).first()[0] or 0) > limit:
        bits = max(0, bits - FAN)
    carried = _carried(rows, points, width, first, bits).where("last is not null")
    offered = points.select("key", _cell("at", bits).alias("cell"), "at", "row", "n").unionByName(carried.select("key", "cell", "last.*"))
    return offered.withColumn("until", F.lead("at").over(Window.partitionBy("key", "cell").orderBy("at"))), bits
