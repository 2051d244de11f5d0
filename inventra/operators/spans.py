"""Points in spans, by an index of dyadic blocks.

A span of whole numbers is cut into the largest blocks [i * 2**l, (i + 1) * 2**l)
that fill it, at most two for each level l; a point lies in one block of each
level.  So a join by key, level and block finds each span around a point exactly
once, with a few rows for each span and each point, and one key's rows are dealt
out by block however many it has.  Where it only matters whether some span holds a
point, the blocks are places in masks, and a point stays one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(spans: DataFrame, begin: str, end: str) -> int:
    """Blocks of the longest span have less than so many levels."""
    longest = spans.agg(F.max(F.col(end).cast("long") - F.col(begin).cast("long") + 1)).first()[0]
    return max(1, int(longest or 1)).bit_length()


def _blocks(begin: Column, end: Column, levels: int) -> Column:
    """The blocks that fill a span, its end included."""
    out = []
    for level in range(levels):
        step = 1 << level
        first = F.shiftright(begin + (step - 1), level)
        last = F.shiftright(end + 1, level)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        # A block whose twin isn't in the span too is as large as can be.
        out.append(F.when((first < last) & odd(first), F.struct(F.lit(level).alias("level"), first.alias("block"))))
        out.append(F.when((first < last) & odd(last) & (odd(first + 1) | (last - 1 > first)), F.struct(F.lit(level).alias("level"), (last - 1).alias("block"))))
    return F.array_compact(F.array(*out))


def blocks(spans: DataFrame, begin: str, end: str, levels: int) -> DataFrame:
    """spans with ``level`` and ``block``: a row for each block.  A span whose end
    is before its begin, or which lacks one, has none."""
    made = F.explode(_blocks(F.col(begin).cast("long"), F.col(end).cast("long"), levels))
    return spans.withColumn("_b", made).withColumns({"level": F.col("_b.level"), "block": F.col("_b.block")}).drop("_b")


def stops(points: DataFrame, at: str, levels: int) -> DataFrame:
    """points with ``level`` and ``block``: a row for each level."""
    held = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(F.col(at).cast("long"), n).alias("block")) for n in range(levels))))
    return points.withColumn("_b", held).withColumns({"level": F.col("_b.level"), "block": F.col("_b.block")}).drop("_b")


def _unsent(held: DataFrame) -> DataFrame:
    """Never broadcast: by the size of its files a table of spans looks far smaller
    than its blocks are in the driver's memory."""
    return held.hint("merge")


def stabbed(points: DataFrame, spans: DataFrame, key: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Each point with each span of its key around it; other columns must differ."""
    levels = _levels(spans, begin, end)
    return stops(points, at, levels).join(_unsent(blocks(spans, begin, end, levels)), [*key, "level", "block"]).drop("level", "block")


def first_around(points: DataFrame, spans: DataFrame, key: list[str], at: str, begin: str, end: str, rank: list[Column], told: list[str], carry: list[str]) -> DataFrame:
    """carry and ``found`` (a struct of ``told``) of the first span by ``rank``
    around each point that is in one.  A block keeps its first span alone, so a
    point meets one row for each level however many spans lie around it."""
    levels = _levels(spans, begin, end)
    order = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)))
    best = F.min(F.struct(order.alias("order"), F.struct(*told).alias("found"))).alias("best")
    held = blocks(spans, begin, end, levels).groupBy(*key, "level", "block").agg(best)
    met = stops(points, at, levels).join(_unsent(held), [*key, "level", "block"])
    return met.groupBy(*carry).agg(F.min("best").alias("best")).select(*carry, "best.found")


#: Places of a tier that one mask holds: a bit each.
_WIDTH = 6


def _bits(first: Column, last: Column) -> Column:
    """A mask with the bits of these places within their group set."""
    ones, within = F.lit(-1).cast("long"), lambda c: c.bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")
    return F.call_function("shiftleft", ones, within(first)).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(63) - within(last)))


def masks(spans: DataFrame, key: list[str], begin: str, end: str, tiers: int) -> list[DataFrame]:
    """For each tier key, ``group`` and ``mask``: which of a group's 64 places are
    held.  A place of tier n is a whole group of tier n - 1, so a span sets bits of two
    groups of each tier at most, and any number of spans makes one row of a group."""
    b, e, group = F.col("_b"), F.col("_e"), lambda c: F.shiftright(c, _WIDTH)
    now = spans.select(*key, F.col(begin).cast("long").alias("_b"), F.col(end).cast("long").alias("_e")).where("_b <= _e")
    out = []
    for tier in range(tiers):
        first, last = group(b + (1 << _WIDTH) - 1), group(e + 1) - 1
        rises = (first <= last) & F.lit(tier < tiers - 1)
        piece = lambda g, x, y: F.struct(g.alias("group"), _bits(x, y).alias("mask"))
        left, right = piece(group(b), b, F.lit(-1)), piece(group(e), F.lit(0), e)
        # Whole groups go up a tier; what is left lies in the groups of both ends.
        own = F.when(rises, F.array_compact(F.array(F.when(group(b) < first, left), F.when(group(e) > last, right)))).when(group(b) == group(e), F.array(piece(group(b), b, e))).otherwise(F.array(left, right))
        out.append(now.select(*key, F.inline(own)).groupBy(*key, "group").agg(F.bit_or("mask").alias("mask")))
        now = now.where(rises).select(*key, first.alias("_b"), last.alias("_e"))
    return out


def outside(points: DataFrame, spans: DataFrame, key: list[str], at: str, begin: str, end: str) -> DataFrame:
    """The points that no span of their key holds, and those without key or place.
    A tier spans 64 times the one below, so few do, and each takes its points away."""
    tiers = -(-(_levels(spans, begin, end) - 1) // _WIDTH) or 1
    out = points
    for tier, held in enumerate(masks(spans, key, begin, end, tiers)):
        held = held.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(key)), "group", "mask")
        place = F.shiftright(F.col(at).cast("long"), _WIDTH * tier)
        bit = F.call_function("shiftright", F.col("mask"), place.bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")).bitwiseAND(F.lit(1)) == 1
        same = [F.col(c) == F.col(f"_{i}") for i, c in enumerate(key)]
        out = out.join(_unsent(held), reduce(Column.__and__, [*same, F.shiftright(place, _WIDTH) == F.col("group"), bit]), "left_anti")
    return out
