"""The tolerant as-of join against brute force, dense buckets included."""

import random

import pytest
from pyspark.sql import functions as F

from inventra.llm import asof
from inventra.llm.asof import asof_join, floored, micros

LEFT = "id long, key long, time long, bucket int, slot string, cell int, at long, n int, row string"
RIGHT = "key long, at long, rank int, num long, bucket int, p string, last int, l int"


def made(seed, keys=4, clicks=120, orders=150, span=400):
    rng = random.Random(seed)
    none = lambda x: None if rng.random() < 0.06 else x
    key = lambda: 0 if rng.random() < 0.4 else rng.randrange(keys)
    # Half of the times are coarse, so there are ties; a burst lies close together.
    at = lambda: rng.choice([rng.randrange(-span, span), 50 * rng.randrange(-4, 5), 100 + rng.randrange(8)])
    left = [(none(i), none(key()), none(at())) for i in range(clicks)]
    left += left[:5] + [(left[6][0], 1, -3), (None, 0, 5)]
    right = [(none(key()), none(at()), none(rng.randrange(3)), none(rng.randrange(40))) for _ in range(orders)]
    return left, right + right[:6]


def brute(left, right, tolerance):
    first, low = {}, lambda x: (x is None, x or 0)
    for i, k, t in left:
        if i not in first or (low(t), low(k)) < (low(first[i][1]), low(first[i][0])):
            first[i] = (k, t)
    out = []
    for i, (k, t) in first.items():
        near = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and 0 <= t - r[1] <= tolerance]
        if not near:
            out.append((i, k, t, None, None, 0))
            continue
        at = max(r[1] for r in near)
        same = [r for r in near if r[1] == at]
        best = min(same, key=lambda r: (r[2] is None, -(r[2] or 0), r[3] is None, r[3] or 0))
        out.append((i, k, t, at, best[3], len(same)))
    return sorted(out, key=repr)


def joined(spark, left, right, tolerance, limit=64):
    a = spark.createDataFrame([(*r, 1, "s", 2, 3, 4, "r") for r in left], LEFT).repartition(3)
    b = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in right], RIGHT).repartition(3)
    rank = [F.col("rank").isNull(), -F.col("rank"), F.col("num").isNull(), F.col("num")]
    got = asof_join(a, b, id="id", left_key="key", left_time="time", right_key="key", right_time="at", tolerance=tolerance, rank=rank, carry=["num"], limit=limit)
    return sorted(((r.id, r["key"], r.time, r["at"], r.row.num if r.row else None, r.n) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("seed", "tolerance", "limit"), [(1, 50, 64), (2, 50, 6), (3, 300, 2), (4, 7, 2), (5, 1, 2), (6, 100_000, 3)])
def test_equals_brute_force(spark, seed, tolerance, limit):
    left, right = made(seed)
    assert joined(spark, left, right, tolerance, limit) == brute(left, right, tolerance)


def test_every_bucket_the_dense_way(spark, monkeypatch):
    """One slot for all buckets: all of them go by cells."""
    monkeypatch.setattr(asof, "SLOTS", 1)
    left, right = made(11)
    assert joined(spark, left, right, 90, 4) == brute(left, right, 90)


def test_edges_of_the_tolerance(spark):
    left = [(1, 0, 72), (2, 0, 73), (3, 0, -1), (4, 0, 0)]
    assert joined(spark, left, [(0, 0, 1, 9)], 72) == [(1, 0, 72, 0, 9, 1), (2, 0, 73, None, None, 0), (3, 0, -1, None, None, 0), (4, 0, 0, 0, 9, 1)]


@pytest.mark.parametrize("which", ["left", "right", "both"])
def test_empty(spark, which):
    left, right = made(7, clicks=10)
    left, right = ([] if which != "right" else left), ([] if which != "left" else right)
    assert joined(spark, left, right, 50) == brute(left, right, 50)


def test_pairs_grow_with_the_rows(spark):
    """One key with all rows: a cell holds a few, and its rows don't overlap."""
    n = 4000
    rows = spark.range(n).select(F.col("id"), F.lit(1).cast("long").alias("key"), (F.col("id") * 3 + 1).alias("time"))
    points = spark.range(n).select(F.lit(1).cast("long").alias("key"), (F.col("id") * 3).alias("at"), F.struct("id").alias("row"), F.lit(1).cast("long").alias("n"))
    offered, bits = asof._in_cells(rows, points, 20_000, 64)
    assert offered.groupBy("key", "cell").count().agg(F.max("count")).first()[0] <= 65
    met = rows.alias("l").join(offered.alias("p"), (F.shiftright("l.time", bits) == F.col("p.cell")) & (F.col("at") <= F.col("time")) & F.coalesce(F.col("time") < F.col("until"), F.lit(True)))
    assert met.count() == n and met.where("at <> time - 1").count() == 0


def test_times(spark):
    """Microseconds of both kinds of timestamps, before 1970 too; floors go down."""
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.5' as a, timestamp'2024-03-31 02:30:00.000001 UTC' as b, timestamp_ntz'2024-03-31 02:30:00.000001' as c")
    r = df.select(micros(df, "a").alias("a"), micros(df, "b").alias("b"), micros(df, "c").alias("c"), floored(micros(df, "a"), 86_400_000_000).alias("f")).first()
    assert (r.a, r.f) == (-500_000, -86_400_000_000) and r.b == r.c == 1_711_852_200_000_001


def test_types_must_agree(spark):
    with pytest.raises(ValueError, match="types"):
        asof_join(spark.range(1).selectExpr("id", "id as k", "id as t"), spark.range(1).selectExpr("cast(id as int) as k", "id as t"), id="id", left_key="k", left_time="t", right_key="k", right_time="t", tolerance=1, rank=[F.col("t")], carry=["t"])
