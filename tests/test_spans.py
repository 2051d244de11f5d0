"""The index of spans: brute force, odd spans, one key with very many."""

import random

import pytest
from pyspark.sql import functions as F

from inventra.operators import joins, spans

POINTS, SPANS = "key string, p int, i int", "key string, lo int, hi int, s int"


def made(seed, points=120, held=150):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "b", None])
    lo = lambda: rng.choice([rng.randrange(-60, 300), 64, 0, -1, None])
    s = [(key(), a := lo(), None if a is None else a + rng.choice([-2, 0, 1, 63, 64, rng.randrange(200)]), i) for i in range(held)]
    p = [(key(), rng.choice([None, rng.randrange(-70, 400)]), i) for i in range(points)]
    return p + p[:3], s


def around(p, s):
    return p[0] is not None and p[0] == s[0] and None not in (p[1], s[1], s[2]) and s[1] <= p[1] <= s[2]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    p, s = made(seed)
    a, b = spark.createDataFrame(p, POINTS), spark.createDataFrame(s, SPANS)
    got = spans.stabbed(a, b, ["key"], "p", "lo", "hi").select("i", "s").collect()
    assert sorted(map(tuple, got)) == sorted((x[2], y[3]) for x in p for y in s if around(x, y))
    got = spans.outside(a, b, ["key"], "p", "lo", "hi").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((x for x in p if not any(around(x, y) for y in s)), key=repr)
    got = {r.i: r.found.s for r in spans.first_around(a, b, ["key"], "p", "lo", "hi", [-F.col("lo"), F.col("s")], ["s"], ["i"]).collect()}
    inner = {x[2]: min((-y[1], y[3]) for y in s if around(x, y))[1] for x in p if any(around(x, y) for y in s)}
    assert got == inner


def test_blocks_fill_spans_once(spark):
    """Every span up to 40 long, also below 0, is filled exactly, by few blocks."""
    all_spans = [("k", a, a + n, 1000 * n + a) for a in range(-20, 20) for n in range(40)]
    got = spans.blocks(spark.createDataFrame(all_spans, SPANS), "lo", "hi", 7).collect()
    cells = {}
    for r in got:
        cells.setdefault((r.lo, r.hi), []).extend(range(r.block << r.level, (r.block + 1) << r.level))
    assert all(sorted(held) == list(range(lo, hi + 1)) for (lo, hi), held in cells.items()) and len(cells) == len(all_spans)
    assert max(len([1 for r in got if (r.lo, r.hi) == key]) for key in [(-20, 19), (-19, 18), (0, 39)]) <= 12


def test_one_key_with_very_many(spark):
    """100000 spans and points of one key: rows by block, none of them gathered."""
    n = 100_000
    b = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 4).alias("lo"), (F.col("id") * 4 + 2).alias("hi"), F.col("id").alias("s"))
    a = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 4 + F.col("id") % 4).alias("p"), F.col("id").alias("i"))
    got = spans.stabbed(a, b, ["key"], "p", "lo", "hi")
    assert got.agg(F.count("*"), F.sum((F.col("i") == F.col("s")).cast("int"))).first() == (3 * n // 4, 3 * n // 4)
    # Spans around each other: a block keeps one of them.
    nest = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("lo"), (F.lit(2 * n) - F.col("id")).alias("hi"), F.col("id").alias("s"))
    got = joins.enclosing(a.where("p < 100000"), nest, "key", "p", "lo", "hi", "s", ["i"])
    assert got.agg(F.count("*"), F.max("enclosing")).first() == (n // 4, 0)


@pytest.mark.parametrize(("points", "held"), [(0, 5), (5, 0), (0, 0)])
def test_empty(spark, points, held):
    p, s = made(3, points, held)
    p = p[:points]
    a, b = spark.createDataFrame(p, POINTS), spark.createDataFrame(s, SPANS)
    assert spans.stabbed(a, b, ["key"], "p", "lo", "hi").count() == sum(around(x, y) for x in p for y in s)
    assert spans.outside(a, b, ["key"], "p", "lo", "hi").count() == sum(not any(around(x, y) for y in s) for x in p)


def test_spans_are_not_broadcast(spark):
    """A small file of spans makes many blocks, which the driver must not hold."""
    a, b = spark.createDataFrame([("a", 1, 1)], POINTS), spark.createDataFrame([("a", 0, 5, 1)], SPANS)
    near = spans.first_around(a, b, ["key"], "p", "lo", "hi", [F.col("lo")], ["s"], ["i"])
    for df in (spans.stabbed(a, b, ["key"], "p", "lo", "hi"), near, spans.outside(a, b, ["key"], "p", "lo", "hi")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan


@pytest.mark.parametrize("seed", [3, 4])
def test_outside_keeps_points_one_row(spark, seed):
    """Spans over several tiers, odd ends and repeated points; no point is multiplied."""
    rng = random.Random(seed)
    s = [("a", lo := rng.randrange(-9000, 9000), lo + rng.choice([0, 62, 63, 64, 65, 127, 4095, 4096, 4160, -1]), i) for i in range(12)]
    p = [("a", x, i) for lo, hi in ((s[i][1], s[i][2]) for i in range(12)) for x in (lo - 1, lo, lo + 1, hi - 1, hi, hi + 1, (lo + hi) // 2) for i in (0, 0, 1)]
    got = spans.outside(spark.createDataFrame(p, POINTS), spark.createDataFrame(s, SPANS), ["key"], "p", "lo", "hi")
    assert sorted(map(tuple, got.collect())) == sorted(x for x in p if not any(around(x, y) for y in s))
    assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString()
