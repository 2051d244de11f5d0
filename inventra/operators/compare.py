"""Comparison of inventories: changes over time, and detection against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """added, removed, changed or same by key; of repeated keys the last row
    counts; changes name the fields that differ (null is a value)."""
    last = lambda df, side: df.groupBy(*keys).agg(F.max_by(F.struct(*compared), "ord").alias(side))
    both = last(old, "o").join(last(new, "n"), keys, "full_outer")
    differs = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in compared]
    changes = F.filter(F.array(*differs), lambda x: x.isNotNull())
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(changes) > 0, "changed").otherwise("same")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", F.concat_ws(",", changes)).otherwise("").alias("fields"))


def diff_summary(d: DataFrame, by: str) -> DataFrame:
    return d.groupBy(by).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "same")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of rows with tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def benchmark_counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """By category: expected and found numbers give tp, fp and fn."""
    d = found.groupBy("category").agg(F.count("*").alias("detected"))
    both = truth.join(d, "category", "full_outer").select("category", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("detected", F.lit(0)).alias("detected"))
    zero = F.lit(0)
    return prf(both.select("*", F.least("expected", "detected").alias("tp"), F.greatest(F.col("detected") - F.col("expected"), zero).alias("fp"), F.greatest(F.col("expected") - F.col("detected"), zero).alias("fn")))


def benchmark_names(truth: DataFrame, found: DataFrame) -> DataFrame:
    """By category, over sets of lower-case names; detected counts rows, repeated
    names as often as they stand."""
    t = truth.select("category", F.lower("name").alias("name")).distinct().withColumn("_t", F.lit(1))
    f = found.groupBy("category", F.lower("name").alias("name")).agg(F.count("*").alias("_f"))
    both = t.join(f, ["category", "name"], "full_outer")
    return prf(both.groupBy("category").agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("detected"), F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn")))


def overall(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 over all categories' counts."""
    return prf(counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))


def sets(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Exact comparison of two sets of identities: one row of counts."""
    p, e = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)), expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    both = p.join(e, keys, "full_outer")
    return prf(both.agg(F.count_if(F.col("_p").isNotNull() & F.col("_e").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn")))


def decisions(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row: how many labelled cases have the right action (of a
    reclassification the right type as well), the share that was decided at all,
    and the mean F1 of the actions, where a missing decision is a miss of its
    action alone.  Both sides have ``action`` and ``target_type``."""
    e = expected.select(key, F.col("action").alias("e"), F.col("target_type").alias("et"))
    p = predicted.select(key, F.col("action").alias("p"), F.col("target_type").alias("pt"))
    j = e.join(p, key, "left")
    typed = (F.col("e") != "reclassify") | (F.coalesce("et", F.lit("")) == "") | F.coalesce(F.col("et") == F.col("pt"), F.lit(False))
    right = F.coalesce(F.col("e") == F.col("p"), F.lit(False)) & typed
    sums = j.agg(F.count("*").alias("cases"), F.count_if(right).alias("correct"), F.count("p").alias("decided"))
    f1 = action_scores(j.groupBy(F.col("e").alias("expected"), F.coalesce("p", F.lit("abstain")).alias("predicted")).agg(F.count("*").alias("n"))).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    share = lambda c: F.round(ratio(F.col(c), F.col("cases")), 6)
    both = sums.unionByName(f1, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("cases", "correct", "decided", "macro_f1")))
    return both.select("cases", "correct", share("correct").alias("accuracy"), share("decided").alias("coverage"), "macro_f1")


def confusion(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """How often each action was expected and predicted; a missing prediction abstains."""
    j = expected.join(predicted, key, "left")
    return j.groupBy("expected", F.coalesce("predicted", F.lit("abstain")).alias("predicted")).agg(F.count("*").alias("n"))


def action_scores(matrix: DataFrame) -> DataFrame:
    """Per action precision, recall and F1 from the confusion matrix."""
    cells = matrix.select(F.explode(F.array(F.struct(F.col("expected").alias("action"), F.lit("e").alias("side")), F.struct(F.col("predicted").alias("action"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("expected") == F.col("predicted")).alias("hit"))
    sums = cells.where("x.action <> 'abstain'").groupBy(F.col("x.action").alias("action")).agg(
        F.sum(F.when((F.col("x.side") == "e") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("x.side") == "p") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("x.side") == "e") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"))
    return prf(sums)


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows each category has."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))
