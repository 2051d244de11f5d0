"""Exact dedup: brute force, batches, the index on disk, empty tables."""

import hashlib
import re
import uuid

import pytest
from corpus import SCHEMA, corpus
from pyspark.sql import functions as F

from inventra.llm.digests import DigestIndex, deduplicated, digested
from inventra.llm.tables import shared_dir


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    """(doc_id, digest) -> (keep_id, group_size), and how many rows of a digest stay."""
    groups = {}
    for i, text in rows:
        groups.setdefault(digest(text), []).append(i)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    return {d: (least(ids), len(ids)) for d, ids in groups.items()}, sorted((i is None, i or 0, d) for d, ids in groups.items() for i in ids)


@pytest.mark.parametrize(("batches", "hot"), [(1, 1000), (2, 3), (5, 1000)])
def test_equals_brute_force(spark, batches, hot):
    rows = [(i, t) for i, t, *_ in corpus(3, 60)] + [(7, " a\tb\n\nc "), (8, " a b c "), (9, "a b c"), (10, "x\x85y"), (11, "x y"), (7, " a\tb\n\nc ")]
    df = spark.createDataFrame([(*r, 1, b"d", 1) for r in rows], "doc_id long, text string, row int, digest binary, batch int").repartition(3)
    got = deduplicated(df, batches=batches, hot=hot).withColumn("d", F.lower(F.hex("digest"))).collect()
    groups, want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.d) for r in got) == want
    assert all((r.keep_id, r.group_size) == groups[r.d] for r in got)
    # One row of each group stays, and it has the id that the others name.
    assert sorted(r.d for r in got if r.kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_index_lives_on(spark):
    """A later batch finds what an earlier one left, also by path alone; adding again adds nothing."""
    make = lambda *rows: digested(spark.createDataFrame(list(rows), "doc_id long, text string"))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    index = DigestIndex(spark, path, 4)
    one, two = make((5, "a  b"), (6, "c")), make((1, "a b"), (2, "d"), (3, "d"))
    index.add(one, "one")
    spark.sql(f"drop table {index.name}")
    index = DigestIndex(spark, path, 4)
    index.add(two, "two")
    index.add(two, "two")
    assert index.table().count() == 3
    got = index.resolved(two.withColumn("batch", F.lit("two"))).collect()
    # What came first stays, whatever its id.
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False)]
    plan = index._dealt(two.groupBy("digest").agg(F.first("digest").alias("d")).select(F.col("d").alias("digest"))).join(index.table().hint("merge"), "digest", "left_anti")
    said = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in said and "Bucketed: true" in said
    index.removed()


def test_empty(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []
    got = deduplicated(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(None, None, 1, True)]
