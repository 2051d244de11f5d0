"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by their class log-count ratios, a linear
hinge-loss model is fitted to them by dual coordinate descent, and margins are
turned to probabilities by a logistic curve fitted to margins of rows that the
respective model didn't see.

The model learns from at most ``most`` labelled rows with ``most_bytes`` of text
together, those with the least hash of their id (documented bounds: the sample
alone comes to the driver); scoring covers every row and every whole text, in
Arrow batches, and needs no shuffle.

Defined results: a null or empty text has only its length's features and is
scored by them.  A label for an id that several rows share counts once, for the
least text; repeated rows are scored each.  Labels other than 0 and 1 are left
out.  With one class only (or no labels) every score is that class's smoothed
share.  An empty table gives no rows.  Further columns stay; one that has the
name of the score gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventra.llm.blocks import freed
from inventra.llm.linear import SIZE, features, fitted, held_margins, logistic, margins
from inventra.llm.words import slices

MOST, MOST_BYTES = 4000, 64_000_000


@dataclass
class Linear:
    """A score from 0 to 1: logistic of slope times margin plus offset."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    often: bool = False

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        margin = margins(self.weight, self.bias, *features(texts, self.often))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))

    def column(self, text: str) -> Column:
        weight, rest = self.weight.astype(np.float32), (self.bias, self.slope, self.offset, self.often)

        def run(batches):
            model = Linear(weight, *rest)
            for batch in batches:
                texts = batch.to_pylist()
                parts = [model.scores(texts[a:b]) for a, b in slices(texts)]
                yield freed(pa.array(np.concatenate(parts) if parts else [], pa.float64()))

        from collections.abc import Iterator

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "double")(F.col(text).cast("binary"))


def _bounded(rows: DataFrame, most_bytes: int) -> list:
    """Rows (_id, _label, _text) in order of the ids' hash, as many as hold at
    most ``most_bytes`` of text together, and one at least."""
    order = Window.orderBy(F.xxhash64("_id"), "_id")
    before = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("_held", before).withColumn("_at", F.row_number().over(order))
    out = held.where((F.col("_held") <= most_bytes) | (F.col("_at") == 1)).select("_id", "_label", "_text").collect()
    return sorted(out, key=lambda r: r["_id"])


def _known(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    own = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return own.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))


def _bytes(rows: list) -> list[bytes | None]:
    return [None if r["_text"] is None else bytes(r["_text"]) for r in rows]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, most_bytes: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[bytes | None], np.ndarray]:
    """Texts and labels of at most ``most`` ids with ``most_bytes`` of text, in
    order of id; ``learn`` says of a doc_id whether its label may be used."""
    own = _known(labels, label, learn).orderBy(F.xxhash64("_id"), "_id").limit(most)
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(own), "_id")
    rows = _bounded(joined.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")), most_bytes)
    return _bytes(rows), np.array([r["_label"] for r in rows], float)


def plain_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, most_bytes: int, doc_id: str = "doc_id", text: str = "text") -> list[bytes | None]:
    """Texts of at most ``most`` ids without a label, likewise."""
    ids = docs.select(F.col(doc_id).alias("doc_id")).where(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"))
    own = ids.join(_known(labels, label, learn), "_id", "left_anti").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(own), "_id")
    return _bytes(_bounded(joined.groupBy("_id").agg(F.min("_text").alias("_text"), F.lit(0).alias("_label")), most_bytes))


def constant(label: np.ndarray) -> Linear:
    """The smoothed share of label 1 as every text's score."""
    share = (label.sum() + 1) / (len(label) + 2)
    return Linear(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))


def fit(texts: list[bytes | None], label: np.ndarray, often: bool = False) -> Linear:
    if len(label) < 2 or label.min() == label.max():
        return constant(label)
    place, first = features(texts, often)
    slope, offset = logistic(held_margins(place, first, label), label)
    weight, bias = fitted(place, first, label)
    return Linear(weight, bias, slope, offset, often)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", most: int = MOST, most_bytes: int = MOST_BYTES, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``: how likely label 1 is."""
    texts, known = labelled_sample(docs, labels, label, learn, most, most_bytes, doc_id, text)
    return docs.withColumn(score, fit(texts, known).column(text))
