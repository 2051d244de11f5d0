"""The corpus pipeline: five stages over ``documents``, each written as Parquet
to the shared folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.llm import queries as Q
from inventra.llm.bpe import encode_decode
from inventra.llm.decontaminate import leaks
from inventra.llm.jaccard_join import jaccard_components
from inventra.llm.quality import quality_scores
from inventra.llm.repeats import repeated_spans
from inventra.llm.tables import stored

#: Bytes of text a block holds here: less than in the operators alone, as all
#: stages share the executors and what they keep of earlier ones.
BLOCK_BYTES = 4_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality_scores(docs, Q.table(spark, sf_dir, "labels"), Q.remainder(5) != 0, score="_score")
    return scored.where(F.col("_score") >= 0.3).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, and
    all its texts.  Rows that repeat an id and its text go to one; rows without
    id stay."""
    found = jaccard_components(docs, k=5, percent=80, block_bytes=BLOCK_BYTES).where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    # Only ids that repeat have their texts shuffled.
    many = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = left.join(many, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "text", "_row.*")
    return left.join(many, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what an earlier one holds; cut code points go, and
    documents of which nothing is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    done = repeated_spans(docs, block_bytes=BLOCK_BYTES, carry=rest, whole_points=True).select("doc_id", F.col("kept").cast("string").alias("text"), "carry.*")
    return done.withColumn("n_chars", F.length("text").cast("long")).where("length(text) > 0").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark text stands.  A row is known by its id and
    text, so another text of the same id, or of none, stays."""
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = leaks(keyed, Q.table(spark, sf_dir, "benchmark"), doc_id="_key").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of what is left, as digests."""
    return Q.bpe_digests(encode_decode(docs, Q.tokenizer_json(), block_bytes=BLOCK_BYTES))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", encode)]

#: The classifier and the tokenizer have no SQL twin; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Q.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
