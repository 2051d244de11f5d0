"""The thin queries of this subpackage: each applies one operator to its whole
table and derives the digest columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % n


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The definition of a public tokenizer; its place is that package's."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.quality import quality_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality_scores(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return judged(done, remainder(5) == 0, 0.3)


def judged(done: DataFrame, held_out: Column, cutoff: float) -> DataFrame:
    return done.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.bpe import encode_decode

    done = encode_decode(table(spark, sf_dir, "documents"), tokenizer_json())
    return bpe_digests(done)


def bpe_digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.shards import sharded

    return sharded(table(spark, sf_dir, "documents"), 8)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.toxicity import toxicity_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity_scores(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return judged(done, remainder(3) == 1, 0.7)


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.katz import katz_scores

    docs = table(spark, sf_dir, "documents")
    # With triples the check tool projects more than its budget of disk: README.
    done = katz_scores(docs, remainder(5) != 1, order=2)
    floor = F.log10(F.col("train_tokens") + 0.5 * (F.col("train_words") + 1))
    return done.select("doc_id", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", (F.col("base_sum") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.main_text import main_texts

    done = main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.repeats import repeated_spans

    done = repeated_spans(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.rules import judged as judge

    done = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.asof import asof_join, floored, micros

    hour = 3_600_000_000
    day = lambda h, t: F.when(h % 2 == 1, floored(t, 24 * hour)).otherwise(t)
    crc = lambda c: F.crc32(F.col(c).cast("string"))
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    clicks = clicks.select("click_id", "client_id", day(crc("click_id"), micros(clicks, "ts")).alias("ts_us"))
    cents = F.when(~F.isnan("total"), F.floor(F.lit(100) * F.col("total") + 0.5).cast("long"))
    sales = sales.select("client_id", day(crc("sale_id"), micros(sales, "sold_at")).alias("at"), cents.alias("total_cents"), "sale_id", "priority", crc("sale_id").alias("h"))
    one = F.struct(F.col("sale_id").alias("sale_id"), F.col("priority").alias("priority"))
    other = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    orders = sales.withColumn("made", F.explode(F.when(F.col("h") % 3 != 0, F.array(one, other)).otherwise(F.array(one)))).select("client_id", "at", "total_cents", "made.*")
    rank = [F.col("priority").isNull(), -F.col("priority"), F.col("sale_id").isNull(), F.col("sale_id")]
    done = asof_join(clicks, orders, id="click_id", left_key="client_id", left_time="ts_us", right_key="client_id", right_time="at", tolerance=72 * hour, rank=rank, carry=["sale_id", "total_cents"])
    return done.select(
        F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("time").alias("ts_us"), "row.sale_id",
        (F.col("time") - F.col("at")).alias("lag_us"), "row.total_cents", F.col("n").alias("n_tied"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.digests import deduplicated

    done = deduplicated(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inventra.llm.elkan import clustered

    done = clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, salt="2:")
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_quality, op3_bpe, op4_decontaminate, op5_shards, op6_toxicity, op7_katz, op8_main_text, op9_repeats, op10_rules, op11_asof, op12_exact_dedup, op13_elkan)}


def oracle_sql() -> dict[str, str]:
    from inventra.llm import oracles

    return oracles.oracle_sql()
