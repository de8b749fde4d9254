"""The registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import (
    bpe, divergence, jaccard, language, mixing, neighbours, packing, pii, quality, sharding, toxicity, warc, whitening,
)
from leafwork.session import prepare


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings results rest on, and bounded batches for Python."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepared(spark), sf_dir)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@ready
def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.find_spans(documents(spark, sf_dir)))


@ready
def op2_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@ready
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(documents(spark, sf_dir))


@ready
def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(documents(spark, sf_dir))


@ready
def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


@ready
def op6_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(documents(spark, sf_dir))


@ready
def op7_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.rate_documents(documents(spark, sf_dir), labels)


@ready
def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@ready
def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode_documents(documents(spark, sf_dir), path)
    decoded = bpe.decode_documents(encoded, path)
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@ready
def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@ready
def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@ready
def op12_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@ready
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_boosting, op2_product_quantisation, op3_ngram_jaccard, op4_cross_parsing, op5_mixture_packing,
        op6_kneser_ney_rules, op7_subsequence_svm, op8_zip_warc, op9_bpe_tree, op10_kd_sharding, op11_lanczos_whitening,
        op12_pivotal_mixing, op13_source_audit,
    )
}
ORACLES: dict[str, str] = {"op12_pivotal_mixing": mixing.mixing_sql(), "op13_source_audit": divergence.AUDIT_SQL}
