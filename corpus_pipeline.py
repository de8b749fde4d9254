"""From raw documents to packed sequences: the stages of a training-data pipeline.

Each stage takes what the one before it kept and calls one operator of `leafwork.llm`; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwork.llm import jaccard, packing, pii, quality, toxicity
from leafwork.llm.queries import prepared, tokenizer_path
from leafwork.session import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rated toxic go; the labels come with the input."""
    prepared(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go; the language model is counted over this stage's input."""
    prepared(spark)
    return quality.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one stays. On word shingles: five words, a similarity of 0.8 or more."""
    prepared(spark)
    return jaccard.keep_one(docs, jaccard.Measure(words=5, percent=80))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    prepared(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenized and packed into sequences, mixed by source."""
    prepared(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("PII", redact),
    ("packing", pack),
]

# The stages learn models and tokenize, which SQL cannot express; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
