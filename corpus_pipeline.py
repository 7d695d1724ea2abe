"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents, without any further ones. Nulls:
rows with a null doc_id pass line dedup and near duplicates untouched; null texts
have no words, so the quality rules reject them. Rows of one doc_id with different
texts are documents of their own in every stage. A very long text is a row like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from faultline.llm.checkpoints import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of aligned blocks that an earlier one holds; those with no line left go."""
    found = line_dedup.dedup_lines(docs, every=True)
    kept = found.where("n_removed = 0 or n_removed < n_lines")
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each class of near duplicates."""
    return ngram_join.keep_first(docs.select(*COLUMNS))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = cut(decontamination.find_leaks(keyed, benchmark, spans=False).where("n_hit > 0").select(F.col("doc_id").alias("leak")).distinct())
    return docs.join(leaks, F.xxhash64("text") == F.col("leak"), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places in sequences of 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path()).drop("ids")


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", unique_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("packing", packed),
]

#: SQL has no tokeniser and no patience diff: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
