"""The text pipeline: quality rules, near copies, secrets, mixing, tokens. Each stage takes the documents its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from popmeasure.llm import bpe, common, mixing, novelty, quality, similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their stratum's certified cutoffs go."""
    return quality.passing(docs, common.labels(common.small_batches(spark), sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    common.small_batches(spark)
    return similar.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    common.small_batches(spark)
    return novelty.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out so that the domains' tokens meet their targets."""
    return mixing.repeated(docs, common.labels(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    common.small_batches(common.ready(spark))
    return bpe.tokenised(docs).drop("decoded")


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("secret_scan", secret_scan), ("mixing", mix), ("tokens", tokens)]
#: The cutoffs, fingerprints, compressor and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{common.shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
