"""The training-data pipeline: quality, near copies, repeated passages, source mix, token ids.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but the last
keep the columns of ``documents``. Rows with null or empty texts pass every filter that does not
judge them: quality scores them like any text, near copies and passages do not concern them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm import near_dedup, pieces, quality_pu, source_mix, suffix_dedup

#: A document below this score is rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    net = quality_pu.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_pu.filter_rows(docs, net, QUALITY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.dedup(docs, k=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier."""
    return suffix_dedup.strip_repeats(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw by probabilities raked to the target margins of source, language and topic."""
    return source_mix.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text left, and whether they decode to it."""
    ids = pieces.encode(docs)
    return ids.select("doc_id", "n_ids", "ids", "ids_sha256", "decoded_sha256", "exact")


STAGES = [("quality", quality), ("near_dedup", near_copies), ("suffix_dedup", passages), ("source_mix", source_weights), ("pieces", token_ids)]
#: Training a classifier and encoding have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    from spectraloom.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir))
    return docs
