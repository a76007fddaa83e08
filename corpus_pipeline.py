"""Corpus pipeline: each stage works on the documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from claimweave.llm.common import text_batches
from claimweave.llm.queries import own_folder, table, training_labels
from claimweave.session import cut_lineage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, training_labels(spark, sf_dir))


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near and exact copies the document with the smallest id stays."""
    with text_batches(spark):
        return ngram_join.drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written; what they hold of each document is returned."""
    path = own_folder(spark, "token-shards")
    token_files.write_token_shards(docs, path)
    return token_files.read_token_shards(spark, path)


STAGES = [
    ("toxicity", toxic),
    ("n-gram Jaccard join", similar),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Compression lengths and token ids have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with text_batches(spark):
        for _, stage in STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
