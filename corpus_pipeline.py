"""Corpus pipeline over ``documents``: quality rules, exact and near deduplication, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, exact_dedup, mixing, ngram_join, quality
from quillon.llm.common import delete, scratch, shared_dir, stored, table
from quillon.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them."""
    return quality.passing(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest id stays."""
    return exact_dedup.unique(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.75 or more, the row with the smallest id stays."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document zero, one or two times."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and digests of them and of the text they decode to."""
    rows = bpe.round_trip(docs, tokenizer())
    return rows.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    When a stage is written, its input's copy and the side tables of its operators go.
    """
    docs, top, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{top}/{k}-{name}")
        if before:
            delete(spark, before)
        before = f"{top}/{k}-{name}"
    return docs
