"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mezze.llm import bpe, linedup, mixing, near, quality
from mezze.llm.common import saved, table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules keep; null and empty texts go with those of too few words, repeated rows stay alike."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; a document that had nothing else goes, n_chars follows the text. Columns as they came."""
    cleaned = linedup.remove_boilerplate(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = [F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cleaned.select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more. Ties: the smallest doc_id; see near.keep_one for rows without one."""
    return near.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a null source is a source, ties go by the text's hash."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: one row for each time the mix takes a document."""
    out = bpe.encode(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("encoding", encode)]
#: Exact fitting and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, n_tokens, ids. Every stage is written to the shared folder and read again.

    An empty table gives no rows; columns beyond those of `documents` are carried to the last stage; reruns agree.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
