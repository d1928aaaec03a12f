"""From raw documents to packed training sequences in five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilith.llm.common import shared_folder
from trilith.llm.ngram_jaccard import drop_near_duplicates
from trilith.llm.packing import pack
from trilith.llm.pii import sanitise
from trilith.llm.quality import drop_rejected, ratings_of
from trilith.llm.substring_dedup import drop_repeats


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    return drop_rejected(docs, ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, in one row: the next stage takes rows for documents."""
    return drop_near_duplicates(docs, one_row=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows of 35 words go."""
    return _as_documents(drop_repeats(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and the terms that disclose them become labels."""
    return _as_documents(sanitise(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their token ids."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Classifier and tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes once the next one is written; the last but one's stays, as the result reads it."""
    shared = f"{shared_folder(spark, 'pipeline')}/pipeline-{uuid.uuid4()}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
        if last:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{shared}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
