"""The corpus pipeline: language, quality, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``; the last one adds n_tokens, ids, parity and
round_trip. Models are trained on the rows the queries train on (see the
operators): the language models on the stage's own input, the quality trees on
the labels of the documents that reached the stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridekit.llm import decontam, langid, neardup, pieces, quality
from stridekit.session import ensure_checkpoint_dir
from stridekit.sources.tables import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (the operator's calibrated rejection drops the rest)."""
    model = langid.train(langid.training_rows(docs))
    return langid.drop_rejected(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees score 0.5 or more."""
    model = quality.train(docs, quality.training_labels(read_table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    return neardup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark n-gram occurs."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), action="documents")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the parity of the two libraries, and whether the ids decode to the text."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", distinct_documents),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", tokens),
]

#: Trained models and tokenizers have no SQL form: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows between stages are kept as Parquet in a new folder of spark.checkpoint.dir."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
