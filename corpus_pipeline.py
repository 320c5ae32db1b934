"""A corpus pipeline of five stages: toxic documents go, near copies go, personal data is masked, sources are mixed to
their target weights, and the texts are encoded. Each stage takes all that its predecessor kept.

Defined results, for the pipeline as for its stages: null and empty texts aren't toxic, have no copies and no personal data,
count no words (so a source without words leaves the mix), and encode to the blank; null ids are ids like others; rows of
equal id and text are one document; very long texts are read whole; an empty table gives an empty result; other columns
pass through, but for those named like the encoding's new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, ngram_join, pii, sp_sampling, toxicity
from graphloom.llm.common import dropped, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), drop_toxic=True)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_sampling.encode(docs, k=2)


STAGES = [("toxicity", without_toxic), ("ngram_join", without_copies), ("pii", without_personal_data), ("mixing", mixed), ("sentencepiece", encoded)]

#: The classifiers and the sampled encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)  # its only reader has been written
        before = docs
    return docs
