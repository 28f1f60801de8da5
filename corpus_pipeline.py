"""Corpus pipeline: language ID, near-dedup, decontamination, PII and sampled subword encoding, one after the other.

Every stage works on all that its predecessor kept; each is written as Parquet in the shared folder and read again,
so a lost executor costs a stage at most.

Nulls: a row without text, or whose text has no letter, goes with the first stage; a null id is passed on, and such rows are told apart by their texts. Empty texts
go likewise; very long ones are worked on whole. Of equal rows, and of all near copies, one stays. Ties between languages go to the first by name. An empty table
gives an empty result; without a benchmark nothing is contaminated. Extra columns, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import common, decontaminate, language, neardup, pii, subword

#: Rows of one long that may be sent to all tasks.
FEW = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; lang becomes the predicted one, those without language go."""
    names = ("__lang", "__score", "__bits")  # beside whatever columns there are
    told = language.identify(docs, docs.columns, names=names).where(F.col(names[0]) != language.UNKNOWN)
    return told.withColumn("lang", F.col(names[0])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. A verdict depends on the text alone, so a text's hash is what it is reported and joined by:
    rows with equal ids, or none, are judged each by its own text."""
    text = "__decontaminate_h"  # beside whatever columns there are
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    flagged = common.staged(decontaminate.report(keyed, common.table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(text)).distinct(), "flagged")
    side = F.broadcast(flagged) if flagged.count() <= FEW else flagged
    return docs.withColumn(text, F.xxhash64("text")).join(side, text, "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data under pseudonyms; n_chars follows the text."""
    made = pii.pseudonymise(docs, kinds_as="__pii")
    return made.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def subword_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, with their scores."""
    return subword.digests(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", private_data),
    ("SentencePiece", subword_samples),
]

#: SQL can express none of language models, sketches and sampling; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{common.work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
