"""Corpus pipeline: toxicity → line dedup → n-gram Jaccard join → benchmark decontamination → best-fit packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from tickweave.llm.frames import DOCUMENT_COLUMNS, table
from tickweave.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches 0.7 go; the model learns from the labelled documents that came in."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rejected = toxicity.flagged(docs, model, threshold=0.7)
    return rejected.filter("NOT _toxic").select(*DOCUMENT_COLUMNS)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from later documents; documents of which nothing is left go."""
    done = line_dedup.line_dedup(docs.select(*DOCUMENT_COLUMNS), rare=line_dedup.RARE)
    left = done.filter("n_deleted = 0 OR trim(text) <> ''")
    changed = F.col("n_deleted") > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return jaccard_join.first_of_each(docs, size=5, percent=80).select(*DOCUMENT_COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's windows go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_copied_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: The trained network and the alignment have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to `documents`; each stage's result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            break
        if shared:
            path = f"{shared}/pipeline-{uuid.uuid4().hex}-{number}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        else:
            docs = cut(docs)
    return docs
