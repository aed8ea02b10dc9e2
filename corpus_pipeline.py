"""A training corpus from raw documents, stage by stage; each stage is one of the numbered operators.

Counted as part of the ``llm`` subpackage.  Each function takes (spark, docs,
sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumiframe.llm import decontam, langid, packing, quality, simhash
from lumiframe.llm.common import crc_mod, remove, scratch, shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores under 0.3."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return quality.reject_low_quality(docs, model, threshold=0.3)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of no sure language."""
    return langid.keep_known_language(docs, langid.fit(docs.where(crc_mod("doc_id", 3) != 1)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates, row by row."""
    return simhash.keep_one_row_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, and their places in sequences of 1024 ids."""
    return packing.pack_documents(docs, capacity=1024)


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A trained classifier decides in the first stages: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again.

    What a stage's operator wrote on the way goes when the stage is written, and its
    input when the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/lumiframe/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
