"""The corpus pipeline: quality, repeated passages, near-duplicates, benchmark items, packing.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept. All but the last
return the columns of ``documents``; the last one returns the pieces of the packed sequences.
Extra columns are carried through; a null ``doc_id``, null and empty texts, repeated rows and
empty tables are handled as the operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import attention_quality, decontamination, line_dedup, near_dedup, packing
from barline.llm.queries import tokenizer
from barline.llm.textops import table
from barline.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones of ``docs``."""
    return attention_quality.keep(docs, attention_quality.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occurred earlier."""
    return line_dedup.clean(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_matches(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    got = packing.pack(docs, tokenizer())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pack", pack)]

#: The classifier and the packing are not SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
