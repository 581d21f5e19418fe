"""A corpus pipeline of the training-data operators: each stage's output is written as Parquet and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import Scratch, table
from strandwise.llm.line_dedup import dedup_lines
from strandwise.llm.packing import best_fit_packing, doc_tokens
from strandwise.llm.quality import quality_rules
from strandwise.llm.simhash import drop_near_duplicates
from strandwise.llm.substring import dedup_substrings


def _as_documents(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed with the columns of docs, n_chars following the text."""
    out = changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed
    return out.select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    judged = quality_rules(docs).filter("kept").withColumn("text", F.col("clean_text"))
    return _as_documents(docs, judged)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one."""
    return _as_documents(docs, dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those that share 0.8 of their five-word shingles."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return _as_documents(docs, dedup_substrings(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the packed sequences."""
    return best_fit_packing(docs, doc_tokens())


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = scratch.keep(docs)
    return docs


#: SimHash fingerprints and best-fit bins have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None
