"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality    documents that the quality classifier (learnt from the labelled rows) rejects go
lines      lines that another document (or an earlier place) keeps go; so do documents that lose all their lines
near       one document of each group of copies and near copies stays, the one with the least id
benchmark  documents that hold a benchmark item go
encode     what is left is encoded to token ids and decoded again
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textaudit.llm import bpe, decontaminate, linededup, neardup, quality
from textaudit.llm.common import Scratch, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that a classifier learnt from the labelled ones doesn't reject. Null and empty texts go by its bias alone; repeated rows
    share a fate; without labels of both kinds all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place keeps. Those that lose all they hold go; empty ones before stay.

    Rows are told apart by id and text (linededup.dedup_lines). n_chars, where there is one, follows the text.
    """
    out = linededup.dedup_lines(docs)
    dropped = out.columns[len(docs.columns)]
    out = out.where(F.col(dropped).isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of copies and near copies, the least by id and text; null and empty texts all stay."""
    return neardup.drop_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item. Null and empty texts stay, repeated rows share a fate; an empty benchmark leaves all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as its id, token ids, their number and digest, and the digest of the text decoded from them; null texts encode as empty ones."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("encode", encode_stage)]
#: SQL can't express the fitted classifier: tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of documents, encoded. Each stage's table goes once the next one's is written; the last is
    read by what is returned."""
    scratch, before = Scratch(spark, "pipeline"), []
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
