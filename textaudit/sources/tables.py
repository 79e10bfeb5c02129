"""Reading and writing: tables of a scale folder, tolerant journals, retention of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "version int, signature string, chunk_id string, output_text string, output_sha256 string, updated_at string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their SHA-256; valid says whether the bytes are UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def content_addressed(texts: DataFrame) -> DataFrame:
    """One row per content: the first path keeps it, n counts the paths."""
    return texts.groupBy("sha256").agg(F.min("path").alias("path"), F.first("bytes").alias("bytes"), F.count("*").alias("n"))


def read_journal(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """JSON lines of a checkpoint journal; torn lines, other versions and texts that don't match their hash are dropped."""
    rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    return rows.where((F.col("version") == version) & (F.sha2("output_text", 256) == F.col("output_sha256")))


def completed_chunks(journal: DataFrame, signature: str) -> DataFrame:
    """The last record of each chunk with this signature."""
    mine = journal.where(F.col("signature") == signature)
    return mine.groupBy("chunk_id").agg(F.max(F.struct("updated_at", "output_text")).alias("m")).select("chunk_id", "m.output_text", "m.updated_at")


def append_journal(rows: DataFrame, path: str) -> None:
    rows.withColumn("output_sha256", F.sha2("output_text", 256)).write.mode("append").json(path)
