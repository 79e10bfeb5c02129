"""Folders of files as a table: what no record refers to any more, and backups of tables that are kept by recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textaudit.operators.history import keep_newest

#: Files of a scan that are listed; all are counted.
LISTED = 200


def listing(spark: SparkSession, folders: dict[str, str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(kind, path, relative, bytes, modified) of the files under each kind's folder, of any store that Spark reads; contents are not read.

    suffixes: the endings (with their dot, any case) that may be cleaned; others are not listed. Hidden files and those below hidden folders aren't, either.
    """
    out = None
    for kind, folder in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)|/+$", "")
        root = bare(F.lit(folder))
        path = bare(F.col("path"))
        mine = files.select(F.lit(kind).alias("kind"), path.alias("path"), F.substring(path, F.length(root) + 2, F.length(path)).alias("relative"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
        out = mine if out is None else out.unionByName(mine)
    wanted = F.lit(not suffixes)
    for s in suffixes:
        wanted = wanted | F.endswith(F.lower("path"), F.lit(s.lower()))
    return out.where(wanted & ~F.col("relative").rlike(r"(?:^|/)\."))


def orphans(files: DataFrame, references: DataFrame, path: str = "path") -> DataFrame:
    """The files to which no reference points. Paths are compared without a scheme, with / for \\, and without steps that stay in place."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), r"^[A-Za-z][A-Za-z0-9+.-]+:/*(?=/)", ""), r"(?:/\.)+(?=/|$)|/+(?=/)", "")
    known = references.select(plain(F.col(path)).alias("_known")).where("_known <> ''").distinct()
    return files.join(known, plain(files["path"]) == F.col("_known"), "left_anti")


def orphan_scan(files: DataFrame, references: DataFrame, path: str = "path", listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """(page, totals): the first `listed` orphans by kind and relative path, and one row for each kind: files and orphans with their bytes, and has_more, whether
    there are more orphans in all than are listed. Kinds without files have no row."""
    gone = orphans(files, references, path)
    page = gone.orderBy("kind", F.lower("relative"), "relative").limit(listed)
    per = lambda df, n: df.groupBy("kind").agg(F.count("*").alias(n), F.sum("bytes").alias(f"{n}_bytes"))
    totals = per(files, "files").join(per(gone, "orphans"), "kind", "left").fillna(0, ["orphans", "orphans_bytes"])
    return page, totals.withColumn("has_more", F.sum("orphans").over(Window.partitionBy()) > listed)  # a row for each kind


def back_up(table: DataFrame, folder: str, stamp: str) -> str:
    """Writes a table as gzipped JSON lines under folder/stamp; the write is committed as a whole or not at all. Returns the path."""
    where = f"{folder.rstrip('/')}/{stamp}"
    table.write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", "false").json(where)
    return where


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """(stamp, bytes, parts) of the backups in a folder; what a write that was cut off has left in its temporary folder isn't seen."""
    stamp = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").option("recursiveFileLookup", "true").load(folder).select(stamp.alias("stamp"), "length")
    return whole.groupBy("stamp").agg(F.sum("length").alias("bytes"), F.count("*").alias("parts"))


def to_prune(kept: DataFrame, keep: int) -> DataFrame:
    """The backups that go when the `keep` newest stay, by stamp."""
    return kept.join(keep_newest(kept.withColumn("_all", F.lit(1)), "_all", [F.desc("stamp")], keep).select("stamp"), "stamp", "left_anti")
