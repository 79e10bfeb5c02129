"""Governance of a document history: artifacts, references, rounds. Joins, anti-joins, conditional sums, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS, DEFAULT_ROWS = 500, 200


def artifact_rows(artifacts: DataFrame, refs: DataFrame, rounds: DataFrame, where: Column | None = None) -> DataFrame:
    """artifacts (path, kind, present, bytes), refs (path, doc_id, round_id), rounds (round_id, number): one row per referenced path.

    Filters go below the grouping, so they reach the scans; a filter on the round's columns drops references without one.
    """
    j = artifacts.join(refs, "path").join(rounds, "round_id", "left")
    if where is not None:
        j = j.where(where)
    return j.groupBy("path", "kind", "present", "bytes").agg(
        F.count("*").alias("refs"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("round_id").alias("rounds"), F.min("number").alias("first_round"), F.max("number").alias("last_round")
    )


def artifact_stats(rows: DataFrame) -> DataFrame:
    """One row of conditional sums over artifact rows."""
    return rows.agg(
        F.count("*").alias("artifacts"), F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("missing"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("present"), F.col("bytes"))), F.lit(0)).alias("present_bytes"), F.count_distinct("kind").alias("kinds"), F.sum("refs").alias("refs"),
    )


def page(rows: DataFrame, order: list[Column], limit: int = DEFAULT_ROWS, offset: int = 0) -> DataFrame:
    """limit is held to 1..500 and offset to 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST_ROWS)))


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys of either table without a row in the other: (key, side)."""
    a, b = left.select(F.col(left_key).alias("key")), right.select(F.col(right_key).alias("key"))
    one = lambda x, y, name: x.join(y, "key", "left_anti").distinct().withColumn("side", F.lit(name))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns: one aggregation with map-side maxima, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    best = F.max(F.struct(*order, *rest)).alias("m")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])


def upsert(base: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """base with the rows of changes in place of those with the same key. With order (columns that only changes has) the
    last change of a key by them wins; without, changes must be unique by key."""
    if order:
        changes = latest(changes, key, *order).select(*base.columns)
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_impact(refs: DataFrame, deleted: Column) -> DataFrame:
    """Paths that only deleted references name, with their number: they can go; the others are retained."""
    per = refs.groupBy("path").agg(F.count_if(deleted).alias("deleted_refs"), F.count_if(~deleted).alias("kept_refs"))
    return per.where("deleted_refs > 0").withColumn("removable", F.col("kept_refs") == 0)


def next_round(done: DataFrame, key: str, number: str, most: int) -> DataFrame:
    """The first of rounds 1..most that a key hasn't completed; null when all are."""
    have = done.where(F.col(number).between(1, most)).groupBy(key).agg(F.collect_set(number).alias("have"))  # at most `most` numbers
    return done.select(key).distinct().join(have, key, "left").select(key, F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.coalesce("have", F.array().cast("array<int>")))).alias("next_round"))


def keep_newest(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= keep)


def kind_stats(rows: DataFrame, kinds: DataFrame, kind: str, size: str) -> DataFrame:
    """Counts and sums by kind, with zeros for kinds without rows."""
    per = rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    return kinds.join(per, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
