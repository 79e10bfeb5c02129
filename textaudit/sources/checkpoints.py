"""Resuming runs: a compacted snapshot and an append-only journal, merged by precedence, against the manifest of what is to be done.

A snapshot's outputs are authoritative; the journal adds the last valid record of each other chunk. So a crash between the writing of a
snapshot and the removal of its journal changes nothing, and resuming twice gives the same. A run whose snapshot was made for
something else is a conflict, never a restart, as long as it or its journal holds anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textaudit.sources.tables import JOURNAL

SNAPSHOT = "run_id string, signature map<string,string>, completed boolean, updated_at string, chunk_outputs map<string,string>"
VERSION = 1


class CheckpointConflict(ValueError):
    """Saved work that doesn't belong to the present state of its document."""


def signature_digest(signature: Column) -> Column:
    """SHA-256 of a signature's fields in the order of their names; nulls are fields without a value."""
    fields = F.transform(F.map_entries(signature), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.array_join(F.array_sort(fields), "\n"), 256)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file, as SNAPSHOT; damaged files are no snapshots (their runs resume from the journal)."""
    rows = spark.read.schema(SNAPSHOT + ", _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").option("wholetext", "true").option("multiLine", "true").json(path)
    return rows.where("_damaged is null and run_id is not null").drop("_damaged")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with seq, a number that grows along each writer's records (0 where it wrote none). Torn lines count as nothing."""
    rows = spark.read.schema(JOURNAL + ", run_id string, seq long").option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("seq", F.coalesce("seq", F.lit(0)))


def valid_records(journal: DataFrame) -> DataFrame:
    """Records of this version with a chunk and a text that has its hash."""
    return journal.where((F.col("version") == VERSION) & F.col("chunk_id").isNotNull() & (F.col("chunk_id") != "") & (F.sha2("output_text", 256) == F.col("output_sha256")))


def run_states(expected: DataFrame, snapshots: DataFrame, journal: DataFrame) -> DataFrame:
    """(run_id, state, mismatched, digest), one row for each row of expected (run_id, signature).

    state: fresh (nothing usable was saved), resume, completed, or conflict; mismatched are the names of the fields in which the snapshot differs.
    Of several snapshots of a run the last counts.
    """
    e = expected.select("run_id", F.col("signature").alias("_want")).withColumn("digest", signature_digest(F.col("_want")))
    last = snapshots.groupBy("run_id").agg(F.max_by(F.struct("signature", F.coalesce("completed", F.lit(False)).alias("completed"), _filled("chunk_outputs").alias("outputs")), F.struct(F.coalesce("updated_at", F.lit("")), F.to_json("signature"))).alias("s"))
    good = valid_records(journal)
    kept = good.groupBy("run_id").agg(F.collect_set("signature").alias("signatures"))  # a run has been signed a few times
    out = e.join(last, "run_id", "left").join(kept, "run_id", "left")
    # concat_ws tells apart a field without a value from one with an empty one only by name; values are compared null-safely
    differs = F.filter(F.map_keys("_want"), lambda k: ~F.try_element_at(F.col("_want"), k).eqNullSafe(F.try_element_at(F.coalesce("s.signature", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), k)))
    mismatched = F.when(F.col("s").isNotNull(), F.array_sort(differs)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("mismatched", mismatched)
    saved = F.exists(F.map_values("s.outputs"), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    state = (
        F.when(F.col("s").isNull(), F.when(F.array_contains("signatures", F.col("digest")), "resume").otherwise("fresh")).when(F.col("s.completed"), "completed")
        .when(F.size("mismatched") == 0, "resume").when(saved | F.col("signatures").isNotNull(), "conflict").otherwise("fresh")
    )
    return out.select("run_id", state.alias("state"), F.when(state == "completed", F.array().cast("array<string>")).otherwise(F.col("mismatched")).alias("mismatched"), "digest")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def resume(manifest: DataFrame, expected: DataFrame, snapshots: DataFrame, journal: DataFrame, valid: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """manifest (run_id, chunk_id, ... , text) with state, origin ('snapshot', 'journal' or null), output_text (null: still to be done).

    Chunks of runs that are completed or in conflict have no output here: ask run_states. Blank outputs, and those of which valid(text, output)
    isn't true, count as not saved, whoever holds them: else what a new snapshot leaves out would come back from a journal that is still there.
    Outputs of chunks that the manifest doesn't have are left out, and so are runs that aren't expected. (run_id, chunk_id) must be unique.
    Of equal seq and time the greater text counts, so the order in which files are read doesn't matter.
    """
    states = run_states(expected, snapshots, journal)
    live = states.where("state = 'resume'")
    last = snapshots.groupBy("run_id").agg(F.max_by(_filled("chunk_outputs"), F.struct(F.coalesce("updated_at", F.lit("")), F.to_json("signature"))).alias("outputs"))
    inline = last.join(live.select("run_id"), "run_id").select("run_id", F.explode("outputs").alias("chunk_id", "output_text")).withColumns({"rank": F.lit(1), "at": F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("updated_at"))})
    mine = valid_records(journal).join(live.select("run_id", F.col("digest").alias("signature")), ["run_id", "signature"])
    appended = mine.select("run_id", "chunk_id", "output_text", F.lit(0).alias("rank"), F.struct("seq", F.coalesce("updated_at", F.lit("")).alias("updated_at")).alias("at"))
    saved = inline.unionByName(appended).where(F.trim(F.coalesce("output_text", F.lit(""))) != "")
    if valid is not None:
        saved = saved.join(manifest.select("run_id", "chunk_id", "text"), ["run_id", "chunk_id"]).where(valid(F.col("text"), F.col("output_text")))
    saved = saved.groupBy("run_id", "chunk_id").agg(F.max(F.struct("rank", "at", "output_text")).alias("m"))
    saved = saved.select("run_id", "chunk_id", F.when(F.col("m.rank") == 1, "snapshot").otherwise("journal").alias("origin"), F.col("m.output_text").alias("output_text"))
    out = manifest.join(states.select("run_id", "state"), "run_id").join(saved, ["run_id", "chunk_id"], "left")
    return out.select(*manifest.columns, "state", "origin", "output_text")


def compacted(resumed: DataFrame, expected: DataFrame, updated_at: str) -> DataFrame:
    """Snapshots (as SNAPSHOT) of the runs that resume, with all their outputs; completed where nothing is left.

    A run's outputs are one map, as its snapshot is one object: runs are documents of bounded size.
    """
    done = resumed.where("state in ('resume', 'fresh')").groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("output_text").isNotNull(), F.struct("chunk_id", "output_text")))).alias("chunk_outputs"), F.bool_and(F.col("output_text").isNotNull()).alias("completed"))
    return done.join(expected, "run_id").select("run_id", "signature", "completed", F.lit(updated_at).alias("updated_at"), "chunk_outputs")


def require_compatible(states: DataFrame) -> DataFrame:
    """states, or CheckpointConflict with the first of the runs in conflict and their fields."""
    bad = states.where("state = 'conflict'").orderBy("run_id").select("run_id", "mismatched").limit(5).collect()
    if bad:
        raise CheckpointConflict("saved work doesn't match the present state: " + "; ".join(f"{r.run_id} ({', '.join(r.mismatched)})" for r in bad) + ". Reset these runs before starting anew.")
    return states
