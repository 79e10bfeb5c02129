"""Queries over saved work, with their SQL. Conversations stand in for runs, their turns for chunks; what was saved of them follows by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaudit.sources import checkpoints as C
from textaudit.sources.tables import table


def _saved(spark, sf_dir):
    """(manifest, expected, snapshots, journal): snapshots of three in four conversations hold every third turn, the journal two turns in three, twice over
    and behind an older text; some snapshots are of another signature, some complete; some records don't have their hash."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("string").alias("chunk_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    signature = F.create_map(F.lit("doc"), F.col("run_id"), F.lit("turns"), F.col("n").cast("string"))
    runs = c.groupBy("run_id", "conv_id").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("turn") % 3 == 0, F.struct("chunk_id", "text")))).alias("outputs"))
    expected = runs.select("run_id", signature.alias("signature"))
    theirs = F.when(F.col("conv_id") % 10 == 7, F.create_map(F.lit("doc"), F.col("run_id"), F.lit("turns"), F.lit("0"))).otherwise(signature)
    nothing = F.map_filter("outputs", lambda k, v: F.lit(False))
    snapshots = runs.where("conv_id % 4 <> 3").select("run_id", theirs.alias("signature"), (F.col("conv_id") % 9 == 0).alias("completed"), F.lit("1").alias("updated_at"), F.when(F.col("conv_id") % 20 == 17, nothing).otherwise(F.col("outputs")).alias("chunk_outputs"))
    records = F.array(*[F.struct(F.lit(seq).cast("long").alias("seq"), text.alias("output_text"), hashed.alias("hashed")) for seq, text, hashed in (
        (1, F.concat(F.lit("old "), F.col("text")), F.lit(True)), (2, F.concat("text", "text"), F.lit(True)), (3, F.lit("torn"), F.lit(False)))])
    journal = c.where("turn % 3 <> 2 and conv_id % 20 <> 17").join(expected, "run_id").select("run_id", "chunk_id", C.signature_digest(F.col("signature")).alias("signature"), F.explode(records).alias("r"))
    journal = journal.select(F.lit(C.VERSION).alias("version"), "signature", "chunk_id", "r.output_text", F.when(F.col("r.hashed"), F.sha2("r.output_text", 256)).otherwise("0").alias("output_sha256"), F.lit("2").alias("updated_at"), "run_id", "r.seq")
    return c, expected, snapshots, journal


def checkpoint_resume(spark, sf_dir):
    """Every turn with the state of its conversation's saved work, and what of it holds."""
    out = C.resume(*_saved(spark, sf_dir))
    return out.select("conv_id", "turn", "state", "origin", F.sha2("output_text", 256).alias("output_sha256"))


RESUME_SQL = """
with c as (select conv_id, turn, coalesce(text, '') as text, case when conv_id % 4 = 3 then 'resume' when conv_id % 9 = 0 then 'completed' when conv_id % 10 <> 7 then 'resume' when conv_id % 20 = 17 then 'fresh' else 'conflict' end as state from conversations),
o as (select *, case when state = 'resume' and conv_id % 4 <> 3 and turn % 3 = 0 and trim(text) <> '' then 'snapshot' when state = 'resume' and turn % 3 <> 2 and conv_id % 20 <> 17 then 'journal' end as origin from c)
select conv_id, turn, state, origin, case origin when 'snapshot' then sha256(text) when 'journal' then sha256(case when trim(text) <> '' then text || text else 'old ' || text end) end as output_sha256 from o
"""

QUERIES = {"checkpoint_resume": (checkpoint_resume, RESUME_SQL)}
