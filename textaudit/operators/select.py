"""Choosing among candidates, and folds over the chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_GAIN, TOLERANCE = 0.05, 0.75


def best_candidate(candidates: DataFrame, key: str) -> DataFrame:
    """(key, candidate_id, reason): the eligible candidate of least penalty (then most retention, then first attempt), if it
    gains LEAST_GAIN over the baseline; else the baseline.

    candidates: key, candidate_id, origin ('baseline' or another), attempt, eligible, penalty (null: worst), retention.
    """
    penalty = F.coalesce("penalty", F.lit(float("inf")))
    c = candidates.withColumn("penalty", penalty)
    base = c.where("origin = 'baseline'").select(key, F.col("candidate_id").alias("base_id"), F.col("penalty").alias("base_penalty"))
    best = c.where("origin <> 'baseline' and eligible").groupBy(key).agg(F.min(F.struct("penalty", (-F.coalesce("retention", F.lit(0.0))).alias("r"), "attempt", "candidate_id")).alias("m"))
    out = base.join(best, key, "left")
    gains = F.col("m.penalty") <= F.col("base_penalty") - LEAST_GAIN
    return out.select(
        key, F.when(gains, F.col("m.candidate_id")).otherwise(F.col("base_id")).alias("candidate_id"),
        F.when(F.col("m").isNull(), "no_eligible_candidate").when(gains, "penalty_improved").otherwise("no_measurable_gain").alias("reason"),
    )


def accept_in_order(chunks: DataFrame, key: str, order: str, growth: str, most: int) -> DataFrame:
    """Adds accepted: chunks are taken in order (of equal ones the lesser growth first), and one is refused where the accepted growth would exceed `most`.

    A document whose whole growth stays within `most` is accepted at once, without the fold; of the others the growths alone are
    folded, one document at a time (the fold is neither associative nor commutative).
    """
    total = chunks.groupBy(key).agg(F.sum(growth).alias("_total"))
    marked = chunks.join(total, key)
    fine = marked.where(F.col("_total") <= most).drop("_total").withColumn("accepted", F.lit(True))
    rest = marked.where(F.col("_total") > most).drop("_total").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, growth)))
    steps = rest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(growth).cast("long").alias("g")))).alias("_steps"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("taken"))

    def step(state, chunk):
        new = state["total"] + chunk["g"]
        taken = lambda total, ok: F.struct(total.alias("total"), F.array_append(state["taken"], F.lit(ok)).alias("taken"))
        return F.when(new <= most, taken(new, True)).otherwise(taken(state["total"], False))

    taken = steps.select(F.col(key), F.posexplode(F.aggregate("_steps", start, step, lambda state: state["taken"])).alias("_at", "accepted")).withColumn("_n", F.col("_at") + 1)
    folded = rest.join(taken.drop("_at"), [key, "_n"]).select(*chunks.columns, "accepted")
    return fine.select(*chunks.columns, "accepted").unionByName(folded)


def positions_in_order(df: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """(key, in_order): whether positions never fall along the order; equal ones count as a fall."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_before", F.lag(position).over(w)).groupBy(key).agg((F.count_if(F.col("_before") >= F.col(position)) == 0).alias("in_order"))
