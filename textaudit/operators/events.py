"""Ordered run events: bounded buffers, resume cursors, rate limits, cooldowns, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textaudit.functions.lexicons import EVENT_BUFFER


def buffer(events: DataFrame, key: str, order: str, most: int = EVENT_BUFFER) -> DataFrame:
    """The last `most` events of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= most).drop("_back")


def after_cursor(events: DataFrame, key: str, order: str, cursors: DataFrame, cursor: str, most: int = EVENT_BUFFER) -> DataFrame:
    """Buffered events behind each key's cursor; truncated where the cursor lies before the buffer (then a snapshot is due)."""
    kept = buffer(events, key, order, most)
    first = kept.groupBy(key).agg(F.min(order).alias("_first"))
    out = kept.join(first, key).join(cursors, key).where(F.col(order) > F.col(cursor))
    dropped = events.join(cursors, key).join(first, key).where((F.col(order) > F.col(cursor)) & (F.col(order) < F.col("_first"))).select(key).distinct().withColumn("_cut", F.lit(True))
    return out.join(dropped, key, "left").withColumn("truncated", F.coalesce("_cut", F.lit(False))).drop("_first", "_cut")


def coalesced_buffer(events: DataFrame, key: str, order: str, chunk: str, round_: str, stream: str, done: str, most: int = EVENT_BUFFER) -> DataFrame:
    """What each key's buffer holds at the end: events with seq, their number in the key from 1, however many were left out before.

    stream marks progress events of a chunk. One that isn't done gives way to the chunk's next event if that is one, too, of the same round; so
    a chunk's progress takes one place. Of what is left the last `most` stay: an event is pushed out by as many later ones as
    are there at the end, as those that gave way had their places taken. Null and empty chunks are one chunk, null rounds are 0. seq counts a key in its order, so a key
    is one task's; its columns alone are sorted, and the buffer is cut before the next shuffle.
    """
    w = Window.partitionBy(key, F.coalesce(chunk, F.lit(""))).orderBy(order)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    e = events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
    gives_way = F.coalesce(flag(stream) & ~flag(done) & F.coalesce(F.lead(stream).over(w), F.lit(False)) & (F.lead(F.coalesce(round_, F.lit(0))).over(w) == F.coalesce(round_, F.lit(0))), F.lit(False))
    return buffer(e.withColumn("_way", gives_way).where("not _way").drop("_way"), key, "seq", most)


def replies(kept: DataFrame, key: str, cursors: DataFrame, cursor: str) -> DataFrame:
    """What a client that has seen seq up to its cursor is told, from a buffer with seq: the events behind it, with snapshot false; or, where some of
    these are no longer there, the last event alone, with snapshot true, as a tail would pass for the whole. A null cursor has seen nothing
    and asks for what there is; one beyond the end has seen all. Keys without a cursor get no reply."""
    w = Window.partitionBy(key)
    bounds = kept.withColumns({"_first": F.min("seq").over(w), "_last": F.max("seq").over(w)})  # a buffer is bounded
    seen = F.when(F.col("_cursor").isNull(), F.col("_first") - 1).otherwise(F.least("_cursor", "_last"))
    out = bounds.join(cursors.select(key, F.col(cursor).cast("long").alias("_cursor")), key).withColumn("_seen", seen).withColumn("snapshot", F.col("_seen") < F.col("_first") - 1)
    return out.where(F.when(F.col("snapshot"), F.col("seq") == F.col("_last")).otherwise(F.col("seq") > F.col("_seen"))).drop("_first", "_last", "_cursor", "_seen")


def rate_limit(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """in_window: events of the key in the `seconds` up to each event; allowed: no more than `most`."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= most)


def cooldown(events: DataFrame, key: str, order: str, failed, step: int = 3, most: int = 60) -> DataFrame:
    """streak: failures in a row up to each event; cooldown: step * streak seconds, at most `most`; a success resets it."""
    w = Window.partitionBy(key).orderBy(order)
    out = events.withColumn("_ok", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    out = out.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(key, "_ok").orderBy(order)))
    return out.withColumn("cooldown", F.least(F.lit(most), F.col("streak") * step)).drop("_ok")


def expired(events: DataFrame, key: str, ts: str, done, now, seconds: int = 1800) -> DataFrame:
    """Keys whose last event is a completed one older than `seconds`."""
    last = events.groupBy(key).agg(F.max_by(F.struct(F.col(ts).alias("ts"), done.alias("done")), F.struct(ts, F.col("event_id"))).alias("m"))
    return last.where(F.col("m.done") & (F.col("m.ts") < now - F.expr(f"interval {seconds} seconds"))).select(key, F.col("m.ts").alias("last_ts"))


def progress(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The largest value so far: a display that never moves back."""
    return events.withColumn("progress", F.max(value).over(Window.partitionBy(key).orderBy(order)))


def sections(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Runs of equal neighbouring states: (key, section, state, first, last, n)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = events.withColumn("_new", changed).withColumn("section", F.sum("_new").over(w))
    return out.groupBy(key, "section").agg(F.first(state).alias(state), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
