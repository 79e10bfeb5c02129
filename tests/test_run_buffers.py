"""Run buffers: batch and stream against a plain list that is changed event by event; restart from a checkpoint; expiry."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textaudit.operators import events as E
from textaudit.streaming import runs

SCHEMA = "run_id string, event_id long, ts timestamp, chunk string, round int, stream boolean, done boolean, completed boolean, is_request boolean, cursor long"
START = datetime.datetime(2024, 1, 1)


def some_events(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        stream = rng.random() < 0.7
        out.append((rng.choice("ab") + "run", i, START + datetime.timedelta(seconds=10 * i), rng.choice(["c1", "c2", "c3", None]), rng.choice([1, 1, 1, 2, None]), stream, stream and rng.random() < 0.2, False, False, None))
    return out


class Plain:
    """A list of (seq, event), appended to one by one."""

    def __init__(self, most):
        self.most, self.next, self.kept = most, 1, defaultdict(list)
        self.next = defaultdict(lambda: 1)

    def append(self, e):
        kept = self.kept[e[0]]
        if e[5]:
            for k in range(len(kept) - 1, -1, -1):
                old = kept[k][1]
                if (old[3] or "") == (e[3] or ""):
                    if old[5] and not old[6] and (old[4] or 0) == (e[4] or 0):
                        del kept[k]
                    break
        kept.append((self.next[e[0]], e))
        self.next[e[0]] += 1
        del kept[: max(0, len(kept) - self.most)]

    def reply(self, run, cursor):
        kept = self.kept[run]
        if not kept:
            return []
        first, last = kept[0][0], kept[-1][0]
        seen = first - 1 if cursor is None else min(cursor, last)
        if seen < first - 1:
            return [(last, kept[-1][1][1], True)]
        return [(s, e[1], False) for s, e in kept if s > seen]


@pytest.mark.parametrize("most", [3, 7, 512])
def test_batch_agrees_with_a_list(spark, most):
    rows = some_events(3, 400)
    plain = Plain(most)
    for e in rows:
        plain.append(e)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    kept = E.coalesced_buffer(df, "run_id", "event_id", "chunk", "round", "stream", "done", most)
    got = sorted((r.run_id, r.seq, r.event_id) for r in kept.collect())
    assert got == sorted((run, s, e[1]) for run, x in plain.kept.items() for s, e in x)
    last = {run: x[-1][0] for run, x in plain.kept.items()}
    for cursor in (None, 0, 5, last["arun"] - 3, last["arun"] + 9):
        asked = spark.createDataFrame([("arun", cursor), ("nobody", 1)], "run_id string, at long")
        told = sorted((r.seq, r.event_id, r.snapshot) for r in E.replies(kept, "run_id", asked, "at").collect())
        assert told == plain.reply("arun", cursor), cursor
    assert E.coalesced_buffer(df.where("false"), "run_id", "event_id", "chunk", "round", "stream", "done", most).count() == 0


def test_stream_restarts_coalesces_answers_and_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, most, plain, told = some_events(8, 120), 6, Plain(6), []
    src, out, point = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    at = lambda k: START + datetime.timedelta(seconds=10 * k)
    batches = [rows[:50], rows[50:51] + [("arun", None, at(51), None, None, None, None, None, True, c) for c in (None, 0, 30)], rows[51:]]
    batches[2] += [("brun", 900, at(130), None, None, False, False, True, False, None)]  # completed
    batches += [[("arun", 901, at(300), "c1", 1, True, False, False, False, None)], [("arun", None, at(1000), None, None, None, None, None, True, 1)], [("brun", None, at(1000), None, None, None, None, None, True, None)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        # a query of its own for each file: it restarts from the checkpoint
        stream = runs.run_buffers(spark.readStream.schema(SCHEMA).parquet(src), most, ttl_seconds=1800, late="1 second")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        for e in batch:
            if not e[8]:
                plain.append(e)
        for e in (x for x in batch if x[8] and k < 5):
            told += [(e[0], "snapshot" if snap else "event", e[9], s, i) for s, i, snap in plain.reply(e[0], e[9])]
    got = spark.read.parquet(out).collect()
    assert sorted(map(repr, ((r.run_id, r.kind, r.cursor, r.seq, r.event_id) for r in got if r.kind in ("event", "snapshot")))) == sorted(map(repr, told))
    assert {t[1] for t in told} == {"event", "snapshot"}
    last = {run: max((r for r in got if r.run_id == run and r.kind == "buffer"), key=lambda r: r.next) for run in ("arun", "brun")}
    for run, r in last.items():
        assert (r.seq, r.size, r.next) == (plain.kept[run][0][0], len(plain.kept[run]), plain.next[run])
    assert [(r.run_id, r.size) for r in got if r.kind == "expired"] == [("brun", len(plain.kept["brun"]))]
    # batch over the same events gives the same buffers
    every = spark.createDataFrame([e for b in batches for e in b if not e[8]], SCHEMA)
    kept = E.coalesced_buffer(every, "run_id", "event_id", "chunk", "round", "stream", "done", most)
    assert sorted((r.run_id, r.seq, r.event_id) for r in kept.collect()) == sorted((run, s, e[1]) for run, x in plain.kept.items() for s, e in x)
    assert kept.where(F.col("seq") < 1).count() == 0
