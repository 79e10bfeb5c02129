"""Resuming from files: torn lines, damaged snapshots, other signatures, precedence, and resuming twice."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textaudit.sources import checkpoints as C

SIGN = {"doc": "d1", "model": "m", "limit": "120", "none": None}


def digest(signature):
    return hashlib.sha256("\n".join(sorted("=".join(x for x in (k, v) if x is not None) for k, v in signature.items())).encode()).hexdigest()


def record(run, chunk, text, seq, signature=SIGN, **other):
    return json.dumps({"version": 1, "signature": digest(signature), "run_id": run, "chunk_id": chunk, "output_text": text, "output_sha256": hashlib.sha256(text.encode()).hexdigest(), "updated_at": f"2024-01-{seq:02d}", "seq": seq} | other)


def snapshot(run, outputs, signature=SIGN, **other):
    return json.dumps({"run_id": run, "signature": signature, "completed": False, "updated_at": "2024-01-05", "chunk_outputs": outputs} | other)


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "j").mkdir()
    snaps = {
        "both": snapshot("both", {"c1": "inline", "c9": "not in the manifest", "c3": " "}), "torn": snapshot("torn", {"c1": "lost"})[:-40], "done": snapshot("done", {"c1": "x"}, completed=True),
        "other": snapshot("other", {"c1": "x"}, SIGN | {"model": "n", "limit": None}), "empty": snapshot("empty", {}, SIGN | {"model": "n"}), "held": snapshot("held", {}, SIGN | {"model": "n"}), "null": snapshot("null", None),
    }
    for name, text in snaps.items():
        (tmp_path / "s" / f"{name}.json").write_text(text)
    lines = [
        record("both", "c1", "journal is older than the snapshot", 9), record("both", "c2", "first", 1), record("both", "c2", "last", 3), record("both", "c2", "between", 2), record("both", "c3", "third", 1),
        record("both", "c4", "of another signature", 4, SIGN | {"model": "n"}), record("both", "c4", "wrong hash", 5, output_sha256="0"), record("both", "c4", "wrong version", 6, version=2), record("both", "", "no chunk", 6),
        record("torn", "c1", "from the journal", 1), record("held", "c1", "kept", 1), record("unknown", "c1", "x", 1), record("null", "c2", "y", 1),
    ]
    random.Random(1).shuffle(lines)
    (tmp_path / "j" / "a.jsonl").write_text("\n".join(lines[:6]) + "\n" + record("both", "c4", "torn", 7)[:60])
    (tmp_path / "j" / "b.jsonl").write_text("\n\n" + "\n".join(lines[6:]) + "\n")
    runs = [*snaps, "new"]
    expected = spark.createDataFrame([(r, SIGN) for r in runs], "run_id string, signature map<string,string>")
    manifest = spark.createDataFrame([(r, f"c{k}", k, f"text {k}") for r in runs for k in range(1, 5)], "run_id string, chunk_id string, pos int, text string")
    return tmp_path, manifest, expected


def test_precedence_conflicts_and_torn_files(spark, files):
    path, manifest, expected = files
    snaps, journal = C.read_snapshots(spark, f"{path}/s"), C.read_journals(spark, f"{path}/j")
    states = C.run_states(expected, snaps, journal)
    got = {r.run_id: (r.state, r.mismatched) for r in states.collect()}
    assert got == {"both": ("resume", []), "torn": ("resume", []), "done": ("completed", []), "other": ("conflict", ["limit", "model"]), "empty": ("fresh", ["model"]), "held": ("conflict", ["model"]), "null": ("resume", []), "new": ("fresh", [])}
    assert all(r.digest == digest(SIGN) for r in states.collect())
    with pytest.raises(C.CheckpointConflict, match=r"held \(model\); other \(limit, model\)"):
        C.require_compatible(states)
    assert C.require_compatible(states.where("state <> 'conflict'")).count() == 6
    rows = C.resume(manifest, expected, snaps, journal).collect()
    assert len(rows) == manifest.count()
    done = {(r.run_id, r.chunk_id): (r.origin, r.output_text) for r in rows if r.output_text is not None}
    # a blank output is none: the journal's takes its place
    assert done == {("both", "c1"): ("snapshot", "inline"), ("both", "c2"): ("journal", "last"), ("both", "c3"): ("journal", "third"), ("torn", "c1"): ("journal", "from the journal"), ("null", "c2"): ("journal", "y")}
    again = C.resume(manifest, expected, snaps, journal, valid=lambda text, out: (F.length(text) == 6) & (out != "inline") & (out != "last")).where("output_text is not null")
    assert {(r.run_id, r.chunk_id, r.output_text) for r in again.collect()} == {("both", "c1", "journal is older than the snapshot"), ("both", "c2", "between"), ("both", "c3", "third"), ("torn", "c1", "from the journal"), ("null", "c2", "y")}


def test_resuming_twice_and_after_a_crash_gives_the_same(spark, files):
    path, manifest, expected = files
    some = expected.where("run_id in ('both', 'torn', 'null', 'new')")
    mine = manifest.join(some.select("run_id"), "run_id").select(*manifest.columns)
    snaps, journal = C.read_snapshots(spark, f"{path}/s"), C.read_journals(spark, f"{path}/j")
    view = lambda df: sorted((r.run_id, r.chunk_id, r.output_text or "") for r in df.collect())
    first = C.resume(mine, some, snaps, journal)
    C.compacted(first, some, "2024-02-01").write.json(f"{path}/compacted")
    # the new snapshot is there, the journal not yet gone
    spark_snaps = C.read_snapshots(spark, f"{path}/compacted")
    new = spark.read.schema(C.SNAPSHOT).json(f"{path}/compacted")
    assert new.count() == 4 and spark_snaps.columns == new.columns
    assert view(C.resume(mine, some, new, journal)) == view(first) == view(C.resume(mine, some, snaps.unionByName(new), journal))
    assert view(C.resume(mine, some, new, journal.where("false"))) == view(first)
    # all is done: the next snapshot is complete, and nothing resumes
    full = first.withColumn("output_text", F.coalesce("output_text", F.lit("done")))
    whole = C.compacted(full, some, "2024-03-01")
    assert {r.completed for r in whole.collect()} == {True} and {r.state for r in C.run_states(some, whole, journal).collect()} == {"completed"}
    assert C.resume(mine.where("false"), some, snaps, journal).count() == 0 and C.run_states(some.where("false"), snaps, journal).count() == 0
