"""The factorization machine: interactions, odd tables, and its counts, fit and scores recomputed from plain words."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from textaudit.llm import toxicity as tox
from textaudit.llm.quality import held_out

TEXT = "doc_id long, text string, id int, _y int, KEY string, score int"


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}w{rng.randrange(400)}" for _ in range(n)]


def pairs(n, seed=1):
    """An insult alone, or a group alone, is clean; both together are toxic."""
    rng, out = random.Random(seed), []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = words(rng, rng.randrange(20, 60)) + ["numbskull"] * insult + ["islanders"] * group
        rng.shuffle(w)
        out.append((i, " ".join(w), int(insult and group)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, 1, "k", 2) for i, t, _ in rows], TEXT)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_learns_what_additive_weights_miss(spark):
    rows = pairs(900)
    docs, labels = frames(spark, rows)
    machine = tox.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in tox.score(docs, machine).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(i, y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([got[i].predicted == y for i, y in held]) >= 0.99
    machine.vectors[:] = 0.0
    additive = machine.score_texts([t for i, t, _ in rows if i % 3 == 1])
    assert np.mean([(s >= 0.7) == y for s, (_, y) in zip(additive, held, strict=True)]) < 0.9
    again = tox.train(docs.repartition(5), labels.where("doc_id % 3 <> 1"))
    assert again.bias == machine.bias and np.array_equal(again.weights, machine.weights)


def test_inflected_insults_and_long_clean_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = words(rng, 50) + [f"grobi{rng.choice('abcdefgh')}{rng.randrange(30)}" for _ in range(2 * (i % 2))]
        rng.shuffle(w)
        rows.append((i, " ".join(w), i % 2))
    docs, labels = frames(spark, rows)
    machine = tox.train(docs, labels)
    new = machine.score_texts([" ".join(words(rng, 50)) + " grobiunseen GROBIZZZ.", " ".join(words(rng, 60_000)), " ".join(words(rng, 60_000)) + " grobix1 grobiy2"])
    assert new[0] >= 0.7 and new[1] < 0.7 and new[2] >= 0.7


def test_odd_tables(spark):
    rows = pairs(300)
    docs, labels = frames(spark, rows)
    odd = [(1, None), (1, ""), (None, "numbskull islanders"), (2, "x"), (2, "x"), (3, "é" * 30_000), (4, "  \n"), (5, "日本 語")]
    more = docs.unionByName(spark.createDataFrame([(i, t, 0, 1, "k", 2) for i, t in odd], TEXT))
    mixed = labels.unionByName(spark.createDataFrame([(1, 1 - rows[1][2]), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int"))
    got = tox.score(more, tox.train(more, mixed)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for (_, t, *_), r in zip(more.collect(), got, strict=True):
        assert by_text.setdefault(t or "", r.score) == r.score
    assert tox.score(more.where("false"), tox.UNKNOWN).collect() == []
    for none in (labels.where("toxic = 1"), labels.where("false")):
        assert {r.predicted for r in tox.score(more, tox.train(more, none)).collect()} == {0}


def test_agrees_with_plain_counting(spark):
    """Counts from plain words, and the margin as a double sum over pairs."""
    rows = pairs(240, seed=4) + [(1000 + k, "one text that repeats numbskull", 1) for k in range(100)]
    docs, labels = frames(spark, rows)
    machine = tox.train(docs, labels)
    buckets = tox.terms([t for _, t, _ in rows])
    for (_, t, _), b in zip(rows, buckets, strict=True):
        plain = {(0, w) for w in t.split()} | {(1, w[:k]) for w in t.split() for k in tox.BEGINNINGS if len(w) >= k}
        assert len(plain) - 3 <= len(b) <= len(plain)
    n = np.zeros((2, tox.BUCKETS))
    for b, (_, _, y) in zip(buckets, rows, strict=True):
        n[y, b] += 1
    y = np.array([y for _, _, y in rows])
    strength = tox.strengths(n[1], n[0], (y == 1).sum(), (y == 0).sum())
    assert np.array_equal(machine.used, np.flatnonzero(strength > 0)) and np.allclose(machine.value, strength[machine.used] / tox.SCALE)
    distinct = sorted({(b.tobytes(), y) for b, (_, _, y) in zip(buckets, rows, strict=True)})
    again = tox.Machine(strength).fit([np.frombuffer(b, np.int32) for b, _ in distinct], np.array([y for _, y in distinct]))
    assert np.allclose(again.vectors, machine.vectors)
    got = tox.score(docs, machine).collect()
    for b, r in list(zip(buckets, got, strict=True))[::7]:
        i, x = machine.row(b)
        margin = machine.bias + sum(machine.weights[i] * x) + sum(machine.vectors[i[a]] @ machine.vectors[i[c]] * x[a] * x[c] for a in range(len(i)) for c in range(a))
        assert abs(1 / (1 + np.exp(-margin)) - r.score) < 1e-9


def test_sample_is_bounded_and_a_repeated_text_is_one_of_it(spark, monkeypatch):
    rows = pairs(300, seed=9) + [(1000 + k, "copy " * 20, k % 2) for k in range(300)]
    docs, labels = frames(spark, rows)
    seen, fit = [], tox.Machine.fit
    monkeypatch.setattr(tox.Machine, "fit", lambda self, rows, y: (seen.append((len(y), sum(r.nbytes for r in rows))), fit(self, rows, y))[1])
    tox.train(docs, labels)
    tox.train(docs, labels, sample=40)
    monkeypatch.setattr(tox, "SAMPLE_BYTES", seen[0][1] // 3)
    tox.train(docs, labels)
    assert seen[0][0] == 302 and seen[1][0] < 140 and seen[2][1] < seen[0][1] / 2


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = tox.op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.02
    assert tox.op11_toxicity(spark, sf).where(F.col("score").isNull()).count() == 0
