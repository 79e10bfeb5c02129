"""Fill-in-middle against plain slicing, on small tables with nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textaudit.llm import fill_in_middle as fim

UNIT = re.compile("[^\n]*\n|[^\n]+")


def brute(key, text, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    t = text or ""
    lines = UNIT.findall(t)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not t or any(m in t for m in marks) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, t
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    return len(lines), form, len(prefix), len(middle), s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle


def texts():
    rng = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "é\nß\n\U0001f600x\n", "has <P> inside\nx", "<S>", "x<M>\n", "ends with <", "\n<", "P>\n<\nS>", "\r\n\r\nx\r", " a b\x85c"]
    out += ["x" * 9000, "é" * 5000, ("y" * 5000 + "\n") * 4, "\n" * 13_000]
    out += ["".join(rng.choice("ab é天\n") for _ in range(rng.randrange(1, 30_000))) for _ in range(12)]
    return out


def test_agrees_with_plain_slicing_and_goes_back(spark, monkeypatch):
    monkeypatch.setattr(fim, "BATCH_BYTES", 20_000)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id\nx\ny"), (5, "same id\nother"), (5, "same id\nother")]
    docs = spark.createDataFrame([(i, t, 1, "k", "o") for i, t in rows], "doc_id long, text string, _key int, fim_form string, FIM_OUTPUT string")
    for rate, spm, marks in ((100, 50, fim.SENTINELS), (40, 0, fim.SENTINELS), (100, 100, ("[PRE]", "[SUF]", "[MID]"))):
        got = fim.fill_in_middle(docs, rate=rate, spm_rate=spm, sentinels=marks)
        new = got.columns[5:]
        assert new == ["fim_lines", "_fim_form", "fim_prefix_chars", "fim_middle_chars", "_fim_output"]
        got = got.withColumn("back", fim.restored(F.col("_fim_output"), F.col("_fim_form"), marks)).collect()
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, map(tuple, docs.collect())))
        for r in got:
            assert tuple(r[c] for c in new) == brute(r.doc_id, r.text, rate, spm, marks)
            assert r.back == (r.text or "")
    assert fim.fill_in_middle(docs.where("false")).collect() == []


@pytest.mark.parametrize("block", [1, 3, 7, 64, 4096])
def test_every_cut_of_every_block_size(block):
    for t in texts():
        t = (t or "")[:400]
        lines = UNIT.findall(t)
        got = fim.Lines(t.encode(), block)
        assert got.n == len(lines)
        for k in range(len(lines) + 1):
            head = "".join(lines[:k])
            assert got.cut(k) == (len(head.encode()), len(head))


def test_fenwick_descent_agrees_with_sums():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 13, 64, 100):
        counts = rng.integers(0, 4, (n, 2))
        tree = fim.Fenwick(counts)
        assert tree.total().tolist() == counts.sum(axis=0).tolist()
        for k in range(1, int(counts[:, 0].sum()) + 1):
            at = int(np.searchsorted(np.cumsum(counts[:, 0]), k))
            place, before = tree.before(k)
            assert place == at and before.tolist() == counts[:at].sum(axis=0).tolist()


def test_sentinels_that_could_be_misread_are_errors():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    fim.check_sentinels(fim.SENTINELS)
