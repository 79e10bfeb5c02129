"""The manifest against a plain Merkle tree, on tables with nulls, empty texts, ties, repeated rows, lone sources and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textaudit.llm import common, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree long, place string, _group int, leaf string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        first = i // 16 * 16
        yield level[first : first + 16], i - first
        i //= 16


def brute(rows, tampered):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
    trees = [levels([x[2] for x in by[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(by[s]):
            fold, siblings = h(*map(field, tampered(r))), []
            for run, at in [*path(trees[k], i), *path(top, k)]:
                siblings += run[:at] + run[at + 1 :]
                fold = h(*run[:at], fold, *run[at + 1 :])
            out.append((r[0], own, trees[k][-1][0], top[-1][0], h(*siblings), fold, fold == top[-1][0]))
    return sorted(map(repr, out))


def fifth_lowered(r):
    return (*r[:4], r[4] and r[4].translate(LOWER)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS)
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = merkle.manifest(docs, FIELDS, "source", "doc_id", {"text": F.when(fifth, F.translate("text", merkle._UPPER, merkle._LOWER)).otherwise(F.col("text"))})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in out.collect())


def rows_of(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Ab Éß", "lower only", "ÄÖ", "X" * 40_000, "".join(rng.choice("aB \nÇ") for _ in range(rng.randrange(60)))])
            rows.append((rng.choice([None, rng.randrange(2000), rng.randrange(2000)]), s, rng.choice(["en", None, "", "日本"]), rng.choice([None, 0, 17]), text))
    return rows


@pytest.mark.parametrize("bound", [None, 3000, 0])
def test_manifest_agrees_with_a_plain_tree(spark, monkeypatch, bound):
    """Broadcast nodes, some levels joined by shuffle, and all of them."""
    if bound is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(merkle, "NODE_BYTES", 600)
    sizes = {None: 3, "": 1, "a": 1, "A": 16, "é": 17, "z": 300, "日": 33, "lone": 1} | {f"s{i}": 1 + i % 2 for i in range(20)}
    rows = rows_of(4, sizes)
    rows += [(7, "z", "en", 3, "Again")] * 70 + [(5, "A", None, None, "Tie A"), (5, "A", None, None, "Tie B")]
    got = run(spark, rows)
    assert got == brute(rows, fifth_lowered)
    assert any(x.endswith("False)") for x in got)


@pytest.mark.parametrize("sizes", [{"one": 1}, {"one": 40}, {"a": 1, "b": 1}, {None: 2, "b": 1}])
def test_small_tables(spark, sizes):
    rows = rows_of(5, sizes)
    assert run(spark, rows) == brute(rows, fifth_lowered)


def test_nothing_presented_verifies_and_an_empty_table_is_empty(spark):
    rows = rows_of(6, {"a": 20, "b": 5})
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, FIELDS, "source", "doc_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, lambda r: r) and all(r.verified for r in got)
    assert merkle.manifest(docs.where("false"), FIELDS, "source", "doc_id").collect() == []


def test_settings_are_put_back(spark):
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "77")
    try:
        run(spark, rows_of(7, {"a": 3}))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
