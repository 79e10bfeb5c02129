"""Orphans among files made here, and backups kept by recency."""

import pytest
from pyspark.sql import functions as F

from textaudit.sources import files as S


def test_orphans_are_listed_counted_and_paged(spark, tmp_path):
    made = {"docs": ["a.txt", "sub/b.JSON", "sub/c.md", "keep.exe", ".hidden.txt", ".git/x.txt", "é ü.txt"], "out": ["r.txt", "z.txt"]}
    for kind, names in made.items():
        for n in names:
            (tmp_path / kind / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / kind / n).write_bytes(b"x" * len(n))
    files = S.listing(spark, {k: f"{tmp_path}/{k}" for k in made}, (".txt", ".json", ".md"))
    assert {(r.kind, r.relative, r.bytes) for r in files.collect()} == {(k, n, len(n)) for k, ns in made.items() for n in ns if not n.startswith(".") and n != "keep.exe"}
    assert S.listing(spark, {"docs": f"file://{tmp_path}/docs/"}).count() == 5
    refs = spark.createDataFrame([(f"{tmp_path}/docs/./a.txt",), (f"file://{tmp_path}/out//r.txt",), (None,), ("",), (f"{tmp_path}\\docs\\sub\\c.md",), ("elsewhere/z.txt",)], "path string")
    page, totals = S.orphan_scan(files, refs)
    assert [(r.kind, r.relative) for r in page.collect()] == [("docs", "sub/b.JSON"), ("docs", "é ü.txt"), ("out", "z.txt")]
    assert {r.kind: (r.files, r.orphans, r.orphans_bytes, r.has_more) for r in totals.collect()} == {"docs": (4, 2, 17, False), "out": (2, 1, 5, False)}
    page, totals = S.orphan_scan(files, refs, listed=2)
    assert page.count() == 2 and all(r.has_more for r in totals.collect())
    assert S.orphans(files, refs.where("false")).count() == 6 and S.orphans(files.where("false"), refs).count() == 0


def test_backups_come_back_and_the_newest_stay(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "k int, v string, xs array<int>")
    for stamp in ("20240101", "20240103", "20240102"):
        where = S.back_up(table, str(tmp_path), stamp)
        assert sorted(map(repr, spark.read.schema(table.schema).json(where).collect())) == sorted(map(repr, table.collect()))
    with pytest.raises(Exception, match="(?i)already exists"):
        S.back_up(table, str(tmp_path), "20240101")
    kept = S.backups(spark, str(tmp_path))
    assert {r.stamp for r in kept.collect()} == {"20240101", "20240102", "20240103"} and kept.where(F.col("bytes") <= 0).count() == 0
    assert [r.stamp for r in S.to_prune(kept, 2).collect()] == ["20240101"] and S.to_prune(kept, 9).count() == 0
