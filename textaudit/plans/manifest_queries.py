"""The query over merged manifests, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaudit.operators import manifest as M
from textaudit.plans.text_queries import lang_sql, pieces_sql
from textaudit.sources.tables import table


def merged_manifest(spark, sf_dir):
    """The chunks of every document with blank lines between its lines, and whether a chunk without these comes back in as many paragraphs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    m = M.merged_manifest(d, "doc_id")
    back = M.cut_back(F.replace("text", F.lit("\n\n"), F.lit(" ")), F.col("lengths"))
    return m.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "chunk_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "reason", F.sha2("text", 256).alias("text_sha256"), (F.size(back) == F.size("lengths")).alias("as_many"))


MANIFEST_SQL = rf"""
with recursive p as (select doc_id, {pieces_sql(r"regexp_split_to_array(replace(replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n')")} as ps from documents),
u as (select doc_id, unnest(ps) as t, generate_subscripts(ps, 1) - 1 as i from p),
f as (select doc_id, i, t, length(t) as n, {lang_sql('t')} as lang, case when length(t) <= 80 and regexp_matches(t, '{M.STANDALONE}') then 'standalone-paragraph' when length(t) > {M.LIMIT} then 'oversized-paragraph' end as alone from u),
r as (select doc_id, i, n as len, 1 as parts, lang, alone, 0::bigint as chunk from f where i = 0
  union all select f.doc_id, f.i, case when joins then r.len + 2 + f.n else f.n end, case when joins then r.parts + 1 else 1 end, f.lang, f.alone, case when joins then r.chunk else r.chunk + 1 end
  from r join f on f.doc_id = r.doc_id and f.i = r.i + 1, lateral (select f.alone is null and r.alone is null and f.lang = r.lang and r.len + 2 + f.n <= {M.LIMIT} and r.parts < {M.MOST} as joins)),
c as (select r.doc_id, r.chunk, min(f.i) as first, max(f.i) as last, max(r.alone) as alone, string_agg(t, chr(10) || chr(10) order by f.i) as text from r join f on f.doc_id = r.doc_id and f.i = r.i group by 1, 2)
select doc_id, chunk, case when first = last then 'p' || first || '_c0' else 'p' || first || '_p' || last || '_c0' end as chunk_id, first, last, coalesce(alone, case when first = last then 'paragraph-kept' else 'merged-short-paragraphs' end) as reason, sha256(text) as text_sha256, true as as_many from c
"""

QUERIES = {"merged_manifest": (merged_manifest, MANIFEST_SQL)}
