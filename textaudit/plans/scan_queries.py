"""The rule scan over documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaudit.operators import textscan as S
from textaudit.sources.tables import table


def text_issues(spark, sf_dir):
    """Every line of the documents that holds a secret, a personal path or broken characters."""
    return S.scan(table(spark, sf_dir, "documents"), "doc_id").withColumn("line", F.col("line").cast("long"))


def issue_counts(spark, sf_dir):
    """How many of them there are by code."""
    return S.counts(S.scan(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


def _q(p: str) -> str:
    return p.replace("'", "''")


def _lines() -> str:
    ends = "'" + S.LINE_END.replace("\r", "\\r").replace("\n", "\\n").replace("\x0b", "\\x0b").replace("\x0c", "\\x0c").replace("\x1c", "\\x1c").replace("\x1d", "\\x1d").replace("\x1e", "\\x1e").replace("\x85", "\\x{85}").replace("\u2028", "\\x{2028}").replace("\u2029", "\\x{2029}") + "'"
    found = []
    for code, pattern, group, each in S.RULES:
        if each:
            exempt = f"""regexp_matches(trim(trim(v), '''"`<>.,;'), '{S.PUBLIC_URL}') or trim(trim(v), '''"`<>.,;') = ''""" if code == "secret.provider_url" else f"regexp_matches(v, '{S.PLACEHOLDERS}') or regexp_matches(v, '{_q(S.INTERPOLATED)}')"
            found.append(f"select doc_id, line, '{code}' as code, x, generate_subscripts(vs, 1)::int as match, unnest(vs) as v from (select doc_id, line, x, list_filter(regexp_extract_all(x, '{_q(pattern)}', {group}), lambda v: not ({exempt})) as vs from l)")
        else:
            found.append(f"select doc_id, line, '{code}' as code, x, 1 as match, null::varchar as v from l where regexp_matches(x, '{_q(pattern)}')")
    return f"""with l as (select doc_id, unnest(xs) as x, generate_subscripts(xs, 1) as line from (select doc_id, regexp_split_to_array(text, {ends}) as xs from documents where text is not null)),
issues as (select doc_id, line, code, match, left(trim(case when v is null then x else replace(x, v, case when length(trim(v)) <= 10 then '***' else left(trim(v), 4) || '…' || right(trim(v), 4) end) end), 180) as preview from ({' union all '.join(found)}))"""


QUERIES = {
    "text_issues": (text_issues, _lines() + " select * from issues"),
    "issue_counts": (issue_counts, _lines() + " select code, count(*) as issues, count(distinct (doc_id, line)) as lines, count(distinct doc_id) as texts from issues group by 1"),
}
