"""The query over the roles of web pages' paragraphs, with its SQL. Two invented documents stand beside the pages, as few pages have an abstract or references."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaudit.functions.role_values import rules
from textaudit.operators import docroles
from textaudit.sources.tables import table

#: page_id -> units.
PLANTED = {
    -1: [
        "A Study of Rows", "2024年5月1日", "Table of Contents", "1 Introduction ........ 1", "References 9", "摘要", "本文研究数据行的读取方法，给出了结果。", "关键词：数据；行", "Abstract", "We read the rows of a table. They are many.", "Keywords: rows", "1 Introduction",
        "Rows are read one by one, and then they are kept.", "第二章 系统设计", "系统由读取模块、解析模块组成。", "图1 系统结构", "Fig. 2 Set-up", "注：数据来自实验", "x = y + z", "其中计算公式 a≈b", "研究背景", "（1）读取文件。", "2、解析", "3 items are read, then they are kept apart.", "A long line of words that holds no end, but two commas, and so it is prose",
        "a line without marks", "References", "[1] Someone. A title of rows.", "[2] Nobody. No title of rows.", "附录 A", "More rows.",
    ],
    -2: ["绪论", "正文从这里开始。", "Doe, J. (2019). On rows and columns here.", "Row, A. 2018. Of columns and rows, at last.", "还有一段正文。", "致谢", "感谢所有人。", "3. Press, 2001, of rows", "4. Journal of rows, vol. 3, kept", "Works cited list", "末尾。"],
    -3: ["1.1 Only a body", "It has a text; it ends with it.", "  ", "附录", "Nothing."],
}
_BLOCKS = "p|h[1-6]|li|div|td|th|tr|table|ul|ol|nav|article|section|header|footer|br|title|body|head|html"
_CUTS = (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", rf"(?i)</?(?:{_BLOCKS})(?:\s[^>]*)?/?>", "<[^>]*>")


def page_roles(spark, sf_dir):
    """The paragraphs of every page with the role and phase that each has in its page."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), _CUTS[0], " ")
    pieces = F.transform(F.split(html, _CUTS[1]), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _CUTS[2], " "), r"\s+", " ")))
    units = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.filter(pieces, lambda x: x != "")).alias("unit", "text"))
    planted = spark.createDataFrame([(d, k, t) for d, ts in PLANTED.items() for k, t in enumerate(ts)], "page_id long, unit int, text string")
    out = docroles.classify(units.unionByName(planted), "page_id", "unit")
    return out.select("page_id", "unit", "scope_start", "scope_end", "phase", "role", "editable")


def _sql() -> str:
    r = rules(False)
    values = ", ".join(f"({d}, {k}, '{t}')" for d, ts in PLANTED.items() for k, t in enumerate(ts))
    cut = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '{_CUTS[0]}', ' ', 'g'), '{_CUTS[1]}'), lambda x: trim(regexp_replace(regexp_replace(x, '{_CUTS[2]}', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '')"
    return rf"""
with p as (select page_id, {cut} as ts from pages), u as (select page_id, generate_subscripts(ts, 1)::int - 1 as unit, unnest(ts) as text from p union all select * from (values {values})),
f0 as (select page_id, unit, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, lower(regexp_replace(text, '\s+', '', 'g')) as n, '' as s, false as numbered, null::int as outline from u),
f as (select page_id, unit, {', '.join(f'{v} as "{k}"' for k, v in r.items())} from f0),
a as (select *, coalesce(min(unit) filter (abstract) over d, min(unit) filter (body) over d) as scope_start, coalesce(lead(entry) over o, false) as nx, coalesce(lag(entry) over o, false) as pv, max(unit) over d as last from f window d as (partition by page_id), o as (partition by page_id order by unit)),
b as (select *, min(unit) filter (acknowledgement and unit >= scope_start) over (partition by page_id) as ack from a),
c as (select *, min(unit) filter (unit > coalesce(ack, scope_start) and ((entry and nx and (not pv or unit - 1 = coalesce(ack, scope_start))) or case when ack is null then "references" or back_matter else after_acknowledgement end)) over (partition by page_id) as stop from b),
e as (select *, case when scope_start is not null then (case when stop is null then last else greatest(scope_start, stop - 1) end) end as scope_end, coalesce(entry and nx and (not pv or unit - 1 < scope_start) and unit >= scope_start, false) as run_start from c),
g as (select *, coalesce(unit between scope_start and scope_end, false) as inside, toc_heading or toc_entry or formula as apart from e),
h as (select *, case when not inside then null when apart or not (back_matter or "references" or acknowledgement) then case when acknowledgement then 'acknowledgements' when "references" then 'references' when back_matter then 'back_matter' when run_start and not apart then 'references' end
  when back_matter then 'back_matter' when "references" then 'references' else 'acknowledgements' end as strong, case when inside and abstract then 'abstract' when inside and body then 'body' end as weak from g),
i as (select *, case when inside then coalesce(last_value(strong ignore nulls) over w, last_value(weak ignore nulls) over w, 'body') else 'outside' end as phase from h window w as (partition by page_id order by unit rows unbounded preceding)),
j as (select *, case when scope_start is null or unit < scope_start then 'front_matter' when not inside then 'back_matter' when toc_heading then 'toc_heading' when toc_entry then 'toc_entry' when formula then 'equation' when back_matter then 'back_matter' when "references" then 'references_heading'
  when acknowledgement then 'acknowledgement_heading' when run_start or phase = 'references' then 'reference_entry' when phase = 'back_matter' then 'back_matter' when phase = 'acknowledgements' then 'acknowledgement_body' when heading then 'heading' when caption then 'caption' when note then 'note'
  when keywords then 'keywords' when not prose then 'ambiguous_non_prose' when body_item then 'body_list' when phase = 'abstract' then 'abstract_body' else 'body_prose' end as role from i)
select page_id, unit, scope_start, scope_end, phase, role, role in ('body_prose', 'abstract_body', 'body_list') as editable from j
"""


QUERIES = {"page_roles": (page_roles, _sql())}
