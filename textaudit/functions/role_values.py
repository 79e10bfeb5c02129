"""Words and patterns by which a document's units are told apart, and the rules over them, as SQL that any engine reads.

t is a unit's text without white space around it, n the same in lower case without any white space, s its style (likewise), numbered whether
the word processor numbers it, outline its level or null.
"""

from __future__ import annotations

# --- fixed values: markers, as normalised text ------------------------------------------------------------------------
ABSTRACT = ("摘要", "中文摘要", "论文摘要", "内容摘要", "abstract")
ACKNOWLEDGEMENT = ("致谢", "致谢辞", "谢辞", "鸣谢", "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments")
TOC = ("目录", "tableofcontents")
OPENING = ("绪论", "引言", "前言")
CLOSING = ("结论", "结语", "总结", "总结与展望", "结论与展望")
REFERENCES = (
    "参考文献", "主要参考文献", "参考文献目录", "参考文献列表", "参考资料", "主要参考资料", "参考资料目录", "参考资料列表", "参考书目", "引用文献", "主要引用文献", "文献目录", "文献列表", "文献来源", "资料来源", "参考来源",
    "reference", "references", "referencelist", "listofreferences", "referencematerials", "selectedreferences", "citedreferences", "bibliography", "selectedbibliography", "workscited", "worksconsulted", "worksreferenced",
    "sourcescited", "sourcesconsulted", "sourcelist", "listofsources", "literaturecited", "citedliterature", "literaturereferences", "furtherreading",
)
BACK_MATTER = (
    "附录", "appendix", "appendices", "声明", "诚信声明", "承诺书", "独创性声明", "作者简介", "个人简历", "任务书", "开题报告", "指导教师评阅表", "评阅教师评阅表", "答辩记录", "答辩委员会评语", "成绩评定表",
    "版权使用授权书", "学位论文版权使用授权书", "毕业论文版权使用授权书", "毕业设计论文任务书", "毕业设计（论文）任务书", "原创性声明", "学位论文原创性声明", "学位论文使用授权声明", "攻读学位期间取得的研究成果",
    "攻读学位期间发表的学术论文", "在学期间研究成果", "外文资料", "外文原文", "外文译文", "译文", "原文", "学术诚信承诺书", "诚信承诺书", "论文原创性声明", "论文使用授权声明", "毕业设计论文诚信承诺书", "毕业设计论文原创性声明", "封底",
)
HEADING_WORDS = (
    "研究背景", "研究意义", "国内外研究", "研究现状", "相关理论", "关键技术", "需求分析", "总体设计", "系统设计", "系统实现", "模型构建", "模型训练", "实验设计", "实验结果", "结果分析", "特征工程", "数据预处理", "系统测试", "总结", "展望",
)
SHORT_HEADINGS = ("摘要", "abstract", "绪论", "引言", "前言", "结论", "结语", "总结", "展望", "数据与方法", "材料与方法", "研究方法", "实验方法", "参考文献", "致谢")
# --- fixed values: patterns -------------------------------------------------------------------------------------------
TOC_LEADER = r"(?:\.{3,}|…{2,}|·{3,})\s*(?:[ivxlcdmIVXLCDM]+|\d+)$"
PAGE_AT_END = r"\s(?:[ivxlcdmIVXLCDM]+|\d+)$"
DATE_LINE = r"^\d{4}年\d{1,2}月\d{1,2}日$"
BODY_START = r"^(?:第[一二三四五六七八九十0-9]+章|[1-9]\d*(?:\.\d+)*[^\d].*|绪论|引言|前言)$"
HEADING_NUMBER = r"^(?:第[一二三四五六七八九十百0-9]+章.*|[1-9]\d*(?:\.\d+){0,3}[^\d].*)$"
CAPTION = r"^(?:图|表|fig(?:ure)?[.]?|table)(?:[a-z]?\d+|[一二三四五六七八九十]+)(?:[-.．－—]\d+)*"
MARKED_ITEM = r"^(?:[（(]?(?:\d{1,3}|[一二三四五六七八九十百]+)[）)]|(?:\d{1,3}|[一二三四五六七八九十百]+|[A-Za-z])[.．、)])\s*(.+)$"
SPACED_ITEM = r"^(?:\d{1,3}|[一二三四五六七八九十百]+)\s+(.+)$"
SHORT_HEADING = r"^[A-Za-z0-9一-鿿\s（）()、：:·/+\-]{2,36}$"
SYMBOL = r"[=≈≠≤≥±×÷∑Σ√∫∞α-ωΑ-ΩμσλθπφψωΔδβγ_^\[\]{}<>]"
ENTRY_BRACKET = r"^\[\s*\d{1,4}\s*\]"
ENTRY_NUMBER = r"^\d{1,4}\s*[.．]\s+"
ENTRY_YEAR = r"(?:^|\D)(?:19|20)\d{2}(?:\D|$)"
ENTRY_AUTHOR_YEAR = r"(?i)^.{2,96}?[（(]\s*(?:19|20)\d{2}[a-z]?\s*[）)]\s*[.．]"
ENTRY_AUTHOR_EN = r"^[A-Z][A-Za-z'’\-]+"
ENTRY_AUTHOR_ZH = r"^(?:[㐀-鿿]{2,4}(?:[，,、]\s*[㐀-鿿]{2,4}){1,5}[.．，,]|[㐀-鿿]{2,4}[.．]|[㐀-鿿]{2,4}\s*[（(](?:19|20)\d{2})"
ENTRY_CUE = r"(?i)doi\s*[:：]|https?://|isbn\s*[:：]?|\[(?:j|m|c|d|r|s|eb|ol)\]|\b(?:journal|press|proceedings|conference|vol\.?|no\.?|pp\.?)\b|学报|期刊|出版社|会议论文|硕士学位论文|博士学位论文"
NOTE = r"(?i)^(?:注|说明|备注)\s*[:：]"
STYLE_HEADING = "^(?:heading|标题)|chapterheading|sectionheading|title|章标题|节标题"
STYLE_CAPTION, STYLE_FORMULA = "caption|图注|表注|题注", "equation|公式"


def rules(spark: bool) -> dict[str, str]:
    """Name -> condition, in SQL for Spark or for DuckDB."""
    quoted = lambda p: ("r'" if spark else "'") + p.replace("'", "''" if not spark else "\\x27") + "'"
    like = lambda c, p: f"{'regexp_like' if spark else 'regexp_matches'}({c}, {quoted(p)})"
    count = lambda c, p: f"regexp_count({c}, {quoted(p)})" if spark else f"len(regexp_extract_all({c}, {quoted(p)}))"
    group = lambda c, p: f"trim(regexp_extract({c}, {quoted(p)}, 1))"
    bare = lambda c: f"lower(regexp_replace({c}, {quoted(r'\s+')}, ''{'' if spark else ', $$g$$'}))".replace("$$g$$", "'g'")
    among = lambda c, words: f"{c} in ({', '.join(repr(w) for w in words)})"
    word = lambda *w: like("lower(t)", f"(?:^|[^a-z])(?:{'|'.join(w)})(?:$|[^a-z])")
    marked, spaced = group("t", MARKED_ITEM), group("t", SPACED_ITEM)
    label = lambda b: f"({bare(b)} <> '' and length({bare(b)}) <= 64 and not {like(b, '[:：，,；;。！？!?]')})"
    punctuated = lambda b: like(b, "[:：，,；;。]")
    known = lambda b: f"({among(bare(b), SHORT_HEADINGS)} or {like(bare(b), '|'.join(HEADING_WORDS))})"
    item = lambda b, short: f"({b} <> '' and not {like(b, '^[0-9]')} and case when length({bare(b)}) <= 8 and not {punctuated(b)} then {short} when {punctuated(b)} then true else length({bare(b)}) >= 16 end)"
    r = {"toc_entry": f"({like('t', TOC_LEADER)} or (length(t) <= 80 and {like('t', PAGE_AT_END)}))", "toc_heading": among("n", TOC)}
    r["abstract"] = f"(not {r['toc_entry']} and ({among('n', ABSTRACT)} or (length(n) <= 12 and {like('n', '^摘要|摘要$')})))"
    r["body"] = f"(not {r['toc_entry']} and ({among('n', (*ABSTRACT, *OPENING))} or (not {like('n', DATE_LINE)} and ({like('n', '^第.*章')} or {like('n', BODY_START)}))))"
    r["acknowledgement"] = f"(not {r['toc_entry']} and ({among('n', ACKNOWLEDGEMENT)} or (length(n) <= 12 and {like('n', '^(?:致谢|谢辞|鸣谢)')})))"
    plain_references = f"(not {r['toc_entry']} and ({among('n', REFERENCES)} or (length(n) <= 24 and {like('n', '参考文献')})))"
    r["back_matter"] = f"(not {r['toc_entry']} and ({among('n', BACK_MATTER)} or {like('n', '^(?:附录|appendix)|封底格式$')}))"
    is_label = f"({marked} <> '' and {label(marked)})"
    r["body_item"] = f"(case when {marked} <> '' then not {is_label} and {item(marked, f'not {known(marked)}')} else {item(spaced, 'false')} end)"
    style = f"({like('s', STYLE_HEADING)} or coalesce(outline between 0 and 8, false))"
    short = f"(length(n) <= 36 and not {like('t', '[。！？；!?;]')} and ({like('n', '|'.join(HEADING_WORDS))} or (length(n) <= 14 and {like('t', SHORT_HEADING)})))"
    named = f"({among('n', (*ABSTRACT, *ACKNOWLEDGEMENT, *OPENING, *CLOSING))} or {plain_references} or {r['back_matter']})"
    loose = f"(case when numbered then {label('t')} else not {r['body_item']} and ((length(n) <= 48 and {like('n', HEADING_NUMBER)}) or {short}) end)"
    r["heading"] = f"(n <> '' and not {like('n', DATE_LINE)} and ({named} or {is_label} or {style} or {loose}))"
    meant = f"""(length(n) between 1 and 48 and (({like('n', '参考')} and {like('n', '文献|资料|书目|来源')}) or {like('n', '引用文献|文献目录|文献列表|资料来源')} or {word('bibliography', 'bibliographies', 'bibliographic')}
      or ({word('reference', 'references')} and {word('list', 'cited', 'consulted', 'selected', 'materials', 'sources')}) or ({word('sources')} and {word('cited', 'consulted', 'reference', 'references')}) or ({word('works')} and {word('cited', 'consulted', 'referenced')})))"""
    r["references"] = f"(not {r['toc_entry']} and ({plain_references} or ({meant} and {r['heading']})))"
    year, cue = like(f"{'substring' if spark else 'substr'}(t, 1, 220)", ENTRY_YEAR), like("t", ENTRY_CUE)
    r["entry"] = f"(length(t) >= 8 and ({like('t', ENTRY_BRACKET)} or {like('t', '(?i)^(?:doi[:：]|https?://)')} or {like('t', ENTRY_AUTHOR_YEAR)} or ({like('t', ENTRY_NUMBER)} and ({year} or {cue})) or (not {like('t', ENTRY_NUMBER)} and {year} and ({like('t', ENTRY_AUTHOR_EN)} or {like('t', ENTRY_AUTHOR_ZH)}))))"
    symbols, digits, letters = count("t", SYMBOL), count("t", r"\d"), count("t", "[A-Za-z]")
    operator, hint = like("t", "[=≈≤≥∑Σ√×÷]"), like("t", "计算方式|计算公式|公式如下|定义如下")
    r["formula"] = f"""(t <> '' and ({like('s', STYLE_FORMULA)} or (length(t) <= 220 and (({operator} and {symbols} >= 2) or ({like('t', '=')} and {letters} >= 2 and length(t) <= 100 and not {like('t', '[。！？；!?;]')})
      or ({hint} and {symbols} >= 1) or ({symbols} >= 4 and {digits} >= 1 and {letters} >= 1)))))"""
    r["caption"] = f"({like('s', STYLE_CAPTION)} or {like('n', CAPTION)})"
    r["note"] = f"({like('n', '^(?:图注|表注)')} or {like('t', NOTE)})"
    r["keywords"] = like("n", "^(?:关键词|关键字|keywords?)")
    r["prose"] = f"({like('t', '[。！？!?；;.]')} or (length(t) >= 24 and {count('t', '[，,]')} >= 2))"
    r["after_acknowledgement"] = f"({r['references']} or {r['back_matter']} or ({like('s', '^(?:heading|标题)')} and {r['heading']}))"
    return r
