"""Roles, scope and phases of units against a walk in plain Python."""

import random
import re

from textaudit.functions import role_values as V
from textaudit.operators import docroles
from textaudit.plans.role_queries import PLANTED


class Unit:
    def __init__(self, text, style="", numbered=False, outline=None, table=False):
        self.t, self.s, self.numbered, self.outline, self.table = (text or "").strip(), "".join((style or "").split()).lower(), numbered, outline, table
        self.n = "".join(self.t.split()).lower()

    def toc(self):
        return bool(re.search(V.TOC_LEADER, self.t)) or (len(self.t) <= 80 and bool(re.search(V.PAGE_AT_END, self.t)))

    def abstract(self):
        return not self.toc() and (self.n in V.ABSTRACT or (len(self.n) <= 12 and (self.n.startswith("摘要") or self.n.endswith("摘要"))))

    def body(self):
        if self.toc():
            return False
        if self.n in V.ABSTRACT or self.n in V.OPENING:
            return True
        return not re.match(V.DATE_LINE, self.n) and ((self.n.startswith("第") and "章" in self.n) or bool(re.match(V.BODY_START, self.n)))

    def thanks(self):
        return not self.toc() and (self.n in V.ACKNOWLEDGEMENT or (self.n.startswith(("致谢", "谢辞", "鸣谢")) and len(self.n) <= 12))

    def plain_references(self):
        return not self.toc() and (self.n in V.REFERENCES or ("参考文献" in self.n and len(self.n) <= 24))

    def references(self):
        if self.toc():
            return False
        w, n = set(re.findall("[a-z]+", self.t.lower())), self.n
        meant = 1 <= len(n) <= 48 and (
            ("参考" in n and any(x in n for x in ("文献", "资料", "书目", "来源"))) or any(x in n for x in ("引用文献", "文献目录", "文献列表", "资料来源")) or w & {"bibliography", "bibliographies", "bibliographic"}
            or (w & {"reference", "references"} and w & {"list", "cited", "consulted", "selected", "materials", "sources"}) or ("sources" in w and w & {"cited", "consulted", "reference", "references"}) or ("works" in w and w & {"cited", "consulted", "referenced"})
        )
        return self.plain_references() or bool(meant and self.heading())

    def back(self):
        return not self.toc() and (self.n in V.BACK_MATTER or self.n.startswith(("附录", "appendix")) or self.n.endswith("封底格式"))

    def entry(self):
        t = self.t
        if len(t) < 8:
            return False
        if re.match(V.ENTRY_BRACKET, t) or t.lower().startswith(("doi:", "doi：", "http://", "https://")) or re.match(V.ENTRY_AUTHOR_YEAR, t):
            return True
        year = bool(re.search(r"(?<!\d)(?:19|20)\d{2}[a-z]?(?!\d)", t[:220], re.IGNORECASE))
        if re.match(V.ENTRY_NUMBER, t):
            return year or bool(re.search(V.ENTRY_CUE, t))
        return year and bool(re.match(V.ENTRY_AUTHOR_EN, t) or re.match(V.ENTRY_AUTHOR_ZH, t))

    def formula(self):
        t = self.t
        if not t or "equation" in self.s or "公式" in self.s:
            return bool(t)
        if len(t) > 220:
            return False
        symbols, digits, letters = len(re.findall(V.SYMBOL, t)), len(re.findall("[0-9]", t)), len(re.findall("[A-Za-z]", t))
        return (
            (any(c in t for c in "=≈≤≥∑Σ√×÷") and symbols >= 2) or ("=" in t and letters >= 2 and len(t) <= 100 and not any(c in t for c in "。！？；!?;"))
            or (any(c in t for c in ("计算方式", "计算公式", "公式如下", "定义如下")) and symbols >= 1) or (symbols >= 4 and digits >= 1 and letters >= 1)
        )

    @staticmethod
    def label(b):
        n = "".join(b.split())
        return 0 < len(n) <= 64 and not any(c in b for c in ":：，,；;。！？!?")

    def is_label(self):
        m = re.match(V.MARKED_ITEM, self.t)
        return bool(m) and self.label(m[1])

    def item(self):
        m, marked = re.match(V.MARKED_ITEM, self.t), True
        if not m:
            m, marked = re.match(V.SPACED_ITEM, self.t), False
        if not m or not m[1].strip() or m[1].strip()[0] in "0123456789":
            return False
        b = m[1].strip()
        n = "".join(b.split()).lower()
        if marked and self.is_label():
            return False
        if any(c in b for c in ":：，,；;。"):
            return True
        if len(n) <= 8:
            return marked and not (n in V.SHORT_HEADINGS or any(w in n for w in V.HEADING_WORDS))
        return len(n) >= 16

    def heading(self):
        n = self.n
        if not n or re.match(V.DATE_LINE, n):
            return False
        if n in (*V.ABSTRACT, *V.ACKNOWLEDGEMENT, *V.OPENING, *V.CLOSING) or self.plain_references() or self.back() or self.is_label():
            return True
        if (self.outline is not None and 0 <= self.outline <= 8) or re.search(V.STYLE_HEADING, self.s):
            return True
        if self.numbered:
            return self.label(self.t)
        if self.item():
            return False
        if len(n) <= 48 and re.match(V.HEADING_NUMBER, n):
            return True
        return len(n) <= 36 and not any(c in self.t for c in "。！？；!?;") and (any(w in n for w in V.HEADING_WORDS) or (len(n) <= 14 and bool(re.match(V.SHORT_HEADING, self.t))))

    def ends(self):
        return self.references() or self.back() or (self.s.startswith(("heading", "标题")) and self.heading())


def starts_of_runs(units, first):
    out, k = set(), first
    while k < len(units):
        end = k
        while end < len(units) and units[end].entry():
            end += 1
        if end - k >= 2:
            out.add(k)
        k = max(end, k + 1)
    return out


def walk(units):
    first = next((k for k, u in enumerate(units) if u.abstract()), None)
    if first is None:
        first = next((k for k, u in enumerate(units) if u.body()), None)
    last = None
    if first is not None:
        thanks = next((k for k in range(first, len(units)) if units[k].thanks()), None)
        since = first if thanks is None else thanks
        runs = starts_of_runs(units, since + 1)
        stop = next((k for k in range(since + 1, len(units)) if k in runs or (units[k].ends() if thanks is not None else units[k].references() or units[k].back())), None)
        last = len(units) - 1 if stop is None else max(first, stop - 1)
    runs, phase, out = starts_of_runs(units, first or 0), "body", []
    for k, u in enumerate(units):
        inside = first is not None and first <= k <= last
        if inside:
            if u.thanks():
                phase = "acknowledgements"
            elif u.references():
                phase = "references"
            elif u.back():
                phase = "back_matter"
            elif phase in ("abstract", "body") and u.abstract():
                phase = "abstract"
            elif phase in ("abstract", "body") and u.body():
                phase = "body"
        if first is None or k < first:
            role = "front_matter"
        elif not inside:
            role = "back_matter"
        elif u.n in V.TOC:
            role = "toc_heading"
        elif u.toc():
            role = "toc_entry"
        elif u.table:
            role = "table_content"
        elif u.formula():
            role = "equation"
        elif u.back():
            role = phase = "back_matter"
        elif u.references():
            role, phase = "references_heading", "references"
        elif u.thanks():
            role, phase = "acknowledgement_heading", "acknowledgements"
        elif k in runs:
            role, phase = "reference_entry", "references"
        elif phase == "references":
            role = "reference_entry"
        elif phase == "back_matter":
            role = "back_matter"
        elif phase == "acknowledgements":
            role = "acknowledgement_body"
        elif u.heading():
            role = "heading"
        elif any(x in u.s for x in ("caption", "图注", "表注", "题注")) or re.match(V.CAPTION, u.n):
            role = "caption"
        elif u.n.startswith(("图注", "表注")) or re.match(V.NOTE, u.t):
            role = "note"
        elif u.n.startswith(("关键词", "关键字", "keywords", "keyword")):
            role = "keywords"
        elif not (any(c in u.t for c in "。！？；.!?;") or (len(u.t) >= 24 and u.t.count("，") + u.t.count(",") >= 2)):
            role = "ambiguous_non_prose"
        elif u.numbered or u.item():
            role = "body_list"
        else:
            role = "abstract_body" if phase == "abstract" else "body_prose"
        out.append((first, last, phase if inside else "outside", role))
    return out


MORE = [
    "1 Overview", "说明：这里的数据来自于第一次和第二次实验的全部结果。", "2.3 研究方法", "一、背景", "10 第一", "A) letter item", "（2）这是一个很长的列表项，后面还有内容", "3) short", "致谢 22", "参考文献 23", "引用文献说明", "Selected bibliography", "Sources consulted", "list of reference works", "Doe 2018 and more", "张三，李四. 行的研究. 2019",
    "12. Rows 2001 and so on", "https://a.example/x", "doi: 10.1/x", "[12] x y z", "定义如下 a_b", "f(x)[1] = {a, b}", "Σ x", "系统测试", "Short words", "2024年1月1日", "表2 数据", "Table 3. Rows", "图注：来自实验", "关键词：行", "行被读取。", "", None, "   ", "I ii", "第一章", "前言", "鸣谢各位", "Appendix B", "原文", "end of the line IV",
]


def test_documents_agree_with_a_walk(spark):
    rng = random.Random(7)
    pool = [t for ts in PLANTED.values() for t in ts] + MORE
    plain = lambda t: (t, None, None, None, None)
    docs = {d: [plain(t) for t in ts] for d, ts in PLANTED.items()} | {10: [plain(None)], 11: [plain("摘要")]}
    for d in range(100, 400):
        docs[d] = [(rng.choice(pool), rng.choice([None, None, "Normal", "Heading 1", "caption", "标题 2", "Equation", "My Title"]), rng.choice([None, False, False, True]), rng.choice([None, None, None, 0, 9, -1]), rng.choice([None, False, False, False, True])) for _ in range(rng.randrange(1, 25))]
    rows = [(d, 3 * k, *u, "x", 1) for d, us in docs.items() for k, u in enumerate(us)]
    df = spark.createDataFrame(rows, "doc long, i int, text string, style string, numbered boolean, outline int, in_table boolean, t string, n int").repartition(7)
    got = {}
    for r in docroles.classify(df, "doc", "i", style="style", numbered="numbered", outline="outline", in_table="in_table").orderBy("doc", "i").collect():
        got.setdefault(r.doc, []).append((r.scope_start, r.scope_end, r.phase, r.role))
        assert r.editable == (r.role in ("body_prose", "abstract_body", "body_list")) and (r.t, r.n) == ("x", 1)
    threefold = lambda x: None if x is None else 3 * x
    seen = set()
    for d, us in docs.items():
        want = [(threefold(a), threefold(b), p, r) for a, b, p, r in walk([Unit(*u) for u in us])]
        assert got[d] == want, (d, us)
        seen |= {r for *_, r in want}
    assert seen == {"front_matter", "back_matter", "toc_heading", "toc_entry", "table_content", "equation", "references_heading", "acknowledgement_heading", "reference_entry", "acknowledgement_body", "heading", "caption", "note", "keywords", "ambiguous_non_prose", "body_list", "abstract_body", "body_prose"}
    planted = {d: [r for *_, r in walk([Unit(t) for t in PLANTED[d]])] for d in PLANTED}
    assert planted[-1][5:11] == ["heading", "abstract_body", "keywords", "heading", "abstract_body", "heading"] and planted[-1][-5:] == ["back_matter"] * 5
    assert docroles.classify(df.where("false"), "doc", "i").count() == 0
    runs = docroles.sections(docroles.classify(df.where("doc = -3"), "doc", "i"), "doc", "i").orderBy("first").collect()
    assert [(r.state, r.n) for r in runs] == [("body/heading", 1), ("body/body_prose", 1), ("body/ambiguous_non_prose", 1), ("outside/back_matter", 2)]
