"""Fixed values of the audit: word lists, patterns, thresholds. They must be as they are for the same results."""

# --- fixed values: formulaic connectors -------------------------------------------------------------------------------
CONNECTORS_ZH = [
    "首先", "其次", "再次", "最后", "此外", "综上", "总之", "由此可见", "值得注意的是", "不仅如此", "与此同时", "综上所述",
    "总而言之", "进一步地", "具体而言", "换言之", "换句话说", "在此基础上", "基于此", "由此可知", "不难发现", "需要指出的是",
    "一方面", "另一方面", "再者", "再者说", "其一", "其二", "其三",
]
CONNECTORS_EN = [
    "firstly", "secondly", "thirdly", "finally", "in addition", "furthermore", "moreover", "in conclusion",
    "it is worth noting that", "it should be noted that", "as a result", "in this context", "on the other hand",
]
# --- fixed values: template phrases -----------------------------------------------------------------------------------
TEMPLATES_ZH = [
    r"在.+?背景下", r"随着.+?的(?:不断)?发展", "具有重要意义", r"提供了(?:有力|重要)?(?:的)?(?:支持|支撑)",
    r"发挥(?:着|了)?重要(?:作用|角色)", r"为.+?提供了(?:有力|重要)?保障", r"日益(?:受到|得到).+?关注",
    r"具有(?:较强|一定)的(?:现实|理论|实践)?意义", r"奠定了(?:坚实)?基础", r"得到了广泛关注",
]
TEMPLATES_EN = [
    "has important significance", "plays an important role", r"provides (?:strong|important)? support", "further improves",
    "effectively promotes", "in the context of", r"with the (?:continuous )?development of",
    r"has attracted (?:wide|increasing) attention", "lays a solid foundation",
]
# --- fixed values: passive markers, idioms, burst connectors, closings, padding ---------------------------------------
PASSIVE = [
    r"被[一-龥]{1,15}(?:了|过)?", r"予以[一-龥]{1,4}", r"加以[一-龥]{1,4}", r"为[一-龥]{0,20}?所[一-龥]{1,4}",
    r"受到(?:了|过)?[一-龥]{1,20}?", r"得以[一-龥]{1,4}",
]
IDIOMS = [
    "至关重要", "不言而喻", "举足轻重", "不可或缺", "相辅相成", "息息相关", "显而易见", "日益凸显", "层出不穷", "与日俱增",
    "行之有效", "卓有成效", "一目了然", "众所周知", "毫无疑问", "不可否认", "毋庸置疑", "日益完善", "不断完善", "日益成熟",
    "蓬勃发展", "综上所述", "总而言之", "由此可见", "不难发现", "一以贯之", "重中之重", "首当其冲", "淋漓尽致",
]
BURST = [
    "首先", "其次", "再次", "最后", "此外", "综上", "总之", "不仅如此", "与此同时", "进一步地", "具体而言", "在此基础上", "基于此",
    r"第一(?=[，,、是]|，)", r"第二(?=[，,、是]|，)", r"第三(?=[，,、是]|，)", r"第四(?=[，,、是]|，)", r"第五(?=[，,、是]|，)",
]
CLOSINGS = [
    "综上所述", "总而言之", "总的来说", "由此可见", "整体来看", "不难看出", "in conclusion", "to sum up", "it can be seen that",
    "these findings suggest that", "this demonstrates that",
]
PADDING = [
    "具有(?:重要|较强|一定)意义", "提供了(?:有力|重要)?支持", r"发挥(?:着|了)?重要(?:作用|角色)", r"奠定了(?:坚实)?基础",
    "日益完善", "不断完善", "从某种意义上说", "就整体而言",
]
INTRODUCED = [
    "综上所述", "总而言之", "由此可见", "具有重要意义", "具有较强的现实意义", r"奠定了(?:坚实)?基础", r"提供了(?:有力|重要)?支持",
    r"在.+?背景下.+?具有.+?意义", r"随着.+?的(?:不断)?发展", r"发挥(?:着|了)?重要(?:作用|角色)", r"日益(?:受到|得到).+?关注",
    r"为.+?提供了(?:有力|重要)?保障", r"得到了广泛(?:应用|关注)",
]
# --- fixed values: scaffolds ------------------------------------------------------------------------------------------
NESTED_NUMBER = r"(?:[（(]\s*(?:\d{1,2}|[一二三四五六七八九十]+)\s*[）)]|(?<![\d.A-Za-z])(?:\d{1,2}|[一二三四五六七八九十]+)\s*[）)])"
_ITEM = r"[^。！？!?\n：:；;]{1,48}"
COLON_PARALLEL = rf"{_ITEM}[：:]\s*{_ITEM}[；;]\s*{_ITEM}[；;]\s*{_ITEM}"
# --- fixed values: surface structure of a sentence, first match wins --------------------------------------------------
STRUCT_PASSIVE = r"(?:^|[。！？!?；;])\s*(?:[^。！？!?；;]{0,8}?(?:被|予以|加以|为[^。！？!?；;]{0,12}?所|受到|得以))"
STRUCT_SUBORDINATE = (
    r"^(?:若|如果|假如|倘若|虽然|尽管|即使|由于|因为|鉴于|当[^。！？!?；;]{0,12}?时|通过[^。！？!?；;]{1,20}?(?:，|,|。|；|;)|"
    r"在[^。！？!?；;]{1,20}?(?:上|中|下|方面|过程|情况|前|后)，|基于|随着|相对于|为了|一旦|只要|只有|除非|既然|以便)"
    r"|^[一-鿿]{2,8}(?:里|中|上|下|内|外|时|后|前|过程|情况)[:,，][一-鿿]"
)
STRUCT_PREMODIFIER = r"(?:[一-鿿]{2,8}的){3,}[一-鿿]{2,}"
STRUCT_ENUMERATIVE = r"(?:一方面|另一方面|首先|其次|再次|最后|此外|另外|同时|以及|并且|一是|二是|三是|其一|其二|其三)"
STRUCTURES = ("passive", "subordinate_lead", "long_premodifier", "enumerative", "plain_active")
# --- fixed values: opening families, first match wins -----------------------------------------------------------------
OPENINGS_ZH = (
    ("cn.based_on", r"^(?:基于|依据|根据)"),
    ("cn.through", r"^(?:通过|借助|利用)"),
    ("cn.targeting", r"^(?:针对|围绕|关于|对于)"),
    ("cn.in_context", r"^在[^，,。！？!?；;]{1,24}(?:中|内|下|上|方面|过程|阶段|条件下)[，,]?"),
    ("cn.condition", r"^(?:若|如果|假如|倘若|只要|只有|一旦|除非|当)"),
    ("cn.concession", r"^(?:虽然|尽管|即使|不过|然而|但是|但)"),
    ("cn.causal", r"^(?:由于|因为|鉴于|因此|因而|所以)"),
    ("cn.sequence", r"^(?:首先|其次|再次|最后|第一|第二|第三|其一|其二|其三)"),
    ("cn.additive", r"^(?:此外|另外|同时|再者|并且|而且)"),
    ("cn.article_stance", r"^(?:本文|本研究|本章|笔者|我们)"),
    ("cn.demonstrative_subject", r"^(?:该|这(?:一|些)?)(?:方法|模型|系统|算法|研究|结果|过程|方案|模块|指标)"),
    ("cn.passive", r"^(?:[^，,。！？!?；;]{0,10})?(?:被|受到|得以|予以|加以)"),
    ("cn.domain_subject", r"^(?:系统|模型|算法|方法|研究|实验|结果|数据|模块)"),
)
OPENINGS_EN = (
    ("en.based_on", r"(?i)^(?:based on|according to)\b"),
    ("en.through", r"(?i)^(?:through|using|by means of)\b"),
    ("en.condition", r"(?i)^(?:if|when|unless|once|provided that)\b"),
    ("en.concession", r"(?i)^(?:although|though|however|nevertheless)\b"),
    ("en.causal", r"(?i)^(?:because|therefore|thus|consequently)\b"),
    ("en.sequence", r"(?i)^(?:first|second|third|finally|lastly)\b"),
    ("en.article_stance", r"(?i)^(?:this (?:study|paper|chapter)|we)\b"),
)
#: Marks before a sentence's core, and connectives that its frame counts.
CORE_MARKER = r"^(?:第[一二三四五六七八九十百零0-9]+[章节]|[（(]?[一二三四五六七八九十0-9]+[）).、．]|[0-9]+(?:\.[0-9]+){0,4})\s*"
CONJUNCTION_ZH = "并且|而且|以及|同时|从而|进而|但是|然而|因此|因而|如果|虽然|不仅|而|并|且"
CONJUNCTION_EN = "and|but|because|therefore|although|while|if"
# --- fixed values: growth of patterns (new count, growth) that blocks: in a chunk, in its document, over a whole document ---
LOCAL_GROWTH, DOCUMENT_GROWTH, CUMULATIVE_GROWTH = (3, 2), (4, 2), (4, 1)
# --- fixed values: numbers, citations, terms --------------------------------------------------------------------------
NUMBER = r"(?<![A-Za-z0-9_.])\d+(?:[.,]\d+)*(?:\.\d+)?\s*(?:%|％)?(?![A-Za-z0-9_.])"
NUMERIC_CITATION = r"\[(?:\d+|\d+[-–—]\d+)(?:[,，;；]\s*(?:\d+|\d+[-–—]\d+))*\]"
CONTENT_TOKEN = r"[A-Za-z][A-Za-z0-9_-]*"
RETENTION_UNIT = r"[㐀-䶿一-鿿]|[A-Za-z0-9]+(?:[._%+/-][A-Za-z0-9]+)*"
STOPWORDS = [
    "about", "above", "after", "again", "against", "along", "also", "among", "and", "another", "any", "are", "around", "because",
    "been", "being", "between", "both", "can", "could", "does", "doing", "each", "either", "from", "had", "has", "have", "having",
    "into", "main", "make", "makes", "making", "many", "may", "might", "more", "most", "much", "must", "one", "only", "other", "our",
    "out", "over", "same", "should", "such", "than", "that", "the", "their", "them", "then", "there", "these", "this", "those",
    "through", "thus", "under", "use", "used", "uses", "using", "was", "were", "while", "with", "within", "would",
]
REPEATED_PUNCTUATION = r"([，,。！？!?；;：:、])\1+"
SENTENCE_TERMINAL = r"[。！？!?；;.][\"'”’）)\]】》]*$"
WEAK_TRAILING = r"[，,、：:（(【\[][\"'”’）)\]】》]*$"
# --- fixed values: abbreviations whose full stop ends no sentence -----------------------------------------------------
ABBREVIATIONS = ["al", "approx", "dept", "dr", "eq", "etc", "fig", "inc", "jr", "mr", "mrs", "ms", "no", "prof", "sr", "st", "vs"]
# --- fixed values: dimensions of the audit, the codes of each, points by level ----------------------------------------
DIMENSIONS = (
    ("rhythm", ("low_burstiness_ratio", "sentence_fragment_gaming", "structure_template_concentration"), True),
    ("transitions", ("connector_overuse", "mechanical_burst_pattern"), True),
    ("templates", ("template_phrase_density", "generic_closing_phrase", "abstract_padding_density", "chengyu_density_high"), True),
    ("structure", ("nested_number_scaffold", "colon_parallel_scaffold", "paragraph_length_symmetry"), False),
    ("register", ("passive_voice_overuse",), False),
)
POINTS = {"high": 3, "medium": 2, "low": 1}
OVERLAP_LEAST_TERMS = 8
OVERLAP_THRESHOLD = 0.72
RETENTION_WEIGHTS = (0.55, 0.20, 0.25)
EVENT_BUFFER = 512
MOST_HOTSPOTS = 12
MOST_CHARS = 300_000


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"
