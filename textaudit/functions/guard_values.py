"""Fixed values of the pair guards: patterns and word lists that must be as they are for the same results."""

from textaudit.functions import lexicons as L

# --- fixed values: colloquial forms, by rule --------------------------------------------------------------------------
_DEGREE = r"(?:更(?:加|为)?|较(?:为)?|比较|相对|很|挺)"
_STATE_END = r"(?=$|[^㐀-鿿A-Za-z0-9_]|[且而并但或也了的地])"
COLLOQUIAL = (
    ("followed_change", r"(?:也|就|会)?跟着(?:增强|提高|上升|下降|降低|增大|减小|变化|改变|变强|变弱)"),
    ("informal_usage_degree", r"(?:被)?用得(?:越来越|比较|相当|很)?(?:广|多|少|好|差|频繁)"),
    ("plain_speaking", r"说白了|说到底|话说回来"),
    ("very_adjective", r"挺(?:好|多|大|高|低|快|慢|强|弱|方便|容易|难|重要|明显|不错|合适|有效|清楚|常见|麻烦|复杂|简单)(?:的|了)?"),
    ("contracted_stability_state", f"{_DEGREE}稳{_STATE_END}"),
    ("contracted_accuracy_state", f"{_DEGREE}准{_STATE_END}"),
    ("contracted_smoothness_state", f"{_DEGREE}顺{_STATE_END}"),
    ("contracted_economy_state", f"{_DEGREE}省{_STATE_END}"),
    ("do_informal", r"搞(?:清楚|明白|懂|定|好|出来|一下|研究|开发|分析|设计)"),
    ("casual_choice", r"随便(?:选|选择|使用|设置|调整|修改|处理|采用|看看|写|填|换|改)"),
    ("first_person_colloquial", r"咱们"),
    ("domain_li", r"(?:系统|模型|算法|论文|研究|实验|章节|框架|平台|环境|数据集|网络|结构|过程|方法)里(?:面)?(?:的|所|用|有|包含|存在|进行|实现|应用|部署|运行)"),
    ("also_did", r"(?:还|也|就|再)(?:做|搞)了"),
    ("used_for_modifier", r"(?:同步|消隙|控制|训练|测试|实验|部署|评估|分析|计算|测量|校准|采样|通信|传输|检测)用的(?=[一-鿿A-Za-z0-9_-]{0,14}(?:方法|算法|模型|数据|参数|装置|设备|工具|指标|方案|控制器|传感器))"),
)
# --- fixed values: collocations that conflict -------------------------------------------------------------------------
COLLOCATIONS = (
    ("adapt_requirement", r"适配[^，。；!?！？\n]{0,30}要求"),
    ("realize_requirement", r"(?:实现|达成)[^，。；!?！？\n]{0,24}(?:要求|需求)"),
    ("enhance_precision", r"增强[^，。；!?！？\n]{0,16}(?:控制|测量|定位|计算|识别)?精度"),
)
# --- fixed values: clauses without a predicate ------------------------------------------------------------------------
NOMINAL = (
    r"^(?:并|且|同时|随后|进而|然后)?(?:本文|本研究|本章)?(?:针对|围绕|关于|对于|对)[^，。；!?！？\n]{2,80}"
    r"(?:仿真分析|实验分析|统计分析|回归分析|对比分析|性能分析|误差分析|机理分析|模型分析|数据分析|研究|验证|测试|评估|比较)$"
)
BRIDGE = r"(?:进行|开展|实施|完成|作出|做出|展开)(?:了|过)?|(?:予以|加以)(?:分析|研究|验证|测试|评估|比较)"
DANGLING = r"(?:主要|完全|部分|仍然|仅)?(?:基于|通过|根据|依据|针对|围绕|对于|关于|作用于|取决于|依赖于)$"
# --- fixed values: actions, subjects and finite forms -----------------------------------------------------------------
ACTION = (
    r"(?:介绍|包括|包含|采用|使用|分析|研究|引入|完成|搭建|简化|仿真|得出|绘制|画出|提升|提高|增强|实现|说明|比较|验证|评估|测试|构建|建立|设计|处理|提出|计算|获得|"
    r"形成|切入|延伸|讨论|考察|测量|校准|采样|传输|检测|打下|奠定)"
)
SUBJECT = (
    r"^(?:(?:并|且|同时|随后|进而|然后|最后)，?)?(?:本文|本研究|本章|研究(?:者|人员|团队)|实验(?:结果|数据)|分析结果|"
    r"该(?:方法|模型|系统|算法|控制器|结果|数据|实验)|系统|模型|算法)"
)
FINITE = f"{ACTION}(?:了|过)"
MODAL = (
    r"(?:可|可以|能够|能|应|应当|需要|将|已|已经|进一步|分别|依次)[^，,。；!?！？\n]{0,8}"
    r"(?:采用|使用|分析|研究|完成|搭建|简化|得出|绘制|提升|提高|增强|实现|说明|比较|验证|评估|测试|构建|建立|设计|处理|提出|计算|获得|形成|讨论|考察|测量)"
)
# --- fixed values: causal references and what they refer to -----------------------------------------------------------
CAUSAL = r"据此|基于此|由此(?:可见|可知|表明|说明|导致|使得?)|这(?:表明|说明|意味着|导致|使得?)"
ANTECEDENT = (
    r"(?:上述|前述|该|这一|这些)(?:实验|结果|结论|发现|分析|数据|证据|现象|关系|差异|变化|机制|条件|模型|方法)"
    r"|(?:实验|统计|分析|测量|仿真)(?:结果|数据)[^。！？!?；;]{0,20}(?:显示|表明|说明|证明|发现)"
)
LOOK_BACK = 72
QUOTED = "“[^”\\n]{0,500}”|‘[^’\\n]{0,500}’|「[^」\\n]{0,500}」|『[^』\\n]{0,500}』|(?<![A-Za-z0-9])\"[^\"\\n]{0,500}\""
# --- fixed values: scope qualifiers -----------------------------------------------------------------------------------
JUN_FOLLOWS = (
    r"为|是|可|能|应|须|需|已|未|不|会|由|在|对|与|向|从|把|将|被|有|无|采用|使用|包含|包括|属于|来自|达到|保持|维持|表现|呈现|出现|支持|满足|通过|"
    r"获得|得到|完成|经过|按照|依据|处于|位于|超过|低于|高于|优于|一致|相同|不同"
)
SCOPE_ZH = (
    r"不仅仅|不仅|不只|只要|只需|只须|仅需|仅须|只有|唯有|唯一|仅仅|全部|全都|所有(?![权制])|任何|任一|一律|必然|必定|势必|仅"
    rf"|(?<![0-9一二两三四五六七八九十百千万几多每这那某船舰])只(?!身|字|言片语|手遮天)|均(?=(?U:\s{{0,15}})(?:{JUN_FOLLOWS}))"
)
CLAUSE = r"[^。！？!?；;\n]"
ONLY_AT = rf"^[^\S\n]*在(?:{CLAUSE}{{1,48}}?(?:时|前|后|条件下)|{CLAUSE}*才)"
SCOPE_EN = r"(?iU)(?<!\bnot\s{1,5})\b(?:only|solely)\b|\b(?:all|every|any|necessarily|always)\b"
# --- fixed values: negations, entities, order cues --------------------------------------------------------------------
NEGATION = (
    r"(?iU)(?:并非|并不|并未|尚未|不得|不能|不可|不会|没有|并无|毫无|无法|未(?!来|知)|不(?!仅|但|论|管|妨))"
    r"|\b(?:not|no|never|without|cannot|can't|isn't|aren't|wasn't|weren't|doesn't|don't|didn't)\b"
)
BOUND_NUMBER = r"(?U)(?<![A-Za-z0-9_.:/-])\d+(?:[.,]\d+)*(?:\.\d+)?\s*(?:%|％)?(?![A-Za-z0-9_.:/-])"
URL = r"(?i)https?://[^\s`，,。；;）)\]】>\"']+"
TECH = (
    r"(?<![A-Za-z0-9_])(?:(?:[A-Z]{2,}[A-Za-z0-9]*|[A-Z][A-Za-z0-9]*)(?:[-_](?:[A-Z]{2,}[A-Za-z0-9]*|[A-Z][A-Za-z0-9]*|\d+[A-Za-z0-9]*))+"
    r"|(?:[A-Z]{2,}[- ]?\d+(?:\.\d+)*)|(?:[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)|(?:[A-Z]{2,}[A-Za-z0-9]*)|(?:[A-Za-z]+(?:[./:_-][A-Za-z0-9_]+)+))(?![A-Za-z0-9_])"
)
_TITLE_WORD = r"(?:[A-Z][A-Za-z0-9]+(?:[-/][A-Z]?[A-Za-z0-9]+)?)"
TITLE = rf"(?<![A-Za-z0-9]){_TITLE_WORD}(?:\s+{_TITLE_WORD}){{1,5}}(?![A-Za-z0-9])"
METRIC = (
    r"(?i)(?<![A-Za-z0-9_])(?:准确率|正确率|精确率|召回率|特异度|灵敏度|命中率|通过率|成功率|错误率|误差率"
    r"|F1(?:[-_ ]?score|值)?|mAP(?:@\d+(?::\d+)?)?|AUC(?:值)?|AP|AR|RMSE|MAE|MSE|R\^?2|损失值|平均损失|推理延迟|响应延迟|吞吐量|参数量|显存占用|内存占用)(?![A-Za-z0-9_])"
)
TITLE_LEADERS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "this", "these", "those", "to", "with")
TITLE_PHRASES = ("abstract", "key words", "keywords", "table", "figure")
STRONG_CUE = r"(?i)(?:→|->|=>|\brespectively\b|分别|依次|对应|顺序|排序|排名|先后)"
DELIMITER = r"(?i)(?:、|，|,|/|\band\b|\bor\b)"
INLINE_CODE = r"`[^`]+`"
# --- fixed values: markers that lead a text ---------------------------------------------------------------------------
_CJK_NUMBER = "一二三四五六七八九十百零"
LEADING_MARKER = (
    rf"^(?:(?:第[{_CJK_NUMBER}0-9]+[章节])|(?:[0-9]+(?:\.[0-9]+){{1,4}})(?=\s)|(?:[0-9]+[.．、])|(?:[{_CJK_NUMBER}]+[.．、])|(?:[0-9]+)(?=\s)"
    rf"|(?:[（(]\s*(?:[0-9]+|[{_CJK_NUMBER}]+)\s*[）)])|(?:[0-9]+[)）]))"
)
# --- fixed values: terms that a revision must keep --------------------------------------------------------------------
VERSIONED = (
    r"(?<![A-Za-z0-9])(?:(?:GPT|BERT|RoBERTa|YOLO|ResNet|VGG|LLaMA|Qwen|DeepSeek|CUDA|PyTorch|TensorFlow|Python|Node\.js|React|Vue|Vite|Flask|Django)\s*v?\d+(?:\.\d+)*[A-Za-z0-9._-]*"
    r"|(?:[A-Z][A-Za-z]*[A-Z][A-Za-z0-9]*(?:[-_][A-Za-z0-9.]+)+)|(?:[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)"
    r"|(?:[A-Za-z]{2,}[.-]?\d+(?:\.\d+)*(?:[-_][A-Za-z0-9.]+)?)|(?:(?:v|V)\d+(?:\.\d+){1,3}))(?![A-Za-z0-9])"
)
CODE_LIKE = (
    r"(?<![A-Za-z0-9_])(?:[A-Za-z_][A-Za-z0-9_]*(?:[./:_-][A-Za-z0-9_]+)+|[A-Z][A-Za-z0-9_]*[a-z][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*|[A-Z]{2,}[A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*"
    r"|Django|RESTful|API|JWT|ORM|S3|RGW|Ceph|MySQL|Vue|React|Flask|Python|Boto3|Vite|DOCX|PDF|AI|AIGC|GPT|GPTZero|Google|DeepSeek|Qwen|LLM|CSS|HTML|JSON|HTTP|REST|URL|OpenAI|LangChain)"
    r"(?![A-Za-z0-9_])"
)
# --- fixed values: English words that run together --------------------------------------------------------------------
SPACED_TOKEN = r"[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*"
GLUE_LEFT = (
    "a", "an", "the", "as", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "of", "to", "for", "with", "by", "from", "and", "or",
    "but", "then", "using", "employing",
)
GLUE_RIGHT = GLUE_LEFT + ("addition",)
# --- fixed values: answers in place of texts, formatting, fragments ---------------------------------------------------
LEADING_MARKUP = r"^[>\-\*\s#]+"
ANSWERS = ("如果你愿意", "可以改成", "改写后：", "修改后：", "说明：", "原因很简单", "我也可以继续帮你", "请把需要", "你可以直接贴")
ANSWER_WRAPPER = r"(?i)^(?:以下|下面|当然|好的|已根据|根据你的要求|here\s+(?:is|are)|the\s+rewritten|rewritten\s+text|revised\s+text).{0,80}[:：]"
MARKDOWN = r"\*\*|### |## |- \*\*|> "
FRAGMENT_ZH = r"(?:的|和|与|及|以及|并|但|而|或|在|对|把|被|将|为|以|从|向|通过|由于|因为|因此|同时|其中|例如|包括|并且|从而|为了)$"
FRAGMENT_EN = r"(?i)\b(?:and|or|the|a|an|of|to|with|by|from|as|is|are|was|were|that|which|while|because|therefore|including|using|employing|in|on|at|for)$"
# --- fixed values: author-year citations ------------------------------------------------------------------------------
_AUTHOR = r"(?:[一-鿿]{2,12}\s*(?:等)?(?:和[一-鿿]{2,12})?|[A-Z][A-Za-z]+(?:\s+(?:&|and)\s+[A-Z][A-Za-z]+|\s+et\s+al\.)?)"
_AUTHOR_YEAR = rf"(?:{_AUTHOR}\s*[,，]\s*\d{{4}}[a-z]?(?:\s*[,，]\s*\d{{4}}[a-z]?)*)"
AUTHOR_YEAR = rf"[（(]{_AUTHOR_YEAR}(?:\s*[;；]\s*{_AUTHOR_YEAR})*[）)]"
# --- fixed values: spans that a revision must give back as they are ---------------------------------------------------
URL_SPAN = r"https?://[^\s`，,。；;）)\]】>\"']+"
DOI_SPAN = r"(?<![A-Za-z0-9])10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
_UNIT = r"(?:%|％|cm|mm|m|km|kg|g|mg|μg|ug|L|mL|ml|s|min|h|d|℃|°C|K|Pa|kPa|MPa|Hz|kHz|MHz|GHz|px|dpi)"
WITH_UNIT = rf"(?<![\d.])\d+(?:\.\d+)?\s*{_UNIT}(?![A-Za-z0-9.])"
RANGE_WITH_UNIT = rf"(?<![\d.])\d+(?:\.\d+)?\s*(?:-|–|—|~|～|至)\s*\d+(?:\.\d+)?\s*{_UNIT}(?![A-Za-z0-9.])"
PLAIN_NUMBER = r"(?<![A-Za-z0-9_.])\d+(?:[.,]\d+)*(?:\.\d+)?\s*(?:%|％)?(?![A-Za-z0-9_.])"
CODE_SPAN = r"`[^`\n]+`"
LATEX_SPAN = r"\$\$[^$\n]+\$\$|\$[^$\n]+\$|\\\([^\n]+?\\\)|\\\[[^\n]+?\\\]"
#: What the first character of a span is; inside a word none begins but a URL, so most places are passed by this alone.
_SPAN_BEGINS = r"(?=[`$\\\[(（图表式公0-9]|http|(?<![A-Za-z0-9])[A-Za-z])"
#: Tried in this order at each place.
PROTECTED = _SPAN_BEGINS + "(?:" + "|".join((
    CODE_SPAN, LATEX_SPAN, URL_SPAN, DOI_SPAN, L.NUMERIC_CITATION, AUTHOR_YEAR, r"[图表]\s*\d+(?:[.\-–—]\d+)*", r"式\s*[（(]?\s*\d+(?:[-–—]\d+)?\s*[）)]?", r"公式\s*[（(]?\s*\d+(?:[-–—]\d+)?\s*[）)]?",
    RANGE_WITH_UNIT, WITH_UNIT, rf"[（(]\s*(?:[0-9]+|[{_CJK_NUMBER}]+)\s*[）)]", PLAIN_NUMBER, VERSIONED,
)) + ")"
