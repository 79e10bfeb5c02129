"""The reference operators on inline fixtures: codes that must and must not appear, and order-dependent folds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textaudit.functions import text as T
from textaudit.operators import audit, events, guards, history, pairs, phrases, readability, records, repetition, segment, select, validators
from textaudit.plans import text_queries
from textaudit.sources import tables

TEXTS = {
    "connectors": ("首先，系统读取数据。其次，模块处理数据。此外，结果写入表中。最后，程序结束。", {"connector_overuse", "mechanical_burst_pattern"}),
    "templates": ("随着技术的不断发展，系统具有重要意义。综上所述，方法奠定了坚实基础。", {"template_phrase_density", "generic_closing_phrase", "abstract_padding_density"}),
    "passive": ("数据被系统读取了。结果被模块写入了。日志被程序清理了。", {"passive_voice_overuse"}),
    "uniform": ("The unit reads one row now. " * 6, {"low_burstiness_ratio"}),
    "fragments": ("Yes. No. The longer sentence describes the whole procedure in detail. Another sentence gives the second measured result. One more sentence closes the paragraph here.", {"sentence_fragment_gaming"}),
    "nested": ("（1）读取文件。（2）解析文件。（3）写入文件。", {"nested_number_scaffold"}),
    "colon": ("系统包括：读取模块；解析模块；写入模块。", {"colon_parallel_scaffold"}),
    "plain": ("The probe was lowered to nine metres. Readings settled after a quarter of an hour, and the second series, taken in rain, ran slightly higher.", set()),
    "empty": ("", set()), "blank": (" \n\n ", set()), "null": (None, set()),
}


def test_rules_fire_and_stay_silent(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "id string, text string")
    rows = {r.id: r for r in audit.audit(df).collect()}
    for k, (_, want) in TEXTS.items():
        codes = set(filter(None, rows[k].risk_codes.split(",")))
        assert want <= codes if want else not codes, (k, codes)
    dims = audit.dimensions(audit.audit(df), "id")
    assert dims.count() == 5 * len(TEXTS)
    assert {r.dimension for r in dims.where("id = 'templates' and status = 'focus'").collect()} >= {"templates"}


def test_paragraph_symmetry_and_structure(spark):
    same = "\n\n".join("这一段文字的长度与其他各段完全相同" for _ in range(4))
    many = "".join(f"系统读取第{c}批数据。" for c in "甲乙丙丁戊己庚辛壬")
    rows = {r.id: r.risk_codes for r in audit.audit(spark.createDataFrame([("p", same), ("s", many)], "id string, text string")).collect()}
    assert "paragraph_length_symmetry" in rows["p"] and "structure_template_concentration" in rows["s"]


def test_long_texts_are_audited_whole(spark):
    """What stands behind the first 300,000 characters counts, with either line end."""
    head = "The probe was lowered to nine metres in rain. " * 7000
    tail = "In conclusion, it ran higher.\r\n\r\nWe saw it. We saw two. "
    r = audit.audit(spark.createDataFrame([(head + tail,)], "text string")).collect()[0]
    assert len(head) > 300_000 and r.sentence_count == 7003 and r.paragraph_count == 2
    assert r.opening_top == 7000 and r.opening_total == 7003 and r.closing_count == 1


def test_commonest_value(spark):
    rows = [([],), (["b"],), (["b", "a", "b", "c", "a", "b"],), (["", "", "x"],)]
    assert [r[0] for r in spark.createDataFrame(rows, "v array<string>").select(audit.most_often(F.col("v"))).collect()] == [0, 1, 3, 2]


def test_delta_recommendation_and_next_step(spark):
    before = audit.audit(spark.createDataFrame([("a", TEXTS["connectors"][0]), ("b", TEXTS["plain"][0]), ("c", TEXTS["passive"][0])], "id string, text string"))
    after = audit.audit(spark.createDataFrame([("a", TEXTS["plain"][0]), ("b", TEXTS["templates"][0]), ("c", TEXTS["passive"][0])], "id string, text string"))
    delta = audit.stage_delta(audit.dimensions(before, "id"), audit.dimensions(after, "id"), "id")
    summary = audit.summarize_delta(delta, "id")
    s = {r.id: r for r in summary.collect()}
    assert s["a"].change_permille == -1000 and s["b"].change_permille is None and s["b"].regressed >= 1
    step = {r.id: r.decision for r in audit.next_step(summary, audit.recommendations(delta, audit.dimensions(after, "id"), "id"), "id").collect()}
    assert step == {"a": "stop", "b": "targeted_rerun", "c": "manual_review"}


LADDER = [  # ready, source_only, has_next, bound, after points, recommended: (dimension, trend, executable, high risks, targets)
    ("blocked", False, False, True, None, 9, [("templates", "regressed", True, 1, 1)]), ("clean", True, True, True, None, 0, []), ("source", True, True, True, None, 4, [("register", "stable", False, 0, 1)]),
    ("manual", True, False, True, "templates", 4, [("register", "stable", False, 1, 1)]), ("worse", True, False, True, "templates", 4, [("rhythm", "regressed", True, 0, 1)]), ("high", True, False, True, "templates", 4, [("rhythm", "stable", True, 1, 1)]),
    ("better", True, False, True, "templates", 4, [("rhythm", "stable", True, 0, 1)]), ("no next", True, False, False, "templates", 4, [("rhythm", "stable", True, 0, 1)]), ("unbound", True, False, True, None, 4, [("rhythm", "stable", True, 0, 1)]),
    ("no target", True, False, False, None, 4, [("rhythm", "stable", True, 0, 0)]), ("later", True, False, False, None, 4, [("register", "regressed", False, 2, 1), ("rhythm", "stable", True, 0, 1)]), ("null", None, None, None, None, 2, []),
]


def test_decision_ladder(spark):
    summary = spark.createDataFrame([(k, 5, p) for k, _, _, _, _, p, _ in LADDER], "id string, before_points int, after_points int")
    recs = spark.createDataFrame([(k, i + 1, *r) for k, *_, rs in LADDER for i, r in enumerate(rs)], "id string, rank int, dimension string, trend string, executable boolean, high_count int, targets int")
    state = spark.createDataFrame([(k, a, b, c, d) for k, a, b, c, d, _, _ in LADDER], "id string, ready boolean, source_only boolean, has_next boolean, bound string")
    delta = spark.createDataFrame([(k, "templates", 2, "improved") for k, *_ in LADDER], "id string, dimension string, after_points int, trend string")
    got = {r.id: r.decision for r in audit.next_step(summary, recs, "id", state=state, delta=delta).collect()}
    assert got == {
        "blocked": "blocked", "clean": "stop", "source": "next_dimension", "manual": "manual_review", "worse": "targeted_rerun", "high": "targeted_rerun", "better": "next_dimension", "no next": "targeted_rerun",
        "unbound": "targeted_rerun", "no target": "stop", "later": "targeted_rerun", "null": "manual_review",
    }


def test_sentences_openings_and_bounds(spark):
    df = spark.createDataFrame([("One two. Three! 四五。六；seven\neight",), ("first line\nsecond line\n\nthird",), ("",), ("a" * 50 + "\n" + "b" * 9,)], "t string")
    got = [r[0] for r in df.select(T.sentences(F.col("t"))).collect()]
    assert got == [["One two.", "Three!", "四五。", "六；", "seven eight"], ["first line", "second line", "third"], [], ["a" * 50, "b" * 9]]
    assert [r[0] for r in df.select(T.bounded(F.col("t"), 55)).collect()][3] == "a" * 50 + "\n"
    o = spark.createDataFrame([("Based on these many old results, we go.", "en.based_on"), ("基于数据，模型改变。", "cn.based_on"), ("系统运行。", "cn.domain_subject"), ("We saw the old red car.", "en.article_stance"), ("1. 首先读取。", "cn.sequence")], "s string, want string")
    assert all(r[0] == r[1] for r in o.select(T.opening_family(F.col("s")), "want").collect())
    a, b = spark.createDataFrame([("The cat, a big one, sat on it.",), ("The dog, a tan pup, lay on it.",)], "s string").select(T.skeleton(F.col("s"))).collect()
    assert a[0] == b[0] and len(a[0]) == 64


PAIRS = [
    ("identity", "The value is 12.5 % in [3].", "The value is 12.5 % in [3].", []), ("dropped", "It takes 12 rounds and 7 tests.", "It takes 12 rounds and some tests.", ["number_changed"]),
    ("cited", "Shown before [1,2].", "Shown before [1].", ["citation_changed"]), ("short", "x" * 100 + ".", "x" * 30 + ".", ["shrank"]), ("long", "x" * 20, "x" * 60, ["expanded"]),
    ("drift", "系统读取数据并写入结果表中供后续分析使用和检查", "The system reads data.", ["language_drift"]), ("empty", "Some text stands here.", "", ["empty_output"]),
    ("marks", "It was seen there (twice), in full.", "It was seen there (twice, in full,,,", ["surface"]), ("template", "结果写入表中并由模块读取。", "综上所述结果写入表中并读取。", ["template_introduced"]),
]


def test_pair_checks(spark):
    df = spark.createDataFrame([(k, a, b) for k, a, b, _ in PAIRS], "pair_id string, input_text string, output_text string")
    rows = {r.pair_id: r for r in pairs.check_pairs(df).collect()}
    for k, _, _, want in PAIRS:
        assert set(want) <= set(rows[k].issues) and (want or not rows[k].issues), (k, rows[k].issues)
    assert rows["identity"].retention == 10000 and rows["dropped"].missing_numbers == ["12", "7"][1:] and rows["cited"].missing_citations == ["[1,2]"]


def test_overlap_search_and_growth(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:8]) + " other thing"), (3, "few words")], "i int, text string")
    got = {(r.q_id, r.t_id) for r in pairs.containment_search(texts, texts.withColumnRenamed("i", "j"), "i", "j").collect()}
    assert got == {(1, 1), (2, 2), (1, 2), (2, 1)}
    c = spark.createDataFrame([("a", i, " ".join(words) if i in (0, 3) else "nothing of it") for i in range(5)], "k string, p int, text string")
    assert [(r.right_pos, r.left_pos) for r in pairs.adjacent_overlap(c, "k", "p").collect()] == [(3, 0)]
    before = pairs.pattern_profile(spark.createDataFrame([("d", "Rows go in. Rows come out.")], "k string, text string"), "k")
    after = pairs.pattern_profile(spark.createDataFrame([("d", "However the rows go in. However the rows come out. However they all stay here.")], "k string, text string"), "k")
    grown = {r.pattern: r.blocks for r in pairs.pattern_growth(before, after, "k").where("kind = 'opening'").collect()}
    assert grown == {"en.concession": True}


def test_chunks_keep_every_character_and_the_limit(spark):
    rng = random.Random(1)
    line = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", ",", ".", ";"]) for _ in range(n))
    rows = [(i, "\n".join(line(rng.randrange(1, 200)) for _ in range(3))) for i in range(20)] + [(50, "x" * 900), (51, ""), (52, None), (53, "中文。" * 300)]
    got = segment.chunks(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", limit=120).orderBy("doc_id", "paragraph", "chunk").collect()
    assert all(r.chars <= 120 for r in got)
    for i, t in rows:
        assert "".join("".join(r.text.split()) for r in got if r.doc_id == i) == "".join((t or "").split())


def test_mask_round_trip(spark):
    texts = ["Use `x[1]` and $a+b$ at https://e.org/a?b, see [3,4] for 12.5 % of 7.", "@@0@@ literal @@ 5 @", "", "no spans", "@@@@ 3 @@1@@", "@NUM_1; is no mark, 5 is", "7", "5@x 6", "x@", "😀 9 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segment.mask(F.col("t")).alias("m")).select("t", "m", segment.unmask(F.col("m.masked"), F.col("m.tokens")).alias("back"))
    rows = df.collect()
    assert [r.back for r in rows] == texts and rows[0].m.masked == "Use @CODE_1; and @EQN_2; at @URL_3;, see @REF_4; for @NUM_5; of 7."
    assert rows[5].m.masked == "@-@TOK_1;; is no mark, @NUM_2; is" and rows[9].m.masked == "😀 @NUM_1;😀"
    types = spark.createDataFrame([(texts[0],)], "t string").select(segment.span_types(F.col("t"))).first()[0]
    assert types == {"CODE": 1, "EQN": 1, "URL": 1, "REF": 1, "NUM": 1}


def test_span_types_are_told_in_order(spark):
    want = {
        "`a 1`": "CODE", "$x_1$": "EQN", "$$x$$": "EQN", "\\(y\\)": "EQN", "\\[z 2\\]": "EQN", "https://a.b/c": "URL", "10.1234/ab.c-1": "URL", "[1, 2-4]": "REF", "(Doe and Row, 2019; Li et al., 2020a)": "REF", "（张三等，2019）": "REF",
        "图 3-1": "CAP", "表2": "CAP", "公式（2）": "EQN", "式(3)": "EQN", "(12)": "EQN", "3-5 kg": "NUM", "3.5~4 mm": "NUM", "12 min": "NUM", "1,000.5": "NUM", "50%": "NUM", "GPT-4": "TOK", "ResNet50": "TOK", "v1.2.3": "TOK", "MyName": "TOK", "AB-Z.2": "TOK", "（三）": "TOK",
    }
    text = " 并且 ".join(want)
    spans = spark.createDataFrame([(text,)], "t string").select(segment.protected(F.col("t")).alias("p")).first().p
    assert {s.text.strip(): s.type for s in spans} == want and all(text[s.start : s.stop] == s.text for s in spans)


def test_anchors_and_placeholders(spark):
    cases = [
        ("see MyName 5 now", ["now"], "see @TOK_1; @NUM_2; @FMT_3;", None), ("see MyName 5 now", ["MyName 5 now"], "see @FMT_1;", None), ("see `a b` now", ["a"], "see @CODE_1; now", None), ("one one", ["one"], None, "anchor_missing_or_ambiguous"),
        ("aaa", ["aa"], None, "anchor_missing_or_ambiguous"), ("x", ["y"], None, "anchor_missing_or_ambiguous"), ("see `a b` now", ["b` now"], None, "anchor_overlaps"), ("x y", ["x", "x"], None, "duplicate_anchors"), ("x y", [], "x y", None), ("x y", None, "x y", None), ("p q r", ["r", "p", ""], "@FMT_1; q @FMT_2;", None),
    ]
    df = spark.createDataFrame([(k, t, a) for k, (t, a, _, _) in enumerate(cases)], "k int, t string, a array<string>").select("k", "t", segment.with_anchors(F.col("t"), F.col("a")).alias("w"))
    df = df.select("k", "t", "w", segment.mask_spans(F.col("t"), F.col("w.spans")).alias("m")).select("*", segment.unmask(F.col("m.masked"), F.col("m.tokens")).alias("back"))
    for r, (t, _, masked, problem) in zip(df.orderBy("k").collect(), cases, strict=True):
        assert r.w.problem == problem and r.back == t and (masked is None or r.m.masked == masked), (r, masked)
    m = spark.createDataFrame([("a 1 b 2 c",)], "t string").select(segment.mask(F.col("t")).alias("m"))
    told = lambda out: m.select(segment.placeholder_problem(F.col("m.tokens"), F.lit(out))).first()[0]
    assert [told(x) for x in ("@NUM_1; @NUM_2;", "@NUM_1;", "@NUM_1; @NUM_2; @NUM_3;", "@NUM_1; @NUM_1; @NUM_2;", "@NUM_2; @NUM_1;", "")] == [None, "missing", "unknown", "duplicated", "reordered", "missing"]
    rows = [("x y z", "x then z", None), ("x x", "x", "invalid_source"), ("x z", "x", "removed"), ("x z", "x z z", "duplicated"), ("x z", "z x", "reordered")]
    got = spark.createDataFrame([(s, o) for s, o, _ in rows], "s string, o string").select(segment.anchor_problem(F.col("s"), F.col("o"), F.array(F.lit("x"), F.lit("z")))).collect()
    assert [r[0] for r in got] == [p for *_, p in rows]


def test_candidates_and_fold(spark):
    rows = [("a", "base", "baseline", 0, True, 1.0, 1.0), ("a", "m1", "model", 1, True, 0.9, 0.8), ("a", "m2", "model", 2, True, 0.9, 0.9), ("a", "m3", "model", 3, False, 0.1, 1.0), ("b", "base", "baseline", 0, True, 1.0, 1.0), ("b", "m1", "model", 1, True, 0.97, 1.0), ("c", "base", "baseline", 0, True, None, 1.0)]
    got = {r.k: (r.candidate_id, r.reason) for r in select.best_candidate(spark.createDataFrame(rows, "k string, candidate_id string, origin string, attempt int, eligible boolean, penalty double, retention double"), "k").collect()}
    assert got == {"a": ("m2", "penalty_improved"), "b": ("base", "no_measurable_gain"), "c": ("base", "no_eligible_candidate")}
    chunks = spark.createDataFrame([("x", i, g) for i, g in enumerate([2, 3, 1, -1, 1])] + [("y", 0, 1), ("y", 1, -1)], "doc string, pos int, growth long")
    taken = {(r.doc, r.pos): r.accepted for r in select.accept_in_order(chunks, "doc", "pos", "growth", 3).collect()}
    assert taken == {("x", 0): True, ("x", 1): False, ("x", 2): True, ("x", 3): True, ("x", 4): True, ("y", 0): True, ("y", 1): True}


def test_careful_sentences(spark):
    cases = [
        ("Dr. Smith met J. Doe. They left at 3. 5 people stayed.", ["Dr. Smith met J. Doe.", "They left at 3. 5 people stayed."]), ("See fig. 3 of v1.2. The rest follows.", ["See fig. 3 of v1.2. The rest follows."]),
        ('He said "stop." Then it ended. no capital.', ['He said "stop."', "Then it ended. no capital."]), ("一。二！“三？”四", ["一。", "二！", "“三？”", "四"]), ("", []), ("one", ["one"]),
    ]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(T.careful_sentences(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_json_payloads(spark):
    texts = ['say {"b": 1, "a": [2]} end', "none", None, '{"a": [1, 2,], // x\n "b": 3', "[1, {bad} 2] {\"ok\": true}"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(segment.json_payload("t")).collect()] == ['{"a":[2],"b":1}', None, None, '{"a":[1,2],"b":3}', '{"ok":true}']


RELATIONS = [
    ("same", "MySQL, RESTful and JSON are used respectively.", "MySQL, RESTful and JSON are used respectively.", []), ("order", "MySQL, RESTful and JSON are used respectively.", "JSON, RESTful and MySQL are used respectively.", ["entity_order_changed"]),
    ("swap", "MySQL feeds JSON.", "JSON comes from MySQL.", []), ("gone", "MySQL, RESTful and JSON are used.", "MySQL and JSON are used.", ["entity_order_changed"]), ("not", "It does not change the result.", "It changes the result.", ["negation_scope_removed"]),
    ("numbers", "Rates of 12, 15 and 18 were seen.", "Rates of 15, 12 and 18 were seen.", ["number_order_changed"]), ("value", "ResNet and BERT reach 91 and 88 respectively.", "ResNet and BERT reach 91 and 87 respectively.", ["number_order_changed", "entity_value_binding_missing_number"]),
    ("item", "ResNet and BERT reach 91 and 88 respectively.", "ResNet and others reach 91 and 88 respectively.", ["entity_order_changed", "entity_value_binding_missing_entity"]), ("scope", "All rows are read.", "Rows are read.", ["factual_scope_qualifier_changed"]),
    ("moved", "Only one.\n\nTwo.", "One.\n\nOnly two.", ["factual_scope_qualifier_changed"]), ("added", "It is fast.", "It is always fast.", ["factual_scope_qualifier_changed"]), ("both", "It is not only fast but small.", "It is not just fast but small.", []),
    ("channels", "X-1 与 Y-2 相连。", "Y-2 与 X-1 相连。", []), ("code", "Use `a,b` at https://e.org/a now with AB.", "With AB, use `a,b` at https://e.org/a now.", []), ("null", None, None, []),
]
SCOPES = [
    ("只有通过测试才能发布。", ["condition_necessary"]), ("只有一次。", ["exclusive_restriction"]), ("不仅如此，所有结果均有效，必然如此。", ["universal_totality", "universal_totality", "certainty_absolute"]),
    ("只要一次，只需两次。", ["condition_sufficient", "exclusive_requirement"]), ("一只船，仅在启动时运行，只身", ["condition_necessary"]), ("所有权，平均值", []), ("任何人仅仅看", ["universal_any", "exclusive_restriction"]),
    ("不只有 not only any", ["universal_any"]), ("仅在夜里才行", ["condition_necessary"]), ("不仅仅需，仅仅需", ["exclusive_restriction"]), ("Only all.", ["exclusive_restriction", "universal_totality"]),
]


def test_relations_and_scope(spark):
    df = spark.createDataFrame([(k, a, b) for k, a, b, _ in RELATIONS], "id string, input_text string, output_text string")
    assert {r.id: r.relation_issues for r in guards.relation_issues(df).collect()} == {k: want for k, _, _, want in RELATIONS}
    got = spark.createDataFrame([(t,) for t, _ in SCOPES], "t string").select(guards.scope_kinds(F.col("t"))).collect()
    assert [r[0] for r in got] == [want for _, want in SCOPES]
    profile = lambda t: guards.scope_profile(spark.createDataFrame([("d", t)], "id string, text string"), "id")
    a, b = profile("只有通过测试才能发布。\n\n不仅如此，所有结果均有效。"), profile("通过测试才能发布。\n\n不仅如此，所有结果均有效。只有一次。")
    assert {(r.paragraph, r.kind, r.n) for r in a.collect()} == {(0, "condition_necessary", 1), (1, "universal_totality", 2)}
    assert {(r.paragraph, r.kind, r.n_before, r.n_after) for r in guards.scope_changes(a, b, "id").collect()} == {(0, "condition_necessary", 1, 0), (1, "exclusive_restriction", 0, 1)}


def test_entities_of_equal_places(spark):
    """A metric in capitals is a technical name first; a phrase hides the names in it."""
    rows = [("AUC and 召回率 in The Big House, then Big House.", [("tech", "AUC"), ("metric", "召回率"), ("title", "Big House")]), ("", []), ("a", []), ("Deep Learning Net uses http://e.org/x.", [("title", "Deep Learning Net"), ("url", "http://e.org/x.")])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(guards.entity_spans(F.col("t"))).collect()
    assert [[(e.kind, e.term) for e in r[0]] for r in got] == [w for _, w in rows]


READABILITY = [
    ("kept", "系统更稳，结果挺好的。", "系统更稳，结果挺好的。", []), ("colloquial", "系统更稳定，结果较好。", "系统更稳，结果挺好的。", [0]), ("quoted", "甲。", "“说白了”甲。", []), ("dangling", "该方法依赖于数据。", "该方法依赖于，数据。", [2]),
    ("nominal", "甲。", "本文针对控制系统的误差研究。", [2]), ("bridged", "甲。", "本文针对控制系统进行误差研究。", []), ("chain", "甲。", "采用模型，分析数据，搭建平台，验证结果，提高精度，形成结论。", [3]),
    ("subject", "甲。", "本文采用模型，分析了数据，搭建平台，验证结果，提高精度。", []), ("vague", "甲。", "由此可见，效果好。", [4]), ("named", "甲。", "上述实验持续数日。由此可见，效果好。", []), ("far", "甲。", "上述实验" + "乙" * 80 + "由此可见", [4]),
    ("collocation", "甲", "适配系统要求", [1]), ("null", None, None, []), ("exchanged", "说白了，甲。", "挺好的，甲。", [0]),
]


def test_readability_delta(spark):
    df = spark.createDataFrame([(k, a, b) for k, a, b, _ in READABILITY], "id string, input_text string, output_text string")
    rows = {r.id: r for r in readability.delta(df).collect()}
    for k, _, _, want in READABILITY:
        assert rows[k].readability_issues == [readability.CODES[i] for i in want], k
    assert tuple(rows["exchanged"].readability[0])[1:] == (1, 1, 1, 1) and rows["chain"].readability[3].introduced == 3


CHAIN = [
    ("same", "1. 系统读取数据（李明等，2020）并写入 MySQL8 中。", "1. 系统读取数据（李明等，2020）并写入 MySQL8 中。", []), ("empty", "Some text.", " ", ["empty_output"]), ("paragraphs", "One part.\n\nOther part.", "One part. Other part.", ["paragraph_count_changed"]),
    ("breaks", "One part. Other part.", "One part.\n\nOther part.", ["paragraph_breaks_added"]), ("answer", "系统读取数据。", "改写后：系统读取数据。", ["answer_style"]), ("markdown", "One part.", "**One** part.", ["markdown_introduced"]), ("marker", "（1）读取", "（2）读取", ["leading_marker_changed"]),
    ("cited", "Seen before (Smith et al., 2020a; Doe, 1999).", "Seen before (Doe, 1999).", ["citations_removed", "citations_introduced"]), ("number", "It takes 7 rounds.", "It takes 8 rounds.", ["numbers_removed", "numbers_introduced"]), ("term", "It reads config.yaml by PyTorch 2.1 now.", "It reads a file now.", ["terms_removed"]),
    ("spacing", "The unit of the second probe reads one row in each new series.", "The unit ofthe second probe reads one row in each new series.", ["english_spacing_removed"]), ("order", "MySQL, RESTful and JSON are used.", "JSON, RESTful and MySQL are used.", ["entity_order_changed"]),
    ("long", "x" * 20, "x" * 240, ["expanded", "expanded_twice"]), ("english", "The unit reads one row in each new series, and the second probe reads a second row of it.", "The unit reads 系统读取数据并写入结果表中供后续分析使用和检查系统读取数据并写入结果表中", ["english_drift", "chinese_introduced"]),
    ("fragment", "系统读取数据并写入结果表中供后续分析使用和检查。", "系统读取数据并写入结果表中供后续分析使用和检查的", ["surface"]), ("null", None, None, ["empty_output"]),
]


def test_validator_chain(spark):
    rows = {r.id: r for r in validators.validate(spark.createDataFrame([(k, a, b) for k, a, b, _ in CHAIN], "id string, input_text string, output_text string")).collect()}
    for k, _, _, want in CHAIN:
        got = rows[k].codes
        assert [c for c in got if c in want] == want and (want or not got) and rows[k].first_code == (got[0] if got else None), (k, got)
    out = spark.createDataFrame([(["@1@", "@2@"], t) for t in ("@1@ @2@", "@1@", "@1@ @2@ @3@", "@1@ @2@ @2@", "@2@ @1@")], "e array<string>, t string")
    assert [r[0] for r in out.select(validators.placeholder_issue(F.col("e"), F.col("t"), r"@\d@")).collect()] == [None, "missing", "unknown", "duplicated", "reordered"]
    counts = spark.createDataFrame([("MySQL8 and MySQL8, AB.",)], "t string").select(validators.term_counts(F.col("t"))).first()[0]
    assert [tuple(c) for c in counts] == [("MySQL8", 2)]


def test_repetition_finds_what_brute_force_finds(spark):
    rng = random.Random(5)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lan", "mer")]
    base = [rng.sample(words, rng.randrange(8, 16)) for _ in range(6)]
    docs = [(d, "\n\n".join(" ".join(rng.sample(p, rng.randrange(max(5, len(p) - 3), len(p) + 1)) + rng.sample(words, rng.randrange(4))) for p in (rng.choice(base) for _ in range(9)))) for d in range(12)]
    same = " ".join(words[:9])
    docs += [(50, "\n\n".join([same] * 4)), (51, ""), (52, None), (53, same)]
    want, equal = set(), set()
    for d, t in docs:
        sets = [frozenset(p.split()) for p in (t or "").split("\n\n")]
        first = {s: sets.index(s) for s in sets}
        for i, x in enumerate(sets):
            if len(x) >= 8 and first[x] < i:
                equal.add((d, first[x], i))
            for j, y in enumerate(sets[:i]):
                if min(len(x), len(y)) >= 8 and x != y and first[x] == i and first[y] == j and len(x & y) >= 0.72 * min(len(x), len(y)):
                    want.add((d, j, i))
    got = [(r.d, r.left_unit, r.right_unit) for r in repetition.repeated(spark.createDataFrame(docs, "d int, text string"), "d").collect()]
    assert len(got) == len(set(got)) and set(got) == want | equal and len(want) > 20
    assert [r.d for r in repetition.introduced(spark.createDataFrame([(1, same)], "d int, text string"), spark.createDataFrame([(1, same + "\n\n" + same)], "d int, text string"), "d").collect()] == [1]


def test_scope_profile_reads_every_language(spark, tmp_path):
    """Against a count by hand: documents labelled zh, otherwise or not at all, and null texts."""
    rows = [(1, "en", "Only this. All of any."), (2, "zh", "只有通过测试才能发布。\n\n不仅如此，所有结果均有效，必然如此。只要一次。"), (3, None, "It is always so, only here."), (4, "fr", "任何人 only"), (5, "zh", None), (6, None, "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.kind: (r.documents, r.n) for r in text_queries.scope_profile(spark, str(tmp_path)).collect()}
    assert got == {"exclusive_restriction": (3, 3), "universal_totality": (2, 3), "universal_any": (2, 2), "condition_necessary": (1, 1), "certainty_absolute": (2, 2), "condition_sufficient": (1, 1)}


def test_history_and_events(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, ts int, v string")
    assert {(r.k, r.v) for r in history.latest(rows, "k", "ts").collect()} == {(1, "b"), (2, "c")}
    assert {r.k: r.next_round for r in history.next_round(rows, "k", "ts", 3).collect()} == {1: 2, 2: 1}
    assert len(history.page(rows, [F.col("ts")], 0, -5).collect()) == 1
    ev = spark.createDataFrame([("r", i, "x" if i % 3 else "error") for i in range(20)], "run string, id int, kind string")
    assert [r.id for r in events.buffer(ev, "run", "id", 3).orderBy("id").collect()] == [17, 18, 19]
    cur = spark.createDataFrame([("r", 5)], "run string, c int")
    assert {r.truncated for r in events.after_cursor(ev, "run", "id", cur, "c", 3).collect()} == {True}
    assert {r.truncated for r in events.after_cursor(ev, "run", "id", spark.createDataFrame([("r", 17)], "run string, c int"), "c", 3).collect()} == {False}
    runs = events.sections(spark.createDataFrame([("r", i, s) for i, s in enumerate("aabba")], "run string, id int, s string"), "run", "id", "s").orderBy("section").collect()
    assert [(r.s, r.n) for r in runs] == [("a", 2), ("b", 2), ("a", 1)]


def test_journal_and_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "c1", "old", "2024-01-01"), (1, "s", "c1", "new", "2024-01-02"), (1, "t", "c2", "x", "2024-01-01"), (2, "s", "c3", "y", "2024-01-01")], "version int, signature string, chunk_id string, output_text string, updated_at string")
    path = str(tmp_path / "journal")
    tables.append_journal(rows, path)
    (tmp_path / "journal" / "torn.json").write_text('{"version": 1, "signature": "s", "chunk_id": "c9", "output_te\n{"version": 1, "signature": "s", "chunk_id": "c4", "output_text": "z", "output_sha256": "0", "updated_at": "2024"}\n')
    got = tables.completed_chunks(tables.read_journal(spark, path), "s").collect()
    assert [(r.chunk_id, r.output_text) for r in got] == [("c1", "new")]
    (tmp_path / "t").mkdir()
    for name, raw in (("a.txt", b"same"), ("b.txt", b"same"), ("c.txt", b"\xff\xfe")):
        (tmp_path / "t" / name).write_bytes(raw)
    texts = tables.read_texts(spark, str(tmp_path / "t"))
    assert {r.path.rsplit("/", 1)[1]: r.valid for r in texts.collect()} == {"a.txt": True, "b.txt": True, "c.txt": False}
    assert sorted(r.n for r in tables.content_addressed(texts).collect()) == [1, 2]


def test_streams(spark, tmp_path):
    from textaudit.streaming import runs

    src = str(tmp_path / "in")
    data = spark.createDataFrame([("r", i, f"2024-01-01 00:{i:02d}:00", i % 4 < 2) for i in range(40)], "run_id string, event_id long, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    data.coalesce(1).write.parquet(src)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    stream = lambda: spark.readStream.schema(data.schema).parquet(src)
    cool = {r.event_id: (r.streak, r.cooldown) for r in run(runs.failure_cooldown(stream().drop("ts")), "append", "cooled")}
    assert cool[0] == (1, 3) and cool[1] == (2, 6) and cool[4] == (1, 3) and 2 not in cool
    counts = run(runs.rate_windows(stream(), "10 minutes", "5 minutes", "1 minute"), "append", "rated")
    assert counts and all(r.n <= 10 for r in counts)


def test_queries_and_sql_agree_in_name():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("text,limit", [("", 10), ("a", 10), ("word " * 50, 40)])
def test_pack_paragraph_bounds(text, limit):
    got = segment.pack_paragraph(text, limit, True)
    assert all(0 < len(x) <= limit for x in got) and "".join("".join(got).split()) == "".join(text.split())


def test_last_change_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame([(2, "late", 9), (2, "early", 1), (4, "new", 3)], "k long, v string, seq int")
    assert {(r.k, r.v) for r in history.upsert(base, changes, "k", "seq").collect()} == {(1, "a"), (2, "late"), (3, "c"), (4, "new")}


def test_multisets_are_counted(spark):
    rows = [(["b", "a", "b", "b"], ["b", "c"]), ([], ["x"]), (["x"], []), ([], [])]
    out = spark.createDataFrame(rows, "x array<string>, y array<string>").select(T.multiset_minus(F.col("x"), F.col("y")).alias("m"), T.multiset_shared(F.col("x"), F.col("y")).alias("n")).collect()
    assert [(r.m, r.n) for r in out] == [(["a", "b", "b"], 1), ([], 0), (["x"], 0), ([], 0)]


def test_full_width_numbers_and_not_only(spark):
    row = spark.createDataFrame([(1, "共１２ ％, 3.5 and １２", "It is not only fast, only here. Not  only so.")], "k long, a string, b string")
    assert row.select(T.numbers(F.col("a")).alias("n")).first().n == ["12%", "3.5", "12"]
    assert [(r.kind, r.n) for r in guards.scope_profile(row, "k", "b").collect()] == [("exclusive_restriction", 1)]


def test_ranking_holds_each_expression_once(spark):
    """A filter on the audit isn't pushed below the window with a second copy of it."""
    docs = spark.createDataFrame([(1, "k", "Some text. " * 9)], "doc_id long, lang string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert plan(audit.hotspots(docs, "lang", ["doc_id"])) <= plan(audit.audit(docs)) + 2


def test_records_become_rounds_and_references(spark):
    rows = [
        (" .\\docs\\a.txt", [(1, "p", "out/x.v1.txt", "out/x_compare.json", "2024-01-01"), (1, "p", "out/y.txt", None, "2024-01-02"), (2, "p", "", "", "2024-01-01"), None]), ("docs/a.txt", [(1, "p", "out/z.txt", None, "2023-01-01")]),
        ("", [(1, "p", "out/n.txt", None, "2024-01-01")]), ("docs/b.txt", None), (None, [(1, "p", "out/n.txt", None, "2024-01-01")]),
    ]
    df = spark.createDataFrame(rows, "doc string, rounds array<struct<number: int, profile: string, output_path: string, compare_path: string, ts: string>>")
    flat = records.flat_rounds(df, "doc", "rounds", ("number", "profile"), "ts")
    assert {(r.doc, r.number, r.output_path) for r in flat.collect()} == {("docs/a.txt", 1, "out/y.txt"), ("docs/a.txt", 2, "")}
    got = {(r.path, r.role) for r in records.artifact_refs(df.selectExpr("doc", "inline(rounds)").where("ts = '2024-01-01' and doc like ' %'"), ["doc"], ["output_path", "compare_path"], "output_path", "compare_path").collect()}
    assert len(got) == 19 and {("out/x.v1_quality.json", "derived_from_output"), ("finish/web_exports/x.v1_reviewed.docx", "derived_from_output"), ("out/x_compare_review_decisions.json", "review_decisions"), ("out/x.v1.txt", "output_path")} <= got
    paths = spark.createDataFrame([("a/b.c/d",), (".hidden",), ("a/.x",), ("n.tar.gz",)], "p string").select(records.stem(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["a/b.c/d", ".hidden", "a/.x", "n.tar"]


def test_top_phrases(spark):
    rows = [("a", "Moreover, it was seen there by many people. Furthermore they left. moreover it Further  improves nothing at all here."), ("a", "此外，系统运行。此外，结果写入。"), ("a", None), ("b", "")]
    got = phrases.top_counts(phrases.phrase_counts(spark.createDataFrame(rows, "k string, text string"), "k"), "k", "kind")
    assert {(r.k, r.kind, r.phrase, r.n, r["rank"]) for r in got.collect()} == {("a", "connector", "moreover", 2, 1), ("a", "connector", "此外", 2, 2)}


def test_terms_may_hold_any_mark(spark):
    """Names and URLs with backslashes, quotes of patterns and metacharacters are found as they stand, and no text kills a job."""
    marks = ["\\E", "\\Q", "\\E(", "$", "\\", "\\\\E\\Q", "[a-", "(?", "*+", "{2,1}", "|", "^", ")", "$0", "\\1"]
    terms = [f"http://a.example/x{m}y{m}" for m in marks] + marks
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    there = df.select("t", guards.contains_entity(F.concat(F.lit("see / "), F.col("t"), F.lit(" there")), F.col("t")).alias("y"), guards.contains_entity(F.lit("see / there"), F.col("t")).alias("n")).collect()
    assert all(r.y and not r.n for r in there), [r.t for r in there if not r.y or r.n]
    rng = random.Random(6)
    words = ["http://a.example/" + m + "x" for m in marks] + ["BERT-2", "LoRA-7", "respectively", "We", "compare", "and", "not only", "12%", "`code`", "accuracy", "."] + marks
    rows = [(k, " ".join(rng.choices(words, k=14)) + " respectively.", " ".join(rng.choices(words, k=14))) for k in range(150)] + [(200, "We compare http://a.example/\\E( and http://b.example/c and BERT-2 respectively.", "We compare http://b.example/c and http://a.example/\\E( and BERT-2 respectively.")]
    both = spark.createDataFrame(rows, "id int, input_text string, output_text string")
    codes = {r.id: r.relation_issues for r in guards.relation_issues(both).collect()}
    assert "entity_order_changed" in codes[200] and len(codes) == len(rows)
    same = both.withColumn("output_text", F.col("input_text"))
    assert validators.validate(both).count() == len(rows) and all(r.relation_issues == [] for r in guards.relation_issues(same).collect())
    assert all(r.codes is not None for r in validators.validate(both).select("codes").collect())


def test_words_written_as_one(spark):
    """Against a search of the whole revision for each pair of neighbouring words."""
    from textaudit.functions import guard_values as V

    def plain(a, b):
        if len(re.findall("[A-Za-z]+(?:[-'][A-Za-z]+)*", a)) < 5 or len(re.findall("[A-Za-z]", a)) < 25:
            return []
        found, words = [], list(re.finditer(V.SPACED_TOKEN, a))
        telling = lambda w: bool(re.search(r"[0-9._/-]|[a-z].*[A-Z]|[A-Z].*[a-z]", w))
        for x, y in zip(words, words[1:]):
            left, right, gap = x[0], y[0], a[x.end() : y.start()]
            mark = "".join(gap.split())
            if not re.search(r"\s", gap) or not (mark or telling(left) or telling(right) or left.lower() in V.GLUE_LEFT or right.lower() in V.GLUE_RIGHT) or max(len(left), len(right)) < 2:
                continue
            form = next((f for f in ((left + mark + right).lower(), (left + right).lower()) if len(f) >= 5 and f not in a.lower() and f in b.lower()), None)
            if form and form not in found:
                found.append(form)
        return found

    rng, rows = random.Random(1), []
    words, gaps = ["the", "a", "data", "set", "Model", "GPT-4", "of", "in", "row", "rows", "x2", "e.g", "table", "Fig", "and", "over-fit", "is"], [" "] * 5 + [", ", "-", " (", ") ", "; ", "/", "  ", "\n"]
    for k in range(300):
        w, g = [rng.choice(words) for _ in range(rng.randrange(2, 40))], [rng.choice(gaps) for _ in range(40)]
        other = [("" if rng.random() < 0.15 else y.replace(" ", "") if rng.random() < 0.1 else y) for y in g]
        rows.append((k, "".join(x + y for x, y in zip(w, g)), "".join(x + y for x, y in zip(w, other if k % 3 else g))))
    got = spark.createDataFrame(rows, "k int, a string, b string").select("a", "b", validators.run_together(F.col("a"), F.col("b")).alias("found")).collect()
    assert all(r.found == plain(r.a, r.b) for r in got) and sum(bool(r.found) for r in got) > 50


def test_containment_agrees_with_every_pair(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("row", "table", "key", "sum", "join", "sort") for b in "abcdefghij"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, text(rng.choice([5, 12, 30, 80]))) for k in range(120)] + [(500, None), (None, text(30)), (7, text(20))]
    queries = [(k, " ".join(rng.sample((texts[k][1] or "").split(), min(9, len(texts[k][1].split())))) + " " + text(rng.randrange(6))) for k in range(0, 60)] + [(100, text(90)), (101, "")]
    terms = lambda rows: {i: {w for j, t in rows if j == i for w in (t or "").split()} for i in {j for j, _ in rows if j is not None}}
    a, b = terms(texts), terms(queries)
    want = {(q, t, len(x & y), min(len(x), len(y))) for q, x in b.items() for t, y in a.items() if min(len(x), len(y)) >= 8 and len(x & y) >= 0.72 * min(len(x), len(y))}
    found = pairs.containment_search(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(queries, "j int, text string"), "i", "j")
    assert {tuple(r) for r in found.collect()} == want and len(want) > 40
