"""Source-relative deltas against a plain scan of characters, and evidence that is whole, torn or tampered with."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T
from textaudit.operators import deltas, pairs

CLOSERS, OPENERS, HARD = set("\"'”’)]）】》"), set("\"'“‘([（"), set("。！？!?；;")


def scan(text):
    """Sentences by one walk over the characters."""
    t = " ".join((text or "").split())
    cuts, at = [0], 0
    while at < len(t):
        end = at + 1
        while end < len(t) and t[end] in CLOSERS:
            end += 1
        if t[at] in HARD or (t[at] == "." and stops(t, at, end)):
            cuts.append(end)
            at = end
        else:
            at += 1
    return [s for s in (t[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True)) if s]


def stops(t, at, end):
    if end == len(t):
        return True
    if t[end] != " ":
        return False
    rest = t[end:].lstrip()
    word, token = re.search("[A-Za-z]*$", t[:at])[0], re.search("[A-Za-z0-9_.-]*$", t[:at])[0]
    if (t[:at][-1:].isdigit() and rest[0].isdigit()) or word.lower() in L.ABBREVIATIONS or len(word) == 1 or ("." in token and any(c.isdigit() for c in token)):
        return False
    first = next((c for c in rest if c not in OPENERS), None)
    return first is None or first.isupper() or first.isdigit() or "㐀" <= first <= "䶿" or "一" <= first <= "鿿"


def core(s):
    s = re.sub(L.CORE_MARKER, "", s.strip().strip("“”‘’\"' "))
    return s.lstrip("，,、：:；;。.!！？?")


def english(s):
    return len(re.findall("[A-Za-z]+(?:[-'][A-Za-z]+)*", s)) >= 4 and len(re.findall("[㐀-䶿一-鿿]", s)) <= 2


def family(c):
    for name, pattern in L.OPENINGS_EN if english(c) else L.OPENINGS_ZH:
        if re.search(pattern, c):
            return name
    return "en.plain" if english(c) else "cn.plain"


def frame(s):
    c = core(s)
    m = re.sub(r"@\d+;", " TOKEN ", c)
    m = re.sub(r"(?i)https?://\S+", " URL ", m)
    m = re.sub(r"\d+(?:[.,]\d+)*(?:\.\d+)?", " NUMBER ", re.sub(r"`[^`\n]+`", " CODE ", m))
    size = len(re.sub(r"\s+", "", c))
    n = lambda p, most: min(len(re.findall(p, m, flags=re.IGNORECASE)), most)
    data = {
        "language": "en" if english(c) else "zh", "openingFamily": family(core(c)), "commaBucket": n("[，,]", 4), "semicolonBucket": n("[；;]", 3), "colonBucket": n("[：:]", 2),
        "conjunctionBucket": n(rf"{L.CONJUNCTION_ZH}|\b(?:{L.CONJUNCTION_EN})\b", 4), "lengthBucket": "short" if size <= 12 else "medium" if size <= 32 else "long" if size <= 64 else "very_long",
    }
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


WORDS = ["The", "the", "we", "We", "If", "However", "rows", "Dr", "Fig", "No", "e.g", "v1.2", "3", "4.5", "U.S", "and", "but", "x", "数据", "系统被写入", "因此", "本文", "and，", "`a, b`", "http://a.b/c,d", "@3;", "(1)", "第三章", "“Quoted", "end”", "état"]
MARKS = [".", ". ", "。", "! ", "? ", "；", ", ", " ", " ", " ", "\n", '." ', ".) ", "：", ".. "]


def random_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(MARKS) for _ in range(n))


def test_sentences_openings_and_frames_agree_with_a_scan(spark):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randrange(1, 40)) for _ in range(500)] + ["", " \n ", "No. 5 is. No", "It ended (in May.) Then it rained. (Twice.) 3. 4", "See Fig. 3. Dr. Who came at 3. 5 left.", "a. B. c", "He said “Stop.” Then “Go.”", "One. “", "。。", "x" * 3000 + ". Y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.careful_sentences(F.col("t")).alias("s"), deltas.sentence_facts(F.col("t")).alias("f")).collect()
    for t, r in zip(texts, got, strict=True):
        want = scan(t)
        assert r.s == want, t
        assert [tuple(f) for f in r.f] == [(family(core(s)), frame(s), len(re.sub(r"\s+", "", s))) for s in want], t


def counts(text):
    s = scan(text)
    return {"opening": Counter(family(core(x)) for x in s), "skeleton": Counter(frame(x) for x in s)}


def brute(rows):
    """(doc, chunk) -> rows of both kinds, boundary facts and codes."""
    whole = defaultdict(lambda: {"opening": Counter(), "skeleton": Counter()})
    for d, _, a, _ in rows:
        for k, c in counts(a).items():
            whole[d][k] += c
    out = {}
    for d, n, a, b in rows:
        before, after, grown, codes, seen = counts(a), counts(b), {}, [], []
        for k, code, advice in deltas.KINDS:
            grown[k], block = [], 0
            for p in sorted(after[k]):
                x, y, doc = before[k][p], after[k][p], whole[d][k][p]
                if y > x:
                    then = max(0, doc - x) + y
                    grown[k].append((p, x, y, y - x, doc, then, max(0, then - doc)))
                    block += (y >= 3 and y - x >= 2) or (then >= 4 and then - doc >= 2)
            codes += [code] * bool(block)
            seen += [advice] * bool(grown[k] and not block)
        size = lambda t: [len(re.sub(r"\s+", "", s)) for s in scan(t)]
        x, y = size(a), size(b)
        if len(x) >= 4 and len(x) - len(y) >= 3 and len(y) <= max(1, -(-len(x) // 2)) and sum(y) / max(len(y), 1) >= max(36.0, sum(x) / len(x) * 1.45):
            codes.append(deltas.COLLAPSED)
        if len(y) >= 5 and sum(s <= 6 for s in y) - sum(s <= 6 for s in x) >= 2 and sum(s <= 6 for s in y) / len(y) >= 0.25:
            codes.append(deltas.FRAGMENTED)
        out[d, n] = grown, codes, seen
    return out


def cases():
    rng = random.Random(9)
    rows = [(f"d{d}", n, random_text(rng, 25), random_text(rng, 25)) for d in range(12) for n in range(5)]
    one = "However, the rows go in. "
    rows += [("same", 0, one * 4, one * 4), ("opening", 0, "Rows go in. Rows come out. Rows stay here for now.", one * 3), ("null", 0, None, None), ("null", 1, "", " \n"), ("null", 2, None, one)]
    rows += [("collapse", 0, "The first row is here. The second row is here. The third row is here. The fourth row is here.", "The first row and the second row and the third row and the fourth row are all of them here now.")]
    rows += [("fragments", 0, "The rows are read one by one. They are kept for a while.", "Rows. Read. Kept. One by one they are read. They are kept for quite a while.")]
    rows += [("slow", n, "The rows go in." if n else "However, all of the rows go in.", one) for n in range(5)]  # one more in each chunk: only the document sees it
    rows += [("中文", 0, "数据由系统读取。结果写入表中。程序随后结束。", "因此数据被读取。因此结果被写入。因此程序结束。因此任务完成。"), ("many", 0, "x", " ".join(random_text(rng, 12) for _ in range(30)))]
    return rows


@pytest.fixture(scope="module")
def both(spark):
    df = spark.createDataFrame(cases(), "doc string, chunk int, input_text string, output_text string")
    return df, deltas.style_delta(df, "doc", "chunk").cache()


def test_chunks_and_documents_agree_with_brute_force(spark, both):
    df, evidence = both
    want, got = brute(cases()), {(r.doc, r.chunk): r for r in evidence.collect()}
    assert set(got) == set(want)
    for key, (grown, codes, seen) in want.items():
        r = got[key]
        assert (r.blocking_codes, r.advisory_codes, r.passed) == (codes, seen, not codes), key
        for k in ("opening", "skeleton"):
            assert [tuple(x) for x in r[k].patterns] == grown[k][:12] and r[k].introduced == len(grown[k]) and r[k].max_after == max([x[5] for x in grown[k]], default=0), (key, k)
    codes_of = lambda d: {c for (doc, _), r in got.items() if doc == d for c in r.blocking_codes}
    assert not codes_of("same") and not codes_of("slow") and deltas.REPEATED_OPENING in codes_of("opening") & codes_of("中文")
    assert codes_of("collapse") >= {deltas.COLLAPSED} and codes_of("fragments") >= {deltas.FRAGMENTED} and not codes_of("null")
    assert max(r.skeleton.introduced for r in got.values()) > 12  # more than evidence lists

    whole = {r.doc: r for r in deltas.document_delta(df, "doc", "chunk").collect()}
    sums = defaultdict(lambda: [{"opening": Counter(), "skeleton": Counter()} for _ in range(2)])
    for d, _, a, b in cases():
        for side, t in enumerate((a, b)):
            for k, c in counts(t).items():
                sums[d][side][k] += c
    for d, (x, y) in sums.items():
        for k, code, _ in deltas.KINDS:
            grown = [(p, x[k][p], y[k][p], y[k][p] - x[k][p]) for p in sorted(y[k]) if y[k][p] > x[k][p]]
            assert [tuple(r) for r in whole[d][k].patterns] == grown[:24] and whole[d][k].introduced == len(grown)
            assert (code in whole[d].blocking_codes) == any(g[2] >= 4 for g in grown)
    assert deltas.REPEATED_OPENING in whole["slow"].blocking_codes and whole["same"].passed and whole["null"].chunks == 3
    local = {(r.doc, r.chunk): r for r in deltas.style_delta(df, "doc", "chunk", document=False).collect()}
    assert all(r.source_profile_sha256 == "" and r.scope == "local" and all(p.document_after is None for p in r.opening.patterns) for r in local.values())
    assert deltas.broken(deltas.style_delta(df, "doc", "chunk", document=False), "doc", "chunk").where("broken is not null").count() == 0
    assert deltas.style_delta(df.where("false"), "doc", "chunk").count() == 0 and deltas.document_delta(df.where("false"), "doc", "chunk").count() == 0


def test_profiles_are_additive_and_need_no_order(spark, both):
    df, _ = both
    parts = deltas.chunk_patterns(df, ["doc", "chunk"])
    once = {r.doc: r for r in deltas.profiles(deltas.merged(parts, ["doc"]), df, "doc").collect()}
    again = {r.doc: r.profile_sha256 for r in deltas.profiles(deltas.merged(deltas.merged(parts.repartition(7), ["doc", "chunk"]), ["doc"]), df.orderBy(F.desc("chunk")), "doc").collect()}
    assert {d: r.profile_sha256 for d, r in once.items()} == again and len(set(again.values())) == len(again)
    for d, r in once.items():
        texts = [a for doc, _, a, _ in cases() if doc == d]
        for k, mine in (("opening", r.openings), ("skeleton", r.skeletons)):
            total = sum((counts(t)[k] for t in texts), Counter())
            assert [tuple(x) for x in mine] == sorted(total.items(), key=lambda x: (-x[1], x[0]))
        assert (r.chunks, r.sentences) == (sum(bool((t or "").strip()) for t in texts), sum(len(scan(t)) for t in texts))
    growth = pairs.pattern_growth(pairs.pattern_profile(df.select("doc", F.col("input_text").alias("text")), "doc"), pairs.pattern_profile(df.select("doc", F.col("output_text").alias("text")), "doc"), "doc")
    assert growth.where("doc = 'slow' and kind = 'opening' and growth = 4 and blocks").count() == 1


TAMPER = {
    "torn": {"opening": "null", "scope": "null", "passed": "null"}, "binding": {"baseline_sha256": "upper(candidate_sha256) || 'Z'"}, "scope": {"scope": "'other'", "source_profile_sha256": "''"},
    "boundary": {"boundary": "named_struct('n_in', boundary.n_in, 'n_out', boundary.n_out, 'short_in', boundary.n_in + 1, 'short_out', boundary.short_out, 'fewer', boundary.fewer, 'more_short', boundary.more_short, 'collapsed', boundary.collapsed, 'fragmented', boundary.fragmented)"},
    "codes": {"advisory_codes": "array('x')", "blocking_codes": "array_append(blocking_codes, 'y')"}, "passed": {"passed": "not passed"}, "digest": {"candidate_sha256": "baseline_sha256"},
}
SUMMARY = {
    "counts": ("introduced", "introduced + 1"), "maxima": ("max_introduced", "max_introduced + 1"), "blocking": ("blocking", "case when blocking > 0 then blocking - 1 else blocking + 1 end"),
    "order": ("patterns", "reverse(patterns)"), "rows": ("patterns", "transform(patterns, r -> named_struct('pattern', r.pattern, 'n_in', r.n_in, 'n_out', r.n_out + 1, 'introduced', r.introduced, 'document_before', r.document_before, 'document_after', r.document_after, 'document_introduced', r.document_introduced))"),
    "document_counts": ("patterns", "transform(patterns, r -> named_struct('pattern', r.pattern, 'n_in', r.n_in, 'n_out', r.n_out, 'introduced', r.introduced, 'document_before', r.document_before + 1, 'document_after', r.document_after, 'document_introduced', r.document_introduced))"),
}


def test_tampered_and_torn_evidence_is_found(spark, both):
    df, evidence = both
    assert deltas.broken(evidence, "doc", "chunk").where("broken is not null").count() == 0
    for name, fields in TAMPER.items():
        for column, value in fields.items():
            bad = evidence.where("candidate_sha256 <> baseline_sha256").withColumn(column, F.expr(value).cast(evidence.schema[column].dataType))
            assert {r.broken for r in deltas.broken(bad, "doc", "chunk").collect()} == {name}, (name, column)
    listed = evidence.where("skeleton.introduced between 2 and 11 and skeleton.max_introduced >= 1")
    for name, (field, value) in SUMMARY.items():
        parts = ", ".join(f"'{f}', {re.sub(r'(?<![.])' + field, 'skeleton.' + field, value) if f == field else 'skeleton.' + f}" for f in ("introduced", "blocking", "max_introduced", "max_after", "patterns"))
        bad = listed.withColumn("skeleton", F.expr(f"named_struct({parts})").cast(evidence.schema["skeleton"].dataType))
        assert {r.broken for r in deltas.broken(bad, "doc", "chunk").collect()} == {f"skeleton_{name}"}, name
    # a row that is consistent again but not what was sealed is found by its digest
    other = evidence.withColumns({"doc": F.concat("doc", F.lit("x"))})
    assert {r.broken for r in deltas.broken(other, "doc", "chunk").collect()} == {"digest"}
    whole = deltas.document_delta(df, "doc", "chunk").cache()
    assert deltas.broken_document(whole, "doc").where("broken is not null").count() == 0
    for column, value, name in (("chunks", "-1L", "chunks"), ("result_chunks_sha256", "'no'", "binding"), ("baseline_chunks_sha256", "result_chunks_sha256", "digest"), ("advisory_codes", "array('x')", "codes"), ("skeleton", "null", "torn")):
        bad = whole.where("baseline_chunks_sha256 <> result_chunks_sha256").withColumn(column, F.expr(value).cast(whole.schema[column].dataType))
        assert {r.broken for r in deltas.broken_document(bad, "doc").collect()} == {name}, column


def brute_arbitration(rows):
    """In order, chunk by chunk, over counters of the whole document."""
    out, docs = {}, defaultdict(list)
    for d, n, a, b in rows:
        docs[d].append((n, counts(a), counts(b)))
    for d, chunks in docs.items():
        base = {k: sum((a[k] for _, a, _ in chunks), Counter()) for k, *_ in deltas.KINDS}

        def over(state, base=base):
            return [code for k, code, _ in deltas.KINDS if any(v >= 4 and v - base[k][p] >= 1 for p, v in state[k].items())]

        whole = {k: sum((b[k] for _, _, b in chunks), Counter()) for k, *_ in deltas.KINDS}
        now, fine = {k: Counter(v) for k, v in base.items()}, not over(whole)
        for n, a, b in sorted(chunks, key=lambda c: c[0]):
            trial = {k: Counter(v) for k, v in now.items()}
            for k in trial:
                trial[k].subtract(a[k])
                trial[k].update(b[k])
            codes = [] if fine else over(trial)
            now = now if codes else trial
            out[d, n] = (not codes, codes)
    return out


def test_arbitration_agrees_with_a_walk(spark):
    rng = random.Random(2)
    short = ["However, it rains now.", "We see the rows come in.", "The rows go out again, then.", "因此数据被读取。", "Rows, and more rows, and yet more rows."]
    text = lambda: " ".join(rng.choice(short) for _ in range(rng.randrange(3)))
    rows = [("long", n, random_text(rng, 6), random_text(rng, 6)) for n in range(200)] + [(f"d{d}", n, text(), text()) for d in range(25) for n in range(rng.randrange(1, 9))]
    move = "However, it rains now. " * 4
    rows += [("moved", 0, "", move), ("moved", 1, move, ""), ("one", 0, None, move), ("one", 1, "", "We see the rows come in."), ("one", 2, "", "However, it rains now."), ("empty", 0, None, None)]
    df = spark.createDataFrame(rows, "doc string, chunk int, input_text string, output_text string").repartition(5)
    got = {(r.doc, r.chunk): (r.accepted, r.codes) for r in deltas.arbitrate(df, "doc", "chunk").collect()}
    want = brute_arbitration(rows)
    assert got == want and 0 < sum(not a for (d, _), (a, _) in got.items() if d == "long") < 200
    assert got["moved", 0][0] and not got["one", 0][0] and got["one", 2][0]
    assert deltas.arbitrate(df.where("false"), "doc", "chunk").count() == 0
