"""Merged manifests and their way back, against plain loops; properties on random texts."""

import random
import re

from pyspark.sql import functions as F

from textaudit.functions import text as T
from textaudit.operators import manifest as M

RNG = random.Random(5)
PIECES = ["摘要", "关键词：行", "Abstract", "Key words: rows", "图 1 结构", "表2：数据", "1.2 Methods of rows", "第三章 系统", "参考文献", "致 谢", "A short line of the text.", "这一段是中文，并且有句号。", "Rows are read one by one, and then they are kept for a while; nothing is lost.", "x" * 120, "word " * 30 + "end.", "短。"]


def brute(paragraphs, languages, limit, most):
    out = []
    for i, (p, lang) in enumerate(zip(paragraphs, languages, strict=True)):
        alone = "standalone-paragraph" if len(p) <= 80 and any(re.match(h, p, re.IGNORECASE) for h in M.HEADINGS) else "oversized-paragraph" if len(p) > limit else None
        last = out[-1] if out else None
        if last and not alone and not last["alone"] and last["lang"] == lang and len(last["parts"]) < most and len("\n\n".join([*last["parts"], p])) <= limit:
            last["parts"].append(p)
        else:
            out.append({"first": i, "parts": [p], "lang": lang, "alone": alone})
    return [(c["first"], c["first"] + len(c["parts"]) - 1, c["alone"] or ("paragraph-kept" if len(c["parts"]) == 1 else "merged-short-paragraphs"), [len(p) for p in c["parts"]], "\n\n".join(c["parts"])) for c in out]


def plain_cut(output, lengths):
    whole, n = output.strip(), len(lengths)
    pieces = [p.strip() for p in re.split(r"\n\s*\n", whole) if p.strip()]
    if n == 1:
        return [whole]
    if len(pieces) >= n:
        return [*pieces[: n - 1], "\n\n".join(pieces[n - 1 :])]
    total, at, out = sum(max(1, x) for x in lengths), 0, []
    for k, x in enumerate(lengths[:-1]):
        left = n - k
        if len(whole) - at <= left:
            end = len(whole)
        else:
            least, most = at + 1, len(whole) - (left - 1)
            to = max(least, min(most, at + round(len(whole) * max(1, x) / total)))

            def kind(i):
                a, b = whole[i - 1], whole[i : i + 1]
                word = lambda c: c.isascii() and c.isalnum()
                return 0 if a in "。！？；：.!?;:" else 1 if a in "，、, \t\r\n" or (b and b in "，、, \t\r\n") else 3 if word(a) and b and word(b) else 2

            places = [(kind(i), abs(i - to), i) for i in range(max(least, to - M.NEAR), min(most, to + M.NEAR) + 1)]
            end = min(places)[2] if places and min(places)[0] < 3 else to
        out.append(whole[at:end].strip())
        at = end
    return [*out, whole[at:].strip()]


def test_manifest_agrees_with_a_loop(spark):
    texts = ["\n\n".join(RNG.choice(PIECES) for _ in range(RNG.randrange(0, 12))) for _ in range(120)] + [None, "", " \n\n ", "one\r\n\r\ntwo"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    cut = {r.k: (r.p, r.l) for r in df.select("k", T.paragraphs(T.unix_lines(F.coalesce("text", F.lit("")))).alias("p")).select("k", "p", F.transform("p", T.language).alias("l")).collect()}
    for limit, most in ((850, 4), (150, 2)):
        got = {}
        for r in M.merged_manifest(df, "k", limit=limit, most=most).orderBy("k", "chunk").collect():
            got.setdefault(r.k, []).append((r["first"], r["last"], r.reason, r.lengths, r.text))
            assert r.chunk_id == (f"p{r['first']}_c0" if r["first"] == r["last"] else f"p{r['first']}_p{r['last']}_c0")
        assert got == {k: b for k, (p, lang) in cut.items() if (b := brute(p, lang, limit, most))}
    # unchanged chunks, or chunks without an output, give the paragraphs again
    m = M.merged_manifest(df, "k")
    for outputs in (m.select("k", "chunk_id", F.col("text").alias("output_text")), m.where("false").select("k", "chunk_id", F.col("text").alias("output_text"))):
        back = {}
        for r in M.restored(m, outputs, "k").orderBy("k", "paragraph").collect():
            back.setdefault(r.k, []).append(r.text)
        assert back == {k: p for k, (p, _) in cut.items() if p}


def test_revised_chunks_come_back_in_as_many_parts(spark):
    rows = [("One short sentence. A second, longer sentence follows it. End.", [20, 38, 4]), ("abc", [1, 1, 1, 1, 1]), ("", [3, 4]), ("a\n\nb\n\nc", [1, 1]), ("a\n\nb", [1, 1]), ("x" * 400, [10, 30]), ("一二三四五六七八九十" * 30, [5, 5, 5]), ("  padded text  ", [4]), ("ab cd", [0, 0])]
    for _ in range(300):
        t = "".join(RNG.choice(["word", "字", ".", "。", ", ", " ", "\n", "x9", "-"]) for _ in range(RNG.randrange(0, 300)))
        rows.append((t, [RNG.randrange(0, 90) for _ in range(RNG.randrange(1, 5))]))
    got = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(rows)], "k int, t string, n array<int>").select("k", M.cut_back(F.col("t"), F.col("n")).alias("parts")).orderBy("k").collect()
    for (t, n), r in zip(rows, got, strict=True):
        assert r.parts == plain_cut(t, n), (t, n)
        assert len(r.parts) == len(n) and "".join("".join(r.parts).split()) == "".join(t.split())


def test_best_cut_is_the_one_that_a_look_at_each_place_finds(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("aB9 ,.;。、中😀\n-"[: rng.randrange(2, 15)]) if rng.random() < 0.2 else rng.choice("abc中") for _ in range(400)), rng.randrange(1, 390)) for _ in range(300)]

    def best(t, ideal):
        def kind(i):
            a, b = t[i - 1], t[i : i + 1]
            word = lambda c: c.isascii() and c.isalnum()
            return 0 if a in "。！？；：.!?;:" else 1 if a in "，、, \t\r\n" or b in "，、, \t\r\n" else 3 if word(a) and word(b) else 2

        to = max(5, min(395, ideal))
        k, _, at = min((kind(i), abs(i - to), i) for i in range(max(5, to - M.NEAR), min(395, to + M.NEAR) + 1))
        return at if k < 3 else to

    got = spark.createDataFrame(rows, "t string, ideal int").select("t", "ideal", M._best_cut(F.col("t"), F.col("ideal"), F.lit(5), F.lit(395)).alias("at"))
    # every place of a window was cut out and matched by itself before
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.t, r.at) for r in got.collect()] == [(t, best(t, i)) for t, i in rows]
