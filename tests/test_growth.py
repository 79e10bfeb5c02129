"""What must grow no faster than the text, and SQL that must state the query's rule on odd characters."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T
from textaudit.operators import guards, pairs, records, repetition, segment, validators
from textaudit.plans import relational_queries, text_queries


def test_mask_round_trip_of_many_spans_in_one_text(spark):
    # 1,500 spans took the cube of their number before
    text = " ".join(f"x@z $a_{i}$" for i in range(1500)) + " @EQN_7; `"
    spark.createDataFrame([(text,)], "text string").select(segment.mask(F.col("text"))["masked"]).collect()
    began = time.time()
    m = spark.createDataFrame([(text,)], "text string").select("text", segment.mask(F.col("text")).alias("m"))
    r = m.select(segment.unmask(F.col("m.masked"), F.col("m.tokens")).alias("back"), F.size("m.tokens").alias("n"), segment.unmask(F.concat(F.lit("@EQN_9999999999; @URL_1;"), "m.masked"), F.col("m.tokens")).alias("more")).first()
    assert (r.back, r.n) == (text, 1501) and r.more == "@EQN_9999999999; @URL_1;" + text
    assert time.time() - began < 60
    moved = m.select(segment.unmask(F.lit("a @EQN_2; b @EQN_1;"), F.reverse(F.slice("m.tokens", 1, 2))).alias("t"), segment.unmask(F.lit("@-EQN_1;"), F.col("m.tokens")).alias("u")).first()
    assert moved.t == "a $a_1$ b $a_0$" and moved.u == "@EQN_1;"


@pytest.mark.parametrize("text", ["Noñboos no", "ciónno éno noé", "x是not的 not", "未来未知未不得不仅不但未", "can't can'tx xcan't can'tno don't'no", "ISN'T wıthout İsn't K", "nó no", "\x01no\x02 \x02'\x01", "并未来 尚未知 不不得不", "no_ no-no no1"])
def test_negation_sql_has_the_querys_word_boundaries(spark, tmp_path, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", "a"), (1, 2, "user", text)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in text_queries.negation_loss(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(text_queries.NEGATION_SQL).fetchall()) == got


def test_patterns_found_once_are_those_found_apart(spark):
    odd = ["Based on A, b: c; d", "1. However we if And but 3.5 https://x.y `a` @EQN_2;", "并且因此IF a b c d 中中中", "ıf a because ſ İf x WHILE", "", "“(1) 2. first a b c", "this paper, and:,;，；", "第一章 在系统中，a", "\"a b c d\"\n", "if_ andé éand", " 'x\u2028", "a\u3000b-c d'e f"]
    x = F.col("s")
    plain = F.regexp_replace(F.regexp_replace(F.trim(x), r"^[“”‘’\"' ]+", ""), r"[“”‘’\"' ]+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, L.CORE_MARKER, ""), r"^[，,、：:；;。.!！？?]+", "")
    both = spark.createDataFrame([(t,) for t in odd], "s string").select(
        T.sentence_patterns(x).alias("p"), T.opening_family(x).alias("o"), T.skeleton(x).alias("k"), T.sentence_core(x).alias("c"), plain.alias("plain"), T.solid_length(x).alias("n"), F.length(F.regexp_replace(x, r"(?U)\s+", "")).alias("m"),
        T.english_core(x).alias("e"), ((T.latin_words(x) >= 4) & (T.cjk_chars(x) <= 2)).alias("f"),
        T.count_of(x, T.CONJUNCTION).alias("a"), T.count_of(x, f"(?U){L.CONJUNCTION_ZH}|(?i:\\b(?:{L.CONJUNCTION_EN})\\b)").alias("b"),
    )
    for r in both.collect():
        assert (r.p.opening, r.p.skeleton, r.c, r.n, r.e, r.a) == (r.o, r.k, r.plain, r.m, r.f, r.b), r


def test_repetition_shuffles_a_text_once(spark):
    # every (text, unit, term) was shuffled several times before, and terms were found anew for each
    text = "\n\n".join(["alpha beta gamma delta epsilon zeta theta kappa"] * 3)
    r = repetition.repeated(spark.createDataFrame([(1, text), (None, text)], "k long, text string"), "k")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan
    # as in the SQL, null keys take no part; rows that share a key are one text
    assert sorted((x.k, x.left_unit, x.right_unit, x.shared, x.least_terms) for x in r.collect()) == [(1, 0, 1, 8, 8), (1, 0, 2, 8, 8)]
    both = repetition.repeated(spark.createDataFrame([(1, "ignored words here\n\n" + text[:47]), (1, text[:47])], "k long, text string"), "k")
    assert [(x.left_unit, x.right_unit) for x in both.collect()] == [(0, 1)]


def test_repetition_in_many_blocks_is_the_same(spark, monkeypatch):
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lan", "mer")]
    texts = [("\n\n".join(" ".join(words[(i * k) % 9 : (i * k) % 9 + 8 + i % 5]) for i in range(30)),) for k in range(1, 6)]
    df = spark.createDataFrame(texts, "text string").select(repetition.F.monotonically_increasing_id().alias("k"), "text")
    batch = [df.select("k", "text").transform(lambda d: repetition.units(d, "k")).groupBy("k").agg(F.collect_list(F.struct("unit", "terms")).alias("u")).select("k", "u.unit", "u.terms").toArrow()]
    rows = lambda: sorted(r for b in batch for x in repetition._pairs(0.72)(b.combine_chunks().to_batches()) for r in zip(*x.to_pydict().values(), strict=True))
    whole = rows()
    monkeypatch.setattr(repetition, "SLICE_TERMS", 300)
    monkeypatch.setattr(repetition, "LOOKUPS", 640)
    assert rows() == whole and len(whole) > 100 and len(set(whole)) == len(whole)


@pytest.mark.parametrize("checked, codes", [(validators.validate, "codes"), (guards.relation_issues, "relation_issues")])
def test_a_filter_on_codes_does_not_find_them_again(spark, checked, codes):
    # the filter was pushed below the codes, with all of their expressions in it
    df = spark.createDataFrame([(1, "ABC2 and DEF3 have 4 and 5 respectively.", "DEF3 and ABC2 have 5 and 4 respectively."), (2, "a", "a"), (3, None, None)], "k int, input_text string, output_text string")
    out = checked(df).where(F.size(codes) > 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp" in x.lower() or "rlike" in x.lower() for x in plan.splitlines() if "Filter" in x.split("(")[0])
    got = {r.k: r[codes] for r in out.collect()}
    assert got[1][:2] == ["entity_order_changed", "number_order_changed"] and 2 not in got and got.get(3) == (["empty_output"] if codes == "codes" else None)


def test_references_are_counted_by_hash_before_their_ends_are_found(spark, tmp_path):
    # a distinct count beside the ends sorted every reference by its path
    spark.sql("select id % 3 as o_custkey, date'2024-01-01' + cast(id % 40 as int) as o_orderdate, 'p' as o_orderpriority, id as o_orderkey from range(50)").write.parquet(f"{tmp_path}/orders.parquet")
    out = relational_queries.derived_refs(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("HashAggregate(keys=[role" in x.replace("derived#", "") and "path" in x.split("functions")[0] and "Sort" not in x.split("HashAggregate")[0] for x in plan.splitlines())
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.execute(relational_queries.REFS_SQL).fetchall())
    odd = spark.createDataFrame([(1, " ./a//b.txt "), (2, "http://x//y.d/z"), (3, "\\\\s\\t"), (4, "././ "), (5, None), (6, ":///q")], "k int, p string")
    assert [r.p for r in odd.orderBy("k").select(records.normal_path(F.col("p")).alias("p")).collect()] == ["a/b.txt", "http://x/y.d/z", "/s/t", None, None, "://q"]


def test_overlap_search_finds_the_terms_of_a_text_once(spark):
    # they were found for each step that reads them; rows that share an id are one text, whatever their number
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    alone = [(i, " ".join(words[i : i + 10 + i])) for i in range(20)] + [(None, " ".join(words)), (90, None), (91, "few")]
    shared = [(95, " ".join(words[k : k + 4])) for k in (3, 7, 5)] + [(96, "word")] * 2
    queries = [(k, " ".join(words[k : k + 12])) for k in range(0, 40, 5)]
    b = spark.createDataFrame(queries, "q int, text string")

    def brute(rows):
        sets = {}
        for i, t in rows:
            if i is not None:
                sets.setdefault(i, set()).update((t or "").split())
        both = ((q, i, len(set(t.split()) & s), min(len(s), 12)) for q, t in queries for i, s in sets.items() if len(s) >= 8)
        return {r for r in both if r[2] >= L.OVERLAP_THRESHOLD * r[3]}

    for rows in (alone, alone + shared):
        calls = spark.sparkContext.accumulator(0)

        def seen(t, calls=calls):
            calls.add(1)
            return t

        texts = spark.createDataFrame(rows, "i int, text string").withColumn("text", F.udf(seen, "string")("text"))
        out = pairs.containment_search(texts, b, "i", "q")
        got = {tuple(r) for r in out.collect()}
        assert got == brute(rows) and len(got) > 8
        if rows is alone:  # no shuffle of a row a term before the terms are known
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert calls.value <= len(rows) and "hashpartitioning(t_id#" in plan and not re.search(r"hashpartitioning\(t_id#\d+L?, term#", plan)


def _mask_round_trip_and_its_sql(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    both = text_queries.mask_round_trip(spark, str(folder)).collect(), con.execute(text_queries.MASK_SQL).fetchall()
    return [sorted((tuple(r) for r in rows), key=lambda r: r[0]) for rows in both]


def test_mask_round_trip_keeps_texts_of_one_placeholder(spark, tmp_path):
    # they were left out
    texts = ["a `b` c", "$x$", "[3]", "see https://e.org/a", "\\(y\\)", "$a$ @; @NUM_1; @-", "@EQN_2; $a$", "7", "$ 5", "", None, "`a` and `a`"]
    got, want = _mask_round_trip_and_its_sql(spark, tmp_path, texts)
    assert got == want and [r[0] for r in got] == [*range(7), 11]


def test_mask_round_trip_agrees_with_its_sql_on_odd_texts(spark, tmp_path):
    # \x00 was the mark that stood for a placeholder while two are swapped; links and citations inside other spans weren't counted
    texts = ["`a` 7 \x00", "\x00 [1] `a`", "$a$ @; @NUM_1; \x00 @-", "ab1-http://e.org/x [2]", "10.1234/https://e.org/x", "GPT-4_http://e.org/a $b$", "[1]][1](\x00$$", "\\[`a`\\] \r\x0c $x$", "（[1]）(Doe, 2019) 式(3)`a`"]
    got, want = _mask_round_trip_and_its_sql(spark, tmp_path, texts)
    assert got == want and len(got) == len(texts)
