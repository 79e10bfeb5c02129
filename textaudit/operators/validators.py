"""The chain of checks that a revised chunk must pass: one array of codes, in the order in which a first-failure validator runs.

Every check is an expression over one row; only repetition (operators/repetition.py) needs a join, and is asked for apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaudit.functions import guard_values as V
from textaudit.functions import text as T
from textaudit.operators import guards, pairs as P


def required_terms(text: Column) -> Column:
    """Distinct versioned and code-like names of two characters or more."""
    found = F.concat(F.regexp_extract_all(text, F.lit(V.VERSIONED), F.lit(0)), F.regexp_extract_all(text, F.lit(V.CODE_LIKE), F.lit(0)))
    return F.filter(F.array_distinct(F.transform(found, lambda t: F.trim(t))), lambda t: F.length(t) >= 2)


def term_counts(text: Column) -> Column:
    """How often each required term with a digit, a mark or mixed case occurs: array<struct<term, n>>, by term."""
    telling = F.filter(required_terms(text), lambda t: (F.length(t) >= 3) & t.rlike(r"[0-9._/-]|[a-z].*[A-Z]|[A-Z].*[a-z]"))
    occurrences = lambda t: ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("int")
    return F.transform(F.array_sort(telling), lambda t: F.struct(t.alias("term"), occurrences(t).alias("n")))


def missing_terms(a: Column, b: Column) -> Column:
    """Required terms of a that b doesn't hold, sorted."""
    return F.array_sort(F.filter(required_terms(a), lambda t: ~F.contains(b, t)))


def leading_marker(text: Column) -> Column:
    """The number or chapter mark that a text begins with, or ''."""
    return F.regexp_extract(F.trim(text), V.LEADING_MARKER, 0)


def run_together(a: Column, b: Column) -> Column:
    """Neighbouring words of an English text that the revision writes as one: array<string>, distinct, in order, as in the revision's lower case.

    What is written as one stands in a run of letters and digits that the source doesn't have, so forms without a mark are looked up in
    those runs alone, each once; whole texts are searched only for words with a mark between them.
    """
    words, gaps = F.regexp_extract_all(a, F.lit(V.SPACED_TOKEN), F.lit(0)), F.split(a, V.SPACED_TOKEN)
    telling = lambda w: w.rlike(r"[0-9._/-]|[a-z].*[A-Z]|[A-Z].*[a-z]")

    def joined(p: Column, both: Column) -> Column:
        left, right, mark = p["left"], p["right"], F.when(p["gap"] == " ", "").otherwise(F.regexp_replace(p["gap"], r"(?U)\s+", ""))
        marked, new, low_a, low_b = mark != "", both["new"], both["low_a"], both["low_b"]
        sensitive = marked | telling(left) | telling(right) | F.lower(left).isin(*V.GLUE_LEFT) | F.lower(right).isin(*V.GLUE_RIGHT)
        fit = p["gap"].rlike(r"(?U)\s") & sensitive & ((F.length(left) > 1) | (F.length(right) > 1))
        forms = F.array(F.lower(F.concat(left, mark, right)), F.lower(F.concat(left, right)))
        held = lambda f: F.contains(new, f) | (marked & F.contains(low_b, f))
        return F.when(((new != "") | marked) & fit, F.get(F.filter(forms, lambda f: (F.length(f) >= 5) & held(f) & ~F.contains(low_a, f)), F.lit(0)))

    def found(both: Column) -> Column:
        w, g = both["words"], both["gaps"]
        n = F.size(w) - 1
        next_to = F.arrays_zip(F.slice(w, 1, n).alias("left"), F.slice(w, 2, n).alias("right"), F.slice(g, 2, n).alias("gap"))
        return F.when(n >= 1, F.array_distinct(F.filter(F.transform(next_to, lambda p: joined(p, both)), lambda f: f.isNotNull()))).otherwise(F.array().cast("array<string>"))

    runs = lambda low: F.regexp_extract_all(low, F.lit(r"[a-z0-9._+-]{5,}"), F.lit(0))
    new = lambda low: F.array_join(F.array_except(runs(low["b"]), runs(low["a"])), " ")
    known = lambda low: F.struct(words.alias("words"), gaps.alias("gaps"), new(low).alias("new"), low["a"].alias("low_a"), low["b"].alias("low_b"))
    lows = F.struct(F.lower(a).alias("a"), F.lower(b).alias("b"))
    return F.when(T.language(a) == "en", T.let(T.let(lows, known), found)).otherwise(F.array().cast("array<string>"))


def answer_style(a: Column, b: Column) -> Column:
    """Whether the output begins like an answer about the text and the input doesn't."""
    lead, source = F.trim(F.regexp_replace(F.trim(b), V.LEADING_MARKUP, "")), F.trim(a)
    out = F.lit(False)
    for phrase in V.ANSWERS:
        out = out | (F.startswith(lead, F.lit(phrase)) & ~F.startswith(source, F.lit(phrase)))
    return out


def fragment(a: Column, b: Column) -> Column:
    """Whether the output ends in a function word (in Chinese: and the input doesn't)."""
    bare = lambda t: F.trim(F.regexp_replace(F.trim(t), r"[\"'”’）)\]】》]+$", ""))
    zh = bare(b).rlike(V.FRAGMENT_ZH) & ~bare(a).rlike(V.FRAGMENT_ZH)
    return (F.length(F.trim(a)) >= 20) & (F.length(F.trim(b)) >= 12) & (zh | ((T.language(a) == "en") & bare(b).rlike(V.FRAGMENT_EN)))


def placeholder_issue(expected: Column, output: Column, pattern: str) -> Column:
    """Of the placeholders (array, in order) in an output: 'missing', 'unknown', 'duplicated', 'reordered' or null."""
    def issue(x: Column) -> Column:
        wanted, found = x["wanted"], x["found"]
        return (
            F.when(F.size(wanted) == 0, F.lit(None)).when(F.size(F.array_except(wanted, found)) > 0, "missing").when(F.size(F.array_except(found, wanted)) > 0, "unknown")
            .when(F.size(found) != F.size(F.array_distinct(found)), "duplicated").when(found != wanted, "reordered")
        )

    return T.let(F.struct(expected.alias("wanted"), F.regexp_extract_all(output, F.lit(pattern), F.lit(0)).alias("found")), issue)


def validate(pairs: DataFrame, a: str = "input_text", b: str = "output_text") -> DataFrame:
    """Adds codes (in the order of the chain) and first_code (what a validator that stops at the first failure reports; null: valid).

    The checks of machine style and of repetition aren't among them. An empty output has one code. Null texts are empty ones.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.trim(F.coalesce(F.col(b), F.lit("")))
    breaks = lambda t: F.regexp_count(t, F.lit(r"\n\s*\n"))
    full = lambda c: F.size(c) > 0
    n, m = F.length(x), F.length(y)
    words, cjk = T.latin_words(y), T.cjk_chars(y)
    english = T.language(x) == "en"
    out = guards.relation_issues(pairs, a, b).withColumns({"_a": T.paragraphs(F.trim(x)), "_b": T.paragraphs(y), "_surface": P.surface_issues(x, y)})
    checks = F.array(
        F.when((F.size("_a") > 1) & (F.size("_a") != F.size("_b")), "paragraph_count_changed"), F.when((F.size("_a") <= 1) & (breaks(y) > breaks(x)), "paragraph_breaks_added"),
        F.when(answer_style(x, y), "answer_style"), F.when(y.rlike(V.MARKDOWN) & ~x.rlike(V.MARKDOWN), "markdown_introduced"),
        F.when((leading_marker(x) != "") & (leading_marker(x) != leading_marker(y)), "leading_marker_changed"),
        F.when(full(T.multiset_minus(T.citations(x), T.citations(y))), "citations_removed"), F.when(full(T.multiset_minus(T.citations(y), T.citations(x))), "citations_introduced"),
        F.when(full(T.multiset_minus(T.numbers(x), T.numbers(y))), "numbers_removed"), F.when(full(T.multiset_minus(T.numbers(y), T.numbers(x))), "numbers_introduced"),
        F.when(full(missing_terms(x, y)), "terms_removed"), F.when(full(run_together(x, y)), "english_spacing_removed"),
    )
    later = F.array(
        P.language_check(x, y), P.length_check(x, y),
        F.when(full("_surface") | fragment(x, y) | (y.rlike(V.ANSWER_WRAPPER) & ~F.trim(x).rlike(V.ANSWER_WRAPPER)), "surface"),
        F.when(m > F.greatest(n * 2, n + 200), "expanded_twice"), F.when(english & (words < F.greatest(F.lit(8), F.floor(T.latin_words(x) * 35 / 100))), "english_drift"),
        F.when(english & (cjk > F.greatest(T.cjk_chars(x) + 4, F.floor(words / 2))), "chinese_introduced"),
    )
    codes = F.filter(F.concat(checks, F.col("relation_issues"), later), lambda c: c.isNotNull())
    # explode: found once, whatever is filtered by it later
    out = out.select("*", F.explode(F.array(F.when(y == "", F.array(F.lit("empty_output"))).otherwise(codes))).alias("codes"))
    return out.withColumn("first_code", F.get("codes", F.lit(0))).drop("_a", "_b", "_surface", "relation_issues")
