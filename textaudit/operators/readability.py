"""Readability that a revision lost: forms of five kinds that the output has more of than the input, rule by rule.

Everything is an expression over one row. Quoted spans don't count, nor does white space. Null texts are empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaudit.functions import guard_values as V
from textaudit.functions import text as T

CODES = (
    "colloquial_register_introduced", "academic_collocation_conflict_introduced", "predicate_completeness_regression", "telegraphic_clause_chain_introduced",
    "vague_causal_reference_introduced",
)
#: Bare actions that a sentence may string together, and the fewest clauses of a chain.
BARE_ALLOWED, CHAIN_LEAST = 3, 5
_EDGE = "[ ：:（）()\\[\\]【】]+"


def unquoted(text: Column) -> Column:
    """The text without quoted spans and white space."""
    return F.regexp_replace(F.regexp_replace(text, V.QUOTED, " "), r"(?U)\s+", "")


def _trimmed(clause: Column) -> Column:
    return F.regexp_replace(clause, f"^{_EDGE}|{_EDGE}$", "")


def clause_counts(t: Column) -> tuple[Column, Column]:
    """Clauses that are a prepositional phrase with a noun for a predicate, and clauses that end in a preposition."""
    clauses = F.transform(F.split(t, "[，,。！？!?；;]+"), _trimmed)
    nominal = F.filter(clauses, lambda c: c.rlike(V.NOMINAL) & ~c.rlike(V.BRIDGE))
    return F.size(nominal), F.size(F.filter(clauses, lambda c: c.rlike(V.DANGLING)))


def bare_action(clause: Column) -> Column:
    """Whether a clause names an action without a subject, an aspect or a modal."""
    return T.let(_trimmed(clause), lambda c: c.rlike(V.ACTION) & ~c.rlike(V.SUBJECT) & ~c.rlike(V.FINITE) & ~c.rlike(V.MODAL))


def chained_actions(t: Column) -> Column:
    """Bare actions beyond BARE_ALLOWED, summed over the sentences that chain at least CHAIN_LEAST clauses with actions."""

    def of_sentence(clauses: Column) -> Column:
        chained = F.size(F.filter(clauses, lambda c: c.rlike(V.ACTION))) >= CHAIN_LEAST
        return F.when(chained, F.greatest(F.lit(0), F.size(F.filter(clauses, bare_action)) - BARE_ALLOWED)).otherwise(0)

    return F.aggregate(F.transform(F.split(t, "[。！？!?；;]+"), lambda s: T.let(F.split(s, "[，,]+"), of_sentence)), F.lit(0), lambda a, x: a + x)


def loose_references(t: Column) -> Column:
    """Causal references with nothing named in the LOOK_BACK characters before them."""
    before = F.regexp_extract_all(t, F.lit(rf"(?=(?:{V.CAUSAL}))(?<=(.{{{V.LOOK_BACK}}}|^.{{0,{V.LOOK_BACK - 1}}}))(?:{V.CAUSAL})"), F.lit(1))
    return F.size(F.filter(before, lambda b: ~b.rlike(V.ANTECEDENT)))


def profile(text: Column) -> Column:
    """Counts by kind and rule: array<array<int>>, kinds in the order of CODES. Every form has a Chinese character, so a text without one isn't searched."""
    sizes = (len(V.COLLOQUIAL), len(V.COLLOCATIONS), 2, 1, 1)
    nothing = F.array(*[F.array(*[F.lit(0)] * n) for n in sizes])

    def counts(t: Column) -> Column:
        kinds = (
            [T.count_of(t, p) for _, p in V.COLLOQUIAL], [T.count_of(t, p) for _, p in V.COLLOCATIONS], list(clause_counts(t)), [chained_actions(t)], [loose_references(t)],
        )
        return F.when(t.rlike("[㐀-鿿]"), F.array(*[F.array(*k) for k in kinds])).otherwise(nothing)

    return T.let(unquoted(F.coalesce(text, F.lit(""))), counts)


def delta(pairs: DataFrame, a: str = "input_text", b: str = "output_text") -> DataFrame:
    """Adds readability: array<struct<code, input, output, introduced, resolved>>, one entry for each of CODES, and
    readability_issues: the codes with anything introduced. A rule that falls can't hide one that rises."""
    beyond = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(F.lit(0), p - q)), F.lit(0), lambda s, v: s + v)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    named = F.array(*map(F.lit, CODES))

    def entries(both: Column) -> Column:
        kinds = F.arrays_zip(named.alias("code"), both["x"].alias("x"), both["y"].alias("y"))
        return F.transform(kinds, lambda k: F.struct(
            k["code"].alias("code"), total(k["x"]).alias("input"), total(k["y"]).alias("output"), beyond(k["y"], k["x"]).alias("introduced"), beyond(k["x"], k["y"]).alias("resolved"),
        ))

    both = F.struct(profile(F.col(a)).alias("x"), profile(F.col(b)).alias("y"))
    out = pairs.withColumn("readability", T.let(both, entries))
    return out.withColumn("readability_issues", F.transform(F.filter("readability", lambda r: r.introduced > 0), lambda r: r.code))
