"""Factual guards: scope qualifiers, negations, entities, their order and their values, as expressions over one row.

Null texts are empty ones. Nothing is shuffled but by scope_profile, which groups what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaudit.functions import guard_values as V
from textaudit.functions import text as T

SCOPE_KINDS = ("certainty_absolute", "condition_necessary", "condition_sufficient", "exclusive_requirement", "exclusive_restriction", "universal_any", "universal_totality")
#: What a Chinese qualifier begins with.
SCOPE_BEGINS = "[不只仅唯全所任一必势均]"
SCOPE_CHANGED = "factual_scope_qualifier_changed"


# --- scope ------------------------------------------------------------------------------------------------------------
def paragraphs(text: Column) -> Column:
    """At blank lines, empty ones kept: their numbers count."""
    return F.split(T.unix_lines(F.coalesce(text, F.lit(""))), r"\n\s*\n+")


def _kind_zh(found: Column) -> Column:
    """The kind of a qualifier with the rest of its clause; null for the additive 'not only'."""
    rest = F.regexp_replace(found, "^(?:只有|唯有|仅仅|仅|只)", "")
    return (
        F.when(found.rlike("^不"), F.lit(None)).when(found.rlike("^只要"), "condition_sufficient").when(found.rlike("^[只仅][需须]"), "exclusive_requirement")
        .when(found.rlike("^[只唯]有"), F.when(rest.contains("才"), "condition_necessary").otherwise("exclusive_restriction")).when(found.rlike("^唯一"), "exclusive_restriction")
        .when(found.rlike("^[只仅]"), F.when(rest.rlike(V.ONLY_AT), "condition_necessary").otherwise("exclusive_restriction"))
        .when(found.rlike("^任"), "universal_any").when(found.rlike("^[必势]"), "certainty_absolute").otherwise("universal_totality")
    )


def _kind_en(found: Column) -> Column:
    token = F.lower(found)
    return (
        F.when(token.isin("only", "solely"), "exclusive_restriction").when(token.isin("all", "every"), "universal_totality").when(token == "any", "universal_any")
        .otherwise("certainty_absolute")
    )


def scope_kinds(paragraph: Column) -> Column:
    """The kinds of a paragraph's scope qualifiers, one entry for each that counts."""
    # each match is looked at together with what follows it in its clause, up to 96 characters
    zh = F.regexp_extract_all(paragraph, F.lit(rf"(?=((?:{V.SCOPE_ZH}){V.CLAUSE}{{0,96}}))(?:{V.SCOPE_ZH})"), F.lit(1))
    zh = F.when(paragraph.rlike(SCOPE_BEGINS), zh).otherwise(F.array().cast("array<string>"))
    en = F.regexp_extract_all(paragraph, F.lit(V.SCOPE_EN), F.lit(0))
    return F.filter(F.concat(F.transform(zh, _kind_zh), F.transform(en, _kind_en)), lambda k: k.isNotNull())


def scope_profile(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, paragraph, kind, n): scope qualifiers by paragraph and kind."""
    cut = df.select(key, F.posexplode(paragraphs(F.col(text))).alias("paragraph", "_p"))
    return cut.select(key, "paragraph", F.explode(scope_kinds(F.col("_p"))).alias("kind")).groupBy(key, "paragraph", "kind").agg(F.count("*").alias("n"))


def scope_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Kinds whose number in a paragraph differs between two profiles."""
    b = before.select(key, "paragraph", "kind", F.col("n").alias("n_before"))
    out = after.select(key, "paragraph", "kind", F.col("n").alias("n_after")).join(b, [key, "paragraph", "kind"], "full_outer").fillna(0, ["n_before", "n_after"])
    return out.where("n_before <> n_after")


def _scope_marks(text: Column) -> Column:
    """Every qualifier as paragraph number and kind, sorted: two texts agree where these arrays do."""
    marked = F.transform(paragraphs(text), lambda p, i: F.transform(scope_kinds(p), lambda k: F.concat(i.cast("string"), F.lit(":"), k)))
    return F.array_sort(F.flatten(marked))


# --- negations, numbers, entities -------------------------------------------------------------------------------------
def negations(text: Column) -> Column:
    return F.regexp_count(text, F.lit(V.NEGATION))


def bound_numbers(text: Column) -> Column:
    """Numbers that aren't part of a name, path or time, in order, without white space."""
    return F.transform(F.regexp_extract_all(text, F.lit(V.BOUND_NUMBER), F.lit(0)), lambda x: F.replace(F.regexp_replace(x, r"(?U)\s+", ""), F.lit("％"), F.lit("%")))


def noise(term: Column) -> Column:
    """Whether a name is too short, begins with a function word or is a stock heading."""
    t = F.lower(term)
    return (F.length(term) < 2) | t.isin(*V.TITLE_PHRASES) | F.substring_index(t, " ", 1).isin(*V.TITLE_LEADERS)


_SPANS = "array<struct<start: int, size: int, rank: int, kind: string, term: string>>"


def _located(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """Matches with their places and lengths (negative), from what a split leaves between them."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, m: Column) -> Column:
        start, size = s["at"] + F.length(m["gap"]), F.length(m["found"])
        hit = F.struct(start.alias("start"), (-size).alias("size"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), T.collapse(m["found"]).alias("term"))
        return F.struct((start + size).alias("at"), F.array_append(s["out"], hit).alias("out"))

    placed = lambda found: F.aggregate(F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("gap"), found.alias("found")), none, step, lambda s: s["out"])
    return T.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(_SPANS)))


def entity_spans(text: Column) -> Column:
    """URLs, technical names, title phrases and metrics in order: array<struct<start, size (negative), rank, kind, term>>.

    Of two that overlap the one that starts first stays, of equal starts the longer, of equal places the kind named first.
    """
    named = F.filter(F.concat(_located(text, 1, "tech", V.TECH), _located(text, 2, "title", V.TITLE)), lambda e: ~noise(e["term"]))
    every = F.concat(_located(text, 0, "url", V.URL), named, _located(text, 3, "metric", V.METRIC))
    none = F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, e: Column) -> Column:
        kept = F.struct((e["start"] - e["size"]).alias("end"), F.array_append(s["out"], e).alias("out"))
        return F.when(e["start"] < s["end"], s).otherwise(kept)

    first = lambda found: F.when(F.size(found) > 1, F.aggregate(F.array_sort(found), none, step, lambda s: s["out"])).otherwise(found)
    return T.let(every, first)


def entities(text: Column) -> Column:
    """Distinct entities in order of their first place."""
    return F.array_distinct(F.transform(entity_spans(text), lambda e: e["term"]))


def _pattern_of(term: Column) -> Column:
    """A pattern of a term that stands by itself; names with a slash or a full stop may stand anywhere. Whatever a pattern could read as
    more than itself is escaped, as a URL may hold any mark."""
    literal = F.replace(F.regexp_replace(term, r"[\\^$.|?*+()\[\]{}]", r"\\$0"), F.lit(" "), F.lit(r"\s+"))
    return F.when(term.rlike(r"[/.]"), literal).otherwise(F.concat(F.lit("(?<![A-Za-z0-9_/-])"), literal, F.lit("(?![A-Za-z0-9_/-])")))


def contains_entity(text: Column, term: Column) -> Column:
    return F.regexp_like(text, _pattern_of(term))


def in_order(text: Column, terms: Column) -> Column:
    """Whether text holds all terms, each at a place behind that of the one before: first places that can be had, in one pass."""
    steps = F.transform(terms, lambda t: F.concat(F.lit("(?>.*?(?="), _pattern_of(t), F.lit(")).")))
    return F.regexp_like(text, F.concat(F.lit("(?s)^"), F.array_join(steps, "")))


def numbers_in_order(found: Column, wanted: Column) -> Column:
    """Whether the array wanted is a subsequence of the array found."""
    reached = F.aggregate(found, F.lit(0), lambda i, x: F.when(F.get(wanted, i) == x, i + 1).otherwise(i))
    return reached == F.size(wanted)


# --- relations --------------------------------------------------------------------------------------------------------
def segments(text: Column) -> Column:
    """Sentences and lines with what is in an order there: array<struct<terms, numbers, terms_fixed, numbers_fixed,
    paired>>. terms and numbers are distinct. terms_fixed: a cue of order, two metrics with two numbers, or a list of three or more.
    numbers_fixed: a cue, two entities or a delimiter. paired: a cue, and as many entities as numbers.
    """
    def found(s: Column) -> Column:
        spans = T.let(entity_spans(s), lambda e: F.struct(e.alias("spans"), F.array_distinct(F.transform(e, lambda x: x["term"])).alias("terms")))
        return F.struct(s.alias("s"), spans.alias("e"), T.let(bound_numbers(s), lambda n: F.struct(n.alias("all"), F.array_distinct(n).alias("numbers"))).alias("n"))

    def facts(x: Column) -> Column:
        # cues and delimiters say something of two terms or numbers alone
        s, n = x["s"], F.size(x["e"]["terms"])
        bare = F.regexp_replace(F.regexp_replace(s, V.URL, " "), V.INLINE_CODE, " ")
        cue, listed = F.when((n >= 2) | (F.size(x["n"]["numbers"]) >= 2), s.rlike(V.STRONG_CUE)).otherwise(False), F.when(n >= 3, F.regexp_count(bare, F.lit(V.DELIMITER))).otherwise(0)
        return F.struct(s.alias("s"), x["e"]["spans"].alias("spans"), x["e"]["terms"].alias("terms"), x["n"]["all"].alias("all"), x["n"]["numbers"].alias("numbers"), cue.alias("cue"), listed.alias("listed"))

    def judged(f: Column) -> Column:
        terms, numbers = f["terms"], f["numbers"]
        metrics = F.size(F.array_distinct(F.transform(F.filter(f["spans"], lambda e: e["kind"] == "metric"), lambda e: e["term"])))
        n = F.size(terms)
        ordered = f["cue"] | ((metrics >= 2) & (F.size(f["all"]) >= 2)) | ((n >= 3) & (f["listed"] >= F.greatest(F.lit(2), n - 2)))
        return F.struct(
            terms.alias("terms"), numbers.alias("numbers"), ((n >= 2) & ordered).alias("terms_fixed"), ((F.size(numbers) >= 2) & (f["cue"] | (n >= 2) | f["s"].rlike(V.DELIMITER))).alias("numbers_fixed"),
            ((n >= 2) & (n == F.size(numbers)) & f["cue"]).alias("paired"),
        )

    cut = F.filter(F.split(T.unix_lines(text), r"[。！？!?；;]\s*|\n+"), lambda s: F.trim(s) != "")
    return F.transform(F.transform(F.transform(cut, found), facts), judged)


def relation_issues(pairs: DataFrame, a: str = "input_text", b: str = "output_text") -> DataFrame:
    """Adds relation_issues, the codes of what of the input's facts the output changed, each once, in this order:

    entity_order_changed, number_order_changed (also where one is missing), entity_value_binding_missing_entity,
    entity_value_binding_missing_number, negation_scope_removed, factual_scope_qualifier_changed. Equal texts have none.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    out = pairs.withColumns({"_seg": segments(x), "_num": bound_numbers(y)})
    any_of = lambda flag, broken: F.exists("_seg", lambda s: s[flag] & broken(s))
    bound = lambda s: F.arrays_zip(s["terms"].alias("t"), s["numbers"].alias("n"))
    codes = F.array(
        F.when(any_of("terms_fixed", lambda s: ~in_order(y, s["terms"])), "entity_order_changed"),
        F.when(any_of("numbers_fixed", lambda s: ~numbers_in_order(F.col("_num"), s["numbers"])), "number_order_changed"),
        F.when(any_of("paired", lambda s: F.exists(s["terms"], lambda t: ~contains_entity(y, t))), "entity_value_binding_missing_entity"),
        F.when(any_of("paired", lambda s: F.exists(bound(s), lambda p: contains_entity(y, p["t"]) & ~F.array_contains(F.col("_num"), p["n"]))), "entity_value_binding_missing_number"),
        F.when((negations(x) > 0) & (negations(y) == 0), "negation_scope_removed"), F.when(_scope_marks(x) != _scope_marks(y), SCOPE_CHANGED),
    )
    found = F.filter(codes, lambda c: c.isNotNull())
    # explode: found once, whatever is filtered by it later
    return out.select("*", F.explode(F.array(F.when(x == y, F.array().cast("array<string>")).otherwise(found))).alias("relation_issues")).drop("_seg", "_num")
