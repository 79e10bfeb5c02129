"""Integrity checks on pairs (key, input_text, output_text): what a revision changed that it should not have.

Every check is an expression over one row; only the repetition searches join, on an inverted index of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T

SURFACE_PAIRS = ("（）", "()", "【】", "[]", "《》", "“”")


def length_check(a: Column, b: Column) -> Column:
    """'shrank', 'expanded' or null, by bands of the input's length."""
    n, m = F.length(F.trim(a)), F.length(F.trim(b))
    least = F.floor(n * F.when(n < 80, F.lit(58)).otherwise(F.lit(55)) / 100)
    most = F.when(n < 80, F.greatest(F.floor(n * 160 / 100), n + 24)).otherwise(F.greatest(F.floor(n * 165 / 100), n + 220))
    return F.when(n < 12, F.lit(None)).when(m < least, "shrank").when(m > most, "expanded")


def language_check(a: Column, b: Column) -> Column:
    cjk = T.cjk_chars(a)
    lost = (T.language(a) != "en") & (cjk >= 20) & (T.cjk_chars(b) < F.greatest(F.lit(12), F.floor(cjk * 45 / 100)))
    return F.when(lost, "language_drift")


def retention(a: Column, b: Column) -> Column:
    """0.55 coverage + 0.20 precision + 0.25 length similarity over the multisets of lexical units, in ten thousandths."""
    units = lambda t: F.transform(F.regexp_extract_all(t, F.lit(L.RETENTION_UNIT), 0), lambda x: F.lower(x))
    return retention_of(units(a), units(b))


def retention_of(x: Column, y: Column) -> Column:
    """retention from the arrays of lexical units."""
    both = T.multiset_shared(x, y).cast("double")
    coverage, precision = both / F.greatest(F.size(x), F.lit(1)), both / F.greatest(F.size(y), F.lit(1))
    size = F.least(F.size(x), F.size(y)).cast("double") / F.greatest(F.size(x), F.size(y), F.lit(1))
    c, p, s = L.RETENTION_WEIGHTS
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(10000).cast("long")).otherwise(F.floor((c * coverage + p * precision + s * size) * 10000 + 0.5).cast("long"))


def surface_issues(a: Column, b: Column) -> Column:
    """Codes of what the output's surface shows and the input's doesn't, in order of the checks."""
    s, t = F.trim(a), F.trim(b)
    repeated = F.filter(F.regexp_extract_all(t, F.lit(L.REPEATED_PUNCTUATION), 0), lambda x: ~F.contains(s, x))
    mixed = F.filter(F.regexp_extract_all(t, F.lit(r"[，,][。.!?]|[。.!?][，,]"), 0), lambda x: ~F.contains(s, x))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    unbalanced = F.lit(False)
    for left, right in SURFACE_PAIRS:
        unbalanced = unbalanced | ((count(s, left) == count(s, right)) & (count(t, left) != count(t, right)))
    long = (F.length(s) >= 20) & (F.length(t) >= 12)
    checks = (
        ("repeated_punctuation", (F.length(t) >= 12) & (F.size(repeated) > 0)), ("mixed_bad_punctuation", (F.length(t) >= 12) & (F.size(mixed) > 0)),
        ("unbalanced_punctuation_pair", unbalanced), ("missing_sentence_terminal", long & s.rlike(L.SENTENCE_TERMINAL) & ~t.rlike(L.SENTENCE_TERMINAL)),
        ("trailing_weak_punctuation", long & t.rlike(L.WEAK_TRAILING) & ~s.rlike(L.WEAK_TRAILING)),
    )
    found = F.filter(F.array(*[F.when(c, k) for k, c in checks]), lambda x: x.isNotNull())
    return F.when(t == "", F.array(F.lit("empty_output"))).otherwise(found)


def introduced(a: Column, b: Column, pattern: str = L.any_of(L.INTRODUCED)) -> Column:
    """Matches in the output that the input lacks, sorted."""
    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"({pattern})"), 1))
    return F.array_sort(F.array_except(found(b), found(a)))


def check_pairs(pairs: DataFrame, a: str = "input_text", b: str = "output_text") -> DataFrame:
    """pairs with missing and added numbers and citations, length, language, retention, surface and introduced phrases.

    issues lists the codes in the order of the checks; first_issue is the one that a first-failure validator reports.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    out = pairs.withColumns({
        "missing_numbers": T.multiset_minus(T.numbers(x), T.numbers(y)), "added_numbers": T.multiset_minus(T.numbers(y), T.numbers(x)),
        "missing_citations": T.multiset_minus(T.citations(x), T.citations(y)), "added_citations": T.multiset_minus(T.citations(y), T.citations(x)),
        "length_issue": length_check(x, y), "language_issue": language_check(x, y), "retention": retention(x, y), "surface": surface_issues(x, y), "introduced": introduced(x, y),
    })
    full = lambda c: F.size(c) > 0
    codes = F.array(
        F.when(F.trim(y) == "", "empty_output"), F.when(full("missing_numbers") | full("added_numbers"), "number_changed"), F.when(full("missing_citations") | full("added_citations"), "citation_changed"),
        F.col("length_issue"), F.col("language_issue"), F.when(full("surface"), "surface"), F.when(full("introduced"), "template_introduced"),
    )
    out = out.withColumn("issues", F.filter(codes, lambda c: c.isNotNull()))
    return out.withColumn("first_issue", F.get("issues", F.lit(0)))


def adjacent_overlap(chunks: DataFrame, key: str, pos: str, text: str = "text", window: int = 3, least: float = 0.5) -> DataFrame:
    """The nearest earlier text among the `window` before it that shares at least half of the smaller's terms: one row per text."""
    w = Window.partitionBy(key).orderBy(pos)
    c = chunks.select(key, pos, T.content_terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    pairs = None
    for back in range(1, window + 1):  # a band of fixed width is lags, not a join
        left = c.select(key, F.col(pos).alias("right_pos"), "terms", F.lag(pos, back).over(w).alias("left_pos"), F.lag("terms", back).over(w).alias("left_terms"), F.lit(back).alias("back"))
        pairs = left if pairs is None else pairs.unionByName(left)
    pairs = pairs.where("left_terms is not null").withColumn("o", T.overlap(F.col("terms"), F.col("left_terms")))
    near = pairs.where((F.col("o.least") >= L.OVERLAP_LEAST_TERMS) & (F.col("o.both") >= least * F.col("o.least")))
    best = near.groupBy(key, "right_pos").agg(F.min(F.struct("back", "left_pos", "o")).alias("m"))
    return best.select(key, "right_pos", F.col("m.left_pos").alias("left_pos"), F.col("m.o.both").alias("shared"), F.col("m.o.least").alias("least_terms"))


def containment_search(texts: DataFrame, queries: DataFrame, text_id: str, query_id: str, text: str = "text", threshold: float = L.OVERLAP_THRESHOLD) -> DataFrame:
    """(query, text, shared, least_terms) with an overlap coefficient of the terms of at least `threshold`, by an inverted index of rare terms.

    The smaller of a pair can lack so many of its terms, so one of its rarest few (the more, the more it may lack) must be in the other; only those
    meet, and what meets is verified. Terms are ranked by how many of the other side hold them, and those that none holds are misses already.
    Texts of fewer than 8 terms take no part. Rows that share an id are one text with the terms of all; null ids take no part.
    A text's terms are found once and shuffled once, as a row that all steps read; whether ids repeat is asked at once.
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias(f"{name}_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        repeated = rows.groupBy(f"{name}_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select(f"{name}_id")
        # a condition in the generator isn't pushed below the terms, which would find them twice
        whole = lambda df: df.select(f"{name}_id", F.explode(F.filter(F.array(T.content_terms(F.col("_text"))), lambda t: F.size(t) >= L.OVERLAP_LEAST_TERMS)).alias(f"terms_{name}"))
        if repeated.isEmpty():
            out = whole(rows)
        else:
            terms = rows.join(repeated, f"{name}_id", "left_semi").select(f"{name}_id", F.explode(T.content_terms(F.col("_text"))).alias("term")).distinct()
            several = terms.groupBy(f"{name}_id").agg(F.collect_list("term").alias(f"terms_{name}")).where(F.size(f"terms_{name}") >= L.OVERLAP_LEAST_TERMS)
            out = whole(rows.join(repeated, f"{name}_id", "left_anti")).unionByName(several)
        # one row a group: a shuffle below which no step's conditions are pushed, so that all steps read the same
        return out.groupBy(f"{name}_id").agg(F.max(f"terms_{name}").alias(f"terms_{name}"))

    def each(sets: DataFrame, name: str) -> DataFrame:
        return sets.select(f"{name}_id", F.size(f"terms_{name}").cast("long").alias(f"n_{name}"), F.explode(f"terms_{name}").alias("term"))

    def prefix(mine: DataFrame, name: str, held: DataFrame) -> DataFrame:
        """The rarest terms of each text, of those that the other side holds: one of them is in whatever holds enough of its terms."""
        both, own = mine.join(held, "term"), Window.partitionBy(f"{name}_id")
        ranked = both.withColumns({"_rank": F.row_number().over(own.orderBy("_held", "term")), "_met": F.count("*").over(own)})
        return ranked.where(F.col("_rank") <= F.col("_met") - F.ceil(F.col(f"n_{name}") * F.lit(threshold) - F.lit(1e-9)) + 1).select(f"{name}_id", f"n_{name}", "term")

    sets_t, sets_q = side(texts, text_id, "t"), side(queries, query_id, "q")
    a, b = each(sets_t, "t"), each(sets_q, "q")
    held = lambda df: df.groupBy("term").agg(F.count("*").alias("_held"))
    met = a.join(b.select("term").distinct(), "term", "left_semi")
    small_q = prefix(b, "q", held(met)).join(met, "term").where("n_q <= n_t")
    # a text is the smaller of a pair only if it is smaller than the largest query
    smaller = met.join(sets_q.agg(F.max(F.size("terms_q")).alias("_most")), F.col("n_t") < F.col("_most")).drop("_most")
    small_t = prefix(smaller, "t", held(b)).join(b, "term").where("n_t < n_q")
    pairs = small_q.select("q_id", "t_id").unionByName(small_t.select("q_id", "t_id")).distinct()
    checked = pairs.join(sets_t, "t_id").join(sets_q, "q_id").withColumn("shared", F.size(F.array_intersect("terms_t", "terms_q")))
    out = checked.select("q_id", "t_id", F.col("shared").cast("long").alias("shared"), F.least(F.size("terms_t"), F.size("terms_q")).cast("int").alias("least_terms"))
    return out.where(F.col("shared") >= threshold * F.col("least_terms"))


def pattern_profile(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts of opening families and sentence skeletons per key: (key, kind, pattern, n). Sentences as careful_sentences cuts them."""
    s = texts.select(key, F.explode(F.transform(T.careful_sentences(F.coalesce(F.col(text), F.lit(""))), T.sentence_patterns)).alias("s"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("s")[k].alias("pattern")) for k in ("opening", "skeleton")])
    return s.select(key, F.explode(kinds).alias("p")).groupBy(key, "p.kind", "p.pattern").agg(F.count("*").alias("n"))


def pattern_growth(before: DataFrame, after: DataFrame, key: str, least_after: int = 3, least_growth: int = 2) -> DataFrame:
    """Patterns that a revision made grow: blocks says whether growth and new count reach the thresholds."""
    b = before.select(key, "kind", "pattern", F.col("n").alias("n_before"))
    out = after.select(key, "kind", "pattern", F.col("n").alias("n_after")).join(b, [key, "kind", "pattern"], "full_outer")
    out = out.fillna(0, ["n_before", "n_after"]).withColumn("growth", F.col("n_after") - F.col("n_before")).where("growth > 0")
    return out.withColumn("blocks", (F.col("n_after") >= least_after) & (F.col("growth") >= least_growth))
