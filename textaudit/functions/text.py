"""Text measures as Column expressions: everything stays in the JVM and in the row, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import guard_values as V
from . import lexicons as L

MARK = "\x01"
FULL_WIDTH, ASCII_WIDTH = "０１２３４５６７８９％", "0123456789%"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; inside lambdas Spark doesn't share common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def latin_words(text: Column) -> Column:
    return count_of(text, r"[A-Za-z]+(?:[-'][A-Za-z]+)*")


def latin_chars(text: Column) -> Column:
    return count_of(text, "[A-Za-z]")


def cjk_chars(text: Column) -> Column:
    return count_of(text, "[㐀-䶿一-鿿]")


def word_count(text: Column) -> Column:
    return count_of(text, r"(?U)\b\w+(?:[-']\w+)*\b")


def language(text: Column) -> Column:
    """'en' for enough Latin words against few CJK characters (a test of script, not of language), else 'default'.

    Without CJK characters five words and 25 letters are enough; that search ends at the fifth word and the 25th letter.
    """
    words, chars, cjk = latin_words(text), latin_chars(text), cjk_chars(text)
    mixed = (
        ((words >= 8) & (cjk <= 4) & (chars >= F.greatest(F.lit(30), cjk * 8)))
        | ((words >= 12) & (chars >= F.greatest(F.lit(40), cjk * 6)))
    )
    plain = text.rlike(r"(?s)(?:[A-Za-z]++(?:[-'][A-Za-z]++)*+[^A-Za-z]*+){5}") & text.rlike(r"(?s)(?:[A-Za-z][^A-Za-z]*+){25}")
    return F.when(text.rlike("[㐀-䶿一-鿿]"), F.when(mixed, "en").otherwise("default")).otherwise(F.when(plain, "en").otherwise("default"))


#: White space of Unicode but the plain space.
ODD_SPACE = "[\\t-\\r\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.when(text.rlike(f"{ODD_SPACE}|  "), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text))


def excerpt(text: Column, limit: int = 180) -> Column:
    cut = lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("…")))
    return let(collapse(text), cut)


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def bounded(text: Column, most: int = L.MOST_CHARS) -> Column:
    """Unix line ends; beyond `most` characters cut behind the last line or CJK sentence end in the final 15 %, if any."""
    unix = unix_lines(text)
    head = F.left(unix, F.lit(most))
    cut = F.length(head) - F.length(F.regexp_extract(head, r"[^\n。！？]*$", 0))
    short = F.when(cut - 1 >= int(most * 0.85), F.left(head, cut)).otherwise(head)
    return F.when(F.length(unix) <= most, unix).otherwise(short)


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Behind 。！？；!?; and behind a full stop before white space; a text of one such sentence is cut at its line ends."""
    flat = F.regexp_replace(F.regexp_replace(collapse(text), r"([。！？；!?;])\s*", f"$1{MARK}"), r"(\.)\s+", f"$1{MARK}")
    return let(_pieces(flat, MARK), lambda cut: F.when((F.size(cut) <= 1) & F.contains(text, F.lit("\n")), _pieces(text, r"\n+")).otherwise(cut))


#: What may stand behind the mark that ends a sentence, and before the word that begins one.
CLOSE, OPEN = r"[\"'”’)\]）】》]*", r"[\"'“‘(\[（]*"


def careful_sentences(text: Column) -> Column:
    """Like sentences, but no sentence ends at the full stop of an abbreviation, an initial, a number or a dotted token, or
    before a small letter; closing quotes and brackets stay with the sentence before them. Line ends are white space."""
    held, behind = "\x02", rf"(?={CLOSE}\s)"
    t = collapse(text)
    for pattern in (
        r"((?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*(?:\d[A-Za-z0-9_-]*\.|\.[A-Za-z0-9_.-]*\d)[A-Za-z0-9_.-]*)\." + behind, r"(?i)(?<![a-z])(" + "|".join(L.ABBREVIATIONS) + r")\." + behind,
        r"(?<![A-Za-z])([A-Za-z])\." + behind, rf"(\p{{Nd}})\.(?={CLOSE}\s\p{{Nd}})",
    ):
        t = F.regexp_replace(t, pattern, f"$1{held}")
    t = F.regexp_replace(t, rf"([。！？!?；;]{CLOSE}|\.{CLOSE}(?=\s{OPEN}(?:[\p{{Lu}}\p{{Nd}}㐀-䶿一-鿿]|$)|$))", f"$1{MARK}")
    return F.transform(_pieces(t, MARK), lambda x: F.replace(x, F.lit(held), F.lit(".")))


def paragraphs(text: Column) -> Column:
    """At blank lines."""
    return _pieces(text, r"\n\s*\n")


def lines(text: Column) -> Column:
    """At any line end: the paragraphs of texts without blank lines."""
    return _pieces(text, r"\n+")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def share(array: Column, p: float) -> Column:
    """Percentile by linear interpolation on the sorted array, in ten thousandths rounded half up."""
    at = (F.size(array) - 1) * F.lit(p)
    low = F.floor(at).cast("int")

    def between(ordered: Column) -> Column:
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(array) - 1))
        return F.floor((a + (b - a) * (at - low)) * 10000 + 0.5).cast("long")

    return let(F.array_sort(array), between)


def spread(array: Column) -> Column:
    """n * sum of squares - square of the sum: n**2 times the population variance, exact."""
    longs = F.transform(array, lambda x: x.cast("long"))
    return F.size(array).cast("long") * total(F.transform(longs, lambda x: x * x)) - total(longs) * total(longs)


def variation(array: Column) -> Column:
    """Coefficient of variation (standard deviation over the mean, at least 1), in ten thousandths."""
    n = F.size(array).cast("double")
    cv = F.sqrt(spread(array).cast("double")) / n / F.greatest(total(array).cast("double") / n, F.lit(1.0))
    return F.when(F.size(array) > 0, F.floor(cv * 10000 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def opening_signature(sentence: Column) -> Column:
    """The first three CJK characters, or else the first two Latin words, of a sentence without its leading connector."""
    s = F.regexp_replace(F.trim(sentence), r"^[\s，,;；:：]+", "")
    s = F.trim(F.regexp_replace(s, r"^(?:首先|其次|再次|最后|此外|因此|然而|同时|另外)[，,]?", ""))
    word = "([a-z]+(?:[-'][a-z]+)*)"
    first_two = rf"^[^a-z]*{word}(?:[^a-z]+{word})?"

    def signature(s: Column) -> Column:
        cjk = F.left(F.array_join(F.regexp_extract_all(s, F.lit("[㐀-䶿一-鿿]"), 0), ""), F.lit(3))
        words = let(F.lower(s), lambda x: F.concat_ws(" ", *[F.nullif(F.regexp_extract(x, first_two, i), F.lit("")) for i in (1, 2)]))
        return F.when(s.rlike("[㐀-䶿一-鿿]"), cjk).otherwise(words)

    return let(s, signature)


def structure_class(sentence: Column) -> Column:
    def kind(s: Column) -> Column:
        lead = F.when(s.rlike("^[被予加为受得]"), s).otherwise(F.concat(F.lit("。"), s))
        return (
            F.when(s == "", "plain_active").when(lead.rlike(L.STRUCT_PASSIVE), "passive").when(s.rlike(L.STRUCT_SUBORDINATE), "subordinate_lead")
            .when(s.rlike(L.STRUCT_PREMODIFIER), "long_premodifier").when(s.rlike(L.STRUCT_ENUMERATIVE), "enumerative").otherwise("plain_active")
        )

    return let(F.trim(sentence), kind)


def sentence_core(sentence: Column) -> Column:
    """Without quotes around it, and without the number or chapter mark and the punctuation that it begins with."""
    quotes = "“”‘’\"' "

    def unmarked(s: Column) -> Column:
        return F.ltrim(F.when(F.left(s, F.lit(1)).isin(*"第（(一二三四五六七八九十0123456789"), F.regexp_replace(s, L.CORE_MARKER, "")).otherwise(s), F.lit("，,、：:；;。.!！？?"))

    # a quote before a last line end is one at the end, too
    bare = lambda t: F.when(F.right(t, F.lit(1)).isin(*"\n\r\x85\u2028\u2029"), F.regexp_replace(F.ltrim(t, F.lit(quotes)), r"[“”‘’\"' ]+$", "")).otherwise(F.btrim(t, F.lit(quotes)))
    return let(let(F.trim(sentence), bare), unmarked)


def opening_family(sentence: Column) -> Column:
    return let(sentence_core(sentence), lambda core: family_of_core(core))  # noqa: PLW0108 (one argument: a second would be the index)


def english_core(core: Column) -> Column:
    """Whether a core has four Latin words or more and at most two CJK characters; each search ends where that is told."""
    words = core.rlike(r"(?s)\A[^A-Za-z]*+(?:[A-Za-z]++(?:[-'][A-Za-z]++)*+[^A-Za-z]*+){4}")
    return words & ~core.rlike(r"(?s)\A(?:[^㐀-䶿一-鿿]*+[㐀-䶿一-鿿]){3}")


def family_of_core(core: Column, english: Column | None = None) -> Column:
    en, zh = F.lit("en.plain"), F.lit("cn.plain")
    for name, pattern in reversed(L.OPENINGS_EN):
        en = F.when(core.rlike(pattern), name).otherwise(en)
    for name, pattern in reversed(L.OPENINGS_ZH):
        zh = F.when(core.rlike(pattern), name).otherwise(zh)
    # most sentences have a plain opening, which one search for all of them tells
    some = lambda families: core.rlike("|".join(f"(?:{p})" for _, p in families))
    plain = F.when(~some(L.OPENINGS_EN), "en.plain").otherwise(en)
    return F.when(english_core(core) if english is None else english, plain).otherwise(F.when(~some(L.OPENINGS_ZH), "cn.plain").otherwise(zh))


def length_bucket(sentence: Column) -> Column:
    size = lambda n: F.when(n <= 12, "short").when(n <= 32, "medium").when(n <= 64, "long").otherwise("very_long")
    return let(solid_length(sentence), size)


def solid_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.when(text.rlike(ODD_SPACE), F.regexp_replace(text, r"(?U)\s+", "")).otherwise(F.replace(text, F.lit(" "), F.lit(""))))


#: What a frame doesn't tell apart: marks of masked spans, URLs, code, numbers.
FRAME_MASKS = ((r"@(?:[A-Z]+_)?\d+;", " TOKEN "), (r"(?i)https?://\S+", " URL "), (r"`[^`\n]+`", " CODE "), (r"\d+(?:[.,]\d+)*(?:\.\d+)?", " NUMBER "))


#: A conjunction, looked for where one can begin alone.
CONJUNCTION = rf"(?U)(?=[{''.join(sorted({w[0] for w in L.CONJUNCTION_ZH.split('|')}))}]|\b[{''.join(sorted({w[0] for w in L.CONJUNCTION_EN.split('|')} | {w[0].upper() for w in L.CONJUNCTION_EN.split('|')}))}ıİ])(?:{L.CONJUNCTION_ZH}|(?i:\b(?:{L.CONJUNCTION_EN})\b))"


def frame(core: Column, english: Column | None = None, family: Column | None = None) -> Column:
    """A sentence's frame without its words, as canonical JSON (keys in order, no spaces): language, opening family, punctuation, conjunctions, length.

    english and family: those of the core, where they are known.
    """
    masked = core
    for pattern, name in FRAME_MASKS:
        masked = F.regexp_replace(masked, pattern, name)
    masked = F.when(core.rlike("[@`0-9]|://"), masked).otherwise(core)
    is_english = english_core(core) if english is None else english
    own = family_of_core(core) if family is None else family
    inner = let(sentence_core(core), lambda c: F.when(c == core, own).otherwise(family_of_core(c)))

    def json(m: Column) -> Column:
        least = lambda x, pattern, most: F.least(count_of(x, pattern), F.lit(most)).cast("string")
        parts = (
            ("colonBucket", least(m["marks"], "[：:]", 2), False), ("commaBucket", least(m["marks"], "[，,]", 4), False), ("conjunctionBucket", least(m["text"], CONJUNCTION, 4), False),
            ("language", F.when(is_english, "en").otherwise("zh"), True), ("lengthBucket", length_bucket(core), True),
            ("openingFamily", inner, True), ("semicolonBucket", least(m["marks"], "[；;]", 3), False),
        )
        pieces = [x for i, (k, v, text) in enumerate(parts) for x in (F.lit(("{" if not i else ",") + f'"{k}":' + ('"' if text else "")), v, F.lit('"' if text else ""))]
        return F.concat(*pieces, F.lit("}"))

    return let(masked, lambda m: let(F.struct(m.alias("text"), F.regexp_replace(m, "[^：:，,；;]+", "").alias("marks")), json))


def skeleton(sentence: Column) -> Column:
    """SHA-256 of a sentence's frame."""
    return let(sentence_core(sentence), lambda core: F.sha2(frame(core), 256))


def sentence_patterns(sentence: Column) -> Column:
    """struct<opening, skeleton>: opening_family and skeleton of a sentence, whose core, language and family are found once."""
    def named(x: Column) -> Column:
        known = F.struct(x["core"].alias("core"), x["english"].alias("english"), family_of_core(x["core"], x["english"]).alias("family"))
        return let(known, lambda k: F.struct(k["family"].alias("opening"), F.sha2(frame(k["core"], k["english"], k["family"]), 256).alias("skeleton")))

    return let(sentence_core(sentence), lambda core: let(F.struct(core.alias("core"), english_core(core).alias("english")), named))


def content_terms(text: Column) -> Column:
    """Distinct Latin tokens of three characters or more that aren't stop words, lower-cased, with CJK blocks (of over four characters: pairs)."""
    tokens = F.filter(F.transform(F.regexp_extract_all(text, F.lit(L.CONTENT_TOKEN), 0), lambda x: F.lower(x)), lambda x: (F.length(x) >= 3) & ~x.isin(*L.STOPWORDS))
    blocks = F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), 0)
    pairs = F.transform(blocks, lambda b: F.when(F.length(b) <= 4, F.array(b)).otherwise(F.transform(F.sequence(F.lit(1), F.length(b) - 1), lambda i: F.substr(b, i, F.lit(2)))))
    return F.array_distinct(F.concat(tokens, F.flatten(pairs)))


def numbers(text: Column) -> Column:
    """Numbers that stand by themselves, in any script's digits; white space dropped, full-width digits and ％ as ASCII."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + L.NUMBER), 0), lambda x: F.translate(F.regexp_replace(x, r"(?U)\s+", ""), FULL_WIDTH, ASCII_WIDTH))


def citations(text: Column) -> Column:
    """Numeric and author-year citations, white space dropped, commas and semicolons as ASCII."""
    found = F.concat(F.regexp_extract_all(text, F.lit(L.NUMERIC_CITATION), 0), F.regexp_extract_all(text, F.lit(V.AUTHOR_YEAR), 0))
    return F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"\s+", ""), "，；", ",;"))


def overlap(a: Column, b: Column) -> Column:
    """(size of the intersection, size of the smaller): the overlap coefficient's two numbers."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.least(F.size(a), F.size(b)).alias("least"))


def _runs(a: Column, b: Column, start: Column, at_end: Callable) -> Column:
    """Folds at_end(state, value, count in a, count in b) over the distinct values of both arrays in order, in one pass over them sorted."""
    both = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("v"), F.lit(0).alias("side"))), F.transform(b, lambda x: F.struct(x.alias("v"), F.lit(1).alias("side")))))
    begin = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("na"), F.lit(0).alias("nb"), start.alias("out"))

    def step(s: Column, x: Column) -> Column:
        one, other = F.when(x["side"] == 0, 1).otherwise(0), F.when(x["side"] == 1, 1).otherwise(0)
        same = F.struct(s["v"].alias("v"), (s["na"] + one).alias("na"), (s["nb"] + other).alias("nb"), s["out"].alias("out"))
        new = F.struct(x["v"].alias("v"), one.alias("na"), other.alias("nb"), at_end(s["out"], s["v"], s["na"], s["nb"]).alias("out"))
        return F.when(s["v"] == x["v"], same).otherwise(new)

    return F.aggregate(both, begin, step, lambda s: at_end(s["out"], s["v"], s["na"], s["nb"]))


def multiset_shared(a: Column, b: Column) -> Column:
    """How many elements two arrays of strings have in common, counted as often as both have them."""
    return _runs(a, b, F.lit(0), lambda n, v, x, y: n + F.least(x, y))


def multiset_minus(a: Column, b: Column) -> Column:
    """Elements of a beyond their count in b, sorted."""
    none = F.array().cast("array<struct<v: string, n: int>>")
    beyond = _runs(a, b, none, lambda out, v, x, y: F.when(x > y, F.array_append(out, F.struct(v.alias("v"), (x - y).alias("n")))).otherwise(out))
    return F.flatten(F.transform(beyond, lambda e: F.array_repeat(e["v"], e["n"])))
