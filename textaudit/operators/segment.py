"""Packing sentences into chunks, and masking of spans that must survive a revision.

A chunk is the order-dependent part: sentences are packed one after the other, so it is a small fold over one document's
sentences inside a pandas function; documents are independent, and no document leaves its row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textaudit.functions import guard_values as V
from textaudit.functions import lexicons as L
from textaudit.functions import text as T

TARGET, SOFT_CUT = 0.8, 0.55
#: Characters that a chunk needs to stand alone, for English and other texts.
LEAST = {"en": 160, "default": 60}
_ENGLISH, _OTHER = re.compile(r"(?<=[.!?;:])\s+"), re.compile(r"(?<=[。！？；!?;])\s*|(?<=[.!?;])\s+")
_COMMA = re.compile(r"(?<=[，、：:,;])\s*")


def _join(a: str, b: str) -> str:
    return a + (" " if a and b and a[-1].isascii() and b[0].isascii() else "") + b


def _pack(parts: list[str], limit: int) -> list[str]:
    out: list[str] = []
    for p in parts:
        if out and len(_join(out[-1], p)) <= limit:
            out[-1] = _join(out[-1], p)
        else:
            out.append(p)
    return out


def _cut(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` characters, behind white space or punctuation in the rear part of each window if there is any."""
    out = []
    while len(text) > limit:
        at = max(text.rfind(c, 0, limit) for c in " \t。！？；;，,、:：")
        at = limit if at < SOFT_CUT * limit else at + 1
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [x for x in (*out, text) if x]


def pack_paragraph(text: str, limit: int, english: bool) -> list[str]:
    """Chunks of one paragraph: sentences packed to the target, over-long ones cut, small tails joined; none over the limit."""
    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    target, least = max(1, round(limit * TARGET)), min(LEAST["en" if english else "default"], limit)
    pieces: list[str] = []
    for s in (x.strip() for x in (_ENGLISH if english else _OTHER).split(text) if x and x.strip()):
        pieces += [s] if len(s) <= limit else _pack([y for x in _COMMA.split(s) if x for y in _cut(x.strip(), target)], target)
    chunks: list[str] = []
    for p in pieces:
        both = _join(chunks[-1], p) if chunks else ""
        if chunks and (len(both) <= target or len(chunks[-1]) < least and len(both) <= limit):
            chunks[-1] = both
        else:
            chunks.append(p)
    if len(chunks) > 1 and len(chunks[-1]) < least and len(_join(chunks[-2], chunks[-1])) <= limit:
        chunks[-2:] = [_join(chunks[-2], chunks[-1])]
    return chunks


def chunks(df: DataFrame, key: str, text: str = "text", limit: int = 850) -> DataFrame:
    """(key, paragraph, chunk, chunk_id, text, chars): every chunk of every line of every text, in order."""
    @F.pandas_udf("array<string>")
    def pack(line: pd.Series, english: pd.Series) -> pd.Series:
        return pd.Series([pack_paragraph(x, limit, e) for x, e in zip(line, english, strict=True)])

    lines = df.select(key, F.posexplode(T.lines(F.coalesce(F.col(text), F.lit("")))).alias("paragraph", "line"))
    packed = F.when(F.length("line") <= limit, F.array("line")).otherwise(pack("line", T.language(F.col("line")) == "en"))
    out = lines.select(key, "paragraph", F.posexplode(packed).alias("chunk", "text"))
    return out.withColumn("chunk_id", F.concat(F.lit("p"), "paragraph", F.lit("_c"), "chunk")).withColumn("chars", F.length("text"))


#: Mark of a masked span: its type and its number, from 1; a literal @ is written @- in masked texts, so none is one by chance.
PLACEHOLDER = r"@[A-Z]+_\d+;"
_TOKENS = "array<struct<start: int, stop: int, type: string, text: string>>"


def protected(text: Column) -> Column:
    """The protected spans of a text in order, none of which overlap: array<struct<start, stop, type, text>>, in code points from 0.

    Types: CODE, EQN, URL (and DOI), REF, CAP, NUM (with units, and ranges), TOK (versioned names and the like).
    """
    gaps, found = F.split(text, V.PROTECTED), F.regexp_extract_all(text, F.lit(V.PROTECTED), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_TOKENS).alias("out"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + F.length(m["gap"])
        stop = start + F.length(m["found"])
        return F.struct(stop.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), stop.alias("stop"), span_type(m["found"]).alias("type"), m["found"].alias("text"))).alias("out"))

    # of a split's pieces the last may be missing where nothing stands behind the last match
    return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found")), none, step, lambda s: s["out"])


def span_type(span: Column) -> Column:
    t, whole = F.trim(span), lambda p: F.trim(span).rlike(f"^(?:{p})$")
    return (
        F.when(whole("(?s)`.*`"), "CODE").when(t.rlike(r"^(?:\$|\\\(|\\\[)"), "EQN").when(whole(f"(?i){V.URL_SPAN}|{V.DOI_SPAN}"), "URL").when(whole(f"{L.NUMERIC_CITATION}|{V.AUTHOR_YEAR}"), "REF")
        .when(t.rlike("^[图表]"), "CAP").when(t.rlike(r"^(?:公?式|\(\s*\d)"), "EQN").when(whole("|".join((V.RANGE_WITH_UNIT, V.WITH_UNIT, V.PLAIN_NUMBER))), "NUM").otherwise("TOK")
    )


def with_anchors(text: Column, anchors: Column) -> Column:
    """struct(spans, problem): the protected spans together with a text's anchors (exact strings, type FMT).

    An anchor inside a span is kept by it, and takes the place of spans inside itself. problem is null, or 'duplicate_anchors',
    'anchor_missing_or_ambiguous' (each must stand once), or 'anchor_overlaps'.
    """
    at = lambda a: F.position(a, text)
    start = F.struct(protected(text).alias("spans"), F.when(F.size(F.array_distinct(anchors)) < F.size(anchors), "duplicate_anchors").cast("string").alias("problem"))

    def step(s: Column, a: Column) -> Column:
        first, second = at(a), F.position(a, text, at(a) + 1)
        x, y = first - 1, first - 1 + F.length(a)
        inside = lambda p: (x >= p["start"]) & (y <= p["stop"])
        around = lambda p: (p["start"] >= x) & (p["stop"] <= y)
        cut = lambda p: (x < p["stop"]) & (y > p["start"]) & ~inside(p) & ~around(p)
        kept = F.filter(s["spans"], lambda p: ~around(p) | inside(p))
        new = F.when(F.exists(s["spans"], inside), kept).otherwise(F.array_append(kept, F.struct(x.alias("start"), y.alias("stop"), F.lit("FMT").alias("type"), a.alias("text"))))
        problem = F.when((first == 0) | (second > 0), "anchor_missing_or_ambiguous").when(F.exists(s["spans"], cut), "anchor_overlaps")
        return F.struct(F.when(problem.isNull(), new).otherwise(s["spans"]).cast(_TOKENS).alias("spans"), F.coalesce(s["problem"], problem).alias("problem"))

    given = F.filter(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: a != "")
    return F.aggregate(given, start, step, lambda s: F.struct(F.array_sort(s["spans"]).alias("spans"), s["problem"].alias("problem")))


def mask_spans(text: Column, spans: Column) -> Column:
    """struct(masked, tokens): each span stands as its placeholder; tokens: array<struct<placeholder, type, text>> in their order."""
    safe = lambda c: F.replace(c, F.lit("@"), F.lit("@-"))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("masked"), F.array().cast("array<struct<placeholder: string, type: string, text: string>>").alias("tokens"))

    def step(s: Column, p: Column) -> Column:
        name = F.concat(F.lit("@"), p["type"], F.lit("_"), (s["n"] + 1).cast("string"), F.lit(";"))
        masked = F.concat(s["masked"], safe(F.substring(text, s["at"] + 1, p["start"] - s["at"])), name)
        return F.struct(p["stop"].alias("at"), (s["n"] + 1).alias("n"), masked.alias("masked"), F.array_append(s["tokens"], F.struct(name.alias("placeholder"), p["type"].alias("type"), p["text"].alias("text"))).alias("tokens"))

    end = lambda s: F.struct(F.concat(s["masked"], safe(F.substring(text, s["at"] + 1, F.length(text)))).alias("masked"), s["tokens"].alias("tokens"))
    return F.aggregate(spans, none, step, end)


def mask(text: Column) -> Column:
    """mask_spans of the protected spans, from the text's pieces: their places aren't needed, so the work grows with the text, however many spans it has."""
    def masked(m: Column) -> Column:
        gaps = F.transform(m["gaps"], lambda g: F.replace(g, F.lit("@"), F.lit("@-")))
        tokens = F.transform(m["found"], lambda f, i: T.let(span_type(f), lambda k: F.struct(F.concat(F.lit("@"), k, F.lit("_"), (i + 1).cast("string"), F.lit(";")).alias("placeholder"), k.alias("type"), f.alias("text"))))
        return T.let(F.struct(gaps.alias("gaps"), tokens.alias("tokens")), lambda x: F.struct(_interleaved(x["gaps"], F.transform(x["tokens"], lambda t: t["placeholder"])).alias("masked"), x["tokens"].alias("tokens")))

    return F.when(text.isNotNull(), T.let(F.struct(F.split(text, V.PROTECTED).alias("gaps"), F.regexp_extract_all(text, F.lit(V.PROTECTED), F.lit(0)).alias("found")), masked))


def _interleaved(gaps: Column, between: Column) -> Column:
    """A text from its pieces and what stands between them. Inside a lambda an array that isn't zipped would be made anew for each element."""
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), between.alias("b")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["b"], F.lit("")))), "")


def unmask(masked: Column, tokens: Column) -> Column:
    """The text again, with each placeholder's own span, wherever it stands; unknown placeholders stay as they are.

    A placeholder's number is its token's place, so it is looked up there; tokens that aren't in their places are searched.
    """
    def own(x: Column) -> Column:
        at = lambda m: F.get(x["tokens"], F.coalesce(F.regexp_extract(m, r"_(\d+);$", 1).try_cast("int"), F.lit(0)) - 1)
        searched = lambda m: F.coalesce(F.get(F.filter(x["tokens"], lambda t: t["placeholder"] == m), F.lit(0))["text"], m)
        return _interleaved(x["gaps"], F.transform(x["marks"], lambda m: T.let(at(m), lambda t: F.when(t["placeholder"] == m, t["text"]).otherwise(searched(m)))))

    gaps = F.transform(F.split(masked, PLACEHOLDER), lambda g: F.replace(g, F.lit("@-"), F.lit("@")))
    return T.let(F.struct(gaps.alias("gaps"), F.regexp_extract_all(masked, F.lit(PLACEHOLDER), F.lit(0)).alias("marks"), tokens.alias("tokens")), own)


def placeholder_problem(tokens: Column, output: Column) -> Column:
    """What became of a masked text's placeholders: null, or 'missing', 'unknown', 'duplicated' or 'reordered', in this order."""
    from textaudit.operators.validators import placeholder_issue

    return placeholder_issue(F.transform(tokens, lambda t: t["placeholder"]), output, PLACEHOLDER)


def anchor_problem(source: Column, output: Column, anchors: Column) -> Column:
    """Of anchors that must stay as they are, once each and in order: null, or 'invalid_source', 'removed', 'duplicated' or 'reordered'."""
    once = lambda t, a: (F.position(a, t) > 0) & (F.position(a, t, F.position(a, t) + 1) == 0)
    places = F.transform(anchors, lambda a: F.position(a, output))
    return (
        F.when(F.exists(anchors, lambda a: ~once(source, a)), "invalid_source").when(F.exists(anchors, lambda a: F.position(a, output) == 0), "removed")
        .when(F.exists(anchors, lambda a: ~once(output, a)), "duplicated").when(places != F.array_sort(places), "reordered")
    )


def span_types(text: Column) -> Column:
    """map<type, count> of the protected spans."""
    kinds = F.transform(protected(text), lambda p: p["type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


@F.pandas_udf(StringType())
def json_payload(texts: pd.Series) -> pd.Series:
    """The first JSON object or array in each text that parses, as compact JSON with sorted keys; null where there is none.

    Line comments and trailing commas are dropped and open brackets closed where a text parses only so.
    """
    return texts.map(_payload)


def _payload(text: str | None) -> str | None:
    import json

    decoder = json.JSONDecoder()
    starts = [m.start() for m in re.finditer(r"[{\[]", text or "")]
    for at in starts:
        for repaired in (False, True):
            body = text[at:]
            if repaired:
                body = re.sub(r",(\s*[}\]])", r"\1", re.sub(r'(?m)(?<![:"])//[^\n"]*$', "", body))
                bare = re.findall(r"[{}\[\]]", re.sub(r'"(?:\\.|[^"\\])*"', "", body))
                waiting: list[str] = []
                for c in bare:
                    if c in "{[":
                        waiting.append("}" if c == "{" else "]")
                    elif waiting:
                        waiting.pop()
                body += "".join(reversed(waiting))
            try:
                value, _ = decoder.raw_decode(body)
            except ValueError:
                continue
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None
