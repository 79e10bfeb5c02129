"""Reversible segmentation: neighbouring short paragraphs as one chunk, and a revised chunk cut back to as many paragraphs.

The greedy merge depends on order, so it is a fold over one text's paragraphs; both directions are expressions over the row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaudit.functions import text as T

LIMIT, MOST = 850, 4
#: A cut is moved at most so far to a better place.
NEAR = 120
# --- fixed values: paragraphs that are never merged, of 80 characters or less -----------------------------------------
HEADINGS = (
    r"摘\s*要$", r"关键词[:：]?.*$", r"abstract$", r"key\s+words?[:：]?.*$", r"目录$", r"参考文献$", r"致\s*谢$", r"图\s*\d*[\s、：:].*", r"表\s*\d*[\s、：:].*", r"\d+(?:\.\d+){0,3}\s+\S+.*$", r"第[一二三四五六七八九十\d]+[章节]\s*.*$",
)
STANDALONE = "(?i)^(?:" + "|".join(HEADINGS) + ")"
#: Where a sentence may end, where a phrase may; elsewhere a cut is better between characters that don't make one word.
SENTENCE_END, PHRASE_END, WORD = "。！？；：.!?;:", "，、, \t\r\n", string.ascii_letters + string.digits
#: Each of them as one character: . for a sentence's end, a comma for a phrase's, w for those of words.
CHARS = SENTENCE_END + PHRASE_END + WORD, "." * len(SENTENCE_END) + "," * len(PHRASE_END) + "w" * len(WORD)


def standalone(paragraph: Column) -> Column:
    return (F.length(paragraph) <= 80) & paragraph.rlike(STANDALONE)


_CHUNKS = "array<struct<first: int, last: int, reason: string, length: int, lang: string, lengths: array<int>, text: string>>"


def merged_manifest(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """(key, chunk, chunk_id, first, last, reason, lengths, text): paragraphs (at blank lines) first to last as one chunk, with two line ends between them.

    Paragraphs are merged in order while the chunk stays within limit characters and most paragraphs, of one language each. Headings and the like
    (reason standalone-paragraph) and paragraphs over the limit (oversized-paragraph) are chunks of their own; others are paragraph-kept or
    merged-short-paragraphs. lengths are those of the paragraphs. Null and blank texts have no chunk; rows that share a key are texts of their own.
    """
    def facts(p: Column) -> Column:
        reason = F.when(standalone(p), "standalone-paragraph").when(F.length(p) > limit, "oversized-paragraph")
        return F.struct(p.alias("p"), T.language(p).alias("lang"), reason.cast("string").alias("reason"))

    def step(out: Column, p: Column) -> Column:
        last, n = F.element_at(out, -1), F.length(p["p"])
        open_ = (F.size(out) > 0) & p["reason"].isNull()
        fits = (~last["reason"].isin("standalone-paragraph", "oversized-paragraph")) & (last["lang"] == p["lang"]) & (last["length"] + 2 + n <= limit) & (F.size(last["lengths"]) < most)
        at = F.when(F.size(out) > 0, last["last"] + 1).otherwise(0)
        new = F.struct(at.alias("first"), at.alias("last"), F.coalesce(p["reason"], F.lit("paragraph-kept")).alias("reason"), n.alias("length"), p["lang"].alias("lang"), F.array(n).alias("lengths"), p["p"].alias("text"))
        more = F.struct(last["first"].alias("first"), at.alias("last"), F.lit("merged-short-paragraphs").alias("reason"), (last["length"] + 2 + n).alias("length"), last["lang"].alias("lang"), F.array_append(last["lengths"], n).alias("lengths"), F.concat(last["text"], F.lit("\n\n"), p["p"]).alias("text"))
        return F.when(open_ & fits, F.array_append(F.slice(out, 1, F.size(out) - 1), more)).otherwise(F.array_append(out, new)).cast(_CHUNKS)

    paragraphs = F.transform(T.paragraphs(T.unix_lines(F.coalesce(F.col(text), F.lit("")))), facts)
    out = df.select(key, F.posexplode(F.aggregate(paragraphs, F.array().cast(_CHUNKS), step)).alias("chunk", "c"))
    name = F.when(F.col("c.first") == F.col("c.last"), F.concat(F.lit("p"), F.col("c.first"), F.lit("_c0"))).otherwise(F.concat(F.lit("p"), F.col("c.first"), F.lit("_p"), F.col("c.last"), F.lit("_c0")))
    return out.select(key, "chunk", name.alias("chunk_id"), "c.first", "c.last", "c.reason", "c.lengths", "c.text")


def cut_back(output: Column, lengths: Column) -> Column:
    """The output in as many parts as there are lengths: at its blank lines, if these give as many (what is too much stays with the last);
    else in proportion to the lengths, each cut moved to the best place near: behind a sentence, else at a phrase's end, else between words."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    facts = F.struct(bare(output).alias("whole"), F.aggregate(lengths, F.lit(0), lambda a, x: a + F.greatest(x, F.lit(1))).alias("total"))
    return T.let(facts, lambda f: _cut(f["whole"], lengths, f["total"], F.filter(F.transform(F.split(f["whole"], r"\n\s*\n"), bare), lambda x: x != ""), bare))


def _cut(whole: Column, lengths: Column, total: Column, pieces: Column, bare) -> Column:
    n = F.size(lengths)

    def step(s: Column, length: Column) -> Column:
        left = n - s["k"]
        ideal = s["at"] + F.bround(F.length(whole).cast("double") * F.greatest(length, F.lit(1)) / total).cast("int")
        end = F.when((left == 1) | (F.length(whole) - s["at"] <= left), F.length(whole)).otherwise(_best_cut(whole, ideal, s["at"] + 1, F.length(whole) - (left - 1)))
        return T.let(end, lambda e: F.struct((s["k"] + 1).alias("k"), e.alias("at"), F.array_append(s["parts"], bare(F.substring(whole, s["at"] + 1, e - s["at"]))).alias("parts")))

    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    by_length = F.aggregate(lengths, start, step, lambda s: s["parts"])
    by_lines = lambda p: F.when(F.size(p) == n, p).when(F.size(p) > n, F.array_append(F.slice(p, 1, n - 1), F.array_join(F.slice(p, n, F.size(p)), "\n\n"))).otherwise(by_length)
    return F.when(n == 1, F.array(whole)).otherwise(T.let(pieces, by_lines))


def _best_cut(text: Column, ideal: Column, least: Column, most: Column) -> Column:
    """The best place from least to most near ideal. Everything that is used more than once is bound first."""
    def within(to: Column) -> Column:
        bounds = F.struct(F.greatest(least, to - NEAR).alias("lo"), F.least(most, to + NEAR).alias("hi"), to.alias("to"))
        # from the character before lo on
        near = lambda b: T.let(F.struct(F.substring(text, b["lo"], b["hi"] - b["lo"] + 2).alias("w"), b["lo"].alias("lo"), b["hi"].alias("hi"), b["to"].alias("to")), _ranked)
        return T.let(bounds, lambda b: F.when(b["lo"] > b["hi"], b["to"]).otherwise(near(b)))

    return T.let(F.greatest(least, F.least(most, ideal)), within)


def _ranked(x: Column) -> Column:
    """The place nearest to x.to of the best kind there is. A string with a mark for each place is searched from there to both sides: a look at
    each place by itself took nine tenths of the whole."""
    to = x["to"]

    def nearest(marks: Column, mark: str) -> Column:
        back = F.instr(F.reverse(F.left(marks, to - x["lo"] + 1)), F.lit(mark))
        ahead = F.instr(F.substring(marks, to - x["lo"] + 2, x["hi"] - to), F.lit(mark))
        return T.let(F.struct(back.alias("back"), ahead.alias("ahead")), lambda d: F.when((d["back"] > 0) & ((d["ahead"] == 0) | (d["back"] - 1 <= d["ahead"])), to - d["back"] + 1).when(d["ahead"] > 0, to + d["ahead"]))

    def between(chars: Column) -> Column:
        # w before w: within a word; what stands before a phrase's end is as good a place as the end
        marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(chars, "[^w.,]", "o"), "w(?=w)", "x"), "[wo](?=,)", ",")
        return T.let(F.translate(F.left(marks, x["hi"] - x["lo"] + 1), "w", "o"), lambda m: F.coalesce(nearest(m, ","), nearest(m, "o"), to))

    return T.let(F.translate(x["w"], *CHARS), lambda chars: F.coalesce(nearest(chars, "."), between(chars)))


def restored(manifest: DataFrame, outputs: DataFrame, key: str, output: str = "output_text") -> DataFrame:
    """(key, paragraph, text): the revised chunks (key, chunk_id, output) as paragraphs again, as many as there were; a chunk without an output keeps its text."""
    both = manifest.join(outputs.select(key, "chunk_id", F.col(output).alias("_out")), [key, "chunk_id"], "left")
    parts = both.select(key, "first", F.posexplode(cut_back(F.coalesce("_out", "text"), F.col("lengths"))).alias("_at", "text"))
    return parts.select(key, (F.col("first") + F.col("_at")).alias("paragraph"), "text")
