"""Lines of texts that hold what shouldn't be published: keys, tokens, private addresses, personal paths, broken characters.

One alternation of all rules looks at each text, and again at each line of those that have any; only lines that it finds are looked at rule by
rule, as one line may break several. Nothing is shuffled but by the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: (code, pattern, group of the value, whether each match counts and may be exempt) --------------------
RULES = (
    ("secret.openai_key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", 0, True), ("secret.anthropic_key", r"\bsk-ant-[A-Za-z0-9_-]{20,}\b", 0, True), ("secret.github_token", r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b", 0, True),
    ("secret.aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", 0, True), ("secret.jwt", r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\b", 0, True),
    ("secret.assignment", r"""(?i)(?:^|[^\w])(?:[A-Z0-9_]*?(?:api[_-]?key|secret|token|password))\s*[:=]\s*['"]([^'"]{16,})['"]""", 1, True),
    ("secret.provider_url", r"""(?i)(?:^|[^\w])(?:[A-Z0-9_]*?(?:base[_-]?url|api[_-]?base|provider[_-]?url|model[_-]?endpoint|endpoint)|baseUrl|apiBase|providerUrl|modelEndpoint)\s*[:=]\s*['"]?(https?://[^\s,'"}]+)""", 1, True),
    ("path.windows_user", r"""\b[A-Za-z]:[\\/](?:Users|ChromeDownloads|Downloads|Desktop|Documents)[\\/][^\s`'"<>]+""", 0, False), ("path.user_home", r"""(?:^|[^%$])(?:/Users|/home|/root)/[^\s`'"<>]+""", 0, False),
    ("text.mojibake_replacement", "\ufffd|锟斤拷", 0, False), ("text.mojibake_question_marks", r"\?{4,}", 0, False),
)
PLACEHOLDERS = r"(?i)\.\.\.|<|>|example|placeholder|replace|your|xxx"
INTERPOLATED = r"""\$\{[^}]+\}|^\s*['"]*\$|os\.environ|os\.getenv"""
PUBLIC_URL = r"(?i)^(?:https?://)?(?:(?:127\.0\.0\.1|localhost|0\.0\.0\.0)(?::\d+)?|example\.com|example\.org|example\.net)(?:/.*)?$"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ANY = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for _, p, _, _ in RULES)


def redacted(value: Column) -> Column:
    v = F.trim(value)
    return F.when(F.length(v) <= 10, "***").otherwise(F.concat(F.left(v, F.lit(4)), F.lit("…"), F.right(v, F.lit(4))))


def _exempt(code: str, value: Column) -> Column:
    if code == "secret.provider_url":
        bare = F.regexp_replace(F.trim(value), r"""^['"`<>.,;]+|['"`<>.,;]+$""", "")
        return (bare == "") | bare.rlike(PUBLIC_URL)
    return value.rlike(PLACEHOLDERS) | value.rlike(INTERPOLATED)


def scan(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, code, match, preview): one row for each secret that a line holds, and one for each other rule that it breaks; line and match from 1.

    preview: the line without white space around it, its first 180 characters, with that secret shortened (other ones of the line have rows of their own). Placeholders, variables and public addresses are no secrets. Null
    texts hold nothing; rows that share a key are scanned each.
    """
    hits = texts.where(F.col(text).rlike(ANY)).select(key, F.posexplode(F.split(F.col(text), LINE_END)).alias("_at", "_line")).where(F.col("_line").rlike(ANY))
    line, issues = F.col("_line"), []
    for code, pattern, group, each in RULES:
        found = F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
        if each:
            issues.append(F.transform(F.filter(found, _not_exempt(code)), _as_issue(code, line)))
        else:
            issues.append(F.when(line.rlike(pattern), F.array(F.struct(F.lit(code).alias("code"), F.lit(1).alias("match"), F.left(F.trim(line), F.lit(180)).alias("preview")))).otherwise(F.array().cast("array<struct<code: string, match: int, preview: string>>")))
    out = hits.select(key, (F.col("_at") + 1).alias("line"), F.explode(F.concat(*issues)).alias("_i"))
    return out.select(key, "line", "_i.code", "_i.match", "_i.preview")


def _not_exempt(code: str):
    return lambda v: ~_exempt(code, v)


def _as_issue(code: str, line: Column):
    def issue(v: Column, i: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), (i + 1).cast("int").alias("match"), F.left(F.trim(F.replace(line, v, redacted(v))), F.lit(180)).alias("preview"))

    return issue


def counts(issues: DataFrame, key: str) -> DataFrame:
    """(code, issues, lines, texts), by code."""
    return issues.groupBy("code").agg(F.count("*").alias("issues"), F.count_distinct(key, "line").alias("lines"), F.count_distinct(key).alias("texts"))
