"""Histograms of stock phrases: how often each connector and template occurs, and the commonest of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T

MOST, LEAST = 5, 2


def phrase_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, phrase, n): connectors and templates, in lower case, by the lists of each text's language. Null texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    english = lambda words: F.regexp_extract_all(t, F.lit(r"(?i)\b" + L.any_of(words) + r"\b"), F.lit(0))
    chinese = lambda words: F.regexp_extract_all(t, F.lit(L.any_of(words)), F.lit(0))
    named = lambda kind, found: F.transform(found, lambda p: F.struct(F.lit(kind).alias("kind"), F.lower(T.collapse(p)).alias("phrase")))
    both = lambda find, c, m: F.concat(named("connector", find(c)), named("template", find(m)))
    found = F.when(T.language(t) == "en", both(english, L.CONNECTORS_EN, L.TEMPLATES_EN)).otherwise(both(chinese, L.CONNECTORS_ZH, L.TEMPLATES_ZH))
    return df.select(key, F.explode(found).alias("p")).groupBy(key, "p.kind", "p.phrase").agg(F.count("*").alias("n"))


def top_counts(counts: DataFrame, *keys: str, value: str = "phrase", limit: int = MOST, least: int = LEAST) -> DataFrame:
    """The `limit` values of each key with the highest counts of at least `least`, ties by value; adds rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.where(F.col("n") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
