"""A history from nested records: documents with arrays of rounds become flat rounds and references to artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaudit.functions import text as T
from textaudit.operators.history import latest

# --- fixed values: what lies beside an output, and what is exported from it -------------------------------------------
BESIDE = ("_checkpoint.json", "_compare.json", "_quality.json", "_bodymap.json", "_body_map.json", "_validation.json")
EXPORTED = (".txt", ".docx", ".audit.json", ".guard.json")
EXPORTS, PREFLIGHTS, REVIEWED, PREFLIGHT = "finish/web_exports/", "finish/intermediate/", "_reviewed", "_format_preflight.json"
DECISIONS = "_review_decisions.json"


def normal_path(path: Column) -> Column:
    """Trimmed, with forward slashes, without './' at the start and double slashes; null for an empty one."""
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<!:)/{2,}", "/"), r"^(?:\./)+", "")
    odd = lambda p: F.contains(p, F.lit("//")) | F.startswith(p, F.lit("./"))
    return T.let(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), lambda p: F.nullif(F.when(odd(p), clean(p)).otherwise(p), F.lit("")))


def stem(path: Column) -> Column:
    """The path without the last extension of its file name."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def derived_paths(output: Column) -> Column:
    """The paths that follow from an output's: six beside it, and for the export and the reviewed export four files and a preflight each."""
    def of(x: Column) -> Column:
        exports = [F.concat(F.lit(folder), x["name"], F.lit(mark + end)) for mark in ("", REVIEWED) for folder, end in (*((EXPORTS, e) for e in EXPORTED), (PREFLIGHTS, PREFLIGHT))]
        return F.array(*[F.concat(x["whole"], F.lit(end)) for end in BESIDE], *exports)

    return T.let(T.let(stem(output), lambda whole: F.struct(whole.alias("whole"), F.regexp_replace(whole, "^.*/", "").alias("name"))), of)


def flat_rounds(records: DataFrame, key: str, rounds: str, identity: tuple[str, ...], *order: str) -> DataFrame:
    """One row per round of records (key, rounds: array<struct>): of rounds of a key that agree on identity the last by order stays.

    Null keys, null arrays and null rounds give no row; keys are normalised as paths where they are strings.
    """
    flat = records.select(F.col(key), F.explode(rounds).alias("_r")).where("_r is not null").select(key, "_r.*")
    if dict(records.dtypes)[key] == "string":
        flat = flat.withColumn(key, normal_path(F.col(key)))
    return last_rounds(flat.where(F.col(key).isNotNull()), (key, *identity), *order)


def last_rounds(rounds: DataFrame, identity: tuple[str, ...], *order: str) -> DataFrame:
    """Of rounds with the same identity the last by order, with map-side maxima."""
    packed = rounds.withColumn("_id", F.struct(*identity)).drop(*identity)
    return latest(packed, "_id", *order).select("_id.*", *[c for c in packed.columns if c != "_id"])


def artifact_refs(rounds: DataFrame, keys: list[str], fields: list[str], output: str | None = None, compare: str | None = None) -> DataFrame:
    """(keys, path, role, derived): a reference for each path field of a round, for what its output implies, and for the decisions
    beside its comparison. Of a round each (path, role) is one reference; empty and null paths are none."""
    ref = lambda path, role, derived: F.struct(path.alias("path"), F.lit(role).alias("role"), F.lit(derived).alias("derived"))
    # roles differ between fields, so paths are made distinct by role, as strings
    refs = F.array(*[ref(normal_path(F.col(f)), f, False) for f in dict.fromkeys(fields)])
    if output:
        implied = F.array_distinct(F.transform(derived_paths(normal_path(F.col(output))), normal_path))
        refs = F.concat(refs, F.transform(implied, lambda p: ref(p, "derived_from_output", True)))
    if compare:
        refs = F.concat(refs, F.array(ref(normal_path(F.concat(stem(normal_path(F.col(compare))), F.lit(DECISIONS))), "review_decisions", True)))
    return rounds.select(*keys, F.explode(F.filter(refs, lambda r: r["path"].isNotNull())).alias("_r")).select(*keys, "_r.*")
