"""The writing-quality audit of a text table: metrics, 13 rules, 5 dimensions, stages, deltas, hotspots, next step.

A relative diagnostic over fixed rules; not a detector of who or what wrote a text. Metrics are computed inside each row
(arrays and regular expressions), so the only shuffles are those of rankings and joins that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T

STRUCTURE_LEAST, STRUCTURE_SHARE = 8, 9000


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics of a whole text. Densities, shares and coefficients of variation are whole ten thousandths (rounded half up)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_t", T.unix_lines(t)).withColumn("language", T.language(F.col("_t"))).withColumn("_s", T.sentences(F.col("_t")))
    en = F.col("language") == "en"
    n = F.size("_s")
    count = lambda zh, en_: F.when(en, T.count_of(F.col("_t"), en_)).otherwise(T.count_of(F.col("_t"), zh))
    only_zh = lambda p: F.when(en, F.lit(0)).otherwise(T.count_of(F.col("_t"), p))
    classes = F.transform("_s", T.structure_class)
    per_class = F.transform(F.array(*map(F.lit, L.STRUCTURES)), lambda c: F.size(F.filter("_classes", lambda x: x == c)))
    out = out.withColumns({
        "sentence_count": n, "_l": F.transform("_s", lambda x: F.length(x)),
        "_p": F.transform(T.paragraphs(F.col("_t")), lambda p: F.length(F.regexp_replace(p, r"(?U)\s+", ""))),
        "connector_count": count(L.any_of(L.CONNECTORS_ZH), r"(?i)\b" + L.any_of(L.CONNECTORS_EN) + r"\b"),
        "template_count": count(L.any_of(L.TEMPLATES_ZH), r"(?i)\b" + L.any_of(L.TEMPLATES_EN) + r"\b"),
        "closing_count": T.count_of(F.col("_t"), "(?i)" + L.any_of(L.CLOSINGS)),
        "burst_count": only_zh(L.any_of(L.BURST)), "padding_count": only_zh(L.any_of(L.PADDING)), "passive_count": only_zh(L.any_of(L.PASSIVE)),
        "idiom_count": only_zh(L.any_of(L.IDIOMS)), "nested_number_count": only_zh(L.NESTED_NUMBER), "colon_parallel_count": only_zh(L.COLON_PARALLEL),
        "_classes": F.when(en, F.array().cast("array<string>")).otherwise(classes),
        "_open": F.filter(F.transform("_s", T.opening_signature), lambda x: F.length(x) >= 2),
    })
    out = out.withColumns({
        "paragraph_count": F.size("_p"), "sentence_variation": T.variation(F.col("_l")),
        "short_sentences": F.size(F.filter("_l", lambda x: x <= 6)),
        "paragraph_variation": F.when(F.size("_p") >= 2, T.variation(F.col("_p"))).otherwise(F.lit(0).cast("long")),
        "paragraph_uniformity": uniformity(F.col("_p")), "_per_class": per_class, "structure_total": F.size("_classes"),
        "opening_top": most_often(F.col("_open")),
        "opening_total": F.size("_open"),
    })
    top = F.array_max("_per_class")
    named = F.element_at(F.array(*map(F.lit, L.STRUCTURES)), F.array_position("_per_class", top).cast("int"))
    out = out.withColumns({
        "dominant_structure": F.when(F.col("structure_total") >= 3, named).otherwise(""),
        "structure_share": F.when(F.col("structure_total") >= 3, per_10000(top, F.col("structure_total"))).otherwise(F.lit(0).cast("long")),
    })
    return out.drop("_s", "_classes", "_open", "_per_class")


def per_10000(count: Column, of: Column) -> Column:
    return F.floor(count.cast("double") / F.greatest(of, F.lit(1)) * 10000 + 0.5).cast("long")


def most_often(values: Column) -> Column:
    """How often the commonest value occurs (0 for none), in one pass over the sorted values: whole books have many."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

    return F.aggregate(F.array_sort(values), start, step, lambda a: a["top"])


def uniformity(lengths: Column) -> Column:
    """Mean of min / max of neighbouring lengths, in ten thousandths; 0 for fewer than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(lengths) - 1), lambda i: F.least(F.get(lengths, i), F.get(lengths, i - 1)).cast("double") / F.greatest(F.get(lengths, i), F.get(lengths, i - 1), F.lit(1)))
    mean = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.size(lengths) - 1)
    return F.when(F.size(lengths) >= 2, F.floor(mean * 10000 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def risks(df: DataFrame) -> DataFrame:
    """Adds risks: array<struct<code, level, points, dimension>> in rule order, to rows with metrics."""
    n = F.col("sentence_count")
    d = lambda c: per_10000(F.col(c), n)
    high_if = lambda c: F.when(c, "high").otherwise("medium")
    some = F.trim(F.regexp_replace("_t", r"(?U)\s+", "")) != ""
    rules = (
        ("connector_overuse", d("connector_count") >= 4000, high_if(d("connector_count") >= 6500)),
        ("template_phrase_density", d("template_count") >= 1800, F.lit("high")),
        ("generic_closing_phrase", F.col("closing_count") >= 1, high_if((F.col("closing_count") >= 2) | (n <= 3))),
        ("abstract_padding_density", d("padding_count") >= 2200, F.lit("high")),
        ("mechanical_burst_pattern", (d("burst_count") >= 4500) & (d("connector_count") >= 3500), F.lit("medium")),
        ("passive_voice_overuse", (n >= 2) & (d("passive_count") >= 4000), high_if(d("passive_count") >= 7000)),
        ("chengyu_density_high", (n >= 2) & (d("idiom_count") >= 4000), F.lit("medium")),
        ("nested_number_scaffold", (n >= 2) & (F.col("nested_number_count") >= 3) & (d("nested_number_count") >= 4500), F.lit("medium")),
        ("colon_parallel_scaffold", (F.col("colon_parallel_count") >= 1) & ((d("colon_parallel_count") >= 2000) | (F.col("colon_parallel_count") >= 2)), F.lit("medium")),
        ("low_burstiness_ratio", (n >= 6) & (F.col("sentence_variation") < 1300), F.lit("medium")),
        ("sentence_fragment_gaming", (n >= 5) & (F.col("short_sentences") >= 2) & (d("short_sentences") >= 2500), F.lit("medium")),
        ("structure_template_concentration", (F.col("structure_total") >= STRUCTURE_LEAST) & F.col("dominant_structure").isin("plain_active", "enumerative") & (F.col("structure_share") >= STRUCTURE_SHARE), F.lit("medium")),
        ("paragraph_length_symmetry", (F.col("paragraph_count") >= 3) & (F.col("paragraph_variation") < 1200) & (F.col("paragraph_uniformity") >= 8500), F.lit("medium")),
    )
    of = {code: dim for dim, codes, _ in L.DIMENSIONS for code in codes}
    found = F.array(*[F.when(cond & some, F.struct(F.lit(code).alias("code"), level.alias("level"), F.when(level == "high", L.POINTS["high"]).otherwise(L.POINTS["medium"]).alias("points"), F.lit(of[code]).alias("dimension"))) for code, cond, level in rules])
    return df.withColumn("risks", F.filter(found, lambda r: r.isNotNull()))


def audit(df: DataFrame, text: str = "text") -> DataFrame:
    """One stage: metrics, risks and their sums (risk_count, high_count, risk_points, risk_codes)."""
    out = risks(metrics(df, text))
    return out.withColumns({
        "risk_count": F.size("risks"), "high_count": F.size(F.filter("risks", lambda r: r.level == "high")),
        "risk_points": F.aggregate("risks", F.lit(0), lambda a, r: a + r.points), "risk_codes": F.array_join(F.transform("risks", lambda r: r.code), ","),
    }).drop("_t", "_l", "_p")


def dimensions(audited: DataFrame, *keys: str) -> DataFrame:
    """A row for each key and dimension, with zeros where a dimension has no risk."""
    rows = F.explode(F.array(*[F.lit(d[0]) for d in L.DIMENSIONS]))
    out = audited.select(*keys, "risks", rows.alias("dimension"))
    mine = F.filter("risks", lambda r: r.dimension == F.col("dimension"))
    out = out.withColumn("_m", mine).select(
        *keys, "dimension", F.size("_m").alias("risk_count"), F.size(F.filter("_m", lambda r: r.level == "high")).alias("high_count"),
        F.aggregate("_m", F.lit(0), lambda a, r: a + r.points).alias("risk_points"),
    )
    status = F.when((F.col("high_count") > 0) | (F.col("risk_points") >= 4), "focus").when(F.col("risk_count") > 0, "watch").otherwise("clear")
    return out.withColumn("status", status)


def stage_delta(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Points of two stages by dimension, with the trend; a dimension without a baseline counts as 0 before."""
    b = before.select(*keys, "dimension", F.col("risk_points").alias("before_points"))
    out = after.select(*keys, "dimension", F.col("risk_points").alias("after_points")).join(b, [*keys, "dimension"], "left")
    out = out.withColumn("before_points", F.coalesce("before_points", F.lit(0))).withColumn("point_change", F.col("after_points") - F.col("before_points"))
    return out.withColumn("trend", F.when(F.col("point_change") < 0, "improved").when(F.col("point_change") > 0, "regressed").otherwise("stable"))


def summarize_delta(delta: DataFrame, *keys: str) -> DataFrame:
    """Sums of a stage delta; the relative change (tenths of a per cent, half up) is null where nothing was there before."""
    out = delta.groupBy(*keys).agg(
        F.sum("before_points").alias("before_points"), F.sum("after_points").alias("after_points"), F.sum("point_change").alias("point_change"),
        *[F.count_if(F.col("trend") == t).alias(t) for t in ("improved", "regressed", "stable")],
    )
    return out.withColumn("change_permille", F.when(F.col("before_points") > 0, F.floor(F.col("point_change") * 1000 / F.col("before_points") + 0.5)))


def hotspots(df: DataFrame, key: str, order: list[str], text: str = "text", limit: int = L.MOST_HOTSPOTS) -> DataFrame:
    """The `limit` riskiest texts of each key: by points, high risks, number of risks, then the given order."""
    w = Window.partitionBy(key).orderBy(F.desc("risk_points"), F.desc("high_count"), F.desc("risk_count"), *order)
    # texts without risks sort last; a filter before the window would be pushed down with a second copy of the audit in it
    found = audit(df, text).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= limit) & (F.col("risk_count") > 0))
    return found.withColumn("excerpt", T.excerpt(F.col(text)))


def recommendations(delta: DataFrame, dims: DataFrame, *keys: str, limit: int = 3) -> DataFrame:
    """The dimensions to work on first: regressed ones, then by points and high risks, in registry order on ties."""
    names = F.array(*[F.lit(d[0]) for d in L.DIMENSIONS])
    rows = dims.where("risk_points > 0").join(delta.select(*keys, "dimension", "trend"), [*keys, "dimension"], "left").withColumn("trend", F.coalesce("trend", F.lit("stable")))
    w = Window.partitionBy(*keys).orderBy((F.col("trend") != "regressed").cast("int"), F.desc("risk_points"), F.desc("high_count"), F.array_position(names, F.col("dimension")))
    can = F.col("dimension").isin(*[d[0] for d in L.DIMENSIONS if d[2]])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("executable", can)


def primary_dimension(recommended: DataFrame, *keys: str) -> DataFrame:
    """The dimension to decide about, per key: the first that can be executed on some target, else the first manual one, else the first.

    recommended: rows of recommendations(); a column targets (texts to work on), where there is one, says how many; else each has one.
    """
    targets = F.col("targets") if "targets" in recommended.columns else F.lit(1)
    kind = F.when(F.col("executable") & (targets > 0), 0).when(~F.col("executable"), 1).otherwise(2)
    best = recommended.groupBy(*keys).agg(F.min(F.struct(kind.alias("kind"), "rank", "dimension", "trend", "executable", "high_count", targets.alias("targets"))).alias("m"))
    return best.select(*keys, F.col("m.dimension").alias("target"), F.col("m.trend").alias("trend"), F.col("m.executable").alias("executable"), F.col("m.high_count").alias("high_count"), F.col("m.targets").alias("targets"))


def next_step(summary: DataFrame, recommended: DataFrame, *keys: str, state: DataFrame | None = None, delta: DataFrame | None = None) -> DataFrame:
    """One of blocked, stop, next_dimension, manual_review, targeted_rerun per key; the first that applies:

    blocked: the contract isn't ready. stop: no points. next_dimension: there is but the source. manual_review: the primary dimension
    can't be executed. targeted_rerun: it regressed or has a high risk. next_dimension: there is a next one, and the bound dimension
    improved or has no points left. targeted_rerun: there are targets. stop.

    state (key, ready, source_only, has_next, bound): a null or a missing row counts as ready, not source only, without a next
    dimension and without a bound one. delta: the stage delta, where bound dimensions are looked up.
    """
    out = summary.join(primary_dimension(recommended, *keys), list(keys), "left")
    if state is None:
        out = out.withColumns({"ready": F.lit(True), "source_only": F.lit(False), "has_next": F.lit(False), "bound": F.lit(None).cast("string")})
    else:
        out = out.join(state.select(*keys, "ready", "source_only", "has_next", "bound"), list(keys), "left")
    advanced = F.lit(False)
    if delta is not None:
        of_bound = delta.select(*keys, F.col("dimension").alias("bound"), ((F.col("trend") == "improved") | (F.col("after_points") <= 0)).alias("_advanced"))
        out, advanced = out.join(of_bound, [*keys, "bound"], "left"), F.coalesce("_advanced", F.lit(False))
    step = (
        F.when(~F.coalesce("ready", F.lit(True)), "blocked").when(F.col("after_points") <= 0, "stop").when(F.coalesce("source_only", F.lit(False)), "next_dimension")
        .when(~F.coalesce("executable", F.lit(False)), "manual_review").when((F.col("trend") == "regressed") | (F.col("high_count") > 0), "targeted_rerun")
        .when(F.coalesce("has_next", F.lit(False)) & advanced, "next_dimension").when(F.col("targets") > 0, "targeted_rerun").otherwise("stop")
    )
    return out.select(*keys, "before_points", "after_points", "target", step.alias("decision"))
