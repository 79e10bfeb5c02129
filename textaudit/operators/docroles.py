"""Roles of a document's ordered units: rules over each unit, the part of the document that is its text, a phase that runs on, and runs of equal roles.

What may be edited is decided the careful way round: a unit must stand in the text's scope, be of a phase that is text, and show that it
is prose; a rule that speaks against it decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textaudit.functions import role_values as V

def facts(units: DataFrame, text: str = "text", style: str | None = None, numbered: str | None = None, outline: str | None = None) -> DataFrame:
    """Adds a struct is_, with a boolean for each rule of role_values. Null texts are empty."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    own = {
        "t": t, "n": bare(t), "s": bare(F.coalesce(F.col(style), F.lit(""))) if style else F.lit(""), "numbered": F.coalesce(F.col(numbered), F.lit(False)) if numbered else F.lit(False),
        "outline": F.col(outline).cast("int") if outline else F.lit(None).cast("int"),
    }
    named = units.select(F.struct("*").alias("_unit"), *[c.alias(k) for k, c in own.items()])
    return named.select("_unit", F.struct(*[F.expr(rule).alias(k) for k, rule in V.rules(True).items()]).alias("is_")).select("_unit.*", "is_")


def scoped(units: DataFrame, key: str, order: str, has: str = "is_") -> DataFrame:
    """Adds scope_start and scope_end, the first and last order of a document's text (null: it has none).

    It starts with the abstract, or else with the first unit that begins a body. It ends before the first of what comes after it: a run of two reference
    entries or more, or a heading of references or back matter; behind an acknowledgement these are looked for only after it, and other
    headings end it, too. A document without any of these is text to its end.
    """
    is_ = lambda k: F.col(has)[k]
    w, all_ = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    at = F.col(order)
    u = units.withColumn("scope_start", F.coalesce(F.min(F.when(is_("abstract"), at)).over(all_), F.min(F.when(is_("body"), at)).over(all_)))
    u = u.withColumn("_ack", F.min(F.when(is_("acknowledgement") & (at >= F.col("scope_start")), at)).over(all_)).withColumn("_from", F.coalesce("_ack", "scope_start"))
    u = u.withColumns({"_next": F.coalesce(F.lead(is_("entry")).over(w), F.lit(False)), "_before": F.coalesce(F.lag(is_("entry")).over(w), F.lit(False)), "_prev": F.lag(order).over(w)})
    starts = lambda first: is_("entry") & F.col("_next") & (~F.col("_before") | (F.col("_prev") < first))
    # a run that is under way where the search begins starts there: the unit behind _from has _from itself before it
    ends = F.when(F.col("_ack").isNotNull(), is_("after_acknowledgement")).otherwise(is_("references") | is_("back_matter"))
    boundary = F.when((at > F.col("_from")) & (is_("entry") & F.col("_next") & (~F.col("_before") | (F.col("_prev") == F.col("_from"))) | ends), F.struct(at.alias("at"), F.col("_prev").alias("before")))
    u = u.withColumn("_end", F.min(boundary).over(all_)).withColumn("_last", F.max(order).over(all_))
    u = u.withColumn("scope_end", F.when(F.col("scope_start").isNotNull(), F.when(F.col("_end").isNull(), F.col("_last")).otherwise(F.greatest("scope_start", "_end.before"))))
    u = u.withColumn("run_start", F.coalesce(starts(F.col("scope_start")) & (at >= F.col("scope_start")), F.lit(False)))
    return u.drop("_ack", "_from", "_next", "_before", "_prev", "_end", "_last")


def classify(units: DataFrame, key: str, order: str, text: str = "text", style: str | None = None, numbered: str | None = None, outline: str | None = None, in_table: str | None = None) -> DataFrame:
    """Adds scope_start, scope_end, phase, role and editable. Order must be unique in a document; null texts are empty.

    phase: outside, abstract, body, acknowledgements, references or back_matter: the last of the latter three that began holds on; else that
    of the last start of an abstract or a body. role: the first that fits. editable: body_prose, abstract_body and body_list.
    """
    is_ = lambda k: F.col("is_")[k]
    u = scoped(facts(units, text, style, numbered, outline), key, order)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce((F.col(order) >= F.col("scope_start")) & (F.col(order) <= F.col("scope_end")), F.lit(False))
    table = F.coalesce(F.col(in_table), F.lit(False)) if in_table else F.lit(False)
    runs_on = F.col("run_start") & ~is_("toc_heading") & ~is_("toc_entry") & ~table & ~is_("formula")
    strong = F.when(is_("acknowledgement"), "acknowledgements").when(is_("references"), "references").when(is_("back_matter"), "back_matter").when(runs_on, "references")
    # a heading of several kinds: its role is tried in another order, and the phase follows the role
    after = F.when(is_("toc_heading") | is_("toc_entry") | table | is_("formula"), strong).when(is_("back_matter"), "back_matter").when(is_("references"), "references").otherwise(strong)
    weak = F.when(is_("abstract"), "abstract").when(is_("body"), "body")
    u = u.withColumn("_in", inside).withColumns({"_strong": F.when(F.col("_in"), after), "_weak": F.when(F.col("_in"), weak)})
    held, soft = F.last("_strong", ignorenulls=True).over(w), F.last("_weak", ignorenulls=True).over(w)
    u = u.withColumn("phase", F.when(~F.col("_in"), "outside").otherwise(F.coalesce(held, soft, F.lit("body"))))
    role = (
        F.when(F.col("scope_start").isNull() | (F.col(order) < F.col("scope_start")), "front_matter").when(~F.col("_in"), "back_matter").when(is_("toc_heading"), "toc_heading").when(is_("toc_entry"), "toc_entry")
        .when(table, "table_content").when(is_("formula"), "equation").when(is_("back_matter"), "back_matter").when(is_("references"), "references_heading").when(is_("acknowledgement"), "acknowledgement_heading")
        .when(F.col("run_start") | (F.col("phase") == "references"), "reference_entry").when(F.col("phase") == "back_matter", "back_matter").when(F.col("phase") == "acknowledgements", "acknowledgement_body")
        .when(is_("heading"), "heading").when(is_("caption"), "caption").when(is_("note"), "note").when(is_("keywords"), "keywords").when(~is_("prose"), "ambiguous_non_prose")
        .when(is_("body_item") | (F.coalesce(F.col(numbered), F.lit(False)) if numbered else F.lit(False)), "body_list").when(F.col("phase") == "abstract", "abstract_body").otherwise("body_prose")
    )
    out = u.withColumn("role", role).withColumn("editable", F.col("role").isin("body_prose", "abstract_body", "body_list"))
    return out.drop("is_", "run_start", "_in", "_strong", "_weak")


def sections(classified: DataFrame, key: str, order: str) -> DataFrame:
    """Runs of neighbouring units of one phase and role."""
    from .events import sections as runs

    return runs(classified.withColumn("_state", F.concat_ws("/", "phase", "role")), key, order, "_state").withColumnRenamed("_state", "state")
