"""What a revision's sentences repeat more often than its source's: opening families and frames, by chunk and by document, and the evidence of it.

Counters are additive: one grouped sum of both sides' sentences gives the chunks' counts, sums of these the documents' (partial
and final sums are the same operation), so nothing is joined but a chunk's growing patterns with its document's counts.
Digests are additive, too: a set's digest is the sum of its members' hashes, so it needs no order and no list in one task.
They show errors and partial writes; they are no signature, as sums can be forged.

Evidence is a row that can be checked without the texts: ``broken`` recomputes what follows from its other fields and names
the first thing that doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T

REPEATED_OPENING, REPEATED_FRAME = "repeated_opening_family_introduced", "repeated_sentence_skeleton_introduced"
COLLAPSED, FRAGMENTED = "sentence_boundary_collapse_introduced", "sentence_fragmentation_introduced"
KINDS = (("opening", REPEATED_OPENING, "opening_family_delta_observed"), ("skeleton", REPEATED_FRAME, "sentence_skeleton_delta_observed"))
SHORT = 6
#: Patterns that evidence lists, of a chunk and of a document; all are counted.
LISTED, LISTED_OF_DOCUMENT = 12, 24
_PARTS = 4


# --- digests ----------------------------------------------------------------------------------------------------------
def hash_sums(payload: Column) -> list[Column]:
    """Aggregates that together are the digest of a set: sums of four 60-bit parts of its members' SHA-256."""
    h = F.sha2(payload, 256)
    return [F.coalesce(F.sum(F.conv(F.substring(h, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)") for k in range(_PARTS)]


def digest_of_sums(head: list[Column], sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws(":", *[x.cast("string") for x in (*head, *sums)]), 256)


# --- counters ---------------------------------------------------------------------------------------------------------
def sentence_facts(text: Column) -> Column:
    """array<struct<opening, skeleton, size>> of a text's sentences; size without white space."""
    fact = lambda s: T.let(T.sentence_patterns(s), lambda p: F.struct(p["opening"].alias("opening"), p["skeleton"].alias("skeleton"), T.solid_length(s).alias("size")))
    return F.transform(T.careful_sentences(text), fact)


def chunk_patterns(chunks: DataFrame, keys: list[str], a: str = "input_text", b: str | None = "output_text") -> DataFrame:
    """(keys, kind, pattern, n_in, n_out): how often each pattern stands in either text; n_out is 0 without a column b. Null texts are empty."""
    def side(k: int, c: str) -> Column:
        return F.transform(T.careful_sentences(F.coalesce(F.col(c), F.lit(""))), lambda x: F.struct(F.lit(k).alias("side"), T.sentence_patterns(x).alias("p")))

    s = chunks.select(*keys, F.explode(F.concat(*[side(k, c) for k, c in enumerate((a, b)) if c])).alias("s"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("s.p")[k].alias("pattern")) for k, *_ in KINDS])
    counted = s.select(*keys, "s.side", F.explode(kinds).alias("p")).groupBy(*keys, "p.kind", "p.pattern")
    return counted.agg(*[F.count_if(F.col("side") == k).alias(n) for k, n in enumerate(("n_in", "n_out"))])


def merged(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of finer keys, added up."""
    return patterns.groupBy(*keys, "kind", "pattern").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def profiles(patterns: DataFrame, chunks: DataFrame, doc: str, text: str = "input_text", n: str = "n_in") -> DataFrame:
    """(doc, chunks, sentences, openings, skeletons, profile_sha256): a document's pattern baseline, without its words.

    patterns: merged counters of the document; chunks: its chunks, of which blank ones don't count. openings and skeletons are lists of
    (pattern, n), commonest first: there are 22 families and at most 52,800 frames, however long a document is. The digest is
    that of the set of patterns with their counts.
    """
    size = chunks.groupBy(doc).agg(F.count_if(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")) != "").alias("chunks"))
    there = patterns.where(F.col(n) > 0)
    sums = hash_sums(F.concat_ws(":", "kind", "pattern", F.col(n).cast("string")))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col(n)).alias("less"), "pattern"))))
    agg = there.groupBy(doc).agg(F.sum(F.when(F.col("kind") == "opening", F.col(n)).otherwise(0)).alias("sentences"), *[listed(k).alias(f"{k}s") for k, *_ in KINDS], *[c.alias(f"_s{i}") for i, c in enumerate(sums)])
    out = size.join(agg, doc, "left").fillna(0, ["sentences"])
    zero = lambda i: F.coalesce(f"_s{i}", F.lit(0).cast("decimal(38,0)"))
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<less: bigint, pattern: string>>")), lambda x: F.struct(x["pattern"].alias("pattern"), (-x["less"]).alias("n")))
    digest = digest_of_sums([F.lit("profile"), F.col("chunks"), F.col("sentences")], [zero(i) for i in range(_PARTS)])
    return out.select(doc, "chunks", "sentences", plain("openings").alias("openings"), plain("skeletons").alias("skeletons"), digest.alias("profile_sha256"))


# --- sentence boundaries ----------------------------------------------------------------------------------------------
def boundary_delta(a: Column, b: Column) -> Column:
    """struct of the sentence counts of both texts, of those of SHORT characters or less, and whether the revision collapsed or fragmented them.

    a, b: the sizes of the sentences.
    """
    n, m, short, shorter = F.size(a), F.size(b), F.size(F.filter(a, lambda x: x <= SHORT)), F.size(F.filter(b, lambda x: x <= SHORT))
    mean = lambda sizes, count: T.total(F.transform(sizes, lambda x: x.cast("long"))).cast("double") / F.greatest(count, F.lit(1))
    fewer, more = F.greatest(n - m, F.lit(0)), F.greatest(shorter - short, F.lit(0))
    collapsed = (n >= 4) & (fewer >= 3) & (m <= F.greatest(F.lit(1), F.ceil(n / 2))) & (mean(b, m) >= F.greatest(F.lit(36.0), mean(a, n) * 1.45))
    fragmented = (m >= 5) & (more >= 2) & (shorter * 4 >= m)
    return F.struct(
        n.alias("n_in"), m.alias("n_out"), short.alias("short_in"), shorter.alias("short_out"), fewer.alias("fewer"), more.alias("more_short"), collapsed.alias("collapsed"), fragmented.alias("fragmented"),
    )


# --- assessments ------------------------------------------------------------------------------------------------------
def growth(patterns: DataFrame, doc: str, chunk: str, whole: DataFrame | None = None) -> DataFrame:
    """The chunks' patterns that grew, with their documents' counts (null without whole), and whether they block.

    whole: the document's counters before the revision (n_in). The document's count after it is as if this chunk alone were revised.
    """
    rows = patterns.where("n_out > n_in").withColumn("introduced", F.col("n_out") - F.col("n_in"))
    if whole is None:
        rows = rows.withColumn("document_before", F.lit(None).cast("long"))
    else:
        rows = rows.join(whole.select(doc, "kind", "pattern", F.col("n_in").alias("document_before")), [doc, "kind", "pattern"], "left").fillna(0, ["document_before"])
    after = F.greatest(F.lit(0), F.col("document_before") - F.col("n_in")) + F.col("n_out")
    rows = rows.withColumn("document_after", F.when(F.col("document_before").isNotNull(), after))
    rows = rows.withColumn("document_introduced", F.when(F.col("document_before").isNotNull(), F.greatest(F.lit(0), F.col("document_after") - F.col("document_before"))))
    return rows.withColumn("blocks", _blocks(F.struct("n_out", "introduced", "document_after", "document_introduced")))


def _blocks(r: Column) -> Column:
    local = (r["n_out"] >= L.LOCAL_GROWTH[0]) & (r["introduced"] >= L.LOCAL_GROWTH[1])
    return local | F.coalesce((r["document_after"] >= L.DOCUMENT_GROWTH[0]) & (r["document_introduced"] >= L.DOCUMENT_GROWTH[1]), F.lit(False))


_ROW = "struct<pattern: string, n_in: bigint, n_out: bigint, introduced: bigint, document_before: bigint, document_after: bigint, document_introduced: bigint>"
_DOCUMENT_ROW = "struct<pattern: string, n_in: bigint, n_out: bigint, introduced: bigint>"


def _summary(kind: str, row: str, listed: int, after: str) -> Column:
    """Aggregate: struct(introduced, blocking, max_introduced, max_after, patterns) of one kind's growing patterns; patterns in their order, the first `listed` of them."""
    mine, fields = F.col("kind") == kind, [x.split(":")[0].strip() for x in row[7:-1].split(",")]
    rows = F.slice(F.array_sort(F.collect_list(F.when(mine, F.struct(*fields)))), 1, listed).cast(f"array<{row}>")
    most = lambda c: F.coalesce(F.max(F.when(mine, F.col(c))), F.lit(0)).alias
    return F.struct(F.count_if(mine).alias("introduced"), F.count_if(mine & F.col("blocks")).alias("blocking"), most("introduced")("max_introduced"), most(after)("max_after"), rows.alias("patterns")).alias(kind)


def _filled(c: str, row: str) -> Column:
    none = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("introduced", "blocking", "max_introduced", "max_after")], F.array().cast(f"array<{row}>").alias("patterns"))
    return F.coalesce(F.col(c), none).alias(c)


def _codes(boundary: bool) -> tuple[Column, Column]:
    """(blocking, advisory) codes from the summaries."""
    some = lambda *cs: F.filter(F.array(*cs), lambda c: c.isNotNull())
    blocking = [F.when(F.col(k)["blocking"] > 0, code) for k, code, _ in KINDS]
    if boundary:
        blocking += [F.when(F.col("boundary.collapsed"), COLLAPSED), F.when(F.col("boundary.fragmented"), FRAGMENTED)]
    return some(*blocking), some(*[F.when((F.col(k)["introduced"] > 0) & (F.col(k)["blocking"] == 0), code) for k, _, code in KINDS])


def _sealed(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence_sha256", evidence_digest(df.columns))


def evidence_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's fields as JSON, in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if c != "evidence_sha256")), {"ignoreNullFields": "false"}), 256)


def style_delta(pairs: DataFrame, doc: str, chunk: str, a: str = "input_text", b: str = "output_text", document: bool = True) -> DataFrame:
    """Evidence by chunk: (doc, chunk, scope, source_profile_sha256, baseline_sha256, candidate_sha256, opening, skeleton, boundary, blocking_codes,
    advisory_codes, passed, evidence_sha256), one row for each (doc, chunk), which must be unique.

    scope is 'document' where a chunk is judged against its whole document, too, and 'local' without. Null and blank texts have no sentences.
    """
    patterns = chunk_patterns(pairs, [doc, chunk], a, b)
    whole = merged(patterns, [doc]) if document else None
    grown = growth(patterns, doc, chunk, whole).groupBy(doc, chunk).agg(*[_summary(k, _ROW, LISTED, "document_after") for k, *_ in KINDS])
    x, y = (F.coalesce(F.col(c), F.lit("")) for c in (a, b))
    sizes = lambda t: F.transform(T.careful_sentences(t), T.solid_length)
    facts = pairs.select(doc, chunk, F.sha2(F.trim(x), 256).alias("baseline_sha256"), F.sha2(F.trim(y), 256).alias("candidate_sha256"), F.struct(sizes(x).alias("a"), sizes(y).alias("b")).alias("_sizes"))
    facts = facts.withColumn("boundary", boundary_delta(F.col("_sizes.a"), F.col("_sizes.b"))).drop("_sizes")
    out = facts.join(grown, [doc, chunk], "left")
    if document:
        out = out.join(profiles(whole, pairs, doc, a).select(doc, F.col("profile_sha256").alias("source_profile_sha256")), doc)
    else:
        out = out.withColumn("source_profile_sha256", F.lit(""))
    out = out.select(doc, chunk, F.lit("document" if document else "local").alias("scope"), "source_profile_sha256", "baseline_sha256", "candidate_sha256", *[_filled(k, _ROW) for k, *_ in KINDS], "boundary")
    blocking, advisory = _codes(True)
    return _sealed(out.withColumns({"blocking_codes": blocking, "advisory_codes": advisory}).withColumn("passed", F.size("blocking_codes") == 0))


def document_delta(pairs: DataFrame, doc: str, chunk: str, a: str = "input_text", b: str = "output_text") -> DataFrame:
    """Evidence by document: what all its revised chunks together repeat more often. (doc, chunks, baseline_profile_sha256, result_profile_sha256,
    baseline_chunks_sha256, result_chunks_sha256, opening, skeleton, blocking_codes, advisory_codes, passed, evidence_sha256).

    Chunks are cut each by itself, so none runs into the next. The digests of the chunks bind each text to its place.
    """
    whole = merged(chunk_patterns(pairs, [doc, chunk], a, b), [doc])
    grown = whole.where("n_out > n_in").withColumn("introduced", F.col("n_out") - F.col("n_in"))
    grown = grown.withColumn("blocks", (F.col("n_out") >= L.CUMULATIVE_GROWTH[0]) & (F.col("introduced") >= L.CUMULATIVE_GROWTH[1]))
    grown = grown.groupBy(doc).agg(*[_summary(k, _DOCUMENT_ROW, LISTED_OF_DOCUMENT, "n_out") for k, *_ in KINDS])
    bound = {c: hash_sums(F.concat_ws(":", F.col(chunk).cast("string"), F.sha2(F.trim(F.coalesce(F.col(c), F.lit(""))), 256))) for c in (a, b)}
    facts = pairs.groupBy(doc).agg(F.count("*").alias("chunks"), *[s.alias(f"_{k}{i}") for k, c in zip("ab", (a, b), strict=True) for i, s in enumerate(bound[c])])
    side = lambda c, n, name: profiles(whole, pairs, doc, c, n).select(doc, F.col("profile_sha256").alias(name))
    out = facts.join(side(a, "n_in", "baseline_profile_sha256"), doc).join(side(b, "n_out", "result_profile_sha256"), doc).join(grown, doc, "left")
    digests = [digest_of_sums([F.lit("chunks"), F.col("chunks")], [F.col(f"_{k}{i}") for i in range(_PARTS)]).alias(f"{name}_chunks_sha256") for k, name in zip("ab", ("baseline", "result"), strict=True)]
    out = out.select(doc, "chunks", "baseline_profile_sha256", "result_profile_sha256", *digests, *[_filled(k, _DOCUMENT_ROW) for k, *_ in KINDS])
    blocking, advisory = _codes(False)
    return _sealed(out.withColumns({"blocking_codes": blocking, "advisory_codes": advisory}).withColumn("passed", F.size("blocking_codes") == 0))


# --- arbitration ------------------------------------------------------------------------------------------------------
def arbitrate(pairs: DataFrame, doc: str, chunk: str, a: str = "input_text", b: str = "output_text") -> DataFrame:
    """(doc, chunk, accepted, codes): which revised chunks a document can take, in order, before a pattern repeats too often in it.

    A chunk is refused (and its source stays) where with those accepted before it any pattern would reach CUMULATIVE_GROWTH; codes then
    names the kinds. A document that passes with all its chunks takes them all: what one chunk adds another may remove.

    The fold's state is a map of counters. It holds the patterns alone that could reach the limits if every chunk that adds to them were
    taken, and only chunks that change one of these are steps; the others are accepted without it. (doc, chunk) must be unique.
    """
    least, growth_least = L.CUMULATIVE_GROWTH
    patterns = chunk_patterns(pairs, [doc, chunk], a, b)
    change = F.col("n_out") - F.col("n_in")
    whole = patterns.groupBy(doc, "kind", "pattern").agg(F.sum("n_in").alias("base"), F.sum("n_out").alias("all_taken"), F.sum(F.greatest(change, F.lit(0))).alias("added"))
    refused = (F.col("all_taken") >= least) & (F.col("all_taken") - F.col("base") >= growth_least)
    failing = whole.groupBy(doc).agg(F.max(refused).alias("fails")).where("fails").select(doc)
    contended = whole.where((F.col("base") + F.col("added") >= least) & (F.col("added") >= growth_least)).join(failing, doc, "left_semi").select(doc, "kind", "pattern", "base")
    changes = patterns.where("n_out <> n_in").join(contended, [doc, "kind", "pattern"], "left_semi").select(doc, chunk, F.concat_ws(":", "kind", "pattern").alias("k"), change.alias("change"))
    steps = changes.groupBy(doc, chunk).agg(F.map_from_entries(F.collect_list(F.struct("k", "change"))).alias("changes"))
    steps = steps.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(chunk, "changes")), lambda x, y: F.when(x[chunk] < y[chunk], -1).otherwise(1)).alias("steps"))
    state = contended.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "pattern"), F.struct("base", F.col("base").alias("now"))))).alias("state"))
    codes = "array<struct<chunk: " + pairs.schema[chunk].dataType.simpleString() + ", codes: array<string>>>"

    def step(s: Column, x: Column) -> Column:
        def judged(trial: Column) -> Column:
            over = F.map_filter(trial, lambda _, v: (v["now"] >= least) & (v["now"] - v["base"] >= growth_least))
            broken = F.filter(F.array(*[F.when(F.exists(F.map_keys(over), lambda k: F.startswith(k, F.lit(f"{kind}:"))), code) for kind, code, _ in KINDS]), lambda c: c.isNotNull())
            kept = F.struct(s["state"].alias("state"), F.array_append(s["refused"], F.struct(x[chunk].alias("chunk"), broken.alias("codes"))).alias("refused"))
            return F.when(F.size(over) == 0, F.struct(trial.alias("state"), s["refused"].alias("refused"))).otherwise(kept)

        added = F.map_zip_with(s["state"], x["changes"], lambda _, v, d: F.struct(v["base"].alias("base"), (v["now"] + F.coalesce(d, F.lit(0).cast("long"))).alias("now")))
        return T.let(added, judged)

    begin = F.struct("state", F.array().cast(codes).alias("refused"))
    folded = steps.join(state, doc).select(doc, F.explode(F.aggregate("steps", begin, step, lambda s: s["refused"])).alias("r"))
    refused = folded.select(doc, F.col("r.chunk").alias(chunk), F.col("r.codes").alias("codes"))
    out = pairs.select(doc, chunk).join(refused, [doc, chunk], "left")
    return out.select(doc, chunk, F.col("codes").isNull().alias("accepted"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


# --- checking evidence ------------------------------------------------------------------------------------------------
_HASH = "^[0-9a-f]{64}$"
FAMILIES = sorted({k for k, _ in (*L.OPENINGS_ZH, *L.OPENINGS_EN)} | {"cn.plain", "en.plain"})


def _kind_broken(kind: str, listed: int, scope: Column | None) -> list[tuple[str, Column]]:
    """(name, condition that something is wrong) of one kind's summary, in the order in which they are named."""
    s = F.col(kind)
    rows = s["patterns"]
    name = lambda r: r["pattern"].isin(FAMILIES) if kind == "opening" else r["pattern"].rlike(_HASH)
    counts = (s["introduced"] < 0) | (s["blocking"] < 0) | (s["blocking"] > s["introduced"]) | ((s["introduced"] == 0) != (s["max_introduced"] == 0)) | (F.size(rows) != F.least(s["introduced"], F.lit(listed)))
    row = lambda r: ~name(r) | (r["n_in"] < 0) | (r["introduced"] <= 0) | (r["introduced"] != r["n_out"] - r["n_in"])
    most, after = F.array_max(F.transform(rows, lambda r: r["introduced"])), lambda r: r["document_after"]
    if scope is None:
        blocks, after = (lambda r: (r["n_out"] >= L.CUMULATIVE_GROWTH[0]) & (r["introduced"] >= L.CUMULATIVE_GROWTH[1])), lambda r: r["n_out"]
        related = lambda r: F.lit(False)
    else:
        blocks = _blocks
        of_document = lambda r: (r["document_before"] < r["n_in"]) | (r["document_after"] != F.greatest(F.lit(0), r["document_before"] - r["n_in"]) + r["n_out"]) | (r["document_introduced"] != F.greatest(F.lit(0), r["document_after"] - r["document_before"]))
        none = lambda r: r["document_before"].isNotNull() | r["document_after"].isNotNull() | r["document_introduced"].isNotNull()
        related = lambda r: F.when(scope == "document", F.coalesce(of_document(r), F.lit(True))).otherwise(none(r))
    highest = F.coalesce(F.array_max(F.transform(rows, after)), F.lit(0))
    blocking = F.size(F.filter(rows, blocks))
    all_there = s["introduced"] <= listed
    ids = F.transform(rows, lambda r: r["pattern"])
    maxima = (s["max_introduced"] < F.coalesce(most, F.lit(0))) | (s["max_after"] < highest) | (all_there & ((s["max_introduced"] != F.coalesce(most, F.lit(0))) | (s["max_after"] != highest)))
    return [
        (f"{kind}_counts", counts), (f"{kind}_rows", F.exists(rows, lambda r: F.coalesce(row(r), F.lit(True)))), (f"{kind}_document_counts", F.exists(rows, related)), (f"{kind}_order", (ids != F.array_sort(ids)) | (F.size(ids) != F.size(F.array_distinct(ids)))),
        (f"{kind}_maxima", maxima), (f"{kind}_blocking", (blocking > s["blocking"]) | (all_there & (blocking != s["blocking"]))),
    ]


def _first_broken(columns: list[str], hashes: list[str], checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that something fails; evidence with a null in a field that needs a value is torn."""
    torn = F.lit(False)
    for c in columns:
        torn = torn | F.col(c).isNull()
    for k, *_ in KINDS:
        for part in ("introduced", "blocking", "max_introduced", "max_after", "patterns"):
            torn = torn | F.col(k)[part].isNull()
    formats = F.lit(False)
    for h in hashes:
        formats = formats | ~F.col(h).rlike(_HASH)
    blocking, advisory = _codes("boundary" in columns)
    end = [("codes", (F.col("blocking_codes") != blocking) | (F.col("advisory_codes") != advisory)), ("passed", F.col("passed") != (F.size("blocking_codes") == 0)), ("digest", F.col("evidence_sha256") != evidence_digest(columns))]
    return F.coalesce(*[F.when(F.coalesce(wrong, F.lit(True)), name) for name, wrong in (("torn", torn), ("binding", formats), *checks, *end)])


def broken(evidence: DataFrame, doc: str, chunk: str) -> DataFrame:
    """Adds broken to a chunk's evidence: null, or the first of torn, binding, scope, the counts, rows, document_counts, order, maxima and blocking of
    opening and skeleton, boundary, codes, passed, digest that doesn't hold. Evidence is to be trusted where broken is null, and its chunk where passed, too."""
    b, scope = F.col("boundary"), F.col("scope")
    in_scope = ~scope.isin("document", "local") | ((scope == "document") != F.col("source_profile_sha256").rlike(_HASH)) | ((scope == "local") != (F.col("source_profile_sha256") == ""))
    counts = (b["n_in"] < 0) | (b["n_out"] < 0) | (b["short_in"] < 0) | (b["short_out"] < 0) | (b["short_in"] > b["n_in"]) | (b["short_out"] > b["n_out"]) | (b["fewer"] != F.greatest(b["n_in"] - b["n_out"], F.lit(0))) | (b["more_short"] != F.greatest(b["short_out"] - b["short_in"], F.lit(0)))
    follows = (b["fragmented"] != ((b["n_out"] >= 5) & (b["more_short"] >= 2) & (b["short_out"] * 4 >= b["n_out"]))) | (b["collapsed"] & ((b["n_in"] < 4) | (b["fewer"] < 3) | (b["n_out"] > F.greatest(F.lit(1), F.ceil(b["n_in"] / 2)))))
    checks = [("scope", in_scope), *[x for k, *_ in KINDS for x in _kind_broken(k, LISTED, scope)], ("boundary", counts | follows)]
    return evidence.withColumn("broken", _first_broken([c for c in evidence.columns if c not in (doc, chunk, "broken")] + [doc, chunk], ["baseline_sha256", "candidate_sha256"], checks))


def broken_document(evidence: DataFrame, doc: str) -> DataFrame:
    """broken for a document's evidence: torn, binding, chunks, the checks of opening and skeleton, codes, passed, digest."""
    hashes = ["baseline_profile_sha256", "result_profile_sha256", "baseline_chunks_sha256", "result_chunks_sha256"]
    checks = [("chunks", F.col("chunks") < 0), *[x for k, *_ in KINDS for x in _kind_broken(k, LISTED_OF_DOCUMENT, None)]]
    return evidence.withColumn("broken", _first_broken([c for c in evidence.columns if c != "broken"], hashes, checks))
