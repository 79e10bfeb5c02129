"""Queries over what revisions repeat, and over the evidence of it, with their SQL. A turn is revised by the next one of its conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.operators import deltas, pairs
from textaudit.plans.text_queries import CJK, WORDS, _q, flat_sql, pieces_sql, turn_pairs
from textaudit.sources.tables import table


# --- SQL of careful sentences, openings and frames --------------------------------------------------------------------
_CLOSE, _OPEN = """["''”’)\\]）】》]*""", """["''“‘(\\[（]*"""


def careful_sql(t: str) -> str:
    """Full stops are judged word by word, each with the next."""
    w, x = "p[1]", "p[2]"
    before = f"regexp_replace({w}, '\\.{_CLOSE}$', '')"
    abbreviations = ", ".join(f"'{a}'" for a in L.ABBREVIATIONS)
    letters, token = f"regexp_extract({before}, '[A-Za-z]+$')", f"regexp_extract({before}, '[A-Za-z0-9_.-]+$')"
    held = f"(regexp_matches({before}, '\\p{{Nd}}$') and regexp_matches({x}, '^\\p{{Nd}}')) or lower({letters}) in ({abbreviations}) or length({letters}) = 1 or (contains({token}, '.') and regexp_matches({token}, '\\d'))"
    ends = f"regexp_matches({w}, '\\.{_CLOSE}$') and regexp_matches({x}, '^{_OPEN}[\\p{{Lu}}\\p{{Nd}}㐀-䶿一-鿿]') and not ({held})"
    words = f"string_split(regexp_replace({flat_sql(t)}, '([。！？!?；;]{_CLOSE})', '\\1' || chr(1), 'g'), ' ')"
    marked = f"list_transform(list_zip({words}, list_append(({words})[2:], '')), lambda p: case when {ends} then {w} || chr(1) else {w} end)"
    return pieces_sql(f"string_split(array_to_string({marked}, ' '), chr(1))")


def core_sql(s: str) -> str:
    marker = _q(L.CORE_MARKER).replace("?:", "")
    return f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({s}), '^[“”‘’"'' ]+', ''), '[“”‘’"'' ]+$', ''), '{marker}', ''), '^[，,、：:；;。.!！？?]+', '')"""


def _cases(families, core: str) -> str:
    return " ".join(f"when regexp_matches({core}, '{_q(p)}') then '{k}'" for k, p in families)


def language_sql(core: str) -> str:
    return f"case when {WORDS.format(t=core)} >= 4 and {CJK.format(t=core)} <= 2 then 'en' else 'zh' end"


def family_sql(core: str) -> str:
    return f"case when {language_sql(core)} = 'en' then case {_cases(L.OPENINGS_EN, core)} else 'en.plain' end else case {_cases(L.OPENINGS_ZH, core)} else 'cn.plain' end end"


def frames_ctes(sentences: str, keys: str) -> str:
    """From relation `sentences` (keys, s): relation frames (keys, opening, skeleton, size)."""
    english = f"len(regexp_extract_all('  ' || regexp_replace(m, '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || '  ', '(?i) ({L.CONJUNCTION_EN}) '))"
    count = lambda chars, most: f"least(len(regexp_extract_all(m, '[{chars}]')), {most})"
    bucket = "case when width <= 12 then 'short' when width <= 32 then 'medium' when width <= 64 then 'long' else 'very_long' end"
    conjunctions = f"least(len(regexp_extract_all(m, '{L.CONJUNCTION_ZH}')) + {english}, 4)"
    json = (
        f"""'{{"colonBucket":' || {count('：:', 2)} || ',"commaBucket":' || {count('，,', 4)} || ',"conjunctionBucket":' || {conjunctions} || ',"language":"' || language || '","lengthBucket":"' || {bucket}"""
        f""" || '","openingFamily":"' || inner_family || '","semicolonBucket":' || {count('；;', 3)} || '}}'"""
    )
    return rf"""cores as (select {keys}, s, {core_sql('s')} as core from {sentences}),
facts as (select {keys}, length(regexp_replace(s, '\s+', '', 'g')) as size, {family_sql('core')} as opening, {language_sql('core')} as language, length(regexp_replace(core, '\s+', '', 'g')) as width, {core_sql('core')} as inner_core,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(core, '@(?:[A-Z]+_)?\d+;', ' TOKEN ', 'g'), '(?i)https?://\S+', ' URL ', 'g'), '`[^`\n]+`', ' CODE ', 'g'), '\d+(?:[.,]\d+)*(?:\.\d+)?', ' NUMBER ', 'g') as m from cores),
named as (select *, {family_sql('inner_core')} as inner_family from facts),
frames as (select {keys}, opening, size, sha256({json}) as skeleton from named)"""


# --- growth by conversation, frames by source -------------------------------------------------------------------------
def opening_growth(spark, sf_dir):
    """Opening families that the assistant's turns use more than the user's, by conversation."""
    c = table(spark, sf_dir, "conversations")
    side = lambda r: pairs.pattern_profile(c.where(F.col("role") == r), "conv_id").where("kind = 'opening'")
    return pairs.pattern_growth(side("user"), side("assistant"), "conv_id").select("conv_id", "pattern", "n_before", "n_after", "growth", "blocks")


GROWTH_SQL = f"""
with s as (select conv_id, role, unnest({careful_sql("coalesce(text, '')")}) as s from conversations where role in ('user', 'assistant')), {frames_ctes('s', 'conv_id, role')},
n as (select conv_id, opening as pattern, count(*) filter (role = 'user') as n_before, count(*) filter (role = 'assistant') as n_after from frames group by 1, 2)
select *, n_after - n_before as growth, n_after >= 3 and n_after - n_before >= 2 as blocks from n where n_after > n_before
"""


def skeleton_concentration(spark, sf_dir):
    """The number of distinct sentence frames of each source, and the commonest (of equal ones the least hash) with its number."""
    d = table(spark, sf_dir, "documents").select("source", "text")
    p = pairs.pattern_profile(d, "source").where("kind = 'skeleton'").groupBy("source")
    top = F.min(F.struct((-F.col("n")).alias("less"), "pattern"))
    return p.agg(F.count("*").alias("skeletons"), F.sum("n").alias("sentences"), top.alias("t")).select("source", "skeletons", "sentences", (-F.col("t.less")).alias("commonest"), F.col("t.pattern").alias("skeleton"))


SKELETON_SQL = f"""
with s as (select source, unnest({careful_sql("coalesce(text, '')")}) as s from documents), {frames_ctes('s', 'source')}, n as (select source, skeleton, count(*) as n from frames group by all)
select source, count(*) as skeletons, sum(n)::bigint as sentences, max(n) as commonest, arg_min(skeleton, (-n, skeleton)) as skeleton from n group by source
"""


# --- source-relative deltas -------------------------------------------------------------------------------------------
def style_delta(spark, sf_dir):
    """Every revised turn, judged by itself and against its conversation."""
    e = deltas.style_delta(turn_pairs(spark, sf_dir), "conv_id", "turn")
    counts = [F.col(k)[c].cast("long").alias(f"{k}_{c}") for k, *_ in deltas.KINDS for c in ("introduced", "blocking", "max_introduced", "max_after")]
    listed = [F.array_join(F.transform(F.col(k)["patterns"], lambda r: F.concat_ws(":", F.left(r["pattern"], F.lit(16)), r["n_in"].cast("string"), r["n_out"].cast("string"), r["document_before"].cast("string"), r["document_after"].cast("string"))), ",").alias(f"{k}_patterns") for k, *_ in deltas.KINDS]
    bounds = [F.col("boundary")[c].alias(c) for c in ("n_in", "n_out", "short_in", "short_out", "collapsed", "fragmented")]
    codes = [F.array_join(c, ",").alias(c) for c in ("blocking_codes", "advisory_codes")]
    return e.select("conv_id", "turn", *counts, *listed, *bounds, *codes, "passed", "source_profile_sha256", "baseline_sha256", "candidate_sha256")


def _grown_ctes() -> str:
    side = lambda k, t: f"select conv_id, turn, {k} as side, unnest({careful_sql(t)}) as s from p"
    return rf"""p as (select conv_id, turn, coalesce(text, '') as a, lead(coalesce(text, '')) over w as b, lead(turn) over w as nx from conversations window w as (partition by conv_id order by turn) qualify nx is not null),
s as ({side(0, 'a')} union all {side(1, 'b')}), {frames_ctes('s', 'conv_id, turn, side')},
long as (select conv_id, turn, side, 'opening' as kind, opening as pattern from frames union all select conv_id, turn, side, 'skeleton', skeleton from frames),
n as (select conv_id, turn, kind, pattern, count(*) filter (side = 0) as n_in, count(*) filter (side = 1) as n_out from long group by all),
whole as (select conv_id, kind, pattern, sum(n_in)::bigint as n_in, sum(n_out)::bigint as n_out from n group by all)"""


def _profile_sql(n: str) -> str:
    """The digest of each conversation's profile of either side."""
    text = "a" if n == "n_in" else "b"
    sums = " || ':' || ".join(f"coalesce(sum(('0x' || sha256(concat_ws(':', kind, pattern, {n}))[{15 * k + 1}:{15 * k + 15}])::hugeint), 0)" for k in range(4))
    return rf"""select conv_id, sha256('profile:' || any_value(chunks) || ':' || coalesce(sum({n}) filter (kind = 'opening'), 0) || ':' || {sums}) as profile
  from (select conv_id, count(*) filter (trim(regexp_replace({text}, '\s+', ' ', 'g')) <> '') as chunks from p group by 1) left join (select * from whole where {n} > 0) using (conv_id) group by 1"""


def _kind_sql(kind: str, after: str, listed: int, row: str) -> str:
    only = f"filter (kind = '{kind}')"
    return rf"""count(*) {only} as {kind}_introduced, count(*) filter (kind = '{kind}' and blocks) as {kind}_blocking, coalesce(max(introduced) {only}, 0) as {kind}_max_introduced, coalesce(max({after}) {only}, 0) as {kind}_max_after,
  coalesce(array_to_string((list({row} order by pattern) {only})[1:{listed}], ','), '') as {kind}_patterns"""


_ZERO = ", ".join(f"coalesce({k}_{c}, 0) as {k}_{c}" for k in ("opening", "skeleton") for c in ("introduced", "blocking", "max_introduced", "max_after"))
_LISTS = ", ".join(f"coalesce({k}_patterns, '') as {k}_patterns" for k in ("opening", "skeleton"))
_BLOCKING = "case when opening_blocking > 0 then 'repeated_opening_family_introduced' end, case when skeleton_blocking > 0 then 'repeated_sentence_skeleton_introduced' end"
_ADVISORY = "case when opening_introduced > 0 and opening_blocking = 0 then 'opening_family_delta_observed' end, case when skeleton_introduced > 0 and skeleton_blocking = 0 then 'sentence_skeleton_delta_observed' end"
_STYLE_ROW = "left(pattern, 16) || ':' || n_in || ':' || n_out || ':' || document_before || ':' || document_after"
STYLE_DELTA_SQL = rf"""
with {_grown_ctes()},
g0 as (select n.*, n.n_out - n.n_in as introduced, coalesce(whole.n_in, 0) as document_before, greatest(0, coalesce(whole.n_in, 0) - n.n_in) + n.n_out as document_after from n join whole using (conv_id, kind, pattern) where n.n_out > n.n_in),
g as (select *, (n_out >= 3 and introduced >= 2) or (document_after >= 4 and greatest(0, document_after - document_before) >= 2) as blocks from g0),
k as (select conv_id, turn, {_kind_sql('opening', 'document_after', 12, _STYLE_ROW)}, {_kind_sql('skeleton', 'document_after', 12, _STYLE_ROW)} from g group by 1, 2),
z as (select conv_id, turn, count(*) filter (side = 0) as n_in, count(*) filter (side = 1) as n_out, count(*) filter (side = 0 and size <= 6) as short_in, count(*) filter (side = 1 and size <= 6) as short_out,
  coalesce(sum(size) filter (side = 0), 0)::double as long_in, coalesce(sum(size) filter (side = 1), 0)::double as long_out from frames group by 1, 2),
b as (select *, n_in >= 4 and n_in - n_out >= 3 and n_out <= greatest(1, ceil(n_in / 2)) and long_out / greatest(n_out, 1) >= greatest(36.0::double, long_in / greatest(n_in, 1) * 1.45::double) as collapsed,
  n_out >= 5 and short_out - short_in >= 2 and short_out * 4 >= n_out as fragmented from (select p.conv_id, p.turn, p.a, p.b, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(short_in, 0) as short_in, coalesce(short_out, 0) as short_out, coalesce(long_in, 0) as long_in, coalesce(long_out, 0) as long_out from p left join z using (conv_id, turn))),
r as (select conv_id, turn, {_ZERO}, {_LISTS}, n_in::int as n_in, n_out::int as n_out, short_in::int as short_in, short_out::int as short_out, collapsed, fragmented, sha256(trim(a)) as baseline_sha256, sha256(trim(b)) as candidate_sha256 from b left join k using (conv_id, turn))
select r.*, coalesce(array_to_string([{_BLOCKING}, case when collapsed then 'sentence_boundary_collapse_introduced' end, case when fragmented then 'sentence_fragmentation_introduced' end], ','), '') as blocking_codes, coalesce(array_to_string([{_ADVISORY}], ','), '') as advisory_codes,
  opening_blocking = 0 and skeleton_blocking = 0 and not collapsed and not fragmented as passed, profile as source_profile_sha256
from r join ({_profile_sql('n_in')}) using (conv_id)
"""


def document_style_delta(spark, sf_dir):
    """Every conversation: what its revised turns together repeat more often than the turns before them."""
    e = deltas.document_delta(turn_pairs(spark, sf_dir), "conv_id", "turn")
    counts = [F.col(k)[c].cast("long").alias(f"{k}_{c}") for k, *_ in deltas.KINDS for c in ("introduced", "blocking", "max_introduced", "max_after")]
    listed = [F.array_join(F.transform(F.col(k)["patterns"], lambda r: F.concat_ws(":", F.left(r["pattern"], F.lit(16)), r["n_in"].cast("string"), r["n_out"].cast("string"))), ",").alias(f"{k}_patterns") for k, *_ in deltas.KINDS]
    codes = [F.array_join(c, ",").alias(c) for c in ("blocking_codes", "advisory_codes")]
    return e.select("conv_id", "chunks", *counts, *listed, *codes, "passed", *[c for c in e.columns if c.endswith("s_sha256") or c.endswith("profile_sha256")])


def _chunks_sql(text: str) -> str:
    sums = " || ':' || ".join(f"sum(('0x' || sha256(turn || ':' || sha256(trim({text})))[{15 * k + 1}:{15 * k + 15}])::hugeint)" for k in range(4))
    return f"sha256('chunks:' || count(*) || ':' || {sums})"


_DOCUMENT_ROW = "left(pattern, 16) || ':' || n_in || ':' || n_out"
DOCUMENT_DELTA_SQL = rf"""
with {_grown_ctes()},
g as (select *, n_out - n_in as introduced, n_out >= 4 and n_out - n_in >= 1 as blocks from whole where n_out > n_in),
k as (select conv_id, {_kind_sql('opening', 'n_out', 24, _DOCUMENT_ROW)}, {_kind_sql('skeleton', 'n_out', 24, _DOCUMENT_ROW)} from g group by 1),
c as (select conv_id, count(*) as chunks, {_chunks_sql('a')} as baseline_chunks_sha256, {_chunks_sql('b')} as result_chunks_sha256 from p group by 1),
r as (select conv_id, chunks, {_ZERO}, {_LISTS}, baseline_chunks_sha256, result_chunks_sha256 from c left join k using (conv_id))
select r.*, coalesce(array_to_string([{_BLOCKING}], ','), '') as blocking_codes, coalesce(array_to_string([{_ADVISORY}], ','), '') as advisory_codes, opening_blocking = 0 and skeleton_blocking = 0 as passed, x.profile as baseline_profile_sha256, y.profile as result_profile_sha256
from r join ({_profile_sql('n_in')}) x using (conv_id) join ({_profile_sql('n_out')}) y using (conv_id)
"""


def document_arbitration(spark, sf_dir):
    """Which revised turns their conversation can take, in order, before an opening or a frame repeats too often in it."""
    out = deltas.arbitrate(turn_pairs(spark, sf_dir), "conv_id", "turn")
    return out.select("conv_id", "turn", "accepted", F.array_join("codes", ",").alias("codes"))


ARBITRATION_SQL = rf"""
with recursive {_grown_ctes()},
fails as (select conv_id from whole group by 1 having bool_or(n_out >= 4 and n_out - n_in >= 1)),
keys as (select conv_id, list(kind order by kind, pattern) as kinds, list(pattern order by kind, pattern) as patterns, list(n_in order by kind, pattern) as base from whole join fails using (conv_id) group by 1),
steps as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as i, list(change order by kind, pattern) as change
  from (select p.conv_id, p.turn, whole.kind, whole.pattern, coalesce(n.n_out - n.n_in, 0) as change from p join fails using (conv_id) join whole using (conv_id) left join n on n.conv_id = p.conv_id and n.turn = p.turn and n.kind = whole.kind and n.pattern = whole.pattern) group by 1, 2),
fold as (select conv_id, 0::bigint as i, base as now, null::bigint as turn, []::varchar[] as over from keys
  union all select f.conv_id, s.i, case when len(o.over) = 0 then o.trial else f.now end, s.turn, o.over from fold f join steps s on s.conv_id = f.conv_id and s.i = f.i + 1 join keys k on k.conv_id = f.conv_id,
    lateral (select trial, list_transform(list_filter(list_zip(trial, k.base, k.kinds), lambda v: v[1] >= 4 and v[1] > v[2]), lambda v: v[3]) as over from (select list_transform(list_zip(f.now, s.change), lambda v: v[1] + v[2]) as trial)) o)
select p.conv_id, p.turn, coalesce(len(over), 0) = 0 as accepted, coalesce(array_to_string([case when list_contains(over, 'opening') then 'repeated_opening_family_introduced' end, case when list_contains(over, 'skeleton') then 'repeated_sentence_skeleton_introduced' end], ','), '') as codes
from p left join fold on fold.conv_id = p.conv_id and fold.turn = p.turn
"""


#: What is planted into every tenth row: by (conv_id + turn) % 7 the field that is changed, and what must be found.
TAMPERED = ("passed", "boundary", "binding", "torn", "digest", "skeleton_counts", "codes")


def evidence_check(spark, sf_dir):
    """Evidence of every turn, with a field changed in every tenth row: the rows that don't hold, and what is found first."""
    e = deltas.style_delta(turn_pairs(spark, sf_dir), "conv_id", "turn")
    mode = F.when((F.col("conv_id") * 7 + F.col("turn")) % 10 == 0, (F.col("conv_id") + F.col("turn")) % 7)
    plant = lambda k, c, value: F.when(mode == k, value).otherwise(F.col(c))
    e = e.withColumns({
        "passed": plant(0, "passed", ~F.col("passed")), "boundary": plant(1, "boundary", F.col("boundary").withField("more_short", F.col("boundary.more_short") + 1)),
        "baseline_sha256": plant(2, "baseline_sha256", F.concat(F.lit("x"), "baseline_sha256")), "opening": plant(3, "opening", F.lit(None)), "candidate_sha256": plant(4, "candidate_sha256", F.sha2(F.col("candidate_sha256"), 256)),
        "skeleton": plant(5, "skeleton", F.col("skeleton").withField("introduced", F.lit(-1).cast("long"))), "blocking_codes": plant(6, "blocking_codes", F.array_append("blocking_codes", F.lit("more"))),
    })
    return deltas.broken(e, "conv_id", "turn").where("broken is not null").select("conv_id", "turn", "broken")


_NAMES = ", ".join(f"'{n}'" for n in TAMPERED)
EVIDENCE_SQL = f"""
with p as (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as nx from conversations)
select conv_id, turn, ([{_NAMES}])[((conv_id + turn) % 7 + 1)::int] as broken from p where nx is not null and (conv_id * 7 + turn) % 10 = 0
"""

QUERIES = {
    "opening_growth": (opening_growth, GROWTH_SQL), "skeleton_concentration": (skeleton_concentration, SKELETON_SQL), "style_delta": (style_delta, STYLE_DELTA_SQL),
    "document_style_delta": (document_style_delta, DOCUMENT_DELTA_SQL), "evidence_check": (evidence_check, EVIDENCE_SQL), "document_arbitration": (document_arbitration, ARBITRATION_SQL),
}
