"""Repetition within a text: units (paragraphs, or sentences of one paragraph) that share most of the smaller one's terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textaudit.functions import lexicons as L
from textaudit.functions import text as T


def units(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, unit, terms): the paragraphs of a text, or its sentences where it has but one; those with fewer than 8 terms are left out.

    unit is the place among the paragraphs or sentences. Null texts have no unit.
    """
    cut = df.select(key, F.explode(F.array(T.unix_lines(F.trim(F.coalesce(F.col(text), F.lit("")))))).alias("_t"))
    cut = cut.select(key, F.posexplode(T.let(T.paragraphs(F.col("_t")), lambda p: F.when(F.size(p) >= 2, p).otherwise(T.sentences(F.col("_t"))))).alias("unit", "_u"))
    # explode: a unit's terms are found once, and not again for the condition
    return cut.select(key, "unit", F.explode(F.filter(F.array(T.content_terms(F.col("_u"))), lambda t: F.size(t) >= L.OVERLAP_LEAST_TERMS)).alias("terms"))


def repeated(df: DataFrame, key: str, text: str = "text", threshold: float = L.OVERLAP_THRESHOLD) -> DataFrame:
    """(key, left_unit, right_unit, shared, least_terms): pairs of units of one text whose overlap coefficient reaches the threshold.

    Units with the same set of terms are one while they are compared; each but the first is paired with the first, so what a
    text repeats a thousand times gives a thousand rows, not their square. Of different units every pair is found: the
    smaller of two can lack a fifth of its terms or so, so one of its rarest few terms must be in the other, and only
    those meet. Nothing but the units of one text meets, so a text's units are shuffled once, as a row, and compared
    there. Texts are told apart by key, so rows that share one are one text; null keys take no part.
    """
    u = units(df, key, text).where(F.col(key).isNotNull())
    texts = u.groupBy(key).agg(F.collect_list(F.struct("unit", "terms")).alias("units")).where(F.size("units") > 1).select(key, "units.unit", "units.terms")
    ddl = ", ".join(f"{c} int" for c in PAIR)
    return texts.mapInArrow(_pairs(threshold), f"`{key}` {df.schema[key].dataType.simpleString()}, {ddl}")


PAIR = ("left_unit", "right_unit", "shared", "least_terms")
#: Terms of the texts that are compared at once, and term lookups at once.
SLICE_TERMS, LOOKUPS = 1 << 19, 1 << 22


def _pairs(threshold: float):
    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            terms = np.diff(np.append(0, np.cumsum(pc.list_value_length(pc.list_flatten(batch.column(2))).to_numpy()))[np.append(0, np.cumsum(sizes))])
            at = 0
            while at < len(sizes):
                end, n = at + 1, terms[at]
                while end < len(sizes) and n + terms[end] <= SLICE_TERMS:
                    n, end = n + terms[end], end + 1
                rows = batch.slice(at, end - at)
                for of, *columns in _similar(rows.column(1), rows.column(2), threshold):
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), *[pa.array(c, pa.int32()) for c in columns]], [batch.schema.names[0], *PAIR])
                at = end

    return run


def _similar(places: pa.ListArray, terms: pa.ListArray, threshold: float):
    """Blocks of (text, left, right, shared, least) over texts whose units have the given places and terms."""
    text, unit = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy()), pc.list_flatten(places).to_numpy()
    lists = pc.list_flatten(terms)
    code = pc.list_flatten(lists).dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes = pc.list_value_length(lists).to_numpy()
    of = np.repeat(np.arange(len(sizes)), sizes)
    code = code[np.lexsort((code, of))]
    # sets: units of equal terms, at the first's place
    ends = np.cumsum(sizes)
    order = np.lexsort((unit, text))
    first: dict[tuple[int, bytes], int] = {}
    kept = np.zeros(len(sizes), bool)
    equal = set()
    for i in order.tolist():
        same = (int(text[i]), code[ends[i] - sizes[i] : ends[i]].tobytes())
        j = first.setdefault(same, i)
        kept[i] = j == i
        if unit[j] < unit[i]:
            equal.add((same[0], int(unit[j]), int(unit[i]), int(sizes[i])))
    if equal:
        t, a, b, n = np.array(sorted(equal)).T
        yield t, a, b, n, n
    # (set, term) of the sets, by (text, term)
    here = kept[of]
    of, code = of[here], code[here]
    words = int(code.max()) + 1 if len(code) else 1
    order = np.lexsort((of, code, text[of]))
    of, code = of[order], code[order]
    term = text[of] * words + code
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
    group_size = np.diff(np.append(starts, len(term)))
    group = np.repeat(np.arange(len(starts)), group_size)
    held = group_size[group]
    # at least ceil(threshold * n) terms are in the other set; those that no other set holds are misses already
    several = np.flatnonzero(held > 1)
    several = several[np.lexsort((group[several], held[several], of[several]))]
    sets, at, met = np.unique(of[several], return_index=True, return_counts=True)
    rank = np.arange(len(several)) - np.repeat(at, met) + 1
    needed = np.ceil(sizes[sets] * threshold - 1e-9).astype(np.int64)
    tops = several[rank <= np.repeat(met - needed + 1, met)]
    # the smaller set's rarest terms ask all that hold them; of equal sizes the first place asks
    known = np.sort(of * words + code)
    own, bounds = np.argsort(of, kind="stable"), np.append(0, np.cumsum(np.bincount(of, minlength=len(sizes))))
    most = np.cumsum(held[tops] * sizes[of[tops]])
    cuts = np.unique(np.append(np.searchsorted(most, np.arange(LOOKUPS, (most[-1] if len(most) else 0), LOOKUPS)), len(tops)))
    # a set's terms ask in one block, so each pair is found in one
    cuts = np.unique(np.searchsorted(of[tops], of[tops][np.minimum(cuts, len(tops) - 1)], side="right")) if len(tops) else []
    for x, y in zip([0, *cuts], cuts, strict=False):
        asks = tops[x:y]
        n = held[asks]
        small = np.repeat(of[asks], n)
        large = of[np.arange(n.sum()) + np.repeat(starts[group[asks]] - np.cumsum(n) + n, n)]
        fit = (sizes[small] < sizes[large]) | ((sizes[small] == sizes[large]) & ((unit[small] < unit[large]) | ((unit[small] == unit[large]) & (small < large))))
        small, large = np.divmod(np.unique(small[fit] * len(sizes) + large[fit]), len(sizes))
        for k in range(0, len(small), LOOKUPS // 64):
            s, g = small[k : k + LOOKUPS // 64], large[k : k + LOOKUPS // 64]
            n = sizes[s]
            wanted = np.repeat(g, n) * words + code[own[np.arange(n.sum()) + np.repeat(bounds[s] - np.cumsum(n) + n, n)]]
            found = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
            shared = np.add.reduceat(found.astype(np.int32), np.cumsum(n) - n) if len(n) else n
            near = shared >= threshold * n
            s, g, n, shared = s[near], g[near], n[near], shared[near]
            yield text[s], np.minimum(unit[s], unit[g]), np.maximum(unit[s], unit[g]), shared, n


def introduced(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key): texts that repeat themselves where the text of that key before didn't."""
    return repeated(after, key, text).select(key).distinct().join(repeated(before, key, text).select(key).distinct(), key, "left_anti")
