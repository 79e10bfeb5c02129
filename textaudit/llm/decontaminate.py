"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size (number of distinct five-word shingles, in powers of two). For a partition of items of up to
u shingles, every document is cut into windows of two blocks of u shingles that overlap by one block, so that any passage
of u shingles lies in one window and an item's share of that window is at least about a fifth, however long the document
is. A window is a candidate for an item when one of their SIGNATURE min-hashes agrees (bands of one row: at a Jaccard
similarity of 0.19, the least that a containment of 0.8 leaves, a window is missed with a chance of 0.81**64 = 1e-6).
Candidates are verified by the exact containment of the item's shingles in the whole document. Items of fewer than FEWEST
shingles, whose windows would leave less than that, are candidates wherever one of their shingles stands.

Items are taken in blocks of ITEMS and ITEM_BYTES; one scan of the documents serves a block, whose hashes are broadcast. Nothing is
shuffled, and a passage that a third of the documents hold is verified where each of them stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table
from .textblocks import SHINGLE, U, blocks, mix, shingle_hashes, word_hashes

CONTAINMENT = 0.8
SIGNATURE = 64
LEAST_BLOCK = 8
#: An item of fewer shingles must be contained whole, so its first is looked up.
FEWEST = 4
#: Items of one scan, and bytes of their texts (their shingle hashes take about twice as much); both on average.
ITEMS = 20_000
ITEM_BYTES = 16 << 20
SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=U))


class Items:
    """Distinct shingle hashes of a block of items, and the index from min-hash to items by size partition."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.shingles, self.lengths = [], [], []
        at = 0
        for _, block in blocks(texts):
            words, counts = word_hashes(block)
            hashes, runs = shingle_hashes(words, counts)
            for h, n in zip(np.split(hashes, np.cumsum(runs)[:-1]), counts.tolist(), strict=True):
                if n:  # an item without words can't be contained
                    self.ids.append(ids[at])
                    self.shingles.append(np.unique(h))
                    self.lengths.append(min(n, SHINGLE))
                at += 1
        self.short: dict[int, list[int]] = {}
        self.few: list[int] = []
        parts: dict[int, list[int]] = {}
        for i, (h, k) in enumerate(zip(self.shingles, self.lengths, strict=True)):
            if k < SHINGLE:
                self.short.setdefault(k, []).append(i)
            elif len(h) < FEWEST:
                self.few.append(i)
            else:
                parts.setdefault(max(LEAST_BLOCK, 1 << (len(h) - 1).bit_length()), []).append(i)
        self.partitions = []
        for u, members in sorted(parts.items()):
            tables = []
            for seed in SEEDS:
                v = np.array([mix(self.shingles[i] ^ seed).min() for i in members], U)
                order = np.argsort(v, kind="stable")
                tables.append((v[order], np.array(members)[order]))
            self.partitions.append((u, tables))

    def search(self, hashes: np.ndarray, runs: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """(text, item, shared) of every contained item; the texts are those of one block."""
        pairs: set[tuple[int, int]] = set()
        first = np.cumsum(runs) - runs
        cuts = {}
        for u, _ in self.partitions:
            n = -(-runs // u)  # blocks of u shingles by text
            text = np.repeat(np.arange(len(runs)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cuts[u] = (first[text] + place * u, text)
        if len(hashes) and self.partitions:
            for k, seed in enumerate(SEEDS):
                v = mix(hashes ^ seed)
                for u, tables in self.partitions:
                    at, text = cuts[u]
                    low = np.minimum.reduceat(v, at)
                    windows = np.minimum(low[:-1], low[1:])
                    windows = np.append(np.where(text[:-1] == text[1:], windows, low[:-1]), low[-1])
                    values, members = tables[k]
                    left = np.searchsorted(values, windows)
                    hit = np.flatnonzero(values[np.minimum(left, len(values) - 1)] == windows)
                    for w in hit.tolist():
                        j = int(left[w])
                        while j < len(values) and values[j] == windows[w]:
                            pairs.add((int(text[w]), int(members[j])))
                            j += 1
        if self.few:
            values = np.array([self.shingles[i][0] for i in self.few], U)
            order = np.argsort(values, kind="stable")
            values = values[order]
            left, right = np.searchsorted(values, hashes), np.searchsorted(values, hashes, side="right")
            text = np.repeat(np.arange(len(runs)), runs)
            for w in np.flatnonzero(left < right).tolist():
                pairs.update((int(text[w]), self.few[order[j]]) for j in range(left[w], right[w]))
        held: dict[int, np.ndarray] = {}
        for t, i in sorted(pairs):
            if t not in held:
                held[t] = np.unique(hashes[first[t] : first[t] + runs[t]])
            shared = int(np.isin(self.shingles[i], held[t], assume_unique=True).sum())
            if shared >= CONTAINMENT * len(self.shingles[i]) - 1e-9:
                yield t, i, shared
        for k, members in self.short.items():  # items of under five words: their one run of words
            grams, n = shingle_hashes(words, counts, k)
            values = np.array([self.shingles[i][0] for i in members], U)
            text = np.repeat(np.arange(len(n)), n)
            hit = np.isin(grams, values)
            for t, v in sorted(set(zip(text[hit].tolist(), grams[hit].tolist(), strict=True))):
                for i in np.flatnonzero(values == U(v)).tolist():
                    yield t, members[i], 1


def _item_blocks(items: DataFrame, item_id: str, item_text: str):
    """Blocks of about ITEMS distinct items and ITEM_BYTES, as broadcasts."""
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    n, size = known.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    scans = max(1, -(-n // ITEMS), -(-int(size or 0) // ITEM_BYTES))
    for s in range(scans):
        block = sorted(known.where(F.pmod(F.xxhash64("i", "t"), F.lit(scans)) == s).collect(), key=str)  # about ITEMS rows
        yield items.sparkSession.sparkContext.broadcast(Items([r[0] for r in block], [r[1] for r in block]))


def _search(found: Items, texts: list):
    for first, block in blocks(texts):
        words, counts = word_hashes(block)
        hashes, runs = shingle_hashes(words, counts)
        for t, i, n in found.search(hashes, runs, words, counts):
            yield first + t, i, n


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, shared, item_size): one row for each row of docs that holds at least CONTAINMENT of an item's shingles.

    Items of under five words are held as one run of words. Items without words, null and empty texts match nothing.
    Equal item rows count once; of an item id with several texts each is searched. Rows of docs that repeat give their
    rows each. Other columns are not read.
    """
    item_type = items.schema[item_id].dataType
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, shared long, item_size long"
    out = None
    for shared in _item_blocks(items, item_id, item_text):

        def run(batches, shared=shared):
            found = shared.value
            for batch in batches:
                rows = list(_search(found, batch.column(1).to_pylist()))
                if rows:
                    at, item, n = (list(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([found.ids[i] for i in item]), pa.array(n, pa.int64()), pa.array([len(found.shingles[i]) for i in item], pa.int64())], ["id", "item_id", "shared", "item_size"])

        one = d.mapInArrow(lean(run), schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item (as find_contained finds them).

    Null and empty texts hold none and stay; rows that repeat stay or go together; an empty table, or no items, leave docs
    as it is. Columns of docs may have any names.
    """
    at = docs.columns.index(text_col)
    out = docs
    for shared in _item_blocks(items, item_id, item_text):

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, _, _ in _search(shared.value, batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(lean(run), docs.schema)
    return out


def op3_decontamination(spark, sf_dir):
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The exact answer, by joining shingles; items of under five words are one run of so many.
OP3_SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') as w from documents),
bw as (select item_id, w, least(len(w), 5) as k from (select distinct item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') as w from benchmark) where len(w) > 0),
items as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bw)),
sizes as (select item_id, count(*) as item_size from items group by item_id),
ks as (select distinct k from items),
grams as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from w, ks where len(w) >= k)),
hits as (select doc_id, item_id, count(*) as shared from grams join items using (k, s) group by all)
select doc_id, item_id, shared, item_size from hits join sizes using (item_id) where shared >= 0.8 * item_size - 1e-9
"""
