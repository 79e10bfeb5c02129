"""Fill-in-middle: every text is cut behind two units (lines) and put together again as prefix, suffix, middle.

The UTF-8 bytes of a text are divided into fixed blocks of BLOCK bytes. A Fenwick tree over the blocks holds how many
units end and how many code points begin in each; a descent by binary lifting finds the block in which the k-th unit ends
and what the blocks before it hold, and only that block is searched for the exact place. So a cut costs one block and the
logarithm of the text's length, whatever the text's length, after one counting pass.

Where the cuts fall and which form a row takes follow from a hash of its id alone, so they are the same in every run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, table

#: Bytes of a block.
BLOCK = 4096
#: Bytes of texts of one outgoing batch, or one text.
BATCH_BYTES = 8 << 20
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
_NEWLINE = 10


class Fenwick:
    """Prefix sums of fixed numbers, a row of them for each block."""

    def __init__(self, counts: np.ndarray):
        sums = np.vstack((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0, dtype=np.int64)))
        at = np.arange(len(sums))
        self.tree = sums - sums[at - (at & -at)]  # node i holds the numbers of the blocks i - lowbit(i) to i - 1
        self.n = len(counts)

    def before(self, k: int, column: int = 0) -> tuple[int, np.ndarray]:
        """(the first block with which the sum of a column reaches k, the sums of all columns before it); k is 1 at least."""
        at, got, step = 0, np.zeros(self.tree.shape[1], np.int64), 1 << self.n.bit_length()
        while step:
            if at + step <= self.n and got[column] + self.tree[at + step, column] < k:
                at += step
                got = got + self.tree[at]
            step >>= 1
        return at, got

    def total(self) -> np.ndarray:
        at, got = self.n, np.zeros(self.tree.shape[1], np.int64)
        while at:
            got, at = got + self.tree[at], at & (at - 1)
        return got


class Lines:
    """The lines of a text (the last may lack its newline) and where they end, in bytes and in code points."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        starts = np.arange(0, max(len(data), 1), block)
        marks = np.stack((self.data == _NEWLINE, (self.data & 0xC0) != 0x80), axis=1).astype(np.int64)
        self.tree = Fenwick(np.add.reduceat(marks, starts, axis=0) if len(data) else np.zeros((1, 2), np.int64))
        ended, self.chars = self.tree.total().tolist()
        self.n = ended + bool(len(data) and data[-1] != _NEWLINE)
        self.ended = ended

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k lines."""
        if k == 0:
            return 0, 0
        if k > self.ended:
            return len(self.data), self.chars
        at, (units, chars) = self.tree.before(k)
        here = self.data[at * self.block : (at + 1) * self.block]
        last = int(np.flatnonzero(here == _NEWLINE)[k - int(units) - 1]) + 1
        return at * self.block + last, int(chars) + int(((here[:last] & 0xC0) != 0x80).sum())


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the hash of seed and key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """A sentinel whose end begins another (or itself) could be found where none was put, so that is an error."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(a.endswith(b[:k]) for k in range(1, len(b))) or (a != b and a in b):
                raise ValueError(f"sentinels {sentinels} overlap")
    if len(set(sentinels)) < 3:
        raise ValueError(f"sentinels {sentinels} are not three")


def transform(data: bytes, key: str, sentinels: tuple[bytes, bytes, bytes], seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, code points of prefix and of middle, output) of one text."""
    h1, h2, h3, h4 = draws(key, seed)
    lines = Lines(data)
    if not data or h3 % 100 >= rate or any(s in data for s in sentinels):
        return lines.n, "plain", None, None, data
    first, last = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (a, chars_a), (b, chars_b) = lines.cut(first), lines.cut(last)
    p, s, m = sentinels
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = b"".join((s, data[b:], p, data[:a], m, data[a:b]) if form == "spm" else (p, data[:a], s, data[b:], m, data[a:b]))
    return lines.n, form, chars_a, chars_b - chars_a, out


_COLUMNS = ("fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with fim_lines (number of lines), fim_form (plain, psm or spm), fim_prefix_chars, fim_middle_chars (null where plain) and fim_output.

    rate and spm_rate are per cent: of texts that are changed, and of those that are in the order suffix, prefix, middle. A null text
    counts as empty; empty texts and texts that hold a sentinel stay plain. A null id draws as the empty key; rows that
    share an id share its draws, and repeated rows come out alike. An empty table gives no rows. Where docs has columns so called,
    the new ones have underscores before them. Nothing is shuffled; a task holds one batch or one text and its output.
    """
    check_sentinels(sentinels)
    marks = tuple(s.encode() for s in sentinels)
    text, key = (fresh(c, docs.columns) for c in ("_utf8", "_key"))
    names = [fresh(c, docs.columns) for c in _COLUMNS]
    keyed = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")).cast("binary")).withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    others = [c for c in keyed.columns if c not in (text, key)]

    def run(batches):
        for batch in batches:
            texts, keys, kept = batch.column(len(others)), batch.column(len(others) + 1), batch.select(list(range(len(others))))
            first, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                rows.append(transform(texts[i].as_py(), keys[i].as_py(), marks, seed, rate, spm_rate))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept.slice(first, len(rows)).columns, *columns], [*others, *names])
                    first, size, rows = i + 1, 0, []

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} {t}" for n, t in zip(names, ("long", "string", "long", "long", "binary"), strict=True))])
    out = keyed.select(*others, text, key).mapInArrow(lean(run), schema)
    return out.withColumn(names[-1], F.col(names[-1]).cast("string"))


def restored(output, form, sentinels: tuple[str, str, str] = SENTINELS):
    """The text that an output was made of, as a Column: the output cut at its sentinels, by its form."""
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    before = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substr(before, F.lit(len(p) + 1)), s, 1), middle, F.substring_index(before, s, -1))
    spm = F.concat(F.substring_index(before, p, -1), middle, F.substring_index(F.substr(before, F.lit(len(s) + 1)), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("fim_output"), F.col("fim_form"))
    return out.select(
        "doc_id", F.col("fim_lines").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
    ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d
), c AS (
  SELECT *, len(lines)::bigint AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::bigint END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
