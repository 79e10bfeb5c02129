"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first 4, 5 and 6 bytes (so that inflected forms share a term), hashed to
BUCKETS. Over all labelled training rows the log-odds ratio of every bucket between the classes is counted (one partial
sum per task). A term's value in a text is the part of its ratio, of either sign, that is sure: the ratio's size less
Z standard errors, zero if nothing is left. So the thousands of neutral words of a long text add no noise, and a text's
length doesn't thin out what it says. Values are divided by SCALE, and a text whose values are longer than LIMIT is scaled down to that.

The machine scores bias + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, with FACTORS numbers to a vector, so it learns
that two terms together (an insult and the name of a group) mean what neither means alone, which additive weights can't say. It is fitted by
adaptive gradient descent (AdaGrad) on the logistic loss, on a bounded sample of distinct labelled texts, about SAMPLE of each
class, chosen by a hash of the text. The pairs' sum is taken in time linear in the terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small, table
from .quality import held_out
from .textblocks import U, blocks, mix, powers, spans

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Bytes of the beginnings of words that are terms, besides the words.
BEGINNINGS = (4, 5, 6)
Z = 2.0
SCALE, LIMIT = 2.0, 4.0
FACTORS = 8
EPOCHS, RATE, DECAY = 20, 0.1, 1e-4
#: Distinct labelled texts of each class that the machine is fitted on, about; the ratios use all rows.
SAMPLE = 2000
#: Bytes of the sampled rows, which the driver holds: the sample is smaller where texts are so long that it would take more.
SAMPLE_BYTES = 128 << 20
#: A text that scores this or more is toxic.
TOXIC = 0.7


def term_keys(block: list[bytes]) -> np.ndarray:
    """text << BUCKET_BITS | bucket, sorted and distinct, of a block of lower-cased UTF-8 texts."""
    data, starts, ends, counts = spans(block)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    text, size = np.repeat(np.arange(len(block), dtype=np.int64), counts), ends - starts
    keys = []
    for salt, k in enumerate((0, *BEGINNINGS)):
        at = size >= k
        s, n = starts[at], np.where(k, k, size[at])
        h = mix(mix((total[s + n] - total[s]) * down[s] + n.astype(U)) + U(min(salt, 1)))
        keys.append(text[at] << BUCKET_BITS | (h >> U(64 - BUCKET_BITS)).astype(np.int64))
    key = np.sort(np.concatenate(keys))
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def terms(texts: list[str]) -> list[np.ndarray]:
    """The distinct buckets of every text, sorted."""
    out = []
    for _, block in blocks(texts):
        out += _by_text(term_keys(block), len(block))
    return out


def _by_text(key: np.ndarray, n: int) -> list[np.ndarray]:
    cut = np.searchsorted(key >> BUCKET_BITS, np.arange(1, n))
    return [x.astype(np.int32) for x in np.split(key & (BUCKETS - 1), cut)]


def strengths(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The value of every bucket, from the numbers of rows that hold it."""
    a, b, c, d = toxic + 0.5, clean + 0.5, n_toxic - toxic + 0.5, n_clean - clean + 0.5
    ratio = np.log(a) - np.log(c) - np.log(b) + np.log(d)
    sure = np.abs(ratio) - Z * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.where(toxic + clean > 0, np.maximum(sure, 0.0), 0.0)


class Machine:
    """Buckets in use, their values in a text, and bias, weights and vectors."""

    def __init__(self, strength: np.ndarray, bias: float = 0.0):
        self.used = np.flatnonzero(strength > 0)
        self.at = np.full(len(strength), -1, np.int32)
        self.at[self.used] = np.arange(len(self.used))
        self.value = strength[self.used] / SCALE
        self.bias, self.weights, self.vectors = bias, np.zeros(len(self.used)), np.zeros((len(self.used), FACTORS))

    def row(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[buckets]
        i = i[i >= 0]
        x = self.value[i]
        return i, x / max(1.0, np.sqrt((x * x).sum()) / LIMIT)

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> Machine:
        rng = np.random.default_rng(7)
        self.vectors = rng.normal(0, 0.05, self.vectors.shape)
        w, v, b = self.weights, self.vectors, self.bias
        gw, gv, gb = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), 1e-6
        share = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y == 0).sum(), 1))
        xs = [self.row(r) for r in rows]
        for _ in range(EPOCHS):
            for k in rng.permutation(len(xs)):
                i, x = xs[k]
                q = v[i] * x[:, None]
                total = q.sum(axis=0)
                margin = b + w[i] @ x + (total @ total - (q * q).sum()) / 2
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[k]) * share[k]
                gb += g * g
                b -= RATE * g / np.sqrt(gb)
                step = g * x + DECAY * w[i]
                gw[i] += step * step
                w[i] -= RATE * step / np.sqrt(gw[i])
                step = g * x[:, None] * (total - q) + DECAY * v[i]
                gv[i] += step * step
                v[i] -= RATE * step / np.sqrt(gv[i])
        self.bias = float(b)
        return self

    def score_block(self, block: list[bytes]) -> np.ndarray:
        key = term_keys(block)
        i = self.at[key & (BUCKETS - 1)]
        text, i, n = (key >> BUCKET_BITS)[i >= 0], i[i >= 0], len(block)
        x = self.value[i]
        x = x / np.maximum(1.0, np.sqrt(np.bincount(text, x * x, n)) / LIMIT)[text]
        q = self.vectors[i] * x[:, None]
        pairs = sum(np.bincount(text, c, n) ** 2 for c in q.T) - np.bincount(text, (q * q).sum(axis=1), n)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(text, self.weights[i] * x, n) + pairs / 2, -30, 30)))

    def score_texts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.score_block(block) for _, block in blocks(texts)]])


#: Without rows of both classes nothing is known against any text.
UNKNOWN = Machine(np.zeros(BUCKETS), bias=-4.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """The machine of the labelled rows of docs. Ids whose rows in labels disagree, nulls and other labels are left out.

    Rows of docs that share a labelled id count each; null texts count as empty. A text that repeats is fitted once for each label it has.
    Without rows of both classes (an empty table, say) the machine is UNKNOWN. Other columns are not read.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    y = y.agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).where("_y = _most").select("_id", F.col("_y").cast("int").alias("_y"))
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(small(y, 12 * y.count()), "_id")
    d = d.select("_y", "_text", F.xxhash64("_text").alias("_key"))
    most = 4 * F.least(F.octet_length("_text"), F.lit(BUCKETS))  # a row has less than a bucket for each byte
    sizes = {r[0]: tuple(r[1:]) for r in d.groupBy("_y").agg(F.count("*"), F.approx_count_distinct("_key", 0.02), F.sum(most) / F.count("*")).collect()}
    if set(sizes) != {0, 1}:
        return UNKNOWN
    rate = {k: min(1.0, sample / n, SAMPLE_BYTES / 2 / max(mean * n, 1)) for k, (_, n, mean) in sizes.items()}
    chosen = F.pmod("_key", F.lit(1 << 30)) < F.when(F.col("_y") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0])) * (1 << 30)
    d = d.select("_y", "_text", "_key", chosen.alias("_in"))

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            y, keys, chosen = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for first, block in blocks(batch.column(1).to_pylist()):
                rows = _by_text(term_keys(block), len(block))
                for k, row in zip(y[first : first + len(rows)], rows, strict=True):
                    counts[k, row] += 1
                at = np.flatnonzero(chosen[first : first + len(rows)])
                if len(at):
                    yield _rows(len(at), y=y[first + at], key=keys[first + at], row=[rows[i].tobytes() for i in at])
        at = np.flatnonzero(counts.any(axis=0))
        if len(at):
            yield _rows(len(at), bucket=at, clean=counts[0, at], toxic=counts[1, at])

    scratch = Scratch(docs.sparkSession, "toxicity")
    both = scratch.put(d.mapInArrow(lean(run), ", ".join(f"{k} {v[0]}" for k, v in _TYPES.items())))
    sums = both.where("bucket is not null").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # BUCKETS rows
    rows = both.where("row is not null").groupBy("y", "key").agg(F.min("row").alias("row")).toPandas()  # about 2 x sample rows
    scratch.drop(both)
    counts = np.zeros((2, BUCKETS))
    counts[0, sums["bucket"]], counts[1, sums["bucket"]] = sums["clean"], sums["toxic"]
    machine = Machine(strengths(counts[1], counts[0], sizes[1][0], sizes[0][0]))
    rows = sorted(zip(rows["row"].map(bytes), rows["y"], strict=True))  # the order of arrival must not matter
    return machine.fit([np.frombuffer(r, np.int32) for r, _ in rows], np.array([k for _, k in rows]))


_TYPES = {"y": ("int", pa.int32()), "key": ("long", pa.int64()), "row": ("binary", pa.binary()), "bucket": ("int", pa.int32()), "clean": ("long", pa.int64()), "toxic": ("long", pa.int64())}


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, (_, t) in _TYPES.items()], list(_TYPES))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), one row per row of docs; predicted is 1 from TOXIC on. Null texts score as empty ones, by the bias alone.

    Repeated rows score alike; an empty table gives no rows; whole texts are read, and no other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # an index of BUCKETS and the terms in use, at most BUCKETS x (FACTORS + 2)

    def run(batches):
        for batch in batches:
            s = shared.value.score_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= TOXIC).astype(np.int32))], ["id", "score", "predicted"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(run), f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def op11_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train(docs, labels.where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
