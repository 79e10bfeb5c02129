"""Quality classifier: Naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams of the whole text: of its bytes, and of the shapes of its tokens (size, letters,
capitals, marks, repetition). Over all labelled training rows every n-gram's log-count ratio r between the two classes is
counted (distributed, one partial sum per task). Indicators are scaled by r, each row to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent on a bounded sample of the labelled rows (about SAMPLE of each
class, chosen by a hash of the id). The weights are interpolated with their mean size, as is usual for this model. The
score is the logistic of SLOPE times the margin, so 0.5 is the decision boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small, table
from .textblocks import U, blocks, byte_grams, mix, shingle_hashes, spans, word_hashes

GRAM_BYTES = (4,)
#: Orders of the n-grams of token shapes.
GRAM_SHAPES = (1, 2, 3)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 1.0
#: Labelled rows of each class that the linear model is fitted on, about; the ratios use all rows.
SAMPLE = 2000
#: Bytes of the sampled rows, which the driver holds: the sample is smaller where texts are so long that it would take more.
SAMPLE_BYTES = 128 << 20
COST = 1.0
EPOCHS = 30
INTERPOLATION = 0.25
SLOPE = 4.0


_TOKEN = np.ones(256, bool)
_TOKEN[[9, 10, 11, 12, 13, 32]] = False
_UPPER, _LETTER, _MARK = (np.zeros(257, np.int32) for _ in range(3))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = 1
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = 1


def token_shapes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shape of every white-space token, number of tokens by text): size, letters, capitals, marks, repetition of the tokens before."""
    data, starts, ends, counts = spans(block, _TOKEN)
    hashes, _ = word_hashes(block, _TOKEN)
    size = ends - starts
    sums = [np.append(0, np.cumsum(kind[data])) for kind in (_LETTER, _UPPER, _MARK)]
    letters, upper, marks = (c[ends] - c[starts] for c in sums)
    shape = np.searchsorted([2, 4, 8, 16], size, side="right")
    shape = shape * 3 + np.where(letters == 0, 0, np.where(letters == size, 2, 1))
    shape = shape * 3 + np.where(upper == 0, 0, np.where((upper == letters) & (size > 1), 2, 1))
    shape = shape * 4 + np.minimum(marks, 3)
    text = np.repeat(np.arange(len(block)), counts)
    same = np.zeros(len(hashes), np.int64)
    for back in range(8, 0, -1):
        if len(hashes) > back:
            equal = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
            same[back:][equal] = 1 if back == 1 else 2 if back < 5 else 3
    return shape * 4 + same, counts


def features_by_block(texts: list[str]):
    """(first index, features) of every block of texts: a batch of texts has many times their bytes in features."""
    for first, block in blocks(texts, lower=False):
        grams = [byte_grams(block, k) for k in GRAM_BYTES]
        shapes, counts = token_shapes(block)
        words = mix(shapes.astype(U) + U(1))
        grams += [shingle_hashes(words, counts, k) for k in GRAM_SHAPES]
        keys = []
        for salt, (hashes, counts) in enumerate(grams):
            text = np.repeat(np.arange(len(block), dtype=np.int64), counts)
            keys.append(text << BUCKET_BITS | (mix(hashes + U(salt)) >> U(64 - BUCKET_BITS)).astype(np.int64))
        key = np.sort(np.concatenate(keys))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        cut = np.searchsorted(key >> BUCKET_BITS, np.arange(1, len(block)))
        yield first, [x.astype(np.int32) for x in np.split(key & (BUCKETS - 1), cut)]


def features(texts: list[str]) -> list[np.ndarray]:
    """The distinct n-gram buckets of every text, sorted: n-grams of its bytes and of the shapes of its tokens."""
    return [x for _, rows in features_by_block(texts) for x in rows]


def log_count_ratio(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    p, q = positive + SMOOTHING, negative + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for L1-loss SVM over unit-length rows of r at the given indices: (weights, bias)."""
    w, b, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    x = [r[i] / max(np.sqrt((r[i] ** 2).sum()), 1e-12) for i in rows]
    norm = np.array([v @ v + 1.0 for v in x])
    limit = np.where(y > 0, cost * len(y) / max(2 * (y > 0).sum(), 1), cost * len(y) / max(2 * (y < 0).sum(), 1))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), limit[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[rows[i]] += step * x[i]
                b += step
                alpha[i] = new
            worst = max(worst, abs(g) if 0 < alpha[i] < limit[i] else 0.0)
        if worst < 1e-3:
            break
    return w, b


class Model:
    def __init__(self, r: np.ndarray, w: np.ndarray, bias: float):
        w = (1 - INTERPOLATION) * w + INTERPOLATION * np.abs(w).mean()
        self.weights, self.squares, self.bias = (w * r).astype(np.float32), (r * r).astype(np.float32), float(bias)

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[i].sum(dtype=np.float64)) / max(float(np.sqrt(self.squares[i].sum(dtype=np.float64))), 1e-12) + self.bias for i in rows], np.float64)

    def score_texts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.scores(rows) for _, rows in features_by_block(texts)]])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SLOPE * self.margins(rows), -30, 30)))


#: Without rows of both classes nothing is known against any text.
UNKNOWN = Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows of docs. Ids whose rows in labels disagree, nulls and other labels are left out.

    Rows of docs that share a labelled id count each; null texts count as empty. Without rows of both classes (an empty
    table, say) the model is UNKNOWN. Other columns are not read.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    y = y.agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).where("_y = _most").select("_id", F.col("_y").cast("int").alias("_y"))
    n_labels = y.count()
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(small(y, 12 * n_labels), "_id")
    most = 4 * F.least(F.octet_length("_text") + 64, F.lit(BUCKETS))  # a row has at most a bucket for each byte and some shapes
    sizes = {r[0]: (r[1], r[2]) for r in d.groupBy("_y").agg(F.count("*"), F.coalesce(F.sum(most), F.lit(0))).collect()}
    rates = {k: min(1.0, sample / n, SAMPLE_BYTES / 2 / max(size, 1)) for k, (n, size) in sizes.items()}
    rate = F.when(F.col("_y") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    d = d.select("_text", "_y", (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < rate * (1 << 30)).alias("_in"))

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            y, chosen = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for first, rows in features_by_block(batch.column(0).to_pylist()):
                for k, row in zip(y[first : first + len(rows)], rows, strict=True):
                    counts[k, row] += 1
                at = np.flatnonzero(chosen[first : first + len(rows)])
                if len(at):
                    yield _rows(len(at), y=y[first + at], row=[rows[i].tobytes() for i in at])
        at = np.flatnonzero(counts.any(axis=0))
        if len(at):
            yield _rows(len(at), bucket=at, negative=counts[0, at], positive=counts[1, at])

    scratch = Scratch(docs.sparkSession, "quality")
    both = scratch.put(d.mapInArrow(lean(run), _SCHEMA))
    sums = both.where("bucket is not null").groupBy("bucket").agg(F.sum("negative").alias("n"), F.sum("positive").alias("p")).toPandas()  # BUCKETS rows
    chosen = both.where("row is not null").select("y", "row").toPandas()  # about 2 x sample rows
    scratch.drop(both)
    y = np.where(chosen["y"].to_numpy() == 1, 1.0, -1.0)
    if not ((y > 0).any() and (y < 0).any()):
        return UNKNOWN
    positive, negative = np.zeros(BUCKETS), np.zeros(BUCKETS)
    positive[sums["bucket"]], negative[sums["bucket"]] = sums["p"], sums["n"]
    r = log_count_ratio(positive, negative)
    rows = sorted(zip(chosen["row"], y, strict=True))  # the order of arrival must not matter
    return Model(r, *fit_hinge([np.frombuffer(x, np.int32) for x, _ in rows], np.array([k for _, k in rows]), r))


_SCHEMA = "y int, row binary, bucket int, negative long, positive long"


def _rows(n: int, **columns) -> pa.RecordBatch:
    types = {"y": pa.int32(), "row": pa.binary(), "bucket": pa.int32(), "negative": pa.int64(), "positive": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], list(types))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), one row per row of docs; null texts score as empty ones, by the bias alone.

    Repeated rows score alike; an empty table gives no rows; whole texts are read, and no other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two float tables of BUCKETS

    def run(batches):
        for batch in batches:
            s = shared.value.score_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(run), f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns (of any names), that the model doesn't reject: score 0.5 or more.

    Null and empty texts go by the bias alone; repeated rows stay or go together; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score_texts(batch.column(at).to_pylist()) >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op1_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
