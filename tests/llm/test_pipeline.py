"""corpus_pipeline: each stage and run() as a whole against brute force on one small corpus with planted cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import WORDS, brute_lines, brute_near, prose

import corpus_pipeline
from textaudit.llm import bpe, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(i, prose(9000 + i, n)) for i, n in enumerate((6, 20, 60))] + [(7, ""), (8, None)]


def corpus():
    rng = random.Random(11)
    texts = [prose(i, rng.randrange(30, 90)).capitalize() + "." for i in range(60)]
    rows = list(enumerate(texts))
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(3000 + i, 40).split())) for i in range(60)]  # of low quality
    shared = prose(77, 25)
    rows += [(200 + i, prose(4000 + i, 40) + "\n" + shared + "\n" + prose(5000 + i, 30)) for i in range(6)]  # a line that six hold
    for i in range(8):  # near copies that are no near copies line by line
        words = prose(6000 + i, 200).split()
        cut = [" ".join(words[k : k + 8]) for k in range(0, 200, 8)]
        words[20 * i + 3] = "changed"
        other = [" ".join(words[k : k + 11]) for k in range(0, 200, 11)]
        rows += [(300 + i, "\n".join(cut)), (320 + i, "\n".join(other))]
    rows += [(400 + i, prose(7000 + i, 80) + " " + (t or "") + " " + prose(8000 + i, 30)) for i, t in ITEMS]
    rows += [(3, texts[3]), (3, texts[3]), (500, texts[4]), (501, texts[5].upper()), (502, shared), (None, shared), (None, prose(66, 50)), (None, prose(66, 50)), (3, prose(55, 45))]
    rows += [(600, None), (600, None), (601, ""), (602, " \n\n "), (603, prose(1, 20_000))]
    rng.shuffle(rows)
    return [(i, t, ("en", None)[len(t or "") % 2], f"s{len(t or '') % 3}", None if t is None else len(t)) for i, t in rows]  # repeated rows repeat in full


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("pipeline"))
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    ids = sorted({r[0] for r in rows if r[0] is not None and r[0] < 200})
    spark.createDataFrame([(i, int(i < 100), 0) for i in ids] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows


def held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def brute_quality(rows, labels):
    """Counts, ratios, fit and margins in one process."""
    feats = quality.features([r[1] for r in rows])
    y = {i: q for i, q in labels if i is not None and not held_out(i)}
    counts = np.full((2, quality.BUCKETS), quality.SMOOTHING)
    train = []
    for r, f in zip(rows, feats, strict=True):
        if r[0] in y:
            np.add.at(counts[y[r[0]]], f, 1)
            train.append((f.astype(np.int32).tobytes(), y[r[0]]))
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train.sort()
    w, b = quality.fit_hinge([np.frombuffer(x, np.int32) for x, _ in train], np.array([1.0 if q else -1.0 for _, q in train]), ratio)
    w = 0.75 * w + 0.25 * np.abs(w).mean()
    return [r for r, f in zip(rows, feats, strict=True) if (w * ratio)[f].sum() / (np.sqrt((ratio[f] ** 2).sum()) or 1.0) + b >= 0]


def brute_line_stage(rows):
    out = []
    for r, gone in zip(rows, brute_lines([r[:2] for r in rows]), strict=True):
        lost = {k for k, _ in gone}
        text = r[1] and "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in lost)
        if not lost or text.strip():
            out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def brute_near_stage(rows):
    """The row that is least by id and MD5 of its text, of each class; null and empty texts stay."""
    root = brute_near([(k, r[1]) for k, r in enumerate(rows)])
    classes = defaultdict(list)
    for k, r in enumerate(rows):
        classes[root[k] if r[1] else ("alone", k)].append(r)
    return [min(c, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())) for c in classes.values()]


def brute_benchmark_stage(rows):
    def grams(t, k):
        w = WORDS.findall((t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def clean(text):
        for _, t in ITEMS:
            k = min(5, len(WORDS.findall((t or "").lower())))
            if k and len(grams(t, k) & grams(text, k)) >= 0.8 * len(grams(t, k)):
                return False
        return True

    return [r for r in rows if clean(r[1])]


def brute_encode_stage(rows):
    import regex
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(path)), special_tokens={})
    pattern, out = regex.compile(public_tokenizers.PATTERN), []
    for i, text, *_ in rows:
        ids = [k for word in pattern.findall(text or "") for k in enc.encode_ordinary(word)]
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest(), tuple(ids)))
    return out


BRUTE = {"lines": brute_line_stage, "near": brute_near_stage, "benchmark": brute_benchmark_stage, "encode": brute_encode_stage}


def plain(df):
    return [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()]


def test_stages_and_their_hand_over(spark, tables, tmp_path):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "encode"]
    want, kept = rows, {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        want = brute_quality(want, labels) if name == "quality" else BRUTE[name](want)
        if name == "encode":
            assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        else:
            assert got.schema.simpleString() == docs.schema.simpleString()
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert Counter(plain(docs)) == Counter(want), name
        kept[name] = Counter(r[0] for r in want)
    # the decisions that brute force above takes, spelt out
    assert not any(100 <= (i or 0) < 200 for i in kept["quality"]) and kept["quality"][600] == 2
    assert kept["lines"][502] == 0 and kept["lines"][601] == kept["lines"][602] == 1 and kept["lines"][600] == 2  # one lost all it had, the others had nothing to lose
    assert all(kept["near"][300 + i] + kept["near"][320 + i] == 1 for i in range(8)) and kept["near"][3] == 2
    assert [i for i in (400, 401, 402) if kept["benchmark"][i]] == [] and kept["benchmark"][407] == kept["benchmark"][408] == 1
    # run() is the same, with its own tables between the stages
    assert Counter(plain(corpus_pipeline.run(spark, sf))) == Counter(want)


def test_stages_keep_other_columns_and_take_empty_tables(spark, tables):
    sf, _ = tables
    more = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30").withColumns({c: F.lit(k) for k, c in enumerate(("_key", "id", "row", "lines", "dropped_lines", "class_id"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more, sf).columns == more.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, more.where("false"), sf).count() == 0, name


def test_encoded_documents_decode_to_their_texts(spark, tables):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = bpe.encode_documents(docs, public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.decoded_sha256) for r in out.collect()) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert re.fullmatch("[0-9a-f]{64}", out.first().ids_sha256)
