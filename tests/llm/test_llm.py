"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textaudit.llm import ann, bpe, chat_format, decontaminate, license_scan, linededup, neardup, quality, sharding, textblocks, url_filter

WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")
DOCS = "doc_id long, text string, id int, uid int, line int, shard string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def odd_docs(spark):
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "two words"), (7, "two words"), (None, prose(2, 40)), (8, prose(3, 30_000)), (9, "  \n\n "), (9, "  \n\n "), (10, "x" * 40_000)]
    return spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- hashing ----------------------------------------------------------------------------------------------------------
def test_hashes_agree_with_words():
    texts = ["", "One two, one TWO three four five", None, "été été ß Ünï one", "a-b_c 12x", prose(5, 400)]
    for first, block in textblocks.blocks(texts, most=64):
        words, counts = textblocks.word_hashes(block)
        real = [WORDS.findall(b.decode()) for b in block]
        assert counts.tolist() == [len(r) for r in real]
        seen = {}
        for w, h in zip([w for r in real for w in r], words.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# --- op 1 -------------------------------------------------------------------------------------------------------------
def test_quality_separates_and_scores_odd_texts(spark):
    good = [(i, prose(i, 60).capitalize() + ".", 1) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(100 + i, 60).split()), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in good + bad], "doc_id long, text string, _y int")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad if i % 3] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = {i: q for i, _, q in good + bad if i % 3 == 0}
    assert np.mean([got[i].predicted == q for i, q in truth.items()]) >= 0.95
    odd = quality.score(odd_docs(spark), model).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert quality.score(empty_docs(spark), model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    one_class = quality.train(docs, labels.where("quality = 1"))
    assert all(r.predicted == 1 for r in quality.score(docs, one_class).collect())


def test_hinge_fit_is_deterministic_and_separates():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, 8, replace=False) + 50 * (i % 2)).astype(np.int32) for i in range(40)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    w, b = quality.fit_hinge(rows, y, np.ones(100))
    assert all(np.sign(w[r].sum() / np.sqrt(8) + b) == k for r, k in zip(rows, y, strict=True))
    again = quality.fit_hinge(rows, y, np.ones(100))
    assert np.array_equal(w, again[0]) and b == again[1]


def test_quality_agrees_with_plain_counting(spark):
    """Ratios, scaling, fit and scores, recomputed in one process over the same features; features by plain n-grams of bytes."""
    rng = random.Random(12)
    rows = [(i, (prose(i, rng.randrange(1, 40)) if i % 2 else prose(i, 30).upper() + "!?"), i % 2) for i in range(80)] + [(90, "", 1), (91, None, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    feats = dict(zip([i for i, _, _ in rows], quality.features([t for _, t, _ in rows]), strict=True))
    for i, t, _ in rows:
        grams = {(t or "").encode()[k : k + 4] for k in range(max(0, len(t or "") - 3))}
        assert len(grams) <= len(feats[i]) <= len(grams) + 3 * len((t or "").split()) + 1
    counts = np.full((2, quality.BUCKETS), quality.SMOOTHING)
    for i, _, q in rows:
        if i % 5:
            for b in feats[i].tolist():
                counts[q, b] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train = sorted((feats[i].astype(np.int32).tobytes(), q) for i, _, q in rows if i % 5)
    w, b = quality.fit_hinge([np.frombuffer(x, np.int32) for x, _ in train], np.array([1.0 if q else -1.0 for _, q in train]), r)
    w = 0.75 * w + 0.25 * np.abs(w).mean()
    for i, f in feats.items():
        norm = np.sqrt((r[f] ** 2).sum()) or 1.0
        assert abs(1 / (1 + np.exp(-4 * ((w * r)[f].sum() / norm + b))) - got[i]) < 1e-4


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 400)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, fit = [], quality.fit_hinge
    monkeypatch.setattr(quality, "fit_hinge", lambda rows, y, r: (seen.append(sum(x.nbytes for x in rows)), fit(rows, y, r))[1])
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", seen[0] // 3)
    quality.train(docs, labels)
    assert 0 < seen[1] < seen[0] / 2


# --- op 2 -------------------------------------------------------------------------------------------------------------
def shingles_of(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute_lines(rows):
    """For every row the set of (line, keeper id) that it loses; rows that repeat an id and a text after the first lose all."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, hashlib.md5((rows[r][1] or "").encode()).digest()))
    at = defaultdict(list)
    for r in order:
        for k, line in enumerate((rows[r][1] or "").split("\n")):
            if n := linededup.normal(line):
                at[n].append((r, k))
    keys = list(at)
    grams = {k: shingles_of(k) for k in keys}
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = grams[keys[a]], grams[keys[b]]
            if len(x & y) >= 0.8 * len(x | y):
                root[find(keys[a])] = find(keys[b])
    classes = defaultdict(list)
    for k in keys:
        classes[find(k)] += at[k]
    out = [set() for _ in rows]
    place = {r: n for n, r in enumerate(order)}
    for places in classes.values():
        keeper = min(places, key=lambda p: (place[p[0]], p[1]))
        for r, k in places:
            if (r, k) != keeper:
                out[r].add((k, rows[keeper[0]][0]))
    return out


def assert_lines(spark, rows, extra=()):
    """dedup_lines gives what brute force gives, row by row (rows that repeat id and text in any order)."""
    schema = "doc_id long, text string" + "".join(f", {c} int" for c in extra)
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], schema)
    out = linededup.dedup_lines(docs)
    assert out.columns[: 2 + len(extra)] == ["doc_id", "text", *extra] and len(set(out.columns)) == 5 + len(extra)
    want = Counter()
    for (i, t), gone in zip(rows, brute_lines(rows), strict=True):
        lost = {k for k, _ in gone}
        kept = t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
        want[(i, kept, *range(len(extra)), tuple(sorted(gone)) or None, len(t.split("\n")) if t else 0)] += 1
    n = 2 + len(extra)
    got = Counter((*r[:n], tuple(sorted(zip(r[n], r[n + 1], strict=True))) if r[n] else None, r[n + 2]) for r in out.collect())
    assert got == want
    return want


def test_lines_agree_with_brute_force(spark):
    base = [prose(i, 12) for i in range(12)]
    chain = [prose(99, 60)]
    for k in range(8):  # each is near the one before, the ends are not near each other
        words = chain[-1].split()
        words[5 * k] = "changed%d" % k
        words[5 * k + 1] = "again%d" % k
        chain.append(" ".join(words))
    rng = random.Random(4)
    rows = []
    for i in range(60):
        lines = [rng.choice(base + chain) if rng.random() < 0.6 else prose(1000 + i * 10 + j, 9) for j in range(4)]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, base[0].upper() + "  "), (104, "a\na\nA"), (105, "\u3000a\u00a0\t b\r\na b")]
    assert_lines(spark, rows)


def test_lines_of_rows_that_share_ids(spark):
    """Rows are told apart by id and text; of rows that repeat both one keeps its lines; clashing names; null ids."""
    one, two, three, four = (prose(400 + i, 12) for i in range(4))
    rows = [(1, one), (2, one + "\n" + two), (2, three + "\n" + four), (2, three + "\n" + four), (7, four), (None, two), (None, two), (None, None), (8, "  "), (8, "  "), (9, one)]
    rows += [(11, prose(500, 30))] * 25
    assert_lines(spark, rows, ("_id", "_dropped", "_keepers", "_n_lines", "n_lines", "dropped_lines", "keepers", "_key", "_first", "_lines", "_rid", "_number", "_least"))


def test_short_fuzzy_lines_by_characters(spark):
    """One edit in mid-line is found from 49 characters on, in any script; the brute force has shingles of its own."""
    rng, rows = random.Random(8), []
    for alphabet, edit in (("abcdefghijklmnopqrst ", "z"), ("éèêàâîôùûçäöüßñ ", "ÿ"), ("абвгдежзийклмнопрстуфхц ", "я"), ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "龍"), ("0123456789,. ", "x")):
        for n in (20, 48, 49, 60, 78):
            line = "".join(rng.choice(alphabet) for _ in range(n - 1)).strip().ljust(n, alphabet[0])
            line = linededup.normal(line).ljust(n, alphabet[0])
            rows += [(len(rows), line), (len(rows) + 1, line[: n // 2] + edit + line[n // 2 + 1 :])]
    rows += [(len(rows) + i, t) for i, t in enumerate(("-----", "--------", "----", "ababab", "bababa", "aaaaab", "aaaaaab", "one", "two"))]
    grams = {i: {t[j : j + 5] for j in range(max(1, len(t) - 4))} for i, t in ((i, linededup.normal(t)) for i, t in rows)}
    keeper = {i: min(j for j in grams if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])) for i in grams}
    out = linededup.dedup_lines(spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in rows], DOCS)).collect()
    got = {r.doc_id: r.keepers[0] for r in out if r.keepers}
    assert got == {i: k for i, k in keeper.items() if i != k}
    assert len(got) == 5 * 3 + 3


def test_lines_of_odd_tables(spark):
    out = linededup.dedup_lines(odd_docs(spark))
    assert out.count() == 12 and out.columns[:6] == [c.split()[0] for c in DOCS.split(", ")]
    assert linededup.dedup_lines(empty_docs(spark)).count() == 0


def test_parts_of_one_leader_give_the_same_links(spark, monkeypatch):
    """A leader whose lines don't fit in one part loses no link."""
    base = prose(7, 50).split()
    rows = []
    for i in range(40):
        words = list(base)
        for k in range(10):
            words[(7 * (i // 2) + 5 * k) % 50] = f"edit{i // 2}x{k}"
        if i % 2:
            words[49] = f"last{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(linededup, "PART_BYTES", 3000)
    assert_lines(spark, rows)


def test_near_threshold_members_visit_other_parts(spark, monkeypatch):
    """Texts that all share a template but hold pairs of near copies far from the leader: links across parts only."""
    head = prose(70, 30)
    tails = [prose(700 + i, 12) for i in range(60)]
    rows = [(i, f"{head} {tails[i // 2]}{'' if i % 2 else ' x'}") for i in range(120)]
    rng = random.Random(3)
    rng.shuffle(rows)
    monkeypatch.setattr(linededup, "PART_BYTES", 2000)
    want = assert_lines(spark, rows)
    assert sum(len(k[2] or ()) for k in want) >= 60


def test_bands_of_lines_are_on_disk_once(spark, monkeypatch):
    """Buckets are gone round by round before the lines are joined; a payload numbers few lines, and more payloads lose no link."""
    from pathlib import Path

    kept, entries, put = [], [], linededup.Scratch.put

    def watched(self, df, *by):
        out = put(self, df, *by)
        where = Path(self.base.removeprefix("file://"))
        kept.append(len(list(where.glob("*/kind=*"))))
        if by:
            entries.append(out.selectExpr("sum(octet_length(payload))", "count_if(kind = 0)").first())
        return out

    monkeypatch.setattr(linededup.Scratch, "put", watched)
    monkeypatch.setattr(linededup, "SEGMENT", 16, raising=False)
    rows = [(i, "\n".join([prose(40 + i % 5, 20), prose(900 + i, 12), prose(60 + i % 7, 16) + " x" * (i % 2)])) for i in range(40)]
    assert_lines(spark, rows)
    sent, lines = entries[0]
    assert sent == 10 * linededup.BANDS * lines > 0
    at = [n for n in kept if n]
    assert at[0] > 1 and at[: at[0] + 1] == [at[0], *range(at[0], 0, -1)]  # one less at each put behind the first round's


def test_lines_that_met_by_chance_are_parted(spark, monkeypatch):
    """Where all lines share all bands, only those that could be alike are compared, and no link is lost."""
    made, compare, compared = linededup.signatures, linededup.exact_links, []

    def all_meet(hashes, grams):
        out = made(hashes, grams)
        bands = out[0] if isinstance(out, tuple) else out
        bands[:] = np.arange(bands.shape[1])
        return out

    def watched(members, *rest):
        compared.extend(members.select("text").distinct().collect())
        return compare(members, *rest)

    monkeypatch.setattr(linededup, "signatures", all_meet)
    monkeypatch.setattr(linededup, "exact_links", watched)
    alone, pairs = [prose(2000 + i, 90) for i in range(30)], [(prose(3000 + i, 90), prose(3000 + i, 90) + " x y") for i in range(6)]
    rows = [(i, t) for i, t in enumerate([*(a for a, _ in pairs), *alone, *(b for _, b in pairs)])]
    assert_lines(spark, rows)
    texts, alike = {r.text for r in compared}, {t for p in pairs for t in p}
    assert alike <= texts and len(texts - alike) <= 4  # a pair in a thousand has near sketches, too


def test_screen_parts_groups_at_far_sketches():
    bits = [np.zeros(108, np.uint8) for _ in range(6)]
    bits[1][:] = bits[2][:] = bits[3][:] = 1  # far from the leader
    bits[2][:36], bits[3][:72] = 0, 0  # 2 is near 1 and 3; 3 is far from 1, and near the leader by one bit at most
    bits[3][71] = 1
    bits[4][:50] = 1  # far from all others
    bits[4][90:] = 1
    sketch = [np.packbits(b).tobytes() for b in bits]

    def screen(rows):
        out = linededup._screen(pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "sketch": pa.array([r[2] for r in rows], pa.binary())}))
        return sorted(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))

    assert screen([(13, 10, sketch[3]), (10, 10, sketch[0]), (12, 10, sketch[2]), (11, 10, sketch[1]), (14, 10, sketch[4])]) == [(11, 11), (12, 11), (13, 11)]
    # groups are apart, whatever their order; a line without a sketch is near to all; a group can be gone
    assert screen([(5, 3, sketch[1]), (9, 2, None), (2, 2, sketch[0]), (3, 3, sketch[0]), (7, 2, sketch[1])]) == [(2, 2), (7, 2), (9, 2)]
    assert screen([]) == []


# --- op 3 -------------------------------------------------------------------------------------------------------------
def test_containment_agrees_with_brute_force(spark):
    items = [(i, prose(200 + i, n)) for i, n in enumerate([4, 5, 9, 17, 33, 70, 140, 400, 1, 6, 7, 8])] + [(20, ""), (21, None), (3, prose(203, 17))]
    rows = [(100 + i, prose(i, 300) + " " + (t or "") + ". " + prose(50 + i, 2000 * (i % 3))) for i, t in items]
    half = prose(206, 140).split()
    half[10:16] = ["x"] * 6
    rows += [(1, prose(1, 5000)), (2, " ".join(half)), (3, None), (4, ""), (5, "tiny"), (6, items[5][1].upper())]
    docs = spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in rows], DOCS)
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, id int")

    def grams(t, k):
        w = WORDS.findall((t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, t in set(items):
        k = min(5, len(WORDS.findall((t or "").lower())))
        for d, text in rows:
            if k and (g := grams(t, k)) and len(g & grams(text, k)) >= 0.8 * len(g):
                want.add((d, i, len(g & grams(text, k)), len(g)))
    got = {tuple(r) for r in decontaminate.find_contained(docs, bench).collect()}
    assert got == want and len(want) > 8
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, *_ in want}
    assert decontaminate.find_contained(empty_docs(spark), bench).count() == 0
    assert decontaminate.find_contained(docs, bench.where("false")).count() == 0


# --- op 4 -------------------------------------------------------------------------------------------------------------
def test_shards_are_even_and_gapless(spark):
    rows = [(i, "same" if i % 3 else prose(i, 5), 0, 1, 2, "s") for i in range(1003)] + [(5, "same", 0, 1, 2, "s")] * 40 + [(None, None, 0, 1, 2, "s")] * 3
    out = sharding.assign_shards(spark.createDataFrame(rows, DOCS), 16).collect()
    assert len(out) == len(rows)
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert len(per) == 16 and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.assign_shards(empty_docs(spark), 16).count() == 0


def test_bounded_loads_move_little():
    rng = random.Random(2)
    counts = Counter(rng.randrange(sharding.RING) for _ in range(50_000))
    home = dict(zip(range(sharding.RING), range(sharding.RING), strict=True))
    nodes = sharding.ring(16)
    import bisect

    cells = [c for c, _ in nodes]
    moved = sum(hi - lo for cell, lo, hi, shard, _ in sharding.runs(counts, 16) if shard != nodes[bisect.bisect_left(cells, home[cell]) % len(cells)][1])
    assert moved < 0.1 * 50_000
    assert sum(hi - lo for _, lo, hi, *_ in sharding.runs(counts, 16)) == 50_000


def test_shards_agree_with_a_ring_walk(spark):
    """Row by row: the home's shard while it has room, then clockwise; and what one more shard moves."""
    keys = {c: [f"{c}.{k}" for k in range(n)] for c, n in Counter(random.Random(2).choices(range(0, sharding.RING, 97), k=5000)).items()}
    keys[5] = [f"hot.{k}" for k in range(2500)]
    where = {}
    for shards in (16, 17):
        n = sum(map(len, keys.values()))
        room = [n // shards + (s < n % shards) for s in range(shards)]
        nodes = sharding.ring(shards)
        home = {c: min((k for k, (cell, _) in enumerate(nodes) if cell >= c), default=0) for c in keys}
        want, over = {}, []
        for c in sorted(keys):
            for k in range(len(keys[c])):
                s = nodes[home[c]][1]
                if room[s]:
                    room[s] -= 1
                    want[c, k] = s
                else:
                    over.append((c, k))
        for c, k in over:
            at = home[c]
            while not room[nodes[at % len(nodes)][1]]:
                at += 1
            want[c, k] = nodes[at % len(nodes)][1]
            room[want[c, k]] -= 1
        runs = sharding.runs({c: len(x) for c, x in keys.items()}, shards)
        got = {(c, k): s for c, lo, hi, s, _ in runs for k in range(lo, hi)}
        assert got == want and sum(hi - lo for _, lo, hi, _, _ in runs) == n
        where[shards] = got
    moved = np.mean([where[16][x] != where[17][x] for x in where[16]])
    assert moved < 0.35  # all keys placed anew would move 16 of 17


# --- op 5 -------------------------------------------------------------------------------------------------------------
def brute_near(rows):
    n, df, sets = len(rows), Counter(), []
    for _, t in rows:
        w = WORDS.findall((t or "").lower())
        s = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets.append(s)
        df.update(s.keys())
    weights = [{s: c * (1 + 0.25 * log((1 + n) / (1 + df[s])) / log(1 + n)) for s, c in x.items()} for x in sets]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = weights[a], weights[b]
            both = sum(min(v, y[s]) for s, v in x.items() if s in y)
            if rows[a][1] and (rows[a][1] == rows[b][1] or both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)):
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for k in range(n):
        classes[find(k)].append(rows[k][0])
    return {i: min(c) for c in classes.values() for i in c}


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(8)
    rows, i = [], 0
    for g in range(25):
        words = prose(g, rng.choice([8, 40, 150, 400])).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = prose(rng.randrange(10**6), 1)
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(900, "Two Words"), (901, "two words!"), (902, None), (903, None), (904, ""), (905, "..."), (906, "..."), (907, "!!!")]
    docs = spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in rows], DOCS)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_near(rows)


def test_parts_of_one_leader_give_the_same_classes(spark, monkeypatch):
    base = prose(7, 200).split()
    rows = []
    for i in range(30):
        words = list(base)
        for k in range(5):
            words[(7 * (i // 2) + 39 * k) % 200] = f"edit{i // 2}x{k}"
        if i % 2:
            words[199] = f"last{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(neardup, "PART_BYTES", 8000)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows) and len(set(got.values())) > 1


def test_near_duplicates_of_odd_tables(spark):
    got = sorted((r.doc_id or -1, r.class_id, r.class_size) for r in neardup.near_duplicates(odd_docs(spark)).collect())
    assert len(got) == 12 and [c for i, c, _ in got if i in (1, 2, 3)] == [1, 1, 1] and [c for i, c, _ in got if i in (4, 5)] == [4, 5]
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_packed_shingles_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        for top in (2**20, 2**56):
            h = np.unique(rng.integers(0, top, n).astype(np.uint64))
            d, tf, c = (rng.integers(1, high, len(h)) for high in (2, 3, 2**40))
            packed = neardup._Bytes().put_sorted(h).put_counts(d).put_counts(tf).put(c)
            back = neardup._Bytes(packed.data).put_counts(c)
            got = back.get_sorted(), back.get_counts(), back.get_counts(), back.get(np.int64), back.get_counts()
            assert all(np.array_equal(x, y) for x, y in zip(got, (h, d, tf, c, c), strict=True))


def test_one_row_of_each_class_stays(spark):
    """Rows are told apart by id and text: the case of rows that share ids, repeated rows, null ids, clashing names."""
    x, y = prose(31, 60), prose(32, 60)
    tail = y.rsplit(" ", 1)[0] + " tail"
    rows = [(1, x), (2, x), (2, y), (7, tail), (8, x), (8, x), (9, None), (9, None), (10, ""), (10, ""), (11, prose(33, 60)), (11, prose(33, 60)), (None, prose(34, 60)), (None, prose(34, 60))]
    docs = spark.createDataFrame([(i, t, *range(8)) for i, t in rows], "doc_id long, text string, id int, row int, root int, class_id int, least int, _key int, _rid int, _first int")
    got = Counter((r[0], r[1]) for r in neardup.drop_copies(docs).collect())
    want = Counter([(1, x), (2, y), (9, None), (9, None), (10, ""), (10, ""), (11, prose(33, 60)), (None, prose(34, 60))])
    assert got == want and neardup.drop_copies(docs).columns == docs.columns
    assert neardup.drop_copies(empty_docs(spark)).count() == 0


# --- op 6 -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("depth", [1.0, ann.DEPTH])
def test_nearest_agrees_with_brute_force(spark, depth):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[300:500] = v[7]
    rows = [(i, [float(y) for y in x], 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] * 8, 0), (1004, [], 0), (None, [1.0] * 16, 0), (2000, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), depth=depth).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}  # alone of its length, 2000 finds nothing
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(len(v)), d)) if i != q][:10]
        hits += len(set(order) & {i for i, _ in found})
        assert all(abs(d[i] - s) < 1e-9 for i, s in found)
        if depth == 1.0:
            assert [i for i, _ in found] == order
    assert hits >= 0.9 * 70
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_recall_on_a_given_table(spark):
    """Against brute force on the whole embeddings table, through the index: a block of any size reranks the same share of itself."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.where(ann.usable(F.col("embedding"))).collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    assert ann.DEPTH * len(v) < 100
    hits = total = 0
    found = defaultdict(set)
    for r in ann.nearest(table, table.where("vec_id % 20 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    for q in ids[ids % 20 == 0].tolist():
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)).tolist() if ids[i] != q][:10]
        hits += len(found[q] & set(ids[order].tolist()))
        total += 10
    assert hits >= 0.9 * total


# --- op 7 -------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,\nmodify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "Text.\nLicensed under CC BY-NC 4.0.\nmore"), (2, mit), (3, "The license of this is unknown."), (4, None), (5, ""), (6, "# SPDX-License-Identifier: Apache-2.0"), (7, "Released under the MIT License. This work is licensed under the GNU General Public License, version 3."), (8, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.")]
    got = {r.doc_id: (r.licenses, r.unmatched_ids) for r in license_scan.scan_licenses(spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in rows], DOCS)).collect()}
    assert got == {1: ("CC-BY-NC-4.0", ""), 2: ("MIT", ""), 6: ("Apache-2.0", ""), 7: ("GPL-3.0,MIT", ""), 8: ("", "bsd-source")}
    assert license_scan.scan_licenses(empty_docs(spark)).count() == 0
    assert all(re.search(license_scan.HINTS, s) for s in license_scan.known_sentences())


#: Licences and the paragraphs of their headers, as the licences' own texts have them.
GPL_BODY = "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GPL_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
MIT_ASIS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."
BSD_TEXT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
BSD_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
APACHE_ASIS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License."
HEADERS = [
    ("GPL-3.0-or-later", (f"This program is free software: you can redistribute it and/or modify {GPL_BODY.format(3)}", GPL_HOPE)),
    ("GPL-3.0-or-later", (f"This program is free software; you can redistribute it and/or modify {GPL_BODY.format(3)}",)),
    ("GPL-2.0-or-later", (f"This program is free software; you can redistribute it and/or modify {GPL_BODY.format(2)}", GPL_HOPE)),
    ("GPL-2.0-or-later", (f"This program is free software; you can redistribute it and/or modify {GPL_BODY.format(2)}",)),
    *[("MPL-2.0", (f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{s}://mozilla.org/MPL/2.0/.",)) for s in ("", "s")],
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("MIT", (*MIT_TEXT, MIT_ASIS)), ("MIT", MIT_TEXT), ("BSD-2-Clause", BSD_TEXT), ("BSD-3-Clause", (*BSD_TEXT, BSD_ENDORSE)),
    ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("Apache-2.0", (APACHE, "http://www.apache.org/licenses/LICENSE-2.0", APACHE_ASIS)), ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("AGPL-3.0", ("Licensed under the GNU Affero General Public License, version 3.",)), ("LGPL-3.0", ("Licensed under the GNU Lesser General Public License, version 3.",)),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3.",)), ("GPL-2.0", ("Licensed under the GNU General Public License, version 2.",)), ("MIT", ("This project is licensed under the MIT License.",)),
    ("CC-BY-NC-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",)), ("CC-BY-SA-4.0", ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)), ("CC0-1.0", ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",)),
]
TAGS = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "ISC": "ISC", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPL-3.0-only": "GPL-3.0", "GPL-2.0-only": "GPL-2.0",
    "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC0-1.0": "CC0-1.0",
}


GPL_OLD = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
HEADERS += [
    *[(f"GPL-{v}.0-or-later", (f"This program is free software; you can redistribute it and/or modify {GPL_OLD.format('', v)}", *more)) for v in (2, 3) for more in ((), (GPL_HOPE,))],
    ("LGPL-2.1", (f"This library is free software; you can redistribute it and/or modify {GPL_OLD.format('Lesser ', '2.1')}",)),
    ("LGPL-3.0", (f"This library is free software; you can redistribute it and/or modify {GPL_OLD.format('Lesser ', '3')}",)),
    *[("LGPL-3.0", (f"This {what} is free software: you can redistribute it and/or modify {GPL_BODY.format(3).replace('GNU ', 'GNU Lesser ')}",)) for what in ("library", "program")],
    *[("AGPL-3.0", (f"This program is free software: you can redistribute it and/or modify {GPL_BODY.format(3).replace('GNU ', 'GNU Affero ')}", *more)) for more in ((), (GPL_HOPE,))],
    ("Unlicense", ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
    ("Zlib", ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:")),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    *[("EPL-2.0", (f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}2.0 which is available at {h}://www.eclipse.org/legal/epl-2.0/",)) for v, h in (("", "https"), ("v. ", "http"))],
]
TAGS |= {"Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "EPL-2.0": "EPL-2.0"}


def walk(ids):
    """Licences and identifiers left by a pointer for each rule, in plain Python."""
    found, rest = [], list(enumerate(ids))
    for name, need in license_scan.RULES:
        seen, used, done = 0, [], set()
        for at, k in rest:
            if k == need[seen]:
                used, seen = [*used, at], seen + 1
                if seen == len(need):
                    done |= set(used)
                    seen, used = 0, []
        if done:
            found.append(name)
            rest = [x for x in rest if x[0] not in done]
    return found, [k for _, k in rest]


def test_ordered_rules_agree_with_a_walk(spark):
    rng = random.Random(6)
    families = [["mit-grant", "mit-notice", "mit-asis", "mit-ref"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], ["gpl-free-1", "gpl-free-2", "gpl-pub", "later-2", "later-3", "gpl-hope-1", "gpl-hope-2"]]
    rows = [(["mit-notice", "mit-grant", "mit-notice"],), (["mit-grant", "mit-grant", "mit-notice", "mit-notice"],), ([],), (["bsd-binary", "bsd-source", "bsd-grant"],)]
    rows += [([rng.choice(rng.choice(families[: 1 + k % 3])) for _ in range(rng.randrange(1, 12))],) for k in range(300)]
    got = spark.createDataFrame(rows, "ids array<string>").select("ids", license_scan.matched(F.col("ids")).alias("m")).select("ids", "m.found", "m.rest").collect()
    assert [(r.found, r.rest) for r in got] == [walk(r.ids) for r in got] and len(got) == len(rows)
    assert got[0].found == ["MIT"] and got[0].rest == ["mit-notice"]


def test_licences_of_long_tied_and_repeated_texts(spark):
    """A sentence at the end of a long text; a tie of the two readings goes to lines; rows that share an id, repeat or have none are texts of their own."""
    long = (prose(1, 60) + ".\n") * 3000 + MIT_TEXT[0]
    rows = [(1, long), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (3, MIT_TEXT[1]), (3, MIT_TEXT[0]), (None, "Licensed under CC BY 4.0."), (None, "Released under the MIT License."), (4, "")]
    got = [tuple(r) for r in license_scan.scan_licenses(spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in rows], DOCS)).collect()]
    mit = (2, "MIT", "mit-ref", "")
    want = [(1, "", "mit-grant", "mit-grant"), mit, mit, (3, "", "mit-notice", "mit-notice"), (3, "", "mit-grant", "mit-grant"), (None, "CC-BY-4.0", "ccby4-ref", ""), (None, "MIT", "mit-ref", "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_licence_headers_in_both_readings(spark):
    """Every rule fires on its licence's header: a paragraph a line, and wrapped behind comment marks. No known sentence is one that the cutter never leaves whole."""
    texts = [(name, text) for name, parts in HEADERS for text in ("\n\n".join(parts), "\n\n".join(textwrap.fill(p, 60, initial_indent=" * ", subsequent_indent=" * ") for p in parts))]
    texts += [(name, f"/* SPDX-License-Identifier: {tag} */\ncode") for tag, name in TAGS.items()]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, (_, t) in enumerate(texts)], DOCS)).collect()}
    assert [(got[i].licenses, got[i].unmatched_ids) if i in got else None for i in range(len(texts))] == [(name, "") for name, _ in texts]
    assert {k for r in got.values() for k in r.sentence_ids.split(",")} == set(license_scan.known_sentences().values())
    assert {name for name, _ in texts} == {name for name, _ in license_scan.RULES}
    for way in (license_scan.by_line, license_scan.by_paragraph):
        rows = [(s, f"{s.capitalize()}. Next") for s in license_scan.known_sentences()]
        cut = spark.createDataFrame(rows, "s string, t string").select("s", license_scan.normal(F.get(way(F.col("t")), F.lit(0))).alias("first")).collect()
        assert all(r.s == r.first for r in cut)



# --- op 8 -------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    pieces = ["</s>", "[INST]", "[/INST]", "<s>", "[SYS] ", " [/SYS]", "[ROLE x] ", "[/ROLE]", "\\e", "\\l", "\\", "[", "<", "]", "a", " ", "\n", "é", "日", ""]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]x", "", None]), rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for c in range(120) for t in range(rng.randrange(1, 6))]
    rows += [(200, 0, "assistant", "x" * 200_000), (None, 0, "user", "no id"), (201, 1, "user", "same"), (201, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as open")
    out = chat_format.format_conversations(df).collect()
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    assert len(out) == len(want) and all(r.round_trip for r in out)
    undo = lambda s: s.replace("\\c", "]").replace("\\b", "[").replace("\\l", "<").replace("\\e", "\\")
    for r in out:
        said = [x for _, role, x in sorted(want[r.conv_id]) if role == "assistant"]
        raw = r.formatted.encode()
        assert [undo(raw[s.start : s.start + s.bytes].decode()) for s in r.loss_spans] == said
    assert chat_format.format_conversations(df.where("false")).count() == 0


# --- op 9 -------------------------------------------------------------------------------------------------------------
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(spark):
    path, pattern, real = tokenizer()
    rng = random.Random(1)
    texts = [None, "", "a" * 5000, "ab" * 3000, "aaaa bbbb  \n\n\t x", "日本語のテキスト" * 30, "</s>[INST] ok [/INST]", " the" * 99 + "   ", "\x00\x01\x1c\x1d \x85\xa0", "<|endoftext|>", prose(1, 500)]
    texts += ["".join(rng.choice("abcdeéß ñth \n'\x1c0१") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 0, 1, 2, "s") for i, t in enumerate(texts)], DOCS)
    for r in bpe.encode_documents(docs, path, pattern, keep_ids=True).collect():
        t = texts[r.doc_id] or ""
        ids = real.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(empty_docs(spark), path, pattern).count() == 0


def test_bpe_words_with_low_merges_are_encoded_alone():
    path, _, real = tokenizer()
    vocabulary = bpe.Vocabulary(open(path, "rb").read())
    rng = random.Random(2)
    words = ["".join(rng.choice("aehinostrl") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    assert vocabulary.replay([w.encode() for w in words]) == [real.encode_ordinary(w) for w in words] == [vocabulary.encode_alone(w.encode()) for w in words]


# --- op 10 ------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://x.net", "https://x.net/", "http://b.org/fr/1", "http://b.org/FR/1", "http://x.example.com/de/a", "http://notexample.com/de/a", "ftp://net/en/", "a://b://c/d", "http://u@h.org:80/fr/?x", "http://é.org/fr/é" * 500]
    urls += [f"http://spam{i}.net/buy/{i}" for i in range(40)] + [f"http://good{i}.org/fr/read/{i}" for i in range(40)] + ["http://spam7.com/buy/7", "http://good7.com/fr/read/7", "http://good7.com/fr/read/7"]
    pages = spark.createDataFrame([(i, u, 0, "p", 1) for i, u in enumerate(urls)], "page_id long, url string, host int, path string, _text int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls)

    def parts(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    for i, u in enumerate(urls):
        host, path = parts(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0])
        assert got[i].verdict == (rule[1] or got[i].verdict)
    n = len(urls)
    assert got[n - 3].verdict == "block" and got[n - 2].verdict == got[n - 1].verdict == "allow"
    alone = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")).collect()
    assert alone[0].verdict == "allow"
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_urls_broadcast_a_bounded_number_of_scores(spark, monkeypatch):
    # small files of many n-grams were taken for small tables and broadcast, exploded URLs too
    rng = random.Random(4)
    urls = [f"https://{prose(i % 40, 1)}{rng.choice(['.net', '.org/fr', '.com', '.com/de'])}/{prose(1000 + i, 1)}/{rng.randrange(10**6)}" for i in range(600)] + [None, "", "x"] + ["https://a.net/b"] * 30
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    plans, sent = [], []
    put, broadcast = url_filter.Scratch.put, F.broadcast
    monkeypatch.setattr(url_filter.Scratch, "put", lambda self, df, *by: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(self, df, *by))
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    rows = {}
    for often in (1 << 16, 64):
        monkeypatch.setattr(url_filter, "OFTEN", often, raising=False)
        sent.clear()
        out = url_filter.judge_urls(pages)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        assert sent and all(n < often for n in sent), (often, sent)
        rows[often] = sorted(tuple(r) for r in out.collect())
    assert rows[1 << 16] == rows[64] and len(rows[64]) == len(urls) and len({r[-1] for r in rows[64]}) > 300
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"\bJoin (Inner|LeftAnti|Cross)", line)]
    assert joins and all(re.search(r"strategy=(merge|broadcast)", line) for line in joins), joins
