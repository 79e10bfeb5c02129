"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Per chunk of texts: equal texts collapse to one. The chunk keeps the distinct five-word shingles of each text, with
   counts, as one row (by their numbers in the chunk); its distinct shingles, each with the number of texts and documents that hold it, go to buckets by
   range of their 56-bit hash, packed as one binary per chunk and bucket.
2. Per bucket: exact document frequencies over the whole corpus. A shingle that only one text holds can't be shared by
   two, so only the others go back to their chunks, with frequencies. A shingle that a third of all documents hold is one entry
   per chunk here.
3. Per chunk: weights tf x idf. The weight that a text shares with any other bounds its similarity to it, so a text whose
   shared weight is under THRESHOLD of its total has no near duplicate and needs no signature. The others get SAMPLES
   consistent samples (hash and level), cut in bands.
4. Texts that agree on a band share its least text as leader and are compared by exact weighted Jaccard similarity
   (bandsearch.py): no link between different texts is lost and no pair leaves a task but links.
5. Components of the links are the classes; equal texts follow the least of them.

Groups of copies meet as one row per chunk, band groups only as minima and joins with their least member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bandsearch import exact_links
from .common import Scratch, first_of_repeated, fresh, lean, release_shuffles, same_row, small, table, text_key
from .components import components
from .textblocks import U, blocks, mix, shingle_hashes, unique_by_text, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: How much the inverse document frequency adds to a shingle's weight at most.
IDF_SHARE = 0.25
SAMPLES = BANDS * ROWS
#: Bytes of text and number of documents of a chunk.
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 1 << 16
#: Input bytes for each bucket of shingle hashes.
BUCKET_BYTES = 8 << 20
#: Bytes of the shingle hashes of the texts that are compared together.
PART_BYTES = 4 << 20
HASH_BITS = 56
_POOL = 1 << 16
_rng = np.random.default_rng(20)
GAMMA_R = _rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
LOG_C = np.log(_rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
BETA = _rng.random(_POOL).astype(np.float32)
SEEDS = mix(np.arange(101, 101 + SAMPLES, dtype=U))


class _Bytes:
    """Arrays one behind the other in a binary, each with its length."""

    def __init__(self, data: bytes = b""):
        self.data, self.at = data, 0

    def put(self, x: np.ndarray) -> _Bytes:
        self.data += len(x).to_bytes(8, "little") + x.tobytes()
        return self

    def get(self, dtype) -> np.ndarray:
        n = int.from_bytes(self.data[self.at : self.at + 8], "little")
        out = np.frombuffer(self.data, dtype, n, self.at + 8)
        self.at += 8 + out.nbytes
        return out

    def put_sorted(self, x: np.ndarray) -> _Bytes:
        """Sorted hashes by their differences, as many bytes each as the largest needs, in planes."""
        gaps = np.diff(x)
        width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
        self.put(x[:1]).put(np.array([len(gaps), width], "<i8"))
        return self.put(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).ravel())

    def get_sorted(self) -> np.ndarray:
        first, (n, width) = self.get(U), self.get("<i8").tolist()
        gaps = np.zeros((n, 8), np.uint8)
        gaps[:, :width] = self.get(np.uint8).reshape(width, n).T
        return np.cumsum(np.concatenate((first, gaps.view(U).ravel())), dtype=U)

    def put_counts(self, x: np.ndarray) -> _Bytes:
        """Numbers of which most are 1."""
        at = np.flatnonzero(x != 1)
        return self.put(np.array([len(x)], "<i8")).put(at.astype("<u4")).put(x[at].astype("<u8"))

    def get_counts(self) -> np.ndarray:
        out = np.ones(int(self.get("<i8")[0]), np.int64)
        at = self.get("<u4")
        out[at] = self.get("<u8").astype(np.int64)
        return out


_SENT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
_SENT_DDL = "kind int, key long, chunk long, payload binary"


def _chunk_rows(chunk: int, ids: pa.Array, rows: pa.Array, texts: list, buckets: int):
    """What one chunk sends: its texts' facts and shingles (kind 0, for itself) and its distinct shingles by bucket (kind 1)."""
    import xxhash

    of: dict[bytes, int] = {}
    reps, members = [], []
    for i, t in enumerate(texts):
        # null and empty texts are nobody's copies
        key = xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) if t else None
        if key is None or key not in of:
            if key is not None:
                of[key] = len(reps)
            reps.append((i, key))
            members.append([i])
        else:
            members[of[key]].append(i)
    h, tf, sizes, total = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(reps), np.int64)
    for first, block in blocks([texts[i] for i, _ in reps]):
        v, often, n = unique_by_text(*(lambda s, r: (s >> U(64 - HASH_BITS), r))(*shingle_hashes(*word_hashes(block))))
        total[first : first + len(block)] = np.bincount(np.repeat(np.arange(len(block)), n), weights=often, minlength=len(block)).astype(np.int64)
        h.append(v), tf.append(often), sizes.append(n)
    h, tf, sizes = np.concatenate(h), np.concatenate(tf), np.concatenate(sizes)
    distinct, number = np.unique(h, return_inverse=True)
    copies = np.array([len(m) for m in members])
    flat = pa.array(np.concatenate([np.array(m) for m in members]), pa.int32())
    first_row = pa.array([i for i, _ in reps], pa.int64())
    facts = pa.RecordBatch.from_arrays(
        [pa.array([k for _, k in reps], pa.binary()), rows.take(first_row), pa.array(total), pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(m) for m in members]), pa.int32()), ids.take(flat))],
        ["key", "row", "total", "members"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, facts.schema) as w:
        w.write_batch(facts)
    # its shingles by their number in the chunk; their hashes come back with the frequencies
    of_doc = np.repeat(np.arange(len(reps)), sizes).astype(U)
    own = _Bytes().put(np.frombuffer(sink.getvalue(), np.uint8)).put(np.array([len(distinct)], "<i8")).put_sorted(of_doc * U(len(distinct)) + number.astype(U)).put_counts(tf)
    yield 0, None, chunk, own.data
    holders = np.bincount(number, minlength=len(distinct))
    held = np.bincount(number, weights=np.repeat(copies, sizes), minlength=len(distinct)).astype(np.int64)
    cuts = [0, *np.searchsorted(distinct, (np.arange(1, buckets, dtype=np.float64) * (2.0**HASH_BITS / buckets)).astype(U)).tolist(), len(distinct)]
    for b in range(buckets):
        s = slice(cuts[b], cuts[b + 1])
        if s.start < s.stop:
            yield 1, b, chunk, _Bytes().put(np.array([s.start], "<i8")).put_sorted(distinct[s]).put_counts(holders[s]).put_counts(held[s]).data


def _send(buckets: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < CHUNK_DOCS and size < CHUNK_BYTES:
                    size += len(texts[end] or "")
                    end += 1
                rows = list(_chunk_rows(part << 24 | seq, batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), texts[at:end], buckets))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)
                at, seq = end, seq + 1

    return run


def _frequencies(sent: pa.Table) -> pa.Table:
    """One bucket's shingles of all chunks -> for each chunk its shingles that several texts hold, with document frequencies."""
    chunks, parts = sent.column("chunk").to_pylist(), []
    for p in sent.column("payload").to_pylist():
        b = _Bytes(p)
        start = int(b.get("<i8")[0])
        h = b.get_sorted()
        parts.append((h, b.get_counts(), b.get_counts(), np.arange(start, start + len(h))))
    sizes = [len(p[0]) for p in parts]
    h, texts, docs, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    of = np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    often = np.diff(np.append(first, len(s)))
    keep = np.repeat(np.add.reduceat(texts[order], first) > 1, often)
    df = np.repeat(np.add.reduceat(docs[order], first), often)[keep]
    kept = order[keep]
    back = np.lexsort((at[kept], of[kept]))
    kept, df = kept[back], df[back]
    cuts = np.searchsorted(of[kept], np.arange(len(parts) + 1))
    rows = [(chunks[i], _Bytes().put_sorted(at[kept[a:b]].astype(U)).put_sorted(h[kept[a:b]]).put_counts(df[a:b]).data) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    return pa.table({"kind": pa.array(np.ones(len(rows), np.int32)), "chunk": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def signatures(h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bands (one row of BANDS hashes for each text) of the texts whose weighted shingles start at `first`."""
    log_w = np.log(w).astype(np.float32)
    sizes = np.diff(np.append(first, len(h)))
    out = np.empty((len(first), SAMPLES), U)
    for k, seed in enumerate(SEEDS):
        draw = mix(h ^ seed)
        r = GAMMA_R[(draw & U(0xFFFF)).astype(np.int32)]
        beta = BETA[(draw >> U(16) & U(0xFFFF)).astype(np.int32)]
        t = np.floor(log_w / r + beta)
        a = LOG_C[(draw >> U(32) & U(0xFFFF)).astype(np.int32)] - r * (t - beta) - r
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
        best = least[np.searchsorted(least, first)]  # of equals the least hash: each text's are sorted
        out[:, k] = mix(h[best] + mix(t[best].astype(np.int64).astype(U)))
    bands = np.empty((len(first), BANDS), U)
    for b in range(BANDS):
        x = np.full(len(first), U(b))
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x ^ out[:, k]) + U(1)
        bands[:, b] = x
    return bands


def idf(df, n: int):
    """1 for a shingle of every document, up to 1 + IDF_SHARE for one of a single document.

    The inverse document frequency is scaled to 0..1, or what thousands of near copies have in common would weigh next to
    nothing against a few changed words, and they would not be near copies of each other any more.
    """
    return 1 + IDF_SHARE * np.log((1 + n) / (1 + df)) / np.log(1 + max(n, 1))


def _weigh(n: int, id_type: pa.DataType):
    schema = pa.schema([("uid", pa.int64()), ("key", pa.binary()), ("row", pa.binary()), ("members", pa.list_(id_type)), ("weight", pa.float64()), ("hashes", pa.binary()), ("weights", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(sent: pa.Table) -> pa.Table:
        chunk = sent.column("chunk")[0].as_py()
        own, heard = None, []
        for kind, p in zip(sent.column("kind").to_pylist(), sent.column("payload").to_pylist(), strict=True):
            if kind == 0:
                own = _Bytes(p)
            else:
                heard.append(_Bytes(p))
        facts = pa.ipc.open_stream(pa.py_buffer(own.get(np.uint8))).read_all()
        n_distinct = max(1, int(own.get("<i8")[0]))
        doc, number = np.divmod(own.get_sorted().astype(np.int64), n_distinct)
        tf = own.get_counts()
        frequency, distinct = np.zeros(n_distinct, np.int64), np.zeros(n_distinct, U)
        for b in heard:
            at = b.get_sorted().astype(np.int64)
            distinct[at] = b.get_sorted()
            frequency[at] = b.get_counts()
        members = facts.column("members").combine_chunks()
        total = facts.column("total").to_numpy()
        copies = np.diff(members.offsets.to_numpy())
        docs = len(total)
        shared = frequency[number] > 0
        doc, number, tf = doc[shared], number[shared], tf[shared].astype(np.float64)
        h, w = distinct[number], tf * idf(frequency[number].astype(np.float64), n)
        of_shared = np.bincount(doc, weights=w, minlength=docs)
        weight = of_shared + (total - np.bincount(doc, weights=tf, minlength=docs)) * idf(copies.astype(np.float64), n)
        hopeful = (of_shared >= THRESHOLD * weight - 1e-9) & (of_shared > 0)
        keep = hopeful[doc]
        h, w, doc = h[keep], w[keep], doc[keep]
        chosen = np.flatnonzero(hopeful)
        hashes, weights, bands = ([None] * docs for _ in range(3))
        if len(chosen):
            first = np.searchsorted(doc, chosen)
            made = signatures(h, w, first).astype(np.int64).tolist()
            for k, (i, a, b) in enumerate(zip(chosen.tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True)):
                hashes[i], weights[i], bands[i] = h[a:b].tobytes(), w[a:b].tobytes(), made[k]
        uid = pa.array((chunk << 16) + np.arange(docs))
        return pa.table([uid, facts.column("key"), facts.column("row"), members, pa.array(weight), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run


def _entries(rows: pa.Table):
    hashes, weights = ([np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in (("hashes", U), ("weights", np.float64)))
    return np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]), np.concatenate(hashes), np.concatenate(weights), rows.column("weight").to_numpy()


def _classes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(root, id, row, class_id, class_row, class_size, links), one row per row of docs: row is the text's key; class_id and
    class_row are those of the class's least row, by id (null first) and text key."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("row"), F.col(text_col).alias("text"))
    n, size = source.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(8, min(1 << 22, -(-int(size or 0) // BUCKET_BYTES)))
    id_ddl = docs.schema[id_col].dataType.simpleString()
    sent = scratch.put(source.mapInArrow(lean(_send(buckets)), _SENT_DDL), "kind")
    # what one phase has read is deleted before the next one shuffles, so their disks don't add up
    shared = scratch.put(sent.where("kind = 1").groupBy("key").applyInArrow(lean(_frequencies), "kind int, chunk long, payload binary"))
    scratch.drop_part(sent, "kind=1")
    release_shuffles(docs.sparkSession)
    both = sent.where("kind = 0").select("kind", "chunk", "payload").unionByName(shared)
    weigh = _weigh(n, to_arrow_type(docs.schema[id_col].dataType))
    texts = scratch.put(both.groupBy("chunk").applyInArrow(lean(weigh), f"uid long, key binary, row binary, members array<{id_ddl}>, weight double, hashes binary, weights binary, bands array<long>"))
    scratch.drop(sent, shared)
    release_shuffles(docs.sparkSession)
    known = texts.where("key is not null")
    least = known.groupBy("key").agg(F.min("uid").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep")
    copies = scratch.put(known.select("key", "uid").join(least, "key").where("uid <> rep").select("uid", "rep"))
    copies = small(copies, 16 * copies.count())
    hopeful = texts.where("bands is not null").join(copies, "uid", "left_anti")
    bands = scratch.put(hopeful.select("uid", F.explode("bands").alias("band")))
    least = bands.groupBy("band").agg(F.min("uid").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    led = bands.join(least, "band").select(F.col("uid").alias("a"), "b").distinct()
    members = scratch.put(led.join(texts.select(F.col("uid").alias("a"), "weight", "hashes", "weights"), "a"))
    scratch.drop(bands)
    links = exact_links(members, "hashes", _entries, THRESHOLD, PART_BYTES, scratch)
    scratch.drop(members)  # links are written
    roots = components(links, scratch)
    roots = small(roots, 16 * roots.count())
    rep = texts.select("uid", "row", "members").join(copies, "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
    rooted = rep.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(F.coalesce("root", "rep").alias("root"), "row", "members")
    counted = links.join(roots, links.a == roots.node).groupBy("root").agg(F.count("*").alias("links"))
    # min of one row's ids first: ids of copies in a chunk are one list
    first = F.struct(F.sort_array("members")[0].alias("id"), F.col("row"))
    classes = rooted.groupBy("root").agg(F.min(first).alias("least"), F.sum(F.size("members")).cast("long").alias("class_size"), F.count("*").alias("nodes")).join(counted, "root", "left")
    several = classes.where("nodes > 1 or class_size > 1").select("root", "least", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    several = scratch.put(several)
    joined = rooted.join(small(several, 72 * several.count()), "root", "left")
    joined = joined.select("root", "row", "least", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"), F.explode("members").alias("id"))
    alone = F.col("least").isNull()
    out = joined.select("root", "id", "row", F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"), F.when(alone, F.col("row")).otherwise(F.col("least.row")).alias("class_row"), "class_size", "links")
    out = scratch.put(out)
    scratch.drop(texts)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size, links): one row per row of docs; class_id is the least id of the class (null is less).

    A class joins equal texts and texts of weighted Jaccard similarity THRESHOLD or more over TF-IDF weighted five-word
    shingles (texts of fewer words: one shingle of all), transitively. links: verified links between different texts that
    make the class. Null and empty texts are a class of their own each; texts without words are copies only of equal texts.
    Rows that share an id are rows of their own: they have one class only if their texts do. An empty table gives no rows.
    Other columns are not read.
    """
    out = _classes(docs, id_col, text_col, Scratch(docs.sparkSession, "neardup"))
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "links")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, without the rows whose class (see near_duplicates) has a row with a lesser id or, of equal
    ids, a lesser text key; of rows that repeat an id and a text one stays. Null and empty texts all stay."""
    scratch = Scratch(docs.sparkSession, "neardup")
    classes = _classes(docs, id_col, text_col, scratch).where(F.col("row").isNotNull() & (F.col("row") != F.unhex(F.md5(F.lit("")))))
    rows = scratch.put(classes.where("class_size > 1").groupBy("id", "row").agg(F.count("*").alias("n"), F.min(F.expr("id <=> class_id and row <=> class_row")).alias("stays")))
    flagged, first = first_of_repeated(docs, rows.where("stays and n > 1").select("id", "row"), id_col, text_col, scratch)
    key, rid, rkey = (fresh(c, flagged.columns) for c in ("_key", "_rid", "_rkey"))
    gone = rows.where("not stays").select(F.col("id").alias(rid), F.col("row").alias(rkey))
    keyed = flagged.withColumn(key, text_key(text_col))
    left = keyed.join(small(gone, 40 * gone.count()), same_row(keyed, gone, [(id_col, rid), (key, rkey)]), "left_anti")
    return left.where(first).select(*docs.columns)


def op5_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
