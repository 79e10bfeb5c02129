"""Fuzzy line deduplication by MinHash.

1. Per chunk of texts: lines in normal form (lower case, runs of white space as one space) that are equal collapse to one
   with the positions of the others. Lines of SHINGLE characters get a MinHash signature over their shingles of SHINGLE
   characters: one permutation cut in SAMPLES bins, empty bins filled from others (optimal densification), in bands.
2. Band values go to buckets by range, packed as one binary per chunk and bucket (where chunks and buckets are so many
   that a binary holds one line, there are as many rows as lines and bands). Equal lines of a band count once, and a bucket
   yields the least line of each band with its other lines, never all pairs. Buckets are shuffled in ROUNDS, and those of a
   round are deleted before the next, so the bands are never on disk twice.
3. Long lines that met by chance (their number grows with the square of the lines) are parted by sketches of a bit a sample, before
   their texts are moved. Lines that share a least line then are compared by exact Jaccard similarity of their shingle sets
   (bandsearch.py): all links between different lines are found, those that join components leave.
4. Distributed union-find over those links; equal lines follow the least of them. Each component keeps its line at the
   least place: by id, text, line number.

A line that a third of the documents hold meets as one row per chunk.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bandsearch import exact_links
from .common import Scratch, first_of_repeated, fresh, lean, release_shuffles, same_row, small, table, text_key
from .components import components
from .textblocks import U, char_grams, mix, slices

THRESHOLD = 0.8
#: Code points. An edited character in mid-line changes so many shingles on each side, so it passes from 49 characters. With 3
#: it would from 29, but long lines of one language share most of their trigrams without being copies.
SHINGLE = 5
#: Lines of similarity 0.8 meet with a chance of 0.996; of those of 0.3, which grow with the square of the lines, 1.3 % meet.
BANDS, ROWS = 18, 6
SAMPLES = BANDS * ROWS
CHUNK_BYTES = 8 << 20
#: Bytes of the band entries of a bucket.
BUCKET_BYTES = 4 << 20
#: Shuffles of the buckets, one after the other.
ROUNDS = 4
#: Bytes of the lines that are compared together.
PART_BYTES = 1 << 19
#: Lines of as many shingles have a sketch: a bit of each of their samples. With fewer too many of the samples are copies.
SKETCHED = 2 * SAMPLES
#: Lines whose sketches differ in more bits aren't compared. A link of similarity 0.8 that met in one band alone differs in 14 of
#: the others' 102 on the mean, and in more than 36 with a chance of about 1e-8; lines of 0.1 in 46, and in 36 or fewer with 0.03.
FAR = SAMPLES // 3
#: Members of a leader that are screened; larger groups are compared as they are.
SCREENED = 512
#: Members that are screened together.
SCREEN_ROWS = 1 << 14
EMPTY = np.uint32(0xFFFFFFFF)
_rng = np.random.default_rng(3)
#: For each attempt the bin that an empty bin looks at.
FILL = np.stack([_rng.integers(0, SAMPLES, SAMPLES) for _ in range(512)])
#: White space that isn't a plain space or the end of a line.
ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

ODD_ASCII = [c for c in ODD_SPACES if c.isascii()]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """The normal forms of a text's lines."""
    text = text.lower()
    if "  " in text or any(c in text for c in (ODD_ASCII if text.isascii() else ODD_SPACES)):
        return [" ".join(x.split()) for x in text.split("\n")]
    return [x.strip(" ") for x in text.split("\n")]


def signatures(hashes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, sketch as bytes) of every text with any gram: hashes of their grams in order, number of grams by text."""
    n = len(grams)
    sig = np.full(n * SAMPLES, EMPTY, np.uint32)
    where = (((hashes >> U(32)) * U(SAMPLES)) >> U(32)).astype(np.int64)
    where += np.repeat(np.arange(n, dtype=np.int64) * SAMPLES, grams)
    np.minimum.at(sig, where, np.minimum(hashes.astype(np.uint32), EMPTY - np.uint32(1)))
    filled = sig.copy()
    left = np.flatnonzero(sig == EMPTY)
    for bins in FILL:
        if not len(left):
            break
        value = sig[left - left % SAMPLES + bins[left % SAMPLES]]
        filled[left] = value
        left = left[value == EMPTY]
    sig = filled.reshape(n, BANDS, ROWS).astype(U)
    x = np.tile(np.arange(BANDS, dtype=U), (n, 1))
    for k in range(ROWS):
        x = mix(x ^ sig[:, :, k]) + U(1)
    return x, np.packbits((filled & np.uint32(1)).astype(np.uint8).reshape(n, SAMPLES), axis=1)


#: One entry of a bucket: the low bits of the band value (the bucket has the high ones; different bands of equal bits are one,
#: whose lines are compared all the same), the line within its payload's SEGMENT, and bits that equal lines have in common.
#: They are drawn from the line's key for each band anew: different lines of equal bits (2**-32 a pair) would count as equal
#: there, but not in the other bands that they share.
ENTRY = np.dtype([("band", "<u4"), ("owner", "<u2"), ("key", "<u4")])
#: Lines of a chunk that a payload numbers.
SEGMENT = 1 << 16


def _send(buckets: int, id_type: pa.DataType, ddl_id: str):
    place = pa.struct([("id", id_type), ("row", pa.binary()), ("line", pa.int32())])
    schema = pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("key", pa.binary()), ("place", place), ("text", pa.string()), ("sketch", pa.binary()), ("more", pa.list_(place)), ("bucket", pa.int64()), ("payload", pa.binary())])
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(U)

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def places(at: list[tuple[int, int]], ids: pa.Array, rows: pa.Array) -> pa.StructArray:
        of = pa.array([x[0] for x in at], pa.int64())
        return pa.StructArray.from_arrays([ids.take(of), rows.take(of), pa.array([x[1] for x in at], pa.int32())], fields=list(place))

    def chunk_of(base: int, ids: pa.Array, rows: pa.Array, texts: list):
        import xxhash

        digest = xxhash.xxh3_128_digest
        order = sorted(range(len(texts)), key=lambda i, a=ids.to_pylist(), b=rows.to_pylist(): (a[i] is not None, a[i] or 0, b[i] or b""))
        of: dict[bytes, int] = {}
        lines, at_of, more = [], [], []
        for i in order:  # so the first place of a line is its least
            for k, line in enumerate(normal_lines(texts[i]) if texts[i] else ()):
                if line:
                    key = digest(line.encode("utf-8", "replace"))
                    n = len(lines)
                    known = of.setdefault(key, n)
                    if known == n:
                        lines.append(line), at_of.append((i, k))
                    else:
                        more.append((known, (i, k)))
        n = len(lines)
        if not n:
            return
        uid, keys = np.arange(base, base + n), list(of)
        more.sort(key=lambda x: x[0])
        counts = np.bincount([x[0] for x in more], minlength=n) if more else np.zeros(n, np.int64)
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), places([x[1] for x in more], ids, rows), mask=pa.array(counts == 0))
        bits = np.frombuffer(b"".join(keys), "<u8")[::2]
        bands, owner, sketches = [], [], [None] * n
        for first, block in slices(lines):
            hashes, grams = char_grams(block, SHINGLE)
            long = np.array([len(x) for x in block]) >= SHINGLE  # a shorter line is its only shingle
            if long.any():
                at = np.flatnonzero(long) + first
                made, sketch = signatures(hashes if long.all() else hashes[np.repeat(long, grams)], grams[long])
                bands.append(made.ravel())
                owner.append(np.repeat(at, BANDS))
                for i in np.flatnonzero(grams[long] >= SKETCHED).tolist():
                    sketches[at[i]] = sketch[i].tobytes()
        yield batch_of(n, kind=pa.array(np.zeros(n, np.int32)), uid=pa.array(uid), key=pa.array(keys, pa.binary()), place=places(at_of, ids, rows), text=pa.array(lines, pa.string()), sketch=pa.array(sketches, pa.binary()), more=others)
        if not bands:
            return
        band, owner = np.concatenate(bands), np.concatenate(owner)
        for first in range(0, n, SEGMENT):
            here = slice(*np.searchsorted(owner, (first, first + SEGMENT)))
            order = np.argsort(band[here])
            values, of_line = band[here][order], owner[here][order]
            entry = np.empty(len(values), ENTRY)
            entry["band"], entry["owner"], entry["key"] = values & U(0xFFFFFFFF), of_line - first, mix(bits[of_line] ^ values) >> U(32)
            cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
            packed = [(b, entry[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
            kind = pa.array([1 + b * ROUNDS // buckets for b, _ in packed], pa.int32())
            yield batch_of(len(packed), kind=kind, uid=pa.array(np.full(len(packed), base + first)), bucket=pa.array([r[0] for r in packed], pa.int64()), payload=pa.array([r[1] for r in packed], pa.binary()))

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < CHUNK_BYTES:
                    size += len(texts[end] or "")
                    end += 1
                n = 0
                for out in chunk_of(base, batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), texts[at:end]):
                    n = n or out.num_rows  # the lines come first
                    yield out
                base, at = base + n, end

    ddl_place = f"struct<id: {ddl_id}, row: binary, line: int>"
    return run, f"kind int, uid long, key binary, place {ddl_place}, text string, sketch binary, more array<{ddl_place}>, bucket long, payload binary"


def _leaders(sent: pa.Table) -> pa.Table:
    """One bucket's entries -> distinct (a, b): b is the least line of a band of several lines, a one of them (b, too)."""
    payloads = sent.column("payload").to_pylist()
    entry = np.frombuffer(b"".join(payloads), ENTRY)
    line = np.repeat(sent.column("uid").to_numpy(), [len(p) // ENTRY.itemsize for p in payloads]) + entry["owner"]
    band = entry["band"]
    order = np.argsort(band)
    band = band[order]
    twice = np.append(band[1:] == band[:-1], False)
    twice[1:] |= twice[:-1]
    order = order[twice]
    band, line, key = band[twice], line[order], entry["key"][order]
    order = np.lexsort((line, key, band))
    band, line, key = band[order], line[order], key[order]
    new_band = np.append(True, band[1:] != band[:-1])
    least_of_key = np.append(True, new_band[1:] | (key[1:] != key[:-1])) if len(band) else np.zeros(0, bool)
    band, line, new_band = band[least_of_key], line[least_of_key], new_band[least_of_key] if len(band) else np.zeros(0, bool)
    if not len(band):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    first = np.flatnonzero(new_band)
    sizes = np.diff(np.append(first, len(band)))
    least = np.repeat(np.minimum.reduceat(line, first), sizes)
    several = np.repeat(sizes > 1, sizes)
    a, b = line[several], least[several]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return pa.table({"a": pa.array(a[new]), "b": pa.array(b[new])})


def _screen(sent: pa.Table) -> pa.Table:
    """(a, b, sketch) of whole groups -> (a, b) of the parts that a group falls into when lines of far sketches are parted: b is
    then the least line of the part. Lines alone go; lines without a sketch are near to all."""
    a, b = (sent.column(c).to_numpy() for c in ("a", "b"))
    order = np.lexsort((a, b))
    a, b, sketches = a[order], b[order], sent.column("sketch").to_pylist()
    known = np.array([x is not None for x in sketches], bool)[order]
    width = -(-SAMPLES // 64) * 8
    sketch = np.frombuffer(b"".join((x or b"").ljust(width, b"\0") for x in sketches), U).reshape(-1, width // 8)[order]

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= FAR) | ~known[x] | ~known[y]

    n = len(a)
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    size = np.diff(np.append(first, n))
    start, size = np.repeat(first, size), np.repeat(size, size)
    each = np.arange(n)
    part = np.where(near(each, start), start, each)
    x = np.flatnonzero(part != start)  # each of them meets all others, in a circle
    links = [(x, x)]
    for step in range(1, int(size[x].max(initial=0))):
        x = x[size[x] > step]
        y = start[x] + (x - start[x] + step) % size[x]
        here = near(x, y)
        links.append((x[here], y[here]))
    x, y = (np.concatenate(z) for z in zip(*links, strict=True))
    while True:
        least = np.minimum(part[x], part[y])
        before = part.copy()
        for z in (x, y):
            np.minimum.at(part, before[z], least), np.minimum.at(part, z, least)
        part = part[part]
        if (part == before).all():
            break
    keep = np.bincount(part, minlength=n)[part] > 1
    return pa.table({"a": pa.array(a[keep]), "b": pa.array(a[part[keep]])})


def screened(led: DataFrame, lines: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """led (a, b; n rows) with groups parted where sketches tell that no line of one part is like one of another."""
    wide = scratch.put(led.groupBy("b").count().where(F.col("count") > SCREENED).select("b"))
    few = wide.count()
    sketches = lines.where("sketch is not null").select(F.col("uid").alias("a"), "sketch")
    sketches = sketches.join(small(led.select("a").distinct(), 8 * n), "a", "left_semi")
    narrow = led.join(small(wide, 8 * few), "b", "left_anti") if few else led
    of_bin = F.pmod(F.xxhash64("b"), F.lit(-(-n // SCREEN_ROWS) or 1)).alias("bin")
    parted = narrow.join(sketches, "a", "left").select(of_bin, "a", "b", "sketch").groupBy("bin").applyInArrow(lean(_screen), "a long, b long")
    if few:
        parted = parted.unionByName(led.join(small(wide, 8 * few), "b", "left_semi").select("a", "b"))
    out = scratch.put(parted.distinct())
    scratch.drop(wide)
    return out


def _entries(rows: pa.Table):
    """(row, hash of a shingle) of every shingle of every line."""
    texts, owner, found = rows.column("text").to_pylist(), [], []
    for at, block in slices(texts):
        hashes, grams = char_grams(block, SHINGLE)
        owner.append(np.repeat(np.arange(at, at + len(block)), grams)), found.append(hashes)
    return np.concatenate(owner), np.concatenate(found), None, None


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, key, lines array<struct<line, keeper, kept>>, copies), one row per row (told by id and text_key) that holds lines
    which stand elsewhere, too: the line (from 0), the id that keeps it, whether this is the place that keeps it (left out
    where copies is 1); and how many rows there are with this id and text.

    Lines are cut at \\n. Lines that are empty in normal form are nobody's copies.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("row"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a line of 300 characters has 18 entries of 10 bytes
    run, ddl = _send(max(8, min(1 << 22, -(-int(size) * 3 // 5 // BUCKET_BYTES))), to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString())
    sent = scratch.put(source.mapInArrow(lean(run), ddl), "kind")
    lines = sent.where("kind = 0")
    found = []
    for k in range(1, ROUNDS + 1):
        found.append(scratch.put(sent.where(F.col("kind") == k).select("bucket", "uid", "payload").groupBy("bucket").applyInArrow(lean(_leaders), "a long, b long")))
        scratch.drop_part(sent, f"kind={k}")
        release_shuffles(docs.sparkSession)
    met = scratch.put(reduce(DataFrame.unionByName, found).distinct())
    scratch.drop(*found)
    led = screened(met, lines, met.count(), scratch)
    scratch.drop(met)
    texts = lines.select(F.col("uid").alias("a"), "text")
    texts = texts.join(small(led.select("a").distinct(), 8 * led.count()), "a", "left_semi")
    members = scratch.put(led.join(texts, "a"))
    links = exact_links(members, "text", _entries, THRESHOLD, PART_BYTES, scratch)
    scratch.drop(led, members)
    release_shuffles(docs.sparkSession)
    roots = scratch.put(components(links, scratch))
    roots = small(roots, 16 * roots.count())
    least = lines.groupBy("key").agg(F.min("uid").alias("rep"), F.count("*").alias("n"), F.max(F.col("more").isNotNull()).alias("again")).where("n > 1 or again").select("key", "rep")
    # a line is known by the least of its equals; one that stands once and has no links is dropped here
    rooted = least.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    single = lines.join(roots, lines["uid"] == roots["node"]).select("key", "root")
    of_key = scratch.put(rooted.unionByName(single).distinct())
    of_key = small(of_key, 40 * of_key.count())
    held = scratch.put(lines.select("key", "place", "more").join(of_key, "key").select("root", "place", "more"))
    scratch.drop(sent)
    release_shuffles(docs.sparkSession)
    keep = scratch.put(held.groupBy("root").agg(F.min("place").alias("keep")))
    kept = held.join(small(keep, 64 * keep.count()), "root")
    nothing = F.array().cast(held.schema["more"].dataType)
    every = kept.select("keep", F.explode(F.concat(F.array("place"), F.coalesce("more", nothing))).alias("at"))
    every = every.groupBy("at", "keep").agg(F.count("*").alias("n"))  # a place has one line, so one keeper
    line = F.struct(F.col("at.line").alias("line"), F.col("keep.id").alias("keeper"), (F.col("at") == F.col("keep")).alias("kept"))
    every = every.groupBy(F.col("at.id").alias("id"), F.col("at.row").alias("key")).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("n").alias("copies"))
    # where a row has no copy, what it keeps is not asked for
    every = every.withColumn("lines", F.when(F.col("copies") > 1, F.col("lines")).otherwise(F.filter("lines", lambda x: ~x["kept"])))
    out = scratch.put(every.where("copies > 1 or size(lines) > 0"))
    scratch.drop(held)
    release_shuffles(docs.sparkSession)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts without the lines that another place keeps, and three more columns: n_lines, dropped_lines and
    keepers (arrays or null), with underscores before a name that docs has already.

    One row per row of docs, with all its columns. A line's places are ordered by id (null first), text and number, and the
    first keeps it. Lines are cut at \\n; lines that are empty in normal form stay. A document can lose all its lines: its
    text is then empty. Null texts stay null, null and empty texts have no lines to lose. Rows that share an id are rows of
    their own; of rows that repeat an id and a text one may keep lines, the others lose all. An empty table gives none.
    """
    # hashes are most of what is written: they don't compress, and none comes twice
    scratch = Scratch(docs.sparkSession, "lines", {"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"})
    fate = repeated_lines(docs, id_col, text_col, scratch)
    flagged, first = first_of_repeated(docs, fate.where("copies > 1").select("id", "key"), id_col, text_col, scratch)
    size = fate.agg(F.sum(48 + 24 * F.size("lines"))).first()[0] or 0
    key, rid, rkey, lines = (fresh(c, flagged.columns) for c in ("_key", "_rid", "_rkey", "_lines"))
    keyed, fate = flagged.withColumn(key, text_key(text_col)), fate.select(F.col("id").alias(rid), F.col("key").alias(rkey), F.col("lines").alias(lines))
    joined = keyed.join(small(fate, int(size)), same_row(keyed, fate, [(id_col, rid), (key, rkey)]), "left")
    gone = F.filter(F.col(lines), lambda x: ~F.col(first) | ~x["kept"])
    gone = F.when(F.size(gone) > 0, gone)
    dropped, keepers, n_lines = (fresh(c, docs.columns) for c in ("dropped_lines", "keepers", "n_lines"))
    joined = joined.withColumn(lines, gone).select(*docs.columns, F.col(lines)["line"].alias(dropped), F.col(lines)["keeper"].alias(keepers))
    at, n = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts, gone = batch.column(at).to_pylist(), batch.column(n).to_pylist()
            out, count = [], []
            for t, drop in zip(texts, gone, strict=True):
                lines = t.split("\n") if t else []
                count.append(len(lines))
                if drop:
                    drop = set(drop)
                    t = "\n".join([x for k, x in enumerate(lines) if k not in drop])
                out.append(t)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int32())], [*batch.schema.names, n_lines])

    from pyspark.sql.types import IntegerType, StructField, StructType

    return joined.mapInArrow(lean(run), StructType([*joined.schema.fields, StructField(n_lines, IntegerType())]))


def op2_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.coalesce("dropped_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(gone).alias("n_dropped"), gone.alias("dropped_lines"), F.coalesce("keepers", F.array().cast("array<long>")).alias("keeper_doc_ids"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
