"""Approximate nearest neighbours by a permutation index (pivot inverted files).

A vector is represented by its pivots ordered from the nearest. The index is sharded by rows: each block of vectors keeps
one inverted file per pivot with the position that the pivot has for every vector of the block. A query reads the files of
its NEAR nearest pivots, which sums up the footrule distance (the displacement of these pivots) to every vector of the
block; the DEPTH share of the block with the least footrule is reranked by the exact distance, and each block's best go to
a merge. (Files that hold a pivot's nearest vectors only would leave most of a block unread, but find less than half of the
neighbours where vectors have no low-dimensional structure: README.md.)
The depth is a share of the block, so recall doesn't depend on the corpus's size; ``depth=1.0`` is exact.

Equal vectors of a block are one entry with their least ids, so a vector that a third of the rows hold takes one place
among the candidates. Queries meet the blocks in groups of bounded size; no pair of vectors leaves a task but the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PIVOTS = 256
#: Pivots are taken from about so many distinct vectors, chosen by hash.
SAMPLE = 4096
BLOCK = 4096
QUERIES = 1024
#: Pivots, from a query's nearest, whose inverted files it reads.
NEAR = 64
DEPTH = 0.15


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n of the rows in random order, without any that is within half the median distance of one before.

    Pivots that lie together say the same, and their order among themselves is noise; a dense group gives one pivot.
    """
    rng = np.random.default_rng(5)
    order = rng.permutation(len(sample))
    a, b = rng.integers(0, len(sample), (2, 2000))
    gaps = np.sqrt(((sample[a] - sample[b]) ** 2).sum(1))
    apart = 0.5 * float(np.median(gaps[a != b])) if (a != b).any() else 0.0
    chosen: list[int] = []
    for i in order.tolist():
        if len(chosen) == n:
            break
        if not chosen or np.sqrt(((sample[chosen] - sample[i]) ** 2).sum(1)).min() >= apart:
            chosen.append(i)
    return sample[chosen]


def positions(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For every vector the position of each pivot in its order, nearest first; ties by pivot number."""
    d = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)[None]
    order = np.argsort(d, axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None], axis=1)
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray | None, k: int, depth: float):
    """(query, vector, distance) of each query's k best of a block, as arrays."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, member = np.unique(vectors, axis=0, return_inverse=True)
    member = member.ravel()
    by = np.argsort(member, kind="stable")  # ids stay in order within an entry
    first = np.searchsorted(member[by], np.arange(len(distinct)))
    least = ids[by[first]]
    sizes = np.diff(np.append(first, len(ids)))
    place = np.argsort(least, kind="stable")  # ties of the footrule go to smaller ids
    distinct, first, sizes = distinct[place], first[place], sizes[place]
    take = len(distinct) if pivots is None else min(len(distinct), max(k + 1, int(np.ceil(depth * len(distinct)))))
    files = None if take == len(distinct) else np.ascontiguousarray(positions(distinct, pivots).T)  # one file per pivot
    spots = None if files is None else positions(queries, pivots)
    nearest_pivots = None if files is None else np.argsort(spots, axis=1, kind="stable")[:, :NEAR]
    out = []
    for n, q in enumerate(queries):
        if files is None:
            candidates = np.arange(len(distinct))
        else:
            footrule = np.zeros(len(distinct), np.int32)
            for p in nearest_pivots[n].tolist():
                footrule += np.abs(files[p] - spots[n, p])
            bound = np.partition(footrule, take - 1)[take - 1]
            below = np.flatnonzero(footrule < bound)
            candidates = np.concatenate((below, np.flatnonzero(footrule == bound)[: take - len(below)]))
        d = np.sqrt(((distinct[candidates] - q) ** 2).sum(1))
        near = candidates[np.argsort(d, kind="stable")]
        d = np.sort(d, kind="stable")
        found: list[tuple[float, int]] = []
        for c, x in zip(near.tolist(), d.tolist(), strict=True):
            if len(found) >= k and x > found[k - 1][0]:
                break
            found += [(x, int(i)) for i in ids[by[first[c] : first[c] + min(sizes[c], k + 1)]] if i != query_ids[n]]
            found = sorted(found)[:k]
        out += [(int(query_ids[n]), i, x) for x, i in found]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, depth: float = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance for each query row, ties to smaller ids.

    Both tables have id_col and vector_col. Vectors that are null, zero, empty or hold null or non-finite components take no
    part, a vector is only compared with those of its length, and a query never with rows of its own id. Rows with null ids
    take no part. Of query rows that share an id the least vector counts. Other columns are not read.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    v, q = clean(vectors), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = {r[0]: r[1] for r in v.groupBy(F.size("v")).count().collect()}  # a row for each length of vectors
    n, m = sum(sizes.values()), q.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    pivots = {}
    for length, count in sizes.items():
        some = v.where((F.size("v") == length) & (F.pmod(F.xxhash64("v"), F.lit(max(1, count // SAMPLE))) == 0)).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
        if some:
            pivots[length] = choose_pivots(np.array([r[0] for r in some], np.float64))
    shared = spark.sparkContext.broadcast(pivots)
    v = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if len(mine) and len(asked):
            (ids, vs), (qids, qs) = ((t.column("id").to_numpy(), t.column("v").combine_chunks()) for t in (mine, asked))
            own, others = (np.diff(x.offsets.to_numpy()) for x in (vs, qs))
            for length in sorted(set(own.tolist()) & set(others.tolist())):
                some, of = np.flatnonzero(own == length), np.flatnonzero(others == length)
                matrix = lambda x, at: x.take(pa.array(at)).flatten().to_numpy().reshape(-1, length)  # noqa: E731, B023
                rows += search_block(ids[some], matrix(vs, some), qids[of], matrix(qs, of), shared.value.get(length) if depth < 1 else None, k, depth)
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    best = q.groupBy("block", "part").cogroup(v.groupBy("block", "part"))
    best = best.applyInArrow(lambda asked, mine: run(mine, asked), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
