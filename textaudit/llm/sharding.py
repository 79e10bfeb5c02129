"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING cells. A row's cell is the top of the hash of its key (doc_id, and the text's checksum and size, so
that rows that share a doc_id spread out); a shard's virtual nodes own the cells from the previous node's up to their
own. Every shard takes the rows of its own cells, in ring order, up to its capacity; what overflows a full shard continues
clockwise to the next virtual node whose shard has room. Capacities are n // shards, one more for the first n mod shards,
so row counts differ by one at most (law ``rows``) and only the overflow leaves its home shard.

The driver sees one count per cell, at most RING numbers however many rows there are; it turns them into runs (cell, first
rank, last rank, shard, first slot). A row finds its run by its rank within its cell.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, table

RING_BITS = 16
RING = 1 << RING_BITS
VIRTUAL_NODES = 128


def ring(shards: int, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard), sorted; where two virtual nodes fall on one cell the one that hashes lower keeps it."""
    taken: dict[int, tuple[int, int]] = {}
    for s in range(shards):
        for v in range(nodes):
            h = int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big")
            cell = h >> (64 - RING_BITS)
            taken[cell] = min(taken.get(cell, (h, s)), (h, s))
    return [(c, s) for c, (_, s) in sorted(taken.items())]


def runs(counts: dict[int, int], shards: int, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, first slot) that together hold every row of every cell."""
    n = sum(counts.values())
    free = [n // shards + (s < n % shards) for s in range(shards)]
    given = [0] * shards
    nodes_at = ring(shards, nodes)
    cells = [c for c, _ in nodes_at]
    out, over = [], []

    def take(cell: int, first: int, k: int, shard: int) -> None:
        out.append((cell, first, first + k, shard, given[shard]))
        given[shard] += k
        free[shard] -= k

    for cell, k in sorted(counts.items()):
        home = bisect.bisect_left(cells, cell) % len(cells)
        here = min(k, free[nodes_at[home][1]])
        if here:
            take(cell, 0, here, nodes_at[home][1])
        if k > here:
            over.append((cell, here, k - here, home))
    for cell, first, left, at in over:
        while left:
            shard = nodes_at[at % len(cells)][1]
            if here := min(left, free[shard]):
                take(cell, first, here, shard)
                first, left = first + here, left - here
            at += 1
    return out


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per row of docs; slot counts from 0 without gaps in every shard.

    Null text counts as empty; null and repeated ids are keys like others, repeated rows take a slot each. An empty table
    gives no rows. Other columns are not read. The text is read once; only ids, sizes and checksums are shuffled.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = scratch.put(rows.withColumn("_h", F.xxhash64("_id", "text_crc32", "size")).withColumn("_n", F.monotonically_increasing_id()))
    again = scratch.put(rows.groupBy("_h").agg((F.count("*") > 1).alias("_again")).where("_again"))
    rows = rows.join(small(again, 12 * again.count()), "_h", "left")
    # rows that repeat are dealt over the ring by their number, or a row that a third of all repeat would be one cell's
    rows = rows.withColumn("_h", F.when(F.col("_again"), F.xxhash64("_h", "_n")).otherwise(F.col("_h"))).drop("_again")
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_h", 64 - RING_BITS).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("_cell").count().collect()}  # RING rows at most
    pieces = runs(counts, shards, nodes)
    if not pieces:
        return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    plan = F.broadcast(spark.createDataFrame(pieces, "_cell int, _lo long, _hi long, shard int, _slot long"))  # RING + shards runs or so
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "_n")) - 1)
    out = ranked.join(plan, "_cell").where("_rank >= _lo and _rank < _hi")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))


def op4_sharding(spark, sf_dir):
    out = assign_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
