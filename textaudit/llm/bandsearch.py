"""Exact links inside groups of candidates, shared by the two MinHash operators.

A group is a leader (the least member of some bands) with all members of those bands. Every member is compared with its
leader; a member that fails is searched among all others of its group by an inverted index. What leaves a task are links
that join two components of a group, never pairs to be compared.

Groups are packed into bins of bounded bytes, so a call to Python serves many. A group over the bound is cut in parts,
each with the leader; members that are not in the leader's component behind that search visit the other parts, in blocks
of bounded bytes. So only these visitors are copied, no link between different texts is lost, and no task holds more than
a bin or a part with a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small
from .components import Forest
from .textblocks import U, mix

_SCHEMA = "a long, b long, part int, link boolean"
EPSILON = 1e-9


class Entries:
    """The (row, key, weight) entries of a bin in order of (group, key): rows that share a key in a group are one run.

    Without weights a row may name a key twice, which counts once, and total is found here. Key and row are then sorted as one
    number, which leaves 64 bits less those of the bin's rows (some 10) to tell a group's keys apart.
    """

    def __init__(self, group: np.ndarray, row: np.ndarray, key: np.ndarray, weight: np.ndarray | None, total: np.ndarray | None):
        # keys are hashes, so those of different groups stay apart
        salted = key ^ mix(np.arange(1, group[-1] + 2, dtype=U))[group][row]
        if weight is None:
            bits = U(max(1, (len(group) - 1).bit_length()))
            salted >>= bits
            salted <<= bits
            salted |= row.astype(U)
            salted.sort()
            salted = salted[np.append(True, salted[1:] != salted[:-1])[: len(salted)]]
            self.row = (salted & ((U(1) << bits) - U(1))).astype(np.int64)
            salted >>= bits
            self.weight, self.total = np.ones(len(salted)), np.bincount(self.row, minlength=len(group)).astype(np.float64)
        else:
            order = np.argsort(salted)
            salted, self.row, self.weight, self.total = salted[order], row[order], weight[order], total
        first = np.append(True, salted[1:] != salted[:-1]) if len(salted) else np.zeros(0, bool)
        self.run = np.cumsum(first) - 1
        self.runs = int(self.run[-1]) + 1 if len(salted) else 0


def leader_links(e: Entries, leader: np.ndarray, group: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """For each row whether it is as similar as `least` to the leader of its group (a leader is to itself)."""
    of_leader = leader[e.row]
    theirs = np.zeros(e.runs)
    theirs[e.run[of_leader]] = e.weight[of_leader]
    both = np.bincount(e.row, weights=np.minimum(e.weight, theirs[e.run]), minlength=len(group))
    against = np.zeros(group[-1] + 1)
    against[group[leader]] = total[leader]
    return (both >= least * (total + against[group] - both) - EPSILON) | leader


def search(e: Entries, seek: np.ndarray, home: np.ndarray, group: np.ndarray, total: np.ndarray, least: float, main: np.ndarray | None):
    """(x, y): rows of one group, x of `seek` and y of `home`, that join two components; rows of `main` are one with their leader.

    A key that one row has alone is in no intersection: a row of which less than `least` is left without those has no link.
    A row that has come to the main component needs no search: a link between it and a row outside is found from there.
    """
    n = len(group)
    others = np.bincount(group, weights=home)[group] - home
    useful = np.zeros(group[-1] + 1, bool)
    useful[group[seek & (others > 0)]] = True  # a group of a leader and one member ends here
    at = np.flatnonzero((useful[group] & (home | seek))[e.row])
    row, run, weight = e.row[at], e.run[at], e.weight[at]
    # keys of two rows at least, the leader's aside where it has been compared
    shared = (np.bincount(run, minlength=e.runs) > 1)[run]
    common = np.bincount(row, weights=weight * shared, minlength=n)
    hopeful = seek & (common >= least * total - EPSILON) & (common > 0)
    if not hopeful.any():
        return
    useful[:] = False
    useful[group[hopeful]] = True
    at = np.flatnonzero(shared & useful[group[row]])
    at = at[np.argsort(group[row[at]], kind="stable")]
    row, run, weight = row[at], run[at], weight[at]
    cuts = np.searchsorted(group[row], np.arange(group[-1] + 2))
    rows = np.searchsorted(group, np.arange(group[-1] + 2))
    for g in np.flatnonzero(useful).tolist():
        s = slice(cuts[g], cuts[g + 1])
        first = rows[g]
        yield from _search_one(row[s] - first, run[s], weight[s], hopeful[first : rows[g + 1]], home[first : rows[g + 1]], total[first : rows[g + 1]], least, None if main is None else main[first : rows[g + 1]], first)


def _search_one(row, run, weight, seek, home, total, least, main, first):
    n = len(total)
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    often = np.diff(np.append(starts, len(run)))
    number = np.repeat(np.arange(len(starts)), often)
    by_row = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[by_row], np.arange(n + 1))
    forest, centre = Forest(), -1
    if main is not None:
        forest.above = dict.fromkeys(np.flatnonzero(main).tolist(), centre)
    for x in np.flatnonzero(seek).tolist():
        if main is not None and forest.root(x) == centre:
            continue
        mine = by_row[cuts[x] : cuts[x + 1]]
        runs = number[mine]
        size = often[runs]
        at = np.arange(size.sum()) + np.repeat(starts[runs] - np.cumsum(size) + size, size)
        both = np.bincount(row[at], weights=np.minimum(weight[at], np.repeat(weight[mine], size)), minlength=n)
        near = (both >= least * (total + total[x] - both) - EPSILON) & home
        near[x] = False
        for y in np.flatnonzero(near).tolist():
            if forest.join(x, y):
                yield first + x, first + y


def _arranged(sent: pa.Table, *by: str) -> tuple[pa.Table, np.ndarray]:
    """(rows in order of the columns `by` and a, the group's number of each row by the columns `by`)."""
    keys = [sent.column(c).to_numpy() for c in (*by, "a")]
    order = np.lexsort(keys[::-1])  # the order of arrival must not matter
    new = np.zeros(len(order), bool)
    for k in keys[:-1]:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return sent.take(pa.array(order)), np.cumsum(new)


def _rows(a, b, part, link) -> pa.Table:
    n = len(a)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "part": pa.array(np.broadcast_to(part, n), pa.int32()), "link": pa.array(np.full(n, link))})


def _first_search(entries_of: Callable, least: float):
    def run(sent: pa.Table) -> pa.Table:
        rows, group = _arranged(sent, "b", "part")
        a, b, part, parts = (rows.column(c).to_numpy() for c in ("a", "b", "part", "parts"))
        leader = a == b
        row, key, weight, total = entries_of(rows)
        e = Entries(group, row, key, weight, total)
        total = e.total
        main = leader_links(e, leader, group, total, least)
        out = [_rows(a[main & ~leader], b[main & ~leader], 0, True)]
        found = list(search(e, ~main, ~leader, group, total, least, main))
        x, y = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
        out.append(_rows(a[x], a[y], 0, True))
        large = np.flatnonzero(parts > 1)
        if len(large):  # who is not with the leader behind this
            with_leader = Forest()
            with_leader.above = dict.fromkeys(np.flatnonzero(main).tolist(), -1)
            for i, j in found:
                with_leader.join(i, j)
            alone = [i for i in large.tolist() if with_leader.root(i) != -1]
            out.append(_rows(a[alone], b[alone], part[alone], False))
        return pa.concat_tables(out)

    return run


def _visit(entries_of: Callable, least: float):
    def run(sent: pa.Table) -> pa.Table:
        rows, group = _arranged(sent, "b", "part", "block", "visitor")
        # visitors stand behind their hosts; both are one group
        b, part, block = (rows.column(c).to_numpy() for c in ("b", "part", "block"))
        new = np.append(False, (b[1:] != b[:-1]) | (part[1:] != part[:-1]) | (block[1:] != block[:-1]))
        group, visitor, a = np.cumsum(new), rows.column("visitor").to_numpy() == 1, rows.column("a").to_numpy()
        row, key, weight, total = entries_of(rows)
        e = Entries(group, row, key, weight, total)
        found = list(search(e, visitor, ~visitor, group, e.total, least, None))
        return _rows(a[[f[0] for f in found]], a[[f[1] for f in found]], 0, True)

    return run


def exact_links(members: DataFrame, bytes_col: str, entries_of: Callable, least: float, part_bytes: int, scratch: Scratch) -> DataFrame:
    """(a, b): links of similarity `least` or more that join all members of a group that such links join.

    members: (a, b, payload columns): a is a member, b its leader, and each leader is a member of itself; bytes_col is the
    column that gives a member's size. entries_of(table) -> (row, key, weight or None, total weight of each row or None).
    """
    sizes = members.groupBy("b").agg(F.sum(F.octet_length(bytes_col)).alias("bytes"))
    parts = F.ceil(F.col("bytes") / part_bytes).cast("int")
    of_group = sizes.select("b", "bytes", parts.alias("parts"))
    everything, large = of_group.agg(F.sum("bytes"), F.count_if(F.col("parts") > 1)).first()
    bins = max(1, -(-int(everything or 0) // part_bytes))
    cut = of_group.where("parts > 1").select("b", "parts")
    cut = members.join(small(scratch.put(cut), 12 * large), "b", "left") if large else members.withColumn("parts", F.lit(1))
    cut = cut.withColumn("parts", F.coalesce("parts", F.lit(1)))
    here = F.array(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    cut = cut.withColumn("part", F.explode(F.when(F.col("a") == F.col("b"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(here)))
    binned = cut.withColumn("bin", F.pmod(F.xxhash64("b", "part"), F.lit(bins)))
    first = scratch.put(binned.groupBy("bin").applyInArrow(lean(_first_search(entries_of, least)), _SCHEMA))
    links = first.where("link").select("a", "b")
    alone = first.where("not link").select("a", "b", "part")
    if not large or alone.isEmpty():
        return links
    guests = scratch.put(members.join(alone, ["a", "b"]))
    blocks = guests.groupBy("b").agg(F.ceil(F.sum(F.octet_length(bytes_col)) / part_bytes).cast("int").alias("blocks"))
    blocks = scratch.put(blocks)
    blocks = small(blocks, 12 * blocks.count())
    hosts = cut.where("parts > 1 and a <> b").join(blocks, "b")
    hosts = hosts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visitor", F.lit(0))
    to = guests.withColumnRenamed("part", "own").join(blocks, "b").join(small(scratch.put(of_group.where("parts > 1").select("b", "parts")), 12 * large), "b")
    to = to.withColumn("block", F.pmod(F.xxhash64("a", F.lit(1)), F.col("blocks")).cast("int")).withColumn("visitor", F.lit(1))
    to = to.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> own").select(*hosts.columns)
    both = hosts.unionByName(to)
    # a group is two parts at most, so it is a bin of its own
    second = scratch.put(both.groupBy("b", "part", "block").applyInArrow(lean(_visit(entries_of, least)), _SCHEMA))
    return links.unionByName(second.select("a", "b"))
