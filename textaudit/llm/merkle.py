"""Merkle manifest of a table: a leaf per row, a tree per source, a tree over the sources' roots; proofs by a recursive query.

Leaves are numbered within their source over a range-partitioned sort, so a source of any size is many tasks' work. Every
FANOUT consecutive nodes of a level are hashed to one of the next, until one is left. The levels are written as one table of
nodes: a node has the digests of its run (its children, 32 bytes each) and the link to its parent (tree, level, place, and
its slot in the parent's run).

Proofs are made by a recursive query (WITH RECURSIVE) over that table. Leaves of one run have all their ancestors in
common, so they climb in one row: it holds one folded digest for each leaf of the run and the siblings met so far, once. Each step joins the
parents, puts every folded digest in its slot of the parent's run, hashes the run, and appends the other digests of that run
to the siblings. So a row stays under some kilobytes however many leaves there are: the tree's depth is
log16 of their number. At the end every leaf has the root that follows from what it holds now, to be compared with the root of the manifest.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests are inputs as hex text, and are kept as 32 bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import Scratch, table

FANOUT = 16
#: Bytes of a node row, about, for the bound of the broadcast.
NODE_BYTES = 32 * FANOUT + 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = "struct<tree: bigint, level: int, place: bigint>"
#: The tree over the sources' roots.
TOP = -1


def digest(col):
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(col, 256))


def digest_of_run(run):
    """H of the digests that are in a binary, one behind the other."""
    return digest(F.lower(F.hex(run)))


def field(col):
    """A field of a leaf: "-" for null, else its size in UTF-8 bytes, a colon and the value."""
    text = col.cast("string")
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*cols):
    return digest(F.concat(*map(field, cols)))


def _numbered(rows: DataFrame, group: str, order: list, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with _pid and _mid, groups): groups has a row for each group in each partition, with what numbers its rows from 0.

    rows are range-partitioned and sorted by group and order; rows that repeat are told apart by their place in the input, so no
    range is wider than it must be. groups: (group, _pid, _first, _before, _n, _ordinal): the number of a row of its group is
    _mid - _first + _before; _n counts the group; _ordinal numbers the groups in their order.
    """
    ordered = [F.col(group).asc_nulls_first(), *order, F.col("_tie")]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("_tie")
    rows = scratch.put(rows.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    groups = scratch.put(rows.groupBy(group, "_pid").agg(F.min("_mid").alias("_first"), F.count("*").alias("_rows")))
    within = Window.partitionBy(group).orderBy("_pid")  # a row for each partition at most
    before = F.sum("_rows").over(within) - F.col("_rows")
    groups = groups.select("*", before.alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("_n"))
    starts = groups.where("_before = 0")
    by_pid = starts.groupBy("_pid").agg(F.count("*").alias("_starts")).withColumn("_earlier", F.sum("_starts").over(Window.orderBy("_pid")) - F.col("_starts"))  # a row a partition
    in_pid = F.row_number().over(Window.partitionBy("_pid").orderBy("_first")) - 1
    ordinals = starts.withColumn("_k", in_pid).join(by_pid, "_pid").select(F.col(group).alias("_g"), (F.col("_earlier") + F.col("_k")).alias("_ordinal"))
    groups = groups.join(ordinals, F.col(group).eqNullSafe(F.col("_g"))).drop("_g", "_rows")
    return rows, scratch.put(groups)


def _levels(nodes: DataFrame, most: int, level: int, scratch: Scratch) -> list[DataFrame]:
    """The tables of the levels above nodes (tree, place, digest, n; n nodes of its tree in this level, `most` at most)."""
    out = []
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        run = F.array_sort(F.collect_list(F.struct((F.col("place") % FANOUT).alias("slot"), "digest")))
        up = nodes.where("n > 1").groupBy("tree", F.expr(f"place div {FANOUT}").alias("place")).agg(F.first("n").alias("n"), run.alias("run"))
        up = up.select("tree", F.lit(level).alias("level"), "place", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), _joined(F.col("run.digest")).alias("kids"))
        nodes = scratch.put(up.withColumn("digest", digest_of_run("kids")))
        out.append(nodes)
    return out


def _joined(digests):
    return F.aggregate(digests, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))


def _link(trees: int, deepest: int) -> dict[str, F.Column]:
    """parent and slot of a node (tree, level, place, n): in its tree; from its tree's root in the tree over the sources, whose levels
    follow those of the deepest tree; null for the last root of all."""
    up = F.struct("tree", (F.col("level") + 1).alias("level"), F.expr(f"place div {FANOUT}").alias("place")).cast(_LINK)
    over = F.struct(F.lit(TOP).alias("tree"), F.lit(deepest + 1).alias("level"), F.expr(f"tree div {FANOUT}").alias("place")).cast(_LINK)
    leaves = (F.col("n") == 1) & (F.col("tree") != TOP) & F.lit(trees > 1)
    return {"parent": F.when(F.col("n") > 1, up).when(leaves, over), "slot": F.when(F.col("n") > 1, F.col("place") % FANOUT).when(leaves, F.col("tree") % FANOUT).cast("int")}


_CLIMB = """
WITH RECURSIVE climb(run, parent, slot, folds, siblings, subroot, root) AS (
  SELECT run, parent, slot, folds, siblings, subroot, root FROM {seed}
  UNION ALL
  SELECT /*hint*/ c.run, n.parent, n.slot,
    transform(c.folds, f -> unhex(sha2(lower(hex(concat(substring(n.kids, 1, 32 * c.slot), f, substring(n.kids, 32 * c.slot + 33)))), 256))),
    concat(c.siblings, substring(n.kids, 1, 32 * c.slot), substring(n.kids, 32 * c.slot + 33)),
    coalesce(c.subroot, n.subroot), n.digest
  FROM climb c JOIN {nodes} n ON n.id = c.parent
)
SELECT run, parent, slot, folds, siblings, subroot, root FROM climb WHERE parent IS NULL/*stops*/
"""
#: Spark stops a recursive query at a million rows unless told not to; here it ends with the root.
_NO_LIMITS = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _climb(seed: DataFrame, nodes: DataFrame, hint: str, until: int | None, scratch: Scratch) -> DataFrame:
    """The climbers of seed at the root, or where their parent is in a level from `until` on, which nodes doesn't have."""
    spark = seed.sparkSession
    stops = "" if until is None else f" OR parent.level >= {until}"
    with _settings(spark, _NO_LIMITS):
        return scratch.put(spark.sql(_CLIMB.replace("/*hint*/", hint).replace("/*stops*/", stops), seed=seed, nodes=nodes))


def manifest(docs: DataFrame, fields: list[str], group_col: str, id_col: str, presented: dict[str, F.Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of docs; digests in lowercase hex.

    leaf: H of the fields, in their order; subroot: root of the tree of the row's group; root: that of the tree over the subroots, ordered by
    group (null first, then by UTF-8 bytes); proof_sha256: H of the siblings, level by level from the leaf to the root, left to right.
    presented: what is to be verified in place of a field's value. folded_root follows from the presented
    leaf and the original siblings, and verified tells whether it is root.

    Leaves ascend by id (null first), rows of one id by their leaves. Null fields, groups and ids are values of their own, empty texts aren't null. Rows
    that repeat are leaves of their own with siblings of their own. An empty table gives no rows; other columns are not read.
    """
    spark, scratch, presented = docs.sparkSession, Scratch(docs.sparkSession, "merkle"), presented or {}
    changed = F.lit(False)
    for c, value in presented.items():
        changed = changed | ~F.col(c).eqNullSafe(value)
    own = leaf(*(F.col(c) for c in fields))
    other = F.when(changed, leaf(*(presented.get(c, F.col(c)) for c in fields)))
    leaves = scratch.put(docs.select(F.col(group_col).alias("_group"), F.col(id_col).alias("_id"), own.alias("_leaf"), other.alias("_presented")))
    rows, groups = _numbered(leaves, "_group", [F.col("_id").asc_nulls_first(), F.col("_leaf")], scratch)
    scratch.drop(leaves)
    trees, most = groups.agg(F.countDistinct("_ordinal"), F.coalesce(F.max("_n"), F.lit(0))).first()

    names = groups.select(F.col("_group").alias("_g"), F.col("_pid").alias("_p"), (F.col("_before") - F.col("_first")).alias("_shift"), F.col("_n").alias("n"), F.col("_ordinal").alias("tree"))
    n_groups = groups.count()
    placed = rows.join(common.small(names, 96 * n_groups), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p"))).withColumn("place", F.col("_mid") + F.col("_shift"))
    run = F.array_sort(F.collect_list(F.struct((F.col("place") % FANOUT).alias("slot"), F.col("_id").alias("id"), F.col("_leaf").alias("leaf"), F.col("_presented").alias("presented"))))
    runs = placed.groupBy("tree", F.expr(f"place div {FANOUT}").alias("place")).agg(F.first("n").alias("leaves"), run.alias("rows"))
    runs = scratch.put(runs)
    scratch.drop(rows)

    # a lone leaf is the root of its tree and no run; its place in the tree over the sources is its own
    lone = F.col("leaves") == 1
    level_1 = runs.select("tree", F.lit(1).alias("level"), "place", F.expr(f"(leaves + {FANOUT - 1}) div {FANOUT}").alias("n"), _joined(F.col("rows.leaf")).alias("kids"), "leaves", "rows")
    level_1 = level_1.withColumn("digest", F.when(lone, F.col("kids")).otherwise(digest_of_run("kids")))
    hashed = level_1.where(~lone).select("tree", "level", "place", "n", "kids", "digest")
    deepest = 0
    while FANOUT**deepest < most:
        deepest += 1
    levels = _levels(level_1.select("tree", "place", "digest", "n"), -(-most // FANOUT), 1, scratch)
    if trees > 1:
        roots = [x.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(trees).cast("long").alias("n")) for x in (level_1, *levels)]
        levels += _levels(_all(roots), trees, deepest, scratch)
    link = _link(trees, deepest)
    subroot = F.when((F.col("n") == 1) & (F.col("tree") != TOP), F.col("digest"))
    nodes = _all([hashed, *levels]).select(F.struct("tree", "level", "place").cast(_LINK).alias("id"), link["parent"].alias("parent"), link["slot"].alias("slot"), "kids", "digest", subroot.alias("subroot"))
    nodes = scratch.put(nodes)

    put_in = f"rows, r -> CASE WHEN leaves = 1 THEN coalesce(r.presented, r.leaf) ELSE unhex(sha2(lower(hex(concat(substring(kids, 1, 32 * cast(r.slot as int)), coalesce(r.presented, r.leaf), substring(kids, 32 * cast(r.slot as int) + 33)))), 256)) END"
    seed = level_1.select(
        F.struct("tree", "place").alias("run"), link["parent"].alias("parent"), link["slot"].alias("slot"), F.expr(f"transform({put_in})").alias("folds"),
        F.lit(b"").cast("binary").alias("siblings"), subroot.alias("subroot"), F.col("digest").alias("root"),
    )
    climbed, until = seed, _first_broadcast_level(nodes)
    if until is None or until > 2:
        climbed = _climb(climbed, nodes if until is None else nodes.where(F.col("id.level") < until), "", until, scratch)
    if until is not None:
        climbed = _climb(climbed, nodes.where(F.col("id.level") >= until), "/*+ BROADCAST(n) */", None, scratch)

    by_leaf = runs.join(climbed, (runs["tree"] == climbed["run.tree"]) & (runs["place"] == climbed["run.place"])).select("leaves", _joined(F.col("rows.leaf")).alias("kids"), "folds", "siblings", "subroot", "root", F.posexplode("rows").alias("at", "row"))
    around = F.when(F.col("leaves") > 1, F.expr("concat(substring(kids, 1, 32 * at), substring(kids, 32 * at + 33))")).otherwise(F.lit(b"").cast("binary"))
    hexed = lambda c: F.lower(F.hex(c))
    folded = F.col("folds")[F.col("at")]
    return by_leaf.select(
        F.col("row.id").alias(id_col), hexed("row.leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        F.sha2(hexed(F.concat(around, F.col("siblings"))), 256).alias("proof_sha256"), hexed(folded).alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.select(*out.columns))
    return out


def _first_broadcast_level(nodes: DataFrame) -> int | None:
    """The lowest level from which on all nodes together are small enough to be broadcast; None if even the last root isn't."""
    room, first = common.BROADCAST_BYTES // NODE_BYTES, None
    for level, n in sorted(((r[0], r[1]) for r in nodes.groupBy("id.level").count().collect()), reverse=True):  # a row a level
        room -= n
        if room < 0:
            break
        first = level
    return first


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    tampered = F.when(fifth, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})


OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda a, c: list_reduce(range(8), lambda b, k: xor(b >> 1, 3988292384 * (b & 1)), xor(a, c)), 4294967295::bigint), 4294967295) % 5 = 0 AS fifth,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') AS head
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN fifth THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l
), t AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM t WHERE len(nodes) > 1
), subroots AS (
  SELECT tree, nodes[1] AS subroot FROM t WHERE len(nodes) = 1
), s AS (
  SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM s WHERE len(nodes) > 1
), every AS (
  SELECT tree, level, nodes FROM t UNION ALL SELECT -1, level, nodes FROM s
), climb AS (
  SELECT doc_id, leaf, tree AS home, tree, 0 AS level, place, coalesce(other, leaf) AS fold, '' AS proof, false AS done FROM p
  UNION ALL
  SELECT doc_id, leaf, home, CASE WHEN len(nodes) = 1 THEN -1 ELSE c.tree END, CASE WHEN len(nodes) = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN len(nodes) = 1 THEN home ELSE place // 16 END,
    CASE WHEN len(nodes) = 1 THEN fold ELSE sha256(array_to_string(nodes[place // 16 * 16 + 1:place] || [fold] || nodes[place + 2:place // 16 * 16 + 16], '')) END,
    CASE WHEN len(nodes) = 1 THEN proof ELSE proof || array_to_string(nodes[place // 16 * 16 + 1:place] || nodes[place + 2:place // 16 * 16 + 16], '') END, len(nodes) = 1 AND c.tree = -1
  FROM climb c JOIN every e ON e.tree = c.tree AND e.level = c.level WHERE NOT done
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM climb JOIN subroots ON subroots.tree = home CROSS JOIN (SELECT nodes[1] AS root FROM s WHERE len(nodes) = 1) WHERE done
"""
