"""What the operators share: reading tables, scratch tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import inspect
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which one side of a join is broadcast; a larger side is shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: on a local master (tests) a temporary folder, else an error,
    as executors of a cluster don't see each other's disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
        where = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="textaudit-")
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's scratch space
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage: any executor can read them again after a loss.

    ``put`` writes and rereads a DataFrame; ``drop`` deletes one that no later plan reads; what a returned
    DataFrame still reads goes when the driver ends. ``options`` are the Parquet writer's.
    """

    def __init__(self, spark: SparkSession, what: str, options: dict[str, str] | None = None):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/textaudit/{what}-{uuid.uuid4().hex[:12]}", 0
        self.options = {"compression": "zstd"} | (options or {})
        atexit.register(_delete, spark, self.base)

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.options(**self.options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._textaudit_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _delete(self.spark, df._textaudit_path)

    def drop_part(self, df: DataFrame, part: str) -> None:
        """Deletes one partition's folder ("column=value") of a table; the others can still be read."""
        _delete(self.spark, f"{df._textaudit_path}/{part}")


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more: it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


_trimmed = [0.0]


def trim() -> None:
    """Gives the memory that a Python worker has freed back to the system; the allocators would keep it for the next task."""
    if time.monotonic() - _trimmed[0] < 1:
        return
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    _trimmed[0] = time.monotonic()


def lean(run):
    """run, a function for applyInArrow or a generator of them for mapInArrow, with a trim behind each group or batch."""

    @functools.wraps(run)
    def of_group(x):
        out = run(x)
        trim()
        return out

    @functools.wraps(run)
    def of_batches(batches):
        for out in run(batches):
            yield out
            del out
            trim()
        trim()

    return of_batches if inspect.isgeneratorfunction(run) else of_group


def small(df: DataFrame, size: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its size (bytes, from counted rows) is within the bound; else unmarked, for a shuffled join."""
    return F.broadcast(df) if size <= most else df


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column is called so, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(text_col: str):
    """16 bytes that tell apart texts; null for null. With the id it tells rows apart, but for rows that repeat both."""
    return F.unhex(F.md5(F.col(text_col)))


def same_row(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Condition of a join on columns that may be null: null meets null."""
    return reduce(lambda x, y: x & y, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def first_of_repeated(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a boolean column (its name is returned, too): false on all rows but one of those that repeat an id and a text.

    repeated: (id, key), the distinct ids and text keys of rows that repeat. Only those rows are written and compared, by
    minima with map-side partial results, so that a row that a third of all repeat is never one task's.
    """
    key, number, first, least = (fresh(c, docs.columns) for c in ("_key", "_number", "_first", "_least"))
    n = repeated.count()
    if not n:
        return docs.withColumn(first, F.lit(True)), first
    repeated = repeated.toDF("_rid", "_rkey")
    width = 64 if dict(repeated.dtypes)["_rid"] == "string" else 24
    keyed = docs.withColumn(key, text_key(text_col))
    match = same_row(keyed, repeated, [(id_col, "_rid"), (key, "_rkey")])
    those = scratch.put(keyed.join(small(repeated, width * n), match, "left_semi").withColumn(number, F.monotonically_increasing_id()))
    leasts = those.groupBy(id_col, key).agg(F.min(number).alias(least)).select(least)
    flagged = those.join(leasts, those[number] == leasts[least], "left").withColumn(first, F.col(least).isNotNull())
    others = keyed.join(small(repeated, width * n), match, "left_anti").withColumn(first, F.lit(True))
    columns = [*docs.columns, first]
    return others.select(*columns).unionByName(flagged.select(*columns)), first


def utf8_size(col):
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
