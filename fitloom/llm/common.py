"""Helpers that the corpus operators share: tables, materialising, hot groups and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word.
SPACES = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a temporary folder; on a
    cluster executors would each write to their own disk, so that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("fitloom.shared.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fitloom-")
        spark.conf.set("fitloom.shared.dir", found)
    return f"{found.rstrip('/')}/fitloom-{context.applicationId}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``materialize`` wrote within: for steps whose result has been written elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder; results not yet read are lost."""
    remove(spark, shared_dir(spark))


#: Rows of narrow tables that go into one file, and files at least.
FILE_ROWS, LEAST_FILES = 50_000, 8


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` by way of a file, which cuts its lineage.

    Unlike ``checkpoint()`` this runs the plan once, and unlike a cache it outlives lost executors.
    Where at most ``rows`` rows can come, they go into files in proportion, however many
    partitions the session has, since each file costs the store several calls.
    Files stay for as long as results may be read from them: until ``scratch`` ends or ``clean`` is called.
    """
    out, path = written(df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS))), name)
    if _scratch:
        _scratch[-1].append(path)
    return out


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(col: Column, n: int = 5) -> Column:
    """crc32 of the id's decimal digits, modulo ``n``: the fold that a row belongs to."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


#: Groups that a broadcast may hold: those with more than 1 / HOT of all rows, so that there are at most HOT of them.
HOT, FEW = 20_000, 256


def spread_join(df: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """``df``, of ``total`` rows, joined with ``groups(*key, n, ...)``, where n counts the rows of a key in ``df``.

    Keys with many rows meet them by broadcast, so that the rows stay where they are; all
    other keys are too small to fill a task, and are shuffled.  Rows whose key isn't in
    ``groups`` are left out.
    """
    most = max(FEW, total // HOT)
    hot = F.broadcast(groups.where(F.col("n") > most))
    return df.join(hot, key).unionByName(df.join(hot.select(*key), key, "left_anti").join(groups.where(F.col("n") <= most), key))


def deal(df: DataFrame, key: list[str], spread: str, cap: int, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into those of small groups and block pairs of large groups.

    Groups of at most ``cap`` rows come back as they are.  A larger group is dealt into
    ceil(rows / ``block``) blocks (``cap`` by default) by a hash of ``spread``, and each row is sent to every pair of
    blocks that holds its own (columns ``b1 <= b2``, ``own``), so that each pair of rows
    meets in exactly one block pair and no task holds more than about 2 * ``block`` rows.
    """
    total, most = df.count(), F.col("n")
    counts = materialize(df.groupBy(*key).agg(F.count("*").alias("n")).where(most > cap), "groups", total // cap)
    # Nearly all rows are in small groups: only the hot keys' broadcast and the warm keys' shuffle touch them.
    hot = F.broadcast(counts.where(most > max(FEW, total // HOT)))
    small = df.join(hot.select(*key), key, "left_anti").join(counts.where(most <= max(FEW, total // HOT)).select(*key), key, "left_anti")
    return small, blocks_of(spread_join(df, counts, key, total), spread, block or cap).drop("n")


def blocks_of(rows: DataFrame, spread: str, block: int) -> DataFrame:
    """Rows of groups of n rows, each once for every pair of its group's blocks that holds its own: ``own``, ``b1 <= b2``."""
    nb = F.ceil(F.col("n") / F.lit(block)).cast("int")
    return (
        rows.withColumn("own", F.pmod(F.xxhash64(F.col(spread), F.lit(7)), nb).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), nb - 1)))
        .withColumns({"b1": F.least("own", "_o"), "b2": F.greatest("own", "_o")})
        .drop("_o")
    )


def components(edges: DataFrame, max_rounds: int = 40, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs; at most ``rows``, if known) as ``(node, component)``; component is the smallest node.

    Alternates large-star and small-star steps, each a groupBy with map-side minimum and a
    join, until the edges no longer change; a hub's edges meet its minimum by broadcast.
    Nodes without an edge don't appear.  Nothing is collected but two checksums per round.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")

    def seen(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def with_least(e: DataFrame, most: int) -> DataFrame:
        least = materialize(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least", most)
        return spread_join(e, least, ["a"], most)

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before = seen(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large = with_least(both(edges), 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # An edge leads to a smaller node here, so a node's edges are few unless many of its neighbours have different minima.
        down = materialize(large.distinct(), "down", 2 * before[0])
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        small = with_least(down, 2 * before[0]).select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("e")).select("e.*")
        edges = materialize(small.where("a <> b").distinct(), "edges", 2 * before[0])
        now = seen(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def release() -> None:
    """Hand freed memory back to the system at a task's end, so that an idle worker doesn't hold what the task needed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Forest:
    """Union-find over positions 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
