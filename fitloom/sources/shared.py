"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, a part of it for this application; a temporary folder where Spark runs in one process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("fitloom.tables.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="fitloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = "file://" + made
        spark.conf.set("fitloom.tables.dir", found)
    return f"{found.rstrip('/')}/fitloom-tables-{context.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its plan runs once, and lost executors lose nothing of it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where a row means much work.
ROWS_OF_TASK = 20_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, small in bytes and large in work, dealt to at least as many tasks as there are cores, and to more as its rows grow (files give one task for megabytes of keys)."""
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_OF_TASK))
    return df.repartition(n, *keys)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the documents: sizes estimated from small files must not make the driver broadcast it."""
    return df.hint("merge")


def apart(df: DataFrame) -> DataFrame:
    """``df`` by way of a narrow step that ends generated code.

    A join's or an array's generated code holds all rows that one row gives, and with further ones in the same code their
    product: millions of rows of alike pairs.  After this step they are asked for one at a time.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Documents, and bytes of their texts, that a worker looks at at once, so that its memory doesn't grow with what a batch holds.
AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches, whose last column is a text, in pieces of at most ``AT_ONCE`` rows and ``BYTES_AT_ONCE`` (a longer text is a piece of its own).

    What a batch took is handed back to the system before the next one is read.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + AT_ONCE, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right"))))
            yield b.slice(at, to - at)
            at = to
        del b
        release()


def release() -> None:
    """Hand freed memory back to the system, so that an idle worker doesn't hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there completely."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written; results not yet read are lost."""
    remove(spark, folder(spark))


def name_for(path: str) -> str:
    """A table's name in the session's catalog, by its path."""
    return "fitloom_" + hashlib.sha256(path.encode()).hexdigest()[:16]
