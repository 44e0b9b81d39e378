"""Incremental ingest: a stream of JSON records into the store, the same acceptance rules as in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitloom.sources import metrics, store

INPUT = "text string, name string, source string, uploaded_at timestamp"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New records of a folder as a stream."""
    return spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 100).json(path)


def accepted(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Acceptable records, each text once within the watermark; works on streams and on tables.

    On a stream the counters of ``metrics`` are observed as "ingest", for a ``metrics.RunMetrics`` listener.
    """
    if records.isStreaming:
        records = store.judged(records).observe("ingest", *metrics.counters()).drop("reason")
    ok, _ = store.accept(records)
    if ok.isStreaming:
        return ok.withWatermark("uploaded_at", late).dropDuplicatesWithinWatermark(["id"])
    return ok.dropDuplicates(["id"])


def start(records: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append accepted records as Parquet; with ``once`` what is there now, then stop."""
    w = accepted(records).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def counters(records: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records and characters per window of upload time and source."""
    r = records.withWatermark("uploaded_at", late) if records.isStreaming else records
    return r.groupBy(F.window("uploaded_at", width), "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
