"""Stored dimension scores: a table of pairs, bucketed by job, from which any weights give overall scores by a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitloom.functions import vocab as V
from fitloom.sources import shared

DIMENSIONS = list(V.DEFAULT_WEIGHTS)
#: Columns of the table: a dimension without a score isn't applicable.
SCHEMA = "jd_id long, resume_id long, " + ", ".join(f"{k} double" for k in DIMENSIONS)


class ScoreStore:
    """Dimension scores under ``path``, one row for a pair, in ``buckets`` by job and sorted by job within.

    A job's pairs lie in one bucket, so rankings by job read the table without a shuffle.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = shared.name_for(path)

    def exists(self) -> bool:
        return shared.exists(self.spark, self.path)

    def save(self, wide: DataFrame) -> None:
        """Replace the table; ``wide`` has a column for each dimension.  Each bucket is one file."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        rows = wide.select("jd_id", "resume_id", *DIMENSIONS).repartition(self.buckets, "jd_id")
        rows.write.format("parquet").bucketBy(self.buckets, "jd_id").sortBy("jd_id").option("path", self.path).mode("overwrite").saveAsTable(self.table)

    def read(self) -> DataFrame:
        """The table; one written by another session is entered in this one's catalog first."""
        if not self.spark.catalog.tableExists(self.table):
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.path).schema)
            self.spark.sql(f"CREATE TABLE {self.table} ({kinds}) USING parquet CLUSTERED BY (jd_id) SORTED BY (jd_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.table)
