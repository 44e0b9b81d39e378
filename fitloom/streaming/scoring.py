"""Candidates as a stream of changes, scored against stored jobs as they come.

A change is ``(resume_id, seq, text, deleted)``; of a candidate's changes the one with the
greatest ``seq`` holds, whatever the order of arrival.  Each micro-batch parses only its
own candidates and appends their scores under its own number: a batch that is run again
after a failure replaces what it wrote before.  Reading keeps the rows of each candidate's
last change; a deletion leaves none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitloom.operators import parsing, report
from fitloom.operators import scoring as S
from fitloom.sources.scores import ScoreStore

CHANGE = "resume_id long, seq long, text string, deleted boolean"


class LiveScores:
    """Scores by generation under ``path``: ``rows`` of scored candidates and ``changes`` with every candidate's numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, batch: int, changes: DataFrame, rows: DataFrame) -> None:
        """Write one batch: first its rows, then the changes that make them count."""
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        changes.select("resume_id", "seq", "deleted").write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    def current(self) -> DataFrame:
        """``(resume_id, seq, batch)`` of the candidates that are there: their last change, unless it deletes them."""
        changes = self.spark.read.option("basePath", f"{self.path}/changes").parquet(f"{self.path}/changes")
        last = F.max_by(F.struct("deleted", "batch"), F.struct("seq", "batch"))
        return changes.groupBy("resume_id").agg(F.max("seq").alias("seq"), last.alias("l")).where(~F.coalesce("l.deleted", F.lit(False))).select("resume_id", "seq", F.col("l.batch").alias("batch"))

    def read(self) -> DataFrame:
        """``(jd_id, resume_id, *dimensions)`` that hold now."""
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.join(self.current(), ["resume_id", "seq", "batch"], "left_semi").select("jd_id", "resume_id", *S.DIMENSIONS)

    def compact(self, store: ScoreStore) -> None:
        """What holds now as one table by job, for rankings and other weights."""
        store.save(self.read())


def latest(changes: DataFrame) -> DataFrame:
    """Each candidate's last change of a batch; of changes equal in ``seq`` a deletion, then the greater text."""
    return changes.where("resume_id is not null and seq is not null").groupBy("resume_id").agg(F.max(F.struct("seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), "text")).alias("c")).select("resume_id", "c.seq", "c.deleted", "c.text")


def score_changes(changes: DataFrame, jd: dict[str, DataFrame], dims: tuple, as_of: tuple[int, int], pairs_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(jd_id, resume_id, seq, *dimensions)`` of candidates given by ``changes(resume_id, seq, deleted, text)``."""
    docs = changes.where("not deleted").select(F.col("resume_id").alias("doc_id"), "text")
    cv = parsing.parse_resume(docs, dims, as_of)
    wide = report.scored(pairs_of(docs.select(F.col("doc_id").alias("resume_id"))), jd, cv, dims[2])
    return wide.select("jd_id", "resume_id", *S.DIMENSIONS).join(changes.select("resume_id", "seq"), "resume_id")


def start(
    changes: DataFrame, live: LiveScores, jd: dict[str, DataFrame], dims: tuple, as_of: tuple[int, int], pairs_of: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Score a stream of ``CHANGE`` rows into ``live``; with ``once`` what is there now, then stop.

    ``pairs_of(candidates)`` gives the jobs that candidates meet: ``(jd_id, resume_id)``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        # The batch is read once: parsing and the list of changes both start from what is kept.
        kept = latest(rows).persist()
        try:
            live.append(number, kept, score_changes(kept, jd, dims, as_of, pairs_of))
        finally:
            kept.unpersist()

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
