"""Counters of runs, taken on the way of the rows: no second pass counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from fitloom.sources import store


def counters() -> list[Column]:
    """Sums over rows with ``reason``: rows, accepted, rejected by reason, characters accepted."""
    ok = F.col("reason").isNull()
    count = lambda c: F.count(F.when(c, F.lit(1)))
    return [F.count(F.lit(1)).alias("rows"), count(ok).alias("accepted"), count(F.col("reason") == "empty").alias("empty"), count(F.col("reason") == "too long").alias("too_long"), F.coalesce(F.sum(F.when(ok, F.length("text"))), F.lit(0)).alias("chars")]


def save_accepted(docs: DataFrame, path: str, most: int = store.MOST_CHARS, uploaded_at: str | None = None) -> dict[str, int]:
    """Write accepted records under ``path``/state=accepted and the others, with their reason, under state=rejected; the counters of that pass."""
    seen, one = Observation("ingest"), store.judged(docs, most=most)
    both = one.withColumns({"id": store.text_id(F.col("text")), "char_count": F.length("text").cast("long"), "uploaded_at": F.lit(uploaded_at).cast("string")})
    state = F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise("rejected")
    both.observe(seen, *counters()).withColumn("state", state).write.mode("append").partitionBy("state").parquet(path)
    return dict(seen.get)


class RunMetrics(StreamingQueryListener):
    """Adds up the counters that streams observe under ``name``, by query."""

    def __init__(self, name: str = "ingest"):
        self.name = name
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.runId), {})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            mine = self.totals.setdefault(str(event.progress.runId), {})
            for k, v in row.asDict().items():
                mine[k] = mine.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
