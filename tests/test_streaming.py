"""Streams of candidates into scores, and counters of runs."""

import json

from pyspark.sql import functions as F

from fitloom.operators import parsing, report
from fitloom.operators import scoring as S
from fitloom.sources import metrics
from fitloom.sources.scores import ScoreStore
from fitloom.sources.skills import default_dictionary
from fitloom.streaming import ingest, scoring

JD = "岗位名称：后端工程师\n任职要求：\n1. 必须熟悉 Python、Docker，3 年以上开发经验\n2. 本科及以上学历\n加分项\n- 了解 Rust 者优先"
CVS = ["张三\n教育背景\n某某大学 硕士\n专业技能\n- 精通 Python", "李四\n专业技能\n- 熟悉 Docker，Rust", "王五\n自我评价\n了解 Python"]
AS_OF = (2025, 6)


def test_stream_equals_batch(spark, tmp_path):
    """Changes in two rounds with a restart between: later numbers hold whatever their order, deletions leave no row."""
    dims = default_dictionary(spark)
    jd = parsing.parse_jd(spark.createDataFrame([(10, JD), (11, JD.replace("Python", "Java"))], "doc_id long, text string"), dims)
    pairs_of = lambda c: jd["jobs"].select("jd_id").crossJoin(c)
    live, src = scoring.LiveScores(spark, f"file://{tmp_path}/live"), tmp_path / "in"
    src.mkdir()
    rounds = [
        [(1, 1, CVS[0], False), (2, 5, CVS[1], False), (3, 1, CVS[2], False), (1, 1, CVS[0], False), (5, 1, None, False), (None, 1, "x", False)],
        [(1, 2, CVS[2], False), (2, 4, CVS[0], False), (3, 2, None, True), (4, 1, CVS[1], None)],
    ]
    for i, rows in enumerate(rounds):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("resume_id", "seq", "text", "deleted"), r, strict=True))) for r in rows))
        changes = spark.readStream.schema(scoring.CHANGE).json(str(src))
        q = scoring.start(changes, live, jd, dims, AS_OF, pairs_of, str(tmp_path / "cp"), once=True)
        q.awaitTermination(300)
        assert q.exception() is None
    docs = spark.createDataFrame([(1, CVS[2]), (2, CVS[1]), (4, CVS[1]), (5, None)], "doc_id long, text string")
    cv = parsing.parse_resume(docs, dims, AS_OF)
    want = report.scored(pairs_of(docs.select(F.col("doc_id").alias("resume_id"))), jd, cv, dims[2]).select("jd_id", "resume_id", *S.DIMENSIONS)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(live.read()) == key(want) and len(key(want)) == 8
    # A batch that runs again replaces what it wrote.
    again = live.current().where("batch = 1")
    assert {r.resume_id for r in again.collect()} == {1, 4}
    store = ScoreStore(spark, f"file://{tmp_path}/scores", 2)
    live.compact(store)
    assert key(store.read()) == key(want)


def test_counters(spark, tmp_path):
    """One pass writes both parts and counts them; a stream's listener adds up what batches observe."""
    docs = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None), (4, "x" * 60_001), (5, "bb")], "seq int, text string")
    path = str(tmp_path / "out")
    seen = metrics.save_accepted(docs, path)
    assert seen == {"rows": 5, "accepted": 2, "empty": 2, "too_long": 1, "chars": 3}
    back = spark.read.parquet(path)
    assert {(r.state, r["count"]) for r in back.groupBy("state").count().collect()} == {("accepted", 2), ("rejected", 3)}
    assert back.where("state = 'accepted'").where("length(id) = 12 and reason is null").count() == 2
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"text": t, "uploaded_at": "2025-01-01T00:00:00"}) for t in ("a", "b", "a", " ")))
    heard = metrics.RunMetrics()
    spark.streams.addListener(heard)
    try:
        q = ingest.start(ingest.stream(spark, str(src)), str(tmp_path / "s"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(120)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(heard)
    total = next(iter(heard.totals.values()))
    assert (total["rows"], total["accepted"], total["empty"]) == (4, 3, 1)
