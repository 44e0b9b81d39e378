"""What grows with the tables is dealt to more tasks, and what is sought in a text doesn't take the square of its length."""

import time

from pyspark.sql import functions as F

from fitloom.functions import text as T
from fitloom.operators import dictionary as DI
from fitloom.plans import matching

SF = "/root/testdata/sf0.001"


def test_ranges_are_dealt_by_their_number(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert matching.dealt_ranges(spark, SF).rdd.getNumPartitions() == least
    monkeypatch.setattr(matching, "RANGES_OF_TASK", 100)
    want = sorted(matching.effective_years(spark, SF).collect())
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert matching.dealt_ranges(spark, SF).rdd.getNumPartitions() == n > least
    monkeypatch.undo()
    assert sorted(matching.effective_years(spark, SF).collect()) == want


def test_a_tail_is_sought_backwards(spark):
    rows = [("甲。乙 丙", " 丙"[1:]), ("a.b", "b"), ("end.", ""), ("", ""), ("plain", "plain"), ("😀x", "😀x")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.x for r in df.select(T.tail(F.col("t"), "[^。. ]").alias("x")).collect()] == [w for _, w in rows]
    long = spark.range(1).select(T.tail(F.concat(F.repeat(F.lit("x"), 300_000), F.lit(".y")), "[^.]").alias("x"))
    began = time.time()
    assert long.first().x == "y" and time.time() - began < 20


def test_short_lines_are_cut_where_aliases_begin(spark, monkeypatch):
    """The native scan looks only at places that can count, and finds what a look at every place finds."""
    entries = [("A", "x", ["the", "c++", "k8s", "straße", "σας", ".net", "th"], []), ("B", "x", ["向量检索", "检索x", "x检索"], []), ("C", "x", ["q"], [])]
    texts = ["The the  THE. c++ C++, xthe the9 the_", "K8S K8s", "STRASSE straße STRAẞE", "ΣΑΣ σας", "😀the 😀 .NET a.net", "用x检索x向量检索the向量检索", "", "q Q xq q", "the " * 140, "t", "İthe İ the", "thethe the the\rthe"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, line string")
    found = lambda e: sorted(map(tuple, DI.scan_native(lines, DI.from_rows(spark, e)[1], ["doc_id"]).collect()))
    for e in (entries, [entries[0], entries[2]], [entries[0]], [entries[1]]):
        monkeypatch.setattr(DI, "FEW_HEADS", 64)
        few = found(e)
        monkeypatch.setattr(DI, "FEW_HEADS", 0)
        many = found(e)
        monkeypatch.setattr(DI, "cut", lambda heads, anywhere: None)
        assert few == many == found(e) and few
        monkeypatch.undo()
    # A line without any place that counts is one part, whatever its length.
    assert spark.range(1).select(F.size(F.split(F.lit("other earth xthe " * 30), DI.cut(["th"], False)))).first()[0] == 1


def test_long_lines_come_in_parts(spark, monkeypatch):
    """Aliases across the parts' ends are found once, at their places in the whole line, whatever the parts' size."""
    alias = DI.from_rows(spark, [("A", "x", ["the", "general public license", "😀x", "q"], []), ("B", "x", ["向量检索"], [])])[1]
    texts = ["xthe the general public license q" * 3, "the 😀x 向量检索 xqx q " * 9, "the " * 40, "a" * 90 + " q"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, line string")
    found = lambda: sorted(map(tuple, DI.scan_native(lines, alias, ["doc_id"]).select("doc_id", "canonical", "s", "e", "raw").collect()))
    want = found()
    assert all(texts[d][s:e] == raw for d, _, s, e, raw in want) and len(want) > 50
    monkeypatch.setattr(DI, "SHORT", 5)
    assert found() == want == sorted((r.doc_id, r.canonical, r.s, r.e, r.raw) for r in DI.scan(lines, alias, "line").collect())
    n = DI.parts(lines, ["doc_id"], 6).groupBy("doc_id").agg(F.sum("own").alias("n"), F.max(F.length("line")).alias("most")).collect()
    assert {r.doc_id: r.n for r in n} == {i: len(t) for i, t in enumerate(texts)} and max(r.most for r in n) <= 1 + 7 + 7
