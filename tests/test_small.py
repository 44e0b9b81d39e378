"""Sections by kind, names of records, stores without files, examples."""

from pyspark.sql import functions as F

from fitloom.operators import parsing
from fitloom.operators import sections as SE
from fitloom.sources import examples, store


def test_sections_by_kind(spark):
    docs = spark.createDataFrame([(1, "head\n专业技能\na\n教育背景\nb\n技能清单\nc"), (2, "none"), (3, "教育背景\nx")], "doc_id int, text string")
    secs = SE.sections(docs).cache()
    assert {r.doc_id: r.kinds for r in SE.kinds(secs).collect()} == {1: ["skill", "education"], 3: ["education"]}
    assert {(r.doc_id, r.sec_no, r.body) for r in SE.first(secs, ["skill"]).collect()} == {(1, 1, "a")}
    assert {(r.doc_id, r.body) for r in SE.first(secs, ["skill", "education"]).collect()} == {(1, "a"), (3, "x")}
    assert {r.doc_id for r in SE.having(docs, secs, ["education"]).collect()} == {1, 3}


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([("姓名：张三\nx", None), ("姓名：李四\ny", "given"), ("1 2 3", " ")], "text string, name string")
    ok, _ = store.accept(docs)
    named = store.named(ok)
    assert {r["name"] for r in named.collect()} == {"张三", "given", parsing.UNNAMED}
    held = store.keep(named, str(tmp_path / "a"), persist=False)
    assert held.count() == 3 and not (tmp_path / "a").exists()
    assert {r["name"] for r in store.keep(named, str(tmp_path / "b"), persist=True).collect()} == {"张三", "given", parsing.UNNAMED}


def test_examples(spark):
    assert examples.catalog(spark).columns == ["key", "kind", "label"] and examples.detail(spark, "nothing").count() == 0
    both = examples.detail(spark).where(F.col("kind") == "jd").first()
    assert "任职要求" in both.text
