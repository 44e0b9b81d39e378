"""Lines, majors, advice, payload merging, stored records: cases that the SQL of the queries doesn't hold."""

import time

from pyspark.sql import functions as F

from fitloom.functions import dates as D
from fitloom.functions import text as T
from fitloom.operators import dictionary as DI
from fitloom.operators import mentions as M
from fitloom.operators import merging, parsing, report
from fitloom.operators import sections as SE
from fitloom.plans import corpus
from fitloom.sources import skills, store


def test_lines_of_long_and_odd_texts(spark):
    rows = [(1, "a\n\nbé😀\n"), (2, ""), (3, None), (4, "\n"), (5, "x" * 1000)]
    got = {}
    for r in SE.lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.start_offset, r.end_offset, r.line))
    for d, t in rows:
        at, want = 0, []
        for i, x in enumerate((t or "").split("\n")):
            want.append((i, at, at + len(x), x))
            at += len(x) + 1
        assert sorted(got[d]) == want
    began = time.time()
    long = spark.createDataFrame([(1, "line\n" * 1_000_000)], "doc_id long, text string")
    assert SE.lines(long).agg(F.max("end_offset")).first()[0] == 5_000_000 and time.time() - began < 60


def test_mentions_in_one_long_line(spark):
    text = ("word " * 200 + "python，") * 300
    found = M.locate(spark.createDataFrame([(1, text)], "doc_id long, text string"), skills.default_dictionary(spark)[1])
    rows = found.collect()
    assert len(rows) == 300 and all(text[r.start : r.end] == "python" and len(r.evidence) <= 160 for r in rows)


def test_scans_agree_on_overlapping_aliases(spark):
    dims = DI.from_rows(spark, [("A", "x", ["data base"], []), ("B", "x", ["base system"], []), ("C", "x", ["base"], []), ("D", "x", ["系统"], []), ("E", "x", ["c"], [])])
    lines = [(1, "a data base system"), (2, "base data base c, C# c"), (3, "database 分布系统 base系统"), (4, "x " * 500 + "data base " + "y" * 700 + " base")]
    docs = spark.createDataFrame(lines, "doc_id long, line string")
    one = {(r.doc_id, r.canonical, r.s, r.e) for r in DI.scan_native(docs, dims[1], ["doc_id"]).collect()}
    two = {(r.doc_id, r.canonical, r.s, r.e) for r in DI.scan(docs, dims[1], "line").collect()}
    assert one == two and (1, "A", 2, 11) not in {x for x in one if x[1] == "B"}


def test_majors_and_prefixes(spark):
    texts = ["计算机科学与技术、软件工程", "数学与应用数学或应用数学", "微电子工程", "物理 物理", None, "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.m for r in df.orderBy("i").select(D.majors(F.col("t")).alias("m")).collect()]
    assert got == [["计算机科学与技术", "软件工程"], ["数学与应用数学", "应用数学"], ["电子工程"], ["物理", "物理"], [], []]
    p = spark.createDataFrame([("1. 本科",), ("（plain）",), ("(3) x",), (None,)], "t string").select(T.strip_list_prefix(F.col("t")).alias("x"), T.find_span(F.col("t"), "X").alias("s")).collect()
    assert [r.x for r in p] == ["本科", "（plain）", "x", ""] and p[2].s == 4


def test_new_skills_take_their_place_from_the_text(spark):
    dims = skills.default_dictionary(spark)
    docs = spark.createDataFrame([(1, "熟悉 Python\n精通 Terraform 者优先\n"), (2, "nothing")], "doc_id long, text string")
    names = spark.createDataFrame([(1, ["terraform", "py", "python3", ""]), (2, ["Ansible"]), (3, None)], "doc_id long, skills array<string>")
    out = {(r.doc_id, r.canonical): r for r in merging.merge_skills(M.locate(docs, dims[1]), merging.named(names, "skills"), docs, dims).collect()}
    assert set(out) == {(1, "Python"), (1, "terraform"), (1, "py"), (2, "Ansible")}
    assert out[1, "Python"].source == "dict+llm" and out[1, "py"].source == "llm" and out[1, "py"].start == 3
    new = out[1, "terraform"]
    assert (new.start, new.end, new.level, new.demand, new.evidence) == (13, 22, "精通", "must", "精通 Terraform 者优先")
    assert out[2, "Ansible"].start is None and out[2, "Ansible"].demand == "must"


def test_advice_and_questions(spark):
    pairs, jd, cv, dims = corpus.parsed(spark, "/root/testdata/sf0.001")
    jd, cv = {k: v.cache() for k, v in jd.items()}, {k: v.cache() for k, v in cv.items()}
    rows = report.match(pairs, jd, cv, dims[2]).collect()
    assert rows and all(1 <= len(r.advice) <= 6 and any(a.startswith("技能用词") for a in r.advice) for r in rows)
    assert all(any(a.startswith("补充") for a in r.advice) == bool(r.missing_skills) for r in rows)
    bank = spark.createDataFrame([("Python", ["q0", "q1"])], "canonical string, questions array<string>")
    q = report.questions(pairs, jd, cv, bank=bank).collect()
    assert {r.question for r in q if r.kind == "verify" and r.skill == "Python"} <= {"q0", "q1"}
    assert all(1 <= r.pos <= 6 for r in q) and {r.kind for r in q} == {"verify", "gap", "project"}


def test_stamps_and_names(spark):
    ok, _ = store.accept(spark.createDataFrame([("text",)], "text string"), uploaded_at="2025-06-01 00:00:00")
    assert ok.first().uploaded_at == "2025-06-01 00:00:00"
    names = {r.doc_id: r.name for r in parsing.display_names(spark.createDataFrame([(1, "姓名：张三\n"), (2, "1 2 3")], "doc_id long, text string")).collect()}
    assert names == {1: "张三", 2: parsing.UNNAMED}
