"""Vectors of the text, date and number expressions."""

import math

import pytest
from pyspark.sql import functions as F

from fitloom.functions import dates as D
from fitloom.functions import numeric as N
from fitloom.functions import text as T
from fitloom.operators import scoring as S
from fitloom.operators import sections as SE


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_rounding_equals_exact_half_even(spark):
    xs = [0.25, 0.35, 2.675, 0.125, 66.25, 0.05, 1234567.25, -0.25, 0.0] + [i / 80 for i in range(400)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[N.py_round(F.col("x"), n).alias(f"r{n}") for n in (1, 2, 3)]).collect()
    for r in rows:
        assert [r.r1, r.r2, r.r3] == [round(r.x, n) for n in (1, 2, 3)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("Ｐｙｔｈｏｎ　Ｃ＋＋", "Python C++"),
        ("x" + chr(0x200B) + "y" + chr(0xFEFF), "xy"),
        ("a  \n\n\n\n b\t\n", "a\n\n b"),
        ("“q”—‘z’", "\"q\"-'z'"),
        ("（保留）：，", "（保留）：，"),
        ("e" + chr(0x301), "é"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize_text(F.lit(raw).cast("string"))) == want


def test_lines_and_sentences(spark):
    assert one(spark, T.split_sentences(F.lit("用 Node.js 开发。v3.5 上线！End. Next\nlast"))) == ["用 Node.js 开发", "v3.5 上线", "End", "Next", "last"]
    long = "；".join(f"第{i}句" + "字" * 60 for i in range(5))
    blocks = one(spark, T.split_blocks(F.lit("- 短行\n\n1. " + long)))
    assert blocks[0] == "短行" and all(len(b) <= 220 for b in blocks) and len(blocks) == 3
    assert one(spark, T.indentation(F.lit("\t  x"))) == 6
    assert one(spark, T.shorten(F.lit("x" * 70))) == "x" * 57 + "..."
    assert one(spark, T.join_names(F.array(*map(F.lit, "abc")), 2)) == "a、b 等 3 项" and one(spark, T.join_names(F.array().cast("array<string>"), 2)) == "无"
    assert one(spark, T.clean_list(F.lit('A, "a"、B；\n' + "z" * 61))) == ["A", "B"]
    assert one(spark, T.clean_list(F.lit("b,A,c,a,B,,C,d"), 60, 3)) == ["b", "A", "c"]
    assert len(one(spark, T.clean_list(F.lit(",".join(f"n{i % 50_000}" for i in range(100_000))), 60, 100_000))) == 50_000


def test_evidence_and_phrases(spark):
    t = "前一句。我用 Python 写了服务！后一句"
    at = t.index("Python")
    assert one(spark, T.evidence_around(F.lit(t), F.lit(at), F.lit(at + 6))) == "我用 Python 写了服务！"
    p = "1. 本科及以上学历，计算机"
    assert one(spark, T.context_phrase(F.lit(p), F.lit(p.index("本科")), F.lit(2))) == "1. 本科及以上学历"


@pytest.mark.parametrize("text, want", [("提升 30%", True), ("降到 120ms", True), ("QPS 达到 5000", True), ("优化了性能", False), ("5G 网络", False), ("百分之三十", True)])
def test_quantified(spark, text, want):
    assert one(spark, T.has_quantified(F.lit(text))) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024.03 - 2024.09", ("2024.03-2024.09", 7)),
        ("2023年9月至2024年6月", ("2023.09-2024.06", 10)),
        ("2022/07-至今", ("2022.07-至今", 36)),
        ("2019-2023", ("2019-2023", 60)),
        ("2024-2019", None),
        ("no date", None),
    ],
)
def test_date_ranges(spark, text, want):
    r = D.date_range(F.lit(text), 2025, 6)
    got = spark.range(1).select(r.alias("r")).select(F.when(F.col("r").isNotNull(), D.range_label(F.col("r"))).alias("label"), "r.months").first()
    assert (None if got.label is None else (got.label, got.months)) == want


def test_years_and_levels(spark):
    assert one(spark, D.find_years(F.lit("2019 x 2021、2019 1989 12021 2040"), 2025)) == [2019, 2021]
    need = lambda t: tuple(one(spark, D.years_needed(F.lit(t))) or ())
    assert need("3 年以上") == (3, None) and need("5-3 年") == (3, 5) and need("应届") == (0, None) and need("x") == ()


@pytest.mark.parametrize("line, kind", [("## 教育背景", "education"), ("任职要求（急招）", "requirement"), ("【项目经历】", "project"), ("- 专业技能", None), ("我熟悉工作经历，很多", None), ("一、工作经历", "work"), ("技能", "skill"), ("12345", None)])
def test_headings(spark, line, kind):
    assert one(spark, SE.heading(F.lit(line))["kind"]) == kind


@pytest.mark.parametrize("spans, want", [([(0, 5), (10, 15)], 12), ([(0, 5), (3, 9)], 10), ([(0, 5), (6, 10)], 11), ([(10, 5)], 0), ([(0, 600)], 0)])
def test_month_merge(spark, spans, want):
    df = spark.createDataFrame([(1, s, e) for s, e in spans], "id int, s int, e int")
    assert S.merged_months(df, ["id"]).first().months == want


def test_score_curves(spark):
    x = lambda n, h: one(spark, S.experience_score(F.lit(float(n)), F.lit(float(h))))
    assert [x(4, h) for h in (0, 1, 2, 3, 4, 6)] == [0, 25, 50, 75, 100, 100] and x(0, 0) == 100
    e = lambda n, h: one(spark, S.education_score(F.lit(n), F.lit(h)))
    assert (e(3, 2), e(3, 1), e(2, 0), e(1, 0), e(0, 3), e(2, 4)) == (55, 20, 0, 55, None, 100)
    d = lambda n, m, h: one(spark, S.domain_score(F.lit(n), F.lit(m), F.lit(h)))
    assert (d(2, 1, True), d(2, 0, True), d(2, 0, False), d(0, 0, True)) == (50, 45, 55, None)
    assert one(spark, S.effective_years(F.lit("高级"), F.lit(False), F.lit(9.0), F.lit(4.0), F.lit(12))) == 4.5
    v = [one(spark, S.verdict(F.lit(float(s)))) for s in (100, 85, 84.9, 70, 69.9, 55, 54.9, 0)]
    assert "".join(v) == "AABBCCDD"


def test_weights(spark):
    def weights(applicable, w=None):
        dims = spark.createDataFrame([(1, 1, k, 50.0, k in applicable) for k in S.DIMENSIONS], "jd_id int, resume_id int, key string, score double, applicable boolean")
        given = spark.createDataFrame(list(w.items()), "key string, weight string") if w else None
        return {r.key: r.weight for r in S.normalize_weights(dims, given).collect()}

    assert math.isclose(sum(weights(S.DIMENSIONS).values()), 1)
    some = weights(["must_have", "project"])
    assert math.isclose(some["must_have"], 0.35 / 0.45) and some["domain"] == 0
    assert weights(["must_have"], {"must_have": "0"})["must_have"] == 1
    assert set(weights([]).values()) == {0.0}
    assert math.isclose(weights(["must_have", "project"], {"must_have": "bad", "project": "-3"})["must_have"], 1)
