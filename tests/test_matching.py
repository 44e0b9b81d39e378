"""Documents end to end: scan, parse, match, rank, report."""

import json
import random

from fitloom.operators import dictionary as DI
from fitloom.operators import experience, mentions, parsing, report
from fitloom.operators import scoring as S
from fitloom.sources.skills import ENTRIES, default_dictionary
from pyspark.sql import functions as F

JD = "岗位名称：后端工程师\n公司：某某科技\n岗位职责\n- 负责平台开发\n任职要求：\n1. 必须熟悉 Python、PyTorch，3 年以上开发经验\n2. 本科及以上学历\n3. 熟悉向量检索和 Docker\n加分项\n- 了解 Rust 者优先"
GOOD = "张三 | 男\n教育背景\n某某大学 软件工程 硕士\n专业技能\n- 精通 Python，Docker\n- 熟练 FAISS\n工作经历\n某公司 | 后端工程师 | 2019.01-2023.12\n- 用 PyTorch 把延迟从 800ms 降到 120ms\n- 维护服务\n实习经历\n2018.01-2018.06 某厂 算法实习生\n- 数据清洗"
WEAK = "李四\n教育背景\n某某学院 大专\n自我评价\n了解 Python"


def parsed(spark):
    dims = default_dictionary(spark)
    jd = parsing.parse_jd(spark.createDataFrame([(10, JD), (11, "")], "doc_id int, text string"), dims)
    cv = parsing.parse_resume(spark.createDataFrame([(1, GOOD), (2, WEAK), (3, None)], "doc_id int, text string"), dims, (2025, 6))
    # Parsed once, read often, as written tables would be.
    keep = lambda rel: {k: spark.createDataFrame(v.collect(), v.schema) for k, v in rel.items()}
    return dims, keep(jd), keep(cv)


def brute_scan(line, aliases):
    found, low = [], line.lower()
    for order, (alias, canonical) in enumerate(sorted(aliases, key=lambda a: -len(a[0]))):
        for i in range(len(low) - len(alias) + 1):
            if low[i : i + len(alias)] == alias:
                cjk = any("一" <= c <= "鿿" for c in alias)
                if cjk or not ((i and (line[i - 1].isascii() and (line[i - 1].isalnum() or line[i - 1] in "_+#."))) or (i + len(alias) < len(line) and line[i + len(alias)].isascii() and (line[i + len(alias)].isalpha() or line[i + len(alias)] in "_+#."))):
                    found.append((order, i, i + len(alias), canonical))
    taken, out = set(), []
    for _, s, e, c in sorted(found):
        if not taken & set(range(s, e)):
            taken |= set(range(s, e))
            out.append((s, e, c))
    return sorted(out)


def test_scans_agree_with_brute_force(spark):
    entries = [*ENTRIES, ("检索", "x", ["检索增强", "向量检索增强"], []), ("js x", "x", ["js script"], [])]
    _, alias, _ = DI.from_rows(spark, entries)
    rng = random.Random(2)
    bits = [a for _, _, al, _ in entries for a in al] + [" ", "，", "C", "x", ".", "+", "1", "向量", "增强", "生成"]
    lines = ["".join(rng.choices(bits, k=8)).upper() if i % 3 else "".join(rng.choices(bits, k=8)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, line string")
    ordered = [(r.alias, r.canonical) for r in DI.compile_aliases(alias).orderBy("compile_ord").collect()]
    want = {(i, *x) for i, t in enumerate(lines) for x in brute_scan(t, ordered)}
    assert {(r.doc_id, r.s, r.e, r.canonical) for r in DI.scan_native(df, alias, ["doc_id"]).collect()} == want
    assert {(r.doc_id, r.s, r.e, r.canonical) for r in DI.scan(df, alias, "line").collect()} == want


def test_mentions_carry_their_place(spark):
    _, alias, _ = default_dictionary(spark)
    docs = spark.createDataFrame([(1, GOOD), (2, JD)], "doc_id int, text string")
    rows = mentions.locate(docs, alias).collect()
    text = {1: GOOD, 2: JD}
    assert rows and all(text[r.doc_id][r.start : r.end] == r.raw for r in rows)
    by = {(r.doc_id, r.canonical): r for r in rows}
    assert by[1, "Python"].origin == "skill_section" and by[1, "Python"].level == "精通" and by[1, "PyTorch"].origin == "experience"
    assert by[2, "Rust"].demand == "nice" and by[2, "Python"].demand == "must"


def test_parse(spark):
    _, jd, cv = parsed(spark)
    j = {r.jd_id: r for r in jd["jobs"].collect()}
    assert (j[10].title, j[10].company, j[10].min_years, j[10].education_level) == ("后端工程师", "某某科技", 3.0, 2)
    assert j[10].must_have == ["Python", "PyTorch", "向量数据库", "Docker"] and j[10].nice_to_have == ["Rust"]
    assert j[11].must_have == []
    reqs = jd["requirements"].where("doc_id = 10").orderBy("pos").collect()
    assert [r.kind for r in reqs] == ["must", "must", "must", "nice"] and reqs[1].category == "学历"
    r = {x.resume_id: x for x in cv["resumes"].collect()}
    assert (r[1].name, r[1].school, r[1].education_level, r[1].work_years, r[1].internship_months) == ("张三", "某某大学", 3, 5.0, 6)
    assert r[2].name == "李四" and r[2].total_years == 0.0 and r[3].skill_names == []
    e = cv["experiences"].where("doc_id = 1").orderBy("sec_no").collect()
    assert [(x.kind, x.org, x.title, x.duration_months, x.quantified) for x in e] == [("work", "某公司", "后端工程师", 60, 1), ("internship", "某厂 算法实习生", "", 6, 0)]
    assert e[0].skills == ["PyTorch"] and e[0].period == "2019.01-2023.12"


def test_entries(spark):
    body = "项目甲\n后端负责人 2020.01-2020.06\n- 一\n二二" + "很长" * 30 + "\n项目乙\n- 三"
    got = spark.range(1).select(experience.entries(F.lit(body)).alias("e")).first().e
    assert [(x.header, len(x.bullets)) for x in got] == [("项目甲 后端负责人 2020.01-2020.06", 2), ("项目乙", 1)]


def test_match_and_recompute(spark):
    dims, jd, cv = parsed(spark)
    pairs = jd["jobs"].select("jd_id").crossJoin(cv["resumes"].select("resume_id"))
    scores = report.dimension_scores(pairs, jd, cv, dims[2]).cache()
    total = {(r.jd_id, r.resume_id): r for r in S.recompute(scores).collect()}
    assert total[10, 1].overall > total[10, 2].overall and total[11, 3].overall == 0 and not total[11, 3].assessable
    per = {(r.jd_id, r.resume_id, r.key): r.score for r in scores.collect()}
    assert per[10, 1, "experience"] == 100 and per[10, 1, "education"] == 100
    # All four required skills are held, FAISS standing in for its parent.
    assert per[10, 1, "must_have"] == 100.0
    only = S.recompute(scores, spark.createDataFrame([(k, "1" if k == "must_have" else "0") for k in S.DIMENSIONS], "key string, weight string"))
    assert only.where("jd_id = 10 and resume_id = 1").first().overall == per[10, 1, "must_have"]
    reports = report.match(pairs, jd, cv, dims[2]).cache()
    full = {(r.jd_id, r.resume_id): r for r in reports.collect()}
    assert {k: v.overall for k, v in full.items()} == {k: v.overall for k, v in total.items()}
    r = full[10, 2]
    assert r.must_ratio == "1/4" and set(r.missing_skills) == {"PyTorch", "向量数据库", "Docker"} and r.risks and len(r.dimensions) == 6
    assert json.loads(report.to_json(reports).first().report)["dimensions"]
    ranked = S.rank(S.recompute(scores), 1).where("jd_id = 10").collect()
    assert [x.resume_id for x in ranked] == [1]


def test_questions(spark):
    _, jd, cv = parsed(spark)
    pairs = spark.createDataFrame([(10, 1)], "jd_id int, resume_id int")
    q = report.questions(pairs, jd, cv).where("jd_id = 10 and resume_id = 1").orderBy("pos").collect()
    assert [x.kind for x in q][:3] == ["verify"] * 3 and any(x.kind == "project" for x in q)
