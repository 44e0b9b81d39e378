"""Text operators over whole tables: brute force over every row of documents, with the typed-in rows of the core queries among them."""

import re

import pytest

from fitloom.functions import patterns as PT
from fitloom.functions import vocab as V
from fitloom.plans import texts, whole
from tests import rows as typed

A = re.ASCII
BULLET = r"^\s*([-*•·▪◦●○◆◇■□→➢➤‣]|\(?\d{1,2}\)?[.、)）]|[（(]\d{1,2}[)）]|[①-⑳]|[（(][一二三四五六七八九十]{1,3}[)）])\s*"
HEADING = [
    (r"^#{1,6}\s*", ""), (r"^\*\*(.+?)\*\*$", r"\1"), (r"^__(.+?)__$", r"\1"), (r"^[【\[（(](.+?)[】\]）)]$", r"\1"), (r"^[一二三四五六七八九十]{1,3}\s*[、.．]\s*", ""),
    (r"^第[一二三四五六七八九十]{1,3}部分\s*[：:]?\s*", ""), (r"[：:]\s*$", ""),
]
SENIOR = [("实习|intern", "实习"), (r"校招|校园招聘|应届|毕业生|20[0-9][0-9]\s*届", "校招"), ("专家|架构师|architect", "专家"), (r"资深|高级|senior|sr\.|sr ", "高级"), ("中级|intermediate", "中级"), ("初级|junior|entry", "初级")]
DEMAND = [("必须|必需|要求|精通|深入|扎实", "must"), ("加分|优先|更佳", "nice"), ("熟悉|掌握|熟练|具备|负责", "must"), ("有所了解|了解|有经验|锦上添花", "nice")]
ALIASES = texts._ALIASES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (those of sf0.001 and planted ones), and their texts by id."""
    planted = [typed.RESUME, typed.JD, "no headings at all", "", None, "x" * 30_000 + " which the stem", "a\n" * 300 + "the end"]
    planted += [t for _, t in typed._HEADINGS + typed._BULLETS + typed._RANGES + typed._SENIOR] + [c for _, c, _ in typed._CLAUSES]
    planted += [r[1] for r in typed._NEED + typed._EDU + typed._PAYLOADS + typed._CLAUSE_AT] + ["熟悉 the，精通 which 优先", "licensed under the tioning"]
    rows = [(10_000_000 + i, t) for i, t in enumerate(planted)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = tmp_path_factory.mktemp("whole")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder), {r.doc_id: r.text for r in docs.collect()}


def run(spark, corpus, name, *keys):
    rows = whole.QUERIES[name](spark, corpus[0]).collect()
    found = {tuple(r[k] for k in keys): tuple(v for c, v in r.asDict().items() if c not in keys) for r in rows}
    assert len(found) == len(rows)
    return found


def lines(corpus):
    return {(d, i): x for d, t in corpus[1].items() for i, x in enumerate((t or "").split("\n"))}


def mentions(corpus):
    """Longer aliases first, then the dictionary's order, then from the left; what overlaps a taken place is left out."""
    ordered = sorted(enumerate(ALIASES), key=lambda x: (-len(x[1][0]), x[0]))
    for d, t in corpus[1].items():
        base = 0
        for line in (t or "").split("\n"):
            taken = set()
            for _, (alias, canonical) in ordered:
                for m in re.finditer(f"(?={re.escape(alias)})", line.lower()):
                    s, e = m.start(), m.start() + len(alias)
                    if not re.match("[A-Za-z0-9_+#.]", line[s - 1 : s] if s else "") and not re.match("[A-Za-z_+#.]", line[e : e + 1]) and not taken & set(range(s, e)):
                        taken |= set(range(s, e))
                        yield d, canonical, base + s, base + e
            base += len(line) + 1


def test_lines(spark, corpus):
    want = {}
    for k, x in lines(corpus).items():
        t = x.strip()
        for p, by in HEADING:
            t = re.sub(p, by, t, flags=A)
        want[k] = (t.strip(),)
    assert run(spark, corpus, "whole_clean_heading", "doc_id", "line_no") == want
    assert run(spark, corpus, "whole_strip_bullet", "doc_id", "line_no") == {k: (bool(re.match(BULLET, x, A)), re.sub(BULLET, "", x, flags=A).strip()) for k, x in lines(corpus).items()}


def test_demand_and_sections(spark, corpus):
    got = run(spark, corpus, "whole_judge_demand", "doc_id", "line_no")
    want = {k: (next((d for p, d in DEMAND if re.search(p, x)), "nice" if got[k][0] in ("bonus", "summary", "benefit") else "must")) for k, x in lines(corpus).items()}
    assert {k: v[1] for k, v in got.items()} == want
    # Sections cut each text's lines without gaps, under the kinds of their lines; the typed-in texts have their known ones.
    sections = run(spark, corpus, "whole_sections", "doc_id", "sec_no")
    covered = [((d, i), kind) for (d, _), (kind, a, b, _) in sections.items() for i in range(a, b + 1)]
    assert len(covered) == len(got) and dict(covered) == {k: v[0] for k, v in got.items()}
    assert [sections[10_000_000, n][0] for n in range(5)] == ["preamble", "education", "skill", "work", "summary"]


def test_texts(spark, corpus):
    docs = corpus[1]
    assert run(spark, corpus, "whole_seniority_detect", "doc_id") == {(d,): (next((s for p, s in SENIOR if re.search(p, (t or "")[:400], re.I | A)), ""),) for d, t in docs.items()}
    levels = {d: [n for w, n in V.EDUCATION_LEVELS.items() if n and w in (t or "")] for d, t in docs.items()}
    assert run(spark, corpus, "whole_education_detect", "doc_id") == {(d,): (min(x, default=None), max(x, default=None)) for d, x in levels.items()}
    got = run(spark, corpus, "whole_rounding", "doc_id")
    assert set(got) == {(d,) for d in docs}
    for (d,), (x, r1, r2) in got.items():
        t = docs[d]
        assert (x, r1, r2) == ((None,) * 3 if t is None else (len(t) / len(t.split("\n")), round(x, 1), round(x, 2)))


def test_dates_and_years(spark, corpus):
    ls = lines(corpus)
    got, need = run(spark, corpus, "whole_date_ranges", "doc_id", "line_no"), run(spark, corpus, "whole_years_requirement", "doc_id", "line_no")
    assert set(got) == set(need) == set(ls)
    rx = re.compile(typed._RANGE_SQL, A)
    for k, x in ls.items():
        m = rx.search(x)
        if not m:
            assert got[k] == (None,) * 4 or re.search(PT.YEAR_SPAN, x, A)
            continue
        sy, sm, ey, em, now = m.groups()
        sy, ey, em = int(sy), 2025 if now else int(ey), 6 if now else int(em or 12)
        if ey >= sy:
            assert got[k] == (sy, ey, max(1, (ey - sy) * 12 + em - int(sm or 1) + 1), bool(now))
    for _, t, lo, hi in typed._NEED:
        assert {need[k] for k, x in ls.items() if x == t} == {(lo, hi)}
    assert all(need[k] == (None, None) for k, x in ls.items() if not re.search(r"\d|[一二三四五六七八九十两]", x) and not re.search(PT.NO_EXPERIENCE, x))


def test_words(spark, corpus):
    names = {}
    for a, c in ALIASES:
        names.setdefault(a, c)
    terms = {(d, i): w for d, t in corpus[1].items() for i, w in enumerate(re.split(r"[ \t\n\x0b\f\r]+", t or ""))}
    assert run(spark, corpus, "whole_canonical_lookup", "doc_id", "pos") == {k: (w, names.get(w.lower())) for k, w in terms.items()}
    first = {}
    for (d, i), w in sorted(terms.items()):
        if w:
            first.setdefault((d, names.get(w.lower(), w)), (i,))
    assert run(spark, corpus, "whole_normalize_list", "doc_id", "name") == first


def test_mentions(spark, corpus):
    docs, found = corpus[1], set(mentions(corpus))
    clauses, levels = (run(spark, corpus, f"whole_{n}", "doc_id", "canonical", "s") for n in ("clause_at", "level_detect"))
    assert set(clauses) == set(levels) == {m[:3] for m in found}
    for d, c, s, e in found:
        (clause,) = clauses[d, c, s]
        assert docs[d][s:e] in clause and clause in docs[d]
        if not re.search("[一-鿿]", docs[d]):
            assert levels[d, c, s] == (None, None)
    located = whole.QUERIES["whole_locate_mentions"](spark, corpus[0])
    assert {(r.doc_id, r.canonical) for r in located.collect()} == {m[:2] for m in found}


def test_payloads(spark, corpus):
    got = run(spark, corpus, "whole_llm_sanitize", "doc_id")
    assert set(got) == {(d,) for d in corpus[1]}
    for (_, payload), (_, *want) in zip(typed._PAYLOADS, typed._CLEAN, strict=True):
        if payload is not None:
            assert {got[d,] for d, t in corpus[1].items() if t == payload} == {tuple(want)}
