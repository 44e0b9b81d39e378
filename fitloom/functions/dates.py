"""Date ranges, years and fields that are found by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions import patterns as PT
from fitloom.functions import vocab as V
from fitloom.functions.numeric import months_between
from fitloom.functions.text import let


def _int(col: Column) -> Column:
    return F.nullif(col, F.lit("")).try_cast("int")


def date_range(text: Column, as_of_year: int, as_of_month: int) -> Column:
    """The first range as a struct (start_year, start_month, end_year, end_month, months, ongoing, raw), null without one.

    Missing months count as January and December.  A reversed range gives way to the first
    span of bare years.  "Until now" ends at ``as_of``.
    """
    none = F.lit(None).cast("int")

    def out(sy: Column, sm: Column, ey: Column, em: Column, ongoing: Column, raw: Column) -> Column:
        months = months_between(sy, F.coalesce(sm, F.lit(1)), ey, F.coalesce(em, F.lit(12)))
        return F.struct(sy.alias("start_year"), sm.alias("start_month"), ey.alias("end_year"), em.alias("end_month"), months.alias("months"), ongoing.alias("ongoing"), F.trim(raw).alias("raw"))

    def of(g: Column) -> Column:
        now = g["now"] != ""
        ends = F.struct(
            _int(g["g1"]).alias("sy"), _int(g["g2"]).alias("sm"), F.when(now, F.lit(as_of_year)).otherwise(_int(g["g3"])).alias("ey"),
            F.when(now, F.lit(as_of_month)).otherwise(_int(g["g4"])).alias("em"), _int(g["s1"]).alias("s1"), _int(g["s2"]).alias("s2"),
        )
        return let(
            ends,
            lambda x: F.when(x["ey"] >= x["sy"], out(x["sy"], x["sm"], x["ey"], x["em"], now, g["raw"])).when(x["s2"] >= x["s1"], out(x["s1"], none, x["s2"], none, F.lit(False), g["span"])),
        )

    parts = {"raw": (PT.DATE_RANGE, 0), "g1": (PT.DATE_RANGE, 1), "g2": (PT.DATE_RANGE, 2), "g3": (PT.DATE_RANGE, 3), "g4": (PT.DATE_RANGE, 4), "now": (PT.DATE_RANGE, 5), "span": (PT.YEAR_SPAN, 0), "s1": (PT.YEAR_SPAN, 1), "s2": (PT.YEAR_SPAN, 2)}
    return let(F.struct(*[F.regexp_extract(text, p, i).alias(n) for n, (p, i) in parts.items()]), of)


def range_label(r: Column) -> Column:
    """"2024.03-2024.09", "2023-至今"."""
    one = lambda y, m: F.when(m.isNull(), y.cast("string")).otherwise(F.format_string("%d.%02d", y, m))
    return F.concat(one(r["start_year"], r["start_month"]), F.lit("-"), F.when(r["ongoing"], F.lit("至今")).otherwise(one(r["end_year"], r["end_month"])))


def find_years(text: Column, as_of_year: int) -> Column:
    """The distinct years from 1990 to eight years ahead, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda x: x.cast("int"))), lambda y: y.between(1990, as_of_year + 8))


def single_date(text: Column) -> Column:
    y = _int(F.regexp_extract(text, PT.SINGLE_DATE, 1))
    return F.when(y.isNotNull(), F.struct(y.alias("year"), _int(F.regexp_extract(text, PT.SINGLE_DATE, 2)).alias("month")))


def years_needed(text: Column) -> Column:
    """(min_years, max_years) by ordered patterns; "no experience" words give (0, null)."""
    pair = F.lit(None).cast("struct<min_years:int,max_years:int>")
    for i, pattern in reversed(list(enumerate(PT.YEARS_NEEDED))):
        groups = 2 if i == 0 else 1
        a = _int(F.regexp_extract(text, pattern, 1))
        b = _int(F.regexp_extract(text, pattern, 2)) if groups == 2 else F.lit(None).cast("int")
        low, high = (F.least(a, b), F.greatest(a, b)) if groups == 2 else (a, b)
        pair = F.when(a.isNotNull(), F.struct(low.alias("min_years"), high.alias("max_years"))).otherwise(pair)
    return F.coalesce(pair, F.when(text.rlike(PT.NO_EXPERIENCE), F.struct(F.lit(0).alias("min_years"), F.lit(None).cast("int").alias("max_years"))))


def seniority(text: Column) -> Column:
    head, out = F.left(F.coalesce(text, F.lit("")), F.lit(400)), F.lit("")
    for label, pattern in reversed(PT.SENIORITY.items()):
        out = F.when(head.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def education(text: Column, highest: bool) -> Column:
    """(level, word) of the lowest or highest education level named, the earliest word breaking ties; null for none."""
    found = F.filter(
        F.array(*[F.struct(F.lit(-n if highest else n).alias("k"), F.instr(text, w).alias("at"), F.lit(w).alias("word")) for w, n in V.EDUCATION_LEVELS.items() if n]),
        lambda x: x["at"] > 0,
    )
    best = F.array_min(found)
    return F.when(F.size(found) > 0, F.struct(F.abs(best["k"]).alias("level"), best["word"].alias("word"), (best["at"] - 1).alias("at")))


def graduation_year(text: Column, education_text: Column, as_of_year: int) -> Column:
    return F.coalesce(_int(F.regexp_extract(text, PT.GRADUATION, 1)), F.array_max(find_years(education_text, as_of_year)), single_date(education_text)["year"])


def demand(clause: Column, section: Column) -> Column:
    """must or nice: the first tier with a word in the clause, else by section."""
    out = F.when(section.isin("bonus", "summary", "benefit"), F.lit("nice")).otherwise(F.lit("must"))
    for kind, words in reversed(V.DEMAND_TIERS):
        out = F.when(F.coalesce(clause, F.lit("")).rlike("|".join(words)), F.lit(kind)).otherwise(out)
    return out


def requirement_class(text: Column, has_skills: Column) -> Column:
    c = PT.REQUIREMENT
    return (
        F.when(text.rlike(c["学历"]), F.lit("学历")).when(text.rlike(c["经验"]), F.lit("经验")).when(has_skills, F.lit("技能"))
        .when(text.rlike(c["软技能"]), F.lit("软技能")).when(text.rlike(c["项目"]), F.lit("项目")).otherwise(F.lit("其他"))
    )


def school(text: Column) -> Column:
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PT.SCHOOL), F.lit(0))
    return F.coalesce(F.get(F.filter(hits, lambda x: ~x.rlike("|".join(V.SCHOOL_STOP))), F.lit(0)), F.lit(""))


def majors(text: Column, most: int = 6) -> Column:
    """All majors of the vocabulary in their order in the text; longer names first take their place, shorter ones within them don't count.

    A name that is found gives way to a mark of its own length, so that it isn't seen again.
    """
    ordered = sorted(V.MAJORS, key=len, reverse=True)
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\ue000-\uf8ff]", " ")
    for i, name in enumerate(ordered):
        t = F.replace(t, F.lit(name), F.lit(chr(0xE000 + i) + "\uf8ff" * (len(name) - 1)))
    marks = F.regexp_extract_all(t, F.lit("[\ue000-\ue0ff]"), F.lit(0))
    names = F.array(*map(F.lit, ordered))
    return F.slice(F.transform(marks, lambda m: F.element_at(names, (F.ascii(m) - 0xE000 + 1).cast("int"))), 1, most)


def major(text: Column) -> Column:
    """A labelled major, else the first of the vocabulary in its own order."""
    label = F.nullif(F.regexp_extract(text, PT.labelled("major"), 1), F.lit(""))
    return F.coalesce(label, F.get(F.filter(F.array(*map(F.lit, V.MAJORS)), lambda w: F.contains(text, w)), F.lit(0)), F.lit(""))
