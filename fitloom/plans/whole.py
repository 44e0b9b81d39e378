"""The text operators over the whole table ``documents``: its texts, lines, mentions and words.

Every row counts, with its nulls, long texts and repeated lines.  Where SQL can't tell what
an operator has to find in such texts, tests compare it with brute force; of the functions
here ``catalog`` leaves out those that ``corpus`` runs over the same texts and more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions import dates as D
from fitloom.functions import numeric as N
from fitloom.functions import text as T
from fitloom.operators import dictionary as DI
from fitloom.operators import mentions as M
from fitloom.operators import sections as SE
from fitloom.plans.star import table
from fitloom.plans.texts import WORDS
from fitloom.sources import payloads, shared

QUERIES: dict = {}

_ALIASES = ", ".join(f"('{a}', '{c}', {100 * i + j})" for i, (c, _, al, _) in enumerate(WORDS) for j, a in enumerate(dict.fromkeys([*al, c.lower()])))
_TERMS = rf"""WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') AS l FROM documents),
 t AS (SELECT doc_id, unnest(l) AS term, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM l),
 a AS (SELECT alias, arg_min(canonical, n) AS canonical FROM (VALUES {_ALIASES}) v(alias, canonical, n) GROUP BY 1)
"""
ORACLES = {
    "whole_canonical_lookup": _TERMS + "SELECT doc_id, pos, term, canonical FROM t LEFT JOIN a ON lower(trim(term)) = alias",
    "whole_normalize_list": _TERMS + "SELECT doc_id, coalesce(canonical, trim(term)) AS name, min(pos) AS pos FROM t LEFT JOIN a ON lower(trim(term)) = alias WHERE trim(term) <> '' GROUP BY 1, 2",
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return SE.numbered(documents(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, canonical, s, e, text)``: every mention of ``WORDS`` with its text."""
    docs = documents(spark, d)
    return DI.scan(docs, DI.from_rows(spark, WORDS)[1]).select("doc_id", "canonical", "s", "e").join(shared.large(docs), "doc_id")


def words(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, terms)``: the words of every text in order, none for a null text."""
    return documents(spark, d).select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("terms"))


@query
def whole_clean_heading(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", T.clean_heading(F.col("line")).alias("title"))


@query
def whole_strip_bullet(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", T.is_bullet(F.col("line")).alias("bullet"), T.strip_bullet(F.col("line")).alias("body"))


@query
def whole_sections(spark: SparkSession, d: str) -> DataFrame:
    return SE.sections(documents(spark, d), offsets=False).select("doc_id", "sec_no", "kind", "start_line", "end_line", "body")


@query
def whole_locate_mentions(spark: SparkSession, d: str) -> DataFrame:
    return M.locate(documents(spark, d), DI.from_rows(spark, WORDS)[1]).select("doc_id", "canonical", "origin", "demand", "level_score")


@query
def whole_judge_demand(spark: SparkSession, d: str) -> DataFrame:
    return SE.tagged_lines(documents(spark, d), offsets=False).select("doc_id", "line_no", "kind", D.demand(F.col("line"), F.col("kind")).alias("demand"))


@query
def whole_clause_at(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("doc_id", "canonical", "s", T.clause_at(F.col("text"), F.col("s"), F.col("e")).alias("clause"))


@query
def whole_level_detect(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("doc_id", "canonical", "s", M.level_of(F.col("text"), F.col("s"), F.col("e")).alias("x")).select("doc_id", "canonical", "s", "x.level", "x.level_score")


@query
def whole_date_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = lines(spark, d).select("doc_id", "line_no", D.date_range(F.col("line"), 2025, 6).alias("r"))
    return r.select("doc_id", "line_no", "r.start_year", "r.end_year", "r.months", "r.ongoing")


@query
def whole_years_requirement(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", D.years_needed(F.col("line")).alias("y")).select("doc_id", "line_no", "y.min_years", "y.max_years")


@query
def whole_education_detect(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", D.education(t, False)["level"].alias("min_level"), D.education(t, True)["level"].alias("max_level"))


@query
def whole_seniority_detect(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", D.seniority(F.col("text")).alias("seniority"))


@query
def whole_canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    terms = words(spark, d).select("doc_id", F.posexplode("terms").alias("pos", "term"))
    return DI.canonical_of(terms, "term", DI.from_rows(spark, WORDS)[1]).select("doc_id", "pos", "term", "canonical")


@query
def whole_normalize_list(spark: SparkSession, d: str) -> DataFrame:
    return DI.normalize_list(words(spark, d), ["doc_id"], "terms", DI.from_rows(spark, WORDS)[1])


@query
def whole_llm_sanitize(spark: SparkSession, d: str) -> DataFrame:
    p = payloads.sanitize_jd(documents(spark, d), "text")
    return p.select("doc_id", "title", F.array_join("skills", ",").alias("skills"), F.array_join("bonus", ",").alias("bonus"), "min_years")


@query
def whole_rounding(spark: SparkSession, d: str) -> DataFrame:
    x = (F.length("text") / F.size(F.split("text", "\n"))).alias("x")
    return documents(spark, d).select("doc_id", x).select("doc_id", "x", N.py_round(F.col("x"), 1).alias("r1"), N.py_round(F.col("x"), 2).alias("r2"))
