"""Model payloads merged into parsed records: rules first, the model fills what they left open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions import dates as D
from fitloom.functions import text as T
from fitloom.functions import vocab as V
from fitloom.operators import dictionary as DI
from fitloom.operators import mentions as M
from fitloom.sources import shared

MOST_DOMAINS, MOST_HIGHLIGHTS = 12, 10


def named(payloads: DataFrame, column: str, demand: str | None = None, rank: int = 0, key: str = "doc_id") -> DataFrame:
    """``(doc_id, ord, name, demand)``: a payload's list as rows; ``rank`` sets lists apart, ``demand`` is given to its new skills."""
    # Outer, as the optimizer would otherwise repeat the whole cleaning in a filter on the list's size.
    rows = payloads.select(F.col(key).alias("doc_id"), F.posexplode_outer(column).alias("_p", "name"))
    return rows.select("doc_id", F.struct(F.lit(rank).alias("r"), F.col("_p").alias("p")).alias("ord"), F.trim("name").alias("name"), F.lit(demand).cast("string").alias("demand")).where("name <> ''")


def merge_skills(found: DataFrame, names: DataFrame, docs: DataFrame, dims: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``(doc_id, pos, canonical, raw, category, source, origin, start, end, evidence, level, demand)`` of mentions and a model's names.

    Names are brought to the dictionary's; a skill that rules found as well, or found more
    than once, is from both sources.  A new one is looked for in the text whatever its case:
    where it stands it gets its place, evidence and level; its demand is that of its list,
    else of its line, as in a section of requirements.
    """
    dim_skill, dim_alias, _ = dims
    first = found.groupBy("doc_id", "canonical").agg(F.min(F.struct("start", "end", "raw", "origin", "evidence", "level", "demand")).alias("m"), F.count("*").alias("n"), F.max((F.col("demand") != "nice").cast("int")).alias("_must"))
    model = DI.canonical_of(names, "name", dim_alias).withColumn("canonical", F.coalesce("canonical", "name"))
    model = model.groupBy("doc_id", "canonical").agg(F.min(F.struct("ord", "name", "demand")).alias("x"))
    both = first.join(shared.large(model), ["doc_id", "canonical"], "full")
    # Only new names read their texts, and take along what surrounds them.
    new = placed(both.where("m is null").join(shared.large(docs.select("doc_id", "text")), "doc_id", "left").select("doc_id", "canonical", F.col("x.name").alias("name"), "text"))
    s, e = F.col("start") - F.col("at"), F.col("end") - F.col("at")
    level = M.level_of(F.col("around"), s, e)["level"]
    spots = new.select("doc_id", "canonical", F.struct("start", "end", "line", T.evidence_around(F.col("around"), s, e).alias("evidence"), level.alias("level")).alias("spot"))
    rows = both.join(shared.large(spots), ["doc_id", "canonical"], "left")
    own = F.when(F.col("m").isNotNull(), F.when(F.col("_must") == 1, F.lit("must")).otherwise("nice"))
    source = F.when(F.col("m").isNull(), F.lit("llm")).when(F.col("x").isNotNull() | (F.col("n") > 1), F.lit("dict+llm")).otherwise("dict")
    rows = rows.select(
        "doc_id",
        "canonical",
        F.coalesce("m.raw", "x.name").alias("raw"),
        source.alias("source"),
        F.coalesce("m.origin", F.lit("other")).alias("origin"),
        F.coalesce(F.col("m.start"), F.col("spot.start")).alias("start"),
        F.coalesce(F.col("m.end"), F.col("spot.end")).alias("end"),
        F.coalesce(F.col("m.evidence"), F.col("spot.evidence")).alias("evidence"),
        F.when(F.col("m").isNotNull(), F.col("m.level")).otherwise(F.col("spot.level")).alias("level"),
        F.coalesce(own, F.col("x.demand"), D.demand(F.col("spot.line"), F.lit("requirement"))).alias("demand"),
        F.struct(F.col("m").isNull().alias("new"), F.col("m.start").alias("s"), F.col("x.ord").alias("o"), F.col("canonical").alias("c")).alias("_o"),
    )
    out = rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("_o"))).drop("_o")
    return DI.categories(out, "canonical", dim_skill).select("doc_id", "pos", "canonical", "raw", "category", "source", "origin", "start", "end", "evidence", "level", "demand")


def placed(new: DataFrame) -> DataFrame:
    """``(doc_id, canonical, start, end, around, at, line)`` of ``new(doc_id, canonical, name, text)``: where a name stands, whatever its case (nulls and the first line where it doesn't).

    One pass in Arrow batches: the text stays behind, what surrounds the name goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = text or ""
                p = text.lower().find(name.lower())
                first = text.rfind("\n", 0, max(p, 0)) + 1
                line = text[first:].split("\n", 1)[0]
                low = max(0, p - DI.AROUND)
                rows.append((p, p + len(name), text[low : p + len(name) + DI.AROUND], low, line) if p >= 0 else (None, None, None, None, line))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "canonical", "start", "end", "around", "at", "line"])

    kind = new.schema["doc_id"].dataType.simpleString()
    return new.mapInArrow(run, f"doc_id {kind}, canonical string, start int, end int, around string, at int, line string")


def filled(rule: Column, model: Column) -> Column:
    """The rule's text, the model's where it is empty."""
    return F.coalesce(F.nullif(rule, F.lit("")), model, F.lit(""))


def appended(rule: Column, model: Column, most: int | None = None) -> Column:
    out = F.array_distinct(F.concat(rule, F.coalesce(model, F.array().cast("array<string>"))))
    return F.slice(out, 1, most) if most else out


def educated(rule: Column, level: Column, model: Column, highest: bool) -> tuple[Column, Column]:
    """(words, level) of education: the model's words go through the same rules."""
    found = D.education(model, highest)
    open_ = F.coalesce(rule, F.lit("")) == ""
    words = found["word"] if highest else F.nullif(T.strip_list_prefix(T.context_phrase(model, found["at"], F.length(found["word"]))), F.lit(""))
    return F.when(open_, F.coalesce(words, model, F.lit(""))).otherwise(rule), F.when(open_ & model.isNotNull(), F.coalesce(found["level"], F.lit(0))).otherwise(level)


def merge_job(jobs: DataFrame, clean: DataFrame) -> DataFrame:
    """``jobs`` with the open fields filled from ``clean`` (a sanitised payload by ``jd_id``); domains are united, ``soft_skills`` added."""
    p = clean.select("jd_id", *[F.col(c).alias(f"_{c}") for c in ("title", "company", "education", "min_years", "domains", "soft_skills", "seniority")])
    j = jobs.join(shared.large(p), "jd_id", "left")
    education, level = educated(F.col("education"), F.col("education_level"), F.col("_education"), False)
    named_level = F.when(F.col("_seniority").isin(*V.SENIORITY), F.col("_seniority"))
    new = {
        "title": filled(F.col("title"), F.col("_title")),
        "company": filled(F.col("company"), F.col("_company")),
        "seniority": filled(F.col("seniority"), named_level),
        "min_years": F.coalesce("min_years", "_min_years"),
        "education": education,
        "education_level": level,
        "domains": appended(F.col("domains"), F.col("_domains"), MOST_DOMAINS),
    }
    soft = F.coalesce("_soft_skills", F.array().cast("array<string>"))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns], F.array_distinct(soft).alias("soft_skills"))


def soft_requirements(requirements: DataFrame, merged: DataFrame) -> DataFrame:
    """A job's soft skills as further requirements (nice, no skill of the dictionary), those left out that a requirement already says."""
    soft = merged.select(F.col("jd_id").alias("doc_id"), F.explode("soft_skills").alias("text")).join(requirements.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")
    return requirements.drop("pos").unionByName(soft.select("doc_id", "text", F.lit("nice").alias("kind"), F.lit("软技能").alias("category"), F.array().cast("array<string>").alias("skills")))


def merge_resume(resumes: DataFrame, clean: DataFrame) -> DataFrame:
    """``resumes`` with a model's fields (by ``resume_id``): its name goes first, all else only fills what is open; highlights are added."""
    p = clean.select("resume_id", *[F.col(c).alias(f"_{c}") for c in ("name", "school", "major", "education", "graduation_year", "highlights", "domains", "total_years")])
    r = resumes.join(shared.large(p), "resume_id", "left")
    education, level = educated(F.col("education"), F.col("education_level"), F.col("_education"), True)
    short = F.transform("_highlights", lambda x: T.shorten(x, 120))
    new = {
        "name": filled(F.col("_name"), F.col("name")),
        "school": filled(F.col("school"), F.col("_school")),
        "major": filled(F.col("major"), F.col("_major")),
        "education": education,
        "education_level": level,
        "graduation_year": F.coalesce("graduation_year", "_graduation_year"),
        # Only where no dated entry was found at all.
        "total_years": F.when((F.col("total_years") == 0) & (F.col("_total_years") > 0), F.col("_total_years")).otherwise(F.col("total_years")),
        "highlights": appended(F.col("highlights"), short, MOST_HIGHLIGHTS),
        "domains": appended(F.col("domains"), F.col("_domains"), MOST_DOMAINS),
    }
    return r.select(*[new.get(c, F.col(c)).alias(c) for c in resumes.columns])
