"""Mentions enriched: section origin, clause, demand, proficiency and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import dates as D
from fitloom.functions import text as T
from fitloom.functions import vocab as V
from fitloom.operators import dictionary, sections
from fitloom.sources import shared

WINDOW = 14


def origin_of(kind: Column) -> Column:
    """The origin that a section kind stands for; what precedes all headings is personal."""
    return (
        F.when(kind == "skill", F.lit("skill_section"))
        .when(kind.isin(*V.EXPERIENCE_KINDS), F.lit("experience"))
        .when(kind == "education", F.lit("education"))
        .when(kind.isin("personal", "preamble"), F.lit("personal"))
        .when(kind == "summary", F.lit("summary"))
        .otherwise(F.lit("other"))
    )


def level_of(text: Column, start: Column, end: Column) -> Column:
    """The proficiency word nearest to [start, end) within a window: by distance, then longer, then by code point."""
    low = F.greatest(F.lit(0), start - WINDOW)
    window = F.substr(text, low + 1, end + WINDOW - low)
    # A word's first place in each run of Chinese characters; words never span two runs.
    runs = F.regexp_extract_all(window, F.lit(r"[^一-鿿]*[一-鿿]+"), F.lit(0))
    starts = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,run:string>>").alias("r")),
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["r"], F.array(F.struct(acc["at"].alias("at"), x.alias("run")))).alias("r")),
        lambda acc: acc["r"],
    )
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in V.LEVEL_WORDS.items()])
    found = F.flatten(
        F.transform(
            starts,
            lambda r: F.transform(
                F.filter(words, lambda w: F.contains(r["run"], w["w"])),
                lambda w: F.struct(
                    F.abs(low + r["at"] + F.position(w["w"], r["run"]) - 1 + F.length(w["w"]) / 2 - (start + end) / 2).alias("d"),
                    (-F.length(w["w"])).alias("l"),
                    w["w"].alias("level"),
                    w["n"].alias("score"),
                ),
            ),
        )
    )
    nearest = T.let(F.array_min(found), lambda best: F.when(best.isNotNull(), F.struct(best["level"].alias("level"), best["score"].alias("level_score"))))
    # Most windows hold no such word and are not looked at closer.
    return F.when(window.rlike("|".join(V.LEVEL_WORDS)), nearest)


def locate(docs: DataFrame, dim_alias: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All mentions of a document with raw text, offsets, section kind, origin, clause, demand, level and evidence.

    Mentions meet the kinds of their lines by line number; no text is shuffled with them.
    """
    found = dictionary.scan_around(docs, dim_alias, text, keys)
    kinds = sections.tagged_lines(docs, text, keys, offsets=False).select(*keys, "line_no", "kind")
    m = found.join(shared.large(kinds), [*keys, "line_no"])
    t, s, e = F.col("around"), F.col("s") - F.col("at"), F.col("e") - F.col("at")
    return m.select(
        *keys,
        "canonical",
        "raw",
        F.col("s").alias("start"),
        F.col("e").alias("end"),
        "line_no",
        F.col("kind").alias("section"),
        origin_of(F.col("kind")).alias("origin"),
        "clause",
        D.demand(F.col("clause"), F.col("kind")).alias("demand"),
        level_of(t, s, e).alias("lv"),
        T.evidence_around(t, s, e).alias("evidence"),
        F.lit("dict").alias("source"),
    ).select("*", F.col("lv.level"), F.col("lv.level_score")).drop("lv")
