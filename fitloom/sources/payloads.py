"""Model payloads as an optional input: JSON found in free text, checked and cleaned field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import numeric as N
from fitloom.functions import text as T


def balanced_object(col: Column) -> Column:
    """The first {...} of a text that is balanced from its first brace on, braces within strings left out; null without one.

    The text is cut after each quote, brace and escaped character, and depth, quotes and
    place are folded over these pieces: texts of any length, few steps, nothing copied.
    """
    tail = F.when(F.instr(col, "{") > 0, F.substr(col, F.instr(col, "{")))
    pieces = F.regexp_extract_all(tail, F.lit(r"[^\"\\{}]*+(?:\\[\s\S]|[\"{}])"), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, piece: Column) -> Column:
        last, escape = F.right(piece, F.lit(1)), F.length(piece) > 1
        # Within a string, what follows a backslash is no sign; outside, a backslash is nothing.
        sign = F.when(a["quoted"] & escape & (F.substr(piece, F.length(piece) - 1, F.lit(1)) == "\\"), F.lit("")).otherwise(last)
        depth = F.when(a["quoted"], a["depth"]).when(sign == "{", a["depth"] + 1).when(sign == "}", a["depth"] - 1).otherwise(a["depth"])
        n = a["n"] + F.length(piece)
        return F.struct(
            depth.alias("depth"),
            F.when(sign == '"', ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"),
            n.alias("n"),
            F.when((a["end"] == 0) & ~a["quoted"] & (sign == "}") & (depth == 0), n).otherwise(a["end"]).alias("end"),
        )

    end = F.aggregate(pieces, state, step, lambda a: a["end"])
    return F.when(end > 0, F.substr(tail, F.lit(1), end))


def _object(text: Column) -> Column:
    """A text parsed as a JSON object, as a variant; null for anything else."""
    return _only_object(F.try_parse_json(text))


def _only_object(v: Column) -> Column:
    return F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), v)


def extract_json(col: Column) -> Column:
    """A JSON object found in a text, as a variant: the whole text, the first object of a list, a fenced block or the
    balanced braces in it, the first balanced braces of the text."""
    items = F.try_variant_get(F.try_parse_json(col), "$", "array<variant>")
    listed = F.get(F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT")), F.lit(0))
    fences = F.regexp_extract_all(col, F.lit(r"(?s)```(?:json|JSON)?\s*(.*?)```"), F.lit(1))
    fenced = F.get(F.filter(F.transform(fences, lambda x: F.coalesce(_object(x), _object(balanced_object(x)))), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(_object(col), listed, fenced, _object(balanced_object(col)))


def as_list(v: Column, path: str, most_chars: int = 60, most: int = 40) -> Column:
    """A list of names, or a separated text, as clean distinct names."""
    items = F.try_variant_get(v, path, "array<string>")
    text = F.try_variant_get(v, path, "string")
    joined = F.when(items.isNotNull(), F.array_join(items, "\n")).otherwise(text)
    return F.when(v.isNotNull(), T.clean_list(joined, most_chars, most))


def as_number(v: Column, path: str, low: float, high: float) -> Column:
    """A number or a text that starts with one; true and false are none."""
    raw = F.try_variant_get(v, path, "variant")
    boolean = F.coalesce(F.schema_of_variant(raw) == "BOOLEAN", F.lit(False))
    return F.when(~boolean, N.clean_number(F.try_variant_get(v, path, "string"), low, high))


def as_text(v: Column, path: str, most: int = 120) -> Column:
    t = F.regexp_replace(T.strip(F.try_variant_get(v, path, "string")), rf"{T.WHITE}+", " ")
    return F.nullif(F.left(t, F.lit(most)), F.lit(""))


def sanitize_jd(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the usable fields of a job payload; the bonus list leaves out what the skills hold."""
    v = df.withColumn("_v", extract_json(F.col(payload)))
    c = F.col("_v")
    out = v.withColumns(
        {
            "title": as_text(c, "$.title"),
            "company": as_text(c, "$.company"),
            "skills": as_list(c, "$.skills"),
            "_bonus": as_list(c, "$.bonus"),
            "majors": as_list(c, "$.majors"),
            "domains": as_list(c, "$.domains", most=12),
            "education": as_text(c, "$.education", 40),
            "seniority": as_text(c, "$.seniority", 20),
            "soft_skills": as_list(c, "$.soft_skills"),
            "min_years": as_number(c, "$.min_years", 0, 50),
            "max_years": as_number(c, "$.max_years", 0, 50),
        }
    )
    low = F.transform("skills", F.lower)
    return out.withColumn("bonus", F.filter("_bonus", lambda x: ~F.array_contains(low, F.lower(x)))).drop("_v", "_bonus")


def sanitize_resume(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the usable fields of a candidate payload."""
    v = df.withColumn("_v", extract_json(F.col(payload)))
    c = F.col("_v")
    return v.withColumns(
        {
            "name": as_text(c, "$.name", 40),
            "school": as_text(c, "$.school", 60),
            "major": as_text(c, "$.major", 60),
            "education": as_text(c, "$.education", 40),
            "graduation_year": as_number(c, "$.graduation_year", 1950, 2100).cast("int"),
            "skills": as_list(c, "$.skills"),
            "domains": as_list(c, "$.domains", most=12),
            "highlights": as_list(c, "$.highlights", most_chars=120, most=10),
            "total_years": as_number(c, "$.total_years", 0, 60),
        }
    ).drop("_v")
