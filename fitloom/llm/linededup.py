"""Line dedup with overlapping three-line windows, in DataFrame functions only.

A text's lines are its parts between newlines; blank ones (white space alone) are left out
of the windows and always stay.  Each run of three consecutive lines, trimmed of white
space at both ends, is hashed to 128 bits.  A window that occurs more than once in all
documents keeps its first occurrence, by (doc_id, position); the lines that any later
occurrence covers are removed, overlaps merged.  A later occurrence that overlaps the kept
one of the same window leaves the lines that they share: ``a,a,a,a`` becomes ``a,a,a``.

Only hashes, ids and positions are shuffled and summed up on the map side, so a window
shared by a third of all rows costs one row per task; the positions to remove are joined
to the documents by id and text digest, which spreads hot windows over all tasks.

Defined cases: a null text stays null; texts of fewer than three lines have no window and
stay; a text whose lines all go becomes empty but its row stays; windows repeat within a
document as well; rows equal in id and text count as one document and all stay alike; an
empty table gives no rows; other columns pass through, n_chars is set to the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import materialize

SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
LINES = 3


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, SPACE, "")


def windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, k, at, h1, h2)``: the three-line windows in order; at holds the indexes of the window's lines."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("digest"), F.split("text", "\n").alias("lines"))
    hashed = lines.select(
        "doc_id",
        "digest",
        F.filter(
            F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.xxhash64(trimmed(x)).alias("h"), F.hash(trimmed(x)).alias("g"), (F.length(trimmed(x)) > 0).alias("full"))),
            lambda s: s["full"],
        ).alias("l"),
    ).where(F.size("l") >= LINES)
    cut = F.transform(
        F.sequence(F.lit(0), F.size("l") - LINES),
        lambda k: F.struct(
            k.alias("k"),
            F.array(*[F.col("l")[k + j]["i"] for j in range(LINES)]).alias("at"),
            F.xxhash64(*[F.col("l")[k + j]["h"] for j in range(LINES)], *[F.col("l")[k + j]["g"] for j in range(LINES)]).alias("h1"),
            F.xxhash64(F.lit(1), *[F.col("l")[k + j][c] for c in ("g", "h") for j in range(LINES)]).alias("h2"),
        ),
    )
    return hashed.select("doc_id", "digest", F.explode(cut).alias("w")).select("doc_id", "digest", "w.k", "w.at", "w.h1", "w.h2")


def removals(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, gone)``: for each changed document the distinct indexes of the lines to remove."""
    # Written once: both sides of the join below would hash all texts again.
    w = materialize(windows(docs), "windows")
    place = F.struct("doc_id", "digest", "k")
    repeated = w.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.max(place).alias("last")).where("keep <> last").select("h1", "h2", "keep")
    later = w.join(repeated, ["h1", "h2"]).where(place != F.col("keep"))
    own = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("digest") == F.col("keep.digest"))
    # A window that begins d windows after its kept one shares all but its last d lines with it.
    behind = F.least(F.lit(LINES), F.when(own, F.col("k") - F.col("keep.k")).otherwise(LINES))
    lines = F.slice("at", F.lit(LINES + 1) - behind, behind)
    return later.select("doc_id", "digest", lines.alias("at")).groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated windows' later occurrences; same columns."""
    # The columns travel in one, so that no name of theirs can clash.
    packed = docs.select(F.xxhash64("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).alias("d")
    r = removals(docs.select("doc_id", "text")).hint("shuffle_hash").alias("r")
    joined = packed.join(r, F.col("d.__row.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__text") == F.col("r.digest")), "left")
    lines = F.when(F.col("r.gone").isNotNull(), F.split("d.__row.text", "\n"))
    split = joined.select(F.col("d.__row").alias("__row"), lines.alias("__lines"), F.col("r.gone").alias("__gone"))
    # The places that stay, by a hash set: looking for each line among those that go would take time with their product.
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(kept)
    out = split.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, i - 1 AS i, l AS raw, trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS l
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), win AS (
  SELECT doc_id, i AS i0, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2, l AS l0, lead(l, 1) OVER w AS l1, lead(l, 2) OVER w AS l2
  FROM lines WHERE l <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT *, row_number() OVER o AS n, first_value(doc_id) OVER o AS d0, first_value([i0, i1, i2]) OVER o AS at0
  FROM win WHERE l2 IS NOT NULL WINDOW o AS (PARTITION BY l0, l1, l2 ORDER BY doc_id, i0)
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, d0, at0, unnest([i0, i1, i2]) AS i FROM ranked WHERE n > 1) WHERE NOT (doc_id = d0 AND list_contains(at0, i))
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(raw, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source,
       CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
