"""Sections of documents: lines with offsets, headings, running section numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions import text as T
from fitloom.functions import vocab as V
from fitloom.sources import shared


#: Titles as one literal map, folded to a constant when a query is planned.
_TITLES = json.dumps({t: {"kind": k, "title": n} for t, (k, n) in V.titles().items()}, ensure_ascii=False)


def heading(line: Column) -> Column:
    """(kind, title) of a heading line, null for any other: its cleaned text is looked up among the titles."""

    def named(title: Column) -> Column:
        found = F.element_at(F.from_json(F.lit(_TITLES), "map<string,struct<kind:string,title:string>>"), title)
        return F.when(F.length(title).between(1, V.TITLE_CHARS), found)

    def of(raw: Column) -> Column:
        fits = F.length(raw).between(1, V.HEADING_CHARS) & (raw.startswith("#") | ~raw.rlike(r"^[-*•·▪◦●○◆◇■□ ]"))
        return F.when(fits, T.let(T.strip_trailing_paren(T.clean_heading(raw)), named))

    return T.let(T.strip(F.coalesce(line, F.lit(""))), of)


def inline_heading(line: Column) -> Column:
    """(kind, title, rest) of a line like "heading: content", null for any other."""
    pattern = r"^([^：:\n]{2,20})\s*[：:]\s*(.+)$"

    def of(t: Column) -> Column:
        rest = T.strip(F.regexp_extract(t, pattern, 2))
        return F.when(F.length(rest) > 0, T.let(heading(T.strip(F.regexp_extract(t, pattern, 1))), lambda h: F.when(h.isNotNull(), F.struct(h["kind"].alias("kind"), h["title"].alias("title"), rest.alias("rest")))))

    return T.let(T.strip(F.coalesce(line, F.lit(""))), of)


def lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, line_no, start_offset, end_offset, line)``, offsets in characters.

    A running sum within an array is what Spark's functions lack (a fold copies its result
    for every line), so offsets are summed in Arrow batches, vectorised and without a shuffle.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches):
            split = pc.split_pattern(pc.fill_null(b.column(len(names)), ""), "\n")
            flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
            size = pc.utf8_length(flat).to_numpy().astype(np.int64)
            first = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))[:-1]
            ends = np.cumsum(size + 1) - 1
            starts = ends - size
            of = owner.to_numpy()
            base, place = starts[first][of], np.arange(len(of)) - first[of]
            own = [b.column(k).take(owner) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int32)) for x in (place, starts - base, ends - base)), flat], names=[*names, *LINE_COLUMNS])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names) + ", line_no int, start_offset int, end_offset int, line string"
    return docs.select(*names, text).mapInArrow(run, schema)


LINE_COLUMNS = ("line_no", "start_offset", "end_offset", "line")


def numbered(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, line_no, line)``: ``lines`` for those who need no offsets, in generated code alone."""
    return docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def tagged_lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), offsets: bool = True) -> DataFrame:
    """``lines`` (without ``offsets``: ``numbered``) with the number (0 for what stands before the first heading), kind and title of their section."""
    own = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    h = (lines if offsets else numbered)(docs, text, keys).withColumns({"_in": inline_heading(F.col("line")), "_h": heading(F.col("line"))})
    h = h.withColumns(
        {
            "is_heading": F.col("_in").isNotNull() | F.col("_h").isNotNull(),
            "_k": F.coalesce(F.struct(F.col("_in.kind"), F.col("_in.title")), F.lit(None)),
        }
    ).withColumn("_k", F.when(F.col("_in").isNotNull(), F.col("_k")).otherwise(F.col("_h")))
    return h.select(
        *keys,
        *(LINE_COLUMNS if offsets else ("line_no", "line")),
        "is_heading",
        F.col("_in.rest").alias("inline_rest"),
        F.sum(F.col("is_heading").cast("int")).over(own).alias("sec_no"),
        F.coalesce(F.last(F.col("_k.kind"), ignorenulls=True).over(own), F.lit("preamble")).alias("kind"),
        F.coalesce(F.last(F.col("_k.title"), ignorenulls=True).over(own), F.lit("")).alias("title"),
    )


def sections(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), offsets: bool = True) -> DataFrame:
    """``(*keys, sec_no, kind, title, start_line, end_line, start_offset, end_offset, heading_line, body)``; section 0 is the preamble.

    A section ends where the next heading begins, the last one with the text.  Without ``offsets`` those two columns are left out, and no Python runs.
    """
    t = tagged_lines(docs, text, keys, offsets)
    body = F.when(~F.col("is_heading"), F.col("line")).otherwise(F.col("inline_rest"))
    rows = t.groupBy(*keys, "sec_no", "kind", "title").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        *((F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("_end")) if offsets else ()),
        F.coalesce(F.max(F.when(F.col("is_heading"), F.col("line"))), F.lit("")).alias("heading_line"),
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("line_no", body.alias("b"))))), lambda x: x["b"]), "\n")).alias("body"),
    )
    if not offsets:
        return rows
    after = Window.partitionBy(*keys).orderBy("sec_no")
    return rows.withColumn("end_offset", F.coalesce(F.lead("start_offset").over(after), F.col("_end"))).drop("_end")


def kinds(secs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, kinds)``: the kinds of a document's sections in the order of their first, what precedes all headings left out."""
    first = secs.where("sec_no > 0").groupBy(*keys, "kind").agg(F.min("sec_no").alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "kind"))), lambda x: x["kind"]).alias("kinds"))


def first(secs: DataFrame, wanted: list[str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first section of some kinds of each document that has one; all columns."""
    rest = [c for c in secs.columns if c not in (*keys, "sec_no")]
    found = secs.where(F.col("kind").isin(wanted)).groupBy(*keys).agg(F.min(F.struct("sec_no", *rest)).alias("_s"))
    return found.select(*keys, "_s.*").select(secs.columns)


def having(docs: DataFrame, secs: DataFrame, wanted: list[str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` that have a section of some kinds."""
    return docs.join(secs.where(F.col("kind").isin(wanted)).select(*keys).distinct(), list(keys), "left_semi")


def text_of(secs: DataFrame, kinds: list[str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bodies of sections of some kinds, joined in order."""
    return secs.where(F.col("kind").isin(kinds) & (F.col("body") != "")).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "body"))), lambda x: x["body"]), "\n").alias("text")
    )


def scan_text(secs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A document's text without its self-assessment and benefit sections."""
    kinds = [k for k in (*V.SECTION_KINDS, "preamble") if k not in ("summary", "benefit")]
    return text_of(secs, kinds, keys)
