"""Uploaded files: formats, a cascade of encodings, size limits; what can't be read is set aside with its reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("txt", "md", "markdown", "json", "csv", "log", "")
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "big5")


def decode_bytes(data: bytes) -> str | None:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def _office(data: bytes, suffix: str) -> tuple[str | None, str | None]:
    """(text, reason) of a PDF or DOCX file, where the optional reader is installed."""
    import io

    try:
        if suffix == "pdf":
            from pypdf import PdfReader

            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages), None
        from docx import Document

        d = Document(io.BytesIO(data))
        return "\n".join([p.text for p in d.paragraphs] + [" | ".join(c.text for c in r.cells) for t in d.tables for r in t.rows]), None
    except ImportError:
        return None, f"no reader for {suffix} is installed"
    except Exception as e:  # a broken file must not fail the job
        return None, f"unreadable {suffix}: {type(e).__name__}"


def read_uploads(spark: SparkSession, path: str, most_mb: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(``path, text`` of readable files, ``path, reason`` of the others).

    Spark's file listing leaves out files of no bytes: they appear in neither part.
    """
    raw = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))

    @F.pandas_udf("text string, reason string")
    def read(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for b, k in zip(data, kind, strict=True):
            if not b:
                out.append((None, "empty"))
            elif k in TEXT_SUFFIXES:
                t = decode_bytes(b)
                out.append((t, "unknown encoding" if t is None else None if t.strip() else "empty"))
            elif k in ("pdf", "docx"):
                out.append(_office(b, k))
            else:
                out.append((None, f"unsupported format: {k}"))
        return pd.DataFrame(out, columns=["text", "reason"])

    big = F.col("length") > int(most_mb * 1_000_000)
    parsed = raw.withColumn("x", F.when(~big, read(F.col("content"), suffix))).select("path", F.col("x.text").alias("text"), F.when(big, F.lit("too large")).otherwise(F.col("x.reason")).alias("reason"))
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null").select("path", "reason")
