"""Token counts through a digest cache.

Counts are stored under (content digest, tokenizer digest).  A run digests every text,
joins the digests to the stored counts, encodes one text for each distinct digest that is
missing, appends those counts to the cache and joins them back to the documents.

The content digest is SHA-256 of the text after normalisation; for a tokenizer without a
normaliser (byte-level BPE) the only normalisation that keeps counts exact is null to
empty.  The tokenizer digest covers the file's bytes and the library's version, so another
vocabulary never meets old counts.

Encoding splits a text before each single space between two non-space characters, where
byte-level BPE never joins, and keeps a bounded per-worker memo of the pieces' counts, so
that a frequent word is encoded once; the sum equals the count of the whole text (tested
against the library).  A tokenizer of another kind encodes whole texts.

Defined cases: null counts as empty (0 bytes, 0 tokens); repeated rows and equal texts
come back with equal counts, each row once; special strings inside texts are handled as
the library does by default; extra columns are ignored; an empty table gives no rows and
appends none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm.common import materialize, shared_dir, spread_join

#: Pieces that a worker remembers at most, and the longest piece that it remembers.
MEMO, LONGEST = 1_000_000, 64
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"\s | \s|^ | $")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library}|{version(library)}".encode()).hexdigest()


def spaced(path: str) -> bool:
    """Whether the tokenizer is byte-level BPE without normaliser, so that spaced pieces count by themselves."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    free = [t["content"] for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"])]
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not free


def pieces(text: str) -> list[str]:
    """The text cut before each single inner space; the pieces join to the text again."""
    if ODD.search(text) is None:
        first, *rest = text.split(" ")
    else:
        first, *rest = CUT.split(text)
    return [first, *(" " + x for x in rest)] if text else []


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, for one worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def encode(texts: list[str]) -> list[int]:
        return [len(e) for k in range(0, len(texts), 2000) for e in tok.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]

    if not spaced(path):
        return encode
    memo: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = pieces(text)
            while True:
                try:
                    out.append(sum(map(memo.__getitem__, parts)))
                    break
                except KeyError:
                    missing = list({p for p in parts if p not in memo})
                    if len(memo) + len(missing) > MEMO:
                        memo.clear()
                        missing = list(set(parts))
                    found = dict(zip(missing, encode(missing), strict=True))
                    if len(found) > MEMO // 2 or any(len(p) > LONGEST for p in found):
                        memo.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
                        out.append(sum(found[p] if p in found else memo[p] for p in parts))
                        if len(memo) > MEMO:
                            memo.clear()
                        break
                    memo.update(found)
        return out

    return count


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """``(digest, n_tokens)`` of ``texts(digest, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counters.get(path) or _counters.setdefault(path, counter(path))
        for b in batches:
            for k in range(0, b.num_rows, 200):
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 200], pa.array(count(b.column(1)[k : k + 200].to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows, none where it doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = "digest binary, tokenizer string, n_tokens long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row; new counts are appended to ``cache``."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    cache = cache or f"{shared_dir(spark)}/token-cache-{hashlib.sha256(os.urandom(16)).hexdigest()[:16]}"
    stored = read_cache(spark, cache)
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digested = filled.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    keys = materialize(digested.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    n = keys.count()
    groups = materialize(keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "texts", n)
    misses = groups.select("digest", "doc_id").join(known, "digest", "left_anti")
    # Joined on id and digest, not on the digest alone: the many copies of one text stay spread out.
    texts = digested.alias("d").join(
        misses.hint("shuffle_hash").alias("m"),
        F.col("d.digest").eqNullSafe(F.col("m.digest")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")),
        "left_semi",
    )
    fresh = materialize(encode_counts(texts, path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "fresh")
    counts = known.unionByName(fresh)
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return spread_join(keys, groups.select("digest", "n").join(counts, "digest"), ["digest"], n).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
