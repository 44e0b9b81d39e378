"""Mixing sources to target weights.

Each source's words, its documents one after another in a hashed order, are packed into
blocks of ``block`` words (a source's last block may be shorter).  Sources weigh 1, 2, 3,
repeating, in code-point order with null last; their targets share all words by weight,
stop at ``most`` times the source's own words, and hand the excess on by weight until none
is above.  Targets become slot counts; for each output shard the sources' counts are drawn
multinomially from the slots that are left (so the totals are met exactly); slot i of a
source is block perm(i mod n) of the source's pass i div n, with a Feistel permutation of
the block indexes for each source and pass; slots and blocks are joined by index.

A block is taken at most ceil(slots / blocks) <= ``most`` times, so no document exceeds
``most`` times its size.  Everything is seeded: reruns agree, whatever the partitions.

Defined cases: a null or blank text has size 0 and is taken 0 times; a null source is a
source of its own; repeated rows are documents of their own with the same digest columns
where equal draws fall to them; extra columns are ignored; an empty table or one without
any word gives targets 0.  The driver holds one row per source and at most ``SHARDS`` rows
of counts per source.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import WORD, materialize

#: Least slots of an output shard, most shards, rows of a source that are placed together, chunks whose starts are summed together,
#: slots that a task draws, sources that a broadcast may hold.
SHARD_SLOTS, SHARDS, CHUNK_ROWS, RUN_CHUNKS, TASK_SLOTS, FEW_SOURCES = 1024, 4096, 400, 1024, 20_000, 10_000


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of all words by weight, none above ``most`` times the source's size."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), [i for i in range(len(sizes))]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def slot_counts(sizes: list[int], goals: list[float], block: int) -> list[int]:
    """Slots of each source: whole passes over its blocks, and the rest in blocks."""
    out = []
    for size, goal in zip(sizes, goals, strict=True):
        n = -(-size // block)
        passes = int(goal // size) if size else 0
        rest = goal - passes * size
        out.append(passes * n + min(n, round(rest / min(block, size))) if size else 0)
    return out


def shard_counts(slots: list[int], seed: int) -> np.ndarray:
    """Counts by shard and source: multinomial draws from what is left of each source's slots."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, per = np.array(slots, np.int64), max(SHARD_SLOTS, -(-sum(slots) // SHARDS))
    rows = []
    while (total := int(left.sum())) > 0:
        need, got = min(per, total), np.zeros(len(left), np.int64)
        while need:
            p = left / left.sum()
            draw = np.minimum(rng.multinomial(need, p / p.sum()), left)
            got, left, need = got + draw, left - draw, need - int(draw.sum())
        rows.append(got)
    return np.array(rows, np.int64).reshape(len(rows), len(slots))


def permuted(i: np.ndarray, n: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the next even bit width, walked back into range."""
    if n <= 1:
        return i.copy()
    half = np.uint64(max(1, math.ceil((n - 1).bit_length() / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return (a << half) | b

    x = once(i.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


class Mix:
    """The mix of ``docs(doc_id, source, text)``: its sources, slots and placed documents."""

    def __init__(self, docs: DataFrame, block: int = 256, most: int = 3, seed: int = 42):
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        sized = materialize(
            docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("digest")),
            "sizes",
        )
        found = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        names = sorted((s for s in found if s is not None)) + [None] * (None in found)
        sizes = [found[s]["size"] for s in names]
        goals = targets(sizes, [1 + i % 3 for i in range(len(names))], most)
        self.slots = slot_counts(sizes, goals, block)
        self.blocks = [-(-s // block) for s in sizes]
        self.sources = self.spark.createDataFrame(
            [(i, s, sizes[i], goals[i], max(1, -(-found[s]["n"] // CHUNK_ROWS))) for i, s in enumerate(names)], "sid int, source string, source_size long, target double, chunks int"
        )
        self.sized = sized

    def placed(self) -> DataFrame:
        """Each document with its first word's index within its source (``sid, chunk, rn`` name a row)."""
        tagged = (
            self.sized.alias("d")
            .join((F.broadcast(self.sources) if len(self.slots) <= FEW_SOURCES else self.sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("doc_id", "digest", "size", "sid", "source_size", "target", F.pmod(F.xxhash64("doc_id", "digest", F.lit(self.seed)), F.col("chunks")).cast("int").alias("chunk"))
        )
        own = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "digest")
        within = tagged.withColumns({"rn": F.row_number().over(own), "_at": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
        # One row per source and chunk; only these are summed in order.
        sums = tagged.groupBy("sid", "chunk").agg(F.sum("size").alias("_n")).withColumn("_span", F.floor(F.col("chunk") / RUN_CHUNKS))
        before = lambda name, *by: F.sum(name).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col(name)
        spans = sums.groupBy("sid", "_span").agg(F.sum("_n").alias("_s")).withColumn("_first", before("_s", "sid", "_span")).drop("_s")
        starts = sums.withColumn("_in", before("_n", "sid", "_span", "chunk")).join(spans, ["sid", "_span"]).select("sid", "chunk", (F.col("_first") + F.col("_in")).alias("_start"))
        return within.join(starts, ["sid", "chunk"]).withColumn("at", F.col("_start") + F.col("_at")).drop("_start", "_at")

    def segments(self) -> DataFrame:
        """``placed`` cut at block borders: block, and the words [first, last) of the document that it holds."""
        b = F.lit(self.block)
        size, at = F.col("size"), F.col("at")
        return (
            self.placed()
            .where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(at / b), F.floor((at + size - 1) / b))))
            .withColumns({"first": F.greatest(F.lit(0).cast("long"), F.col("block") * b - at), "last": F.least(size, (F.col("block") + 1) * b - at)})
        )

    def draws(self) -> DataFrame:
        """``(shard, sid, slot, pass, block)``: one row per slot of the mix."""
        counts = shard_counts(self.slots, self.seed)
        firsts = np.cumsum(counts, axis=0) - counts
        plan = [(j, s, int(firsts[j, s]), int(counts[j, s]), self.blocks[s]) for j in range(len(counts)) for s in range(len(self.slots)) if counts[j, s]]
        df = self.spark.createDataFrame(plan, "shard int, sid int, first long, n long, blocks long")
        seed = self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, sid, first, n, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for k in range(first, first + n, 100_000):
                        i = np.arange(k, min(k + 100_000, first + n))
                        turn, out = i // blocks, np.empty(len(i), np.int64)
                        for e in np.unique(turn):
                            out[turn == e] = permuted(i[turn == e] % blocks, blocks, f"{seed}/{sid}/{e}")
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shard, np.int32)), pa.array(np.full(len(i), sid, np.int32)), pa.array(i), pa.array(turn), pa.array(out)], names=["shard", "sid", "slot", "pass", "block"])

        return df.repartition(max(1, -(-sum(self.slots) // TASK_SLOTS)), "shard", "sid").mapInArrow(run, "shard int, sid int, slot long, pass long, block long")

    def times(self) -> DataFrame:
        """``(sid, block, times, shard)``: how often each block is drawn, and the first shard that holds it."""
        return self.draws().groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))

    def shards(self) -> DataFrame:
        """The mix itself: for each slot the word ranges ``[first, last)`` of the documents in its block."""
        return self.draws().join(self.segments().select("sid", "block", "doc_id", "digest", "first", "last"), ["sid", "block"])

    def taken(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken, slots, first_shard)`` for each row.

        slots counts the mix's slots that hold words of the document, first_shard is the first shard that does (null: none).
        """
        rows = self.placed()
        got = (
            self.segments()
            .join(self.times(), ["sid", "block"])
            .groupBy("sid", "chunk", "rn")
            .agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"), F.sum("times").alias("slots"), F.min("shard").alias("first_shard"))
        )
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return rows.join(got, ["sid", "chunk", "rn"], "left").select("doc_id", "size", "source_size", "target", zero("taken"), zero("slots"), "first_shard")


SPAN = re.compile(WORD)


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text of the word ranges [first, last), adjoining ranges in one piece, pieces on lines of their own."""
    spans = [m.span() for m in SPAN.finditer(text)]
    runs: list[list[int]] = []
    for a, b in sorted(ranges):
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def mix_documents(docs: DataFrame, block: int = 256) -> DataFrame:
    """The mix as documents: one row for each pass that takes words of a document, with its columns.

    The text holds the words that the pass takes (all of them: the text as it was) and
    n_chars its length.  Rows that are equal in id and text share the first one's draws.
    """
    m = Mix(docs.select("doc_id", "source", "text"), block)
    got = (
        m.segments()
        .join(m.times(), ["sid", "block"])
        .groupBy("doc_id", "digest", "size", "sid", "chunk", "rn")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last", "times"))).alias("ranges"))
        .groupBy("doc_id", "digest", "size")
        .agg(F.min_by("ranges", F.struct("sid", "chunk", "rn")).alias("ranges"))
    )
    # The columns travel in one, so that no name of theirs can clash.
    packed = docs.select(F.xxhash64("text").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    joined = packed.join(got.hint("shuffle_hash").alias("g"), F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.digest") == F.col("g.digest")))
    joined = joined.select(*[F.col(f"d.row.`{c}`").alias(c) for c in docs.columns], F.col("g.ranges").alias("__ranges"))
    names, schema = docs.columns, docs.schema
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                rows, out = [], []
                for i, (text, r) in enumerate(zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)):
                    for e in range(max(x["times"] for x in r)):
                        rows.append(i)
                        out.append(cut(text, [(x["first"], x["last"]) for x in r if x["times"] > e]))
                cols = [c.take(pa.array(rows, pa.int64())) for c in part.columns[: len(names)]]
                cols[at] = pa.array(out, pa.string())
                if chars is not None:
                    cols[chars] = pa.array([len(t) for t in out], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, schema)
