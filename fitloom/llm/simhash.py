"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have
it set.  Two fingerprints at ``budget`` or fewer differing bits link.  Texts are grouped by
fingerprint first, so only distinct fingerprints are compared.

Pigeonring: cut the 64 bits into a ring of ``segments``; if two fingerprints differ in at
most ``budget`` bits, then some segment starts a chain of which each prefix of ``l``
segments differs in at most ``l * budget / segments`` bits.  With more segments than
``budget`` the chain's first segment must be equal, so segments are the join keys; a pair
is dropped unless its whole chain from that segment stays within the budgets, and the full
Hamming distance is checked last.  The filter loses no pair.

Defined cases: a null or blank text has fingerprint zero and links like any other; a text
with fewer words than a shingle is one shingle; equal texts share a fingerprint; repeated
rows come back repeatedly; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Forest, components, deal, materialize, spread_join

#: Shingles whose bits are counted at once.
CHUNK = 100_000
#: Rows of a segment value beyond which it is split into blocks.
CAP = 256


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased; none for a blank text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[i:j], 42) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(groups: list[list[int]]) -> np.ndarray:
    """Each group's fingerprint, as unsigned 64-bit numbers."""
    out = np.zeros(len(groups), np.uint64)
    held, size = [], 0

    def flush() -> None:
        h = np.fromiter((x for i in held for x in groups[i]), np.uint64, size)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([len(groups[i]) for i in held])
        counts = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
        out[held] = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()

    for i, g in enumerate(groups):
        if len(g) > CHUNK:
            total = np.zeros(64, np.int64)
            for k in range(0, len(g), CHUNK):
                part = np.array(g[k : k + CHUNK], np.uint64)
                total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(total * 2 > len(g), bitorder="little").view(np.uint64)[0]
        elif g:
            held.append(i)
            size += len(g)
            if size > CHUNK:
                flush()
                held, size = [], 0
    if held:
        flush()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for k in range(0, b.num_rows, 500):
                fp = majority([shingle_hashes(t, width) for t in texts[k : k + 500].to_pylist()])
                yield pa.RecordBatch.from_arrays([ids[k : k + 500], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ring_holds(x: Column, start: Column, segments: int, budget: int) -> Column:
    """Whether the chain from segment ``start`` of the xor ``x`` stays within its proportional budgets."""
    width = 64 // segments
    ok = F.lit(True)
    for length in range(1, segments):
        # The chain's bits, turned so that the segment `start` comes lowest.
        shift = (start * width).cast("int")
        low = F.call_function("shiftrightunsigned", x, shift)
        high = F.when(shift > 0, F.call_function("shiftleft", x, F.lit(64) - shift)).otherwise(F.lit(0).cast("long"))
        chain = low.bitwiseOR(high).bitwiseAND(F.lit((1 << (width * length)) - 1).cast("long"))
        ok = ok & (F.bit_count(chain) <= length * budget // segments)
    return ok


def near_edges(classes: DataFrame, segments: int = 4, budget: int = 3) -> DataFrame:
    """``(a, b)``: enough links among ``classes(rep, fp)`` (distinct fps) to join all within ``budget`` bits of each other."""
    if 64 % segments or segments <= budget:
        raise ValueError("segments must divide 64 and exceed the budget")
    width = 64 // segments
    mask = (1 << width) - 1
    keyed = classes.select(
        "rep",
        "fp",
        F.posexplode(F.array(*[F.call_function("shiftrightunsigned", F.col("fp"), F.lit(i * width)).bitwiseAND(F.lit(mask).cast("long")) for i in range(segments)])).alias("seg", "val"),
    )
    small, large = deal(keyed, ["seg", "val"], "rep", CAP)
    left, right = small.alias("l"), small.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    cold = (
        left.join(
            right,
            (F.col("l.seg") == F.col("r.seg"))
            & (F.col("l.val") == F.col("r.val"))
            & (F.col("l.rep") < F.col("r.rep"))
            & ring_holds(x, F.col("l.seg"), segments, budget)
            & (F.bit_count(x) <= budget),
        )
        .select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    )

    def block(pdf):
        import pandas as pd

        start = int(pdf["seg"].iloc[0]) * width
        pdf = pdf.drop_duplicates("rep").sort_values("rep")
        fp, rep, own = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf["own"].to_numpy()
        turned = (fp >> np.uint64(start)) | (fp << np.uint64(64 - start)) if start else fp
        b1, b2 = int(pdf["b1"].iloc[0]), int(pdf["b2"].iloc[0])
        at_l, at_r = np.flatnonzero(own == b1), np.flatnonzero(own == b2)
        tree = Forest(len(fp))
        for i in at_l:
            d = turned[at_r] ^ turned[i]
            for length in range(2, segments):
                keep = np.bitwise_count(d & np.uint64((1 << (width * length)) - 1)) <= length * budget // segments
                at, d = (at, d)[0][keep] if length > 2 else at_r[keep], d[keep]
            for j in at[np.bitwise_count(d) <= budget]:
                tree.join(int(i), int(j))
        roots = np.array([tree.root(i) for i in range(len(fp))], np.int64)
        found = roots != np.arange(len(fp))
        return pd.DataFrame({"a": rep[roots[found]], "b": rep[found]})

    hot = large.groupBy("seg", "val", "b1", "b2").applyInPandas(block, "a long, b long")
    return cold.unionByName(hot)


def near_classes(fps: DataFrame, segments: int = 4, budget: int = 3) -> DataFrame:
    """``(fp, n, component)`` for each distinct fp of ``fps(doc_id, fp)``: its rows, the smallest doc_id reachable over links."""
    n = fps.count()
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes", n)
    found = components(near_edges(classes, segments, budget), rows=4 * n)
    return classes.join(found, classes.rep == found.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component"))


def simhash_dedup(docs: DataFrame, width: int = 3, segments: int = 4, budget: int = 3) -> DataFrame:
    """One row per document: ``(doc_id, fingerprint, component_id, kept)``."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    n = fps.count()
    found = materialize(near_classes(fps, segments, budget), "components", n)
    return spread_join(fps, found, ["fp"], n).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
    )
