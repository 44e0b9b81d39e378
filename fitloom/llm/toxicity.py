"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows: both hold the commonest ordinary
words, one then holds the words of toxic texts whose fragments are over-represented there,
the other as many bytes of further ordinary words.  A window is a word (longer ones are
cut into windows of 64 bytes) written three times, since zstandard stores shorter blocks
raw.  Its two compressed lengths give a saving; a text's windows are counted by saving and
saved share, and a logistic curve fitted on other labelled rows turns the counts into a
probability at the labels' own base rate, so that 0.5 is the calibrated threshold.

Labels are learned from rows whose crc32(doc_id) mod 5 isn't 0: remainders 1 to 3 train the
dictionaries and 4 calibrates.  The fit reads a sample bounded by ``MOST_TOXIC`` and
``MOST_ORDINARY`` rows, taken by a hash of the id, without texts beyond ``MOST_BYTES``;
scoring reads whole texts of all rows.

Defined cases: a null or blank text has no windows and gets the intercept's probability;
repeated rows get equal scores; extra columns are ignored; without labels of both classes
all scores are the share of toxic labels (0 without any), which ``keep_clean`` follows too;
empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import fold, release

FOLDS = 5
#: Bounds of the labelled sample.
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 1500, 3000, 32_768
#: Bytes of a window; lengths of the fragments that choose the toxic words; least rows and z-score of a fragment.
WINDOW, FRAGMENTS, LEAST_ROWS, LEAST_Z = 64, (4, 5, 7), 4, 7.0
#: Words in the dictionaries: common to both, and of each kind at most.
SHARED, OWN = 600, 1500
#: Cells of the windows' histogram: shares of the length that is saved, by bytes saved.
SHARES, SAVED = 4, 8
CELLS = SHARES * SAVED + 1
MEMO = 150_000


def words(text: str | None) -> list[bytes]:
    """The text's windows."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    if any(len(w) > WINDOW for w in out):
        out = [w[i : i + WINDOW] for w in out for i in range(0, len(w), WINDOW)]
    return out


def fragments(word: bytes) -> set[bytes]:
    b = b" " + word + b" "
    return {b[i : i + n] for n in FRAGMENTS for i in range(len(b) - n + 1)}


@dataclass(frozen=True)
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: tuple[float, ...] = ()
    base: float = 0.0


def compressor(content: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(15, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def histogram(model: Model) -> Callable[[list[bytes]], np.ndarray]:
    """A function from a text's windows to counts by cell (cell 0: nothing saved), with a bounded memo."""
    toxic, ordinary = compressor(model.toxic).compress, compressor(model.ordinary).compress
    memo: dict[bytes, int] = {}

    def cell(w: bytes) -> int:
        x = (b" " + w) * 3 + b" "
        a = len(ordinary(x))
        saved = a - len(toxic(x))
        if saved <= 0:
            return 0
        return min(saved, SAVED) + SAVED * min(SHARES - 1, 5 * saved // max(1, a - 13))

    def count(ws: list[bytes]) -> np.ndarray:
        if len(memo) > MEMO:
            memo.clear()
        for w in ws:
            if w not in memo:
                memo[w] = cell(w)
        return np.bincount([memo[w] for w in ws] or [0], minlength=CELLS + SAVED)[:CELLS]

    return count


def features(count: Callable, ws: list[bytes]) -> np.ndarray:
    return np.concatenate((np.log1p(count(ws)[1:]), [math.log1p(len(ws)), 1.0]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (weight * (p - y)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_dictionaries(rows: list[tuple[list[bytes], int]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, the likeliest words last (nearest)."""
    seen, df = (Counter(), Counter()), (Counter(), Counter())
    n = [0, 0]
    for ws, y in rows:
        distinct = set(ws)
        seen[y].update(distinct)
        df[y].update(set().union(*map(fragments, distinct)) if distinct else ())
        n[y] += 1

    def z(g: bytes) -> float:
        p = (df[0][g] + df[1][g]) / (n[0] + n[1])
        return (df[1][g] / n[1] - df[0][g] / n[0]) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))

    telling = {g for g, k in df[1].items() if k >= LEAST_ROWS and z(g) >= LEAST_Z}
    rank = lambda c: sorted(c, key=lambda w: (-c[w], w))
    toxic = [w for w in rank(seen[1]) if fragments(w) & telling][:OWN]
    common = rank(seen[0])[: SHARED + 2 * OWN]
    text = lambda ws: b" " + b"  ".join(reversed(ws)) + b" "
    k, other = 0, common[SHARED:]
    while k < len(other) and len(text(other[: k + 1])) <= max(len(text(toxic)), 64):
        k += 1
    return text(common[:SHARED]) + text(toxic), text(common[:SHARED]) + text(other[:k])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from a bounded labelled sample."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit("toxicity")))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = total.get(1, 0) / max(1, sum(total.values()))
    sample = known.where("toxic = 1").orderBy("_h", "doc_id").limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy("_h", "doc_id").limit(MOST_ORDINARY))
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
    found = short.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("_h", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["_h"], r["doc_id"], r["text"] or ""))
    rows = [(words(r["text"]), r["toxic"], zlib.crc32(str(r["doc_id"]).encode()) % FOLDS) for r in found]
    learn, rest = [(w, y) for w, y, k in rows if k < FOLDS - 1], [(w, y) for w, y, k in rows if k == FOLDS - 1]
    if len({y for _, y in learn}) < 2 or len({y for _, y in rest}) < 2:
        return Model(base=base)
    toxic, ordinary = train_dictionaries(learn)
    count = histogram(Model(toxic, ordinary))
    y = np.array([y for _, y in rest], float)
    # The sample's classes count as often as they do among all labels.
    weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    return Model(toxic, ordinary, tuple(logistic(np.array([features(count, w) for w, _ in rest]), y, weight)), base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(model.weights)
        count = histogram(model) if model.weights else None
        for b in batches:
            for k in range(0, b.num_rows, 200):
                texts = b.column(1)[k : k + 200].to_pylist()
                s = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(count, words(t)) @ weights))))) for t in texts] if count else [model.base] * len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 200], pa.array(s, pa.float64())], names=["doc_id", "score"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't judged toxic, all columns kept."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(model.weights)
        count = histogram(model) if model.weights else None
        at = names.index("text")
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                if count:
                    part = part.filter(pa.array([float(features(count, words(t)) @ weights) < 0 for t in part.column(at).to_pylist()]))
                elif model.base >= 0.5:
                    part = part.slice(0, 0)
                yield part
        release()

    return docs.mapInArrow(run, docs.schema)
