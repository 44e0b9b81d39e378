"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Base spans follow fixed patterns.  Added ones are found in the other runs of 16 or more
characters of keys (letters, digits, ``+/_=-``) that aren't numbers: two first-order Markov
models, of random strings and of ordinary identifiers, give each step from one character
to the next a log-likelihood ratio.  A run's steps are summed from left to right, from 0
again whenever the sum falls below it; a stretch between such restarts is a secret, up to
its highest sum, if that sum reaches ``LEAST`` and the stretch 16 characters.  So a random
part of a path or of a compound name is found by itself.

Both models are trained here.  Samples of ordinary identifiers are all runs of such
characters, numbers left out, outside the base spans of all documents, and the joints of
identifiers made of their words (``with_joined``); samples of random
strings are the values of base spans of 16 or more characters in all documents, and
``MADE`` digests in each of the alphabets that keys are written in.  A task counts the
steps of its texts, and what the driver gets is one number for each pair of characters.

Defined cases: null or empty texts have no spans; positions are code points, end
exclusive; repeated rows get equal results; texts are read whole; extra columns are
ignored; an empty table gives no rows, and models trained on none know the made strings
alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from base64 import b32encode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are maximal, so that these find what runs of any length give after the short ones are dropped.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile("[A-Za-z0-9+/_=-]{16,}")
#: Characters of an added span at least; its log-likelihood ratio at least (a million to one); made strings of an alphabet; pseudo counts of a character, and of a step by its second character.
CHARS, LEAST, MADE, PSEUDO, BACK = 16, math.log(1e6), 200, 0.5, 5.0
#: Prose has few identifiers of several words: what joins them, and the share of word ends that count as each of these or as a capital.
JOINTS, JOINED = "_-/", 0.1
SIDE = len(KEY) + 1  # symbol 0 is whatever else stands before or after a run
SYMBOL = np.zeros(128, np.int16)
SYMBOL[[ord(c) for c in KEY]] = np.arange(1, SIDE)
INDEX = {c: i for i, c in enumerate(KEY, 1)}

Span = tuple[int, int, int]  # start, kind, end


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) by the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMED):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[Span]:
    return [m[:3] for m in base_matches(text)]


def steps(symbols: np.ndarray) -> np.ndarray:
    """Counts of steps by first and second symbol; those between two symbols 0 don't count."""
    padded = np.concatenate(([0], symbols, [0])).astype(np.int64)
    n = np.bincount(padded[:-1] * SIDE + padded[1:], minlength=SIDE * SIDE)
    n[0] = 0
    return n


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, SYMBOL[np.minimum(points, 127)], 0)


def without_numbers(symbols: np.ndarray) -> np.ndarray:
    """Runs that are digits alone become symbols 0."""
    inside = symbols > 0
    if not inside.any():
        return symbols
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digit = (symbols >= INDEX["0"]) & (symbols <= INDEX["9"])
    total = np.concatenate(([0], np.cumsum(digit)))
    number = total[last] - total[first] == last - first
    out = symbols.copy()
    for a, b in zip(first[number], last[number], strict=True):
        out[a:b] = 0
    return out


def samples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the ordinary identifiers and of the random strings of a text."""
    symbols, secret = symbols_of(text), np.zeros(SIDE * SIDE, np.int64)
    matches = base_matches(text)
    if matches:
        value = np.zeros(len(symbols), bool)
        for _, _, end, at in matches:
            if end - at >= CHARS:
                value[at:end] = True
        secret = steps(np.where(value, symbols, 0))
        symbols = symbols.copy()
        for start, _, end, _ in matches:
            symbols[start:end] = 0
    return steps(without_numbers(symbols)), secret


def made() -> list[str]:
    """Random strings in the usual alphabets: digests, so that runs agree."""
    out = []
    for i in range(MADE):
        d = hashlib.sha512(str(i).encode()).digest()
        b = b64encode(d).decode()
        out += [d.hex(), d.hex().upper(), b32encode(d).decode().rstrip("="), b, b.replace("+", "-").replace("/", "_").rstrip("="), re.sub("[+/=]", "", b)]
    return out


def with_joined(ordinary: np.ndarray) -> np.ndarray:
    """Counts of ordinary steps with those of identifiers made of words: at word ends a share goes on to the next word, after a joint or with a capital."""
    n = ordinary.reshape(SIDE, SIDE).astype(np.float64)
    ends, starts = n[:, 0] * JOINED, n[0] / max(1, n[0].sum())
    for c in JOINTS:
        n[:, INDEX[c]] += ends
        n[INDEX[c]] += starts * ends.sum()
    capital = np.zeros(SIDE)
    for c in KEY[26:52]:
        capital[INDEX[c.upper()]] = starts[INDEX[c]]
        n[INDEX[c.upper()]] += n[INDEX[c]] * starts[INDEX[c]] * JOINED
    return (n + ends[:, None] * capital).reshape(-1)


def ratios(ordinary: np.ndarray, secret: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each step, random over ordinary, from the counts of steps."""
    secret, ordinary = secret + sum(steps(symbols_of(x)) for x in made()), with_joined(ordinary)

    def log_probability(n: np.ndarray) -> np.ndarray:
        n = n.reshape(SIDE, SIDE)
        single = n.sum(0) + PSEUDO
        return np.log((n + BACK * single / single.sum()) / (n.sum(1, keepdims=True) + BACK))

    return log_probability(secret) - log_probability(ordinary)


def train(docs: DataFrame) -> np.ndarray:
    """``ratios`` from the texts of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SIDE * SIDE), np.int64)
        for b in batches:
            for text in b.column(0):
                x, y = samples(text.as_py() or "")
                n[0] += x
                n[1] += y
        kind, step = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(n[kind, step])], names=["kind", "step", "n"])

    out = np.zeros((2, SIDE * SIDE), np.int64)
    for r in docs.select("text").mapInArrow(run, "kind int, step int, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect():  # 2 * SIDE ** 2 rows at most
        out[r["kind"], r["step"]] = r["n"]
    return ratios(out[0], out[1])


def random_parts(run: str, table: list[list[float]]) -> Iterator[tuple[int, int]]:
    """The stretches of a run that are likelier random, as (start, end)."""
    total = best = 0.0
    start = end = before = 0
    for i, c in enumerate(run):
        now = INDEX[c]
        total += table[before][now]
        before = now
        if total < 0:
            if best >= LEAST and end - start >= CHARS:
                yield start, end
            total, best, start, end = 0.0, 0.0, i + 1, i + 1
        elif total > best:
            best, end = total, i + 1
    if best >= LEAST and end - start >= CHARS:
        yield start, end


def find(text: str | None, table: list[list[float]]) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text; added ones overlap no base one."""
    text = text or ""
    base, added = base_spans(text), []
    for m in RUN.finditer(text):
        if m.group().isdigit():
            continue
        # What base spans leave of the run.
        cuts, at = [(a, b) for a, _, b in base if a < m.end() and b > m.start()], m.start()
        for a, b in [*cuts, (m.end(), m.end())]:
            if a - at >= CHARS:
                added += [(at + x, 3, at + y) for x, y in random_parts(text[at:a], table)]
            at = max(at, b)
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]


def find_all(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)``; n_random counts the added spans."""
    scores = (train(docs) if table is None else table).tolist()

    def row(text: str | None) -> tuple:
        base, added = find(text, scores)
        kinds = [k for _, k, _ in base]
        return (*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = list(zip(*(row(t.as_py()) for t in b.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
