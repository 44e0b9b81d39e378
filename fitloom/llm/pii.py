"""Personal data with a skip-chain conditional random field.

Base spans follow fixed patterns and checks.  The field's nodes are a text's words that
hold a digit or an at sign (all other words are certainly outside), its labels "outside"
and the four kinds.  Log-linear unary potentials look at a word's shape, chain potentials
join neighbouring nodes, skip potentials join a node to the last earlier one with the same
core or the same six or more digits.  Loopy sum-product messages run until they settle;
words of a base span are held to its kind, and words that reach ``LEAST`` are added as
spans.  The repeats of a word form a path rather than a clique, so a text with a million
equal numbers costs a million edges.

All weights are trained here, on the base labels of at most ``SAMPLE`` texts of up to
``MOST_BYTES`` that hold a digit or at sign (a documented bound; finding spans reads every
whole text): unary ones by logistic regression on the words' shapes, chain and skip ones as
smoothed log ratios of the labels that meet on an edge, for words with the same core and for
words with the same digits apart.

Defined cases: null or empty texts have no spans; positions are code points, end
exclusive; repeated rows get equal results; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, TELLING, NODE = re.compile("[0-9]"), re.compile("[0-9@]"), re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT, EDGE = re.compile("[^0-9]+"), re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$")
#: Texts of the training sample and their bytes; kinds of skip edges; probability from which a word is added; sweeps at most.
SAMPLE, MOST_BYTES, EQUAL, SIMILAR, LEAST, SWEEPS = 2000, 32_768, 0, 1, 0.8, 30
#: Pseudo pairs of equal labels on skip edges, so that edges say something before they are met, and the bound of a log ratio.
PRIOR, MOST_RATIO = 8.0, 4.0

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by the fixed patterns, in order."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at)
        if m and start < at:
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


@dataclass
class Graph:
    """The nodes of one text and their edges."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int, int]] = field(default_factory=list)  # and the kind of edge


#: Shape features by index, "always" first.
FEATURES = ("always", "at", "letters", "plain", "luhn", "quad", "plus", "paren", "hyphen", "after_plus", "d1", "d4", "d10", "d14", "d20", "domain")


def shape(core: str, digits: str, after_plus: bool) -> list[int]:
    n = len(digits)
    has = {
        "always": True,
        "at": "@" in core,
        "domain": "@" in core and "." in core.rsplit("@", 1)[1],
        "letters": any(c.isalpha() for c in core),
        "plain": core == digits,
        "luhn": 14 <= n <= 19 and len(NOT_DIGIT.sub("", core)) == n and core.replace("-", "") == digits and luhn(digits),
        "quad": bool(IP.fullmatch(core)) and all(int(x[-4:]) <= 255 for x in core.split(".")),
        "plus": core.startswith("+"),
        "paren": core.startswith("("),
        "hyphen": "-" in core,
        "after_plus": after_plus,
        "d1": 1 <= n < 4,
        "d4": 4 <= n < 10,
        "d10": 10 <= n < 14,
        "d14": 14 <= n < 20,
        "d20": n >= 20,
    }
    return [i for i, f in enumerate(FEATURES) if has[f]]


def graph(text: str) -> Graph:
    """Nodes, chain edges between words that follow each other, skip edges between repeats."""
    g = Graph()
    if TELLING.search(text) is None:
        return g
    last_of: dict[str, int] = {}
    before, phone = -2, False
    for k, m in enumerate(NODE.finditer(text)):
        if TELLING.search(m.group()) is None:
            continue
        word = m.group()
        left = EDGE.match(word)
        start = m.start() + (left.end() if left and left.start() == 0 and left.end() < len(word) else 0)
        core = EDGE.sub("", word)
        digits = NOT_DIGIT.sub("", core)
        near = before == k - 1
        phone = core.startswith("+") or (near and phone and core[:1] in "(0123456789" and not core[-1:].isalpha())
        i = len(g.spans)
        g.spans.append((start, start + len(core)))
        g.features.append(shape(core, digits, phone and not core.startswith("+")))
        if near:
            g.chain.append((i - 1, i))
        for key, kind in (("=" + core.lower(), EQUAL), *((("#" + digits, SIMILAR),) if len(digits) >= 6 else ())):
            if key in last_of and (not g.skip or g.skip[-1][:2] != (last_of[key], i)):
                g.skip.append((last_of[key], i, kind))
            last_of[key] = i
        before = k
    return g


@dataclass(frozen=True)
class Weights:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: tuple[np.ndarray, np.ndarray]  # the same for each kind of skip edge


def ratios(pairs: np.ndarray, most: float) -> np.ndarray:
    """Log ratios of pairs of labels to what chance would give."""
    joint = pairs / pairs.sum()
    return np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -most, most)


def held(g: Graph, spans: list[Span]) -> list[int]:
    """Each node's base label: 0 outside, or 1 + kind."""
    out, k = [0] * len(g.spans), 0
    for i, (a, b) in enumerate(g.spans):
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        for s, kind, e in spans[k : k + 8]:
            if s < b and e > a:
                out[i] = 1 + kind
                break
    return out


def train(texts: list[str]) -> Weights:
    """Unary weights by multinomial logistic regression, chain and skip weights by smoothed log ratios, on base labels."""
    labels = len(KINDS) + 1
    rows, y, pairs = [], [], np.ones((labels, labels))
    repeats = [np.full((labels, labels), 0.5) + PRIOR * np.eye(labels) for _ in range(2)]
    for t in texts:
        g = graph(t)
        lab = held(g, base_spans(t))
        rows += g.features
        y += lab
        for i, j in g.chain:
            pairs[lab[i], lab[j]] += 1
        for i, j, kind in g.skip:
            repeats[kind][lab[i], lab[j]] += 1
    x = np.zeros((len(rows), len(FEATURES)))
    for i, f in enumerate(rows):
        x[i, f] = 1
    # Equal rows are counted once, and each class holds one pseudo row, so that no weight runs off.
    w = np.zeros((len(FEATURES), labels))
    w[0, 0] = 1.0
    if rows:
        kinds, inverse = np.unique(np.column_stack((x, np.array(y))), axis=0, return_inverse=True)
        weight = np.log1p(np.bincount(inverse.ravel())).astype(float)
        fx, target = kinds[:, :-1], np.eye(labels)[kinds[:, -1].astype(int)]
        for _ in range(300):
            z = fx @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= 0.5 * (fx.T @ ((p - target) * weight[:, None]) + 0.02 * w) / weight.sum()
    return Weights(w, ratios(pairs, 2), (ratios(repeats[EQUAL], MOST_RATIO), ratios(repeats[SIMILAR], MOST_RATIO)))


def marginals(g: Graph, base: list[int], w: Weights) -> np.ndarray:
    """Label probabilities of the nodes by loopy sum-product."""
    n, labels = len(g.spans), w.unary.shape[1]
    unary = np.array([w.unary[f].sum(0) for f in g.features])
    for i, b in enumerate(base):
        if b:
            unary[i, b] += 8
    a = np.array([i for i, _ in g.chain] + [i for i, _, _ in g.skip], np.int64)
    b = np.array([j for _, j in g.chain] + [j for _, j, _ in g.skip], np.int64)
    belief = unary
    if len(a):
        pots = np.array([w.chain] * len(g.chain) + [w.skip[k] for _, _, k in g.skip])
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        pot = np.exp(np.concatenate((pots, pots.transpose(0, 2, 1))))
        back = np.concatenate((np.arange(len(a), 2 * len(a)), np.arange(len(a))))
        msg = np.zeros((len(src), labels))
        for _ in range(SWEEPS):
            total = unary.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, pot))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if moved < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(text: str | None, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    text = text or ""
    base = base_spans(text)
    g = graph(text)
    if not g.spans:
        return base, []
    lab = held(g, base)
    if all(lab):
        return base, []
    p = marginals(g, lab, w)
    linked, added = {j for _, j in g.chain}, []
    for i, (a, b) in enumerate(g.spans):
        k = int(p[i].argmax())
        if lab[i] or not k or p[i, k] < LEAST:
            continue
        if k == 4 and added and i in linked and added[-1][1] == 3 and added[-1][2] == g.spans[i - 1][1]:
            added[-1] = (added[-1][0], 3, b)
        else:
            added.append((a, k - 1, b))
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def train_on(docs: DataFrame) -> Weights:
    """Weights from a bounded sample of texts that hold a digit or at sign, chosen by a hash of the text."""
    digest = F.xxhash64("text", F.lit("pii"))
    docs = docs.where(F.octet_length("text") <= MOST_BYTES)
    rows = docs.where(F.col("text").rlike("[0-9@]")).select(digest.alias("h"), F.col("doc_id")).orderBy("h", "doc_id").limit(SAMPLE)
    found = docs.select("text", digest.alias("h")).join(F.broadcast(rows.select("h").distinct()), "h", "left_semi").dropDuplicates(["h"]).collect()
    return train([r["text"] for r in sorted(found, key=lambda r: (r["h"], r["text"] or "")) if r["text"]])


def find_all(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``; the counts are of base spans."""
    weights = weights or train_on(docs)

    def row(text: str | None) -> tuple:
        base, added = find(text, weights)
        kinds = [k for _, k, _ in base]
        return (*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = list(zip(*map(row, b.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
