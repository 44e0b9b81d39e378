"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens: its words (A-Z lower-cased) and one end.  Every token is
coded bit by bit and each bit is predicted by context mixing: hashed contexts look up
counts of zeros and ones, the predictions are combined in the logistic domain by weights
that gates select, and the mix is refined by an adaptive probability map.

Words of the head (at least ``least`` training occurrences, ``HEAD`` words at most) have a
code: a Huffman code of their group of languages, then of the word, or of a range of counts
whose words share the rest by their counts.  All other words have the code of the language
that their last three bytes speak for, then their own share: that of known words by count,
or a spelling.  The contexts of a code's bits are none, the languages that the earlier words
of the text speak for, the word before, the two words before, and the word before the last
with the languages, so they reach over words; their counts are of occurrences.  A spelling's
bits have the contexts of that language with 1, 2, 3 and 4 earlier bytes, and of 6 earlier
bytes; they learn from every distinct training word.

Learning is online: each shard of the training texts is gone through once; a step of tokens
is predicted from what has been counted so far, weights move along the error's gradient
(AdaGrad), and the step's bits are added to the counts.  Counts and maps of all shards are
summed, weights averaged by the bits that they have seen, in rounds of ``TREE`` partial sums.
A text's shard and its place there follow from a hash of its id and text, and the number of
shards from the number of tokens, so that scores are the same however the input is
partitioned; the number grows with the root of the input, as each shard hands on a table.  To
learn what a rare word looks like, a training word's own occurrence is left out: words that
occur once are learned as new ones.  Scoring holds the sums fixed, so that it doesn't depend
on the order of texts.

Tables have a slot for about every two training tokens and bit context, 2 ** ``MOST_BITS``
an order at most (a fixed bound on what is broadcast); contexts share slots without check.
Counts of all words are exact and joined, whatever their number.

Defined cases: a null text is an empty one and holds only the end; equal rows get equal
scores and each comes back; extra columns are ignored; a null ``lang`` counts as an empty
one, and languages beyond the ``LANGS`` - 1 commonest share one; without any training
row counts are 0 and all codes are alike; an empty table gives no rows.  Texts and words
of any length are scored whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import fold, materialize, release

FOLDS, HELD = 5, 1
#: Words of the head at most, those with a code of their own, languages told apart, slots of word endings.
HEAD, SINGLES, LANGS, SUFFIXES = 262_144, 2048, 16, 4096
#: Least training occurrences and most bytes of a word of the head.
LEAST, LONGEST = 3, 64
LEAST_BITS, MOST_BITS = 16, 21
#: Tokens of a step, at first and at most; bytes of words spelled at once.
FIRST_STEP, STEP, SPELL = 256, 8192, 24_000
#: Entries that a task counts before it hands them on; slots of a piece of a table; partial sums added at once.
FLUSH, PIECE, TREE = 400_000, 1 << 15, 32
SUPPORT, BUCKETS, RATE, LOGIT = 5, 33, 0.06, np.float32(10)
#: There are as many shards as the root of the tokens (words, for spellings) over these.
SHARD_TOKENS, SHARD_WORDS = 150_000, 50_000
#: Scores travel as whole millionths of a decimal digit and base terms as billionths, so that sums don't depend on their order.
UNIT, FINE = 1_000_000, 1_000_000_000
#: Weights are summed as whole numbers too.
GRAIN = 1 << 24
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ORDERS = (1, 2, 3, 4, 6)
LUT = np.minimum(np.ceil(np.log2(np.arange(17) + 1)), SUPPORT - 1).astype(np.int8)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def suffix(word: bytes) -> int:
    """A number below ``SUFFIXES`` from the word's last three bytes."""
    b = (b"   " + word)[-3:]
    return (b[0] * 961 + b[1] * 31 + b[2]) % SUFFIXES


def stirred(x: np.ndarray) -> np.ndarray:
    """A hash of numbers, once for each context."""
    x = (x ^ (x >> np.uint64(31))) * A
    return (x ^ (x >> np.uint64(29))) * B


def slots_of(contexts: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """Slots below 2 ** bits of stirred contexts and multiplied nodes."""
    x = contexts ^ nodes
    x *= A
    x >>= np.uint64(64 - bits)
    return x.view(np.int64)


# ---------------------------------------------------------------------------
# The mixer: the same for codes and for spellings.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Slots of each input in one table (offsets), the two inputs whose support is the first gate, and values of the second gate."""

    offsets: tuple[int, ...]
    watched: tuple[int, int]
    sides: int

    @property
    def inputs(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> tuple[int, int, int]:
        return SUPPORT * SUPPORT * self.inputs, self.sides * self.inputs, self.sides * BUCKETS


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def support_of(n: np.ndarray) -> np.ndarray:
    return LUT.take(np.minimum(n, 16).astype(np.int8))


def crossed(w: list[np.ndarray]) -> np.ndarray:
    """The sums of both gates' weights by input and pair of gates (the first's value times sides, plus the second's), so that a bit looks up one number an input."""
    return (w[0].astype(np.float32)[:, :, None] + w[1].astype(np.float32)[:, None, :]).reshape(len(w[0]), -1)


def cell_of(z: np.ndarray, side: np.ndarray) -> np.ndarray:
    return side * BUCKETS + np.rint((z + 11) * np.float32((BUCKETS - 1) / 22)).astype(np.int64)


class Learner:
    """A mixer that learns online: counts, gated weights and the adaptive map."""

    def __init__(self, layout: Layout):
        self.layout, k = layout, layout.inputs
        self.counts = np.zeros(2 * layout.offsets[-1], np.float32)  # of zeros and ones, side by side
        self.w = [np.full((k, SUPPORT * SUPPORT), 0.3), np.zeros((k, layout.sides))]
        self.sq = [np.full(w.shape, 1.0) for w in self.w]
        self.map = [np.zeros(layout.sides * BUCKETS), np.zeros(layout.sides * BUCKETS)]  # ones, all
        self.seen = 0

    def predict(self, slots: list[np.ndarray], side: np.ndarray) -> tuple:
        """Inputs, pairs of gates and the mixed logit of each bit."""
        pairs = self.counts.view(np.uint64)
        x, seen = [], {}
        for m, s in enumerate(slots):
            c = pairs.take(s).view(np.float32).reshape(-1, 2)
            if m in self.layout.watched:
                seen[m] = support_of(c[:, 0] + c[:, 1])
            c += np.float32(0.4)
            v = c[:, 1] / c[:, 0]
            x.append(np.log(v, out=v))
        i, j = self.layout.watched
        gates = (seen[i] * np.int8(SUPPORT) + seen[j]) * np.int64(self.layout.sides) + side
        z = np.zeros(len(side), np.float32)
        for v, w in zip(x, crossed(self.w), strict=True):
            z += v * w.take(gates)
        return x, gates, np.clip(z, -11, 11, out=z)

    def learn(self, bit: np.ndarray, slots: list[np.ndarray], side: np.ndarray) -> np.ndarray:
        """Predict the bits, move the weights, count; the probabilities of a one before the map."""
        p = self.move(bit, slots, side)
        one = np.float32(1)
        for s in slots:
            np.add.at(self.counts, (s << 1) + bit, one)
        self.seen += len(bit)
        return p

    def move(self, bit: np.ndarray, slots: list[np.ndarray], side: np.ndarray) -> np.ndarray:
        x, gates, z = self.predict(slots, side)
        p = squash(z)
        err = bit.astype(np.float32) - p
        for m, v in enumerate(x):
            pull = np.bincount(gates, err * v, self.w[0].shape[1] * self.layout.sides).reshape(-1, self.layout.sides)
            for w, sq, grad in zip(self.w, self.sq, (pull.sum(1), pull.sum(0)), strict=True):
                sq[m] += grad * grad
                w[m] += RATE * grad / np.sqrt(sq[m])
        cell = cell_of(z, side)
        found = np.bincount(2 * cell + bit, minlength=2 * len(self.map[0])).reshape(-1, 2)
        self.map[0] += found[:, 1]
        self.map[1] += found.sum(1)
        return p

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """What has been learned, in pieces of whole numbers that can be added up."""
        if not self.seen:
            return
        for k in range(0, len(self.counts), 2 * PIECE):
            part = self.counts[k : k + 2 * PIECE]
            if part.any():
                yield k // (2 * PIECE), packed(part.astype(np.int64))
        yield -1, self.tail().tobytes()

    def tail(self) -> np.ndarray:
        """Weights times bits seen, the map and the bits seen, as whole numbers."""
        return np.concatenate([*(np.rint(w.ravel() * (GRAIN * float(self.seen))).astype(np.int64) for w in self.w), *(m.astype(np.int64) for m in self.map), [self.seen]])


class Mixer:
    """A mixer whose sums are fixed: logits and support by slot, weights, map."""

    def __init__(self, layout: Layout, counts: np.ndarray, tail: np.ndarray | None):
        self.layout, k = layout, layout.inputs
        n0, n1 = counts[0::2], counts[1::2]
        # In steps of 1 / 10 in a byte each, as every worker holds a copy.
        self.logit = np.clip(np.rint(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))) * LOGIT), -127, 127).astype(np.int8)
        self.support = support_of(n0 + n1)
        tail = Learner(Layout(layout.offsets[:1] * (k + 1), layout.watched, layout.sides)).tail() if tail is None else tail
        a, b, c = np.cumsum(layout.sizes)
        w = (tail[:b] / (GRAIN * float(max(1, tail[-1])))).astype(np.float32) if tail[-1] else np.concatenate((np.full(a, 0.3, np.float32), np.zeros(b - a, np.float32)))
        w /= LOGIT
        self.w = [w[:a].reshape(k, -1), w[a:].reshape(k, -1)]
        self.crossed = crossed(self.w)
        ones, all_ = tail[b:c], tail[c : 2 * c - b]
        middle = squash(np.tile(np.arange(BUCKETS), layout.sides) * (22 / (BUCKETS - 1)) - 11)
        self.correction = (0.5 * ((ones + 20 * middle) / (all_ + 20) - middle)).astype(np.float32)

    def cost(self, bit: np.ndarray, slots: list[np.ndarray], side: np.ndarray) -> np.ndarray:
        """Minus log10 of each bit's probability."""
        i, j = self.layout.watched
        gates = (self.support.take(slots[i]) * np.int8(SUPPORT) + self.support.take(slots[j])) * np.int64(self.layout.sides) + side
        z = np.zeros(len(bit), np.float32)
        for s, w in zip(slots, self.crossed, strict=True):
            z += self.logit.take(s) * w.take(gates)
        np.clip(z, -11, 11, out=z)
        p = squash(z)
        p += self.correction[cell_of(z, side)]
        np.clip(p, 1e-5, 1 - 1e-5, out=p)
        p = np.abs(p - (1 - bit).astype(np.float32))
        return np.log(p, out=p) * np.float32(-1 / math.log(10))


def packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, larger ones beside them: how many, their places, their values."""
    large = np.flatnonzero(counts >= 255)
    return b"".join((np.int64(len(large)).tobytes(), large.astype(np.int64).tobytes(), counts[large].astype(np.int64).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes()))


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    large = np.frombuffer(data, np.int64, 2 * n, 8)
    out = np.frombuffer(data, np.uint8, offset=8 + 16 * n).astype(np.int64)
    out[large[:n]] = large[n:]
    return out


def add_pieces(parts: DataFrame, tasks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sums by piece of ``parts(task, piece, data)``, added in rounds so that no group holds more than ``TREE`` partial sums."""

    def add(pdf):
        read = unpacked if pdf["piece"].iloc[0] >= 0 else lambda x: np.frombuffer(x, np.int64)
        total = read(pdf["data"].iloc[0]).copy()
        for x in pdf["data"].iloc[1:]:
            total += read(x)
        return pdf.iloc[:1].assign(data=[packed(total) if read is unpacked else total.tobytes()])

    while True:
        tasks = -(-tasks // TREE)
        parts = parts.withColumn("task", F.pmod("task", F.lit(tasks))).groupBy("task", "piece").applyInPandas(add, "task int, piece int, data binary")
        if tasks == 1:
            break
    for r in parts.toLocalIterator():
        yield r["piece"], unpacked(r["data"]) if r["piece"] >= 0 else np.frombuffer(r["data"], np.int64)


def sharded(rows: DataFrame, what: str, by: list[str], shards: int) -> DataFrame:
    """``(what, shard)``: rows dealt to shards by a hash of ``by``, each shard in one partition and in the order of that hash."""
    spark = rows.sparkSession
    # For each shard a number that Spark deals to a partition of its own.
    dealt = spark.range(32 * shards).select(F.pmod(F.hash("id"), F.lit(shards)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id"))
    keys = {r["p"]: r["id"] for r in dealt.collect()}
    numbers = F.array(*[F.lit(keys.get(i, i)).cast("long") for i in range(shards)])
    h = F.xxhash64(*by)
    r = rows.select(what, h.alias("h")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")).withColumn("key", F.get(numbers, F.col("shard")))
    return r.repartition(shards, "key").sortWithinPartitions("shard", "h").select(what, "shard")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        shard = b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield int(shard[x]), b.slice(x, y - x)


def learned(rows: DataFrame, shards: int, layout: Layout, feed: Callable[[Learner, Iterator[pa.RecordBatch]], None]) -> Mixer:
    """The mixer that all shards of ``rows(what, shard)`` learn together, each from the beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in groupby(by_shard(batches), key=lambda x: x[0]):
            learner = Learner(layout)
            feed(learner, (b for _, b in parts))
            for piece, data in learner.pieces():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())], names=["task", "piece", "data"])
            del learner
        release()

    counts, tail = np.zeros(2 * layout.offsets[-1], np.float32), None
    for piece, data in add_pieces(rows.mapInArrow(run, "task int, piece int, data binary"), shards):
        if piece < 0:
            tail = data
        else:
            counts[2 * PIECE * piece : 2 * PIECE * piece + len(data)] = data
    return Mixer(layout, counts, tail)


# ---------------------------------------------------------------------------
# Codes
# ---------------------------------------------------------------------------


def huffman(weights: list[int], first: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Each item's path of (node, bit) from the root, nodes numbered from ``first``; the next free number."""
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    n = len(weights)
    while len(heap) > 1:
        (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[n] = (a, b)
        heapq.heappush(heap, (wa + wb, n, n))
        n += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    todo = [(heap[0][2], [])] if heap else []
    while todo:
        at, path = todo.pop()
        if at < len(weights):
            paths[at] = path
        else:
            for bit, child in enumerate(children[at]):
                todo.append((child, [*path, (first + at - len(weights), bit)]))
    return paths, first + max(0, len(weights) - 1)


class Codes:
    """The codes of symbols laid end to end: a code of the group, then one within it."""

    def __init__(self, weights: np.ndarray, group: np.ndarray):
        kinds = sorted(set(group.tolist()))
        outer, free = huffman([int(weights[group == g].sum()) for g in kinds], 0)
        paths: list = [None] * len(weights)
        for path, g in zip(outer, kinds, strict=True):
            members = np.flatnonzero(group == g).tolist()
            inner, free = huffman([int(weights[i]) for i in members], free)
            for i, p in zip(members, inner, strict=True):
                paths[i] = path + p
        self.nodes = max(1, free)
        self.size = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.node = np.array([n for p in paths for n, _ in p], np.int64)
        self.bit = np.array([b for p in paths for _, b in p], np.int64)

    def unroll(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of the symbols' codes: the symbol's place, the node, the bit, its index in the code."""
        size = self.size[symbols]
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(symbols)), size)
        depth = np.arange(ends[-1] if len(size) else 0) - (ends - size).take(owner)
        at = self.start[symbols].take(owner) + depth
        return owner, self.node.take(at), self.bit.take(at), depth


@dataclass
class Head:
    """The head: words, their symbols when they are scored and learned, their share within the symbol, what they tell of the language."""

    words: list[bytes]
    count: np.ndarray
    symbol: np.ndarray
    learned: np.ndarray
    within: np.ndarray
    speaks: np.ndarray
    guess: list[int]  # language by suffix
    codes: Codes
    bits: int

    @property
    def langs(self) -> int:
        return self.speaks.shape[1]

    @property
    def layout(self) -> Layout:
        n, size = self.codes.nodes, 1 << self.bits
        return Layout(tuple(np.cumsum([0, n, 4 * self.langs * n, size, size, size]).tolist()), (2, 3), 4 * 8)


def build_head(words: list[bytes], counts: np.ndarray, ends: int, rare: np.ndarray, guess: list[int], least: int, train: int) -> Head:
    """``counts``: occurrences by word and language, commonest words first; ``ends``: training texts; ``rare``: occurrences of other words by guessed language."""
    n, langs = counts.shape
    c = counts.sum(1)
    first = 1 + langs
    total = counts.sum(0) + 1.0
    share = counts / total
    home = np.where(share.max(1) >= 0.8 * share.sum(1), share.argmax(1) + 1, 0) if n else np.zeros(0, np.int64)
    # Symbols: the end, other words by language, single words, ranges of counts by group.
    ranged = [(int(h), int(x).bit_length()) for h, x in zip(home[SINGLES:], c[SINGLES:], strict=True)]
    at = {key: first + min(n, SINGLES) + i for i, key in enumerate(sorted(set(ranged)))}
    symbol = np.array([first + i for i in range(min(n, SINGLES))] + [at[key] for key in ranged], np.int64)
    seen_as = np.where(c == least, np.array([1 + guess[suffix(w)] for w in words], np.int64), symbol)
    size = first + min(n, SINGLES) + len(at)
    weights, group, mass = np.ones(size, np.int64), np.full(size, -1, np.int64), np.zeros(size)
    weights[0] += ends
    weights[1:first] += rare
    np.add.at(weights, seen_as, c)
    group[1:first] = np.arange(1, first)
    group[symbol] = home
    np.add.at(mass, symbol, c.astype(float))
    # Log of a word's share in a language, against the mean over languages; whole numbers, so that sums are exact.
    logs = np.log((counts + 0.3) / (total + 0.3 * max(1, n)))
    speaks = np.rint((logs - logs.mean(1, keepdims=True)) * 1024).astype(np.int64)
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * train).bit_length()))
    return Head(words, c, symbol, seen_as, np.log10(c / mass[symbol]), speaks, guess, Codes(weights, group), bits)


class Reader:
    """Turns texts into symbols and contexts, in runs of tokens that may begin or end within a text."""

    def __init__(self, head: Head):
        self.head = head
        self.index = {w: i for i, w in enumerate(head.words)}
        self.offsets = head.layout.offsets
        # By language, with a last word that tells nothing.
        self.speaks = np.ascontiguousarray(np.concatenate((head.speaks, np.zeros((1, head.langs), np.int64))).T)

    def look_up(self, words: list[bytes | None], ends: list[int]) -> np.ndarray:
        """Each word's index in the head, -1 - its guessed language, or ``END`` for ends."""
        get, guess = self.index.get, self.head.guess
        found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        found[ends] = END
        rare = np.flatnonzero(found == -1)
        found[rare] = [-1 - guess[suffix(words[i])] for i in rare.tolist()]
        return found

    def contexts(self, found: np.ndarray, starts: np.ndarray, carry: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Ids of the word before and of the one before that, the state of languages, and what the next run needs.

        ``starts`` are the texts' first places; ``carry`` is that of a text which began in an
        earlier run, at place 0.  Ids: 0 none, then languages of other words, then the head.
        """
        n = len(found)
        ids = np.where(found >= 0, found + 1 + self.head.langs, np.where(found == END, 0, -found))
        heads = np.zeros(n, bool)
        heads[starts] = True
        one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[heads] = 0
        two[heads] = 0
        two[1:][heads[:-1]] = 0
        text = np.cumsum(heads)
        carried = np.zeros(self.head.langs, np.int64)
        if carry is not None and not heads[0]:
            one[0], two[0] = carry[:2]
            if n > 1 and not heads[1]:
                two[1] = carry[0]
            carried = carry[2]
        # Language by language: the best so far, the second and which one the best is.
        word = np.where(found >= 0, found, len(self.head.words))
        base, after = np.zeros(int(text[-1]) + 1, np.int64), np.zeros(self.head.langs, np.int64)
        best = second = which = None
        for k, speaks in enumerate(self.speaks):
            told = speaks.take(word)
            before = np.cumsum(told)
            before -= told
            base[text[starts]] = before[starts]
            base[0] = -carried[k]
            before -= base.take(text)
            after[k] = before[-1] + told[-1]
            if k == 0:
                best, second, which = before, np.full(n, NEVER), np.zeros(n, np.int64)
            else:
                np.maximum(second, np.minimum(best, before), out=second)
                which[before > best] = k
                best = np.maximum(best, before)
        margin = best - second if self.head.langs > 1 else np.zeros(n)
        sure = (margin > 700).astype(np.int64) + (margin > 2500) + (margin > 6000)
        return one, two, which * 4 + sure, (ids[-1], one[-1], after)

    def slots(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Owner, bit, slots by input and second gate of each bit of the symbols' codes."""
        owner, node, bit, depth = self.head.codes.unroll(symbols)
        o, n = self.offsets, self.head.codes.nodes
        a, b, s = one.astype(np.uint64), two.astype(np.uint64), state.astype(np.uint64)
        spread = node.astype(np.uint64) * B
        slots = [node, (o[1] + state * n).take(owner) + node]
        for i, key in enumerate((a * A + np.uint64(1), (a * A + b) * A + np.uint64(2), (b * A + s) * A + np.uint64(3))):
            slots.append(slots_of(stirred(key).take(owner), spread, self.head.bits))
            slots[-1] += o[2 + i]
        return owner, bit, slots, (state % 4 * 8).take(owner) + np.minimum(depth, 7)


END, NEVER = -1_000_000, -(1 << 62)


def symbols_of(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of looked-up words: the end is 0, other words have 1 + their guessed language."""
    out = np.where(found == END, 0, -found)
    known = found >= 0
    out[known] = table[found[known]]
    return out


def runs(texts: Iterator[tuple[object, list[bytes]]], most: int = 4 * STEP) -> Iterator[tuple]:
    """Texts in runs of about ``most`` tokens: (rows, their places in the run, words with None for ends, places of ends, places where a text begins).

    A text longer than a run goes on in the next one, which then has a place 0 where no text begins.
    """
    rows, places, words, ends, starts = [], [], [], [], []
    for row, ws in texts:
        rows.append(row)
        places.append(len(words))
        starts.append(len(words))
        at = 0
        while len(ws) - at > (room := max(1, most - len(words))):
            words += ws[at : at + room]
            at += room
            yield rows, places, words, ends, starts
            rows, places, words, ends, starts = [row], [0], [], [], []
        words += ws[at:] if at else ws
        ends.append(len(words))
        words.append(None)
        if len(words) >= most:
            yield rows, places, words, ends, starts
            rows, places, words, ends, starts = [], [], [], [], []
    if words:
        yield rows, places, words, ends, starts


def prepared(reader: Reader, texts: Iterator[tuple[object, list[bytes]]]) -> Iterator[tuple]:
    """(rows, places, words, found, one, two, state) of each run."""
    carry = None
    for rows, places, words, ends, starts in runs(texts):
        found = reader.look_up(words, ends)
        one, two, state, carry = reader.contexts(found, np.array(starts, np.int64), carry)
        yield rows, places, words, found, one, two, state


def learn_codes(learner: Learner, reader: Reader, texts: Iterator[list[bytes]]) -> None:
    """Go through the texts once, in steps that grow from ``FIRST_STEP`` to ``STEP`` tokens."""
    for _, _, _, found, one, two, state in prepared(reader, ((None, ws) for ws in texts)):
        symbols, at = symbols_of(found, reader.head.learned), 0
        while at < len(symbols):
            step = min(STEP, FIRST_STEP + learner.seen // 128)
            part = slice(at, at + step)
            _, bit, slots, side = reader.slots(symbols[part], one[part], two[part], state[part])
            learner.learn(bit, slots, side)
            at += step


def code_costs(mixer: Mixer, reader: Reader, found: np.ndarray, one: np.ndarray, two: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Minus log10 of each token's code, and of its share within its symbol."""
    symbols, out = symbols_of(found, reader.head.symbol), []
    for at in range(0, len(symbols), STEP):
        part = slice(at, at + STEP)
        owner, bit, slots, side = reader.slots(symbols[part], one[part], two[part], state[part])
        out.append(np.bincount(owner, mixer.cost(bit, slots, side), len(symbols[part])))
    cost = np.concatenate(out) if out else np.zeros(0)
    known = found >= 0
    cost[known] -= reader.head.within[found[known]]
    return cost


# ---------------------------------------------------------------------------
# Spellings
# ---------------------------------------------------------------------------


def spell_layout(types: int) -> Layout:
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * types).bit_length()))
    return Layout(tuple((np.arange(len(ORDERS) + 1) << bits).tolist()), (1, 2), 8 * 8)


def spell_steps(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The words in runs of about ``most`` bytes."""
    run, size = [], 0
    for w in words:
        run.append(w)
        size += len(w) + 1
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def spell_bits(words: list[bytes], layout: Layout, guess: list[int]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Bit plane by bit plane of the words, each closed by a space: bits, slots by input, second gate; last the words' ends."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    byte = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    n = len(byte)
    place = np.arange(n) - np.repeat(ends - sizes, sizes)
    past = np.zeros(n, np.uint64)
    for back in range(max(ORDERS), 0, -1):
        shifted = np.zeros(n, np.uint64)
        shifted[back:] = byte[:-back]
        past |= np.where(place >= back, shifted, 0).astype(np.uint64) << np.uint64(8 * (back - 1))
    kin = np.repeat(np.fromiter((guess[suffix(w)] for w in words), np.uint64, len(words)), sizes)
    keys = [stirred((((past & np.uint64((1 << 8 * k) - 1)) << np.uint64(8)) | (kin if k <= 4 else np.uint64(255))) * A + np.uint64(k)) for k in ORDERS]
    bits = (layout.offsets[1] - layout.offsets[0]).bit_length() - 1
    value = byte.astype(np.int64)
    for j in range(7, -1, -1):
        spread = ((256 | value) >> (j + 1)).astype(np.uint64) * B
        yield (value >> j) & 1, [layout.offsets[i] + slots_of(k, spread, bits) for i, k in enumerate(keys)], np.minimum(place, 7) * 8 + j, ends


def learn_spelling(learner: Learner, words: list[bytes], guess: list[int]) -> None:
    """Go through the words once, in steps that grow to ``SPELL`` bytes."""
    at = 0
    while at < len(words):
        step = min(SPELL, 600 + learner.seen // 64)
        some = next(spell_steps(words[at : at + step], step))
        for bit, slots, side, _ in spell_bits(some, learner.layout, guess):
            learner.learn(bit, slots, side)
        at += len(some)


def spell_costs(mixer: Mixer, words: list[bytes], guess: list[int]) -> np.ndarray:
    """Minus log10 of the words' spellings."""
    out = [np.zeros(0)]
    for some in spell_steps(words, SPELL):
        total = 0
        for bit, slots, side, ends in spell_bits(some, mixer.layout, guess):
            total = total + mixer.cost(bit, slots, side).astype(float)
        out.append(np.diff(np.concatenate(([0.0], np.cumsum(total)[ends - 1]))))
    return np.concatenate(out)


# ---------------------------------------------------------------------------
# The corpus
# ---------------------------------------------------------------------------


def vocabulary(docs: DataFrame, langs: int) -> DataFrame:
    """``(word, suffix, c0.., c)``: every word's training counts by language and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, c in sorted(counts.items()):
                words = list(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), pa.array(list(map(suffix, words)), pa.int32()), pa.array(np.full(len(c), k, np.int32)), pa.array(list(c.values()), pa.int64())],
                    names=["word", "suffix", "k", "n"],
                )
            counts.clear()

        for b in batches:
            for text, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(k, Counter()).update(tokens(text))
                if sum(map(len, counts.values())) > FLUSH:
                    yield from flush()
        yield from flush()

    # -1: in texts that aren't learned from.
    rows = docs.select("text", F.when(F.col("train"), F.col("k")).otherwise(-1).alias("k")).mapInArrow(run, "word binary, suffix int, k int, n long")
    sums = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(langs)]
    return rows.groupBy("word", "suffix").agg(*sums).withColumn("c", sum((F.col(f"c{k}") for k in range(1, langs)), F.col("c0")))


@dataclass(frozen=True)
class Rare:
    """Prices of words outside the head: by guessed language the share of new words, and known words' discounted mass."""

    new: np.ndarray
    mass: np.ndarray
    discount: float

    def price(self, kin: np.ndarray, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Minus log10 of the words, given that they are outside the head."""
        known = (1 - self.new[kin]) * np.maximum(c - self.discount, 0) / np.maximum(self.mass[kin], 1e-9)
        # In logarithms, as a long word's spelling can be below the least double.
        with np.errstate(divide="ignore"):
            a, b = np.log10(np.where(c > 0, known, 0)), np.log10(self.new[kin]) - spelled
        top = np.maximum(a, b)
        return -(top + np.log10(10 ** (a - top) + 10 ** (b - top)))


def threshold(vocab: DataFrame) -> int:
    """The least count of a word of the head, so that at most about ``HEAD`` words are in it."""
    if vocab.where(F.col("c") >= LEAST).count() <= HEAD:
        return LEAST
    steps = vocab.where(F.col("c") >= LEAST).groupBy(F.floor(F.log2("c") * 8).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    kept, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["b"]):
        kept += r["n"]
        if kept > HEAD:
            break
        least = math.ceil(2 ** (r["b"] / 8))
    return least


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for each row."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    tagged = docs.select("doc_id", "text", lang.alias("lang"), F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD, F.lit(True)).alias("train"))
    sizes = tagged.where("train").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    ends = tagged.where("train").count() if len(sizes) == LANGS else sum(r["n"] for r in sizes)
    names = [r["lang"] for r in sizes[: LANGS - 1]]
    tagged = tagged.withColumn("k", F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(names)], F.lit(len(names)))).drop("lang")
    langs = len(names) + (len(names) < len(sizes) or not names)
    cs = [f"c{k}" for k in range(langs)]

    vocab = materialize(vocabulary(tagged, langs), "vocabulary")
    least = threshold(vocab)
    in_head = (F.col("c") >= least) & (F.length("word") <= LONGEST)
    outside = ~in_head & (F.col("c") > 0)
    one = lambda cond, what=F.lit(1): F.sum(F.when(cond, what).otherwise(F.lit(0)))
    by_suffix = vocab.groupBy("suffix").agg(
        *[one(F.col(c) > 0).alias(f"t{c}") for c in cs],
        F.sum("c").alias("c"), one(F.col("c") > 0).alias("types"), one(outside, F.col("c")).alias("rare"), one(outside & (F.col("c") > 0)).alias("rare_types"),
        one(F.col("c") == 1).alias("n1"), one(F.col("c") == 2).alias("n2"), one(in_head & (F.col("c") == least), F.col("c")).alias("edge"),
    ).collect()
    by_suffix.sort(key=lambda r: r["suffix"])
    types, total = sum(r["types"] for r in by_suffix), sum(r["c"] for r in by_suffix) + ends
    distinct = types + (ends > 0)
    spoken = np.array([[r[f"t{c}"] for c in cs] for r in by_suffix], float).reshape(-1, langs)
    best = (spoken / (spoken.sum(0) + 1)).argmax(1) if len(spoken) else []
    guess = [0] * SUFFIXES
    for r, k in zip(by_suffix, best, strict=True):
        guess[r["suffix"]] = int(k)
    by_kin = lambda name: np.bincount([guess[r["suffix"]] for r in by_suffix], [r[name] for r in by_suffix], langs) if by_suffix else np.zeros(langs)
    n1, n2, rare, edge = (by_kin(x) for x in ("n1", "n2", "rare", "edge"))
    discount = float(n1.sum() / (n1.sum() + 2 * n2.sum())) if n1.sum() and n2.sum() else 0.5
    # A training word's own occurrence is left out: one that occurs once is new, one at the head's edge is outside.
    mass = rare - discount * by_kin("rare_types")
    prices = Rare(np.where(mass > 0, (n1 + 1) / (rare + edge + 2), 1.0), mass, discount)

    rows = vocab.where(in_head).orderBy(F.desc("c"), "word").select("word", *cs).toArrow()
    counts = np.column_stack([rows.column(c).to_numpy() for c in cs]).astype(np.int64).reshape(-1, langs)
    head = build_head(rows.column("word").to_pylist(), counts, ends, (rare + edge).astype(np.int64), guess, least, total)
    shared = spark.sparkContext.broadcast(head)

    def feed_texts(learner: Learner, batches: Iterator[pa.RecordBatch]) -> None:
        learn_codes(learner, Reader(shared.value), (tokens(t) for b in batches for t in b.column(0).to_pylist()))

    def feed_words(learner: Learner, batches: Iterator[pa.RecordBatch]) -> None:
        for some in batched((w for b in batches for w in b.column(0).to_pylist()), 10_000):
            learn_spelling(learner, list(some), guess)

    shards = lambda n, each: max(1, math.isqrt(n // each))
    n = shards(total, SHARD_TOKENS)
    codes = spark.sparkContext.broadcast(learned(sharded(tagged.where("train"), "text", ["doc_id", "text"], n), n, head.layout, feed_texts))
    n = shards(types, SHARD_WORDS)
    speller = spark.sparkContext.broadcast(learned(sharded(vocab.where("c > 0"), "word", ["word"], n), n, spell_layout(types), feed_words))

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy().astype(float)
            kin = np.array([guess[suffix(w)] for w in words], np.int64)
            cost = np.rint(prices.price(kin, c, spell_costs(speller.value, words, guess)) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cost)], names=["word", "c", "price"])

    rarer = materialize(vocab.where(~in_head).select("word", "c").mapInArrow(priced, "word binary, c long, price long"), "words")
    # Written once: the two branches below would score all texts twice.
    both = materialize(tagged.select("doc_id", "text").mapInArrow(lambda batches: scored(batches, shared.value, codes.value, ends), SUMS), "tokens")
    common = both.where("word is null").drop("word")
    own = both.where("word is not null").groupBy("doc_id", "digest", "word").agg(F.sum("n").alias("times"))
    fine = F.rint(F.log10(F.col("c") + 0.5) * FINE).cast("long")
    found = (
        own.join(rarer, "word")
        .groupBy("doc_id", "digest")
        .agg(F.sum("times").alias("rn"), F.sum(F.col("times") * (F.col("c") > 0).cast("long")).alias("rknown"), F.sum(F.col("times") * fine).alias("rfine"), F.sum(F.col("times") * F.col("price")).alias("rcost"))
    )
    a, b = common.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    # Equal rows have added up; each takes its part.
    whole = lambda x: F.col(x) + F.coalesce(F.col(f"r{x}") * F.col("n_rare") / F.col("rn"), F.lit(0.0))
    n_tokens = whole("n").cast("long")
    s = -whole("cost") / UNIT
    return joined.select(
        F.col("a.doc_id").alias("doc_id"),
        F.coalesce(fold(F.col("a.doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        n_tokens.alias("n_tokens"),
        whole("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (whole("fine") / FINE - n_tokens * F.lit(math.log10(total + 0.5 * (distinct + 1)))).alias("base_score"),
        s.alias("score"),
        F.when(F.col("n_bytes") > 0, -s / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


SUMS = "doc_id long, digest long, word binary, n_bytes long, n_rare long, n long, known long, fine long, cost long"


def scored(batches: Iterator[pa.RecordBatch], head: Head, mixer: Mixer, ends: int) -> Iterator[pa.RecordBatch]:
    """Per document one row with the sums of its tokens in the head and of all codes (word null), and one for each distinct other word."""
    import xxhash

    reader = Reader(head)
    # By index in the head, then the end, then other words: known, base term.
    known = np.concatenate((np.ones(len(head.words), np.int64), [int(ends > 0), 0]))
    fine = np.rint(np.log10(np.concatenate((head.count, [ends, 0])) + 0.5) * FINE).astype(np.int64)
    fine[-1] = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 300):
            part = batch.slice(at, 300)
            texts, size = part.column(1).to_pylist(), part.num_rows
            raws = [(t or "").encode("utf-8", "replace") for t in texts]
            sums = np.zeros((4, size), np.int64)  # tokens in the head and ends, known, base terms, costs
            rare: list[Counter] = [Counter() for _ in range(size)]
            for rows, places, words, found, one, two, state in prepared(reader, ((i, raw.lower().split()) for i, raw in enumerate(raws))):
                cost = np.rint(code_costs(mixer, reader, found, one, two, state) * UNIT).astype(np.int64)
                other = (found < 0) & (found != END)
                index = np.where(found >= 0, found, np.where(other, -1, -2))
                for j, x in enumerate(((~other).astype(np.int64), known[index], fine[index], cost)):
                    np.add.at(sums[j], rows, np.add.reduceat(x, places))
                owner = np.searchsorted(places, np.flatnonzero(other), side="right") - 1
                for i, w in zip(owner.tolist(), np.flatnonzero(other).tolist(), strict=True):
                    rare[rows[i]][words[w]] += 1
            digest = [xxhash.xxh64_intdigest(raw, 1 if t is None else 0) - (1 << 63) for raw, t in zip(raws, texts, strict=True)]
            zero = lambda n: pa.array(np.zeros(n, np.int64))
            names = ["doc_id", "digest", "word", "n_bytes", "n_rare", "n", "known", "fine", "cost"]
            lead = [pa.array(digest, pa.int64()), pa.nulls(size, pa.binary()), pa.array([len(r) for r in raws], pa.int64()), pa.array([sum(c.values()) for c in rare], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *lead, *map(pa.array, sums)], names=names)
            n = [len(c) for c in rare]
            if sum(n):
                rows_of = pa.array(np.repeat(np.arange(size), n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows_of), lead[0].take(rows_of), pa.array([w for c in rare for w in c], pa.binary()), zero(sum(n)), zero(sum(n)), pa.array([x for c in rare for x in c.values()], pa.int64()), *[zero(sum(n))] * 3],
                    names=names,
                )
