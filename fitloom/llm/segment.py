"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces (and
byte fallback for characters that have none); a path's probability is proportional to the
product of its pieces' weights, (1 + rank) ** -alpha for the merge rank of a BPE model.
Give every path an independent Gumbel perturbation of its log probability: the k largest
are a sample without replacement.  They are found by A* search: a search node is a path's
beginning with the next piece limited to some of the edges there, its bound the maximum
perturbed value below it, drawn top-down.  Completing the best node draws its best path at
once (each free piece by its conditional probability), and every step leaves behind the
node of the other edges, whose maximum is a Gumbel truncated at the path's value.  Only the
best of those that can still be popped are kept.  The (k+1)-th value is the threshold from
which each path's inclusion score 1 - exp(-exp(log p - threshold)) follows.

Pieces never span a word's border (checked when the model is read), so lattices are built
once for each distinct word of a chunk of texts and all texts of a chunk advance together;
a worker keeps the solved lattices of words that come again, up to a fixed size.  A chunk
holds about ``CHUNK`` characters, or one text if that is longer.
Random numbers are a hash of the row key, the sample and the place, so results don't
depend on chunks or partitions.

Defined cases: null and empty texts have one empty segmentation (log probability 0,
inclusion 1) and no second; a text with fewer than k segmentations gives all of them, each
with inclusion 1; a lone surrogate becomes "?"; U+2581 in a text is decoded as a space, as
the library does (``decoded`` tells); repeated rows get the same samples; a null id counts
as 0; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fitloom.llm.common import release

SPACE = "▁"
#: Characters of texts that are worked on together.
CHUNK = 300_000
#: Nodes and length of words that a worker's memo keeps at most; words that it remembers having met once.
KEPT, LONGEST, SEEN = 300_000, 64, 300_000
SLOTS = 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a function of key and place."""
    return drawn(mix(key + M1), place)


def drawn(mixed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The same with keys that are mixed once for many places."""
    return ((mix(mixed ^ (place.astype(np.uint64) * M1 + M1)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """The pieces of a model, by a hash of their characters."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece spans a word's border")
        if model.normalize("ﬁ  x") != f"{SPACE}ﬁ{SPACE}{SPACE}x":
            raise ValueError("only models that leave texts as they are can be decoded exactly")
        self.longest = max(len(self.pieces[i]) for i in plain)
        score = np.array([model.get_score(i) for i in plain])
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        self.one_byte = np.array([self.bytes[c] for c in range(128)])
        self.byte_weight = -alpha * np.log(2.0 + len(plain))
        h = np.zeros(len(plain), np.uint64)
        for k, i in enumerate(plain):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in self.pieces[i]:
                    x = (x + np.uint64(ord(c) + 1)) * M1
            h[k] = x
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(plain)[order]
        self.weight = (-alpha * np.log(1.0 + rank))[order]
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        # The pieces of a slot (the hash's first bits) stand together: first[slot]:first[slot + 1].
        self.first = np.searchsorted(self.hash >> np.uint64(64 - SLOTS), np.arange((1 << SLOTS) + 1, dtype=np.uint64)).astype(np.int32)
        # Beginnings of pieces, by a slot of their hash: where none is met, no longer piece follows.
        self.begins = np.zeros(1 << SLOTS, bool)
        with np.errstate(over="ignore"):
            for i in plain:
                x = np.uint64(0)
                for c in self.pieces[i]:
                    x = (x + np.uint64(ord(c) + 1)) * M1
                    self.begins[int(x) >> 64 - SLOTS] = True
        # Texts of ids, for decoding: bytes stand for themselves.
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.array([len(x) for x in self.raw])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.joined[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.starts[ids] - ends + n, n)].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids, without the space that encoding puts before a text."""
        text = self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of the ranges of ``sizes`` from ``start`` on, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)


def sorted_by(a: np.ndarray, b: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """The order by a, then b, then c (below ``most``); packed into one number where they fit, which sorts faster."""
    bits = [int(x.max(initial=0)).bit_length() for x in (a, b)] + [(most - 1).bit_length()]
    if sum(bits) > 63:
        return np.lexsort((c, b, a))
    return np.argsort((a.astype(np.int64) << (bits[1] + bits[2])) | (b.astype(np.int64) << bits[2]) | c)


class Lattice:
    """The lattices of distinct words, laid end to end: a node per character and one at each word's end."""

    def __init__(self, chars: np.ndarray, start: np.ndarray, sizes: np.ndarray, vocab: Vocabulary):
        """Words are ``sizes`` characters of ``chars`` from ``start`` on."""
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last = self.first + sizes
        n = int((sizes + 1).sum())
        self.chars = np.zeros(n, np.uint32)
        inner = np.ones(n, bool)
        inner[self.last] = False
        self.chars[inner] = chars[spread(start, sizes)]
        left = np.repeat(self.last, sizes + 1) - np.arange(n)  # characters to the word's end
        start, length, k = self.match(vocab, left)
        bare = left > 0
        bare[start[length == 1]] = False
        bare = np.flatnonzero(bare)
        c = self.chars[bare]
        weight = np.concatenate((vocab.weight[k], vocab.byte_weight * (1.0 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))))
        piece = np.concatenate((vocab.id[k], np.where(c < 0x80, vocab.one_byte[np.minimum(c, 127)], -1))).astype(np.int32)
        start, length = np.concatenate((start, bare)), np.concatenate((length, np.ones(len(bare), np.int64)))
        # All words are solved together from their ends, nodes of equal distance to it at once.
        order = sorted_by(left[start], start, length - 1, vocab.longest)
        start, end, weight, piece = start[order], (start + length)[order], weight[order], piece[order]
        heads = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1]))) if len(start) else np.zeros(0, np.int64)
        nodes, beta = start[heads], np.zeros(n)
        fan = np.diff(np.concatenate((heads, [len(start)])))
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(left[nodes]) > 0, [True]))) if len(nodes) else np.zeros(1, np.int64)
        bounds = np.concatenate((heads, [len(start)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = bounds[lo], bounds[hi]
            x = weight[a:b] + beta[end[a:b]]
            at = heads[lo:hi] - a
            top = np.maximum.reduceat(x, at)
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, fan[lo:hi])), at))
            beta[nodes[lo:hi]] = total
            weight[a:b] = x - np.repeat(total, fan[lo:hi])  # from here on the edges' conditional log probabilities
        # A node's edges stand together, the likeliest first.
        order = sorted_by(start, ((1 - np.exp(weight)) * ((1 << 32) - 1)).astype(np.int64), end - start - 1, vocab.longest)
        self.start, self.end, self.piece, self.logq = start[order].astype(np.int32), end[order].astype(np.int32), piece[order], weight[order]
        self.q = np.exp(self.logq)
        self.edge = np.zeros(n + 1, np.int64)  # a node's edges are edge[node]:edge[node + 1]
        fan = np.bincount(self.start, minlength=n)
        np.cumsum(fan, out=self.edge[1:])
        self.rest = np.where(fan[self.start] == 1, -np.inf, np.log(np.maximum(1 - self.q, 1e-300)))  # log of what the node's other edges have

    def subset(self, words: np.ndarray) -> Lattice:
        """The lattices of some of the words (by index, ascending)."""
        out = object.__new__(Lattice)
        size = self.last[words] - self.first[words] + 1
        out.first = np.cumsum(size) - size
        out.last = out.first + size - 1
        nodes = spread(self.first[words], size)
        fan = (self.edge[nodes + 1] - self.edge[nodes]) if len(nodes) else np.zeros(0, np.int64)
        out.edge = np.concatenate(([0], np.cumsum(fan)))
        edges = spread(self.edge[nodes], fan)
        moved = np.repeat(np.repeat(out.first - self.first[words], size), fan)
        out.start, out.end = (self.start[edges] + moved).astype(np.int32), (self.end[edges] + moved).astype(np.int32)
        out.chars, out.piece, out.logq, out.q, out.rest = self.chars[nodes], self.piece[edges], self.logq[edges], self.q[edges], self.rest[edges]
        return out

    def followed(self, other: Lattice) -> Lattice:
        """Both lattices, the other's words after this one's."""
        out, n, m = object.__new__(Lattice), len(self.chars), len(self.q)
        for name, by in (("first", n), ("last", n), ("start", n), ("end", n), ("chars", 0), ("piece", 0), ("logq", 0), ("q", 0), ("rest", 0)):
            a, b = getattr(self, name), getattr(other, name)
            setattr(out, name, np.concatenate((a, b + a.dtype.type(by) if by else b)))
        out.edge = np.concatenate((self.edge, other.edge[1:] + m))
        return out

    def match(self, vocab: Vocabulary, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, length, index into the vocabulary) of all pieces in the words."""
        at = np.flatnonzero(left > 0)
        h, room = np.zeros(len(at), np.uint64), left[at]
        plus = self.chars.astype(np.uint64) + np.uint64(1)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for length in range(1, vocab.longest + 1):
            h = (h + plus[at + (length - 1)]) * M1
            slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
            live = np.flatnonzero(vocab.begins[slot])
            at, h, room, slot = at[live], h[live], room[live], slot[live]
            k, stop = vocab.first[slot], vocab.first[slot + 1]
            look = np.flatnonzero(k < stop)
            while len(look):
                hit = vocab.hash[k[look]] == h[look]
                got = look[hit]
                for out, x in zip(found, (at[got], np.full(len(got), length), k[got].astype(np.int64)), strict=True):
                    out.append(x)
                look = look[~hit]
                k[look] += 1
                look = look[k[look] < stop[look]]
            live = np.flatnonzero(room > length)
            at, h, room = at[live], h[live], room[live]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in found)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its conditional probability."""
        e, stop = self.edge[node], self.edge[node + 1] - 1
        rest = u - self.q[e]
        live = np.flatnonzero((rest > 0) & (e < stop))
        while len(live):
            e[live] += 1
            rest[live] -= self.q[e[live]]
            live = live[(rest[live] > 0) & (e[live] < stop[live])]
        return e


def paths(lat: Lattice, unit: np.ndarray, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw each occurrence's pieces from ``node`` to its word's end: (occurrence, edge) in order."""
    occ, owners, edges, step = np.arange(len(unit)), [], [], 0
    live = node < lat.last[unit]
    occ, node = occ[live], node[live]
    while len(occ):
        e = lat.draw(node, drawn(seed[occ], (place[occ] << 20) + step))
        owners.append(occ)
        edges.append(e)
        node = lat.end[e]
        live = node < lat.last[unit[occ]]
        occ, node, step = occ[live], node[live], step + 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, edge = np.concatenate(owners), np.concatenate(edges)
    order = np.argsort(owner, kind="stable")
    return owner[order], edge[order]


class Words:
    """The words of texts: their characters, and each one's start and size; a word has the spaces before it, a text one more."""

    def __init__(self, texts: list[str]):
        self.chars = np.frombuffer("".join(SPACE + t.replace(" ", SPACE) for t in texts if t).encode("utf-32-le"), np.uint32)
        lens = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = np.cumsum(lens) - lens
        mark = self.chars == ord(SPACE)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[first[lens > 0]] = True
        self.start = np.flatnonzero(begins)
        self.sizes = np.diff(np.concatenate((self.start, [len(self.chars)])))
        self.place = np.arange(len(self.chars)) - np.repeat(self.start, self.sizes)
        #: Each text's words are cut[i]:cut[i + 1].
        self.cut = np.searchsorted(self.start, np.concatenate((first, [len(self.chars)])))
        powers = np.cumprod(np.full(int(self.sizes.max(initial=1)), M1, np.uint64))
        sums = np.add.reduceat((self.chars + np.uint64(1)) * powers[self.place], self.start) if len(self.start) else np.zeros(0, np.uint64)
        self.hash = mix(sums ^ self.sizes.astype(np.uint64))


class Memo:
    """A worker's solved lattices of words that it has met in more than one chunk, up to ``KEPT`` nodes."""

    def __init__(self, vocab: Vocabulary):
        none = np.zeros(0, np.int64)
        self.vocab, self.lattice = vocab, Lattice(np.zeros(0, np.uint32), none, none, vocab)
        self.hash, self.at, self.seen = none.astype(np.uint64), none, none.astype(np.uint64)

    def solve(self, words: Words) -> tuple[Lattice, np.ndarray]:
        """Lattices that hold all words, and each word's index in them."""
        kinds, where, kind = np.unique(words.hash, return_index=True, return_inverse=True)
        k = np.searchsorted(self.hash, kinds)
        found = np.zeros(len(kinds), bool)
        if len(self.hash):
            found = self.hash[np.minimum(k, len(self.hash) - 1)] == kinds
        new, old = np.flatnonzero(~found), len(self.lattice.first)
        index = np.zeros(len(kinds), np.int64)
        index[found] = self.at[k[found]]
        index[new] = old + np.arange(len(new))
        fresh = Lattice(words.chars, words.start[where[new]], words.sizes[where[new]], self.vocab)
        both, unit = self.lattice.followed(fresh), index[kind]
        # Equal hashes are checked: a word that differs from its kind gets a lattice of its own.
        same = both.last[unit] - both.first[unit] == words.sizes
        at = np.minimum(np.repeat(both.first[unit], words.sizes) + words.place, len(both.chars) - 1)
        same &= np.logical_and.reduceat(both.chars[at] == words.chars, words.start) if len(words.start) else same
        odd = np.flatnonzero(~same)
        if len(odd):
            unit[odd] = len(both.first) + np.arange(len(odd))
            both = both.followed(Lattice(words.chars, words.start[odd], words.sizes[odd], self.vocab))
        self.keep(fresh, kinds[new])
        return both, unit

    def keep(self, fresh: Lattice, hashes: np.ndarray) -> None:
        sizes = fresh.last - fresh.first
        k = np.searchsorted(self.seen, hashes)
        met = self.seen[np.minimum(k, len(self.seen) - 1)] == hashes if len(self.seen) else np.zeros(len(hashes), bool)
        again = np.flatnonzero(met & (sizes <= LONGEST))
        again = again[np.cumsum(sizes[again] + 1) <= KEPT - len(self.lattice.chars)]
        if len(again):
            self.at = np.concatenate((self.at, len(self.lattice.first) + np.arange(len(again))))
            self.hash = np.concatenate((self.hash, hashes[again]))
            order = np.argsort(self.hash)
            self.hash, self.at = self.hash[order], self.at[order]
            self.lattice = self.lattice.followed(fresh.subset(again))
        self.seen = np.sort(np.concatenate((self.seen if len(self.seen) < SEEN else self.seen[:0], hashes[~met & (sizes <= LONGEST)])))


class Search:
    """The A* search of one text: its completed paths and its best open nodes."""

    __slots__ = ("key", "k", "done", "open", "count")

    def __init__(self, key: int, k: int):
        self.key, self.k, self.done, self.open, self.count = key, k, [], [], 0

    def push(self, bound: float, node: tuple) -> None:
        self.count += 1
        heapq.heappush(self.open, (-bound, self.count, node))


def bounds(mass: np.ndarray, g: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The maxima of nodes of log mass ``mass``: Gumbels truncated at ``g``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(np.minimum(mass - g, 700)) - noise))


def search(keys: list[int], texts: list[str], memo: Memo, k: int) -> tuple[Lattice, list[Search]]:
    """The solved searches of the texts; a completed path is (edges, their words, log probability, perturbed value)."""
    words = Words(texts)
    lat, unit_all = memo.solve(words)
    units = [unit_all[a:b] for a, b in zip(words.cut[:-1].tolist(), words.cut[1:].tolist(), strict=True)]
    searches = [Search(key, k) for key in keys]
    todo = []
    first_g = -np.log(-np.log(uniform(np.array(keys, np.uint64), np.ones(len(keys), np.int64))))
    for i, s in enumerate(searches):
        g = float(first_g[i])
        if len(units[i]):
            # Node: value, word from which it is free, edges of that word so far, the node's excluded edges, earlier path.
            todo.append((i, g, 0, [], frozenset(), None))
        else:
            s.done.append((np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0, g))
    for turn in range(k):
        if not todo:
            break
        unit, node, place, fixed = [], [], [], []
        turn_keys = mix(np.array([searches[t[0]].key + (turn + 2) * int(M1) & (1 << 64) - 1 for t in todo], np.uint64))
        for (i, _, w, begun, out, _), key in zip(todo, turn_keys, strict=True):
            u = units[i][w:]
            first = int(lat.end[begun[-1]]) if begun else int(lat.first[u[0]])
            start = lat.first[u]
            forced = []
            if out:
                e = np.array([x for x in range(lat.edge[first], lat.edge[first + 1]) if x not in out])
                q = np.cumsum(lat.q[e])
                r = uniform(np.array([key]), np.array([0]))[0] * q[-1]
                forced = [int(e[min(np.searchsorted(q, r), len(e) - 1)])]
                first = int(lat.end[forced[0]])
            start[0] = first
            fixed.append(begun + forced)
            unit.append(u)
            node.append(start)
            place.append(np.arange(w + 1, w + 1 + len(u)))
        lens = np.array([len(u) for u in unit])
        base = np.cumsum(lens) - lens
        owner, edge = paths(lat, np.concatenate(unit), np.concatenate(node), np.repeat(mix(turn_keys + M1), lens), np.concatenate(place))
        cut = np.searchsorted(owner, np.concatenate((base, [base[-1] + lens[-1]])))
        # For all drawn steps at once: log probabilities, the mass that each step leaves behind, its bound.
        steps, logq = np.diff(cut), lat.logq[edge]
        upto = np.cumsum(logq)
        where_all = owner + np.repeat(np.array([t[2] for t in todo]) - base, lens)[owner]
        kept = np.array([int(np.searchsorted(t[5][1], t[2])) if t[5] is not None else 0 for t in todo])
        head = kept + np.array([len(f) for f in fixed])
        ahead = np.array([float(lat.logq[np.concatenate((t[5][0][:n], f)).astype(np.int64)].sum()) if t[5] is not None else 0.0 for t, n, f in zip(todo, kept.tolist(), fixed, strict=True)])
        prior = np.concatenate(([0.0], upto))[cut]
        total = ahead + np.where(steps > 0, prior[1:] - prior[:-1], 0.0)
        key, g = np.array([searches[t[0]].key for t in todo], np.uint64), np.array([t[1] for t in todo])
        place_all = np.arange(len(edge)) + np.repeat(head - cut[:-1], steps)
        noise = np.log(drawn(np.repeat(mix(key + M1), steps), (turn + 1 << 40) + place_all))
        bound_all = bounds(upto - logq + np.repeat(ahead - prior[:-1], steps) + lat.rest[edge], np.repeat(g, steps), noise)
        nxt = []
        for j, (i, gj, w, _, out, earlier) in enumerate(todo):
            s, lo, hi, n_head = searches[i], int(cut[j]), int(cut[j + 1]), int(head[j])
            mine, where = edge[lo:hi], where_all[lo:hi]
            if n_head:
                begun = np.array(fixed[j], np.int64)
                mine = np.concatenate((earlier[0][: kept[j]], begun, mine))
                where = np.concatenate((earlier[1][: kept[j]], np.full(len(begun), w), where))
            s.done.append((mine, where, float(total[j]), gj))
            # Open nodes of this path: from the step at which it left the earlier one.
            bound, at = bound_all[lo:hi], n_head
            if out:
                at = n_head - 1
                e = mine[at]
                free = [x for x in range(lat.edge[lat.start[e]], lat.edge[lat.start[e] + 1]) if x != e and x not in out]
                with np.errstate(divide="ignore"):
                    mass = ahead[j] - lat.logq[e] + np.log(lat.q[free].sum()) if free else -np.inf
                bound = np.concatenate((bounds(np.array([mass]), gj, np.log(uniform(key[j : j + 1], np.array([(turn + 1 << 40) + at])))), bound))
            left = k - len(s.done) + 1
            best = () if not len(bound) else [int(bound.argmax())] if left == 1 else sorted(np.argpartition(-bound, min(left, len(bound)) - 1)[:left].tolist())
            for b in best:
                if bound[b] > -np.inf:
                    p = at + b
                    first = int(np.searchsorted(where, where[p]))
                    gone = (out if b == 0 and out else frozenset()) | {int(mine[p])}
                    s.push(float(bound[b]), (int(where[p]), mine[first:p].tolist(), gone, (mine, where)))
            if len(s.done) < k and s.open:
                value, _, (w2, inside, gone, path) = heapq.heappop(s.open)
                nxt.append((i, -value, w2, inside, gone, path))
        todo = nxt
    return lat, searches


def spelled(lat: Lattice, edges: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The pieces' ids of a path, characters without a piece as their bytes."""
    ids = lat.piece[edges]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    parts, at = [], 0
    for i in bare.tolist():
        parts += [ids[at:i], np.array([vocab.bytes[c] for c in chr(int(lat.chars[lat.start[edges[i]]])).encode("utf-8", "replace")], np.int32)]
        at = i + 1
    return np.concatenate([*parts, ids[at:]])


def sampled(keys: list[int], texts: list[str], memo: Memo, k: int) -> list[list[tuple]]:
    """For each text up to k tuples (array of ids, log probability, perturbed value, inclusion score)."""
    lat, searches = search(keys, texts, memo, k)
    out = []
    for s in searches:
        threshold = -s.open[0][0] if s.open else None
        out.append([(spelled(lat, mine, memo.vocab), logp, g, 1.0 if threshold is None else float(-np.expm1(-np.exp(min(700.0, logp - threshold))))) for mine, _, logp, g in s.done])
    return out


def sample(keys: list[int], texts: list[str], vocab: Vocabulary, k: int) -> list[list[tuple]]:
    """The same with lists of ids."""
    return [[(ids.tolist(), *rest) for ids, *rest in rows] for rows in sampled(keys, texts, Memo(vocab), k)]


_memos: dict[tuple, Memo] = {}


def memo_of(path: str, alpha: float = 1.0) -> Memo:
    """This worker's memo for a model."""
    if (path, alpha) not in _memos:
        _memos[path, alpha] = Memo(Vocabulary(path, alpha))
    return _memos[path, alpha]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``CHUNK`` characters."""
    for b in batches:
        ids, texts, size = [], [], 0
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(d)
            texts.append((t or "").encode("utf-8", "replace").decode())
            size += len(texts[-1]) + 20
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def encode_samples(docs: DataFrame, path: str, k: int = 2, alpha: float = 1.0, seed: int = 42, keep_ids: bool = True) -> DataFrame:
    """Up to k rows per document, best first.

    ``(doc_id, sample, ids, n_pieces, log_prob, perturbed, inclusion, ids_sha256, decoded)``;
    ids are left out unless ``keep_ids``; decoded tells whether decoding them gives the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(path, alpha)
        vocab = memo.vocab
        for ids, texts in chunks(batches):
            keys = [int(mix(np.array([((d or 0) & (1 << 64) - 1) ^ seed << 32], np.uint64))[0]) for d in ids]
            rows, pieces = [], []
            for d, text, found in zip(ids, texts, sampled(keys, texts, memo, k), strict=True):
                for n, (ids_, logp, g, inclusion) in enumerate(found):
                    pieces.append(ids_)
                    rows.append((d, n, len(ids_), logp, g, inclusion, hashlib.sha256(ids_.tobytes()).hexdigest(), vocab.decode(ids_) == text))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int32)
                arrays.insert(2, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces))))
            yield pa.RecordBatch.from_arrays(arrays, names=[c for i, c in enumerate(COLUMNS) if keep_ids or i != 2])
        release()

    types = ["long", "int", "array<int>", "int", "double", "double", "double", "string", "boolean"]
    schema = ", ".join(f"{c} {t}" for i, (c, t) in enumerate(zip(COLUMNS, types, strict=True)) if keep_ids or i != 2)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_samples(samples: DataFrame, path: str) -> DataFrame:
    """``(doc_id, sample, text)`` of rows with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = memo_of(path).vocab
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vocab.decode(x or []) for x in b.column(2).to_pylist()], pa.string())], names=["doc_id", "sample", "text"])

    return samples.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")


COLUMNS = ["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_sha256", "decoded"]
