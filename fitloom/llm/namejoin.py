"""Edit-distance name join by trie descent, in shards by length.

Distances are unrestricted Damerau-Levenshtein: insertions, deletions and substitutions of
one code point, and exchanges of two adjacent ones between which text may have been
inserted or deleted.

Each side's distinct names meet in shards.  A name of the trie side of length L is cut into
``most`` + 1 pieces with one code point left out between neighbours.  As one edit can't
touch two pieces, a name within ``most`` edits holds one of them unchanged, moved by as many
places as its length allows: the shard's key is (L, number of the piece, piece).  Names of
shards with more than ``CAP`` rows, and names too short for such pieces, meet instead by
what is left of them after up to ``most`` deletions, which two names within ``most`` edits
share; how many names share such a rest is bounded by the alphabet, not by the input.

In a shard the trie is held as its sorted names with their common prefixes: descending it
from one name to the next keeps the rows of the prefix that they share.  A row holds the
2 * ``most`` + 1 cells about the diagonal; the rows above it on the path are retained, since
exchanges look back at them; where no live row can lead to ``most`` or less, all names
below that prefix are skipped.

Defined cases: null and empty names take no part; repeated rows count each; names of any
length cost memory in proportion to it; rows of any other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import materialize

#: Rows of a shard from which its names meet by their rests instead.
CAP = 1000
TRIE, ASKED = 0, 1


def pieces(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the ``most`` + 1 pieces of a name, one code point between neighbours."""
    each, more = divmod(length - most, most + 1)
    out, at = [], 0
    for i in range(most + 1):
        n = each + (i < more)
        out.append((at, n))
        at += n + 1
    return out


def _piece(length: Column, i: int, most: int) -> tuple[Column, Column]:
    """``pieces(length, most)[i]`` as columns."""
    each, more = F.floor((length - most) / (most + 1)).cast("int"), F.pmod(length - most, F.lit(most + 1))
    return each * i + F.least(more, F.lit(i)) + i, each + F.when(more > i, 1).otherwise(0)


def _key(length: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), piece)


def piece_keys(name: Column, most: int, side: int) -> Column:
    """The keys of a name's shards; of the trie side one for each piece, else one for each length and place that a piece can have."""
    long_enough, out = 2 * most + 1, []
    own = F.length(name)
    for more in (0,) if side == TRIE else range(-most, most + 1):
        length = own + more
        for i in range(most + 1):
            start, n = _piece(length, i, most)
            for left in (0,) if side == TRIE else range(-most, most + 1):
                # ``left`` characters more stand before the piece in the asked name, -more - left after it.
                if abs(left) + abs(more + left) > most or (i == 0 and left):
                    continue
                at = start + left
                fits = (length >= long_enough) & (at >= 0) & (at + n <= own)
                out.append(F.when(fits, _key(length, i, F.substr(name, at + 1, n))))
    return F.filter(F.array_distinct(F.array(*out)), lambda k: k.isNotNull())


def rest_keys(name: Column, most: int) -> Column:
    """The hashes of a name less up to ``most`` of its code points."""
    rests = F.array(name)
    for _ in range(most):
        cut = F.transform(rests, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x)))))
        rests = F.array_distinct(F.concat(rests, F.flatten(cut)))
    return F.transform(rests, lambda x: F.xxhash64(F.lit("rest"), x))


def row_below(rows: list[list[int]], name: str, i: int, asked: str, most: int) -> list[int]:
    """The row of ``name[:i]``, given those of all shorter prefixes: cell c is the distance to the first i + c - ``most`` of ``asked``, ``most`` + 1 for anything above."""
    far, last, above, out = most + 1, name[i - 1], rows[i - 1], []
    for c in range(2 * most + 1):
        j = i + c - most
        if not 0 <= j <= len(asked):
            out.append(far)
            continue
        best = above[c + 1] + 1 if c < 2 * most else far
        if j:
            best = min(best, above[c] + (last != asked[j - 1]), out[c - 1] + 1 if c else far)
            # Exchanges: asked[j - 1] stands earlier in the prefix and the prefix's last code point earlier in the asked name.
            for up in range(min(most, i - 1)):
                if name[i - 2 - up] == asked[j - 1]:
                    for back in range(min(most - up, j - 1)):
                        from_ = c - back + up
                        if asked[j - 2 - back] == last and 0 <= from_ <= 2 * most:
                            best = min(best, rows[i - 2 - up][from_] + up + back + 1)
        out.append(min(best, far))
    return out


def descend(names: list[str], shared: list[int], asked: str, most: int) -> Iterator[tuple[str, int]]:
    """(name, distance) of the sorted ``names`` within ``most`` of ``asked``; ``shared`` has each name's common prefix with the one before it."""
    rows = [[c - most if 0 <= c - most <= len(asked) else most + 1 for c in range(2 * most + 1)]]
    least, dead = [0], len(names[0]) + 1
    for i, name in enumerate(names):
        if i and shared[i] >= dead:
            continue
        keep, dead = min(shared[i], len(rows) - 1), len(name) + 1
        del rows[keep + 1 :], least[keep + 1 :]
        for d in range(keep + 1, len(name) + 1):
            rows.append(row_below(rows, name, d, asked, most))
            least.append(min(rows[d]))
            # The row t above can still be reached by an exchange, at a cost of t.
            if min(least[d - t] + t for t in range(min(most, d) + 1)) > most:
                dead = d
                break
        else:
            end = len(asked) - len(name) + most
            if 0 <= end <= 2 * most and rows[-1][end] <= most:
                yield name, rows[-1][end]


def shard_pairs(trie: list[str], asked: list[str], most: int) -> Iterator[tuple[str, str, int]]:
    """(asked name, name, distance) within one shard, a trie for each length."""
    tries: dict[int, list[str]] = {}
    for name in sorted(set(trie)):
        tries.setdefault(len(name), []).append(name)
    for names in tries.values():
        shared = [0, *(len(os.path.commonprefix(two)) for two in zip(names, names[1:], strict=False))]
        for q in asked:
            if abs(len(q) - len(names[0])) <= most:
                for name, d in descend(names, shared, q, most):
                    yield q, name, d


def scan_shards(rows: DataFrame, most: int) -> DataFrame:
    """``(asked, name, distance)`` of ``rows(key, side, name)``, partitioned and sorted by key; a task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            q, n, d = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(d, pa.int32())], names=["asked", "name", "distance"])

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, side = t.column(0).to_numpy(), t.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            asked = np.add.reduceat(side, first)
            size = np.diff(np.r_[first, len(key)])
            found: list[tuple[str, str, int]] = []
            for g in np.flatnonzero((asked > 0) & (asked < size)):
                names, sides = t.column(2).slice(first[g], size[g]).to_pylist(), side[first[g] : first[g] + size[g]]
                found += shard_pairs([x for x, s in zip(names, sides, strict=True) if s == TRIE], [x for x, s in zip(names, sides, strict=True) if s == ASKED], most)
                if len(found) > 5000:
                    yield packed(found)
                    found = []
            if found:
                yield packed(found)

        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from done(t.slice(0, cut)) if cut else ()
            rest = t.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from done(rest)

    return rows.mapInArrow(run, "asked string, name string, distance int")


def name_pairs(names: DataFrame, asked: DataFrame, most: int = 1) -> DataFrame:
    """``(asked, name, distance)``: all pairs of distinct names at a distance of at most ``most``, from two tables with a column ``name``."""
    side = lambda df, s: df.select("name").where("name <> ''").distinct().select(F.lit(s).alias("side"), "name")
    both = materialize(side(names, TRIE).unionByName(side(asked, ASKED)), "names")
    keys = F.when(F.col("side") == TRIE, piece_keys(F.col("name"), most, TRIE)).otherwise(piece_keys(F.col("name"), most, ASKED))
    keyed = both.select("side", "name", F.explode(keys).alias("key"))
    large = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CAP).select("key", F.lit(True).alias("large")), "large-shards")
    # A merge join, never a broadcast: there are as many large shards as the input makes; large keys' rows are split at run time.
    routed = keyed.join(large.hint("merge"), "key", "left")
    short = F.length("name") < 2 * most + 1 + F.when(F.col("side") == ASKED, most).otherwise(0)
    finer = routed.where("large").select("side", "name").unionByName(both.where(short)).distinct()
    rows = routed.where("large is null").select("key", "side", "name").unionByName(finer.select(F.explode(rest_keys(F.col("name"), most)).alias("key"), "side", "name"))
    found = scan_shards(rows.repartition("key").sortWithinPartitions("key"), most)
    return found.groupBy("asked", "name").agg(F.min("distance").alias("distance"))


def misspelt(name: Column, key: Column) -> Column:
    """A name with two neighbours exchanged where the crc32 of its key's digits is even: those at crc32 mod (length - 1) and after it."""
    h = F.crc32(key.cast("string").cast("binary"))
    at = F.pmod(h, F.length(name) - 1).cast("int")
    part = lambda start, n: F.substr(name, start + 1, n)
    swapped = F.concat(part(F.lit(0), at), part(at + 1, F.lit(1)), part(at, F.lit(1)), part(at + 2, F.length(name)))
    return F.when((F.pmod(h, F.lit(2)) == 0) & (F.length(name) >= 2), swapped).otherwise(name)


def vendor_clients(clients: DataFrame, vendors: DataFrame, most: int = 1) -> DataFrame:
    """``(vendor_id, distance, n_clients, first_client_id, clients_crc)``: for each misspelt vendor the clients with names within ``most`` edits, by distance.

    Clients are summed up by name and vendors by id and name before they meet; rows without an id count, in ``n_clients`` alone.
    """
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    held = clients.where("name <> ''").groupBy("name").agg(F.count("*").alias("c"), F.min("client_id").alias("first"), F.sum(crc).alias("crc"))
    held = materialize(held, "client-names")
    wrong = vendors.select("vendor_id", misspelt(F.col("name"), F.col("vendor_id")).alias("name")).where("name <> ''").groupBy("vendor_id", "name").agg(F.count("*").alias("m"))
    wrong = materialize(wrong, "vendor-names")
    pairs = name_pairs(held, wrong, most)
    met = pairs.join(held.hint("merge"), "name").groupBy("asked", "distance").agg(F.sum("c").alias("c"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    out = wrong.join(met.withColumnRenamed("asked", "name").hint("merge"), "name")
    return out.groupBy("vendor_id", "distance").agg(
        F.sum(F.col("m") * F.col("c")).alias("n_clients"), F.min("first").alias("first_client_id"), F.coalesce(F.sum(F.col("m") * F.col("crc")), F.lit(0)).alias("clients_crc")
    )
