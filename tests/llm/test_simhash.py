"""SimHash: brute force over small tables, hot segment values and odd inputs."""

import random

import xxhash

from fitloom.llm import simhash


def brute(rows, width=3, budget=3):
    fps = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[doc_id] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {d: (f"{fps[d]:016x}", root(d)) for d in ids}


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE two"), (7, "x " * 30_000)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(8)]
    for i in range(10, 120):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 20


def test_hot_segment_values_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 5)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs).collect()}
    assert got == brute(rows)


def test_pigeonring_loses_no_pair(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for f in fps for _ in range(3)]
    fps = sorted(set(fps))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {(r.a, r.b) for r in simhash.near_edges(spark.createDataFrame(signed, "rep long, fp long")).collect()}
    assert got == {(i, j) for i, f in enumerate(fps) for j, g in enumerate(fps) if i < j and (f ^ g).bit_count() <= 3}


def test_empty_table_and_repeated_rows(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = simhash.simhash_dedup(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and {r.component_id for r in rows} == {5}
