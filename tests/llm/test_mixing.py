"""Mixing: targets, permutations, totals, whole use of words."""

import random
import re

import numpy as np

from fitloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = ["a", "b", "c", None][min(3, int(rng.expovariate(1.1)))]
        text = " \n".join(f"w{i}_{k}" for k in range(int(rng.expovariate(1 / 60))))
        rows.append((i, text, source, len(text), 7))
    rows += [(900, None, "a", 0, 7), (901, " \t", "a", 2, 7), (902, "x " * 20_000, "c", 40_000, 7), (None, "n u l l", "b", 7, 7), (5, "dup dup", "b", 7, 7), (5, "dup dup", "b", 7, 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, taken int")


def test_targets():
    assert mixing.targets([100, 100], [1, 2]) == [200 / 3, 400 / 3]
    assert mixing.targets([10, 90], [3, 1]) == [30.0, 70.0]
    assert mixing.targets([5, 5, 90], [1, 2, 3]) == [15.0, 15.0, 70.0]
    assert mixing.targets([0, 10], [1, 2]) == [0.0, 10.0] and mixing.targets([], []) == []


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        p = mixing.permuted(np.arange(n), n, "k")
        assert sorted(p) == list(range(n))
    assert not np.array_equal(mixing.permuted(np.arange(1000), 1000, "k"), mixing.permuted(np.arange(1000), 1000, "l"))


def test_counts_meet_their_totals():
    slots = [0, 5, 7000, 3, 100]
    assert mixing.shard_counts(slots, 1).sum(0).tolist() == slots


def test_taken(spark):
    rows, docs = make(spark)
    got = mixing.Mix(docs, block=16).taken().collect()
    assert len(got) == len(rows)
    size = {(r[0], r[1]): len(WORD.findall(r[1] or "")) for r in rows}
    assert sorted(r["size"] for r in got) == sorted(size[r[0], r[1]] for r in rows)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 16 + 0.02 * target
    assert abs(sum(t for _, t in by_source) - sum(r["size"] for r in got)) < 1e-6
    again = mixing.Mix(docs.repartition(5), block=16).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_and_documents_hold_what_is_taken(spark):
    rows, docs = make(spark, 2)
    rows, docs = rows[:900], docs.where("doc_id < 900 and text not like 'dup%'")
    m = mixing.Mix(docs, block=16)
    taken = {r.doc_id: r.taken for r in m.taken().collect()}
    held = {}
    for r in m.shards().selectExpr("doc_id", "last - first as n").collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + r.n
    assert held == {d: n for d, n in taken.items() if n}
    out = mixing.mix_documents(docs, block=16)
    assert out.columns == docs.columns
    words, text = {}, {r[0]: r[1] for r in rows}
    for r in out.collect():
        found = WORD.findall(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(found)
        assert r.n_chars == len(r.text) and set(found) <= set(WORD.findall(text[r.doc_id]))
    assert words == held


def test_empty(spark):
    _, docs = make(spark)
    assert mixing.Mix(docs.limit(0)).taken().count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.Mix(docs.where("text is null")).taken().collect()} == {0}
