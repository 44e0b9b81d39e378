"""Embedding near-dedup: exact on small tables, recall near the threshold, odd inputs."""

import numpy as np
import pyarrow as pa
import pytest

from fitloom.llm import vectors


def brute(ids, x, least=0.95):
    u = vectors.unit(x)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    stack.append(int(j))
        comp[i] = min(ids[j] for j in seen)
    return {d: (int(near[k].sum()), comp[k]) for k, d in enumerate(ids)}


def planted(n, d=64, seed=0, low=0.95, high=0.97):
    """n random vectors and n near copies with cosines between low and high."""
    rng = np.random.default_rng(seed)
    a = vectors.unit(rng.normal(size=(n, d)))
    z = rng.normal(size=(n, d))
    z = vectors.unit(z - (z * a).sum(1, keepdims=True) * a)
    c = rng.uniform(low, high, size=(n, 1))
    return np.concatenate((a, c * a + np.sqrt(1 - c * c) * z)).astype(np.float32)


def test_recall_near_the_threshold(spark):
    x = planted(4000, low=0.951)
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_dedup(df).collect()}
    want = brute(ids, x)
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.99 * sum(n for n, _ in want.values())


@pytest.mark.parametrize("cap", [2000, 40])
def test_groups_copies_and_odd_rows(spark, monkeypatch, cap):
    monkeypatch.setattr(vectors, "CAP", cap)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    x = np.concatenate((base, base[0] + 0.03 * rng.normal(size=(200, 16)), np.repeat(base[5:6], 60, 0), 2 * base[7:8])).astype(np.float32)
    ids = [int(i) * 3 + 1 for i in range(len(x))]
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16), (9006, [None] * 16), (9007, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + [rows[0]] + [(i, v, 0) for i, v in odd], "vec_id long, embedding array<float>, m int")
    out = vectors.near_dedup(df).collect()
    want = brute(ids, x)
    assert len(out) == len(rows) + 1 + len(odd)
    for r in out:
        if r.vec_id in want:
            assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept


def test_empty(spark):
    assert vectors.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vectors.near_dedup(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1


def test_recall_at_two_thousand_cells(spark, monkeypatch):
    """20,000 vectors in 2,000 cells: over 9 in 10 planted pairs just above the threshold are found."""
    monkeypatch.setattr(vectors, "PER_CELL", 10)
    rng = np.random.default_rng(9)
    base = vectors.unit(rng.normal(size=(19_600, 64)))
    side = rng.normal(size=(400, 64))
    side -= (side * base[:400]).sum(1, keepdims=True) * base[:400]
    near = 0.951 * base[:400] + np.sqrt(1 - 0.951**2) * vectors.unit(side)
    x = np.concatenate((base, near))
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})
    got = {r.vec_id: r for r in vectors.near_dedup(spark.createDataFrame(table)).collect()}
    hit = sum(got[19_600 + i].component_id == i for i in range(400))
    assert hit > 360 and sum(r.n_links for r in got.values()) == 2 * hit
