"""Exponion search against a plain k-means in integers, its savings, and odd inputs."""

import hashlib

import duckdb
import numpy as np
import pytest

from fitloom.llm import kmeans


def plain(rows, k=16, rounds=3):
    """(clusters, distances, centroids) by full scans."""
    v = np.array([r[1] for r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    c = v[order].copy()
    for i in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if i < rounds:
            for j in np.unique(a):
                c[j] = [int(x) // int((a == j).sum()) for x in v[a == j].sum(0)]
    return a, d[np.arange(len(v)), a], c


def table(spark, rows):
    return spark.createDataFrame([(i, [x / 64 for x in v], 7) for i, v in rows], "vec_id long, embedding array<double>, cluster int")


@pytest.mark.parametrize(("n", "spread"), [(400, 40), (300, 2), (5, 9)])
def test_clusters(spark, n, spread):
    """Small spreads make many ties and many equal centroids."""
    rng = np.random.default_rng(n)
    rows = [(i, [int(x) for x in rng.integers(-spread, spread, 64) * rng.integers(0, 2)]) for i in range(n)]
    a, d, c = plain(rows)
    got = sorted(kmeans.summary(table(spark, rows).repartition(3)).collect())
    assert [r["cluster"] for r in got] == a.tolist() and [r["distance"] for r in got] == d.tolist()
    assert {r["inertia"] for r in got} == {int(d.sum())}
    for r in got:
        assert r["cluster_inertia"] == int(d[a == r["cluster"]].sum())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest()


def test_bounds_save_scans():
    """Of clustered vectors most are settled without a look at a centroid, and none wrongly."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-600, 600, (16, 64))
    v = np.concatenate([m + rng.integers(-30, 30, (200, 64)) for m in centers])
    first = kmeans.Centroids(centers + 9)
    cluster, upper, lower, _ = kmeans.scan_all(v, first)
    second = kmeans.Centroids(centers)
    moved = np.sqrt(kmeans.squared(first.at, second.at).astype(float))
    counts = np.zeros(len(v), int)
    got = kmeans.search(v, cluster, upper + moved[cluster], lower - moved.max(), second, counts)
    assert (got[0] == kmeans.scan_all(v, second)[0]).all() and counts.mean() < 1


def test_random_bounds():
    """Loose bounds that hold give what a full scan gives."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        v, c = rng.integers(-3, 4, (60, 5)), kmeans.Centroids(rng.integers(-3, 4, (7, 5)))
        near, _, _, _ = kmeans.scan_all(v, c)
        start = rng.integers(0, 7, 60)
        d = np.sqrt(np.stack([kmeans.squared(v, m) for m in c.at], 1).astype(float))
        own = d[np.arange(60), start]
        d[np.arange(60), start] = np.inf
        got, upper, lower = kmeans.search(v, start, own + rng.random(60), np.maximum(0, d.min(1) - rng.random(60)), c)
        assert (got == near).all()


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (2, None), (3, []), (4, [1.0] * 63), (5, [nan] + [0.0] * 63), (6, [inf] + [0.0] * 63), (7, [None] + [0.0] * 63), (None, [-0.01] * 64), (8, [2.0**21] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, kmeans.cluster(df)[0].select("vec_id", "v", "distance").collect()), key=str)
    assert got == sorted([(1, [32] * 64, 0)] * 2 + [(None, [-1] * 64, 0)], key=str)
    assert kmeans.summary(df.limit(0)).count() == 0


def test_sql(spark):
    """The registered query and its SQL on the smallest table."""
    from fitloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = QUERIES["op11_kmeans"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({kmeans.ORACLE})").fetchall())
