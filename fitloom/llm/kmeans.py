"""Centroid clustering: Lloyd's rounds with exponion search, exact in integers.

A vector carries its cluster, an upper bound of the distance to its centroid and a lower
bound of the distance to any other.  When centroids move, the bounds move with them.  A
vector whose upper bound is below its lower one, or below half the way to the centroid
nearest to its own, stays without a look at any centroid.  For another the distance to
its own centroid is measured; if that doesn't settle it, only centroids in the ball of
radius 2 * upper + (way to the nearest other centroid) around its own are scanned, a
prefix of the own centroid's list of the others by distance.  The radius is inclusive and
bounds are widened by a little more than rounding can take, so ties are found and go to
the smaller number.  Distances that decide are squared and whole numbers.

The driver holds ``k`` centroids of ``dims`` integers and their lists.  A round is one pass
over the vectors without a shuffle and one sum by cluster with map-side partial sums, so
the size of a cluster doesn't matter; the pass is written to the shared folder, the one
before it removed.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components, or components from 2 ** 21 on (whose squared distances a long can't hold) are
left out; rows equal in id are vectors of their own; rows without an id are clustered as
well, as seeds they come last; with fewer than ``k`` vectors each is a seed; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import materialize, remove, written

SCALE, MOST = 64, 1 << 27
#: More than the relative error of the bounds' few additions and roots.
SLACK = 1e-9
SCHEMA = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long"


def integer_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """``(vec_id, v)``: the usable vectors, each component x as floor(64 * x)."""
    x = lambda c: c.cast("double")
    usable = (F.size("embedding") == dims) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) * SCALE < MOST))
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("embedding", lambda c: F.floor(x(c) * SCALE).cast("int")).alias("v"))


@dataclass(frozen=True)
class Centroids:
    """Centroids, their distances to one another, and for each the others by distance."""

    at: np.ndarray

    def __post_init__(self) -> None:
        apart = np.sqrt(squared(self.at[:, None, :], self.at[None, :, :]).astype(np.float64))
        order = np.argsort(apart, axis=1, kind="stable")
        # The own one first, even where another has the same place.
        order = np.array([[j, *(i for i in row if i != j)] for j, row in enumerate(order)])
        object.__setattr__(self, "order", order)
        object.__setattr__(self, "far", np.take_along_axis(apart, order, 1))
        object.__setattr__(self, "nearest", self.far[:, 1] if len(order) > 1 else np.full(len(order), np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - y
    return (d * d).sum(-1)


def scan_all(v: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, squared distance) by looking at every centroid."""
    d = np.stack([squared(v, m) for m in c.at], axis=1)
    cluster = d.argmin(1)
    own = d[np.arange(len(v)), cluster]
    d[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64)) if len(c.at) > 1 else np.full(len(v), np.inf)
    return cluster, np.sqrt(own.astype(np.float64)), lower, own


def search(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower) given bounds that hold for ``c``; ``counts`` gets the centroids that each vector looked at."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    safe = lambda u, a, low: u * (1 + SLACK) < np.maximum(low, c.nearest[a] / 2) * (1 - SLACK)
    open_ = np.flatnonzero(~safe(upper, cluster, lower))
    own = squared(v[open_], c.at[cluster[open_]])
    upper[open_] = np.sqrt(own.astype(np.float64))
    if counts is not None:
        counts[open_] += 1
    still = ~safe(upper[open_], cluster[open_], lower[open_])
    open_, own = open_[still], own[still]
    start = cluster[open_]
    for a in np.unique(start):
        rows, best = open_[start == a], own[start == a]
        number, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        reach = np.searchsorted(c.far[a], (2 * upper[rows] + c.nearest[a]) * (1 + SLACK), side="right")
        for t in range(1, int(reach.max(initial=0))):
            j, near = c.order[a, t], np.flatnonzero(reach > t)
            d = squared(v[rows[near]], c.at[j])
            if counts is not None:
                counts[rows[near]] += 1
            wins = (d < best[near]) | ((d == best[near]) & (j < number[near]))
            second[near] = np.where(wins, best[near], np.minimum(second[near], d))
            best[near], number[near] = np.where(wins, d, best[near]), np.where(wins, j, number[near])
        cluster[rows], upper[rows] = number, np.sqrt(best.astype(np.float64))
        lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)))
    return cluster, upper, lower


def assigned(rows: DataFrame, c: Centroids, before: Centroids | None) -> DataFrame:
    """Every vector with its cluster, bounds and squared distance; ``before`` has the centroids that the rows' bounds are for."""
    moved = np.zeros(len(c.at)) if before is None else np.sqrt(squared(before.at, c.at).astype(np.float64))
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
    dims = c.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if before is None:
                cluster, upper, lower, own = scan_all(v, c)
            else:
                cluster, upper, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                upper, lower = (upper + moved[cluster]) * (1 + SLACK), np.maximum(0.0, (lower - others[cluster]) * (1 - SLACK))
                cluster, upper, lower = search(v, cluster, upper, lower, c)
                own = squared(v, c.at[cluster])
            parts = [b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(own)]
            yield pa.RecordBatch.from_arrays(parts, names=["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, SCHEMA)


def moved_to_means(rows: DataFrame, c: Centroids) -> Centroids:
    """Each non-empty centroid at its vectors' componentwise floor(sum / count)."""
    dims = c.at.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)])
    at = c.at.copy()
    for r in sums.collect():  # k rows at most
        at[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return Centroids(at)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64) -> tuple[DataFrame, Centroids | None]:
    """``(vec_id, v, cluster, distance)`` of the usable vectors after ``rounds`` rounds and a last assignment, and the final centroids.

    The seeds are the ``k`` vectors with the smallest sha256 of "1:" and their id.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dims), "integer-vectors")
    seeds = rows.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], SCHEMA).drop("upper", "lower"), None
    now, before, path = Centroids(np.array([r["v"] for r in seeds], np.int64)), None, None
    for _ in range(rounds):
        old = path
        rows, path = written(assigned(rows, now, before), "round")
        if old:
            remove(spark, old)
        before, now = now, moved_to_means(rows, now)
    last = materialize(assigned(rows, now, before).drop("upper", "lower"), "assigned")
    if path:
        remove(spark, path)
    return last, now


def summary(vectors: DataFrame) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each usable vector."""
    rows, centroids = cluster(vectors)
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digest = lambda m: hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest()
    facts = [(j, s, sum(sums.values()), digest(centroids.at[j])) for j, s in sums.items()]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 3, k: int = 16) -> str:
    parts = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v AS m FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (SELECT r, vec_id, v, arg_min(c, d * {k} + c) AS cluster, min(d) AS distance FROM (
  SELECT r, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY 1, 2, 3)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY 1),
c{i + 1} AS (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN m{i} n ON n.cluster = o.c)"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = cluster"""
    )


ORACLE = _oracle()
