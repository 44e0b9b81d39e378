"""Pairs of blocks: nothing that grows with the pairs is shuffled or sorted, and places and sums equal brute force."""

import numpy as np
from pyspark.sql import functions as F

from fitloom.operators import blocks as B
from fitloom.operators import pairing as P
from fitloom.operators import scoring as S
from fitloom.plans import matching
from fitloom.sources import shared

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_of_arrays():
    assert np.array_equal(B.rounded(np.array([0.25, 0.35, 2.675, 66.25]), 1), [round(x, 1) for x in (0.25, 0.35, 2.675, 66.25)])


def test_ranking_without_a_window(spark):
    for name in ("overall_rank", "weight_renorm"):
        assert _plan(matching.QUERIES[name](spark, SF)).splitlines()[0].lstrip().startswith(("MapInArrow", "Project"))
        assert "Window" not in _plan(matching.QUERIES[name](spark, SF)).split("MapInArrow")[0]


def test_sums_without_pairs(spark):
    """Jobs and candidates are counted by nation before they meet."""
    plan = _plan(matching.weak_strong_split(spark, SF))
    assert "jd_id" not in plan.split("Join")[0]


def test_first_k_equal_ranking(spark):
    j, r, c = matching.sides(spark, SF)
    every = B.pairs(j, r, "nation", c, P.PLANES, B.ranked(), B.TOTALS + ", rank int").where("rank <= 3").collect()
    first = B.pairs(j, r, "nation", c, P.PLANES, B.ranked(None, 3), B.TOTALS + ", rank int").collect()
    slow = S.rank(S.overall_of(matching.dimensions(spark, SF)), 3).select("jd_id", "resume_id", "overall", "assessable", "verdict", "rank").collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, first)) == sorted(map(tuple, slow))


def test_skills_without_a_name(spark):
    """A skill without a name counts as lacked and comes last."""
    c = P.Codes(spark.createDataFrame([("a",), ("b",)], "canonical string"))
    rows = spark.createDataFrame([(1, "b", 1), (1, None, 1), (1, "a", 2)], "jd_id long, canonical string, pos int")
    got = {x.canonical: (x.code, x.upto0, x.unknown) for x in P.upto(rows, "jd_id", ["pos", F.asc_nulls_last("canonical")], c).collect()}
    assert got == {"b": (1, 2, 0), None: (-1, 2, 1), "a": (0, 3, 1)}
    held = spark.createDataFrame([(7, 1), (8, None)], "resume_id long, held0 long")
    assert sorted((x.resume_id, x.code) for x in P.lacked(held, "held", c).collect()) == [(7, -1), (7, 1), (8, -1), (8, 0), (8, 1)]


def test_equal_first_ranges(spark):
    """Repeated ranges at the beginning of an island are one island, whichever of them comes first."""
    r = spark.createDataFrame([(1, s, e) for s, e in [(10, 12), (10, 12), (10, 20), (15, 30), (40, 41), (40, 41)]], "resume_id long, s int, e int")
    assert [x.months for x in S.merged_months(r, ["resume_id"]).collect()] == [23]


def test_keys_are_dealt_to_tasks(spark, tmp_path):
    """Few bytes of keys make many texts, so that they are dealt to more tasks than their file has."""
    from fitloom.plans import corpus

    spark.range(45_000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    assert corpus.candidates(spark, f"file://{tmp_path}").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert "BroadcastHashJoin" not in corpus.locate_mentions(spark, f"file://{tmp_path}")._jdf.queryExecution().sparkPlan().toString()
    assert shared.AT_ONCE < 10_000


def test_dimensions_are_not_pivoted(spark):
    """Parsed pairs keep their six scores in one row."""
    from fitloom.plans import corpus

    assert "Expand" not in _plan(corpus.pair_dimensions(spark, SF))


def test_lists_of_alike_candidates(spark, tmp_path):
    """Lists that go on in the next Arrow batch give all pairs of their block; a pair takes little room in files."""
    j, r, c = matching.sides(spark, SF)
    some, size = [F.col(f"`{x}`") for x in r.columns if x not in ("resume_id", "nation")], "spark.sql.execution.arrow.maxRecordsPerBatch"
    r = shared.stored(r.crossJoin(spark.range(100)).select((F.col("resume_id") * 100 + F.col("id")).alias("resume_id"), F.when(F.col("resume_id") == 9, None).otherwise(F.col("nation") % 2).alias("nation"), *some), "r")
    j = shared.stored(j.crossJoin(spark.range(5)).withColumn("jd_id", F.col("jd_id") * 5 + F.col("id")).drop("id").withColumn("nation", F.col("nation") % 2), "j")
    before = spark.conf.get(size)
    spark.conf.set(size, "100")
    try:
        path = str(tmp_path / "pairs")
        P.all_pairs(j, r, "nation", c).write.parquet(path)
    finally:
        spark.conf.set(size, before)
    got, whole = spark.read.parquet(path), B.pairs(j, r, "nation", c, P.PLANES, B.dimensions(), B.DIMS)
    digest = lambda df: tuple(df.selectExpr("count(*)", "sum(CAST(xxhash64(*) AS DECIMAL(38,0)))").first())
    assert digest(got) == digest(whole) and got.count() == j.join(r, "nation").count() > 300_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < got.count()
