"""Scoring over relations: strengths, six dimensions, weights, overall scores and rankings.

Every function takes and returns DataFrames keyed by ``jd_id`` and ``resume_id``; a pair is
whatever the caller joins (a blocking key, or one job with all candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions import vocab as V
from fitloom.functions.numeric import py_round

DIMENSIONS = list(V.DEFAULT_WEIGHTS)


def mention_weight(origin: Column, level_score: Column) -> Column:
    """Credibility of one mention in thousandths: by origin, a little more from level 4 on, less up to level 2."""
    base = F.lit(int(V.OTHER_WEIGHT * 1000))
    for name, w in V.ORIGIN_WEIGHT.items():
        base = F.when(origin == name, F.lit(round(w * 1000))).otherwise(base)
    # 850 / 1000 of the fixed weights has no fraction but for .55 and .9, which the exact rounding below settles.
    return F.when(level_score >= 4, F.least(F.lit(1000), base + 50)).when(level_score <= 2, F.round(py_round(base / 1000 * 0.85, 3) * 1000)).otherwise(base).cast("int")


def strength(mentions: DataFrame, dim_parent: DataFrame | None = None) -> DataFrame:
    """``(resume_id, canonical, v)``: the most credible mention in thousandths; parents inherit from their children."""
    own = mentions.groupBy("resume_id", "canonical").agg(F.max(mention_weight(F.col("origin"), F.col("level_score"))).alias("v"))
    if dim_parent is None:
        return own
    up = own.join(dim_parent, own.canonical == dim_parent.child).select("resume_id", F.col("parent").alias("canonical"), "v")
    return own.unionByName(up).groupBy("resume_id", "canonical").agg(F.max("v").alias("v"))


def demand_buckets(mentions: DataFrame) -> DataFrame:
    """``(jd_id, canonical, bucket, pos)``: must if any mention is; the first place among the deciding mentions."""
    must = F.coalesce(F.col("demand"), F.lit("must")) != "nice"
    return (
        mentions.groupBy("jd_id", "canonical")
        .agg(F.bool_or(must).alias("_m"), F.min(F.when(must, F.col("pos"))).alias("_p"), F.min("pos").alias("_q"))
        .select("jd_id", "canonical", F.when(F.col("_m"), F.lit("must")).otherwise("nice").alias("bucket"), F.when(F.col("_m"), F.col("_p")).otherwise(F.col("_q")).alias("pos"))
    )


def matches(pairs: DataFrame, required: DataFrame, strengths: DataFrame) -> DataFrame:
    """``(jd_id, resume_id, canonical, bucket, pos, v, state)`` for each required skill of each pair; v is 0 where absent."""
    r = pairs.join(required, "jd_id").join(strengths, ["resume_id", "canonical"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    state = F.when(F.col("v") >= int(V.STRONG * 1000), F.lit("matched")).when(F.col("v") > 0, F.lit("weak")).otherwise("missing")
    return r.select("jd_id", "resume_id", "canonical", "bucket", "pos", "v", state.alias("state"))


def coverage_score(v: Column, n: Column) -> Column:
    return F.when(n > 0, py_round(v / 1000 / n * 100, 1))


def coverage(matched: DataFrame, bucket: str) -> DataFrame:
    """``(jd_id, resume_id, n, n_matched, n_weak, n_missing, score)`` for the pairs that have requirements of a bucket."""
    count = lambda s: F.sum((F.col("state") == s).cast("long"))
    return (
        matched.where(F.col("bucket") == bucket)
        .groupBy("jd_id", "resume_id")
        .agg(F.count("*").alias("n"), count("matched").alias("n_matched"), count("weak").alias("n_weak"), count("missing").alias("n_missing"), F.sum("v").alias("_v"))
        .withColumn("score", py_round(F.col("_v") / 1000 / F.col("n") * 100, 1))
        .drop("_v")
    )


def merged_months(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, months)``: months covered by ``(s, e)`` month indexes, both ends included, adjoining ranges merged.

    Reversed ranges and those above thirty years don't count; groups that hold nothing else give 0.
    """
    ok = (F.col("e") >= F.col("s")) & (F.col("e") - F.col("s") <= 360)
    r = ranges.select(*keys, F.when(ok, F.col("s")).alias("s"), F.when(ok, F.col("e")).alias("e"))
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = r.withColumn("_new", F.coalesce(F.col("s") > before + 1, F.lit(True)).cast("int"))
    islands = flagged.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = islands.groupBy(*keys, "_i").agg((F.max("e") - F.min("s") + 1).alias("_n"))
    return each.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("months"))


def effective_years(seniority: Column, degree_expected: Column, total_years: Column, work_years: Column, intern_months: Column) -> Column:
    entry = F.coalesce(seniority.isin(*V.ENTRY_LEVEL), F.lit(False)) | F.coalesce(degree_expected, F.lit(False))
    return F.when(entry, total_years).otherwise(py_round(work_years + intern_months / 12 * 0.5, 1))


def experience_score(need: Column, have: Column) -> Column:
    """Full marks from the need on, half at half of it, straight lines between; null without a need."""
    half = need * 0.5
    return (
        F.when(need.isNull(), F.lit(None).cast("double"))
        .when((need <= 0) | (have >= need), F.lit(100.0))
        .when(have >= half, py_round(F.lit(50) + (have - half) / half * 50, 1))
        .otherwise(py_round(have / half * 50, 1))
    )


def education_score(need: Column, have: Column) -> Column:
    """Null without a need; one level short 55, further short 20, unknown 0 (one short is tested first)."""
    return F.when(need > 0, F.when(have >= need, F.lit(100.0)).when(have == need - 1, F.lit(55.0)).when(have > 0, F.lit(20.0)).otherwise(F.lit(0.0)))


def domain_score(n_required: Column, n_matched: Column, resume_has_domains: Column) -> Column:
    return F.when(n_required > 0, F.when(n_matched > 0, py_round(n_matched / n_required * 100, 1)).when(resume_has_domains, F.lit(45.0)).otherwise(F.lit(55.0)))


def project_score(n_jd: Column, n_overlap: Column, n_bullets: Column, n_quantified: Column) -> Column:
    """Four fifths for required skills used in experiences, one fifth for quantified bullets."""
    tech = F.when(n_jd > 0, n_overlap / n_jd).otherwise(F.lit(0.0))
    quant = F.when(n_bullets > 0, n_quantified / n_bullets).otherwise(F.lit(0.0))
    return py_round((tech * 0.8 + quant * 0.2) * 100, 1)


def default_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(V.DEFAULT_WEIGHTS.items())], "dim_no int, key string, default_weight double")


def normalize_weights(dims: DataFrame, weights: DataFrame | None = None, keys: tuple[str, ...] = ("jd_id", "resume_id")) -> DataFrame:
    """``dims(*keys, key, score, applicable)`` with weights that sum to 1 over the applicable dimensions.

    ``weights(key, weight)`` overrides defaults; unusable numbers (texts, infinity) fall back,
    negative ones and those that are not a number count 0.  If all active weights are 0 the defaults share; with no dimension applicable
    all are 0.
    """
    w = default_weights(dims.sparkSession)
    if weights is not None:
        given = F.col("weight").cast("string").try_cast("double")
        w = w.join(weights.select("key", F.when(given != float("inf"), F.nanvl(given, F.lit(0.0))).alias("_w")), "key", "left").withColumn("_w", F.coalesce("_w", "default_weight"))
    else:
        w = w.withColumn("_w", F.col("default_weight"))
    d = dims.join(F.broadcast(w.withColumn("_w", F.greatest(F.lit(0.0), "_w"))), "key")
    pair = Window.partitionBy(*keys)
    active = F.sum(F.when(F.col("applicable"), F.col("_w")).otherwise(0.0)).over(pair)
    fallback = F.sum(F.when(F.col("applicable"), F.col("default_weight")).otherwise(0.0)).over(pair)
    share = F.when(active > 0, F.col("_w") / active).when(fallback > 0, F.col("default_weight") / fallback).otherwise(0.0)
    return d.withColumn("weight", F.when(F.col("applicable"), share).otherwise(0.0)).drop("_w", "default_weight")


def weight_values(weights: dict | None = None) -> dict[str, float]:
    """A weight for each dimension by the rules of ``normalize_weights``, before they are made to sum to 1."""
    out = {}
    for key, default in V.DEFAULT_WEIGHTS.items():
        try:
            value = float((weights or {}).get(key, default))
        except (TypeError, ValueError):
            value = default
        out[key] = default if value == float("inf") else value if value > 0 else 0.0
    return out


def shares(weights: dict | None = None) -> list[list[float]]:
    """For each set of applicable dimensions (bit i: the i-th) all dimensions' weights, summing to 1 but where none applies."""
    w, out = weight_values(weights), []
    for which in range(1 << len(DIMENSIONS)):
        on = [k for i, k in enumerate(DIMENSIONS) if which >> i & 1]
        use = w if sum(w[k] for k in on) > 0 else V.DEFAULT_WEIGHTS
        total = sum(use[k] for k in on)
        out.append([use[k] / total if k in on and total > 0 else 0.0 for k in DIMENSIONS])
    return out


def _which() -> Column:
    """The set of a wide row's applicable dimensions, as its place in ``shares``."""
    return sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(DIMENSIONS)), F.lit(1))


def wide_weights(wide: DataFrame, weights: dict | None = None) -> DataFrame:
    """``wide`` (a column for each dimension, null where it doesn't apply) with ``w_*``: weights at four decimals, looked up by the set of applicable dimensions."""
    table = shares(weights)
    w = {f"w_{k}": F.element_at(F.array(*[F.lit(round(row[i], 4)) for row in table]), F.col("_which")) for i, k in enumerate(DIMENSIONS)}
    return wide.withColumn("_which", _which()).withColumns(w).drop("_which")


def overall_of(wide: DataFrame, weights: dict | None = None) -> DataFrame:
    """``(jd_id, resume_id, overall, assessable, verdict)`` from wide dimension scores, row by row: no join, no window, no shuffle."""
    parts = wide_weights(wide, weights).select("jd_id", "resume_id", *DIMENSIONS, *[(F.coalesce(k, F.lit(0.0)) * F.col(f"w_{k}")).alias(f"p_{k}") for k in DIMENSIONS])
    cents = sum((F.rint(py_round(F.col(f"p_{k}"), 2) * 100).cast("long") for k in DIMENSIONS), F.lit(0).cast("long"))
    some = F.coalesce(*DIMENSIONS).isNotNull()
    total = parts.select("jd_id", "resume_id", (cents / 100).alias("_t"), some.alias("assessable")).select("jd_id", "resume_id", py_round(F.col("_t"), 1).alias("overall"), "assessable")
    return total.withColumn("verdict", verdict(F.col("overall")))


def weighted(dims: DataFrame) -> DataFrame:
    """The contribution of each dimension: score times its weight at four decimals, at two decimals."""
    return dims.withColumn("weight", py_round(F.col("weight"), 4)).withColumn("weighted", py_round(F.coalesce("score", F.lit(0.0)) * F.col("weight"), 2))


def verdict(score: Column) -> Column:
    out = F.lit("D")
    for least, name in reversed(V.VERDICTS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def overall(dims: DataFrame, keys: tuple[str, ...] = ("jd_id", "resume_id")) -> DataFrame:
    """``(*keys, overall, verdict, assessable)`` from weighted dimensions; hundredths are summed exactly."""
    total = F.sum(F.round(F.col("weighted") * 100).cast("long")) / 100
    return dims.groupBy(*keys).agg(py_round(total, 1).alias("overall"), F.bool_or("applicable").alias("assessable")).withColumn("verdict", verdict(F.col("overall")))


def rank(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Candidates of each job by falling overall score, ties in input order (resume_id)."""
    r = scores.withColumn("rank", F.row_number().over(Window.partitionBy("jd_id").orderBy(F.desc("overall"), "resume_id")))
    return r if k is None else r.where(F.col("rank") <= k)


def recompute(dims: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Overall scores under other weights, from stored dimension scores alone."""
    return overall(weighted(normalize_weights(dims.select("jd_id", "resume_id", "key", "score", "applicable"), weights)))


def extra_skills(pairs: DataFrame, required: DataFrame, strengths: DataFrame) -> DataFrame:
    """Skills of a candidate that the job doesn't ask for, the strongest first."""
    r = pairs.join(strengths, "resume_id").join(required.select("jd_id", "canonical").distinct(), ["jd_id", "canonical"], "left_anti")
    return r.withColumn("pos", F.row_number().over(Window.partitionBy("jd_id", "resume_id").orderBy(F.desc("v"), "canonical")))


def top_evidence(mentions: DataFrame, k: int = 4) -> DataFrame:
    """``(resume_id, canonical, evidence, pos)``: distinct snippets, the most credible origins first, k at most for a candidate."""
    w = F.lit(int(V.OTHER_WEIGHT * 1000))
    for name, x in V.ORIGIN_WEIGHT.items():
        w = F.when(F.col("origin") == name, F.lit(round(x * 1000))).otherwise(w)
    m = mentions.where(F.coalesce("evidence", F.lit("")) != "").withColumn("_w", w)
    once = m.withColumn("_n", F.row_number().over(Window.partitionBy("resume_id", "evidence").orderBy(F.desc("_w"), "start"))).where("_n = 1")
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("resume_id").orderBy(F.desc("_w"), "start", "canonical", "evidence"))).where(F.col("pos") <= k).select("resume_id", "canonical", "evidence", "pos")
