"""Queries of the scoring core over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions.numeric import py_round
from fitloom.operators import blocks as B
from fitloom.operators import dictionary as DI
from fitloom.operators import pairing as P
from fitloom.operators import scoring as S
from fitloom.plans import star
from fitloom.plans.star import sql, table
from fitloom.sources import shared
from fitloom.sources.scores import SCHEMA

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MATCH = ("mentions", "own", "parents", "strength", "jdm", "required", "pairs", "matches")


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r1(x: str) -> str:
    """SQL of the exact rounding at one decimal."""
    return f"CAST(format('{{:.1f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def strengths(spark: SparkSession, d: str) -> DataFrame:
    return S.strength(star.mentions(spark, d), star.parents(spark))


def matched(spark: SparkSession, d: str) -> DataFrame:
    return S.matches(star.pairs(spark, d), S.demand_buckets(star.jd_mentions(spark, d)), strengths(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    """``(resume_id, canonical, v, used, area, n, q)``: strength, use in experiences, a mention of level 4 or more, mentions, those of level 5.

    Mentions are read once: each gives a row for its skill and one for each parent, which takes over strength and use alone.
    """
    up = star.parents(spark).groupBy("child").agg(F.collect_list("parent").alias("up"))
    m = star.mentions(spark, d).join(F.broadcast(up), F.col("canonical") == F.col("child"), "left")
    level, none = F.coalesce("level_score", F.lit(0)), F.array().cast("array<string>")
    rows = m.select(
        "resume_id", F.posexplode(F.concat(F.array("canonical"), F.coalesce("up", none))).alias("i", "canonical"), S.mention_weight(F.col("origin"), F.col("level_score")).alias("v"),
        (F.col("origin") == "experience").alias("used"), level.alias("level"),
    )
    own = F.col("i") == 0
    return rows.groupBy("resume_id", "canonical").agg(
        F.max("v").alias("v"), F.bool_or("used").alias("used"), F.bool_or(own & (F.col("level") >= 4)).alias("area"), F.sum(own.cast("long")).alias("n"), F.sum((own & (F.col("level") == 5)).cast("long")).alias("q")
    )


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_nationkey").alias("nation"))


def job_nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("jd_id"), F.col("s_nationkey").alias("nation"))


def holders(spark: SparkSession, d: str, c: P.Codes) -> DataFrame:
    """``(resume_id, nation, held*)`` of all candidates, those without any skill too."""
    return nations(spark, d).join(P.held_masks(strengths(spark, d), c), "resume_id", "left").fillna(0, c.columns("held"))


def codes(spark: SparkSession, d: str) -> P.Codes:
    """The dictionary: all brands and the parents that are none."""
    return P.Codes(table(spark, d, "part").select(F.col("p_brand").alias("canonical")).unionByName(star.parents(spark).select(F.col("parent").alias("canonical"))))


def required(spark: SparkSession, d: str) -> DataFrame:
    """What jobs ask for; their domains are skills of brand 5."""
    return S.demand_buckets(star.jd_mentions(spark, d)).withColumn("area", F.col("canonical").endswith("5"))


def jobs(spark: SparkSession, d: str, c: P.Codes) -> DataFrame:
    """A row for each job: nation, skills as bits."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("jd_id"), F.col("s_nationkey").alias("nation"))
    return s.join(P.job_masks(required(spark, d), c), "jd_id", "left")


def candidates(spark: SparkSession, d: str, c: P.Codes) -> DataFrame:
    """A row for each candidate: nation, skills as bits, bullets ``b`` and quantified ones ``q`` (null without any mention)."""
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_nationkey").alias("nation"))
    return n.join(P.candidate_masks(features(spark, d), c, ("n", "q")).withColumnRenamed("n", "b"), "resume_id", "left")


def masked(spark: SparkSession, d: str, asked: list[str], told: list[str]) -> tuple[DataFrame, P.Codes]:
    """All pairs of a nation with sets ``asked`` of jobs and columns and sets ``told`` of candidates, empty where a side has none."""
    c = codes(spark, d)

    def of(side: DataFrame, key: str, names: list[str]) -> DataFrame:
        sets = [x for n in names for x in ([n] if n in side.columns else c.columns(n))]
        numbers = [x for x in sets if x not in names]
        return side.select(key, "nation", *sets).fillna(0, numbers)

    return P.meet(of(jobs(spark, d, c), "jd_id", asked), of(candidates(spark, d, c), "resume_id", told), ["nation"]), c


def pair_coverage(spark: SparkSession, d: str, bucket: str) -> DataFrame:
    p, c = masked(spark, d, [bucket], [*[f"plane{b}_" for b in range(P.PLANES)], "held", "strong"])
    held = c.count(bucket, "held")
    k = p.select("jd_id", "resume_id", c.size(bucket).alias("n"), c.count(bucket, "strong").alias("m"), held.alias("h"), c.strength(bucket).alias("v")).where("n > 0")
    n = lambda x: x.cast("long")
    return k.select("jd_id", "resume_id", n(F.col("n")).alias("n"), n(F.col("m")).alias("n_matched"), n(F.col("h") - F.col("m")).alias("n_weak"), n(F.col("n") - F.col("h")).alias("n_missing"), S.coverage_score(F.col("v"), F.col("n")).alias("score"))


@query(sql("mentions", "own") + "SELECT resume_id, canonical, v AS strength FROM own")
def skill_strength(spark: SparkSession, d: str) -> DataFrame:
    return S.strength(star.mentions(spark, d)).withColumnRenamed("v", "strength")


@query(sql("mentions", "own", "parents", "strength") + "SELECT resume_id, canonical, v AS strength FROM strength")
def parent_inheritance(spark: SparkSession, d: str) -> DataFrame:
    return strengths(spark, d).withColumnRenamed("v", "strength")


@query(sql("jdm", "required") + "SELECT * FROM required")
def demand_bucket(spark: SparkSession, d: str) -> DataFrame:
    return S.demand_buckets(star.jd_mentions(spark, d))


_COVER = "SELECT jd_id, resume_id, count(*) AS n, count(*) FILTER (WHERE state='matched') AS n_matched, count(*) FILTER (WHERE state='weak') AS n_weak, count(*) FILTER (WHERE state='missing') AS n_missing, {} AS score FROM matches WHERE bucket='{}' GROUP BY 1,2"


@query(sql(*MATCH) + _COVER.format(_r1("sum(v)::DOUBLE/1000/count(*)*100"), "must"))
def must_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pair_coverage(spark, d, "must")


@query(sql(*MATCH) + _COVER.format(_r1("sum(v)::DOUBLE/1000/count(*)*100"), "nice"))
def nice_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pair_coverage(spark, d, "nice")


@query(sql(*MATCH) + "SELECT jd_id, resume_id, canonical FROM matches WHERE state='missing' AND bucket='must'")
def missing_skills(spark: SparkSession, d: str) -> DataFrame:
    c = codes(spark, d)
    j = c.of(S.demand_buckets(star.jd_mentions(spark, d)).where("bucket = 'must'")).withColumn("code", F.coalesce("code", F.lit(-1)))
    return P.meet(j.join(job_nations(spark, d), "jd_id"), P.lacked(holders(spark, d, c), "held", c).select("resume_id", "nation", "code"), ["nation", "code"]).select("jd_id", "resume_id", "canonical")


@query(sql(*MATCH) + "SELECT jd_id, resume_id, canonical, v, CAST(row_number() OVER (PARTITION BY jd_id, resume_id ORDER BY CASE bucket WHEN 'must' THEN 0 ELSE 1 END, pos, canonical) AS INTEGER) AS rank FROM matches WHERE v>0")
def matched_skills(spark: SparkSession, d: str) -> DataFrame:
    c = codes(spark, d)
    j = P.upto(S.demand_buckets(star.jd_mentions(spark, d)), "jd_id", [F.when(F.col("bucket") == "must", 0).otherwise(1), "pos", F.asc_nulls_last("canonical")], c).where("code >= 0").drop("bucket", "pos", "unknown")
    held = c.of(strengths(spark, d)).where("code is not null and v > 0").select("resume_id", "code", "v")
    pairs = P.meet(j.join(job_nations(spark, d), "jd_id"), held.join(holders(spark, d, c), "resume_id"), ["nation", "code"])
    # A skill's place is the number of held ones up to it.
    return pairs.select("jd_id", "resume_id", "canonical", "v", c.count("held", "upto").alias("rank"))


@query(sql(*MATCH) + "SELECT p.jd_id, p.resume_id, s.canonical, s.v, CAST(row_number() OVER (PARTITION BY p.jd_id, p.resume_id ORDER BY s.v DESC, s.canonical) AS INTEGER) AS pos FROM pairs p JOIN strength s USING (resume_id) WHERE NOT EXISTS (SELECT 1 FROM required r WHERE r.jd_id=p.jd_id AND r.canonical=s.canonical)")
def extra_skills(spark: SparkSession, d: str) -> DataFrame:
    c = codes(spark, d)
    # A candidate's skills meet the jobs that don't ask for them; a skill's place is the number of such ones up to it.
    held = P.upto(strengths(spark, d), "resume_id", [F.desc("v"), F.asc_nulls_last("canonical")], c).join(nations(spark, d), "resume_id")
    free = [F.bitwise_not(F.coalesce(a, F.lit(0).cast("long"))).alias(f) for a, f in zip(c.columns("all"), c.columns("free"), strict=True)]
    j = P.lacked(jobs(spark, d, c), "all", c).select("jd_id", "nation", "code", *free)
    pos = c.count("free", "upto") + F.col("unknown")
    return P.meet(j, held, ["nation", "code"]).select("jd_id", "resume_id", "canonical", "v", pos.alias("pos"))


@query(sql(*MATCH) + "SELECT state, bucket, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM matches GROUP BY 1,2")
def weak_strong_split(spark: SparkSession, d: str) -> DataFrame:
    """Sums over all pairs without a pair: jobs that ask for a skill times candidates that hold it, by nation and skill."""
    asked = S.demand_buckets(star.jd_mentions(spark, d)).join(job_nations(spark, d), "jd_id").groupBy("nation", "canonical", "bucket").agg(F.count("*").alias("jobs"))
    strong, v = F.col("v") >= int(S.V.STRONG * 1000), F.col("v").cast("long")
    held = strengths(spark, d).join(nations(spark, d), "resume_id").groupBy("nation", "canonical").agg(
        *[F.count(F.when(on, 1)).alias(n) for n, on in (("matched", strong), ("weak", ~strong & (v > 0)))], *[F.coalesce(F.sum(F.when(on, v)), F.lit(0)).alias(f"{n}_v") for n, on in (("matched", strong), ("weak", ~strong))]
    )
    people = nations(spark, d).groupBy("nation").agg(F.count("*").alias("people"))
    rows = asked.join(people, "nation").join(held, ["nation", "canonical"], "left").fillna(0, ["matched", "weak", "matched_v", "weak_v"])
    states = F.array(
        F.struct(F.lit("matched").alias("state"), F.col("matched").alias("k"), F.col("matched_v").alias("s")), F.struct(F.lit("weak").alias("state"), F.col("weak").alias("k"), F.col("weak_v").alias("s")),
        F.struct(F.lit("missing").alias("state"), (F.col("people") - F.col("matched") - F.col("weak")).alias("k"), F.lit(0).cast("long").alias("s")),
    )
    return rows.select("bucket", "jobs", F.inline(states)).where("k > 0").groupBy("state", "bucket").agg(F.sum(F.col("jobs") * F.col("k")).alias("n"), F.sum(F.col("jobs") * F.col("s")).alias("v"))


@query(sql("ranges", "months") + "SELECT * FROM months")
def experience_months(spark: SparkSession, d: str) -> DataFrame:
    return S.merged_months(star.ranges(spark, d), ["resume_id"])


#: Years by kind: lines of status F count as work, the others as internship.
_YEARS = """, byk AS (SELECT resume_id, kind, sum(n) AS months FROM (SELECT resume_id, kind, max(e)-min(s)+1 AS n FROM (SELECT *, sum(f) OVER (PARTITION BY resume_id, kind ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY resume_id, kind ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+1 THEN 0 ELSE 1 END AS f FROM ranges WHERE e>=s AND e-s<=360)) GROUP BY resume_id, kind, i) GROUP BY 1,2),
years AS (SELECT m.resume_id, """ + _r1("m.months/12.0") + """ AS total_years, """ + _r1("coalesce(w.months,0)/12.0") + """ AS work_years, CAST(coalesce(i.months,0) AS BIGINT) AS intern_months, m.resume_id%5=0 AS degree_expected
  FROM months m LEFT JOIN byk w ON w.resume_id=m.resume_id AND w.kind='F' LEFT JOIN byk i ON i.resume_id=m.resume_id AND i.kind='O'),
eff AS (SELECT resume_id, CASE WHEN degree_expected THEN total_years ELSE """ + _r1("work_years + CAST(intern_months AS DOUBLE)/12*0.5") + """ END AS have FROM years)
"""


#: Ranges that a task sorts, twice, at most about: ranges of copies are so alike that partitions small in bytes hold many.
RANGES_OF_TASK = 500_000


def dealt_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges dealt by candidate to more tasks as they grow; a number that is given is kept as it is, so tasks aren't brought together again by their bytes."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // RANGES_OF_TASK))
    return star.ranges(spark, d).repartition(tasks, "resume_id")


def years(spark: SparkSession, d: str) -> DataFrame:
    # Dealt once by candidate, which serves both groupings.
    r = dealt_ranges(spark, d)
    kind = S.merged_months(r, ["resume_id", "kind"])
    of = lambda k, n: F.sum(F.when(F.col("kind") == k, F.col("months")).otherwise(0)).alias(n)
    y = S.merged_months(r, ["resume_id"]).join(kind.groupBy("resume_id").agg(of("F", "w"), of("O", "i")), "resume_id")
    return y.select(
        "resume_id",
        py_round(F.col("months") / 12, 1).alias("total_years"),
        py_round(F.col("w") / 12, 1).alias("work_years"),
        F.col("i").cast("long").alias("intern_months"),
        (F.col("resume_id") % 5 == 0).alias("degree_expected"),
    )


def have_years(spark: SparkSession, d: str) -> DataFrame:
    e = S.effective_years(F.lit(None).cast("string"), F.col("degree_expected"), F.col("total_years"), F.col("work_years"), F.col("intern_months"))
    return years(spark, d).select("resume_id", e.alias("have"))


@query(sql("ranges", "months") + _YEARS + "SELECT * FROM eff")
def effective_years(spark: SparkSession, d: str) -> DataFrame:
    return have_years(spark, d)


_EXP = "CASE WHEN need<=0 OR have>=need THEN 100.0 WHEN have>=need*0.5 THEN " + _r1("50+(have-need*0.5)/(need*0.5)*50") + " ELSE " + _r1("have/(need*0.5)*50") + " END"
#: What a job needs: years by its key (none for every seventh), a level, domains by its brands' categories.
_NEEDS = """, needs AS (SELECT s_suppkey AS jd_id, CASE WHEN s_suppkey%7=0 THEN NULL ELSE CAST(s_suppkey%9 AS DOUBLE) END AS need, CAST(s_suppkey%5 AS INTEGER) AS need_level FROM supplier),
levels AS (SELECT c_custkey AS resume_id, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS INTEGER) AS have_level FROM customer)
"""


def needs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("jd_id"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 9).cast("double")).alias("need"), (F.col("s_suppkey") % 5).cast("int").alias("need_level"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    out = F.lit(4)
    for i, name in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")):
        out = F.when(F.col("c_mktsegment") == name, F.lit(i)).otherwise(out)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("resume_id"), out.alias("have_level"))


@query(sql("ranges", "months", "pairs") + _YEARS + _NEEDS + f"SELECT p.jd_id, p.resume_id, CASE WHEN need IS NULL THEN NULL ELSE {_EXP} END AS score FROM pairs p JOIN needs USING (jd_id) JOIN eff USING (resume_id)")
def experience_score(spark: SparkSession, d: str) -> DataFrame:
    # Each side is complete before pairs are made, so that no pair is shuffled.
    j, r = needs(spark, d).join(job_nations(spark, d), "jd_id"), have_years(spark, d).join(nations(spark, d), "resume_id")
    return P.meet(j, r, ["nation"]).select("jd_id", "resume_id", S.experience_score(F.col("need"), F.col("have")).alias("score"))


_EDU = "CASE WHEN need_level>0 THEN CASE WHEN have_level>=need_level THEN 100.0 WHEN have_level=need_level-1 THEN 55.0 WHEN have_level>0 THEN 20.0 ELSE 0.0 END END"


@query(sql("pairs") + _NEEDS + f"SELECT p.jd_id, p.resume_id, CAST({_EDU} AS DOUBLE) AS score FROM pairs p JOIN needs USING (jd_id) JOIN levels USING (resume_id)")
def education_score(spark: SparkSession, d: str) -> DataFrame:
    j, r = needs(spark, d).join(job_nations(spark, d), "jd_id"), levels(spark, d).join(nations(spark, d), "resume_id")
    return P.meet(j, r, ["nation"]).select("jd_id", "resume_id", S.education_score(F.col("need_level"), F.col("have_level")).alias("score"))


_DOMAINS = """, jdd AS (SELECT DISTINCT jd_id, canonical AS domain FROM jdm WHERE canonical LIKE '%5'),
resd AS (SELECT DISTINCT resume_id, canonical AS domain FROM mentions WHERE level_score>=4)
"""
_DOM = """SELECT p.jd_id, p.resume_id, count(*) AS n, count(r.domain) AS n_matched, CASE WHEN count(r.domain)>0 THEN """ + _r1("count(r.domain)::DOUBLE/count(*)*100") + """
 WHEN bool_or(h.resume_id IS NOT NULL) THEN 45.0 ELSE 55.0 END AS score
 FROM pairs p JOIN jdd j USING (jd_id) LEFT JOIN resd r ON r.resume_id=p.resume_id AND r.domain=j.domain LEFT JOIN (SELECT DISTINCT resume_id FROM resd) h ON h.resume_id=p.resume_id GROUP BY 1,2"""


def domains(spark: SparkSession, d: str) -> DataFrame:
    p, c = masked(spark, d, ["area"], ["has", "any_area"])
    k = p.select("jd_id", "resume_id", c.size("area").cast("long").alias("n"), c.count("area", "has").cast("long").alias("n_matched"), F.coalesce("any_area", F.lit(False)).alias("any")).where("n > 0")
    return k.select("jd_id", "resume_id", "n", "n_matched", S.domain_score(F.col("n"), F.col("n_matched"), F.col("any")).alias("score"))


@query(sql("mentions", "jdm", "pairs") + _DOMAINS + _DOM)
def domain_score(spark: SparkSession, d: str) -> DataFrame:
    return domains(spark, d)


#: Experiences: mentions of origin "experience"; bullets are all lines, quantified those of level 5.
_PROJ = """, exps AS (SELECT DISTINCT resume_id, canonical FROM (SELECT resume_id, canonical FROM mentions WHERE origin='experience' UNION ALL SELECT resume_id, parent FROM mentions JOIN parents ON canonical=child WHERE origin='experience')),
bul AS (SELECT resume_id, count(*) AS n, count(*) FILTER (WHERE level_score=5) AS q FROM mentions GROUP BY 1),
proj AS (SELECT p.jd_id, p.resume_id, """ + _r1("((CASE WHEN count(r.canonical)>0 THEN count(e.canonical)::DOUBLE/count(r.canonical) ELSE 0 END)*0.8 + any_value(b.q)::DOUBLE/any_value(b.n)*0.2)*100") + """ AS score
 FROM pairs p JOIN bul b USING (resume_id) LEFT JOIN required r ON r.jd_id=p.jd_id LEFT JOIN exps e ON e.resume_id=p.resume_id AND e.canonical=r.canonical GROUP BY 1,2)
"""


def projects(spark: SparkSession, d: str) -> DataFrame:
    p, c = masked(spark, d, ["all"], ["used", "b", "q"])
    k = p.where("b is not null").select("jd_id", "resume_id", c.size("all").alias("n"), c.count("all", "used").alias("h"), "b", "q")
    return k.select("jd_id", "resume_id", S.project_score(F.col("n"), F.col("h"), F.col("b"), F.col("q")).alias("score"))


@query(sql("mentions", "parents", "jdm", "required", "pairs") + _PROJ + "SELECT * FROM proj")
def project_score(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d)


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, P.Codes]:
    """(jobs, candidates, codes) with all that the six dimensions look at."""
    c = codes(spark, d)
    people = candidates(spark, d, c).join(have_years(spark, d), "resume_id", "left").join(levels(spark, d), "resume_id", "left")
    return jobs(spark, d, c).join(needs(spark, d), "jd_id"), people, c


def dimensions(spark: SparkSession, d: str) -> DataFrame:
    """``(jd_id, resume_id, *dimensions)``: all six dimensions of all pairs, null where one isn't applicable."""
    j, r, c = sides(spark, d)
    return P.all_pairs(j, r, "nation", c)


_DIMS = _YEARS + _NEEDS + _DOMAINS + ", dom AS (" + _DOM + ")" + _PROJ + f""", dims AS (
 SELECT p.jd_id, p.resume_id, k.key, coalesce(k.score,0) AS score, k.score IS NOT NULL AS applicable FROM pairs p,
 LATERAL (SELECT 'must_have' AS key, (SELECT {_r1("sum(v)::DOUBLE/1000/count(*)*100")} FROM matches m WHERE m.jd_id=p.jd_id AND m.resume_id=p.resume_id AND bucket='must') AS score
  UNION ALL SELECT 'nice_to_have', (SELECT {_r1("sum(v)::DOUBLE/1000/count(*)*100")} FROM matches m WHERE m.jd_id=p.jd_id AND m.resume_id=p.resume_id AND bucket='nice')
  UNION ALL SELECT 'experience', (SELECT CASE WHEN need IS NULL THEN NULL ELSE {_EXP} END FROM (SELECT n.need, coalesce(e.have,0.0) AS have FROM needs n LEFT JOIN eff e ON e.resume_id=p.resume_id WHERE n.jd_id=p.jd_id))
  UNION ALL SELECT 'education', (SELECT {_EDU} FROM needs n, levels l WHERE n.jd_id=p.jd_id AND l.resume_id=p.resume_id)
  UNION ALL SELECT 'domain', (SELECT score FROM dom x WHERE x.jd_id=p.jd_id AND x.resume_id=p.resume_id)
  UNION ALL SELECT 'project', (SELECT score FROM proj x WHERE x.jd_id=p.jd_id AND x.resume_id=p.resume_id)) k),
wts AS (SELECT * FROM (VALUES ('must_have',0.35::DOUBLE),('nice_to_have',0.12),('experience',0.18),('education',0.12),('domain',0.13),('project',0.10)) t(key,w)),
norm AS (SELECT d.*, CASE WHEN applicable THEN CAST(format('{{:.4f}}', w/sum(CASE WHEN applicable THEN w ELSE 0 END) OVER (PARTITION BY jd_id, resume_id)) AS DOUBLE) ELSE 0 END AS weight FROM dims d JOIN wts USING (key)),
wtd AS (SELECT *, CAST(format('{{:.2f}}', score*weight) AS DOUBLE) AS weighted FROM norm),
tot AS (SELECT jd_id, resume_id, {_r1("CAST(sum(CAST(round(weighted*100) AS BIGINT)) AS DOUBLE)/100")} AS overall, bool_or(applicable) AS assessable FROM wtd GROUP BY 1,2),
ranked AS (SELECT *, CASE WHEN overall>=85 THEN 'A' WHEN overall>=70 THEN 'B' WHEN overall>=55 THEN 'C' ELSE 'D' END AS verdict, CAST(row_number() OVER (PARTITION BY jd_id ORDER BY overall DESC, resume_id) AS INTEGER) AS rank FROM tot)
"""
_ALL = ("mentions", "own", "parents", "strength", "jdm", "required", "pairs", "matches", "ranges", "months")


@query(sql(*_ALL) + _DIMS + "SELECT jd_id, resume_id, key, score, applicable, weight FROM norm")
def weight_renorm(spark: SparkSession, d: str) -> DataFrame:
    j, r, c = sides(spark, d)
    return B.pairs(j, r, "nation", c, P.PLANES, B.weighted(), B.LONG, whole=False)


@query(sql(*_ALL) + _DIMS + "SELECT jd_id, resume_id, overall, assessable, verdict, rank FROM ranked")
def overall_rank(spark: SparkSession, d: str) -> DataFrame:
    j, r, c = sides(spark, d)
    return B.pairs(j, r, "nation", c, P.PLANES, B.ranked(), B.TOTALS + ", rank int")


@query(sql(*_ALL) + _DIMS + "SELECT jd_id, resume_id, overall, verdict, rank FROM ranked WHERE rank<=5")
def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    j, r, c = sides(spark, d)
    return P.best_of_alike(j, r, "nation", c, 5).select("jd_id", "resume_id", "overall", "verdict", "rank")


_CUSTOM = [("must_have", "0.5"), ("nice_to_have", "0"), ("experience", "-1"), ("education", "oops"), ("project", "0.3")]


@query(sql(*_ALL) + _DIMS.replace("('must_have',0.35::DOUBLE),('nice_to_have',0.12),('experience',0.18),('education',0.12),('domain',0.13),('project',0.10)", "('must_have',0.5::DOUBLE),('nice_to_have',0),('experience',0),('education',0.12),('domain',0.13),('project',0.3)").replace("ELSE 0 END AS weight FROM dims", "ELSE 0 END AS weight FROM dims") + "SELECT jd_id, resume_id, overall, verdict FROM ranked")
def recompute_weights(spark: SparkSession, d: str) -> DataFrame:
    """Other weights over the stored scores; nothing but that table is read once it is there."""
    return B.totals_of(stored_scores(spark, d), dict(_CUSTOM)).select("jd_id", "resume_id", "overall", "verdict")


def stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """The application's table of the pairs' dimension scores, written at the first call as tasks make them: totals need no buckets, which would shuffle and sort every pair."""
    path = f"{shared.folder(spark)}/{shared.name_for(d)}-scores"
    if not shared.exists(spark, path):
        dimensions(spark, d).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@query(sql("mentions") + """SELECT resume_id, canonical, origin||':'||canonical||':'||coalesce(CAST(level_score AS VARCHAR),'') AS evidence, pos FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY w DESC, start, canonical, level_score NULLS FIRST) AS INTEGER) AS pos FROM (
  SELECT *, CASE origin WHEN 'skill_section' THEN 1000 WHEN 'experience' THEN 1000 WHEN 'education' THEN 900 WHEN 'personal' THEN 800 WHEN 'summary' THEN 550 ELSE 700 END AS w,
   row_number() OVER (PARTITION BY resume_id, origin, canonical, level_score ORDER BY start) AS n FROM mentions) WHERE n=1) WHERE pos<=4""")
def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    m = star.mentions(spark, d).withColumn("evidence", F.concat_ws(":", "origin", "canonical", F.coalesce(F.col("level_score").cast("string"), F.lit(""))))
    return S.top_evidence(m)


@query(f"""SELECT coalesce(c.cat,'其它') AS category, count(*) AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT p_brand FROM part)
 LEFT JOIN (VALUES {star.values(star.CATEGORIES)}) c(brand, cat) ON p_brand=c.brand GROUP BY 1""")
def category_groups(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select("p_brand").distinct()
    c = DI.categories(brands, "p_brand", spark.createDataFrame(star.CATEGORIES, "canonical string, category string"))
    return c.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_brand")), ",").alias("brands"))


@query(sql("mentions") + "SELECT canonical, count(*) AS n, count(DISTINCT resume_id) AS candidates FROM mentions GROUP BY 1")
def skill_frequency(spark: SparkSession, d: str) -> DataFrame:
    # Two levels of counts instead of a distinct count: the first is combined before the shuffle.
    per = star.mentions(spark, d).groupBy("canonical", "resume_id").agg(F.count("*").alias("n"))
    return per.groupBy("canonical").agg(F.sum("n").alias("n"), F.count("*").alias("candidates"))


@query(sql(*MATCH) + """SELECT jd_id, resume_id, canonical, kind, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY jd_id, resume_id, kind ORDER BY bpos, canonical) AS INTEGER) AS pos FROM (
 SELECT jd_id, resume_id, canonical, pos AS bpos, CASE state WHEN 'missing' THEN 'gap' ELSE 'verify' END AS kind FROM matches WHERE bucket='must')) WHERE pos <= CASE kind WHEN 'verify' THEN 5 ELSE 3 END""")
def question_topk(spark: SparkSession, d: str) -> DataFrame:
    c = codes(spark, d)
    must = P.upto(S.demand_buckets(star.jd_mentions(spark, d)).where("bucket = 'must'").drop("bucket"), "jd_id", ["pos", F.asc_nulls_last("canonical")], c).drop("pos").join(job_nations(spark, d), "jd_id")
    people = holders(spark, d, c)
    lacked = P.lacked(people, "held", c).withColumn("gap", F.lit(True))
    held = c.of(strengths(spark, d)).where("code is not null and v > 0").select("resume_id", "code").join(people, "resume_id").withColumn("gap", F.lit(False))
    # A skill's place within its kind is the number of held or of lacked ones up to it.
    n, every = c.count("held", "upto"), c.size("upto")
    q = P.meet(must, lacked.unionByName(held), ["nation", "code"]).select("jd_id", "resume_id", "canonical", "gap", F.when(F.col("gap"), every - n + F.col("unknown")).otherwise(n).cast("int").alias("pos"))
    return q.where(F.col("pos") <= F.when(F.col("gap"), 3).otherwise(5)).select("jd_id", "resume_id", "canonical", F.when(F.col("gap"), "gap").otherwise("verify").alias("kind"), "pos")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_id FROM events GROUP BY 1")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return per.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"), F.min("f").alias("first_id"))


@query("SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, CAST(min(k) AS INTEGER) AS k_min FROM (SELECT event_type, CAST(json_extract(props,'$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k is not null")
    return k.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.min("k").alias("k_min"))


@query("SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(text, turn) AS last_text, count(*) AS turns FROM conversations GROUP BY 1")
def turn_first_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("text", "turn").alias("last_text"), F.count("*").alias("turns"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY 1,2) GROUP BY 1")
def dedupe_ordered(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))
