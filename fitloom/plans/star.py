"""The matching model over the star schema: its relations as DataFrames, and the same relations as SQL.

A customer is a candidate, a part's brand a skill, an order line a mention (origin by order
priority, level by quantity), a supplier a job that asks for its parts' brands (must or
nice by return flag).  Pairs are all candidates and jobs of one nation, as the model scores
all of a block's pairs; with 25 nations their number grows with the product of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARENTS = [("Brand#11", "Brand#12"), ("Brand#22", "Brand#21"), ("Brand#33", "Brand#35"), ("Brand#44", "Brand#99"), ("Brand#12", "Brand#13")]
CATEGORIES = [(f"Brand#{a}{b}", f"cat{a}") for a in range(1, 3) for b in range(1, 6)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def origin(priority):
    digit = F.substr(priority, F.lit(1), F.lit(1))
    out = F.lit("other")
    for d, name in (("1", "skill_section"), ("2", "experience"), ("3", "education"), ("4", "personal"), ("5", "summary")):
        out = F.when(digit == d, F.lit(name)).otherwise(out)
    return out


def level(quantity):
    return F.when(quantity < 10, F.lit(2)).when(quantity < 20, F.lit(None).cast("int")).when(quantity < 30, F.lit(3)).when(quantity < 40, F.lit(4)).otherwise(F.lit(5))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.col("o_custkey").alias("resume_id"),
        F.col("p_brand").alias("canonical"),
        F.col("p_type").alias("domain"),
        origin(F.col("o_orderpriority")).alias("origin"),
        level(F.col("l_quantity")).alias("level_score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start"),
    )


def jd_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines of small parts: the analogue's rule for what a job asks for, not a sample of the input."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return li.join(p, (li.l_partkey == p.p_partkey) & (p.p_size <= 10)).select(
        F.col("l_suppkey").alias("jd_id"),
        F.col("p_brand").alias("canonical"),
        F.when(F.col("l_returnflag") == "R", F.lit("must")).otherwise("nice").alias("demand"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("jd_id"), "s_nationkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), "c_nationkey")
    return s.join(c, s.s_nationkey == c.c_nationkey).select("jd_id", "resume_id")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to shipping months of each candidate; some reversed ones stay in, to be dropped by the operator."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    m = lambda c: F.year(c) * 12 + F.month(c)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("resume_id"), F.col("l_linestatus").alias("kind"), m("o_orderdate").alias("s"), m("l_shipdate").alias("e"))


def parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARENTS, "child string, parent string")


def values(rows: list[tuple]) -> str:
    """Rows as the list of an SQL VALUES clause."""
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: The same relations in SQL, each a common table expression.
SQL = {
    "mentions": """mentions AS (SELECT o_custkey AS resume_id, p_brand AS canonical, p_type AS domain,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'skill_section' WHEN '2' THEN 'experience' WHEN '3' THEN 'education' WHEN '4' THEN 'personal' WHEN '5' THEN 'summary' ELSE 'other' END AS origin,
  CASE WHEN l_quantity<10 THEN 2 WHEN l_quantity<20 THEN NULL WHEN l_quantity<30 THEN 3 WHEN l_quantity<40 THEN 4 ELSE 5 END AS level_score,
  l_orderkey*10+l_linenumber AS start
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey)""",
    "own": """own AS (SELECT resume_id, canonical, CAST(max(CASE WHEN level_score>=4 THEN least(1000,w+50) WHEN level_score<=2 THEN (CASE w WHEN 1000 THEN 850 WHEN 900 THEN 765 WHEN 800 THEN 680 WHEN 700 THEN 595 ELSE 468 END) ELSE w END) AS INTEGER) AS v
  FROM (SELECT *, CASE origin WHEN 'skill_section' THEN 1000 WHEN 'experience' THEN 1000 WHEN 'education' THEN 900 WHEN 'personal' THEN 800 WHEN 'summary' THEN 550 ELSE 700 END AS w FROM mentions) GROUP BY 1,2)""",
    "parents": f"parents AS (SELECT * FROM (VALUES {values(PARENTS)}) t(child, parent))",
    "strength": """strength AS (SELECT resume_id, canonical, max(v) AS v FROM (SELECT * FROM own UNION ALL SELECT resume_id, parent, v FROM own JOIN parents ON canonical=child) GROUP BY 1,2)""",
    "jdm": """jdm AS (SELECT l_suppkey AS jd_id, p_brand AS canonical, CASE WHEN l_returnflag='R' THEN 'must' ELSE 'nice' END AS demand, l_orderkey*10+l_linenumber AS pos
  FROM lineitem JOIN part ON l_partkey=p_partkey AND p_size<=10)""",
    "required": """required AS (SELECT jd_id, canonical, CASE WHEN bool_or(demand<>'nice') THEN 'must' ELSE 'nice' END AS bucket,
  coalesce(min(pos) FILTER (WHERE demand<>'nice'), min(pos)) AS pos FROM jdm GROUP BY 1,2)""",
    "pairs": "pairs AS (SELECT s_suppkey AS jd_id, c_custkey AS resume_id FROM supplier JOIN customer ON s_nationkey=c_nationkey)",
    "matches": """matches AS (SELECT p.jd_id, p.resume_id, r.canonical, r.bucket, r.pos, coalesce(s.v,0) AS v,
  CASE WHEN coalesce(s.v,0)>=800 THEN 'matched' WHEN coalesce(s.v,0)>0 THEN 'weak' ELSE 'missing' END AS state
  FROM pairs p JOIN required r USING (jd_id) LEFT JOIN strength s ON s.resume_id=p.resume_id AND s.canonical=r.canonical)""",
    "ranges": """ranges AS (SELECT o_custkey AS resume_id, l_linestatus AS kind, year(o_orderdate)*12+month(o_orderdate) AS s, year(l_shipdate)*12+month(l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""",
    "months": """months AS (SELECT resume_id, CAST(coalesce(sum(n),0) AS BIGINT) AS months FROM (SELECT DISTINCT resume_id FROM ranges) LEFT JOIN (
    SELECT resume_id, max(e)-min(s)+1 AS n FROM (SELECT *, sum(f) OVER (PARTITION BY resume_id ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS i FROM (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY resume_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+1 THEN 0 ELSE 1 END AS f
      FROM ranges WHERE e>=s AND e-s<=360)) GROUP BY resume_id, i) USING (resume_id) GROUP BY 1)""",
}


def sql(*names: str) -> str:
    """A WITH clause of the named relations."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
