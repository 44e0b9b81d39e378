"""Small documents to try the engine with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = [
    ("jd_data", "jd", "数据平台工程师", "岗位名称：数据平台工程师\n公司：示例数据\n岗位职责\n- 建设离线与实时数据平台\n任职要求：\n1. 必须熟悉 Python、SQL 与 Spark，3 年以上开发经验\n2. 本科及以上学历，软件工程优先\n加分项\n- 了解 Kubernetes 者优先"),
    ("resume_data", "resume", "数据方向的简历", "姓名：陈一\n教育背景\n某某大学 软件工程 硕士 2019年毕业\n专业技能\n- 精通 SQL 与 PySpark\n- 熟悉 Python\n工作经历\n2019.07-2023.06 | 某某网络公司 | 数据工程师\n- 用 Spark 把日报从 6 小时缩短到 40 分钟\n- 维护任务调度"),
    ("resume_front", "resume", "前端方向的简历，用来比较", "姓名：林二\n教育背景\n某某学院 大专\n专业技能\n- 熟练 JavaScript\n自我评价\n了解 Python"),
]


def catalog(spark: SparkSession) -> DataFrame:
    """``(key, kind, label)`` of all examples."""
    return detail(spark).drop("text")


def detail(spark: SparkSession, key: str | None = None) -> DataFrame:
    """``(key, kind, label, text)`` of all examples or of one; none for an unknown key."""
    rows = spark.createDataFrame(ROWS, "key string, kind string, label string, text string")
    return rows if key is None else rows.where(F.col("key") == key)
