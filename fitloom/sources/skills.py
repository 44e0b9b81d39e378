"""A small default dictionary; production dictionaries are tables with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitloom.operators.dictionary import from_rows

# canonical, category, aliases, parents
ENTRIES = [
    ("Python", "编程语言", ["python", "python3"], []),
    ("Java", "编程语言", ["java"], []),
    ("C++", "编程语言", ["c++", "cpp"], []),
    ("C#", "编程语言", ["c#", "csharp"], []),
    ("Go", "编程语言", ["golang", "go语言"], []),
    ("Rust", "编程语言", ["rust"], []),
    ("JavaScript", "编程语言", ["javascript", "js"], []),
    ("SQL", "编程语言", ["sql"], []),
    ("深度学习", "AI", ["深度学习", "deep learning"], []),
    ("机器学习", "AI", ["机器学习", "machine learning"], []),
    ("PyTorch", "AI", ["pytorch", "torch"], ["深度学习"]),
    ("TensorFlow", "AI", ["tensorflow"], ["深度学习"]),
    ("RAG", "AI", ["rag", "检索增强生成"], []),
    ("向量数据库", "数据", ["向量数据库", "向量检索"], []),
    ("FAISS", "数据", ["faiss"], ["向量数据库"]),
    ("Milvus", "数据", ["milvus"], ["向量数据库"]),
    ("MySQL", "数据", ["mysql"], []),
    ("Redis", "数据", ["redis"], []),
    ("Spark", "数据", ["spark", "pyspark"], []),
    ("Docker", "工程", ["docker"], []),
    ("Kubernetes", "工程", ["kubernetes", "k8s"], []),
    ("FastAPI", "后端", ["fastapi"], []),
    ("Node.js", "后端", ["node.js", "nodejs"], []),
    ("金融科技", "领域方向", ["金融科技", "fintech"], []),
    ("电商", "领域方向", ["电商平台", "e-commerce"], []),
]


def default_dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return from_rows(spark, ENTRIES)
