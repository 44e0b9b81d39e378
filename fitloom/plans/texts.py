"""Queries of the text layer over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions import text as T
from fitloom.operators import dictionary as DI
from fitloom.operators import sections as SE
from fitloom.plans.star import table, values
from fitloom.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: A few words of the corpus's own vocabulary as a dictionary; shorter aliases stand within longer ones, which go first.
WORDS = [("THE", "function", ["the"], []), ("GPL", "legal", ["general public license"], []), ("Public", "legal", ["public license"], []), ("License", "legal", ["license"], []), ("Tion", "stem", ["tion", "tioning"], ["Stem"]), ("Which", "function", ["which", "what"], []), ("Licence", "legal", ["licensed under", "under the"], []), ("Stem", "stem", ["stem"], [])]
_ALIASES = [(a, c) for c, _, al, _ in WORDS for a in dict.fromkeys([*al, c.lower()])]


@query(r"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM documents)""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, i - 1 AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
 SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\.(\s|$)', chr(10)||'\1', 'g'), '[。！？；!?;]|\n+'), lambda x: regexp_replace(regexp_replace(x, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '^[ \t·•-]+|[ \t·•-]+$', '', 'g')), lambda x: length(x) > 0) AS l FROM documents))""")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


_W = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BULLET = r"^\s*([-*•·▪◦●○◆◇■□→➢➤‣]|\(?\d{1,2}\)?[.、)）]|[（(]\d{1,2}[)）]|[①-⑳]|[（(][一二三四五六七八九十]{1,3}[)）])\s*"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


_SENTENCES = f"""list_filter(list_transform(regexp_split_to_array(regexp_replace(l, '\\.(\\s|$)', chr(10)||'\\1', 'g'), '[。！？；!?;]|\\n+'), lambda x: regexp_replace({_strip("x")}, '^[ \\t·•-]+|[ \\t·•-]+$', '', 'g')), lambda x: length(x) > 0)"""


@query(f"""WITH l AS (SELECT doc_id, i, {_strip(f"regexp_replace({_strip('l')}, '{_BULLET}', '')")} AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 b AS (SELECT doc_id, i, CASE WHEN length(l) <= 220 THEN [l] ELSE list_reduce(list_transform({_SENTENCES}, lambda x: [x]),
   lambda a, b: CASE WHEN length(a[-1]) + length(b[1]) > 220 THEN list_concat(a, b) ELSE list_concat(a[:-2], [a[-1] || ' ' || b[1]]) END) END AS bs FROM l WHERE length(l) > 0),
 u AS (SELECT doc_id, i, unnest(bs) AS block, generate_subscripts(bs, 1) AS j FROM b)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos, block FROM u""")
def split_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.split_blocks(F.col("text"))).alias("pos", "block"))


@query("""SELECT doc_id, CAST(i-1 AS INTEGER) AS line_no, CAST(coalesce(sum(length(l)+1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INTEGER) AS start_offset, length(l) AS n
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)),1) AS i FROM documents)""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return SE.lines(table(spark, d, "documents")).select("doc_id", "line_no", "start_offset", F.length("line").cast("long").alias("n"))


_OVER = "y.doc_id=x.doc_id AND y.line_no=x.line_no AND y.s<x.e AND x.s<y.e"
_FIRST = "(y.e-y.s>x.e-x.s OR (y.e-y.s=x.e-x.s AND (y.ord<x.ord OR (y.ord=x.ord AND y.s<x.s))))"
#: What no earlier place overlaps is taken; what is left beside that is looked at again, three times for chains of aliases.
_ROUNDS = "".join(
    f"k{i} AS (SELECT * FROM r{i} x WHERE NOT EXISTS (SELECT 1 FROM r{i} y WHERE {_OVER} AND {_FIRST})),\n r{i + 1} AS (SELECT * FROM r{i} x WHERE NOT EXISTS (SELECT 1 FROM k{i} y WHERE {_OVER})),\n" for i in range(3)
)
_SCAN = f"""WITH a AS (SELECT * FROM (VALUES {values([(a, c, i) for i, (a, c) in enumerate(_ALIASES)])}) t(alias, canonical, ord)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1)-1 AS line_no FROM documents),
c AS (SELECT l.*, a.*, unnest(range(1, length(line)-length(alias)+2)) AS p FROM l JOIN a ON contains(lower(line), alias)),
r0 AS (SELECT doc_id, line_no, canonical, ord, p-1 AS s, p-1+length(alias) AS e FROM c WHERE substr(lower(line), p, length(alias))=alias
 AND (p=1 OR NOT regexp_matches(substr(line,p-1,1),'[A-Za-z0-9_+#.]')) AND NOT regexp_matches(substr(line,p+length(alias),1),'[A-Za-z_+#.]')),
{_ROUNDS}h AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)
"""


@query(_SCAN + "SELECT doc_id, canonical, count(*) AS n, CAST(sum(s) AS BIGINT) AS s_sum FROM h GROUP BY 1,2")
def dict_scan(spark: SparkSession, d: str) -> DataFrame:
    _, alias, _ = DI.from_rows(spark, WORDS)
    lines = SE.numbered(table(spark, d, "documents"))
    return DI.scan_native(lines, alias, ["doc_id", "line_no"]).groupBy("doc_id", "canonical").agg(F.count("*").alias("n"), F.sum("s").alias("s_sum"))


@query(_SCAN + "SELECT canonical, count(*) AS n, count(DISTINCT doc_id) AS docs FROM h GROUP BY 1")
def dict_scan_arrow(spark: SparkSession, d: str) -> DataFrame:
    _, alias, _ = DI.from_rows(spark, WORDS)
    per = DI.scan(table(spark, d, "documents"), alias).groupBy("canonical", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("canonical").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


_QUANT_SQL = r"[0-9]+(\.[0-9]+)?\s*%|(?i)[0-9]+(\.[0-9]+)?\s*(万|亿|千|百|k|w)?\s*(人|用户|客户|次|条|个|台|套|种|篇|份|轮|页|行|所|家|qps|tps|uv|pv|dau|mau|ms|毫秒|秒|分钟|小时|天|周|月|年|倍|分|元|美元|GB|MB|TB|KB)|(qps|tps|uv|pv|dau|mau)[^0-9]{0,6}[0-9]+"


@query(f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '{_QUANT_SQL}')) AS n_quantified FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def quantified_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(T.has_quantified(F.col("line")).cast("long")).alias("n_quantified"))


@query("SELECT doc_id, CASE WHEN length(t)<=60 THEN t ELSE substr(t,1,57)||'...' END AS short, contains(lower(t), 'license') AS licensed FROM (SELECT doc_id, trim(text, ' '||chr(9)||chr(10)||chr(13)) AS t FROM documents)")
def shorten_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.shorten(F.col("text")).alias("short"), F.contains(F.lower("text"), F.lit("license")).alias("licensed"))


@query("SELECT doc_id, text AS body, CAST(length(text) AS BIGINT) AS char_count FROM documents ORDER BY doc_id DESC LIMIT 20")
def store_latest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), F.length("text").cast("long").alias("char_count"), F.col("doc_id").alias("seq"))
    return store.newest(docs, "seq", 20).drop("seq")


@query("SELECT doc_id, substr(sha256(text),1,12) AS id FROM documents WHERE regexp_matches(substr(sha256(text),1,12), '^[0-9a-f]{12}$') AND length(trim(text))>0 AND length(text)<=60000")
def id_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    accepted, _ = store.accept(docs.withColumn("_k", F.col("doc_id")))
    return accepted.where(store.valid_id(F.col("id"))).select(F.col("_k").alias("doc_id"), "id")


