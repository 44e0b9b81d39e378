"""The skill dictionary: dimension tables, lookups, parent expansion and the substring join.

Dictionaries are data: ``dim_alias(alias, canonical, ord)``, ``dim_skill(canonical,
category)`` and ``dim_parent(child, parent)``.  Joins with them are left to Spark, which
broadcasts them while they are small.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom.functions import text as T
from fitloom.functions import vocab as V
from fitloom.sources import shared

OTHER = "其它"
#: Aliases that a task compiles at most, and beginnings of aliases for which they are broadcast.
MOST_ALIASES, MOST_HEADS = 500_000, 20_000
#: Characters of a part of a line, whose places are reached by walking; beginnings of aliases up to which a part is cut before them.
SHORT, FEW_HEADS = 600, 64
CJK = r"[一-鿿]"
ORDER = "struct<n:int,ord:bigint,alias:string>"


def compile_aliases(dim_alias: DataFrame) -> DataFrame:
    """Lower-cased aliases with length, script and what orders them (longest first, then the dictionary's order)."""
    a = dim_alias.select(F.lower(F.trim("alias")).alias("alias"), "canonical", "ord").where(F.length("alias") > 0)
    a = a.groupBy("alias").agg(F.min(F.struct("ord", "canonical")).alias("_m")).select("alias", "_m.canonical", "_m.ord")
    order = F.struct((-F.length("alias")).alias("n"), F.col("ord").cast("long").alias("ord"), F.col("alias"))
    return a.withColumns({"len": F.length("alias"), "is_cjk": F.col("alias").rlike(CJK), "compile_ord": order})


def canonical_of(df: DataFrame, column: str, dim_alias: DataFrame) -> DataFrame:
    """``df`` with ``canonical``: the dictionary's name of a term, null for an unknown one."""
    a = dim_alias.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min_by("canonical", "ord").alias("canonical"))
    return df.join(a, F.lower(F.trim(F.col(column))) == F.col("_alias"), "left").drop("_alias")


def normalize_list(df: DataFrame, keys: list[str], names: str, dim_alias: DataFrame) -> DataFrame:
    """``(*keys, pos, name)``: terms by their dictionary names, unknown ones as they are, each once at its first place."""
    terms = df.select(*keys, F.posexplode(names).alias("pos", "_term")).where(F.trim("_term") != "")
    named = canonical_of(terms, "_term", dim_alias).select(*keys, "pos", F.coalesce("canonical", F.trim("_term")).alias("name"))
    return named.groupBy(*keys, "name").agg(F.min("pos").alias("pos"))


def expand_parents(df: DataFrame, keys: list[str], name: str, pos: str, dim_parent: DataFrame) -> DataFrame:
    """Names and their parents, one level up, in order: each name, then its parents, each once."""
    p = dim_parent.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
    up = df.join(p, df[name] == F.col("_child")).select(*keys, F.col("_parent").alias(name), F.struct(F.col(pos), F.lit(1).alias("k"), F.col("_parent").alias("n")).alias("_at"))
    own = df.select(*keys, name, F.struct(F.col(pos), F.lit(0).alias("k"), F.col(name).alias("n")).alias("_at"))
    return own.unionByName(up).groupBy(*keys, name).agg(F.min("_at").alias("_at")).withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).drop("_at")


def categories(df: DataFrame, name: str, dim_skill: DataFrame) -> DataFrame:
    """``df`` with ``category``; unknown names belong to "other"."""
    d = dim_skill.select(F.col("canonical").alias("_c"), "category")
    return df.join(d, df[name] == F.col("_c"), "left").drop("_c").withColumn("category", F.coalesce("category", F.lit(OTHER)))


def browse(dim_skill: DataFrame, dim_alias: DataFrame, query: str = "", category: str = "", limit: int = 300) -> DataFrame:
    """Entries whose name or an alias holds ``query``, in name order."""
    q = query.strip().lower()
    hits = dim_alias.where(F.contains(F.lower("alias"), F.lit(q))).select("canonical").distinct().withColumn("_hit", F.lit(True))
    rows = dim_skill.join(hits, "canonical", "left").where(F.contains(F.lower("canonical"), F.lit(q)) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    if category:
        rows = rows.where(F.col("category") == category)
    return rows.orderBy("canonical").limit(max(1, min(1000, limit)))


LEFT, RIGHT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+#."), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_+#.")


def boundary_ok(left: Column, right: Column, is_cjk: Column) -> Column:
    """Whether an alias may stand between two neighbouring characters (empty at a line's ends)."""
    return is_cjk | (~left.rlike("[A-Za-z0-9_+#.]") & ~right.rlike("[A-Za-z_+#.]"))


def cut(heads: list[str], anywhere: bool) -> str | None:
    """A pattern of the empty places before which a part of a line is cut, so that all places that count are cuts; None for each place.

    A place counts if one of ``heads`` follows and, unless aliases may stand ``anywhere``, no letter precedes.
    Many heads are not looked for here.
    """
    border = "" if anywhere else "(?<![A-Za-z0-9_+#.])"
    if len(heads) <= FEW_HEADS:
        # Cases are folded in the heads alone: the border's letters are A-Z and a-z, not those that fold to them.
        return f"{border}(?=(?iu:" + "|".join("".join(c if c.isalnum() else "\\" + c for c in h) for h in sorted(heads)) + "))"
    return border + "(?=(?s:.))" if border else None


def parts(lines: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """``(*keys, off, lead, own, line)``: lines in parts of ``own`` characters from ``off`` on, with ``lead`` characters before them and as many after as an alias may need.

    A text is walked from its beginning to reach a place in it, so no part may be long.
    """
    n, line = max(SHORT, longest + 1), F.col("line")
    part = lambda off, lead, own, text: F.struct(off.cast("int").alias("off"), F.lit(lead).alias("lead"), F.length(own).alias("own"), text.alias("line"))
    whole = F.array(part(F.lit(0), 0, line, line))
    after = lambda c, i: F.coalesce(F.substr(F.get(c, i + 1), F.lit(1), F.lit(longest + 1)), F.lit(""))
    cuts = T.let(
        F.regexp_extract_all(line, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)),
        lambda c: F.transform(
            c,
            lambda x, i: F.when(i == 0, part(i, 0, x, F.concat(x, after(c, i)))).otherwise(part(i * n, 1, x, F.concat(F.substr(F.get(c, i - 1), F.lit(-1), F.lit(1)), x, after(c, i)))),
        ),
    )
    return lines.select(*keys, F.explode(F.when(F.length(line) <= n, whole).otherwise(cuts)).alias("x")).select(*keys, "x.*")


def places(size: int, heads: list[str], longest: int, anywhere: bool = True) -> Column:
    """The places of a part's own characters where one of ``heads``, of ``size`` characters, begins, each with what follows it.

    The part is cut where a place can count (``cut``) and only those places are looked at.
    """
    line, pattern = F.col("line"), cut(heads, anywhere)
    piece = lambda p, n: F.substr(line, p, F.lit(n))
    head = lambda p: F.lower(piece(p, size))
    one = lambda p: F.struct((F.col("off") + p - F.col("lead")).alias("p"), head(p).alias("_k"), F.when(p > 1, piece(p - 1, 1)).otherwise("").alias("left"), piece(p, longest + 1).alias("piece"))
    # Where each piece begins; a fold over the few pieces of a part.
    begins = F.aggregate(
        F.split(line, pattern or ""),
        F.struct(F.lit(1).alias("p"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["p"] + F.length(x)).alias("p"), F.concat(acc["all"], F.array(acc["p"])).alias("all")),
        lambda acc: acc["all"],
    )
    at = begins if pattern else F.sequence(F.lit(1), F.length(line))
    return F.transform(F.filter(at, lambda p: (p > F.col("lead")) & (p <= F.col("lead") + F.col("own")) & head(p).isin(heads)), one)


def candidates(lines: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, canonical, compile_ord, s, e, raw)``: all places of all aliases in ``line``, borders respected, overlaps kept.

    A line's places that begin like some alias become rows, each with as many characters as
    the longest alias has; they meet the aliases in a hash join on the first two characters
    (on the first for aliases of one), so no line is compared with the whole dictionary.
    """
    longest = aliases.agg(F.max("len")).first()[0] or 1
    lines = parts(lines, keys, longest)
    found = []
    for size in (1, 2):
        own = aliases.where(F.col("len") == 1 if size == 1 else F.col("len") > 1).withColumn("_k", F.substr("alias", F.lit(1), F.lit(size)))
        begun = own.groupBy("_k").agg(F.max("is_cjk").alias("cjk")).collect()
        heads, anywhere = [r["_k"] for r in begun], any(r["cjk"] for r in begun)
        if not heads:
            continue
        at = lines.where(F.length("line") >= size).select(*keys, F.explode(places(size, heads, longest, anywhere)).alias("x")).select(*keys, "x.*")
        found.append(at.join(F.broadcast(own) if len(heads) <= MOST_HEADS else own, "_k"))
    if not found:
        return lines.where("false").select(*keys, F.lit("").alias("canonical"), F.lit(None).cast(ORDER).alias("compile_ord"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("raw"))
    hit = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    raw = F.substr("piece", F.lit(1), F.col("len"))
    ok = (F.lower(raw) == F.col("alias")) & boundary_ok(F.col("left"), F.substr("piece", F.col("len") + 1, F.lit(1)), F.col("is_cjk"))
    return hit.where(ok).select(*keys, "canonical", "compile_ord", (F.col("p") - 1).alias("s"), (F.col("p") - 1 + F.col("len")).alias("e"), raw.alias("raw"))


def resolve(found: DataFrame, keys: list[str]) -> DataFrame:
    """Keep non-overlapping places: longer aliases first (``compile_ord``), then from the left.

    Places are cut into islands of overlapping ones by a window, and each island is
    resolved by a fold over its few members.
    """
    w = Window.partitionBy(*keys).orderBy("s", "e")
    new = F.coalesce(F.col("s") >= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = found.withColumn("_new", new.cast("int")).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = islands.groupBy(*keys, "_i").agg(F.array_sort(F.collect_list(F.struct("compile_ord", "s", "e", "canonical", "raw"))).alias("c"))
    kept = F.aggregate(
        "c",
        F.array().cast(f"array<struct<compile_ord:{ORDER},s:int,e:int,canonical:string,raw:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return ranked.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.canonical", "k.s", "k.e", "k.raw")


def scan_native(lines: DataFrame, dim_alias: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, canonical, s, e, raw)``: the dictionary's mentions in each ``line``, in DataFrame operations only."""
    return resolve(candidates(lines, compile_aliases(dim_alias), keys), keys)


class Matcher:
    """The dictionary compiled for one worker: an Aho-Corasick automaton over all aliases, one pass over a text whatever their number and length."""

    def __init__(self, aliases: list[tuple[str, str, bool]]):
        """``aliases``: (alias, name, whether in Chinese), in the order of precedence."""
        self.automaton = ahocorasick.Automaton()
        for order, (alias, canonical, is_cjk) in enumerate(aliases):
            self.automaton.add_word(alias, (order, len(alias), canonical, is_cjk))
        if aliases:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of a text's mentions: longer aliases first, then from the left, none overlapping."""
        if not len(self.automaton):
            return []
        low = text.lower()
        if len(low) != len(text):  # a few letters change length when lowered
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = []
        for last, (order, n, canonical, is_cjk) in self.automaton.iter(low):
            s, e = last + 1 - n, last + 1
            if is_cjk or not ((s and text[s - 1] in LEFT) or (e < len(text) and text[e] in RIGHT)):
                found.append((order, s, e, canonical))
        if len(found) < 2:
            return [x[1:] for x in found]
        taken, out = bytearray(len(text)), []
        for _, s, e, canonical in sorted(found):
            if not any(taken[s:e]):
                taken[s:e] = b"\x01" * (e - s)
                out.append((s, e, canonical))
        return sorted(out)


#: The automata of the last dictionaries that this worker met.
_MATCHERS: dict[str, Matcher] = {}


class Compiled:
    """A dictionary on its way to the workers: broadcast once (``MOST_ALIASES`` bound it), built once by each worker and not by each task."""

    def __init__(self, dim_alias: DataFrame):
        rows = compile_aliases(dim_alias).select("compile_ord", "alias", "canonical", "is_cjk").limit(MOST_ALIASES + 1).collect()
        if len(rows) > MOST_ALIASES:
            raise ValueError("the dictionary is too large for a task; use scan_native")
        ordered = [tuple(r)[1:] for r in sorted(rows)]
        self.key = hashlib.sha256(repr(ordered).encode()).hexdigest()
        self.rows = dim_alias.sparkSession.sparkContext.broadcast(ordered)

    def matcher(self) -> Matcher:
        if self.key not in _MATCHERS:
            while len(_MATCHERS) > 1:
                _MATCHERS.pop(next(iter(_MATCHERS)))
            _MATCHERS[self.key] = Matcher(self.rows.value)
        return _MATCHERS[self.key]


#: What a scan returns of each mention, and what it tells of its surroundings.
PLACE = "canonical string, raw string, s int, e int"
SURROUNDINGS = PLACE + ", line_no int, clause string, around string, at int"
#: Mentions, and characters of their strings, that a worker hands on at once.
MENTIONS_AT_ONCE, CHARS_AT_ONCE = 20_000, 4 << 20


def scanned(docs: DataFrame, dim_alias: DataFrame, text: str, keys: tuple[str, ...], columns: str, rows_of: Callable[[str, list], Iterator[tuple]]) -> DataFrame:
    """``(*keys, *columns)``: what ``rows_of`` tells of each text and its mentions; a worker holds a bounded number of rows."""
    compiled, names = Compiled(dim_alias), list(keys)
    fields = [c.split() for c in columns.split(", ")]
    kinds = [pa.string() if kind == "string" else pa.int32() for _, kind in fields]
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", " + columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = compiled.matcher()
        for b in shared.slices(batches):

            def out(at: list, rows: list, b: pa.RecordBatch = b) -> pa.RecordBatch:
                own = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(names))]
                return pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*names, *(n for n, _ in fields)])

            at, rows, chars = [], [], 0
            for i, t in enumerate(b.column(len(names)).to_pylist()):
                for row in rows_of(t, m.scan(t)) if t else ():
                    at.append(i)
                    rows.append(row)
                    chars += sum(len(x) for x in row if type(x) is str)
                    if len(rows) >= MENTIONS_AT_ONCE or chars >= CHARS_AT_ONCE:
                        yield out(at, rows)
                        at, rows, chars = [], [], 0
            if rows:
                yield out(at, rows)

    return docs.select(*names, text).mapInArrow(run, schema)


def scan(docs: DataFrame, dim_alias: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, canonical, raw, s, e)``: mentions with offsets in the whole text; one pass over the texts, no shuffle."""
    return scanned(docs, dim_alias, text, keys, PLACE, lambda t, found: ((canonical, t[s:e], s, e) for s, e, canonical in found))


#: Characters kept on either side of a mention.
AROUND = 40
CLAUSE, NEWLINE = re.compile(f"[{re.escape(V.CLAUSE_BORDER)}]"), re.compile("\n")


def surroundings(t: str, found: list[tuple[int, int, str]]) -> Iterator[tuple]:
    """A text's mentions with line number, clause and the text around."""
    if not found:
        return
    starts = [0, *(x.end() for x in NEWLINE.finditer(t))]
    line_no, borders = -1, []
    for s, e, canonical in found:
        now = bisect_right(starts, s) - 1
        if now != line_no:
            line_no, base = now, starts[now]
            line = t[base : starts[now + 1] - 1 if now + 1 < len(starts) else len(t)]
            borders = [-1, *(x.start() for x in CLAUSE.finditer(line)), len(line)]
        left, right = borders[bisect_left(borders, s - base) - 1] + 1, borders[bisect_left(borders, e - base)]
        low = max(0, s - AROUND)
        yield canonical, t[s:e], s, e, line_no, line[left:right].strip(), t[low : e + AROUND], low


def scan_around(docs: DataFrame, dim_alias: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``scan`` with each mention's line number, its clause, and the text around it (``around`` begins ``at`` in the text).

    What later steps look at travels with the mention, so that none of them reads the text again.
    """
    return scanned(docs, dim_alias, text, keys, SURROUNDINGS, surroundings)


def from_rows(spark: SparkSession, entries: list[tuple[str, str, list[str], list[str]]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dim_skill, dim_alias, dim_parent) of (canonical, category, aliases, parents) rows; a repeated canonical is an error."""
    names = [e[0] for e in entries]
    if len(set(names)) != len(names):
        raise ValueError("a canonical name occurs twice")
    aliases = [(a, c, 100 * i + j) for i, (c, _, al, _) in enumerate(entries) for j, a in enumerate(dict.fromkeys([*al, c.lower()]))]
    parents = [(c, p) for c, _, _, ps in entries for p in ps]

    def frame(rows: list[tuple], columns: str) -> DataFrame:
        # By way of Arrow: a list of rows would go through Python workers of its own, which stay beside those of the scan.
        fields = [c.split() for c in columns.split(", ")]
        kinds = [pa.string() if kind == "string" else pa.int32() for _, kind in fields]
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
        return spark.createDataFrame(pa.table(made, names=[n for n, _ in fields]), columns)

    return (
        frame([(c, k) for c, k, _, _ in entries], "canonical string, category string"),
        frame(aliases, "alias string, canonical string, ord int"),
        frame(parents, "child string, parent string"),
    )
