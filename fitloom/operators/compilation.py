"""Compiling a skill dictionary: aliases by rule, conflicts, repeated names, parents that lead nowhere or in circles, the inventory.

A dictionary comes as ``entries(ord, canonical, category, aliases, parents, auto_alias)``,
one row each; everything here is a join or a sum over it, so it may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.sources import shared


def aliases(entries: DataFrame) -> DataFrame:
    """``(alias, canonical, ord, pos, auto)``: every entry's aliases lower-cased, and its own name unless that is listed or ``auto_alias`` is false."""
    clean = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    own = F.lower(F.trim("canonical"))
    e = entries.select("ord", "canonical", clean.alias("l"), own.alias("own"), F.coalesce("auto_alias", F.lit(True)).alias("auto"))
    auto = F.when(F.col("auto") & ~F.array_contains("l", F.col("own")), F.array(F.struct(F.col("own").alias("alias"), F.lit(True).alias("auto")))).otherwise(F.array().cast("array<struct<alias:string,auto:boolean>>"))
    listed = F.transform("l", lambda a: F.struct(a.alias("alias"), F.lit(False).alias("auto")))
    rows = e.select("ord", "canonical", F.posexplode(F.concat(listed, auto)).alias("pos", "x"))
    return rows.where(F.length("x.alias") > 0).select("x.alias", "canonical", "ord", "pos", "x.auto")


def _at() -> Column:
    return F.struct("ord", "pos")


def resolved(entries: DataFrame) -> DataFrame:
    """``(alias, looked_up, scanned)``: the name that a lookup of the alias gives, and the one that a scan of texts gives.

    Listed aliases go before those by rule.  A later entry takes a lookup over, whereas in a scan the first keeps its place.
    """
    explicit = ~F.col("auto")
    listed, by_rule = F.max_by(F.when(explicit, F.col("canonical")), F.when(explicit, _at())), F.min_by("canonical", _at())
    return aliases(entries).groupBy("alias").agg(F.coalesce(listed, by_rule).alias("looked_up"), F.min_by("canonical", _at()).alias("scanned"))


def conflicts(entries: DataFrame) -> DataFrame:
    """``(alias, canonical, looked_up, scanned)``: the aliases that several names claim, a row for each of them, and whether it wins."""
    a = aliases(entries)
    several = a.groupBy("alias").agg((F.min("canonical") != F.max("canonical")).alias("several")).where("several").select("alias")
    claims = a.join(several, "alias", "left_semi").select("alias", "canonical").distinct()
    r = resolved(entries).select("alias", F.col("looked_up").alias("_l"), F.col("scanned").alias("_s"))
    return claims.join(r, "alias").select("alias", "canonical", (F.col("canonical") == F.col("_l")).alias("looked_up"), (F.col("canonical") == F.col("_s")).alias("scanned"))


def repeated(entries: DataFrame) -> DataFrame:
    """``(canonical, n)`` of names that occur more than once."""
    return entries.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1")


def edges(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("canonical").alias("child"), F.explode("parents").alias("parent")).where("parent is not null").distinct()


def unknown_parents(entries: DataFrame) -> DataFrame:
    """``(child, parent)`` whose parent is no entry."""
    return edges(entries).join(entries.select(F.col("canonical").alias("parent")), "parent", "left_anti").select("child", "parent")


def cycles(parents: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(name, cycle)``: the names that are their own ancestors, and the first name of their circle.

    Edges that begin at a name which is nobody's parent, or end at one without parents, are
    on no circle: they go, round by round, until none goes.  What stays are circles and ways
    between them, however large the dictionary; their names are followed, twice as far in
    every round, until no new ancestor is found.
    """
    e = shared.stored(parents.select("child", "parent").distinct(), "edges")
    n = e.count()
    for _ in range(most_rounds):
        up, down = e.select(F.col("parent").alias("child")).distinct(), e.select(F.col("child").alias("parent")).distinct()
        e = shared.stored(e.join(up, "child", "left_semi").join(down, "parent", "left_semi").select("child", "parent"), "edges")
        before, n = n, e.count()
        if n in (before, 0):
            break
    reach = e
    for _ in range(most_rounds):
        further = reach.alias("a").join(reach.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent"))
        reach = shared.stored(reach.unionByName(further).distinct(), "reach")
        before, n = n, reach.count()
        if n == before:
            break
    # Names of one circle reach each other.
    back = reach.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return reach.join(back, ["child", "parent"]).groupBy(F.col("child").alias("name")).agg(F.least(F.min("parent"), F.first("child")).alias("cycle"))


def inventory(entries: DataFrame) -> DataFrame:
    """``(canonical, category, aliases, alias_count, parents)``, aliases in the order of the dictionary, each once."""
    first = aliases(entries).groupBy("canonical", "alias").agg(F.min(_at()).alias("at"))
    listed = first.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return entries.select("canonical", "category", "parents").join(listed, "canonical", "left").select("canonical", "category", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce(F.size("aliases"), F.lit(0)).alias("alias_count"), "parents")


def compile_dictionary(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dim_skill, dim_alias, dim_parent) of a dictionary, each alias with the name that a scan gives; a repeated name is an error."""
    twice = repeated(entries).orderBy("canonical").limit(5).collect()
    if twice:
        raise ValueError("names occur more than once: " + ", ".join(str(r["canonical"]) for r in twice))
    a = aliases(entries).groupBy("alias").agg(F.min(F.struct("ord", "pos", "canonical")).alias("m"))
    return entries.select("canonical", "category"), a.select("alias", "m.canonical", "m.ord"), edges(entries)
