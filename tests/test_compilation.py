"""Compiling dictionaries, the automaton at size, questions with what they hang on."""

import random
import time

import pytest

from fitloom.operators import compilation as C
from fitloom.operators import dictionary as DI

SCHEMA = "ord long, canonical string, category string, aliases array<string>, parents array<string>, auto_alias boolean"


def entries(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


ROWS = [
    ("Git", "tool", ["git", " GitHub "], [], True), ("GitHub", "tool", ["github"], ["Git"], True), ("Go", "lang", ["golang", ""], None, False), ("golang", "x", None, ["nowhere"], None), ("LONE", "x", [], [], True),
]


def test_aliases_and_conflicts(spark):
    e = entries(spark, ROWS)
    a = {(r.alias, r.canonical, r.auto) for r in C.aliases(e).collect()}
    assert a == {("git", "Git", False), ("github", "Git", False), ("github", "GitHub", False), ("golang", "Go", False), ("golang", "golang", True), ("lone", "LONE", True)}
    # A later listed alias takes a lookup over, one by rule doesn't; scans keep the first.
    assert {(r.alias, r.looked_up, r.scanned) for r in C.resolved(e).collect()} == {("git", "Git", "Git"), ("github", "GitHub", "Git"), ("golang", "Go", "Go"), ("lone", "LONE", "LONE")}
    assert {(r.alias, r.canonical, r.looked_up, r.scanned) for r in C.conflicts(e).collect()} == {("github", "Git", False, True), ("github", "GitHub", True, False), ("golang", "Go", True, True), ("golang", "golang", False, False)}
    assert {tuple(r) for r in C.unknown_parents(e).collect()} == {("golang", "nowhere")}
    assert {(r.canonical, tuple(r.aliases), r.alias_count) for r in C.inventory(e).collect()} == {("Git", ("git", "github"), 2), ("GitHub", ("github",), 1), ("Go", ("golang",), 1), ("golang", ("golang",), 1), ("LONE", ("lone",), 1)}
    skill, alias, parent = C.compile_dictionary(e)
    docs = spark.createDataFrame([(1, "GitHub, git"), (2, "golang")], "doc_id int, text string")
    assert {(r.doc_id, r.canonical, r.s) for r in DI.scan(docs, alias).collect()} == {(1, "Git", 0), (1, "Git", 8), (2, "Go", 0)}
    assert skill.count() == 5 and parent.count() == 2
    with pytest.raises(ValueError, match="Git"):
        C.compile_dictionary(entries(spark, [*ROWS, ("Git", "y", [], [], True)]))


def brute_cycles(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {p for c, p in edges if c == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= set().union(*(reach[m] for m in reach[n])) if reach[n] else set()
    on = {n for n in nodes if n in reach[n]}
    return {(n, min(m for m in on if m in reach[n] and n in reach[m])) for n in on}


@pytest.mark.parametrize("seed", range(2))
def test_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [("s", "s"), ("a", "b"), ("b", "a"), ("b", "c")] + [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(26)] + [(f"long{i}", f"long{i + 1}") for i in range(9)]
    df = spark.createDataFrame(edges, "child string, parent string")
    assert {tuple(r) for r in C.cycles(df).collect()} == brute_cycles(set(edges))
    assert C.cycles(df.limit(0)).count() == 0


def test_large_dictionary(spark):
    """With 200,000 aliases a scan takes no longer than with a handful, once a worker has built the automaton."""
    rng = random.Random(3)
    words = [f"w{i}x{rng.randint(0, 9)}" for i in range(200_000)]
    few, many = [(w, w, f"{w}", False) for w in words[:8]], [(w, w, f"{w}", False) for w in words]
    small, large = (DI.Matcher([(a, c, z) for a, c, _, z in rows]) for rows in (few, many))
    lines = [" ".join(rng.choice(words) if rng.random() < 0.01 else "plain" for _ in range(200)) for _ in range(300)]
    took = []
    for m in (small, large):
        began = time.perf_counter()
        found = [m.scan(x) for x in lines]
        took.append(time.perf_counter() - began)
    assert sum(map(len, found)) > 400 and took[1] < 3 * took[0] + 0.2
    assert found[0] == [(s, s + len(w), w) for w in lines[0].split() if w != "plain" for s in [lines[0].index(w)]] or len(set(lines[0].split())) < 4
