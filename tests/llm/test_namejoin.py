"""The name join against a plain distance over all pairs, and odd inputs."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm import namejoin


def distance(a, b):
    """Unrestricted Damerau-Levenshtein, the whole matrix."""
    big = len(a) + len(b)
    last: dict = {}
    d = {(-1, j): big for j in range(-1, len(b) + 1)} | {(i, -1): big for i in range(-1, len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


words = st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12)


@settings(max_examples=600, deadline=None)
@given(words, words, st.integers(1, 3))
def test_descent_finds_what_the_matrix_finds(trie, asked, most):
    found = sorted(namejoin.shard_pairs(trie, sorted(set(asked)), most))
    assert found == sorted((q, n, distance(q, n)) for q in set(asked) for n in set(trie) if distance(q, n) <= most)


def test_substrings_edited_again():
    assert distance("ca", "abc") == 2
    assert list(namejoin.shard_pairs(["abc"], ["ca"], 2)) == [("ca", "abc", 2)]
    assert list(namejoin.shard_pairs(["abc"], ["ca"], 1)) == []


def some_names(n, seed, most_len=6):
    rng = random.Random(seed)
    return ["".join(rng.choice("abéd ") for _ in range(rng.randint(1, most_len))) for _ in range(n)]


@pytest.mark.parametrize(("most", "cap"), [(1, 1000), (1, 5), (2, 1000), (2, 5)])
def test_pairs(spark, monkeypatch, most, cap):
    """With large shards split and without, every pair is found once."""
    monkeypatch.setattr(namejoin, "CAP", cap)
    left, right = some_names(150, 1, 9), some_names(60, 2, 9)
    rows = lambda names: spark.createDataFrame([(x,) for x in names] + [(None,), ("",)], "name string")
    got = sorted(map(tuple, namejoin.name_pairs(rows(left), rows(right), most).collect()))
    assert got == sorted((q, n, distance(q, n)) for q in set(right) for n in set(left) if distance(q, n) <= most)


def expected(clients, vendors):
    crc = lambda x: zlib.crc32(str(x).encode())
    out: dict = {}
    for v, name in vendors:
        if name and crc(v) % 2 == 0 and len(name) >= 2:
            p = crc(v) % (len(name) - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        for c, other in clients:
            if name and other and (d := distance(name, other)) <= 1:
                out.setdefault((v, d), []).append(c)
    return sorted((v, d, len(c), min(c), sum(map(crc, c))) for (v, d), c in out.items())


def test_query(spark):
    """Hot names, nulls, empty and repeated names, columns that clash."""
    names = some_names(200, 3, 8)
    clients = [(i, "hot name") for i in range(300)] + list(enumerate(names, 1000)) + [(5000, None), (5001, ""), (5002, "a"), (5003, "x" * 3000)]
    vendors = [(i, "hot name") for i in range(40)] + list(enumerate(some_names(80, 4, 8), 100)) + [(900, None), (901, ""), (902, "b"), (903, "x" * 3001), (904, "é")]
    c = spark.createDataFrame([(*x, "y", 1) for x in clients], "client_id long, name string, vendor_id string, distance int")
    v = spark.createDataFrame([(*x, "z") for x in vendors], "vendor_id long, name string, asked string")
    out = namejoin.vendor_clients(c, v)
    assert out.columns == ["vendor_id", "distance", "n_clients", "first_client_id", "clients_crc"]
    assert sorted(map(tuple, out.collect())) == expected(clients, vendors)
    assert namejoin.vendor_clients(c.limit(0), v).count() == 0 and namejoin.vendor_clients(c, v.limit(0)).count() == 0


def test_tables(spark):
    """The registered query on the smallest tables."""
    from fitloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(k, "name").collect()]
    got = sorted(map(tuple, QUERIES["op13_name_join"](spark, d).collect()))
    assert got == expected(read("clients", "client_id"), read("vendors", "vendor_id"))
