"""Personal data: base spans against plain regular expressions, consistency through skip edges, odd inputs."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm import pii

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from([*"a.@-+ 0159()é😀%_\n", "4111111111111111", "10.0.0.255", "300.1.1.1", "a@b.co", "+1 (017) 555-7713", "0000255", "x@y"]), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


TEXTS = ["call +1 (017) 555-7713 now", "mail a.b@c.example.com or a.b@c.example.com!", "from 10.2.3.4 to 300.2.3.4", "card 4111111111111111 ok", "year 2024 and 3.0 items", "4111111111111112 no", "x 17 y 250 z 1234567"] * 30


def exact(g, base, w):
    """Label probabilities by enumerating all labellings."""
    labels, n = w.unary.shape[1], len(g.spans)
    unary = np.array([w.unary[f].sum(0) for f in g.features])
    for i, b in enumerate(base):
        unary[i, b] += 8 * (b > 0)
    total = np.zeros((n, labels))
    for y in product(range(labels), repeat=n):
        z = sum(unary[i, y[i]] for i in range(n)) + sum(w.chain[y[i], y[j]] for i, j in g.chain) + sum(w.skip[k][y[i], y[j]] for i, j, k in g.skip)
        for i in range(n):
            total[i, y[i]] += np.exp(z)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("text", "most"), [
    ("call +1 (017) 555-7713 or 17", 1e-3),
    ("to 555-7713 later 555-7713 and 555-7713", 1e-3),
    ("a@b.co 10.2.3.4 1234567 then", 1e-3),
    ("+1 (017) 555-7713 then 5557713 or 555-7713", 0.05),
    ("10.2.3.4 10.2.3.4 x 10.2.3.4 7", 0.05),
])
def test_marginals_against_enumeration(text, most):
    w = pii.train(TEXTS)
    g = pii.graph(text)
    base = pii.held(g, pii.base_spans(text))
    assert 0 < len(g.spans) <= 6 and np.abs(pii.marginals(g, base, w) - exact(g, base, w)).max() < most


def test_skip_weights_are_learned():
    few, many = pii.train(TEXTS), pii.train(["mail a.b@c.example.com and a.b@c.example.com again"] * 400 + TEXTS)
    assert many.skip[pii.EQUAL][1, 1] > 0 > many.skip[pii.EQUAL][0, 1] and many.skip[pii.EQUAL][0, 1] < few.skip[pii.EQUAL][0, 1]


def test_precision_and_recall_of_added_spans():
    """Numbers that stand whole once and later without their prefix; other numbers of the same shape stay alone."""
    rng = random.Random(2)
    w, right, found, wanted = pii.train(TEXTS), 0, 0, 0
    for _ in range(150):
        a, b, c, other = (rng.randrange(100, 1000) for _ in range(4))
        last = f"{b}-{c}{rng.randrange(10)}"
        text = f"call +1 ({a}) {last} today, room {other}. Ask for {last} later, code {other}{b}"
        wanted += 1
        _, added = pii.find(text, w)
        found += len(added)
        right += sum(text[s:e] == last and k == 3 for s, k, e in added)
    assert right >= 0.9 * wanted and right >= 0.9 * found


def test_field_adds_repeats_and_keeps_clean_text_clean():
    w = pii.train(TEXTS)
    text = "call +1 (017) 555-7713 now. Later words. Just 555-7713 again"
    base, added = pii.find(text, w)
    assert [text[a:b] for a, _, b in base] == ["+1 (017) 555-7713"]
    assert [(text[a:b], k) for a, k, b in added] == [("555-7713", 3)]
    two = "pay 4111111111111111 4111111111111111 at once"
    base, added = pii.find(two, w)
    assert base == [] and [two[a:b] for a, _, b in added] == ["4111111111111111"] * 2
    for clean in ("version 3.0 of 2024", "page 17 of 250", "", None, "no digits at all"):
        assert pii.find(clean, w) == ([], [])


def test_query_columns(spark):
    rows = [(1, None), (2, ""), (3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[1]), (4, "1 " * 30_000), (5, "9" * 60_000), (6, "a" * 60_000 + "@"), (7, "é😀 a@b.co")]
    rows += [(10 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_all(docs).collect()}
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_phone == 1 and got[3].spans == "phone:5:22"
    assert got[7].spans == "email:3:9" and got[None].n_email == 2
    assert pii.find_all(docs).count() == len(rows) and pii.find_all(docs.limit(0)).count() == 0
