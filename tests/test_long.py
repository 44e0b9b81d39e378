"""Texts of any length: JSON objects in prose, experience sections; odd weights."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitloom.operators import experience
from fitloom.operators import scoring as S
from fitloom.sources import payloads


def balanced(text):
    """The first brace's object, character by character."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


TEXTS = ["{}", "a {b} c", "no", "}{", '{"a": "}"} x', '{"a": "\\"}"}', "\\{ {\\} }", '{"\\\\"} }', "{{}", '"{" }', "😀{é}😀"]


def test_balanced_object(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(rng.choice(list('{}"\\ab '), int(n))) for n in rng.integers(0, 30, 3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(payloads.balanced_object(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == [balanced(t) for t in texts]


def found(spark, text):
    return spark.createDataFrame([(text,)], "p string").select(payloads.extract_json(F.col("p")).cast("string").alias("o")).first().o


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('[1, {"a": 2}, {"a": 3}]', {"a": 2}), ("```\nno\n``` and ```json\n{\"a\": 3}\n```", {"a": 3}), ('```JSON so {"a": 4} there```', {"a": 4}),
        ('he says {"a": "x } y"} and {"b": 1}', {"a": "x } y"}), ("{broken", None), ("", None), (None, None), ("[1, 2]", None), ('{bad} {"a": 1}', None),
    ],
)
def test_extract(spark, text, want):
    out = found(spark, text)
    assert (None if out is None else json.loads(out)) == want


def test_long_payload(spark):
    """An object of five million characters within prose."""
    body = {"title": "工程师", "skills": [f"skill {i} \"q\" {{" for i in range(230_000)]}
    text = "so here: " + json.dumps(body, ensure_ascii=False) + " } done"
    assert len(text) > 5_000_000 and json.loads(found(spark, text)) == body


def split(lines):
    """Entries of a section, line by line, by the rule in ``experience.entries`` (no line here is dated)."""
    out = []
    for x in lines:
        head = not x.startswith("- ") and len(x) <= 40
        content = x[2:] if x.startswith("- ") else x
        if head and not (out and out[-1][0] and not out[-1][1]):
            out.append([x, []])
        elif head and len(out[-1][0]) < 80:
            out[-1][0] += " " + x
        else:
            if not out:
                out.append(["", []])
            out[-1][1].append(content)
    return out


KINDS = ["- bullet", "short header", "x" * 41, "h" * 39]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(KINDS), max_size=12), min_size=30, max_size=60))
def test_entries(spark, bodies):
    df = spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(bodies)], "i int, body string")
    got = {r.i: [[e.header, e.bullets] for e in r.e] for r in df.select("i", experience.entries(F.col("body")).alias("e")).collect()}
    assert got == {i: split(b) for i, b in enumerate(bodies)}


def test_long_section(spark):
    """200,000 lines in one section take seconds, not hours."""
    lines = ["short header"] + [f"- bullet {i}" for i in range(200_000)]
    df = spark.createDataFrame([("\n".join(lines),)], "body string")
    began = time.time()
    e = df.select(experience.entries(F.col("body")).alias("e")).first().e
    assert time.time() - began < 60 and len(e) == 1 and e[0].bullets[-1] == "bullet 199999" and len(e[0].bullets) == 200_000


def test_odd_weights(spark):
    """Weights that are not a number count 0, infinite ones fall back, in the long form."""
    dims = spark.createDataFrame([(1, 1, k, 50.0, True) for k in S.DIMENSIONS], "jd_id long, resume_id long, key string, score double, applicable boolean")
    w = spark.createDataFrame([("must_have", "nan"), ("domain", "-inf"), ("project", "inf")], "key string, weight string")
    got = {r.key: r.weight for r in S.normalize_weights(dims, w).collect()}
    assert got["must_have"] == got["domain"] == 0 and got["project"] == pytest.approx(0.10 / 0.52)
