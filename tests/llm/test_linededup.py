"""Line dedup: brute force, merged overlaps, odd inputs."""

import random
import time

from fitloom.llm import linededup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    seen, gone = {}, {}
    for doc_id, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        full = [(i, x.strip(WHITE)) for i, x in enumerate(text.split("\n")) if x.strip(WHITE)]
        for k in range(len(full) - 2):
            w = tuple(x for _, x in full[k : k + 3])
            at = [i for i, _ in full[k : k + 3]]
            first, kept = seen.setdefault(w, (doc_id, at))
            if kept is not at:
                # What the kept occurrence itself covers stays.
                gone.setdefault(doc_id, set()).update(i for i in at if first != doc_id or i not in kept)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(-1, None), (-2, ""), (-3, "a\nb"), (-4, "\n\n\n")]
    pool = [f"line {i}" for i in range(12)] + ["", "  ", " line 3\t"]
    rows += [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 25)))) for i in range(150)]
    rows += [(200 + i, "hot one\nhot two\n hot three \nhot four\ntail %d" % i) for i in range(60)]
    rows += [(300, "z\nz\nz\nz\nz\nend"), (301, "z\nz\nz\nz")]
    rows.append((500, "\n".join(str(i % 900) for i in range(20_000))))
    assert brute([(1, "a\na\na\na\nb")]) == {1: "a\na\na\nb"}
    docs = spark.createDataFrame([(d, t, "s", "g", "t") for d, t in rows], "doc_id long, text string, digest string, gone string, __text string")
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5), (1, "a\nb\nc", 5), (2, "a\nb\nc\nd", 7), (None, "a\nb\nc", 5)], "doc_id long, text string, n_chars long")
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect())
    assert sorted(t for d, t, _ in got if d == "1") in (["", ""], ["a\nb\nc"] * 2)
    assert ("2", "d", 1) in got and len(got) == 4
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_many_lines(spark):
    """100,000 lines of one document, nearly all of them repeated, take time in proportion."""
    text = "\n".join(f"line {i % 20_000}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    kept = linededup.dedup_lines(df).first().text
    assert time.time() - began < 60 and kept == "\n".join(f"line {i}" for i in range(20_000))
