"""Toxicity: held-out accuracy, odd inputs, no leaks from the held-out fold."""

import random
import zlib

from fitloom.llm import toxicity
from fitloom.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit / sum(r.toxic for r in got) > 0.75
    assert hit / max(1, sum(r.predicted for r in got)) > 0.93
    assert all(0 <= r.score <= 1 for r in got)


def small(spark, n=600):
    rng = random.Random(1)
    ordinary = ["".join(rng.choices("aeioulnrst", k=rng.randrange(3, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = rng.choices(ordinary, k=40)
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vileword", "foulterm"])
            w[rng.randrange(40)] = rng.choice(["vileword", "foulterm"])
        rows.append((i, " ".join(w), "src", float(toxic)))
        labels.append((i, int(toxic)))
    rows += [(n, None, None, 0.0), (n + 1, "", "s", 0.0), (n + 2, "VILEWORD " * 20_000, "s", 0.0), (n + 2, "VILEWORD " * 20_000, "s", 0.0), (None, "plain", "s", 0.0), (n + 3, "z" * 90_000, "s", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_small_and_odd(spark):
    docs, labels = small(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 606
    by = {r.doc_id: r for r in rows}
    right = [by[i].predicted == int(i % 4 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.95
    assert by[600].score == by[601].score < 0.5 and by[602].predicted == 1
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity.classify(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_no_labels_and_no_rows(spark):
    docs, labels = small(spark, 20)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
