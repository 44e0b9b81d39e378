"""Sources, sinks, payloads, streams."""

import json

from pyspark.sql import functions as F

from fitloom.sources import config, files, payloads, store
from fitloom.streaming import ingest


def test_uploads(spark, tmp_path):
    for name, data in {"a.txt": "你好".encode("gbk"), "b.md": "﻿x".encode(), "c.exe": b"x", "d.txt": b" \n", "e.txt": b"\xff\xff\xff\xff\x00", "f.json": b"{}" * 10, "g.pdf": b"nope"}.items():
        (tmp_path / name).write_bytes(data)
    ok, bad = files.read_uploads(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in ok.collect()} == {"a.txt": "你好", "b.md": "x", "f.json": "{}" * 10}
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"c.exe", "d.txt", "e.txt", "g.pdf"}
    ok, bad = files.read_uploads(spark, str(tmp_path), 0.000015)
    assert {r.reason for r in bad.where(F.col("path").endswith("f.json")).collect()} == {"too large"}


def test_store(spark, tmp_path):
    good = {"id": "0123456789ab", "text": "hello", "extra": 1}
    for name, body in {"a.json": json.dumps(good), "b.json": "{broken", "c.json": json.dumps({"id": "bad", "text": "x"}), "d.json": json.dumps({"id": "0123456789ac"})}.items():
        (tmp_path / name).write_text(body)
    rows = store.load(spark, str(tmp_path)).collect()
    assert [(r.id, r.char_count, r["name"], r.source) for r in rows] == [("0123456789ab", 5, "", "upload")]
    docs = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None), (4, "x" * 60_001)], "seq int, text string")
    ok, bad = store.accept(docs)
    assert ok.count() == 1 and {r.reason for r in bad.collect()} == {"empty", "too long"}
    ident = ok.first().id
    assert store.get(ok, ident).count() == 1 and store.get(ok, "../etc").count() == 0
    assert store.remove(ok, ok).count() == 0
    req = spark.createDataFrame([(1, " given ", ident), (2, "", ident), (3, None, "none")], "q int, text string, resume_id string")
    assert [r.resolved for r in store.resolve(req, ok).orderBy("q").collect()] == ["given", "a", None]
    store.save(ok.select("id", "text"), str(tmp_path / "out"))
    assert store.load(spark, str(tmp_path / "out")).count() == 1


def test_many_records_of_a_file(spark, tmp_path):
    """All records of a file come back, however many a task wrote; a file of other names is one record or a list."""
    path = tmp_path / "in"
    docs = spark.range(200).selectExpr("substr(sha2(cast(id as string), 256), 1, 12) AS id", "concat('line\n{', id, '}') AS text", "'n' AS name").coalesce(1)
    store.save(docs, str(path))
    store.save(docs.limit(3), str(path))
    one = {"id": "0123456789ab", "text": "a\n{b"}
    (path / "one.json").write_text(json.dumps(one, indent=2))
    (path / "list.json").write_text(json.dumps([one, {**one, "id": "0123456789ac"}], indent=2))
    (path / "part-00000-x.json").write_text(json.dumps(one) + "\n{broken\n" + json.dumps(one))
    got = store.load(spark, str(path))
    assert got.count() == 208 and got.select("id").distinct().count() == 202
    assert {r.text for r in got.where("name <> 'n'").collect()} == {one["text"]}
    assert sorted(r.text for r in got.where("name = 'n'").dropDuplicates(["id"]).collect()) == sorted(r.text for r in docs.collect())


def test_payloads(spark):
    rows = [(1, 'x {"name": "A", "graduation_year": "2027届", "skills": "a，b，A", "highlights": ["h1", "h1"]} y'), (2, "none"), (3, '{"graduation_year": true}')]
    got = {r.id: r for r in payloads.sanitize_resume(spark.createDataFrame(rows, "id int, p string"), "p").collect()}
    assert (got[1].name, got[1].graduation_year, got[1].skills, got[1].highlights) == ("A", 2027, ["a", "b"], ["h1"])
    assert got[2].skills is None and got[3].graduation_year is None


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    recs = [{"text": t, "name": "n", "source": "s", "uploaded_at": "2025-01-01T00:00:00"} for t in ("a", "b", "a", " ")]
    (src / "1.json").write_text("\n".join(map(json.dumps, recs)))
    q = ingest.start(ingest.stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    batch = ingest.accepted(spark.read.schema(ingest.INPUT).json(str(src)))
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.id for r in batch.collect()) and len(got) == 2
    assert ingest.counters(spark.read.schema(ingest.INPUT).json(str(src))).first().n == 4


def test_config():
    s = config.Settings.load({"MAX_UPLOAD_MB": "oops", "TOP_K": "99999", "PERSIST": "no"})
    assert (s.max_upload_mb, s.top_k, s.persist) == (5.0, 1000, False)
    assert config.mask("") == "" and config.mask("short") == "****" and config.mask("sk-123456789") == "sk-1****6789"
