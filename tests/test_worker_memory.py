"""What a Python worker holds at once is bounded, and dictionaries start no workers of their own."""

import pyarrow as pa

from fitloom.operators import dictionary as DI
from fitloom.operators import sections as SE
from fitloom.plans import whole
from fitloom.plans.texts import WORDS
from fitloom.sources import shared


def test_dictionaries_need_no_workers(spark):
    for df in DI.from_rows(spark, WORDS):
        assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    skills, aliases, parents = DI.from_rows(spark, WORDS)
    assert {r.canonical for r in skills.collect()} == {w[0] for w in WORDS} and [tuple(r) for r in parents.collect()] == [("Tion", "Stem")]
    assert aliases.count() == len(aliases.dropDuplicates(["alias"]).collect()) and aliases.schema.simpleString() == "struct<alias:string,canonical:string,ord:int>"
    assert [d.count() for d in DI.from_rows(spark, [])] == [0, 0, 0]


def test_pieces_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(shared, "BYTES_AT_ONCE", 10)
    monkeypatch.setattr(shared, "AT_ONCE", 3)
    texts = ["aaaa", "bbbb", None, "cccc", "", "d" * 50, "", "", "", "", "e", None]
    got = [b.column(1).to_pylist() for b in shared.slices(iter([pa.record_batch({"k": list(range(12)), "t": texts}), pa.record_batch({"k": [1], "t": pa.array([None], pa.string())})]))]
    assert got == [["aaaa", "bbbb", None], ["cccc", ""], ["d" * 50], ["", "", ""], ["", "e", None], [None]]


def test_mentions_of_a_long_line_come_in_pieces(spark, monkeypatch):
    """Every mention's clause is the whole line here: together they would be the square of it."""
    alias = DI.from_rows(spark, WORDS)[1]
    docs = spark.createDataFrame([(1, "the stem " * 2000), (2, None), (3, ""), (4, "none"), (5, "which")], "doc_id long, text string")
    sizes, make = [], pa.RecordBatch.from_arrays
    frame = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: frame.append(f) or df)
    DI.scan_around(docs, alias)
    monkeypatch.undo()
    for b in frame[0](iter([make([pa.array([1, 2, 3, 4, 5], pa.int64()), pa.array([r.text for r in docs.orderBy("doc_id").collect()])], names=["doc_id", "text"])])):
        sizes.append((b.num_rows, b.nbytes))
    assert sum(n for n, _ in sizes) == 4001 and max(size for _, size in sizes) < 6 << 20
    assert DI.scan(docs, alias).count() == 4001


def test_lines_without_offsets_need_no_workers(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "a\r\nb\n\n"), (5, "\n\n技能：x\n😀 y\x00z\n"), (6, "l\n" * 3000 + "教育背景\nz"), (7, "一" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("whole_sections", "whole_judge_demand", "whole_clean_heading", "whole_strip_bullet", "whole_date_ranges", "whole_years_requirement"):
        assert "MapInArrow" not in whole.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(SE.numbered(docs), SE.lines(docs))
    assert same(SE.sections(docs, offsets=False), SE.sections(docs))
    assert same(SE.tagged_lines(docs, offsets=False), SE.tagged_lines(docs))
