"""Token counts: equal to the library's on whole texts; only distinct misses are encoded."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fitloom.llm import tokencount

JSON = public_tokenizers.path("byte_bpe_50k.json")
tok = Tokenizer.from_file(JSON)
count = tokencount.counter(JSON)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab1.,' \n\t\u00a0\u2003\x1c\x85é中😀sdt", "<|endoftext|>", "  ", " a"]), max_size=40).map("".join))
def test_pieces_count_as_the_whole(text):
    assert "".join(tokencount.pieces(text)) == text
    assert count([text]) == [len(tok.encode(text, add_special_tokens=False))]


def test_small_memo(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 5)
    texts = ["a b c d e f g h i j", "k l m n", "x" * 500 + " a", "a " * 5000, ""]
    assert tokencount.counter(JSON)(texts) == [len(tok.encode(t)) for t in texts]


def test_cache_is_filled_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = [(1, None), (2, ""), (3, "Hello world"), (4, "Hello world"), (4, "Hello world"), (None, "x"), (5, "word " * 600), (6, "a<|endoftext|> b")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, digest string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, JSON, cache).collect())
    want = sorted((str(d), len((t or "").encode()), n := len(tok.encode(t or "")), n > 512) for d, t in rows)
    assert got == want
    assert tokencount.read_cache(spark, cache).count() == 5
    more = docs.unionByName(spark.createDataFrame([(9, "new text", "c")], docs.schema))
    assert tokencount.count_tokens(more, JSON, cache).count() == 9
    assert tokencount.read_cache(spark, cache).count() == 6
    assert tokencount.count_tokens(docs.limit(0), JSON, cache).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    texts = ["Hello  wörld", "", " a b"]
    if name.endswith("json"):
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert tokencount.counter(path)(texts) == want
