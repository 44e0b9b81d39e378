"""Segmentations: exact probabilities on small words, sampling without replacement, round trips."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm import segment

PATH = public_tokenizers.path("piece_bpe_32k.model")
vocab = segment.Vocabulary(PATH)
model = sentencepiece.SentencePieceProcessor(model_file=PATH)


def weights():
    return {vocab.pieces[i]: w for i, w in zip(vocab.id.tolist(), vocab.weight.tolist(), strict=True)}


def every(text):
    """All segmentations with their probabilities, by brute force."""
    w, t = weights(), segment.SPACE + text.replace(" ", segment.SPACE)
    found = {}

    def go(i, ids, logw):
        if i == len(t):
            found[tuple(ids)] = logw
            return
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in w:
                go(j, [*ids, model.piece_to_id(t[i:j])], logw + w[t[i:j]])
        if t[i] not in w:
            b = t[i].encode()
            go(i + 1, [*ids, *(vocab.bytes[x] for x in b)], logw + len(b) * vocab.byte_weight)

    go(0, [], 0.0)
    top = max(found.values())
    z = top + np.log(sum(np.exp(v - top) for v in found.values()))
    return {k: v - z for k, v in found.items()}


@pytest.mark.parametrize("text", ["a", "the", "hi x", "ab\ncé"])
def test_probabilities_are_exact_and_all_are_found(text):
    want = every(text)
    (got,) = segment.sample([7], [text], vocab, len(want) + 3)
    assert {tuple(ids) for ids, *_ in got} == set(want)
    for ids, logp, _, inclusion in got:
        assert np.isclose(logp, want[tuple(ids)]) and inclusion == 1.0
    values = [g for _, _, g, _ in got]
    assert values == sorted(values, reverse=True)


def test_frequencies_without_replacement():
    p = {k: float(np.exp(v)) for k, v in every("the").items()}
    n = 6000
    rows = segment.sample([int(x) for x in segment.mix(np.arange(n, dtype=np.uint64))], ["the"] * n, vocab, 2)
    first, second = Counter(tuple(r[0][0]) for r in rows), Counter(tuple(r[1][0]) for r in rows)
    for k, v in p.items():
        assert abs(first[k] / n - v) < 0.03
        want = sum(q * v / (1 - q) for j, q in p.items() if j != k)
        assert abs(second[k] / n - want) < 0.03
    assert all(r[0][0] != r[1][0] for r in rows)
    # Horvitz-Thompson: sums weighted by probability over inclusion score are unbiased.
    assert abs(np.mean([sum(np.exp(lp) / inc for _, lp, _, inc in r) for r in rows]) - 1) < 0.05


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([*"ab th \n\t", "é", "中", "😀", "\x00", "ﬁ"]), max_size=30), max_size=5))
def test_round_trip(texts):
    for text, got in zip(texts, segment.sample(list(range(len(texts))), texts, vocab, 4), strict=True):
        assert len({tuple(ids) for ids, *_ in got}) == len(got) >= 1
        for ids, *_ in got:
            assert vocab.decode(ids) == text == model.decode(ids)


def test_chunks_do_not_matter():
    texts = ["the cat sat", "on a mat", "", "x" * 3000, "word " * 500]
    keys = [5, 6, 7, 8, 9]
    together = segment.sample(keys, texts, vocab, 3)
    alone = [segment.sample([k], [t], vocab, 3)[0] for k, t in zip(keys, texts, strict=True)]
    for a, b in zip(together, alone, strict=True):
        assert [x[0] for x in a] == [x[0] for x in b]
        assert np.allclose([x[1:] for x in a], [x[1:] for x in b])


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x"), (4, "z" * 50_000), (5, "a b " * 5_000), (6, "▁")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, sample int")
    out = segment.encode_samples(docs, PATH, k=3)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 6, None: 2, 4: 3, 5: 3, 6: 2}
    assert all(r.decoded == (r.doc_id != 6) for r in got) and {r.inclusion for r in got if r.doc_id in (1, 2)} == {1.0}
    text = {(r.doc_id, r["sample"]): r.text for r in segment.decode_samples(out, PATH).collect()}
    assert text[4, 2] == "z" * 50_000 and text[3, 1] == "Hello  world"
    assert segment.encode_samples(docs.limit(0), PATH).count() == 0
