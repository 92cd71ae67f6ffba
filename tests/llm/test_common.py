import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from payrecon.llm.common import Bloom, chars_at, components, ngrams, sub_batches, utf8, whole_groups, words

WORD = re.compile("[A-Za-z0-9_\u0080-\U0010ffff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBéÉ ü.,\n日🙂_9", max_size=40)), max_size=8))
def test_words_are_those_of_a_pattern(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    w = words(data, offsets)
    for i, t in enumerate(texts):
        own = slice(w.offsets[i], w.offsets[i + 1])
        found = [bytes(data[s:e]).decode() for s, e in zip(w.starts[own], w.ends[own])]
        assert found == WORD.findall(t or "")
        assert list(chars_at(data, int(offsets[i]), w.starts[own])) == [m.start() for m in WORD.finditer(t or "")]


def test_hashes_ignore_case_and_place():
    texts = ["Éclair UND", "x y éclair und", None, "und"]
    w = words(*utf8(pa.array(texts)))
    h = w.hashes.tolist()
    assert h[0] == h[4] and h[1] == h[5] == h[6] and len(set(h)) == 4


def test_slices_do_not_cut_words(monkeypatch):
    text = ["alpha beta gamma " * 50, "delta" * 30]
    whole = words(*utf8(pa.array(text)))
    monkeypatch.setattr("payrecon.llm.common.SLICE", 7)
    cut = words(*utf8(pa.array(text)))
    assert np.array_equal(whole.hashes, cut.hashes) and np.array_equal(whole.starts, cut.starts)


def test_ngrams_of_short_and_long_texts():
    w = words(*utf8(pa.array(["a b c d e f", "a b", "", "b c d e f"])))
    grams, offsets = ngrams(w, 5)
    assert offsets.tolist() == [0, 2, 3, 3, 4] and grams[1] == grams[3] and len(set(grams.tolist())) == 3


def test_groups_are_never_cut():
    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + 3], "v": list(range(i, min(i + 3, 8)))}) for i in range(0, 8, 3)]
    seen = [t.column("k").to_pylist() for t in whole_groups(batches, "k")]
    assert sum(seen, []) == keys
    assert all(not set(a) & set(b) for a, b in zip(seen, seen[1:]))


def test_sub_batches_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (3, 50, 1, 0, 7)] + [None]})
    assert [t for b in sub_batches([batch], limit=10) for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_filter_has_no_false_negatives(spark):
    values = np.arange(1, 4000, dtype=np.int64) * 7919 * 104729
    bloom = Bloom.of(spark.createDataFrame([(int(v),) for v in values], "h long"), "h", 16)
    assert bloom.has(values.view(np.uint64)).all()
    assert bloom.has((values + 1).view(np.uint64)).mean() < 0.2


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 3), (5, 6), (6, 5), (8, 8), (7, 4), (4, 10), (20, 10)]
    found = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5), (4, 4), (7, 4), (10, 4), (20, 4)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
