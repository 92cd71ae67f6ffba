"""Repeated passages by a sparse suffix array.

Of the 20-word grams of all texts, those at content-selected positions stand for the suffixes that begin there: a gram is
a minimiser if its hash is the smallest in some stretch of 31 neighbouring ones. Any passage of 50 words is such a stretch
and holds one minimiser as its smallest, and equal passages hold the same at the same place. So a suffix array over these
suffixes alone is enough: one row a minimiser, with the 30 words after its gram and the 30 before it.

Suffixes are partitioned by the hash of their gram and sorted by it and the words that follow. Neighbours are compared, which gives
how many words they agree in to the right; suffixes that agree in r words or more are a stretch of the order. For every r from 30 to 0 the
suffixes of a stretch are put in the order of the 30-r words before them, and neighbours that agree in these too, in two documents,
are a match of 50 words, extended to the left by 30-r. A suffix's matches make one range of words; ranges of a document that
overlap are one passage. Nothing is compared but neighbours, and no pair of documents is ever listed.

A gram that one document alone holds cannot match: its suffixes are left out before they are shuffled, by a filter of
fixed size made from the counted ones. A gram held by more than ``HOT`` suffixes would be too much for one task: its
suffixes are exploded into the 31 ways to divide 30 words between left and right, counted by a hash of these words with partial
aggregates, and joined back to the keys that two documents hold. That is the same question asked by key instead of by
order, and splits over tasks however hot the gram is.

Words are compared by hashes: 64 bits for the gram, 32 for each of the words around it (64 for all of them in hot grams).

Defined results: null, empty and short texts hold no passage; a passage repeated within one document only is not
reported; rows with a null id are left out; rows that share an id count as one document; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from payrecon.llm.common import U64, Bloom, Words, mix64, ngrams, staged, sub_batches, utf8, whole_groups, words

MIN_WORDS, GRAM = 50, 20
#: Suffixes of one gram that one task sorts; they take about 1,500 bytes each there.
HOT = 150_000
_FILTER_BITS, _HOT_BITS = 24, 20


def _sliding(values: np.ndarray, size: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) of each value and the size-1 after it; the end is filled with shorter stretches."""
    out, reach = values.copy(), 1
    while reach * 2 <= size:
        out[:-reach or None] = take(out[:-reach or None], out[reach:])
        reach *= 2
    rest = size - reach
    if rest and len(out) > rest:
        out[:-rest] = take(out[:-rest], out[rest:])
    return out


def minimisers(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, text index) of the grams that are smallest in some window of ``size`` words of their text."""
    grams, cuts = ngrams(w, GRAM)
    stretch = size - GRAM + 1
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    inside = np.arange(len(grams)) + stretch <= cuts[1:][text]
    if not inside.any():
        return text[:0], grams[:0], text[:0]
    least = np.where(inside, _sliding(grams, stretch, np.minimum), U64(0))
    # A gram is the smallest of a window if the largest of its windows' smallest is itself. Windows of the text before
    # end too early to reach into this one.
    chosen = np.flatnonzero((_sliding(least[::-1], stretch, np.maximum)[::-1] == grams) & (grams != 0))
    text = text[chosen]
    return w.offsets[:-1][text] + chosen - cuts[:-1][text], grams[chosen], text


def _grams(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(h, lo, hi, n): minimisers of a batch with the smallest and the largest document that hold them and their number."""
    for batch in sub_batches(batches):
        _, h, text = minimisers(words(*utf8(batch.column("text"))), size)
        if not len(h):
            continue
        doc = batch.column("doc_id").to_numpy()[text]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        ends = np.r_[head[1:], len(h)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[head].view(np.int64), doc[head], doc[ends - 1], ends - head)], ["h", "lo", "hi", "n"])


_SUFFIX = "h long, after binary, before binary, doc_id long, place int, start int, end int, steps binary"


def _rows(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _suffixes(batches: Iterable[pa.RecordBatch], size: int, wanted: Bloom, hot: Bloom, only_hot: bool) -> Iterator[pa.RecordBatch]:
    """The suffixes whose gram may be in two documents: codes of the words after and before it (0: none), their place in
    words and in code points, and the steps in code points from word to word on either side."""
    reach = np.arange(size - GRAM)
    for batch in sub_batches(batches, limit=1 << 20):
        data, offsets = utf8(batch.column("text"))
        w = words(data, offsets)
        first, h, text = minimisers(w, size)
        hit = np.flatnonzero(wanted.has(h) & (hot.has(h) == only_hot))
        if not len(hit):
            continue
        first, h, text = first[hit], h[hit], text[hit]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        codes = (w.hashes >> U64(32)).astype(np.uint32) | np.uint32(1)  # never 0
        starts, ends = chars[w.starts], chars[w.ends]
        for at in range(0, len(hit), 5_000):
            p, t = first[at:at + 5_000], text[at:at + 5_000]
            right, left = p[:, None] + GRAM + reach, p[:, None] - 1 - reach
            there, here = right < w.offsets[1:][t][:, None], left >= w.offsets[:-1][t][:, None]
            right, left = np.where(there, right, 0), np.where(here, left, 0)
            forth = np.where(there, ends[right] - ends[np.where(there, right - 1, 0)], 0)
            back = np.where(here, starts[np.where(here, left + 1, 0)] - starts[left], 0)
            base = chars[offsets[t]]
            yield pa.RecordBatch.from_arrays([
                pa.array(h[at:at + 5_000].view(np.int64)), _rows(np.where(there, codes[right], np.uint32(0))), _rows(np.where(here, codes[left], np.uint32(0))),
                batch.column("doc_id").take(pa.array(t)), pa.array((p - w.offsets[t]).astype(np.int32)),
                pa.array((starts[p] - base).astype(np.int32)), pa.array((ends[p + GRAM - 1] - base).astype(np.int32)),
                _rows(np.concatenate([back, forth], 1).astype(np.int32))],
                ["h", "after", "before", "doc_id", "place", "start", "end", "steps"])


def _of(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(after, before, steps, doc, place, start, end) of suffixes."""
    after, before = (_matrix(table.column(c), "<u4") for c in ("after", "before"))
    return after, before, _matrix(table.column("steps"), "<i4"), *(
        table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "place", "start", "end"))


def _reached(steps: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in code points of the word ``left`` words before each suffix, and of the end of the word ``right`` words after its gram."""
    half = steps.shape[1] // 2
    count = np.arange(half)
    back = np.where(count < left[:, None], steps[:, :half], 0).sum(1, dtype=np.int64)
    return start - back, end + np.where(count < right[:, None], steps[:, half:], 0).sum(1, dtype=np.int64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2, ... codes of every row."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=U64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = mix64(out[:, k] * U64(3) + codes[:, k].astype(U64))
    return out


_RANGE = "doc_id long, a long, b long, start long, end long, other_doc long"


def _matches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range of words that each suffix shares with another document, from suffixes sorted by gram and following words."""
    for table in whole_groups(batches, "h"):
        h = table.column("h").to_numpy()
        after, before, steps, doc, place, start, end = _of(table)
        width = after.shape[1]
        agree, so_far = np.zeros(max(0, len(h) - 1), np.int64), h[1:] == h[:-1]
        agree[~so_far] = -1
        for k in range(width):
            so_far = so_far & (after[1:, k] == after[:-1, k]) & (after[1:, k] != 0)
            agree += so_far
        n_before, n_after = (before != 0).sum(1), (after != 0).sum(1)
        left = np.zeros(len(doc), dtype=U64)  # hash of the d words before
        low, high, other = np.full(len(doc), width + 1), np.full(len(doc), -1), np.zeros(len(doc), np.int64)
        for d in range(width + 1):
            r = width - d
            if d:
                left = mix64(left * U64(3) + before[:, d - 1].astype(U64))
            stretch = np.concatenate([[0], np.cumsum(agree < r)])
            rows = np.flatnonzero((n_before >= d) & (n_after >= r))
            if len(rows) < 2:
                continue
            rows = rows[np.lexsort((doc[rows], left[rows], stretch[rows]))]
            cut = np.flatnonzero(np.r_[True, (stretch[rows[1:]] != stretch[rows[:-1]]) | (left[rows[1:]] != left[rows[:-1]])])
            size = np.diff(np.r_[cut, len(rows)])
            lo, hi = np.repeat(doc[rows[cut]], size), np.repeat(doc[rows[cut + size - 1]], size)
            hit = lo < hi
            rows, lo, hi = rows[hit], lo[hit], hi[hit]
            low[rows], high[rows] = np.minimum(low[rows], d), d
            other[rows] = np.where(doc[rows] == lo, hi, lo)
        own = np.flatnonzero(high >= 0)
        if len(own):
            # Windows reaching low to high words to the left are one range, as each is longer than they are apart.
            begin, stop = _reached(steps[own], start[own], end[own], high[own], width - low[own])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                doc[own], place[own] - high[own], place[own] + GRAM + width - low[own], begin, stop, other[own])],
                ["doc_id", "a", "b", "start", "end", "other_doc"])


_KEYED = "h long, g long, doc_id long, a long, b long, start long, end long"


def _divided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of hot grams in all ways to divide the words between left and right: g is a hash of these words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        after, before, steps, doc, place, start, end = _of(table)
        width = after.shape[1]
        left, right = _prefix_hashes(before), _prefix_hashes(after)
        n_before, n_after = (before != 0).sum(1), (after != 0).sum(1)
        for d in range(width + 1):
            rows = np.flatnonzero((n_before >= d) & (n_after >= width - d))
            g = mix64(mix64(left[rows, d] + U64(d)) ^ right[rows, width - d])
            begin, stop = _reached(steps[rows], start[rows], end[rows], np.full(len(rows), d), np.full(len(rows), width - d))
            yield pa.RecordBatch.from_arrays([
                table.column("h").combine_chunks().take(pa.array(rows)), *[pa.array(x) for x in (
                    g.view(np.int64), doc[rows], place[rows] - d, place[rows] + GRAM + width - d, begin, stop)]],
                ["h", "g", "doc_id", "a", "b", "start", "end"])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping ranges of each document as one passage, from a partition sorted by document and place. Only the
    passage that a batch ends in is kept for the next."""
    held = None

    def result(rows: list[np.ndarray]) -> pa.RecordBatch:
        doc, a, b, s, e, other = rows
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, s, e, b - a, other)], ["doc_id", "start", "end", "n_words", "other_doc"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in ("doc_id", "a", "b", "start", "end", "other_doc")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        doc, a, b, s, e, other = rows
        number = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]).astype(np.int64)
        reach = np.maximum.accumulate((number << 34) + b)
        cut = np.flatnonzero(np.r_[True, (number[1:] << 34) + a[1:] >= reach[:-1]])
        rows = [doc[cut], a[cut], np.maximum.reduceat(b, cut), s[cut], np.maximum.reduceat(e, cut), np.minimum.reduceat(other, cut)]
        held = [x[-1:] for x in rows]
        if len(cut) > 1:
            yield result([x[:-1] for x in rows])
    if held is not None:
        yield result(held)


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage: doc_id, start and end (code points, end exclusive), n_words, and one document that
    holds part of it as well. ``min_words`` may not be below 50, the length that minimisers are laid out for."""
    if min_words < MIN_WORDS:
        raise ValueError(f"min_words must be {MIN_WORDS} or more")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    context = rows.sparkSession.sparkContext
    shared = rows.mapInArrow(lambda it: _grams(it, min_words), "h long, lo long, hi long, n long").groupBy("h").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("h", "n")
    shared = staged(shared, "shared-grams")
    frequent = shared.where(F.col("n") > HOT)
    wanted, hot = context.broadcast(Bloom.of(shared, "h", _FILTER_BITS)), context.broadcast(Bloom.of(frequent, "h", _HOT_BITS))

    def suffixes(only_hot: bool) -> DataFrame:
        return rows.mapInArrow(lambda it: _suffixes(it, min_words, wanted.value, hot.value, only_hot), _SUFFIX)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = suffixes(False).repartition(n, "h").sortWithinPartitions("h", "after").mapInArrow(_matches, _RANGE)
    if not frequent.isEmpty():
        found = staged(suffixes(True), "hot-suffixes").mapInArrow(_divided, _KEYED)
        repeated = found.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        # Written first, so that both sides of the join come straight from a shuffle and a hot key can be split.
        repeated = staged(repeated, "repeated-words")
        other = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other_doc")
        ranges = ranges.union(found.join(repeated, ["h", "g"]).select("doc_id", "a", "b", "start", "end", other))
    return ranges.repartition(n, "doc_id").sortWithinPartitions("doc_id", "a").mapInArrow(
        _merged, "doc_id long, start long, end long, n_words long, other_doc long")
