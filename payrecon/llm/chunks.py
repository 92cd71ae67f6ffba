"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash is rolled over the bytes of a text, in lower case and with every stretch between words as one space, so that
case, punctuation and line breaks do not matter: every step shifts the hash and adds a random value of the next byte, so it
depends on the last 32 bytes only. Where its upper bits are zero a chunk ends. Cut points thus follow the content, and after an
insertion the chunks fall into step again. Chunks of 16 to 128 bytes (32 on average) are identified by a 64-bit
digest; a digest that occurs in more than one document is a repeat, and its occurrence in the smallest document is the
one that deduplication keeps. Neighbouring repeated chunks form a run; runs of at least ``min_words`` words are
reported. As a passage loses up to a chunk at either end, 20 words are asked for to catch passages of 50.

Digests are counted over all chunks of all texts. Only chunks whose digest may repeat, by a filter of fixed size made
from the repeated digests, are listed with their places; an exact count of these follows.

Defined results: null and empty texts have no chunks; a passage repeated within one document only is no repeat; rows with
a null id are left out; rows that share an id count as one document; an empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from payrecon.llm.common import U64, Bloom, _powers, _WORD, _BYTE_HASH, lowered, mix64, staged, sub_batches, utf8, whole_groups

WINDOW, SHORTEST, LONGEST, CUT_BITS = 32, 16, 128, 4
BATCH_BYTES = 2 << 20
_GEAR = (mix64(np.arange(5000, 5256, dtype=U64)) >> U64(32)).astype(np.uint32)
_FILTER_BITS = 25


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of the last 32 bytes' values, each shifted by its distance."""
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:  # sums of 1, 2, 4, ... bytes
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h = longer
        reach *= 2
    return h


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are hashed, and the place of each in ``data``. A text begins with a word and ends with one space at most."""
    low = lowered(data)
    inside = _WORD[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    keep[heads] = inside[heads]  # what another text's last word is followed by
    places = np.flatnonzero(keep)
    return np.where(inside[places], low[places], np.uint8(32)), places


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the chunks of all texts of a batch."""
    points = np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends: list[int] = []
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    firsts = np.searchsorted(points, offsets[:-1] + WINDOW)  # before that the hash would see the previous text
    lasts = np.searchsorted(points, offsets[1:])
    for t, (begin, end, a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), firsts.tolist(), lasts.tolist())):
        if begin == end:
            continue
        before, last = len(ends), begin
        for p in points[a:b].tolist():
            while p - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if p - last >= SHORTEST:
                ends.append(p)
                last = p
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        ends.append(end)
        counts[t] = len(ends) - before
    e = np.array(ends, dtype=np.int64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    first = np.r_[True, text_of[1:] != text_of[:-1]] if len(e) else np.zeros(0, bool)
    return np.where(first, offsets[:-1][text_of], np.r_[0, e[:-1]]) if len(e) else e, e, text_of


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_HASH[data] * up[:len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def _chunked(batches: Iterable[pa.RecordBatch]):
    """Batches with their chunks: bytes ranges in the texts, text index, digests."""
    for batch in sub_batches(batches, limit=BATCH_BYTES):
        data, offsets = utf8(batch.column("text"))
        plain, places = normalised(data, offsets)
        starts, ends, text_of = chunk_bounds(plain, np.searchsorted(places, offsets))
        if len(starts):
            yield batch, data, offsets, places[starts], places[ends - 1] + 1, text_of, digests(plain, starts, ends)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): digests of a batch, once for each text that has them."""
    for *_, text_of, h in _chunked(batches):
        order = np.lexsort((text_of, h))
        h, text_of = h[order], text_of[order]
        values, n = np.unique(h[np.r_[True, (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])


def _places(batches: Iterable[pa.RecordBatch], wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Chunks whose digest may repeat, with their place in code points and their words."""
    for batch, data, offsets, starts, ends, text_of, h in _chunked(batches):
        hit = np.flatnonzero(wanted.has(h))
        if not len(hit):
            continue
        inside = _WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begun = np.concatenate([[0], np.cumsum(begins, dtype=np.int32)])
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        first_chunk = np.searchsorted(text_of, text_of[hit])
        base = chars[offsets[text_of[hit]]]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(text_of[hit])), pa.array((hit - first_chunk).astype(np.int32)),
            pa.array((chars[starts[hit]] - base).astype(np.int32)), pa.array((chars[ends[hit]] - base).astype(np.int32)),
            pa.array((begun[ends[hit]] - begun[starts[hit]]).astype(np.int32)), pa.array(h[hit].view(np.int64))],
            ["doc_id", "place", "start", "end", "n_words", "h"])


def _runs(batches: Iterable[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring repeated chunks of each document."""
    for table in whole_groups(batches, "doc_id"):
        doc, place, start, end, n_words, first = (table.column(c).to_numpy() for c in ("doc_id", "place", "start", "end", "n_words", "first_doc"))
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])
        last = np.r_[cut[1:], len(doc)] - 1
        total = np.add.reduceat(n_words, cut)
        keep = total >= min_words
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (
            doc[cut], start[cut].astype(np.int64), end[last].astype(np.int64), (last - cut + 1).astype(np.int64), total.astype(np.int64),
            np.minimum.reduceat(first, cut), np.logical_and.reduceat(first == doc, cut))],
            ["doc_id", "start", "end", "n_chunks", "n_words", "first_doc", "kept"])


def repeats(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """One row per run of repeated chunks: doc_id, start and end (code points, end exclusive), n_chunks, n_words,
    first_doc (smallest document that holds a chunk of it) and kept (deduplication would leave it here)."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = rows.mapInArrow(_digests, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = Bloom.of(repeated, "h", _FILTER_BITS)
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    places = staged(rows.mapInArrow(
        lambda it: _places(it, shared.value), "doc_id long, place int, start int, end int, n_words int, h long"), "chunk-places")
    first = places.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    # Written first, so that both sides of the join come straight from a shuffle and a hot digest can be split.
    first = staged(first.select("h", "first_doc"), "repeated-chunks")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = places.join(first, "h").drop("h").distinct()
    return found.repartition(n, "doc_id").sortWithinPartitions("doc_id", "place", "start").mapInArrow(
        lambda it: _runs(it, min_words),
        "doc_id long, start long, end long, n_chunks long, n_words long, first_doc long, kept boolean")
