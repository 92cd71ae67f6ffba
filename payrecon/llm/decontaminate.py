"""Benchmark decontamination by spaced-seed hashing.

A mask reads some of 9 to 12 consecutive words and ignores the rest, so a substituted word in an ignored place does not change
the hash. Every window of every benchmark item and of every document is hashed under each of the fixed masks. A filter
of fixed size, made from the benchmark's hashes, drops nearly all windows of the documents inside the task that read
them; the rest are joined with the benchmark's hashes. A hit gives a diagonal (place in the document minus place in the
item), on which the words around it (64 on either side of the hits) are compared: the run with the most equal words of those at
``min_identity`` must reach ``min_words`` equal words (all of a shorter item).

The masks hit every run of 13 or more equal words at identity 0.8 or more. A run of 32 words or more has a half that is
such a run too, and the ends of a shorter one can be cut until it has 13, 14, 15, 16, 20, 25 or 30 words with 0 to 6
substitutions; all of these were enumerated (the test does it again). Weaker parameters are not taken.

The same plan runs at every size of either table. Only one row per (document, item, diagonal) goes on to verification, so
a passage costs the same however many of its windows hit; a passage shared by many documents makes a hot hash, which the
adaptive join splits.

Defined results: null and empty texts on either side overlap nothing; items of fewer than 12 words are too short to show
contamination and match nothing; repeated items are reported each; rows with a null key are not reported, and
``decontaminate`` judges texts, so it works without keys; an empty table gives no rows. Extra columns are not read, or
pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from payrecon.llm.common import U64, Bloom, Words, chars_at, mix64, staged, sub_batches, utf8, words

#: 1 reads a word, 0 ignores it. Found by search; together they hit every run that the rule admits.
MASKS = ("11101011011", "110110001111", "111110111", "111001010111", "101001101111", "111110100011",
         "111101111", "111111001001", "1010111111", "11001101111", "111110110001", "110000111111")
SPAN = max(map(len, MASKS))
CONTEXT = 64
MIN_WORDS, MIN_IDENTITY = 13, 0.8
_BASE = 0xA24BAED4963EE407
_FILTER_BITS = 25
#: Text of which the windows are in memory at once: some 40 bytes for each byte of text.
BATCH_BYTES = 1 << 20


def seeds(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) by mask, of all its windows that lie in one text; one mask's at a time."""
    n = len(w.hashes)
    end = np.repeat(w.offsets[1:], np.diff(w.offsets))
    power, scaled = 1, []
    for _ in range(SPAN):
        scaled.append(w.hashes * U64(power))
        power = power * _BASE % (1 << 64)
    for m, mask in enumerate(MASKS):
        starts = max(0, n - len(mask) + 1)
        total = np.full(starts, m, dtype=U64)
        for j, read in enumerate(mask):
            if read == "1":
                total += scaled[j][j:j + starts]
        at = np.flatnonzero(np.arange(starts) + len(mask) <= end[:starts])
        yield mix64(total[at]), at


def _item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, limit=BATCH_BYTES):
        w = words(*utf8(batch.column("text")))
        for hashes, at in seeds(w):
            text_of = w.text_of[at]
            long = np.diff(w.offsets)[text_of] >= SPAN
            hashes, at, text_of = hashes[long], at[long], text_of[long]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column("item").take(pa.array(text_of)),
                 pa.array((at - w.offsets[text_of]).astype(np.int32))], ["h", "item", "place"])


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        w = words(*utf8(batch.column("text")))
        raw = [w.hashes[a:b].tobytes() for a, b in zip(w.offsets[:-1], w.offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(raw, pa.binary())], ["item", "item_words"])


def _regions(batches: Iterable[pa.RecordBatch], wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Stretches of a document around windows that may hit: their words, and the hashes with their places in it."""
    for batch in sub_batches(batches, limit=BATCH_BYTES):
        data, offsets = utf8(batch.column("text"))
        w = words(data, offsets)
        hits = [(h[k], at[k]) for h, at in seeds(w) for k in [np.flatnonzero(wanted.has(h))]]
        hashes, places = np.concatenate([h for h, _ in hits]), np.concatenate([p for _, p in hits])
        if not len(hashes):
            continue
        order = np.argsort(places, kind="stable")
        hashes, places, text = hashes[order], places[order], w.text_of[places[order]]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (np.diff(places) > CONTEXT)])
        rows = []
        for a, b in zip(new, [*new[1:], len(places)]):
            t = int(text[a])
            first, last = max(int(places[a]) - CONTEXT, w.offsets[t]), min(int(places[b - 1]) + SPAN + CONTEXT, w.offsets[t + 1])
            chars = chars_at(data, int(offsets[t]), np.stack([w.starts[first:last], w.ends[first:last]]))
            rows.append((t, int(first - w.offsets[t]), w.hashes[first:last].tobytes(), chars.astype("<i4").tobytes(),
                         hashes[a:b].view(np.int64), (places[a:b] - first).astype(np.int32)))
        t, first, own, chars, h, p = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(t)), pa.array(first, pa.int64()), pa.array(own, pa.binary()), pa.array(chars, pa.binary()),
             pa.array(h, pa.list_(pa.int64())), pa.array(p, pa.list_(pa.int32()))], ["key", "first", "own", "chars", "hs", "places"])


def _verify(batches: Iterable[pa.RecordBatch], min_words: int, min_identity: float) -> Iterator[pa.RecordBatch]:
    """The run of each diagonal with the most equal words among those whose share of equal words is ``min_identity``."""
    share = Fraction(str(min_identity))
    gain, loss = share.denominator - share.numerator, share.numerator  # a run's sum is not negative if it reaches the share
    for batch in batches:
        out = []
        for i, (own, item, diagonal, chars) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("own", "item_words", "diagonal", "chars")))):
            own, item = np.frombuffer(own, U64), np.frombuffer(item, U64)
            low, high = max(0, diagonal), min(len(own), len(item) + diagonal)
            same = own[low:high] == item[low - diagonal:high - diagonal]
            total = np.concatenate([[0], np.cumsum(np.where(same, gain, -loss))])
            seen = np.concatenate([[0], np.cumsum(same)])
            # For each end the first start from which the sum is not negative; no later one has more equal words.
            begin = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
            end = int(np.argmax(seen - seen[begin]))
            start = int(begin[end])
            equal = int(seen[end] - seen[start])
            start += int(np.argmax(same[start:end])) if equal else 0  # begins with an equal word, and so it ends
            n = end - start
            if n and equal >= min(min_words, len(item)):
                marks = np.frombuffer(chars, "<i4").reshape(2, -1)
                out.append((i, int(marks[0, low + start]), int(marks[1, low + end - 1]), equal, n, low + start - diagonal))
        if out:
            i, s, e, equal, n, place = zip(*out)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("item").take(rows), *(pa.array(x, pa.int64()) for x in (s, e, place, equal, n))],
                ["key", "item", "start", "end", "item_word", "equal_words", "n_words"])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY,
) -> DataFrame:
    """The longest verified overlap of each document and item: key, item, start, end (code points), item_word (where it
    begins in the item), equal_words and n_words."""
    if min_words < MIN_WORDS or min_identity < MIN_IDENTITY:
        raise ValueError(f"min_words must be {MIN_WORDS} or more and min_identity {MIN_IDENTITY} or more")
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), "text")
    own_seeds = staged(items.mapInArrow(_item_seeds, f"h long, item {item_kind}, place int").distinct(), "item-seeds")
    wanted = Bloom.of(own_seeds, "h", _FILTER_BITS)
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "text").mapInArrow(
        lambda it: _regions(it, wanted), f"key {kind}, first long, own binary, chars binary, hs array<long>, places array<int>")
    found = staged(found, "regions")
    each = found.select("key", "first", F.explode(F.arrays_zip("hs", "places")).alias("x")).select(
        "key", "first", F.col("x.hs").alias("h"), F.col("x.places").alias("p"))
    lines = each.join(own_seeds, "h").select("key", "first", "item", (F.col("p") - F.col("place")).alias("diagonal")).distinct()
    whole = items.mapInArrow(_item_words, f"item {item_kind}, item_words binary").distinct()
    ready = lines.join(found.select("key", "first", "own", "chars").dropDuplicates(["key", "first"]), ["key", "first"]).join(whole, "item")
    checked = ready.mapInArrow(
        lambda it: _verify(it, min_words, min_identity),
        f"key {kind}, item {item_kind}, start long, end long, item_word long, equal_words long, n_words long")
    best = F.max_by(F.struct("start", "end", "item_word", "equal_words", "n_words"), F.struct("equal_words", -F.col("start")))
    return checked.groupBy("key", "item").agg(best.alias("b")).select(F.col("key").alias(key), F.col("item").alias(item), "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents whose text overlaps a benchmark item. Columns as they came."""
    key = "_digest_of_text"
    while key in docs.columns:
        key += "_"
    marked = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    bad = overlaps(marked.select(key, "text"), benchmark, key, **parameters).select(key).distinct()
    return marked.join(staged(bad, "contaminated"), key, "left_anti").select(*docs.columns)
