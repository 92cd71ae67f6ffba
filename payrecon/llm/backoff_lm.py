"""Stupid-backoff language-model scores of every document against the rest of the corpus.

    S(w | u v) = c(u v w) / c(u v)      if the trigram occurs elsewhere
               = 0.4 S(w | v)           if not, and likewise from bigrams to c(w) / N

Counts leave out the document that is scored, so a text does not vouch for itself; a word that occurs nowhere else
counts as half an occurrence. The first words of a text start at the order that their history allows, without a penalty.

The work is a join of the documents' n-grams with count tables partitioned by hash, summed per document, in three steps.
(1) Documents are dealt into chunks; a chunk lists its distinct n-grams of all orders with their counts, sorted by hash
and cut into ranges of the hash. (2) Each range is one partition of the count table: it adds up the counts of all
chunks, and answers every chunk with the totals of the n-grams it listed, in the same order. (3) Each chunk joins the
answers to the n-grams of its documents and sums. Lists travel as arrays, because a row per n-gram would
take several times the bytes of the text. A hot n-gram is one entry of each chunk's list, however often it occurs.

N-grams are identified by hashes of 18 bits more than it takes to number the corpus's n-grams (46 bits at least), so one
in 262,144 at most is taken for another, at every size.

Defined results: null, empty and wordless texts have no words and no score (null); repeated rows are scored each, and
the other copies count as corpus; null ids are kept; a corpus of one document has only unseen words; an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from payrecon.llm.common import U64, Words, mix64, utf8, words

ORDER, ALPHA, UNSEEN = 3, 0.4, 0.5
CHUNK_BYTES = 4 << 20
#: Bits of a hash beyond those that number the corpus's n-grams, and the fewest bits.
SPARE_BITS, LEAST_BITS = 18, 46
_BASE = 0xC2B2AE3D27D4EB4F
_REQUEST = "bucket int, chunk int, n int, hashes binary, counts binary"
_REPLY = "chunk int, bucket int, n int, counts binary"


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences in as few whole bytes as the largest one needs."""
    steps = np.diff(hashes, prepend=U64(0))
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + int(hashes[0] if len(hashes) else 0).to_bytes(8, "little") + _pack(steps[1:], width)


def unpack_sorted(raw: bytes) -> np.ndarray:
    width, body = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    steps = np.zeros((len(body) // width + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(raw[1:9], np.uint8)
    steps[1:, :width] = body.reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


def squeeze(counts: np.ndarray) -> bytes:
    """Counts, nearly all of them small: bytes where they fit, and a list of the large ones."""
    large = np.flatnonzero(counts >= 255)
    small = np.minimum(counts, 255).astype(np.uint8)
    body = np.concatenate([np.array([len(large)], "<i8").view(np.uint8), small, large.astype("<i8").view(np.uint8), counts[large].astype("<i8").view(np.uint8)])
    return zstandard.ZstdCompressor(level=1).compress(body.tobytes())


def expand(raw: bytes) -> np.ndarray:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = int(body[:8].view("<i8")[0])
    small = body[8:len(body) - 16 * n]
    out = small.astype(np.int64)
    if n:
        tail = np.frombuffer(body[len(body) - 16 * n:].tobytes(), "<i8")
        out[tail[:n]] = tail[n:]
    return out


def grams_of(w: Words, bits: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashes of the n-grams and the position of their last word."""
    n, text = len(w.hashes), w.text_of
    out = []
    for order in range(1, ORDER + 1):
        last = np.arange(order - 1, n)
        last = last[text[last] == text[last - order + 1]]
        h, power = np.full(len(last), order, dtype=U64), 1
        for back in range(order):
            h += w.hashes[last - back] * U64(power)
            power = power * _BASE % (1 << 64)
        out.append((mix64(h) >> U64(64 - bits), last))
    return out


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each distinct value occurs, the rank of every value among the distinct ones), by one sort."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]][:len(values)]
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.cumsum(first) - 1
    return np.diff(np.r_[np.flatnonzero(first), len(values)]), rank


def _list(table: pa.Table, buckets: int, bits: int) -> pa.Table:
    w = words(*utf8(table.column("text")))
    hashes, counts = np.unique(np.concatenate([h for h, _ in grams_of(w, bits)]), return_counts=True)
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], dtype=U64)
    cuts = np.r_[0, np.searchsorted(hashes, edges), len(hashes)]
    rows = [(b, s, e) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
    return pa.table({
        "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
        "chunk": pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int32()),
        "n": pa.array([e - s for _, s, e in rows], pa.int32()),
        "hashes": pa.array([pack_sorted(hashes[s:e]) for _, s, e in rows], pa.binary()),
        "counts": pa.array([squeeze(counts[s:e]) for _, s, e in rows], pa.binary())})


def _total(table: pa.Table) -> pa.Table:
    """One range of the count table, and its answers."""
    lists = [unpack_sorted(r) for r in table.column("hashes").to_pylist()]
    hashes = np.concatenate(lists)
    counts = np.concatenate([expand(r) for r in table.column("counts").to_pylist()])
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    totals = np.add.reduceat(counts[order], first)
    answer = np.empty(len(hashes), dtype=np.int64)
    answer[order] = np.repeat(totals, np.diff(np.r_[first, len(hashes)]))
    cuts = np.cumsum([0, *[len(x) for x in lists]])
    return pa.table({
        "chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": table.column("n"),
        "counts": pa.array([squeeze(answer[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _score(docs: pa.Table, replies: pa.Table, total_words: int, bits: int) -> pa.Table:
    w = words(*utf8(docs.column("text")))
    n, text = len(w.hashes), w.text_of
    seen = [np.zeros(n) for _ in range(ORDER + 1)]  # occurrences elsewhere of the n-gram that ends at each position
    if n:
        grams = grams_of(w, bits)
        answers = replies.column("counts").to_pylist()
        totals = np.concatenate([expand(answers[i]) for i in np.argsort(replies.column("bucket").to_numpy())])
        _, place_of = ranked(np.concatenate([h for h, _ in grams]))  # the place of each n-gram in the chunk's list
        at = 0
        for k, (h, last) in enumerate(grams, 1):
            own, back = ranked(mix64(h ^ (text[last].astype(U64) * U64(_BASE))))
            seen[k][last] = totals[place_of[at:at + len(h)]] - own[back]
            at += len(h)
    lengths = np.diff(w.offsets)
    elsewhere = np.maximum(total_words - lengths, 1).astype(float)[text]
    place = np.arange(n) - w.offsets[:-1][text]
    value = np.log(np.where(seen[1] > 0, seen[1], UNSEEN) / elsewhere)
    level = np.where(seen[1] > 0, 1, 0)
    for k in range(2, ORDER + 1):
        history = np.r_[0.0, seen[k - 1][:-1]] if n else seen[k]
        hit = (seen[k] > 0) & (place >= k - 1)
        value = np.where(hit, np.log(np.where(hit, seen[k], 1) / np.where(hit, history, 1)), value + np.where(place >= k - 1, np.log(ALPHA), 0.0))
        level = np.where(hit, k, level)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=x, minlength=len(lengths)) if n else np.zeros(len(lengths))

    total = per_text(value)
    none = lengths == 0
    return pa.table({
        "doc_id": docs.column("doc_id"), "n_words": pa.array(lengths.astype(np.int64)),
        **{f"n_order{k}": pa.array(per_text(level == k).astype(np.int64)) for k in range(ORDER + 1)},
        "log_score": pa.array(total, mask=none), "log_per_word": pa.array(total / np.maximum(lengths, 1), mask=none)})


def scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_order3 ... n_order0 (words scored by each order; 0: seen nowhere else), log_score (natural
    logarithm, summed) and log_per_word."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # Some ranges for each shuffle partition, so that a task holds a part of its share at a time.
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    total_words = rows.mapInArrow(_word_counts, "n long").agg(F.sum("n")).first()[0] or 0
    bits = min(64, max(LEAST_BITS, SPARE_BITS + (ORDER * total_words).bit_length()))
    lists = dealt.groupBy("chunk").applyInArrow(lambda t: _list(t, buckets, bits), _REQUEST)
    replies = lists.groupBy("bucket").applyInArrow(_total, _REPLY)
    schema = (f"doc_id {kind}, n_words long, " + ", ".join(f"n_order{k} long" for k in range(ORDER + 1))
              + ", log_score double, log_per_word double")
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        lambda d, r: _score(d, r, total_words, bits), schema)


def _word_counts(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(words(*utf8(batch.column("text"))).hashes)], pa.int64())], ["n"])
