"""Mixture-controlled packing: every window of training sequences takes its target share of tokens from every source.

Each source is a queue of its documents' tokens. In every round of deficit round-robin a source earns its share of the
window, takes the whole tokens of what it has earned, and carries the fraction. Because documents may be cut freely, the
state after w windows has a closed form: a source has taken ``floor(w * window * share)`` tokens, and the largest source
takes what the carried fractions leave open, so a window is always full and every source is within one token of its
target (the largest within the number of sources). So nothing is scheduled one window after the other: a token's window follows from its position
in its source's queue alone, and carrying deficits over windows and partitions is arithmetic.

The queue position of a document is the sum of its source's tokens before it. Tasks count within themselves while they
tokenise; only one number per task and source is then summed up. Token ids are written once, as 16-bit values.

Shares are by default the sources' shares of all tokens, so all queues end with the last window and no sequence but the
last is padded. With ``targets`` given, windows follow them until the first queue runs dry, and the rest of the corpus
is spread in proportion to what is left.

Defined results: null and empty texts are documents of the end token alone; a null source is a source of its own; repeated
rows are packed each; documents of any length are cut; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from payrecon.llm.common import staged, sub_batches

END_TOKEN = 1
SEQUENCE = 2048
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
_STAGED = pa.schema([("part", pa.int32()), ("source", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


@lru_cache(maxsize=1)
def encoder(folder: str | None = None):
    """The byte-level BPE of ``byte_bpe_50k.json``: the same vocabulary as ranks, whose encoder is several times faster
    and gives the same ids (tested), its one special token included, which is recognised where a text spells it. ``folder``
    holds the vocabulary files; by default the installed public ones."""
    import public_tokenizers
    import tiktoken

    path = f"{folder}/{VOCABULARY}.tiktoken" if folder else public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _tokenise(batches: Iterable[pa.RecordBatch], folder: str | None) -> Iterator[pa.RecordBatch]:
    """Token ids of each document and its place among its source's tokens of this task."""
    bpe, part = encoder(folder), TaskContext.get().partitionId()
    used: dict[str | None, int] = {}
    for batch in sub_batches(batches):
        rows = []
        for doc_id, text, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source"))):
            ids = np.array([*bpe.encode(text or "", allowed_special="all"), END_TOKEN], dtype="<u2")
            start = used.get(source, 0)
            used[source] = start + len(ids)
            rows.append((part, source, doc_id, start, len(ids), ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STAGED.types)], schema=_STAGED)


@dataclass
class Phase:
    """Windows from ``first`` on in which source i takes weights[i]/whole of the tokens; ``end`` tokens in all."""

    first: int
    weights: list[int]
    before: list[int]
    count: int
    end: int


class Mixture:
    """Which tokens of each source's queue go to which window, in closed form.

    The last window also holds the rest that would not fill another, so it may end in a shorter sequence.
    """

    def __init__(self, totals: list[int], length: int = SEQUENCE, targets: list[float] | None = None):
        self.totals, self.total = totals, sum(totals)
        self.window, self.phases = length, self._plan(length, targets)
        while not all(self._roomy(p) for p in self.phases):  # many small sources: windows of several sequences
            self.window *= 2
            self.phases = self._plan(self.window, targets)
        self.firsts = [p.first for p in self.phases]
        self.at = lru_cache(maxsize=4096)(self._at)

    def _roomy(self, p: Phase) -> bool:
        """The largest source can take up the others' fractions in every window."""
        return p.count <= 1 or self.window * max(p.weights) >= len(p.weights) * sum(p.weights)

    def _plan(self, window: int, targets: list[float] | None) -> list[Phase]:
        phases, taken, first = [], [0] * len(self.totals), 0
        weights = [round(t * (1 << 30)) if n else 0 for t, n in zip(targets or [], self.totals)]
        if sum(weights):
            whole = sum(weights)
            count = min(max(0, n - len(weights)) * whole // (w * window) for n, w in zip(self.totals, weights) if w)
            if count:
                phases.append(Phase(0, weights, taken, count, count * window))
                taken, first = self._taken(phases[0], count, window), count
        left = [n - t for n, t in zip(self.totals, taken)]
        if sum(left):
            phases.append(Phase(first, left, taken, max(1, sum(left) // window), sum(left)))
        return phases

    @staticmethod
    def _taken(p: Phase, w: int, window: int) -> list[int]:
        x = (w - p.first) * window if w - p.first < p.count else p.end
        whole, leader = sum(p.weights), max(range(len(p.weights)), key=p.weights.__getitem__)
        out = [b + x * s // whole for b, s in zip(p.before, p.weights)]
        out[leader] += sum(p.before) + x - sum(out)
        return out

    def _at(self, w: int) -> list[int]:
        """Tokens taken from each source before window w."""
        return self._taken(self.phases[max(0, bisect_right(self.firsts, w) - 1)], w, self.window)

    def windows(self, source: int, start: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
        """(begin, end, window, place in the window) of the parts of a source's tokens [start, stop)."""
        low, high = 0, self.phases[-1].first + self.phases[-1].count
        while high - low > 1:  # the last window that begins at or before start
            mid = (low + high) // 2
            low, high = (mid, high) if self.at(mid)[source] <= start else (low, mid)
        w = low
        while start < stop:
            now, after = self.at(w), self.at(w + 1)
            end = min(stop, after[source])
            if end > start:
                place = sum(after[i] - now[i] for i in range(source)) + start - now[source]
                yield start, end, w, place
                start = end
            w += 1


def _pieces(batches: Iterable[pa.RecordBatch], mixture: Mixture, index: dict, length: int) -> Iterator[pa.RecordBatch]:
    per_window = mixture.window // length
    for batch in batches:
        rows = []
        for source, doc_id, begin, n, ids in zip(*(batch.column(c).to_pylist() for c in ("source", "doc_id", "at", "n", "ids"))):
            wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
            for start, end, w, place in mixture.windows(index[source], begin, begin + n):
                while start < end:  # a window of several sequences is cut at their ends
                    sequence, offset = divmod(place, length)
                    size = min(end - start, length - offset)
                    crc = zlib.crc32(wide[start - begin:start - begin + size].tobytes())
                    rows.append((doc_id, start - begin, size, crc, n, w * per_window + sequence, offset, source))
                    start, place = start + size, place + size
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)


def pack(docs: DataFrame, length: int = SEQUENCE, targets: dict | None = None, tokenizers: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` maps sources to weights (absent sources: weight 0, they are packed last). The totals of the sources, one
    number each, are the only data that reach the driver; sources are a property of the collection, not of its size.
    """
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    ids = staged(rows.mapInArrow(
        lambda it: _tokenise(it, tokenizers), "part int, source string, doc_id long, start long, n long, ids binary"), "token-ids")
    parts = ids.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-parts")
    totals = {r["source"]: r["tokens"] for r in parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    order = sorted(totals, key=lambda s: (s is not None, s or ""))
    mixture_of = [totals[s] for s in order], length, [targets.get(s, 0.0) for s in order] if targets else None
    index = {s: i for i, s in enumerate(order)}
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "before")
    placed = ids.join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "doc_id", (F.col("before") + F.col("start")).alias("at"), "n", "ids")

    def cut(batches):
        return _pieces(batches, Mixture(*mixture_of), index, length)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
