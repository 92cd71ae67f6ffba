"""Shared helpers of the operators: words of Arrow text as arrays, staged tables, whole groups, filters, components.

Texts are never turned into Python strings where only their words matter. A batch of texts is one byte buffer with
offsets; words, their hashes and their n-grams are found with array operations over that buffer. A *word* is a maximal
run of ASCII letters, digits, underscores and non-ASCII characters, compared without case (ASCII and Latin-1 letters).
Null texts count as empty.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from payrecon.session import work_dir

U64 = np.uint64
SLICE = 1 << 18
SUB_BATCH_BYTES = 4 << 20


# -- hashing -------------------------------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for long arrays several times faster than ``np.unique`` without counts."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


_BYTE_HASH = mix64(np.arange(1, 257, dtype=U64))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = _WORD[95] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


# -- texts ---------------------------------------------------------------------------------------------------

def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after the other, and the offsets of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    values = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return values, offsets - first


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals in lower case; no length changes."""
    out = _LOWER[data]
    if len(out) > 1:
        tail = out[1:]
        tail[(out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


def sub_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words of a batch: hashes, byte ranges in the batch's buffer, and the first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of a batch. Works in slices cut between words, so memory is bounded however long a text is."""
    heads = np.unique(offsets)
    hashes, starts, ends = [], [], []
    at, size = 0, len(data)
    while at < size:
        end = min(size, at + SLICE)
        if end < size:  # move the cut to a byte that is in no word; a longer word makes a longer slice
            while end < size:
                gap = np.flatnonzero(~_WORD[data[end:end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(size, end + 4096)
        low = lowered(data[at:end])
        inside = _WORD[low]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = heads[np.searchsorted(heads, at, side="right"):np.searchsorted(heads, end, side="left")] - at
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(low))
        total = np.zeros(len(low) + 1, dtype=U64)
        np.cumsum(_BYTE_HASH[low] * up, out=total[1:])
        hashes.append(mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64))
    starts = np.concatenate(starts)
    return Words(np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offsets))


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their offsets; a text of 1 to k-1 words has one, of all its words."""
    n = len(w.hashes)
    lengths = np.diff(w.offsets)
    end = np.repeat(w.offsets[1:], lengths)
    at = np.arange(n)
    keep = at + k <= end
    short = (lengths > 0) & (lengths < k)
    keep[w.offsets[:-1][short]] = True
    at, end = at[keep], end[keep]
    gram, power = np.zeros(len(at), dtype=U64), 1
    padded = np.concatenate([w.hashes, np.zeros(k, dtype=U64)])
    for j in range(k):
        part = padded[at + j] * U64(power)
        if short.any():
            part[at + j >= end] = 0
        gram += part
        power = power * _GRAM_BASE % (1 << 64)
    counts = np.where(short, 1, np.maximum(lengths - k + 1, 0))
    return mix64(gram), np.concatenate([[0], np.cumsum(counts)])


def chars_at(data: np.ndarray, begin: int, positions: np.ndarray) -> np.ndarray:
    """Code points between byte ``begin`` and each byte position (ascending order is not needed)."""
    positions = np.asarray(positions, dtype=np.int64)
    if not len(positions):
        return positions
    seen = np.concatenate([[0], np.cumsum((data[begin:int(positions.max())] & 0xC0) != 0x80)])
    return seen[positions - begin]


# -- Spark ---------------------------------------------------------------------------------------------------

#: Rows of text that travel to a Python worker at once; the default of 10,000 documents would take tens of megabytes
#: on both sides.
BATCH_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """Set the runtime settings that the operators' memory needs rely on (SQL settings, no restart needed)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark


_STAGED: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):  # the session may have ended already; the folder is then the cluster's to expire
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the cluster's shared folder and read again: it cuts the lineage and fixes what
    would otherwise be computed twice. The folder is removed when the driver's Python ends."""
    spark = df.sparkSession
    if not _STAGED:
        atexit.register(_forget)
    path = work_dir(spark, name)
    _STAGED.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never cut a group, from a partition sorted by ``key``. Callers bound the size of a group."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or keys[0] != held[-1].column(key)[0].as_py()):
            if cut:
                yield pa.concat_tables([*held, table.slice(0, cut)])
                held = [table.slice(cut)]
            else:
                yield pa.concat_tables(held)
                held = [table]
        else:
            if cut:
                yield table.slice(0, cut)
            held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held)


class Bloom:
    """A filter of fixed size over 64-bit hashes: no false negatives, and its bytes do not depend on the data."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = U64(len(bits) * 64 - 1)

    @classmethod
    def of(cls, df: DataFrame, column: str, log2_bits: int) -> Bloom:
        """Of the values of a long column. The driver gets one row per non-empty 64-bit word, so 2**(log2_bits-6) at most."""
        mask = (1 << log2_bits) - 1
        h = F.col(column)
        probes = F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask)))).alias("p")
        rows = df.select(probes).select(
            F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b"),
        ).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
        bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
        return cls(bits.view(U64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for p in (hashes & self.mask, (hashes >> U64(32)) & self.mask):
            out &= ((self.bits[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1)).astype(bool)
        return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each round is two aggregates and two joins over the edges, written to
    the shared folder. The aggregates group by a hash of the node besides, so that the joins shuffle both of their sides; only
    such joins are split at a hot node. Only two numbers a round reach the driver.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("v").alias("node"), F.col("m").alias("root")).union(
                e.select("m", "m").distinct())
        state = now
        both = e.select(F.col("v").alias("u"), F.col("m").alias("n")).union(e.select("m", "v"))
        least = both.groupBy(F.xxhash64("u").alias("spread"), "u").agg(F.least("u", F.min("n")).alias("m")).drop("spread")
        large = both.where("n > u").join(least, "u").where("n <> m").select(F.col("n").alias("v"), "m").distinct()
        root = large.groupBy(F.xxhash64("v").alias("spread"), "v").agg(F.min("m").alias("r")).drop("spread")
        small = large.join(root, "v").select(
            F.explode(F.array(F.struct(F.col("v"), F.col("r").alias("m")), F.struct(F.col("m").alias("v"), F.col("r").alias("m")))).alias("x"),
        ).select("x.*").where("v <> m").distinct()
        e = staged(small, "edges")
