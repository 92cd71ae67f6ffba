"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles (five words; a shorter text is one shingle). Documents with the same set form a copy
class, and one member stands for it from here on. Signatures of MinHash values are cut into bands; classes that agree in
a band meet there. Their signatures are then compared a few values at a time: with a uniform prior, m agreements in n
values give the similarity a Beta(m+1, n-m+1) posterior, and a pair is dropped as soon as the probability of reaching
the threshold falls below ``tolerance``. Pairs that survive all values are verified on their shingle sets, exactly.

A pair that meets in several bands is compared in the first only. Large groups are never emitted as pairs: the members of
a band's bucket are dealt into blocks of about 2,048, every two blocks meet in one task, and what leaves the task is one row per
document and meeting with its partners. A group up to that size costs one row per member and band, a group of m members
``m / 2048`` rows each; its comparisons are those of all pairs, some at a time, so a task's memory is bounded by two blocks.

Defined results: texts without a word are linked to nothing and are a class of their own; a class has the id of its
smallest document; ids must be unique and rows with a null id take no part in ``links``. ``keep_one`` goes by rows, whatever
their ids are: of every group exactly one row stays, repeated rows and rows with null ids included. An empty table gives no
rows. Extra columns are not read, or pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from payrecon.llm.common import U64, Bloom, components, distinct, mix64, ngrams, staged, sub_batches, utf8, whole_groups, words

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: 24 bands of 4 values miss a pair of similarity 0.8 once in 300,000.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16
#: Members of a bucket that meet at once. A group of near copies up to this size travels once per band; a larger one as
#: blocks against blocks.
BLOCK = 2048
_FACTORS = mix64(np.arange(1, VALUES + 1, dtype=U64)) | U64(1)
_FILTER_BITS = 23


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (texts x VALUES, 32 bits); texts without shingles get the largest value everywhere."""
    out = np.full((len(offsets) - 1, VALUES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.diff(offsets) > 0
    if full.any():
        at = offsets[:-1][full]
        for j in range(VALUES):
            out[full, j] = np.minimum.reduceat(((grams * _FACTORS[j]) >> U64(32)).astype(np.uint32), at)
    return out


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        grams, offsets = ngrams(words(*utf8(batch.column("text"))), SHINGLE)
        sig = signatures(grams, offsets)
        n = np.zeros(len(sig), dtype=np.int32)
        sets = np.zeros((len(sig), 2), dtype=np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            own = distinct(grams[a:b])
            n[i] = len(own)
            sets[i] = own.sum().view(np.int64), (np.bitwise_xor.reduce(mix64(own)) if len(own) else U64(0)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n), pa.array(sets[:, 0]), pa.array(sets[:, 1]),
             pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "n", "set_a", "set_b", "sig"])


def _band_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(U64)
        keys = np.zeros(sig.shape[:2], dtype=U64)
        for r in range(ROWS):
            keys = mix64(keys + sig[:, :, r])
        keys = mix64(keys ^ np.arange(BANDS, dtype=U64)[None, :])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64)),
            pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))], ["id", "bucket", "band"])


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest agreements of n at which P(similarity >= threshold) is still ``tolerance``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log_density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log_density - log_density.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return out


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside consecutive groups."""
    left = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = np.repeat(starts + sizes, sizes) - left - 1
    i = np.repeat(left, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _some_pairs(start: int, n: int, some: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j of a large group, a bounded number at a time."""
    at = 0
    while at < n - 1:
        left = n - 1 - at
        k = min(left, max(1, some // left))
        i = np.repeat(np.arange(at, at + k), n - 1 - np.arange(at, at + k))
        first = np.r_[0, np.cumsum(n - 1 - np.arange(at, at + k))[:-1]]
        j = np.arange(len(i)) - np.repeat(first, n - 1 - np.arange(at, at + k)) + i + 1
        yield start + i, start + j
        at += k


def _candidates(batches: Iterable[pa.RecordBatch], least: list[int], some: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Each document's partners that survive the pruning, per meeting of two blocks."""
    for table in whole_groups(batches, "meeting"):
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
        meeting, ids, block = (table.column(c).to_numpy() for c in ("meeting", "id", "block"))
        band, lone = table.column("band").to_numpy(), table.column("lone").to_numpy()
        starts = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]])
        sizes = np.diff(np.r_[starts, len(meeting)])
        costs, at = np.cumsum(sizes * sizes), 0
        while at < len(starts):  # many small groups together, or one large group in parts
            stop = max(at + 1, int(np.searchsorted(costs, (costs[at - 1] if at else 0) + some, side="right")))
            a, end = int(starts[at]), int(starts[stop - 1] + sizes[stop - 1])
            chunks = [_pairs(starts[at:stop], sizes[at:stop])] if stop > at + 1 else _some_pairs(a, end - a, some)
            at, left, right = stop, [], []
            for i, j in chunks:
                keep = lone[i] | (block[i] != block[j])  # two different blocks: their inner pairs meet elsewhere
                i, j = i[keep], j[keep]
                # Pairs that agree in an earlier band have met there.
                for b in range(BANDS - 1):
                    if not len(i):
                        break
                    met = (band[i] > b) & (sig[i, b * ROWS:b * ROWS + ROWS] == sig[j, b * ROWS:b * ROWS + ROWS]).all(1)
                    i, j = i[~met], j[~met]
                same = np.zeros(len(i), dtype=np.int64)
                for s, m in enumerate(least):
                    same += (sig[i, s * STEP:(s + 1) * STEP] == sig[j, s * STEP:(s + 1) * STEP]).sum(1)
                    alive = same >= m
                    i, j, same = i[alive], j[alive], same[alive]
                left.append(i)
                right.append(j)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            if not len(i):
                continue
            touched = distinct(np.r_[i, j])
            partners = ids[j[np.argsort(i, kind="stable")]]
            cuts = np.searchsorted(np.sort(i), np.r_[touched, end])
            yield pa.RecordBatch.from_arrays(
                [pa.array(meeting[touched]), pa.array(ids[touched]),
                 pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(partners))], ["meeting", "id", "partners"])


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j (i ascending), some rows and some shingles at a time."""
    sizes = [len(x) for x in sets]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(place, minlength=len(values)) > 1
    keep = common[place]
    column, row = (np.cumsum(common) - 1)[place[keep]], np.repeat(np.arange(len(sets)), sizes)[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    wide = max(256, (1 << 21) // max(1, len(sets)))
    out = np.zeros(len(i), dtype=np.int64)
    for top in range(0, len(sets), 512):
        a, b = np.searchsorted(i, [top, top + 512])
        if a == b:
            continue
        counts = np.zeros((min(512, len(sets) - top), len(sets)), dtype=np.float32)  # whole numbers far below 2**24
        for at in range(0, int(common.sum()), wide):
            c, d = np.searchsorted(column, [at, at + wide])
            part = np.zeros((len(sets), wide), dtype=np.float32)
            part[row[c:d], column[c:d] - at] = 1
            counts += part[top:top + 512] @ part.T
        out[a:b] = counts[i[a:b] - top, j[a:b]].astype(np.int64)
    return out


def _verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact similarity of the surviving pairs of each meeting; one row per linked document."""
    for table in whole_groups(batches, "meeting"):
        meeting = table.column("meeting").to_numpy()
        starts = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(meeting)]):
            group = table.slice(a, b - a)
            ids, copies = (group.column(c).to_numpy() for c in ("id", "copies"))
            partners = group.column("partners").combine_chunks()
            grams, cuts = ngrams(words(*utf8(group.column("text"))), SHINGLE)
            sets = [distinct(grams[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
            order = np.argsort(ids)
            i = np.repeat(np.arange(len(ids)), partners.value_lengths().to_numpy())
            j = order[np.searchsorted(ids[order], partners.flatten().to_numpy())]
            shared, sizes = shared_counts(sets, i, j), np.array([len(x) for x in sets])
            linked = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
            i, j = i[linked], j[linked]
            links = np.bincount(np.r_[i, j], minlength=len(ids))
            weight = np.bincount(np.r_[i, j], weights=copies[np.r_[j, i]], minlength=len(ids)).astype(np.int64)
            root = np.arange(len(ids))
            while True:  # every document takes the smallest root among its partners, then its root's root
                least = root.copy()
                np.minimum.at(least, i, root[j])
                np.minimum.at(least, j, root[i])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            own = np.flatnonzero(links)
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (ids[own], links[own], weight[own], ids[root[own]])],
                    ["id", "classes", "documents", "peer"])


def copy_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): every document's set and signature, and (set_a, set_b, n, rep, copies) of each distinct set."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = staged(rows.mapInArrow(_sign, "id long, n int, set_a long, set_b long, sig binary"), "signed")
    classes = signed.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return signed, staged(classes, "classes")


def class_links(docs: DataFrame, signed: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(id, classes, documents, peer) per meeting, for the representatives that are linked to another class."""
    reps = classes.select(F.col("rep").alias("id"), "copies")
    own = staged(signed.where("n > 0").select("id", "sig").join(reps, "id"), "reps")
    keys = staged(own.select("id", "sig").mapInArrow(_band_keys, "id long, bucket long, band int"), "band-keys")
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = keys.join(shared, "bucket").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), "id", "band", "block",
        (F.col("block") == F.col("other")).alias("lone"))
    n = met.sparkSession.conf.get("spark.sql.shuffle.partitions")
    least = least_matches(threshold, tolerance)
    found = met.join(own.select("id", "sig"), "id").repartition(int(n), "meeting").sortWithinPartitions("meeting").mapInArrow(
        lambda it: _candidates(it, least), "meeting long, id long, partners array<long>")
    found = staged(found, "candidates")
    wanted = Bloom.of(found.select(F.xxhash64("id").alias("h")).distinct(), "h", _FILTER_BITS)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("h", F.xxhash64("id"))
    texts = texts.mapInArrow(lambda it: _wanted(it, wanted), "id long, text string")
    ready = found.join(reps, "id").join(texts, "id")
    return ready.repartition(int(n), "meeting").sortWithinPartitions("meeting").mapInArrow(
        lambda it: _verify(it, threshold), "id long, classes long, documents long, peer long")


def _wanted(batches: Iterable[pa.RecordBatch], wanted: Bloom) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array(wanted.has(batch.column("h").to_numpy().view(U64)))
        yield batch.select(["id", "text"]).filter(keep)


def links(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest document reachable over links, copies included), copy_id (smallest
    document with the same shingles), n_links (other documents at ``threshold`` or above, copies included) and n_classes
    (other distinct shingle sets among them)."""
    signed, classes = copy_classes(docs)
    linked = staged(class_links(docs, signed, classes, threshold, tolerance), "links")
    groups = components(linked.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    counts = linked.groupBy("id").agg(F.sum("classes").alias("n_classes"), F.sum("documents").alias("documents"))
    of_class = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        groups.select(F.col("node").alias("rep"), "root"), "rep", "left")
    members = signed.select("id", "set_a", "set_b", "n").join(of_class, ["set_a", "set_b", "n"], "left")
    zero = F.lit(0).cast("long")
    return members.select(
        F.col("id").alias("doc_id"), F.coalesce("root", "rep", "id").alias("class_id"), F.coalesce("rep", "id").alias("copy_id"),
        (F.coalesce("documents", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"),
        F.coalesce("n_classes", zero).alias("n_classes"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id, null ids last, the first of
    repeated rows."""
    row, doc = "_row_of_copy", "_doc_of_copy"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "copies-rows")
    found = links(rows.select(F.col(row).alias("doc_id"), F.col("text")), **parameters).where("n_links > 0")
    found = staged(found.select(F.col("doc_id").alias(row), "class_id"), "copies")
    order = F.struct(F.col(doc).isNull(), doc, row)
    ids = rows.select(row, F.col("doc_id").alias(doc))
    kept = found.join(ids, row).groupBy("class_id").agg(F.min_by(row, order).alias(row))
    gone = staged(found.select(row).join(kept.select(row), row, "left_anti"), "near-copies")
    return rows.join(gone, row, "left_anti").select(*docs.columns)
