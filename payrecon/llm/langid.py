"""Language identification, words first: known words by their frequency in each language, other words by character n-grams.

The model is counted from labelled documents: the log frequency of words per language, and of character n-grams of
lengths 5 to 1 with word ends marked. A text's score for a language is the mean over its words. A word of the table gives
its log frequency; a word not in it gives the mean of those of its 5-grams that are known, failing that of its 4-grams, and so on;
a word of which not even a character is known says nothing. The score is the best language's share after a softmax.

The model's bound is a parameter: ``sample_docs`` labelled documents are read for it (chosen by a hash of the id, about
that many however large the table is). Every word they use twice and every n-gram of their words is kept; their number
bounds the model, so it may be broadcast. Predictions read every document whole.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text if there is nothing
to learn from; ties go to the language that comes first in the alphabet; repeated rows get equal rows; an empty table gives no rows. Extra
columns pass through; ``identify`` replaces columns named like its two, ``keep_identified`` leaves all as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from payrecon.llm.common import U64, Words, lowered, mix64, staged, sub_batches, utf8, words

LENGTHS = (5, 4, 3, 2, 1)
SAMPLE_DOCS = 20_000
UNKNOWN = "und"
_BYTE = mix64(np.arange(1000, 1257, dtype=U64))
_BASE = 0x9FB21C651E98DF25


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the character n-grams (over UTF-8 bytes, with word ends marked) of the given words."""
    sizes = ends - starts + 2
    total, first = int(sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(total) - first[of]
    edge = (inner == 0) | (inner == sizes[of] - 1)
    at = np.clip(starts[of] + inner - 1, 0, max(0, len(data) - 1))
    codes = _BYTE[np.where(edge, 256, data[at] if len(data) else 0)]
    gram, power = np.zeros(max(0, total - length + 1), dtype=U64), 1
    for j in range(length):
        gram += codes[j:total - length + 1 + j] * U64(power)
        power = power * _BASE % (1 << 64)
    keep = of[:len(gram)] == of[length - 1:] if length > 1 else np.ones(len(gram), bool)
    return mix64(gram[keep]), of[:len(gram)][keep]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, level, hash, n) of the words (level 0) and character n-grams of labelled texts."""
    for batch in sub_batches(batches):
        data, offsets = utf8(batch.column("text"))
        w, low = words(data, offsets), lowered(data)
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)[w.text_of] if len(w.hashes) else np.zeros(0, object)
        for lang in sorted(set(langs.tolist())):
            mine = langs == lang
            unique, at, n = np.unique(w.hashes[mine], return_index=True, return_counts=True)
            starts, ends = w.starts[mine][at], w.ends[mine][at]
            tables = [(0, unique, n)]
            for length in LENGTHS:
                gram, of = _grams(low, starts, ends, length)
                values, place = np.unique(gram, return_inverse=True)
                tables.append((length, values, np.bincount(place, weights=n[of], minlength=len(values)).astype(np.int64)))
            for level, values, count in tables:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), level, np.int32)),
                     pa.array(values.view(np.int64)), pa.array(count.astype(np.int64))], ["lang", "level", "h", "n"])


@dataclass
class Model:
    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # level: sorted hashes, log frequencies (entries x languages)

    def look_up(self, level: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row in the table) of each hash."""
        keys = self.tables[level][0]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def scores(self, data: np.ndarray, w: Words) -> np.ndarray:
        """Mean log frequency of each text's words (texts x languages)."""
        values = np.zeros((len(w.hashes), len(self.langs)), dtype=np.float32)
        known, at = self.look_up(0, w.hashes)
        values[known] = self.tables[0][1][at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            _, one, back = np.unique(w.hashes[rest], return_index=True, return_inverse=True)
            values[rest] = self._unseen(lowered(data), w.starts[rest][one], w.ends[rest][one])[back]
        total = np.zeros((len(w.offsets) - 1, len(self.langs)))
        if len(values):
            full = np.diff(w.offsets) > 0
            total[full] = np.add.reduceat(values, w.offsets[:-1][full], axis=0, dtype=np.float64)
        return total / np.maximum(np.diff(w.offsets), 1)[:, None]

    def _unseen(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.langs)), dtype=np.float32)
        open_words = np.arange(len(starts))
        for length in LENGTHS:
            if not len(open_words):
                break
            gram, of = _grams(low, starts[open_words], ends[open_words], length)
            known, at = self.look_up(length, gram)
            if not known.any():
                continue
            n = np.bincount(of[known], minlength=len(open_words))
            rows = self.tables[length][1][at[known]]
            sums = np.stack([np.bincount(of[known], weights=rows[:, i], minlength=len(open_words)) for i in range(rows.shape[1])], 1)
            hit = n > 0
            out[open_words[hit]] = sums[hit] / n[hit, None]
            open_words = open_words[~hit]
        return out


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model of the non-null ``lang`` values of (doc_id, text, lang); None if there is nothing to learn from.

    ``sample_docs`` bounds the labelled documents it learns from (about that many, by a hash of the id). All words that these use
    twice and all their n-grams are in the model, so their number bounds its size too.
    """
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n = usable.select("lang").count()
    if not n:
        return None
    if n > sample_docs:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_docs / n))
    counted = usable.select("text", "lang").mapInArrow(_counts, "lang string, level int, h long, n long")
    counted = staged(counted.groupBy("lang", "level", "h").agg(F.sum("n").alias("n")), "lang-counts")
    totals = {(r["lang"], r["level"]): r["n"] for r in counted.groupBy("lang", "level").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return None
    tables = {}
    for level in (0, *LENGTHS):
        wide = counted.where(F.col("level") == level).groupBy("h").agg(
            F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i, lang in enumerate(langs)])
        # A word seen once says less than its n-grams do.
        top = wide.where(F.col("all") >= (2 if level == 0 else 1)).drop("all").toArrow()
        h = top.column("h").to_numpy().view(U64)
        order = np.argsort(h)
        n_of = np.stack([top.column(f"n{i}").to_numpy() for i in range(len(langs))], 1)[order].astype(float)
        all_of = np.array([totals.get((lang, level), 0) for lang in langs], dtype=float)
        tables[level] = h[order], np.log((n_of + 0.5) / (all_of + 0.5 * (len(h) + 1))).astype(np.float32)
    return Model(langs, tables)


def _free(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def predict(docs: DataFrame, model: Model | None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score in the columns ``into``; columns of these names are replaced."""
    docs = docs.drop(*into)
    own = docs.withColumns({into[0]: F.lit(UNKNOWN), into[1]: F.lit(0.0)})
    if model is None:
        return own
    letter = _free("_has_letter", docs.columns)
    names = list(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sub_batches(batches):
            data, offsets = utf8(batch.column("text"))
            mean = m.scores(data, words(data, offsets))
            share = np.exp(mean - mean.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            named = np.array(batch.column(letter).to_pylist(), dtype=bool)
            pred = pa.array([m.langs[b] if ok else UNKNOWN for b, ok in zip(best, named)], pa.string())
            score = pa.array(np.where(named, share.max(1), 0.0))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pred, score], [*names, *into])

    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, own.schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def identify(docs: DataFrame, into: tuple[str, str] = ("lang_pred", "score"), **bounds) -> DataFrame:
    """``docs`` with language and score; learns from the documents that are not held out."""
    return predict(docs, train(docs.where(F.coalesce(~held_out(), F.lit(True))), **bounds), into)


def report(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs.where(F.coalesce(~held_out(), F.lit(True))), **bounds)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3, **bounds) -> DataFrame:
    """Without the documents that have no language or whose best language is hardly better than the others."""
    lang, score = (_free(name, docs.columns) for name in ("_lang_pred", "_lang_score"))
    found = identify(docs, (lang, score), **bounds)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
