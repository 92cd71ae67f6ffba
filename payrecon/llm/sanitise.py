"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of the terms that reveal them.

Patterns give the protected entities (an e-mail address, an IP address, a card or phone number, each by its value). How
strongly a term t reveals an entity e is estimated from the corpus: with p(e), p(t) and p(e,t) the shares of the
documents that hold them (t within ``window`` words of e), the disclosure is PMI(e;t) / IC(e) = log(p(e,t) / p(e) p(t)) /
-log p(e). It is 1 if every document with t holds e. Terms that co-occur with the entity in at least ``support``
distinct texts and reach ``generalise_at`` are replaced by a general word, and at ``remove_at`` removed, wherever they
stand in any text: near the entity, far from it, or where the entity itself is not named. An entity's own
characters are always replaced by the name of its kind.

Only the windows around entities are exploded. The corpus frequency of the candidate terms is counted over all texts; a
filter of fixed size keeps other words from being shuffled, and an exact join follows; the occurrences of the disclosing
terms are found in the same way. Copies of a text count as
documents but not for the support, and share their spans, which are worked out once per distinct text.

Defined results: null and empty texts have no spans and stay as they are; extra columns pass through; repeated rows
are treated alike; an empty table gives no rows. A null id is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from payrecon.llm.common import Bloom, chars_at, staged, sub_batches, utf8, words

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are matched whole and only from their start, which the greedy base pattern does as well.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_FILTER_BITS = 23


_FOUND = ("kinds array<int>, starts array<int>, ends array<int>, entities array<binary>, "
          "context array<struct<entity:binary,term:long>>")
_ARROW = pa.schema([
    ("digest", pa.binary()), ("kinds", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("entities", pa.list_(pa.binary())),
    ("context", pa.list_(pa.struct([("entity", pa.binary()), ("term", pa.int64())])))])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from the at signs, so the time is linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)


def identifiers(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, normalised value) of the direct identifiers of one text."""
    out = []
    if "@" in text:
        out += [(0, s, e, text[s:e].lower()) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end(), m[0]))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 8 <= len(digits) <= 15:
                out.append((3, m.start(), m.end(), digits))
    return out


def _context(text: str, found: list, values: list[bytes], window: int) -> list[dict]:
    """Words near each identifier, except words of identifiers."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = words(data, np.array([0, len(data)]))
    starts, ends = chars_at(data, 0, w.starts), chars_at(data, 0, w.ends)
    held = np.zeros(len(starts), dtype=bool)
    spans = [(int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, e))) for _, s, e, _ in found]
    for a, b in spans:
        held[a:b] = True
    out = []
    for (a, b), v in zip(spans, values):
        near = np.r_[max(0, a - window):a, b:min(len(starts), b + window)].astype(np.int64)
        near = near[~held[near]]
        out += [{"entity": v, "term": t} for t in w.hashes[near].view(np.int64).tolist()]
    return out


def _scan(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One row for each text with identifiers."""
    for batch in sub_batches(batches):
        out: dict[str, list] = {n: [] for n in _ARROW.names}
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
            found = identifiers(text) if text else []
            if not found:
                continue
            values = [hashlib.blake2b(f"{KINDS[k]}:{v}".encode(), digest_size=12).digest() for k, _, _, v in found]
            for name, value in zip(_ARROW.names, (
                    digest, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], values,
                    _context(text, found, values, window))):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_ARROW)


def _term_counts(batches: Iterable[pa.RecordBatch], wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """(term, number of texts of the batch that hold it) of the candidate terms."""
    for batch in sub_batches(batches):
        w = words(*utf8(batch.column("text")))
        hit = wanted.has(w.hashes)
        order = np.lexsort((w.text_of[hit], w.hashes[hit]))
        terms, texts = w.hashes[hit][order], w.text_of[hit][order]
        if len(terms):
            new = np.r_[True, (terms[1:] != terms[:-1]) | (texts[1:] != texts[:-1])]
            values, counts = np.unique(terms[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["term", "n"])


def _occurrences(batches: Iterable[pa.RecordBatch], wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Places in code points of the words of all texts that may be disclosing terms, except words of identifiers."""
    for batch in sub_batches(batches):
        data, offsets = utf8(batch.column("text"))
        w = words(data, offsets)
        hit = np.flatnonzero(wanted.has(w.hashes))
        if not len(hit):
            continue
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        text = w.text_of[hit]
        base = chars[offsets[text]]
        starts, ends, free = chars[w.starts[hit]] - base, chars[w.ends[hit]] - base, np.ones(len(hit), bool)
        cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            for _, s, e, _ in identifiers(batch.column("text")[int(text[a])].as_py()):
                free[a + np.searchsorted(ends[a:b], s, side="right"):a + np.searchsorted(starts[a:b], e)] = False
        yield pa.RecordBatch.from_arrays([
            batch.column("digest").take(pa.array(text[free])), pa.array(w.hashes[hit[free]].view(np.int64)),
            pa.array(starts[free].astype(np.int32)), pa.array(ends[free].astype(np.int32))], ["digest", "term", "start", "end"])


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")


def disclosing_terms(found: DataFrame, docs: DataFrame, support: int, generalise_at: float) -> DataFrame:
    """(entity, term, disclosure) of the pairs that reach the threshold; ``found`` has one row per distinct text."""
    n = float(docs.count())
    pairs = found.select("digest", "copies", F.explode("context").alias("c")).select("digest", "copies", "c.entity", "c.term").distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both"))
    pairs = staged(pairs.where(F.col("texts") >= support), "pii-pairs")
    entities = found.select("copies", F.explode(F.array_distinct("entities")).alias("entity")).groupBy("entity").agg(
        F.sum("copies").alias("n_entity"))
    wanted = Bloom.of(pairs, "term", _FILTER_BITS)
    seen = docs.select("text").mapInArrow(lambda it: _term_counts(it, wanted), "term long, n long")
    terms = seen.groupBy("term").agg(F.sum("n").alias("n_term"))
    pmi = F.log(F.col("both") * n / (F.col("n_entity") * F.col("n_term")))
    content = -F.log(F.col("n_entity") / n)
    scored = pairs.join(entities, "entity").join(terms, "term").withColumn(
        "disclosure", F.when(content > 0, pmi / content).otherwise(F.lit(0.0)))
    return scored.where(F.col("disclosure") >= generalise_at).select("entity", "term", "disclosure")


def find(docs: DataFrame, window: int = 8, support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """(digest, kinds, starts, ends, terms) of each distinct text with identifiers or disclosing terms.

    ``terms`` is a sorted array of (start, end, removed). Spans depend on the text alone, so its digest is the key.
    """
    scanned = staged(docs.select(_digest(), "text").mapInArrow(lambda it: _scan(it, window), "digest binary, " + _FOUND), "pii-scan")
    found = staged(scanned.groupBy("digest").agg(
        F.first(F.struct("kinds", "starts", "ends", "entities", "context")).alias("f"), F.count(F.lit(1)).alias("copies"),
    ).select("digest", "copies", "f.*"), "pii-texts")
    bad = disclosing_terms(found, docs, support, generalise_at).groupBy("term").agg(F.max("disclosure").alias("d"))
    bad = staged(bad, "pii-terms")
    wanted = Bloom.of(bad, "term", _FILTER_BITS)
    places = docs.select(_digest(), "text").mapInArrow(
        lambda it: _occurrences(it, wanted), "digest binary, term long, start int, end int")
    hits = places.join(bad, "term").groupBy("digest", "start", "end").agg(F.max("d").alias("d"))
    terms = hits.groupBy("digest").agg(F.array_sort(F.collect_list(
        F.struct("start", "end", (F.col("d") >= remove_at).alias("removed")))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    empty = F.array().cast("array<int>")
    return found.select("digest", "kinds", "starts", "ends").join(terms, "digest", "full").select(
        "digest", *[F.coalesce(c, empty).alias(c) for c in ("kinds", "starts", "ends")], F.coalesce("terms", none).alias("terms"))


def report(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans as text."""
    base = F.arrays_zip("kinds", "starts", "ends")
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda kind, s, e: F.concat_ws(":", kind, s.cast("string"), e.cast("string"))
    sorted_base = F.array_sort(F.transform(base, lambda b: F.struct(b["kinds"].alias("k"), b["starts"].alias("s"), b["ends"].alias("e"))))
    lines = F.transform(sorted_base, lambda b: line(F.element_at(names, b["k"] + 1), b["s"], b["e"]))
    extra = F.transform("terms", lambda t: line(F.when(t["removed"], "removed").otherwise("general"), t["start"], t["end"]))
    count = lambda kind: F.size(F.filter("kinds", lambda x: x == kind)).cast("long")
    spans = find(docs, **parameters).select(
        "digest", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_join(lines, ",").alias("base"), F.array_join(F.concat(lines, extra), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"))
    all_docs = docs.select("doc_id", _digest()).join(spans, "digest", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return all_docs.select(
        "doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))


@F.udf(returnType=T.StringType(), useArrow=True)
def _rewritten(text, kinds, starts, ends, terms):
    """The text with identifiers named by kind, and disclosing terms generalised or removed."""
    if kinds is None:
        return text
    pieces, at = [], 0
    marks = sorted([(s, e, f"[{KINDS[k].upper()}]") for k, s, e in zip(kinds, starts, ends)]
                   + [(t["start"], t["end"], "" if t["removed"] else "[TERM]") for t in terms])
    for s, e, by in marks:
        if s >= at:
            pieces += [text[at:s], by]
        at = max(at, e)
    return "".join([*pieces, text[at:]])


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with rewritten texts; columns as they came."""
    spans = find(docs, **parameters)
    key = "_digest_of_text"
    while key in docs.columns:
        key += "_"
    joined = docs.withColumn(key, _digest()).join(spans.select(
        F.col("digest").alias(key), F.struct("kinds", "starts", "ends", "terms").alias(key + "f")), key, "left")
    f = F.col(key + "f")
    text = _rewritten("text", f["kinds"], f["starts"], f["ends"], f["terms"])
    return joined.withColumn("text", text).select(*docs.columns)
