"""Fill-in-the-middle transformation with piece tables.

A document is a list of *pieces* (buffer, start, length in bytes) over two immutable buffers: its text, and the three
sentinels. At first it is one piece, the whole text. Cutting splits pieces; an arrangement permutes them and puts sentinel pieces
between; neither touches text. Output is only made when it is asked for: as a column of texts (:func:`rendered`), or streamed
piece by piece into a hash (:func:`digests`). The inverse permutation, read off the sentinel pieces of an output, puts the text
pieces back in their places, where neighbouring ones merge to the one piece at the beginning.

Cut places are counted in *units*, runs of ASCII letters and single other code points, so no word is cut. How a document is cut
and in which form it is put follows from a hash of its id alone, so it is the same on every run, in every partition and
after a lost executor. Nothing is shuffled: every document is transformed where it is read, and texts of any length are handled
as one byte buffer with a few integers.

Forms: ``plain`` (the text as it is: empty texts, texts that hold a sentinel's string, and a tenth of the others), ``psm``
(``<P>`` prefix ``<S>`` suffix ``<M>`` middle) and ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle; a fifth of the rest).

Defined results: a null text counts as empty; a null ``doc_id`` is hashed as an empty one; repeated rows give repeated rows; an
empty table gives no rows. Of extra columns none is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from payrecon.llm.common import sub_batches, utf8

TEXT, SENTINELS = 0, 1
# The sentinels, and the shares (of 100) of documents left plain and of the others put suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SUFFIX_FIRST = 10, 20

SENTINEL_BUFFER = PREFIX + SUFFIX + MIDDLE
_MARK = {name: (SENTINELS, SENTINEL_BUFFER.index(name), len(name)) for name in (PREFIX, SUFFIX, MIDDLE)}
#: The parts of each form in their order: a sentinel, then the part of the document (0 prefix, 1 middle, 2 suffix).
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

Piece = tuple[int, int, int]
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
PIECES = "array<struct<buffer: int, start: long, length: long>>"


# -- pieces ----------------------------------------------------------------------------------------------------

def cut(pieces: list[Piece], places: Iterable[int]) -> list[list[Piece]]:
    """The pieces dealt into parts at byte places of their concatenation (ascending); parts may be empty."""
    parts: list[list[Piece]] = [[]]
    ahead = list(places)
    at = 0
    for buffer, start, length in pieces:
        while ahead and ahead[0] <= at + length:
            head = ahead.pop(0) - at
            if head:
                parts[-1].append((buffer, start, head))
            start, length, at = start + head, length - head, at + head
            parts.append([])
        if length:
            parts[-1].append((buffer, start, length))
        at += length
    return parts + [[] for _ in ahead]


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """An output as pieces: sentinels, and the document's parts in the form's order."""
    return [piece for mark, part in ORDERS[form] for piece in (_MARK[mark], *parts[part])]


def restore(pieces: list[Piece], form: str) -> list[Piece]:
    """The pieces of the document an output was made from; neighbours in the same buffer become one."""
    if form in ORDERS:
        parts: list[list[Piece]] = [[], [], []]
        order = iter(ORDERS[form])
        part = None
        for piece in pieces:
            if piece[0] == SENTINELS:
                mark, part = next(order)
                if piece != _MARK[mark]:
                    raise ValueError(f"not in the form {form}")
            else:
                parts[part].append(piece)
        pieces = [piece for p in parts for piece in p]
    merged: list[Piece] = []
    for buffer, start, length in pieces:
        if merged and merged[-1][0] == buffer and merged[-1][1] + merged[-1][2] == start:
            merged[-1] = (buffer, merged[-1][1], merged[-1][2] + length)
        else:
            merged.append((buffer, start, length))
    return merged


def located(output: bytes, form: str) -> list[Piece]:
    """The pieces of a rendered output, sentinels told from text by the form. The text buffer is then the output itself.

    Only texts without a sentinel's string are ever arranged, and no sentinel can arise where two pieces meet, as it
    begins with the only ``<`` it has; so each is found once.
    """
    if form not in ORDERS:
        return [(TEXT, 0, len(output))] if output else []
    pieces: list[Piece] = []
    at = 0
    for mark, _ in ORDERS[form]:
        found = output.index(mark, at)
        if found > at:
            pieces.append((TEXT, at, found - at))
        pieces.append(_MARK[mark])
        at = found + len(mark)
    return pieces + ([(TEXT, at, len(output) - at)] if at < len(output) else [])


def stream(text: memoryview | bytes, pieces: Iterable[Piece]) -> Iterator[memoryview]:
    """The bytes of pieces, one after the other, without copies."""
    buffers = memoryview(text), memoryview(SENTINEL_BUFFER)
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def choice(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from a document's id."""
    digest = hashlib.sha256(b"1:%s" % (b"" if doc_id is None else b"%d" % doc_id)).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


# -- documents -------------------------------------------------------------------------------------------------

def _transformed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "pieces"]
    for batch in sub_batches(batches):
        ids = batch.column("doc_id")
        data, offsets = utf8(batch.column("text"))
        letter, lead = _LETTER[data], (data & 0xC0) != 0x80
        unit = lead.copy()
        unit[1:] &= ~(letter[1:] & letter[:-1])
        heads = offsets[:-1][offsets[:-1] < len(data)]
        unit[heads] = lead[heads]
        units = np.flatnonzero(unit)
        chars = np.concatenate([[0], np.cumsum(lead)])
        first = np.searchsorted(units, offsets)
        forms, counts, prefix, middle, pieces = [], [], [], [], []
        for i, doc in enumerate(ids.to_pylist()):
            begin, end = int(offsets[i]), int(offsets[i + 1])
            n = int(first[i + 1] - first[i])
            h1, h2, h3, h4 = choice(doc)
            whole = [(TEXT, 0, end - begin)] if end > begin else []
            text = data[begin:end].tobytes()
            plain = not n or h3 % 100 >= 100 - PLAIN or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
            form = "plain" if plain else "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
            counts.append(n)
            forms.append(form)
            if plain:
                prefix.append(None)
                middle.append(None)
                pieces.append(whole)
                continue
            cuts = [int(units[first[i] + u]) if u < n else end for u in sorted((h1 % (n + 1), h2 % (n + 1)))]
            prefix.append(int(chars[cuts[0]] - chars[begin]))
            middle.append(int(chars[cuts[1]] - chars[cuts[0]]))
            pieces.append(arrange(cut(whole, [c - begin for c in cuts]), form))
        flat = [p for own in pieces for p in own]
        columns = list(zip(*flat)) if flat else [(), (), ()]
        structs = pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["buffer", "start", "length"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(own) for own in pieces])].astype(np.int32)), structs)
        yield pa.RecordBatch.from_arrays([
            ids, batch.column("text"), pa.array(counts, pa.int64()), pa.array(forms), pa.array(prefix, pa.int64()),
            pa.array(middle, pa.int64()), lists], names)


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars and middle_chars (code points; null if plain) and pieces: the output's
    piece table, places in bytes of the UTF-8 text (buffer 0) or of the sentinels (buffer 1)."""
    return docs.select("doc_id", "text").mapInArrow(
        _transformed,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n long, form string, prefix_chars long, "
        f"middle_chars long, pieces {PIECES}")


def rendered(text: Column, pieces: Column) -> Column:
    """The output of a piece table as a text (in the JVM; bytes are cut, not code points)."""
    own, marks = F.encode(F.coalesce(text, F.lit("")), "utf-8"), F.encode(F.lit(SENTINEL_BUFFER.decode()), "utf-8")
    return F.decode(F.aggregate(pieces, F.encode(F.lit(""), "utf-8"), lambda out, p: F.concat(out, F.substring(
        F.when(p.buffer == TEXT, own).otherwise(marks), (p.start + 1).cast("int"), p.length.cast("int")))), "utf-8")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        at = {name: i for i, name in enumerate(batch.schema.names)}
        data, offsets = utf8(batch.column(at["text"]))
        lists, forms = batch.column(at["pieces"]), batch.column(at["form"]).to_pylist()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
        flat = lists.flatten()
        table = list(zip(*[flat.field(c).to_pylist() for c in ("buffer", "start", "length")]))
        view = memoryview(data)
        made, back = [], []
        for i, form in enumerate(forms):
            text, pieces = view[int(offsets[i]):int(offsets[i + 1])], table[bounds[i]:bounds[i + 1]]
            for hashes, order in ((made, pieces), (back, restore(pieces, form))):
                h = hashlib.sha256()
                for part in stream(text, order):
                    h.update(part)
                hashes.append(h.hexdigest())
        columns = [batch.column(at[c]) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(made), pa.array(back)], [
            "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])


def digests(transformed: DataFrame) -> DataFrame:
    """SHA-256 of the output and of the text restored from the output's pieces and form; neither is ever put together."""
    kind = transformed.schema["doc_id"].dataType.simpleString()
    return transformed.mapInArrow(
        _digests, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    return digests(transform(docs))
