"""Phrase collocations by HAT-trie counting.

Words are the runs between spaces and tabs of a text in lower case (A-Z only), cut into pieces at ``. , ; : ! ?`` and line
breaks; phrases are 1 to 3 neighbouring words of a piece, counted per language, overlaps included. Three passes over the texts:

1. *Bounds.* Single words and word pairs are counted by 40-bit hash, and then triples of which both pairs may be frequent. A hash's count is at least the phrase's, so hashes seen
   ``min_count`` times hold all phrases that are. Counts travel as packed arrays, one per task and range of hashes, and are merged
   range by range. The hashes become a Bloom filter whose size follows their number up to 32 MB; a fuller filter lets more
   through and loses nothing, and so do hashes that agree.
2. *Counts.* Phrases that may reach ``min_count`` are counted exactly, by their words, in a
   HAT-trie per task: a shallow trie over the bits of word ids with a root per language, whose leaves are hash containers from
   packed ids of the remaining words to counts. A container that outgrows ``BURST`` entries bursts into a node with a container
   per range of next words. Ids are local to a task and stand for real words. When the tries hold ``MAX_ENTRIES`` entries, the
   largest subtrees are spilled whole, together as one run of rows sorted by their words, until half is left; so memory is bounded on any input. The
   runs are merged per prefix partition: rows go by a hash of language and first two words, and a sum over the runs
   of a partition gives the counts, already partitioned for what follows. A hot prefix brings at most one row per spill
   and distinct phrase.

All counts are long, and scores are quotients of decimals of 38 places, exact for counts below 10**16.

Defined results: null texts count as empty and null languages as ``und``; ids play no part, so repeated rows count as often as they
occur; texts of any length are read in slices of about a megabyte, with the last two words carried over; an empty
table gives no rows. Of extra columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from payrecon.llm.common import U64, Bloom, _BYTE_HASH, _powers, distinct, mix64, staged, sub_batches, utf8, whole_groups

SLICE = 1 << 19
ID_BITS = 21
HASH_BITS = 40
DIGIT = 7
BURST = 8192
MAX_ENTRIES = 800_000
#: Words and bytes of words that a task numbers before it spills all and numbers anew. A slice brings less than 2**20 words.
MAX_WORDS = 1_000_000
MAX_WORD_BYTES = 64 << 20
#: Pairs of (hash, count) that pass 1 holds before it merges equal ones, and hands on what is left.
HELD = 1_500_000
MAX_FILTER_BITS = 28
#: Parts of a language that are ranked on their own first.
PARTS = 8

_GAP, _BREAK = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[32, 9]] = _GAP
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR = U64(0xD1342543DE82EF95)


# -- words -----------------------------------------------------------------------------------------------------

class Slice:
    """New words of a stretch of texts: ``hashes``, text of each, whether it follows its forerunner in a piece, and the bytes."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_of: np.ndarray, follows: np.ndarray):
        self.low, self.starts, self.ends, self.text_of, self.follows = low, starts, ends, text_of, follows

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.low))
        total = np.zeros(len(self.low) + 1, dtype=U64)
        np.cumsum(_BYTE_HASH[self.low] * up, out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))

    def strings(self) -> pa.Array:
        """The words as an array of strings, without going through Python objects."""
        length = self.ends - self.starts
        offsets = np.r_[0, np.cumsum(length)]
        data = self.low[_CLASS[self.low] == 0]
        return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def slices(data: np.ndarray, offsets: np.ndarray, size: int = 0) -> Iterator[Slice]:
    """All words of a batch of texts in stretches cut between words, in order."""
    heads, size = np.unique(offsets), size or SLICE
    at, last_text, broken = 0, -1, True
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data):  # on to a byte that is in no word; a longer word makes a longer slice
            gap = np.flatnonzero(_CLASS[data[end:end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        low = _LOWER[data[at:end]]
        kind = _CLASS[low]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = heads[np.searchsorted(heads, at, side="right"):np.searchsorted(heads, end, side="left")] - at
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = np.concatenate([[0], np.cumsum(kind == _BREAK)])
        if len(starts):
            text_of = np.searchsorted(offsets, starts + at, side="right") - 1
            seen = breaks[starts]
            before_text, before_seen = np.r_[last_text, text_of[:-1]], np.r_[-1 if broken else 0, seen[:-1]]
            yield Slice(low, starts, ends, text_of, (text_of == before_text) & (seen == before_seen))
            last_text, broken = int(text_of[-1]), bool(breaks[-1] > seen[-1])
        else:
            broken = broken or bool(breaks[-1])
        at = end


def _lang_key(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _word_hash(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mix64(words ^ mix64(langs))


def _pair_hash(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Hash of each word with its forerunner; the first entry means nothing."""
    out = np.zeros(len(words), dtype=U64)
    out[1:] = mix64((words[:-1] * _PAIR + words[1:]) ^ mix64(langs[1:] + U64(2)))
    return out


def _triple_hash(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Hash of each word with the two before it; the first two entries mean nothing."""
    out = np.zeros(len(words), dtype=U64)
    if len(words) > 2:
        out[2:] = mix64(((words[:-2] * _PAIR + words[1:-1]) * _PAIR + words[2:]) ^ mix64(langs[2:] + U64(3)))
    return out


def _with_langs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, language index of each text, bytes, offsets) of batches of bounded size."""
    for batch in sub_batches(batches):
        coded = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        yield coded.dictionary.to_pylist(), coded.indices.to_numpy(), data, offsets


# -- pass 1 ----------------------------------------------------------------------------------------------------

def _merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[cut], np.add.reduceat(n, cut)


def _packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 and their counts: differences and counts byte by byte, so that their zeros lie together."""
    both = np.concatenate([np.diff(h, prepend=U64(0)), n.astype(U64)]).astype("<u4")
    return both.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(U64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


_PACKED = "key int, lang string, n long, data binary"


class Held:
    """Hashes with counts, equal ones merged as far as memory allows; gives rows packed by range (``key``)."""

    def __init__(self, range_bits: int):
        self.below, self.parts, self.size = HASH_BITS - range_bits, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        h = np.sort(hashes >> U64(64 - HASH_BITS))
        if not len(h):
            return
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        self.parts.append((h[cut], np.diff(np.r_[cut, len(h)]).astype(np.int32)))
        self.size += len(cut)
        if self.size >= HELD:
            h, n = _merged(*map(np.concatenate, zip(*self.parts)))
            self.parts, self.size = [(h, n)], len(h)
            if self.size >= HELD // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h, n = _merged(*map(np.concatenate, zip(*self.parts)))
        self.parts, self.size = [], 0
        keys = (h >> U64(self.below)).astype(np.int32)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        low = h & U64((1 << self.below) - 1)
        data = [_packed(low[a:b], n[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[cut]), pa.nulls(len(cut), pa.string()), pa.nulls(len(cut), pa.int64()), pa.array(data, pa.binary())],
            ["key", "lang", "n", "data"])


def _bounds(batches: Iterable[pa.RecordBatch], range_bits: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of words and pairs, and the number of words of each language, under negative keys."""
    held, totals = Held(range_bits), {}
    for names, lang_of, data, offsets in _with_langs(batches):
        keys = np.array([_lang_key(x) for x in names], dtype=U64)
        tail = np.zeros(0, U64)
        for s in slices(data, offsets):
            langs, own = keys[lang_of[s.text_of]], s.hashes()
            for i, count in enumerate(np.bincount(lang_of[s.text_of], minlength=len(names)).tolist()):
                if count:
                    totals[names[i]] = totals.get(names[i], 0) + count
            joined = np.concatenate([tail, own])
            pairs = _pair_hash(joined, np.concatenate([langs[:1]] * len(tail) + [langs]))[len(tail):][s.follows]
            tail = own[-1:]
            yield from held.add(np.concatenate([_word_hash(own, langs), pairs]))
    yield from held.rest()
    if totals:
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1 - _lang_key(x) % (1 << range_bits) for x in totals], pa.int32()), pa.array(list(totals)),
             pa.array(list(totals.values()), pa.int64()), pa.nulls(len(totals), pa.binary())], ["key", "lang", "n", "data"])


def _wanted_pairs(h: np.ndarray, langs: np.ndarray, follows: np.ndarray, wanted: Bloom) -> tuple[np.ndarray, np.ndarray]:
    """Words that end a pair that may be frequent, and those that end a triple whose pairs both may be."""
    two = follows.copy()
    two[0] = False
    two[two] = wanted.has(_filter_key(_pair_hash(h, langs)[two] >> U64(64 - HASH_BITS)))
    three = two.copy()
    three[1:] &= two[:-1]
    three[0] = False
    return two, three


def _triple_bounds(batches: Iterable[pa.RecordBatch], range_bits: int, wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Packed counts of triples whose pairs both may be frequent."""
    held = Held(range_bits)
    for names, lang_of, data, offsets in _with_langs(batches):
        keys = np.array([_lang_key(x) for x in names], dtype=U64)
        carried = None
        for s in slices(data, offsets):
            h, lang, follows = s.hashes(), lang_of[s.text_of], s.follows
            new = len(h)
            if carried:
                h, follows, lang = (np.concatenate(x) for x in zip(carried, (h, follows, lang)))
            carried = h[-2:], follows[-2:], lang[-2:]
            three = _wanted_pairs(h, keys[lang], follows, wanted)[1]
            three[:len(h) - new] = False
            yield from held.add(_triple_hash(h, keys[lang])[three])
    yield from held.rest()


def _bounded(batches: Iterable[pa.RecordBatch], min_count: int, range_bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, h, n): filter keys of the hashes of each range that are counted often enough, and the totals of the languages."""
    for table in whole_groups(batches, "key"):
        keys = table.column("key").to_numpy()
        data, langs, counts = (table.column(c).to_pylist() for c in ("data", "lang", "n"))
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
        for a, b in zip(cut, [*cut[1:], len(keys)]):
            if keys[a] < 0:
                names = sorted(set(langs[a:b]))
                of = [sum(n for x, n in zip(langs[a:b], counts[a:b]) if x == name) for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(of, pa.int64())], ["lang", "h", "n"])
                continue
            h, n = _merged(*map(np.concatenate, zip(*map(_unpacked, data[a:b]))))
            h, n = h[n >= min_count], n[n >= min_count]
            h = _filter_key(h | U64(int(keys[a]) << (HASH_BITS - range_bits)))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "h", "n"])


def _filter_key(h: np.ndarray) -> np.ndarray:
    """What stands for a 40-bit hash in the filter."""
    return mix64(h)


# -- pass 2: the trie ------------------------------------------------------------------------------------------

class HatTrie:
    """Counts of sequences of up to three word ids.

    The ids of a sequence are packed into one integer. A leaf is a hash container, a dict from what is left of that integer to
    counts; a node is a dict from the next ``DIGIT`` bits to subtrees, so a word id takes three steps and a container is
    shared by the sequences of a range of ids until it bursts. Sequences of different lengths live in different tries.
    """

    def __init__(self, depth: int, burst: int = BURST):
        self.bits, self.burst, self.size = depth * ID_BITS, burst, 0
        self.root: Leaf | Node = Leaf()

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys``: packed ids, ascending and distinct."""
        self.root = self._add(self.root, keys, counts, self.bits)

    def _add(self, at: Leaf | Node, keys: np.ndarray, counts: np.ndarray, left: int) -> Leaf | Node:
        if isinstance(at, Node):
            left -= DIGIT
            lead = keys >> left
            cuts = np.flatnonzero(lead[1:] != lead[:-1]) + 1
            rest = keys & ((1 << left) - 1)
            begin = 0
            for digit, end in zip(lead[np.r_[0, cuts]].tolist(), [*cuts.tolist(), len(keys)]):
                at[digit] = self._add(at.get(digit) or Leaf(), rest[begin:end], counts[begin:end], left)
                begin = end
            return at
        before = len(at)
        get = at.get
        for key, n in zip(keys.tolist(), counts.tolist()):
            at[key] = get(key, 0) + n
        self.size += len(at) - before
        return self._burst(at, left) if len(at) > self.burst and left > DIGIT else at

    def _burst(self, leaf: Leaf, left: int) -> Node:
        left -= DIGIT
        node, mask = Node(), (1 << left) - 1
        for key, n in leaf.items():
            digit = key >> left
            child = node.get(digit)
            if child is None:
                child = node[digit] = Leaf()
            child[key & mask] = n
        for digit, child in node.items():
            if len(child) > self.burst and left > DIGIT:
                node[digit] = self._burst(child, left)
        return node

    def _subtrees(self, at: Leaf | Node, lead: int, left: int, parent: Node | None, digit: int) -> Iterator[tuple]:
        """(size, container, the bits before it, bits left, its parent and place there) of every container."""
        if isinstance(at, Node):
            for d, child in at.items():
                yield from self._subtrees(child, lead << DIGIT | d, left - DIGIT, at, d)
        else:
            yield len(at), at, lead, left, parent, digit

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole containers out, largest first, until ``keep`` entries are left; each gives (keys, counts)."""
        for size, leaf, lead, left, parent, digit in sorted(
                self._subtrees(self.root, 0, self.bits, None, 0), key=lambda subtree: -subtree[0]):
            if not size or keep and self.size <= keep:
                break
            if parent is None:
                self.root = Leaf()
            else:
                del parent[digit]
            self.size -= size
            yield np.fromiter(leaf, np.int64, size) | (lead << left), np.fromiter(leaf.values(), np.int64, size)


class Leaf(dict):
    """A hash container: packed ids of the remaining words to counts."""


class Node(dict):
    """A trie node: next bits of a word id to subtree."""


class Dictionary:
    """Words numbered in the order in which they come. They are found by hash and then compared, so a number stands for one word."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.hashes, self.ids = np.zeros(0, U64), np.zeros(0, np.int64)  # ascending hashes, and the number of each
        self.odd: dict[str, int] = {}  # words whose hash another word has
        self._rank: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.words)

    def _append(self, words: pa.Array) -> np.ndarray:
        first = len(self.words)
        self.words, self._rank = pa.concat_arrays([self.words, words]), None
        return np.arange(first, len(self.words))

    def number(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; new ones are numbered on."""
        values, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, values), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != values) if len(self.hashes) else np.arange(len(values))
        if len(new):
            numbers = self._append(words.take(pa.array(first[new])))
            where = np.searchsorted(self.hashes, values[new])
            self.hashes, self.ids = np.insert(self.hashes, where, values[new]), np.insert(self.ids, where, numbers)
        out = self.ids[np.searchsorted(self.hashes, values)][back]
        other = np.flatnonzero(~pc.equal(self.words.take(pa.array(out)), words).to_numpy(zero_copy_only=False))
        for i, word in zip(other.tolist(), words.take(pa.array(other)).to_pylist()):
            if word not in self.odd:
                self.odd[word] = int(self._append(pa.array([word], pa.large_string()))[0])
            out[i] = self.odd[word]
        return out

    def rank(self) -> np.ndarray:
        """The place of each number's word among all words in order; made again when words were added."""
        if self._rank is None:
            self._rank = np.empty(len(self.words), dtype=np.int64)
            self._rank[pc.sort_indices(self.words).to_numpy()] = np.arange(len(self.words))
        return self._rank


class Counter:
    """The tries of a task (per language and number of words), its dictionary of words, and its spills as sorted runs."""

    def __init__(self, max_entries: int = MAX_ENTRIES, max_words: int = MAX_WORDS, burst: int = BURST):
        self.tries: dict[tuple[str, int], HatTrie] = {}
        self.words = Dictionary()
        self.max_entries, self.max_words, self.burst = max_entries, max_words, burst

    def add(self, lang: str, k: int, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        trie = self.tries.get((lang, k))
        if trie is None:
            trie = self.tries[lang, k] = HatTrie(k, self.burst)
        trie.add(keys[cut], np.diff(np.r_[cut, len(keys)]))

    def relieve(self) -> Iterator[pa.RecordBatch]:
        """Spill if the dictionary or the tries are full."""
        if len(self.words) > self.max_words or self.words.words.nbytes > MAX_WORD_BYTES:
            yield from self.all()
            self.words = Dictionary()
        size = sum(t.size for t in self.tries.values())
        while size > self.max_entries:
            (lang, k), trie = max(self.tries.items(), key=lambda item: item[1].size)
            before = trie.size
            yield from self._runs(lang, k, trie, before // 2)
            size -= before - trie.size

    def all(self) -> Iterator[pa.RecordBatch]:
        for (lang, k), trie in self.tries.items():
            yield from self._runs(lang, k, trie, 0)
        self.tries = {}

    def _runs(self, lang: str, k: int, trie: HatTrie, keep: int) -> Iterator[pa.RecordBatch]:
        spilled = list(trie.spill(keep))
        if not spilled:
            return
        keys, counts = (np.concatenate(x) for x in zip(*spilled))
        words, rank = self.words.words, self.words.rank()
        mask = (1 << ID_BITS) - 1
        columns = [keys >> (ID_BITS * (k - 1 - j)) & mask for j in range(k)]
        order = np.argsort(reduce(lambda a, c: a << ID_BITS | rank[c], columns[1:], rank[columns[0]]))
        for at in range(0, len(order), 20_000):
            part = order[at:at + 20_000]
            own = [words.take(pa.array(c[part])).cast(pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang), len(part)), *own, *[pa.nulls(len(part), pa.string())] * (3 - k), pa.array(counts[part])],
                ["lang", "w1", "w2", "w3", "n"])


def _phrases(batches: Iterable[pa.RecordBatch], wanted: Bloom, triples: Bloom, counter: Counter) -> Iterator[pa.RecordBatch]:
    """(lang, w1, w2, w3, n): runs of exact counts of phrases that may be frequent."""
    for names, lang_of, data, offsets in _with_langs(batches):
        keys = np.array([_lang_key(x) for x in names], dtype=U64)
        carried = None  # strings, hashes, follows and languages of the last two words
        for s in slices(data, offsets):
            strings, h, lang, follows = s.strings(), s.hashes(), lang_of[s.text_of], s.follows
            new = len(h)
            if carried:
                strings = pa.concat_arrays([carried[0], strings])
                h, follows, lang = (np.concatenate(x) for x in zip(carried[1:], (h, follows, lang)))
            old = len(h) - new
            carried = strings[-2:], h[-2:], follows[-2:], lang[-2:]
            yield from counter.relieve()
            langs = keys[lang]
            one = wanted.has(_filter_key(_word_hash(h, langs) >> U64(64 - HASH_BITS)))
            two, three = _wanted_pairs(h, langs, follows, wanted)
            three[three] = triples.has(_filter_key(_triple_hash(h, langs)[three] >> U64(64 - HASH_BITS)))
            one[:old] = two[:old] = three[:old] = False
            used = one.copy()
            used[:-1] |= two[1:]
            used |= two
            used[:-2] |= three[2:]
            used[:-1] |= three[1:]
            places = np.flatnonzero(used)
            if not len(places):
                continue
            ids = np.zeros(len(h), dtype=np.int64)
            ids[places] = counter.words.number(strings.take(pa.array(places)), h[places])
            for i in distinct(lang[places]).tolist():
                here = lang == i
                p = np.flatnonzero(one & here)
                if len(p):
                    counter.add(names[i], 1, ids[p])
                p = np.flatnonzero(two & here)
                if len(p):
                    counter.add(names[i], 2, ids[p - 1] << ID_BITS | ids[p])
                p = np.flatnonzero(three & here)
                if len(p):
                    counter.add(names[i], 3, (ids[p - 2] << ID_BITS | ids[p - 1]) << ID_BITS | ids[p])
    yield from counter.all()


# -- Spark -----------------------------------------------------------------------------------------------------

def phrase_counts(docs: DataFrame, min_count: int = 10, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, w1, w2, w3 (null in shorter phrases) and n of every phrase of up to three words that occurs
    ``min_count`` times in its language; lang and the number of its words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(16, max(HASH_BITS - 32, (4 * shuffles - 1).bit_length()))
    context = rows.sparkSession.sparkContext

    def settled(packed: DataFrame) -> DataFrame:
        return staged(packed.repartition(shuffles, "key").sortWithinPartitions("key").mapInArrow(
            lambda it: _bounded(it, min_count, range_bits), "lang string, h long, n long"), "phrase-bounds")

    def kept(bounds: DataFrame) -> Broadcast:
        frequent = bounds.where("h IS NOT NULL")
        bits = min(MAX_FILTER_BITS, max(16, (frequent.count() * 12).bit_length()))
        return context.broadcast(Bloom.of(frequent, "h", bits))

    bounds = settled(rows.mapInArrow(lambda it: _bounds(it, range_bits), _PACKED))
    totals = bounds.where("h IS NULL").select("lang", F.col("n").alias("total"))
    wanted = kept(bounds)
    triples = kept(settled(rows.mapInArrow(lambda it: _triple_bounds(it, range_bits, wanted.value), _PACKED)))
    runs = rows.mapInArrow(lambda it: _phrases(it, wanted.value, triples.value, Counter(**limits)), "lang string, w1 string, w2 string, w3 string, n long")
    merged = runs.repartition("lang", "w1", "w2").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return staged(merged, "phrases"), totals


def _score(a: Column, left: Column, right: Column) -> Column:
    big = [c.cast("decimal(38,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * big[0] * big[0], big[1] * big[2])


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 10, cover: int = 50, **limits: int) -> DataFrame:
    """lang, rank, phrase, a (count), l and r (counts of the two parts), n (words of the language) and score of the ``top``
    phrases of 2 to 3 words of each language.

    The score is ``floor(1000000 a a / (l r))`` of the cut that scores lowest (the first of equals). A pair inside a candidate
    of three words that has at least ``cover`` per cent of its count is dropped.
    """
    phrases, totals = phrase_counts(docs, min_count, **limits)
    one = phrases.where("w2 IS NULL").select("lang", "w1", "n")
    two = phrases.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "n")
    three = phrases.where("w3 IS NOT NULL")

    def with_count(df: DataFrame, counts: DataFrame, words: list[str], name: str) -> DataFrame:
        """The count of the phrase that the columns ``words`` make, in a column ``name``."""
        keys = counts.columns[1:-1]
        return df.join(counts.select("lang", *[F.col(k).alias(w) for k, w in zip(keys, words)], F.col("n").alias(name)), ["lang", *words])

    longer = three.select("lang", F.inline(F.array(
        F.struct("w1", "w2", "n"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("n").alias("longest"))
    pairs = two.join(longer, ["lang", "w1", "w2"], "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("n") * cover))
    pairs = with_count(with_count(pairs, one, ["w1"], "l"), one, ["w2"], "r")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    triples = with_count(with_count(three, one, ["w1"], "l1"), two, ["w2", "w3"], "r1")
    triples = with_count(with_count(triples, two, ["w1", "w2"], "l2"), one, ["w3"], "r2")
    cuts = F.least(*[F.struct(_score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"),
                              F.col(f"r{k}").alias("r")) for k in (1, 2)])
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), cuts.alias("c")).select(
        "lang", "phrase", "a", "c.l", "c.r", "c.score")
    # The first of every part of a language come together, and Spark keeps the first ``top`` of every task before rows meet; so
    # what one task gets of a language is bounded by the parts, however many candidates there are.
    order = F.desc("score"), F.desc("a"), "phrase"
    parts = pairs.union(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.drop("rank", "part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
