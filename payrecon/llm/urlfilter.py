"""URL lists as a cascade of Bloom filters: exact membership for every key of a corpus, without a join.

A list (rules of host and path, single addresses) is given as rows. The *key universe* of a corpus are all keys that a lookup in it
can ask for: the rule keys that would fit a url, and the url's own address. Level 1 of a cascade is a Bloom filter of the
listed keys; level 2 holds the keys of the universe that level 1 takes for listed although they are not; level 3 the listed
keys that level 2 takes for those; and so on, each level a fraction of the one two before it, until no key is taken
wrongly. A lookup goes down the levels to the first that misses: a miss at an even level means listed, at an odd level not
listed. So answers are exact for all keys of the universe and for all listed ones, and a lookup touches two small bit arrays
in most cases; pages are neither shuffled nor joined.

What is built when: the universe is streamed once against level 1 and only its hits are written; no shuffle of the universe
takes place. Level 1 lets ``sqrt(1/2) * listed / universe`` of the unlisted keys through, the other levels half, which is the
smallest total. A key is known by 128 bits of hash; if two keys of a corpus ever agreed in them, the levels would stop
shrinking, which is noticed, and the cascade is built anew with other hashes.

Size: about ``1.44 * log2(universe / listed) + 4`` bits a listed key. ``max_bytes`` bounds what is broadcast at once: a longer
list is dealt into shards by hash, each with its own cascade, and the pages pass one shard after the other, the state of each url
written in between. The driver packs the bits of one level of one shard.

Rules: a rule (host, path) fits its host and all subdomains where the url's path begins with the rule's. The longest (characters
of host and path) decides, among equally long ones that of the longer host; a rule listed as both is a block. Where no rule
fits, an address listed to be blocked is blocked and all others are allowed. Rules are looked up by *shape* (labels of the
host, length of the path); the shapes that occur are listed in the plan, so their number has to be modest, that of the rules
has not.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed unless the empty address is
listed. Rows of repeated or null ``page_id`` are judged one by one. Null or empty hosts and null paths or verdicts in the lists
are left out, repeated rows count once. Empty lists and tables give what follows from that. Extra columns of pages are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from payrecon.llm.common import U64, mix64, staged

MAX_BYTES = 32 << 20
_RULE, _ADDRESS = "rule", "address"
_KEYS = "a long, b long"


# -- urls as columns -------------------------------------------------------------------------------------------

def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fingerprint(kind: str, host: Column, path: Column, seed: int) -> tuple[Column, Column]:
    return tuple(F.xxhash64(F.lit(f"{kind}{half}{seed}"), host, path) for half in "ab")


def _n_labels(host: Column) -> Column:
    return F.length(F.regexp_replace(host, r"[^.]+", "")) + 1


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]], seed: int) -> Column:
    """Keys of a url to look up, in the order in which they decide: its rules' by length, then its address."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes])
    fits = F.filter(known, lambda s: (s.k <= _n_labels(host)) & (s.n <= F.length(path)) & (host != ""))

    def rule(s: Column) -> Column:
        own, begin = F.call_function("substring_index", host, F.lit("."), -s.k), F.left(path, s.n)
        a, b = _fingerprint(_RULE, own, begin, seed)
        return F.struct((F.length(own) + s.n).alias("size"), F.length(own).alias("size_host"), a.alias("a"), b.alias("b"),
                        s.k.alias("k"), s.n.alias("n"))

    a, b = _fingerprint(_ADDRESS, host, path, seed)
    address = F.struct(F.lit(-1).alias("size"), F.lit(-1).alias("size_host"), a.alias("a"), b.alias("b"),
                       F.lit(0).alias("k"), F.lit(0).alias("n"))
    if not shapes:
        return F.array(address)
    return F.concat(F.sort_array(F.transform(fits, rule), asc=False), F.array(address))


# -- the cascade -----------------------------------------------------------------------------------------------

@dataclass
class Level:
    """One Bloom filter: bits in 64-bit words, and how many bits a key sets."""

    bits: np.ndarray
    size: int
    probes: int


def _positions(a: np.ndarray, b: np.ndarray, level: int, size: int, probes: int) -> Iterator[np.ndarray]:
    """Places of keys in a level of ``size`` bits; the levels' places are independent of each other."""
    salt = mix64(np.array([level + 1], dtype=U64))[0]
    first, step = mix64(a ^ salt), mix64(b + salt) | U64(1)
    for j in range(probes):
        yield (first + step * U64(j)) % U64(size)


def _hit(level: Level, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for at in _positions(a, b, number, level.size, level.probes):
        out &= ((level.bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)
    return out


@dataclass
class Cascade:
    """Levels of one shard of a list. ``has`` is exact for the keys the cascade was built for."""

    levels: list[Level] = field(default_factory=list)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(a), dtype=bool)
        at = np.arange(len(a))
        for number, level in enumerate(self.levels):
            at = at[_hit(level, number, a[at], b[at])]
            listed[at] = number % 2 == 0  # a key that every level takes is what the last level holds
        return listed

    @property
    def n_bytes(self) -> int:
        return sum(level.bits.nbytes for level in self.levels)


def _geometry(n: int, share: float) -> tuple[int, int]:
    """Bits and probes of a filter of n keys that lets about ``share`` of the others through."""
    probes = max(1, round(-math.log2(share)))
    return max(64, math.ceil(n * probes / math.log(2))), probes


def _pack(keys: DataFrame, number: int, n: int, share: float) -> Level:
    """A level of n keys. Bits are set within the tasks and merged word by word before the driver gets them."""
    size, probes = _geometry(n, share)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(U64) for c in ("a", "b"))
            at = np.concatenate(list(_positions(a, b, number, size, probes))) if len(a) else np.zeros(0, U64)
            word, bit = (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["w", "b"])

    rows = keys.mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros((size + 63) // 64, dtype=np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return Level(bits.view(U64), size, probes)


def _hits(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(U64) for c in ("a", "b"))
            yield batch.filter(pa.array(_hit(shared.value, number, a, b)))

    return keys.mapInArrow(run, _KEYS)


def build(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade | None:
    """The cascade of the keys ``listed`` (a, b; distinct) over ``universe`` (a, b; repeats allowed; listed ones may be
    among them). None if two keys cannot be told apart by their hashes."""
    cascade = Cascade()
    if not n_listed:
        return cascade
    share = min(0.5, math.sqrt(0.5) * n_listed / max(1, n_universe))
    level = _pack(listed, 0, n_listed, share)
    cascade.levels.append(level)
    wrong = staged(_hits(universe, level, 0).distinct().join(listed, ["a", "b"], "left_anti"), "wrongly-listed")
    # ``inside`` is what the next level holds, ``outside`` what it must miss.
    inside, outside = wrong, listed
    n_inside, n_outside = inside.count(), n_listed
    stuck = 0
    while n_inside:
        number = len(cascade.levels)
        level = _pack(inside, number, n_inside, 0.5)
        cascade.levels.append(level)
        wrong = staged(_hits(outside, level, number), "wrongly-held")
        n = wrong.count()
        stuck = stuck + 1 if n == n_outside else 0
        if stuck > 40:
            return None
        inside, outside = wrong, inside
        n_inside, n_outside = n, n_inside
    return cascade


# -- lists of any length -----------------------------------------------------------------------------------------

def _shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("b", "a"), F.lit(shards))


def n_shards(n_listed: int, n_universe: int, max_bytes: int) -> int:
    """Shards of which each one's cascade stays below ``max_bytes``, with a margin of a half for uneven shards."""
    bits = 1.44 * math.log2(max(2.0, n_universe / max(1, n_listed))) + 6
    return max(1, math.ceil(1.5 * n_listed * bits / 8 / max_bytes))


def cascades(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int, int, Cascade | None]]:
    """(shard, number of shards, cascade) of a list, one at a time. ``listed`` are distinct keys (a, b)."""
    n_listed = listed.count()
    # Only the size of level 1 hangs on the estimate, never an answer.
    n_universe = universe.agg(F.approx_count_distinct("a", 0.05)).first()[0] if n_listed else 0
    shards = n_shards(n_listed, n_universe, max_bytes)
    for shard in range(shards):
        if shards == 1:
            yield 0, 1, build(listed, universe, n_listed, n_universe)
            continue
        own = listed.where(_shard_of(shards) == shard)
        yield shard, shards, build(own, universe.where(_shard_of(shards) == shard), own.count(), n_universe // shards)


# -- judging -------------------------------------------------------------------------------------------------------

def _shape_list(rules: DataFrame) -> list[tuple[int, int]]:
    rows = rules.select(_n_labels(F.col("host")).alias("k"), F.length("path").alias("n")).distinct().collect()
    return sorted((r.k, r.n) for r in rows)


def _mark(rows: DataFrame, held: Broadcast, shard: int, shards: int, bit: int) -> DataFrame:
    """Set ``bit`` of the entry in ``found`` of every candidate of this shard that the cascade holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            found, a, b, mine = (batch.column(at[c]).flatten().to_numpy() for c in ("found", "a", "b", "shard"))
            member = np.zeros(len(a), dtype=bool)
            own = np.flatnonzero(mine == shard)
            member[own] = held.value.has(a[own].view(U64), b[own].view(U64))
            values = pa.array((found | np.where(member, bit, 0)).astype(np.int32))
            lists = batch.column(at["found"])
            columns = list(batch.columns)
            columns[at["found"]] = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    number = F.transform(F.arrays_zip("a", "b"), lambda x: F.pmod(F.xxhash64(x.b, x.a), F.lit(shards)).cast("int"))
    rows = rows.withColumn("shard", number)
    return rows.mapInArrow(run, rows.schema).drop("shard")


def _look_up(pages: DataFrame, allow: DataFrame, block: DataFrame, addresses: DataFrame, max_bytes: int,
             seed: int) -> DataFrame | None:
    """One row a url: found holds for each candidate 1 (an allow key), 2 (a block key), 3 (both) or 0."""
    rules = allow.union(block)
    shapes = _shape_list(rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn(
        "c", candidates(F.col("host"), F.col("path"), shapes, seed))
    rows = rows.select("page_id", "host", "path", F.col("c.k").alias("k"), F.col("c.n").alias("n"), F.col("c.a").alias("a"),
                       F.col("c.b").alias("b"), F.transform("c", lambda x: F.lit(0)).alias("found"))
    universe = rows.select(F.inline(F.arrays_zip("a", "b")))

    def keys(kind: str, df: DataFrame) -> DataFrame:
        a, b = _fingerprint(kind, F.col("host"), F.col("path"), seed)
        return df.select(a.alias("a"), b.alias("b"))

    lists = {1: keys(_RULE, allow), 2: keys(_RULE, block).union(keys(_ADDRESS, addresses))}
    for bit, listed in lists.items():
        listed = staged(listed.distinct(), "listed-keys")
        for shard, shards, cascade in cascades(listed, universe, max_bytes):
            if cascade is None:
                return None
            if cascade.levels:
                rows = _mark(rows, pages.sparkSession.sparkContext.broadcast(cascade), shard, shards, bit)
                if shards > 1:  # so that tasks hold the bits of one shard at a time
                    rows = staged(rows, "urls")
    return rows


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule (``host/path`` of the rule that decides, or null) and verdict (allow or block) of every row
    of ``pages`` (page_id, url), by ``rules`` (host, path, verdict) and the addresses ``blocked`` (host, path)."""
    rules = rules.where((F.col("host") != "") & F.col("path").isNotNull())
    allow, block = (rules.where(F.col("verdict") == v).select("host", "path") for v in ("allow", "block"))
    addresses = allow.limit(0) if blocked is None else blocked.select("host", "path").dropna()
    addresses = staged(addresses, "blocked-addresses") if blocked is not None else addresses
    seed, rows = 0, None
    while rows is None:
        rows, seed = _look_up(pages, allow, block, addresses, max_bytes, seed), seed + 1
    first = F.array_position(F.transform("found", lambda f: f > 0), True).cast("int") - 1
    rows = rows.withColumn("at", F.when(first >= 0, first))
    k, n = F.get("k", F.col("at")), F.get("n", F.col("at"))
    rule = F.when(k > 0, F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -k), F.left("path", n)))
    blocks = F.coalesce(F.get("found", F.col("at")) >= 2, F.lit(False))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"))


# -- the lists of the registered query -------------------------------------------------------------------------------

# Host, path and verdict of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_rows(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def content(html: Column) -> Column:
    """A hash (256 bits) of what a page says: its first article, or all of the html if it has none. Null for null html."""
    article = F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)
    return F.sha2(F.when(article != "", article).otherwise(html), 256)


def copied_addresses(pages: DataFrame) -> DataFrame:
    """(host, path) of addresses at which only copies lie: each of their pages says what a page with a smaller id says.

    The page with the smallest id keeps its address off the list, so each content stays reachable. Null html and null ids are
    no copies. The list grows with the corpus.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                        content(F.col("html")).alias("content"))
    first = rows.where("content IS NOT NULL").groupBy("content").agg(F.min("page_id").alias("first_id"))
    # Written first, so that both sides of the join come straight from a shuffle and a hot content can be split.
    first = staged(first.where("first_id IS NOT NULL"), "first-pages")
    is_copy = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    return rows.join(first, "content", "left").groupBy("host", "path").agg(F.bool_and(is_copy).alias("copied")).where(
        "copied").select("host", "path")


def report(pages: DataFrame) -> DataFrame:
    """The five rules, then the addresses that hold copies only."""
    return judge(pages, rule_rows(pages.sparkSession), copied_addresses(pages))
