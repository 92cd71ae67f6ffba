"""Operators on overlaps between texts: decontamination, Jaccard join, suffix array, chunks."""

import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from payrecon.llm import chunks, decontaminate, jaccard, suffixes
from payrecon.llm.common import Bloom, mix64
from tests.llm.edges import awkward, nothing, prose, table

WORD = re.compile("[A-Za-z0-9_\u0080-\U0010ffff]+")


def tokens(text):
    return [w.lower() for w in WORD.findall(text or "")]


# -- decontamination -----------------------------------------------------------------------------------------

def items(spark, texts):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "item_id long, text string, key string")


def test_substituted_passages_are_found_where_they_stand(spark):
    passage = prose(50, 30).split()
    changed = list(passage)
    changed[7], changed[19] = "ZZZ", "YYY"
    docs = table(spark, [
        prose(1, 100) + " " + " ".join(passage) + " " + prose(2, 90), prose(3, 40) + "! " + ", ".join(changed).upper(),
        prose(4, 200), prose(5, 30) + " " + " ".join(passage[:9])])
    found = {r.doc_id: r for r in decontaminate.overlaps(docs, items(spark, [" ".join(passage), None, "", "too short"])).collect()}
    assert set(found) == {0, 1}
    assert (found[0].equal_words, found[0].n_words, found[0].item_word) == (30, 30, 0)
    assert (found[1].equal_words, found[1].n_words) == (28, 30)
    text = docs.where("doc_id = 0").first().text
    assert tokens(text[found[0].start:found[0].end]) == [w.lower() for w in passage]


def test_masks_hit_every_pattern_of_the_rule():
    for n, k in ((13, 0), (14, 1), (15, 2), (16, 3), (20, 4), (25, 5), (30, 6)):
        changed = (1 << np.array(list(combinations(range(n), k)), dtype=np.int64)).sum(1) if k else np.zeros(1, np.int64)
        hit = np.zeros(len(changed), bool)
        for mask in decontaminate.MASKS:
            read = sum(1 << j for j, c in enumerate(mask) if c == "1")
            for at in range(n - len(mask) + 1):
                hit |= changed & (read << at) == 0
        assert hit.all(), (n, k)


def brute_overlap(doc, item):
    """Most equal words of a run on any diagonal at identity 0.8."""
    best = 0
    for d in range(-len(item) + 1, len(doc)):
        same = [doc[p] == item[p - d] for p in range(max(0, d), min(len(doc), len(item) + d))]
        for a in range(len(same)):
            for b in range(a + 1, len(same) + 1):
                equal = sum(same[a:b])
                if 5 * equal >= 4 * (b - a):
                    best = max(best, equal)
    return best


def test_overlaps_equal_brute_force(spark):
    item = unlike(900, 70).split()
    rng = np.random.default_rng(5)
    changes = [[6, 7, 8, *range(16, 70)], [*range(13, 70, 4)], [3, 6, 9, *range(16, 70)], [3, 7, 11, *range(15, 70)], [4, 8, *range(15, 70)]]
    changes += [rng.choice(70, n, replace=False) for n in (8, 14, 18, 22) for _ in range(8)]
    changes += [[p for p in range(70) if not a <= p < a + 16 or p in a + rng.choice(16, k, replace=False)] for a in range(0, 50, 5) for k in (2, 3, 4)]
    docs = []
    for i, change in enumerate(changes):
        copy = list(item)
        for p in change:
            copy[p] = f"c{i}n{p}"
        docs.append(copy)
    expected = {i: n for i, d in enumerate(docs) if (n := brute_overlap(d, item)) >= 13}
    assert {0, 1, 2} <= set(expected)
    found = decontaminate.overlaps(table(spark, [" ".join(d) for d in docs]), items(spark, [" ".join(item), " ".join(item[:11])])).collect()
    assert {r.doc_id: r.equal_words for r in found} == expected
    assert all(r.item_id == 0 and 5 * r.equal_words >= 4 * r.n_words for r in found)


def test_decontamination_of_awkward_tables(spark):
    docs = awkward(spark)
    bench = items(spark, [prose(1, 80), None])
    assert {r.doc_id for r in decontaminate.overlaps(docs, bench).collect()} == {1, 6}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 3, 4, 5, None, 7, 8, 9, 10])
    assert decontaminate.overlaps(nothing(spark), bench).collect() == []
    assert decontaminate.decontaminate(docs, bench.where("1 = 0")).count() == docs.count()


# -- Jaccard join --------------------------------------------------------------------------------------------

def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            union = len(sets[a] | sets[b])
            if union and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * union:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near(seed, n, changes):
    w = prose(seed, n).split()
    rng = np.random.default_rng(changes * 100 + seed)
    for p in rng.choice(n, changes, replace=False):
        w[p] = f"new{rng.integers(1e6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = [near(s, 120, c) for s in range(4) for c in range(0, 9)] + [prose(77, 60)] * 3 + ["one two", "one two", "", None, "one"]
    docs = table(spark, texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.links(docs).collect()}
    assert got == brute_links(list(enumerate(texts)))


@pytest.mark.parametrize("block", [jaccard.BLOCK, 300])
def test_a_group_of_two_thousand_near_copies(spark, monkeypatch, block):
    """Every link of a hot group is counted, and up to a block's size its members travel once per band."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = [near(5, 200, 1 + (s % 7 == 0) * 3).replace("new", f"new{s}x") for s in range(2000)]
    sets = [shingles(t) for t in texts]
    place = {g: i for i, g in enumerate(set().union(*sets))}
    held = np.zeros((len(texts), len(place)), dtype=np.float32)
    for i, own in enumerate(sets):
        held[i, [place[g] for g in own]] = 1
    shared, sizes = held @ held.T, held.sum(1)
    linked = shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared)  # with itself too; the groups are cliques
    seen = []
    monkeypatch.setattr(jaccard, "staged", lambda df, name, real=jaccard.staged: seen.append((name, real(df, name))) or seen[-1][1])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.links(table(spark, texts)).collect()}
    assert got == {i: (int(own.argmax()), int(own.sum()) - 1) for i, own in enumerate(linked)} and linked.sum(1).max() > 1500
    met = dict(seen)["candidates"]
    assert met.count() <= jaccard.BANDS * len(texts) * -(-len(texts) // block)


def test_one_row_of_a_group_stays_whatever_the_ids(spark):
    a, b = prose(1, 80), prose(2, 80)
    kept = jaccard.keep_one(table(spark, [(1, a), (1, a), (5, a), (5, b), (None, a), (None, b), (7, near(1, 80, 1))]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b)]
    nulls = jaccard.keep_one(table(spark, [(None, a), (None, a), (None, b), (None, None)]))
    assert sorted(map(str, (r.text for r in nulls.collect()))) == sorted(map(str, [a, b, None]))


def test_pairs_of_a_large_group_come_in_parts():
    for n in (1, 2, 3, 50):
        got = [p for i, j in jaccard._some_pairs(7, n, 60) for p in zip(i.tolist(), j.tolist())]
        assert got == [(7 + i, 7 + j) for i in range(n) for j in range(i + 1, n)]


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 50 <= least[-1] <= 64
    grams = mix64(np.arange(1000, dtype=np.uint64))
    sig = jaccard.signatures(np.concatenate([grams[:900], grams[100:]]), np.array([0, 900, 1800]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.15


def test_near_copies_of_awkward_tables(spark):
    kept = jaccard.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, None, 7, 8, 9, 10}
    assert jaccard.links(nothing(spark)).collect() == []
    assert jaccard.links(table(spark, ["", None])).count() == 2


# -- repeated passages ---------------------------------------------------------------------------------------

def repeated(rows, k):
    first, hit = {}, set()
    for i, t in rows:
        w = tokens(t)
        for p in range(len(w) - k + 1):
            other = first.setdefault(tuple(w[p:p + k]), i)
            if other != i:
                hit |= {other, i}
    return hit


def passages_in_texts():
    shared, line = prose(90, 60), prose(91, 13)
    texts = [prose(100 + i, 150) + " " + (shared if i % 3 == 0 else prose(200 + i, 60)) + ". " + prose(300 + i, 150 + i) for i in range(12)]
    texts += [line + "\n" + prose(400 + i, 120) for i in range(5)] + [prose(500, 90)] * 4 + [" ".join([prose(501, 70)] * 2)]
    return texts, shared


def test_suffixes_find_exactly_the_passages_of_fifty_words(spark):
    texts, shared = passages_in_texts()
    found = suffixes.passages(table(spark, texts)).collect()
    assert {r.doc_id for r in found} == repeated(list(enumerate(texts)), 50)
    for r in found:
        if r.doc_id < 12:
            assert shared.lower() in texts[r.doc_id][r.start:r.end].lower()
            assert len(tokens(texts[r.doc_id][r.start:r.end])) == r.n_words >= 60


def covered(rows, k):
    """Words of each text that lie in a window of k words which another document holds as well."""
    first, out = {}, Counter()
    for i, t in rows:
        w = tokens(t)
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p:p + k]), set()).add(i)
    for i, t in rows:
        w, hit = tokens(t), set()
        for p in range(len(w) - k + 1):
            if len(first[tuple(w[p:p + k])]) > 1:
                hit |= set(range(p, p + k))
        if hit:
            out[i] = len(hit)
    return out


def words_found(found):
    out = Counter()
    for r in found:
        out[r.doc_id] += r.n_words
    return out


def unlike(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_passages_equal_brute_force_on_random_texts(spark, monkeypatch, hot):
    """Passages of all lengths around the least, at ends of texts, cut into others, in sorted groups and in divided ones."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(3)
    shared = [prose(900 + i, 90).split() for i in range(6)]
    texts = []
    for i in range(60):
        own = unlike(i, int(rng.integers(0, 30))).split()
        for _ in range(int(rng.integers(1, 4))):
            one = shared[rng.integers(6)]
            a = int(rng.integers(0, 40))
            own += one[a:a + int(rng.integers(44, 60))] + unlike(1000 + i, int(rng.integers(0, 3))).split()
        texts.append(" ".join(own))
    expected = covered(list(enumerate(texts)), 50)
    found = suffixes.passages(table(spark, texts)).collect()
    assert words_found(found) == expected and len(expected) > 30
    for r in found:
        assert len(tokens(texts[r.doc_id][r.start:r.end])) == r.n_words >= 50 and r.other_doc != r.doc_id


def test_suffixes_of_a_lead_shared_by_many_meet_wherever_their_documents_lie(spark):
    last = [unlike(b + 300_000 if n in (7, 193) else b * 1000 + n, 12) for b in range(4) for n in range(200)]
    texts = [unlike(i, 30) + " " + prose(700 + i // 200, 40) + " " + x + " " + unlike(i + 200_000, 30) for i, x in enumerate(last)]
    expected = covered(list(enumerate(texts)), 50)
    assert set(expected) == {b * 200 + n for b in range(4) for n in (7, 193)}
    assert words_found(suffixes.passages(table(spark, texts)).collect()) == expected


def left_shared(copies):
    """Documents of a common text followed by different words; those of a pair, far apart, share words before it as well."""
    return [unlike(n, 40) + " " + unlike(n - n % 1000 + n % 1000 % (copies // 2) + 100_000, 12) + " " + prose(600 + b, 42) + " " + unlike(n + 200_000, 40)
            for b in range(4) for n in range(b * 1000, b * 1000 + copies)]


def test_suffixes_of_a_frequent_text_are_extended_to_the_left(spark):
    texts = left_shared(80)
    expected = covered(list(enumerate(texts)), 50)
    assert set(expected) == set(range(len(texts)))
    assert words_found(suffixes.passages(table(spark, texts)).collect()) == expected


def test_suffixes_do_not_depend_on_the_batches(spark):
    texts = left_shared(12)
    texts += [" ".join([prose(610, 60)] * 80), prose(610, 60) + " " + unlike(7, 50)]
    expected = covered(list(enumerate(texts)), 50)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows in (2, 5):
            spark.conf.set(key, rows)
            assert words_found(suffixes.passages(table(spark, texts)).collect()) == expected
    finally:
        spark.conf.set(key, before)


def test_chunks_find_the_passages_and_leave_lines_alone(spark):
    texts, shared = passages_in_texts()
    found = chunks.repeats(table(spark, texts)).collect()
    assert {r.doc_id for r in found} == repeated(list(enumerate(texts)), 50)
    for r in found:
        if r.doc_id < 12:
            assert texts[r.doc_id][r.start:r.end].strip(" .").lower() in shared.lower()
    assert {r.doc_id for r in found if r.kept} == {0, 17}


def test_chunks_resist_insertions():
    base = prose(9, 2000).encode()
    for cut in (5, 3000, 9000):
        changed = base[:cut] + b"something new " + base[cut:]
        both = []
        for raw in (base, changed):
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = chunks.chunk_bounds(data, np.array([0, len(data)]))
            assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= chunks.LONGEST
            both.append(set(chunks.digests(data, starts, ends).tolist()))
        assert len(both[0] - both[1]) <= 12


@pytest.mark.parametrize("operator", [suffixes.passages, chunks.repeats])
def test_repeats_in_awkward_tables(spark, operator):
    assert {r.doc_id for r in operator(awkward(spark)).collect()} == {1, 6}
    assert operator(nothing(spark)).collect() == []
    assert operator(table(spark, ["", None, "x"])).collect() == []


def test_suffixes_take_no_shorter_passages(spark):
    with pytest.raises(ValueError):
        suffixes.passages(nothing(spark), 30)


def test_memory_of_windows_is_bounded_by_the_batch():
    """A worker holds the windows of one mask and of a megabyte of text at a time, however many texts travel together."""
    words = np.random.default_rng(5).integers(0, 1 << 40, 400_000)
    texts = [" ".join(f"{x:x}" for x in words[i:i + 400]) for i in range(0, len(words), 400)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    nothing_wanted = Bloom(np.zeros(1 << 10, dtype=np.uint64))
    list(decontaminate._regions([batch.slice(0, 10)], nothing_wanted))
    tracemalloc.start()
    try:
        assert list(decontaminate._regions([batch], nothing_wanted)) == []
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
