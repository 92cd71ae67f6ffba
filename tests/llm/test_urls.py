"""URL lists: rules against a plain reading of them, cascades against sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from payrecon.llm import urlfilter as uf

URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/x?y=1", "https://WWW.Example.COM/en/x", "http://example.com/fr/#/en/",
    "http://x.net/es/1", "http://x.net/fr/", "http://x.net/fr", "http://x.net/de/", "http://net/es/", "http://notnet/es/",
    "http://com/", "http://com", "x.com/en/", "", None, "://", "a://b.com://c/en/", "http://y.org/" + "a/" * 20_000, "http://" + "a." * 300 + "com/x",
    "http://münchen.net/es/ü", "http://x.org?://y.com/", "http://é.example.com/en/\n/x", "ftp://example.com/en/en/", "http://..com/",
]


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    stop = min([i for i in (rest.find(c, end) for c in "?#") if i >= 0] or [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:stop]


def judged(url, rules, blocked=()):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = max(fits)
        return host, path, best[3], "block" if best[2] else "allow"
    return host, path, None, "block" if (host, path) in set(blocked) else "allow"


def pages(spark, urls, html=None):
    return spark.createDataFrame([(i, u, html(i) if html else "h", "x", 7) for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, found long")


def check(spark, urls, rules, blocked=(), **kw):
    listed = spark.createDataFrame(list(blocked), "host string, path string")
    got = uf.judge(pages(spark, urls), uf.rule_rows(spark, rules), listed, **kw).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged(u, rules, blocked) for i, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_rules_of_the_query(spark):
    check(spark, URLS, uf.RULES)


def test_rules_of_all_shapes_and_ties(spark):
    rules = [("a.com", "/x", "allow"), ("com", "/x/y", "block"), ("b.a.com", "", "block"), ("com", "", "block"), ("com", "", "allow"),
             ("b.com", "/xy", "allow"), ("com", "/xyz", "block")]
    check(spark, [f"http://{h}/{p}" for h in ("a.com", "b.a.com", "b.com", "c.b.com", "com") for p in ("", "x", "xy", "x/y", "xyz", "z")], rules)


@pytest.mark.parametrize("max_bytes", [1 << 20, 300])
def test_long_lists_are_exact_in_one_shard_and_in_many(spark, max_bytes, monkeypatch):
    rng = random.Random(3)
    hosts = [f"h{i}.example.{t}" for i in range(40) for t in ("com", "org")]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice('abc')}/{rng.randrange(30)}" for _ in range(1500)]
    rules = [(h, f"/{c}/", rng.choice(["allow", "block"])) for h in rng.sample(hosts, 30) for c in rng.sample("abc", 2)]
    blocked = sorted({parts(u) for u in rng.sample(urls, 400)})
    seen = []
    monkeypatch.setattr(uf, "cascades", lambda *a, real=uf.cascades: (seen.append(x) or x for x in real(*a)))
    check(spark, urls, rules, blocked, max_bytes=max_bytes)
    assert max(len(c.levels) for *_, c in seen) >= 3  # several levels were needed
    if max_bytes == 300:
        assert max(shards for _, shards, _ in seen) > 2 and all(c.n_bytes <= 2 * max_bytes for *_, c in seen)
    else:
        assert all(shards == 1 for _, shards, _ in seen)


def keys(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "v long").select(
        F.xxhash64(F.lit("p"), "v").alias("a"), F.xxhash64(F.lit("q"), "v").alias("b"))


def test_cascade_is_exact_and_small(spark):
    listed, universe = keys(spark, range(500)), keys(spark, range(20_000))
    cascade = uf.build(listed, universe, 500, 20_000)
    rows = universe.toArrow()
    a, b = (rows.column(c).to_numpy().view(np.uint64) for c in "ab")
    order = keys(spark, range(500)).toArrow()
    known = set(zip(order.column("a").to_pylist(), order.column("b").to_pylist()))
    want = [(x, y) in known for x, y in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist())]
    assert cascade.has(a, b).tolist() == want and sum(want) == 500
    assert len(cascade.levels) > 3 and cascade.n_bytes * 8 < 500 * (1.44 * np.log2(40) + 6)


def test_a_key_with_the_hash_of_a_listed_one_ends_the_build(spark, monkeypatch):
    monkeypatch.setattr(uf, "_hits", lambda keys, level, number: keys)  # a filter that takes everything
    assert uf.build(keys(spark, [1]), keys(spark, [2]), 1, 1) is None


def test_empty_lists_nulls_and_no_rows(spark):
    none = uf.rule_rows(spark).limit(0)
    assert {r.verdict for r in uf.judge(pages(spark, URLS), none).collect()} == {"allow"}
    odd = spark.createDataFrame([(None, "/", "allow"), ("com", None, "block"), ("com", "/", None), ("", "", "block")], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in uf.judge(pages(spark, URLS), odd).collect()} == {(None, "allow")}
    empty = pages(spark, URLS).where("1 = 0")
    assert uf.report(empty).collect() == [] and uf.report(empty).columns == ["page_id", "host", "path", "rule", "verdict"]
    twice = pages(spark, ["http://x.net/es/"]).withColumn("page_id", F.lit(None).cast("long"))
    assert [r.verdict for r in uf.judge(twice.union(twice), uf.rule_rows(spark)).collect()] == ["block", "block"]


def test_addresses_of_copies_only(spark):
    html = {0: "<article>one</article>", 1: "<p>x</p><article id=1>one</article>", 2: "<article>two</article>", 3: "plain", 4: "plain", 5: None, 6: None, 7: "<article>one</article>"}
    urls = ["http://a.org/1", "http://a.org/2", "http://a.org/3", "http://a.org/4", "http://a.org/5", "http://a.org/6", "http://a.org/7", "https://a.org/3?x"]
    df = pages(spark, urls, html.get)
    # 3 is an article of its own, 4 has no article and its own html, 5 repeats that; 7 lies where the first page of "two" lies
    assert {(r.host, r.path) for r in uf.copied_addresses(df).collect()} == {("a.org", "/2"), ("a.org", "/5")}
    verdicts = {r.page_id: r.verdict for r in uf.report(df).collect()}
    assert [i for i, v in verdicts.items() if v == "block"] == [1, 4]
