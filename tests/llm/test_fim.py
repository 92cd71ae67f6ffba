"""Fill-in-the-middle: piece tables against strings, outputs and restored texts against a plain version."""

import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from payrecon.llm import fim
from tests.llm.edges import awkward, nothing, prose, table

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(b"1:" + (str(doc_id) if doc_id is not None else "").encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = fim.report(df).collect()
    want = []
    for doc, text in rows:
        n, form, p, m, out = plainly(doc, text)
        want.append((doc, n, form, p, m, sha(out), sha(text or "")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_report_equals_the_plain_version(spark):
    texts = [prose(i, i % 60) for i in range(120)] + ["a<P>b", "x<S>", "<M>", "<P", "S>", "<", "a<P" * 9, "é🙂日本 abc é", "A1b2", "\n\n", "zz"]
    check(table(spark, texts))


def test_awkward_and_empty_tables(spark):
    check(awkward(spark))
    assert fim.report(nothing(spark)).collect() == []
    assert {r.form for r in fim.report(table(spark, [prose(1, 30)] * 300)).select("form").collect()} == {"plain", "psm", "spm"}


def test_pieces_render_to_the_output(spark):
    df = table(spark, [prose(i, i % 40) + "é🙂<" for i in range(60)] + [None, ""])
    rows = fim.transform(df).withColumn("out", fim.rendered(F.col("text"), F.col("pieces"))).collect()
    for r in rows:
        assert r.out == plainly(r.doc_id, r.text)[-1]
        pieces = fim.located(r.out.encode(), r.form)
        assert b"".join(fim.stream(r.out.encode(), fim.restore(pieces, r.form))).decode() == (r.text or "")
        assert sum(p.length for p in r.pieces if p.buffer == fim.TEXT) == len((r.text or "").encode())


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<PSM>aé", max_size=30), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_cut_arrange_locate_restore(text, x, y, form):
    data = text.encode()
    places = sorted((min(x, len(data)), min(y, len(data))))
    whole = [(fim.TEXT, 0, len(data))] if data else []
    parts = fim.cut(whole, places)
    assert [b"".join(fim.stream(data, p)) for p in parts] == [data[:places[0]], data[places[0]:places[1]], data[places[1]:]]
    pieces = fim.arrange(parts, form)
    assert fim.restore(pieces, form) == whole
    if not any(m in text for m in ("<P>", "<S>", "<M>")):
        out = b"".join(fim.stream(data, pieces))
        assert b"".join(fim.stream(out, fim.restore(fim.located(out, form), form))) == data


def test_cutting_pieces_again():
    pieces = [(fim.TEXT, 5, 4), (fim.SENTINELS, 0, 3), (fim.TEXT, 0, 5)]
    assert fim.cut(pieces, [4, 8]) == [[(0, 5, 4)], [(1, 0, 3), (0, 0, 1)], [(0, 1, 4)]]
    assert fim.cut([], [0, 0]) == [[], [], []] and fim.restore(pieces, "plain") == pieces
