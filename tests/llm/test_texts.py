"""Operators on single texts: personal data, secrets, languages, language-model scores, packing; and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from payrecon.llm import backoff_lm, langid, packing, sanitise, secrets
from tests.llm.edges import awkward, nothing, prose, table

# -- personal data -------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and sanitise.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ9.0@@-%+ 1(é", max_size=40))
def test_identifiers_are_those_of_the_patterns(text):
    assert [(sanitise.KINDS[k], s, e) for k, s, e, _ in sanitise.identifiers(text)] == base_pii(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000):
        sanitise.identifiers(text)


PII = ["Write to Ann.B+c@mail.example.com or a@b", "10.0.0.256 and 010.1.2.3.4.5.6.7", "card 4111 1111 1111 1111, 4111111111111112",
       "call +1 (462) 555-7216 now", "é🙂 x@y.zz é", "", None]


def test_pii_report_equals_the_patterns(spark):
    got = {r.doc_id: r for r in sanitise.report(table(spark, PII)).collect()}
    for i, text in enumerate(PII):
        spans = base_pii(text or "")
        line = ",".join("%s:%d:%d" % s for s in spans)
        assert got[i].spans == line and got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(Counter(s[0] for s in spans)[k] for k in sanitise.KINDS)


def test_terms_that_disclose_are_removed_and_common_ones_stay(spark):
    person = "jo@corp.example.com"
    texts = [f"{prose(i, 30)} zebracrossing {person} the {prose(i + 50, 30)}" for i in range(5)]
    texts += [f"{prose(i + 100, 40)} the {prose(i + 150, 10)}" for i in range(40)] + [f"{prose(7, 20)} once a{i}@b.cc {prose(8 + i, 9)}" for i in range(3)]
    docs = table(spark, texts)
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    for i in range(5):
        assert person not in clean[i] and "[EMAIL]" in clean[i] and "zebracrossing" not in clean[i] and " the " in clean[i]
    assert all(clean[i] == texts[i] for i in range(5, 45))
    report = {r.doc_id: r for r in sanitise.report(docs).collect()}
    assert all(report[i].n_terms >= 1 and "removed:" in report[i].spans for i in range(5)) and report[10].n_terms == 0


def test_pii_in_awkward_tables(spark):
    docs = awkward(spark)
    assert Counter(map(tuple, sanitise.sanitise(docs).collect())) == Counter(map(tuple, docs.collect()))
    assert sanitise.sanitise(docs).columns == docs.columns
    assert sanitise.report(docs).count() == docs.count()
    assert sanitise.report(nothing(spark)).collect() == []


# -- secrets -------------------------------------------------------------------------------------------------

SECRETS = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
           ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))


def base_secrets(text):
    out = []
    for rank, (kind, pattern) in enumerate(SECRETS):
        for m in pattern.finditer(text):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def random_text(rng):
    parts = ["password", "Token", "api_key", "=", ": ", '"', "'", " ", "secret", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef01234567", "é🙂", "abc", "\x01", "\x02", "\n", "Z" * 8]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(30)))


def test_secret_spans_equal_the_patterns(spark):
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(150)] + [None, "", "secret=token : abcdefg", "token= abcdef"]
    got = {r.doc_id: r for r in secrets.report(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        spans = base_secrets(text or "")
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(Counter(s[3] for s in spans)[k] for k in secrets.KINDS)
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (40, 48, 64) for _ in range(5)]
    plain = ["internationalisation_of_configuration_files", "Antidisestablishmentarianism", "the/path/of/some/long/directory/name", "a" * 40, "1234567890" * 4, "=" * 60]
    texts = [f"{prose(i, 20)} {k} {prose(i, 5)}" for i, k in enumerate(keys)] + [f"see {p} here" for p in plain] + [
        " ".join("".join(random.Random(i * 9 + j).choice(["the", "ing", "er", "and", "re", "tion"]) for j in range(9)) for _ in range(3)) for i in range(60)]
    got = {r.doc_id: r for r in secrets.report(table(spark, texts)).collect()}
    assert sum(got[i].n_random for i in range(len(keys))) >= 13
    assert all(got[i].n_random == 0 for i in range(len(keys), len(texts)))
    i = next(i for i in range(len(keys)) if got[i].n_random)
    _, s, e = next(x for x in got[i].spans.split(",") if x.startswith("random")).split(":")
    assert texts[i][int(s):int(e)] == keys[i]


@pytest.mark.parametrize("before", ["", "aws_session_access_key=", "config/production/session/", "a=b=", "https//host.example/v1/"])
def test_values_behind_names_and_paths_are_found(spark, before):
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(40)]
    texts = [f"{prose(i, 20)} {before}{k} {prose(i, 5)}" for i, k in enumerate(keys)] + [
        " ".join("".join(random.Random(i * 9 + j).choice(["the", "ing", "er", "and", "re", "tion"]) for j in range(9)) for _ in range(3)) for i in range(60)]
    texts += ["some_configuration_parameter_name=another_long_value_of_words", "the/path/of/some/exceptionally/longdirectorynamesinaplace"]
    found = 0
    for r in secrets.report(table(spark, texts)).collect():
        spans = [x.split(":")[1:] for x in r.spans.split(",") if x.startswith("random")]
        if r.doc_id < 40:
            found += any(texts[r.doc_id][int(s):int(e)].endswith(keys[r.doc_id]) for s, e in spans)
        else:
            assert not spans
    assert found >= 36


def test_secrets_in_awkward_tables(spark):
    got = secrets.report(awkward(spark)).collect()
    assert len(got) == awkward(spark).count() and all(r.n_hex == 0 for r in got)
    assert secrets.report(nothing(spark)).collect() == []


# -- languages -----------------------------------------------------------------------------------------------

def test_words_first_then_shorter_grams(spark):
    en = [(i, prose(i, 60)) for i in range(0, 60)]
    de = [(100 + i, prose(i, 60).replace("e", "ö").replace("s", "sch")) for i in range(60)]
    docs = table(spark, en, lang="en").union(table(spark, de, lang="de")).union(
        table(spark, [(900, "schöschöschö pölschö"), (901, None), (902, "12 34 !!"), (903, "日本語")], lang="xx").withColumn("lang", langid.F.lit(None).cast("string")))
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert all(got[i].lang_pred == "en" for i, _ in en) and all(got[i].lang_pred == "de" for i, _ in de)
    assert got[900].lang_pred == "de" and 0 < got[900].score <= 1
    assert (got[901].lang_pred, got[901].score) == ("und", 0.0) == (got[902].lang_pred, got[902].score)
    assert got[903].lang_pred in ("de", "en")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    for own in (docs, docs.withColumnRenamed("key", "lang_pred").withColumnRenamed("id", "_lang_score")):
        kept = langid.keep_identified(own)
        assert {901, 902} & {r.doc_id for r in kept.collect()} == set() and kept.columns == own.columns
        assert {r.score for r in kept.collect()} == {0.5}
    found = langid.identify(docs)
    assert sorted(found.columns) == sorted([*docs.columns, "lang_pred"]) and {r.doc_id: r.score for r in found.collect()} == {
        i: r.score for i, r in got.items()}


def brute_languages(rows):
    """{doc_id: (language, score)} from counts in dictionaries; grams of bytes with both ends marked."""
    lengths = (5, 4, 3, 2, 1)
    counts, totals = [{} for _ in range(6)], Counter()

    def grams(word, k):
        marked = ["^", *word.encode(), "^"]
        return [tuple(marked[i:i + k]) for i in range(len(marked) - k + 1)]

    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            for word in tokens(text):
                for level, keys in [(0, [word]), *[(k, grams(word, k)) for k in lengths]]:
                    for key in keys:
                        counts[level].setdefault(key, Counter())[lang] += 1
                        totals[lang, level] += 1
    counts[0] = {w: c for w, c in counts[0].items() if sum(c.values()) > 1}
    langs = sorted({lang for lang, _ in totals})

    def logs(level, key):
        return [math.log((counts[level][key][x] + 0.5) / (totals[x, level] + 0.5 * (len(counts[level]) + 1))) for x in langs]

    def of_word(word):
        if word in counts[0]:
            return logs(0, word)
        for k in lengths:
            known = [logs(k, g) for g in grams(word, k) if g in counts[k]]
            if known:
                return [sum(c) / len(known) for c in zip(*known)]
        return [0.0] * len(langs)

    out = {}
    for doc, text, _ in rows:
        own = [of_word(w) for w in tokens(text)]
        mean = [sum(c) / len(own) for c in zip(*own)] if own else [0.0] * len(langs)
        share = [math.exp(m - max(mean)) for m in mean]
        named = any(c.isalpha() for c in text or "")
        out[doc] = (langs[share.index(max(share))], max(share) / sum(share)) if named else ("und", 0.0)
    return out


def test_languages_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the of cat", "dog house x", "der die katze", "hund haus", "le chat maison"]) for _ in range(rng.randrange(1, 9)))
             + rng.choice(["", " zzz", " houses", " katzen qq"]), rng.choice(["en", "de", "fr", None])) for i in range(80)]
    rows += [(80, None, "en"), (81, "", "de"), (82, "12 !!", "en"), (83, "unseen words only", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute_languages(rows)
    for r in langid.report(docs).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-5


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = table(spark, [(i, prose(i, 50)) for i in range(40)], lang="en")
    held = langid.F.when(langid.held_out(), "zz").otherwise(langid.F.col("lang"))
    assert {r.lang_pred for r in langid.report(docs.withColumn("lang", held)).collect()} == {"en"}


def test_languages_of_awkward_tables(spark):
    assert langid.report(awkward(spark)).count() == awkward(spark).count()
    assert langid.report(nothing(spark)).collect() == []
    unlabelled = awkward(spark).withColumn("lang", langid.F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.report(unlabelled).collect()} == {("und", 0.0)}


# -- language-model scores -----------------------------------------------------------------------------------

def tokens(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9_\u0080-\U0010ffff]+", text or "")]


def brute_score(texts):
    grams = lambda w: Counter(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    own = [grams(tokens(t)) for t in texts]
    total = sum(own, Counter())
    n = sum(len(tokens(t)) for t in texts)
    for t, mine in zip(texts, own):
        w, s = tokens(t), 0.0
        for j in range(len(w)):
            for k in range(min(3, j + 1), 0, -1):
                g = tuple(w[j - k + 1:j + 1])
                c = total[g] - mine[g]
                if k == 1:
                    s += math.log((c or 0.5) / max(1, n - len(w)))
                elif c:
                    s += math.log(c / (total[g[:-1]] - mine[g[:-1]]))
                    break
                else:
                    s += math.log(0.4)
        yield s if w else None


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_scores_equal_brute_force(spark, chunk_bytes):
    texts = [prose(i % 9, 20 + i) for i in range(40)] + [None, "", "one", "one two", "word " * 400, "Zz"]
    got = {r.doc_id: r for r in backoff_lm.scores(table(spark, texts), chunk_bytes).collect()}
    for i, want in enumerate(brute_score(texts)):
        assert got[i].log_score == pytest.approx(want) if want is not None else got[i].log_score is None
        assert got[i].n_words == len(tokens(texts[i])) == sum(got[i][f"n_order{k}"] for k in range(4))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**56 - 1), max_size=40), st.lists(st.integers(1, 2**40), max_size=40))
def test_lists_survive_packing(hashes, counts):
    h = np.unique(np.array(hashes, dtype=np.uint64))
    if len(h):
        assert np.array_equal(backoff_lm.unpack_sorted(backoff_lm.pack_sorted(h)), h)
    c = np.array(counts, dtype=np.int64)
    assert np.array_equal(backoff_lm.expand(backoff_lm.squeeze(c)), c)


def test_scores_of_awkward_tables(spark):
    got = backoff_lm.scores(awkward(spark)).collect()
    assert len(got) == awkward(spark).count() and all((r.n_words == 0) == (r.log_score is None) for r in got)
    assert backoff_lm.scores(nothing(spark)).collect() == []


# -- packing -------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 3, 50, 3000, 70_001]), min_size=1, max_size=40), st.booleans(), st.integers(0, 99))
def test_every_window_has_its_mixture(totals, targeted, seed):
    rng = random.Random(seed)
    m = packing.Mixture(totals, 64, [rng.random() for _ in totals] if targeted else None)
    if not m.phases:
        assert sum(totals) == 0
        return
    windows = m.phases[-1].first + m.phases[-1].count
    before = [0] * len(totals)
    for w in range(1, windows + 1):
        now = m.at(w)
        phase = [p for p in m.phases if p.first < w][-1]
        assert all(a >= b for a, b in zip(now, before)) and (w == windows or sum(now) == w * m.window)
        if w < windows:
            leader = max(range(len(totals)), key=phase.weights.__getitem__)
            for i, (n, weight) in enumerate(zip(now, phase.weights)):
                earned = phase.before[i] + (w - phase.first) * m.window * weight / sum(phase.weights)
                assert -1e-6 <= earned - n < 1 + 1e-6 or i == leader and 0 <= n - earned + 1e-6 < len(totals) + 1
        before = now
    assert before == totals


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for x in texts]


@pytest.mark.parametrize("targets", [None, {"a": 1.0, None: 3.0}])
def test_pieces_hold_every_token_once(spark, targets):
    texts = [prose(i, 5 + 40 * (i % 7)) for i in range(40)] + [None, "", "日本 🙂 <|endoftext|> don't  x\n\n", "a" * 3000]
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>  ", "x  <|endoftext|>\n", "<|endoftext", " <|endoftext|>  y"]
    docs = table(spark, [(i, t) for i, t in enumerate(texts[:20])], source="a").union(
        table(spark, [(20 + i, t) for i, t in enumerate(texts[20:30])], source="b")).union(
        table(spark, [(30 + i, t) for i, t in enumerate(texts[30:])], source=None)).repartition(3)
    pieces = packing.pack(docs, 128, targets).collect()
    whole = ids_of(texts)
    for i, ids in enumerate(whole):
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]] and sum(r.length for r in rows) <= 128
    total = sum(map(len, whole))
    assert len(sequences) <= -(-total // 128) + 1


def test_packing_of_awkward_tables(spark):
    pieces = packing.pack(awkward(spark)).collect()
    assert sum(r.length for r in pieces) == sum(len(x) for x in ids_of([r.text for r in awkward(spark).collect()]))
    assert packing.pack(nothing(spark)).collect() == []


# -- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    leak = prose(60, 25)
    texts = [prose(i, 90) for i in range(20)] + [prose(3, 90), prose(4, 89) + " other", "12 34", None, prose(70, 50) + " " + leak + " " + prose(71, 50), "Mail jo@corp.example.com " + prose(72, 40)]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        left.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert left[0] == set(range(26)) - {22, 23} and left[1] == left[0] - {20, 21} and left[2] == left[1] - {24} == left[3]
    text = {r.doc_id: r.text for r in kept.collect()}
    assert "jo@corp" not in text[25] and all(text[i] == texts[i] for i in range(20))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[3]


def test_disclosing_terms_are_rewritten_in_whole_texts_and_in_all_texts(spark):
    near = "mail ann@example.com about Zanzibar " + prose(1, 3)
    texts = [f"{near} {prose(10 + i, 20)} and Zanzibar again {i}" for i in range(12)] + [prose(50, 12) + " é Zanzibar " + prose(51, 5)]
    texts += [prose(100 + i, 30) for i in range(200)]
    docs = table(spark, texts)
    kept = {r.doc_id: r.text for r in sanitise.sanitise(docs, generalise_at=0.5).collect()}
    assert all("Zanzibar" not in t for t in kept.values())
    assert " é " in kept[12] and len(kept) == len(texts)
    spans = {r.doc_id: r for r in sanitise.report(docs, generalise_at=0.5).collect()}
    assert spans[12].n_terms >= 1 and spans[12].n_email == 0 and spans[0].n_email == 1
