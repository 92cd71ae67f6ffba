"""Secret scan: patterns, and a battery of randomness tests with length-aware false-discovery control. SQL functions only.

Patterns give the base spans. The method then looks at every run of 20 or more characters that could be an encoded
value, equals signs ending it, so that names are not taken for a part of their values, and at every segment of 20 or more of a run with
slashes, besides the whole run; a segment inside a run that is found is not listed again. For each distinct run the encoding is inferred (digits, hex, base32, one-case letters, letters and digits,
base64), which gives the alphabet size K, and with n characters the battery is

* chi-squared uniformity over the alphabet, with the exact mean and variance of a uniform multinomial,
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* serial correlation of neighbouring characters.

A run is kept as possibly random if none of the three rejects randomness. Whether it is a discovery is decided against
the other hypothesis, ordinary text: the corpus's own index of coincidence and rate of changes between character classes
(measured over its letter-only runs) say which chi-squared value and how many class changes a text of that length would
have. The two p-values are combined (Fisher), and Benjamini-Hochberg is applied in strata of length, over distinct runs,
so short runs, for which the tests have little power, are held to what their own length can show. Runs of digits alone go through
the tests but are never discoveries: other numbers are as uniform and have no class changes, so nothing tells a secret from them.

The positions come from marking matches with control characters and adding up the pieces' lengths, as SQL has no function
that lists match positions; those two characters are first replaced in the text by a third one of the same length, which
no pattern matches.

Defined results: null and empty texts have no spans; repeated documents are scanned one by one; ties in start go to the
kind listed first; extra columns are not read; an empty table gives no rows. A null id is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from payrecon.llm.common import staged

KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run's failing prefix cannot hold a longer run, so the minimum length may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_RUN = 20
#: Whole runs, tried from their start only, so that a word costs one try and not one for each of its letters.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % MIN_RUN
#: Encodings in the order they are tried: pattern of the whole run (without padding) and alphabet in its order.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("letters", r"^([a-z]+|[A-Z]?[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("alphanumeric", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)
PROSE_COINCIDENCE = 0.066
STEPS_PER_DECADE, LAST_STEP = 10, 400
SPAN = "struct<start:int,end:int,match:string>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches, in code points."""
    odd = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))
    text = F.when(odd, F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    marked = F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01", -1)

    def add(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, "\x02", 1)
        found = F.struct(acc["pos"].alias("start"), (acc["pos"] + F.length(match)).alias("end"), match.alias("match"))
        return F.struct((acc["pos"] + F.length(piece) - 1).alias("pos"), F.concat(acc["found"], F.array(found)).alias("found"))

    def fold(pieces: Column) -> Column:
        first = F.struct(F.length(F.element_at(pieces, 1)).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("found"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), first, add, lambda acc: acc["found"])

    # Through an array of one element, so that the pieces are made once though they are used three times.
    return F.element_at(F.transform(F.array(marked), fold), 1)


def _with_segments(runs: Column) -> Column:
    """Runs, each followed by its segments between slashes that are long enough."""

    def segments(m: Column) -> Column:
        def add(acc: Column, piece: Column) -> Column:
            own = F.struct(acc["pos"].alias("start"), (acc["pos"] + F.length(piece)).alias("end"), piece.alias("match"))
            return F.struct((acc["pos"] + F.length(piece) + 1).alias("pos"), F.concat(acc["found"], F.array(own)).alias("found"))

        first = F.struct(m["start"].alias("pos"), F.array().cast(f"array<{SPAN}>").alias("found"))
        found = F.aggregate(F.split(m["match"], "/"), first, add, lambda acc: acc["found"])
        return F.filter(found, lambda piece: F.length(piece["match"]) >= MIN_RUN)

    return F.flatten(F.transform(runs, lambda m: F.when(
        F.contains(m["match"], F.lit("/")), F.concat(F.array(m), segments(m))).otherwise(F.array(m))))


def _normal(z: Column) -> Column:
    """Distribution function of the normal law (Zelen and Severo's polynomial, error below 1e-7), never below 1e-40."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z > 0, 1 - upper).otherwise(upper), F.lit(1e-40))


def battery(runs: DataFrame) -> DataFrame:
    """Test statistics and p-values of randomness of each distinct ``token``."""
    body = F.regexp_replace("token", "=+$", "")
    kind = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        kind = F.when(F.col("body").rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(kind)
    folded = F.when(F.col("kind") <= 3, F.lower("body")).otherwise(F.col("body"))
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("kind") + 1)
    df = runs.withColumn("body", body).where(F.length("body") >= MIN_RUN).withColumn("kind", kind).withColumn(
        "alphabet", alphabet).withColumn("body", folded).withColumn("n", F.length("body").cast("double")).withColumn(
        "k", F.length("alphabet").cast("double"))
    letters = F.split("alphabet", "")
    counts = F.transform(letters, lambda c: (F.col("n") - F.length(F.replace(F.col("body"), c, F.lit("")))))
    codes = F.transform(F.split("body", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    df = df.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)).withColumn("codes", codes)
    pairs = F.arrays_zip(F.slice("codes", 1, F.size("codes") - 1).alias("a"), F.slice("codes", 2, F.size("codes") - 1).alias("b"))
    mean = F.aggregate("codes", F.lit(0.0), lambda a, c: a + c) / F.col("n")
    df = df.withColumn("pairs", pairs).withColumn("mean", mean)
    mid = (F.col("k") + 1) / 2
    df = df.withColumn(
        "above", F.aggregate("codes", F.lit(0.0), lambda a, c: a + (c > mid).cast("double"))).withColumn(
        "runs", F.aggregate("pairs", F.lit(1.0), lambda a, p: a + ((p["a"] > mid) != (p["b"] > mid)).cast("double"))).withColumn(
        "spread", F.aggregate("codes", F.lit(0.0), lambda a, c: a + (c - F.col("mean")) ** 2)).withColumn(
        "lagged", F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean"))))
    n, k = F.col("n"), F.col("k")
    chi = k * F.col("squares") / n - n
    below = n - F.col("above")
    both = 2 * F.col("above") * below
    runs_mean, runs_var = both / n + 1, both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(runs_var > 0, (F.col("runs") - runs_mean) / F.sqrt(runs_var)).otherwise(F.lit(40.0))
    serial = F.when(F.col("spread") > 0, F.col("lagged") / F.col("spread")).otherwise(F.lit(1.0))
    two_sided = lambda z: 2 * _normal(-F.abs(z))
    cls = F.translate(F.regexp_replace("token", "=+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "A" * 26 + "0" * 10 + "....")
    cls = F.regexp_replace(cls, "[a-z]", "a")
    changes = F.length(F.regexp_replace(cls, r"(.)\1*", "x")) - 1
    return df.select(
        "token", "kind", "n", "k", chi.alias("chi"), changes.cast("double").alias("changes"),
        (F.col("squares") - n) .alias("coincidences"),
        _normal(-(chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("p_uniform"),
        two_sided(z_runs).alias("p_runs"), two_sided((serial + 1 / n) * F.sqrt(n)).alias("p_serial"))


def discoveries(runs: DataFrame, q: float = 0.01, level: float = 0.001) -> DataFrame:
    """Distinct runs that look random and are discoveries at rate ``q`` in their stratum of length."""
    tested = staged(battery(runs), "secret-tests")
    # Two numbers of the whole corpus reach the driver, and later one threshold per stratum (16 at most).
    prose = tested.where("kind = 2").agg(
        (F.sum("coincidences") / F.sum(F.col("n") * (F.col("n") - 1))).alias("ic"),
        (F.sum("changes") / F.sum(F.col("n") - 1)).alias("rate")).first()
    ic = prose["ic"] or PROSE_COINCIDENCE
    rate = min(0.5, max(prose["rate"] or 0.0, 0.02))
    n, k = F.col("n"), F.col("k")
    excess = F.greatest(k * ic - 1, F.lit(0.0))
    p_chi = _normal((F.col("chi") - (k - 1) - n * excess) / F.sqrt(2 * (k - 1) + 4 * n * excess))
    p_changes = _normal(-(F.col("changes") - 0.5 - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate)))
    half = -(F.log(p_chi) + F.log(p_changes))  # Fisher: chi-squared of four degrees, whose tail has this closed form
    p_text = F.exp(-half) * (1 + half)
    step = F.least(F.floor(-F.log10(F.greatest(p_text, F.lit(1e-40))) * STEPS_PER_DECADE), F.lit(LAST_STEP)).cast("int")
    stratum = F.least(F.floor(F.log2(n / MIN_RUN) * 4), F.lit(15)).cast("int")
    judged = tested.withColumns({
        "step": step, "stratum": stratum,
        "random": (F.col("p_uniform") >= level) & (F.col("p_runs") >= level) & (F.col("p_serial") >= level) & (F.col("kind") != 0)})
    bins = judged.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("stratum").orderBy(F.desc("step"))
    ranked = bins.withColumn("rank", F.sum("c").over(down)).withColumn("all", F.sum("c").over(Window.partitionBy("stratum")))
    limits = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS_PER_DECADE) <= q * F.col("rank") / F.col("all")).groupBy(
        "stratum").agg(F.min("step").alias("least")).collect()
    if not limits:
        return judged.where(F.lit(False)).select("token")
    least = F.create_map(*[F.lit(int(x)) for row in limits for x in row])
    return judged.where(F.col("random") & (F.col("step") >= least[F.col("stratum")])).select("token")


def scan(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """(doc_id, base, extra): arrays of (start, end, kind) of every document, base ones and those of the battery."""
    text = F.coalesce("text", F.lit(""))

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    nothing = F.array().cast(f"array<{SPAN}>")
    found = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)
    # An assignment holds a colon or an equals sign, and the other two patterns match inside runs only.
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), found).otherwise(nothing)
    inside = F.size("runs") > 0
    access, digits = (F.when(inside, _matches(text, p)).otherwise(nothing) for p in (ACCESS, HEX))
    base = F.array_sort(F.concat(of(0, assign), of(1, access), of(2, digits)))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), _matches(text, RUN).alias("runs"))
    first = staged(rows.select("doc_id", "row", base.alias("base"), "runs"), "secret-runs")
    each = first.select("row", F.explode(_with_segments(F.col("runs"))).alias("m")).select("row", "m.start", "m.end", F.col("m.match").alias("token"))
    random = discoveries(each.select("token").distinct(), q)
    extra = each.join(random, "token").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("extra"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return first.join(extra, "row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def report(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    named = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("rank"),
                                                   F.element_at(names, s["kind"] + 1).alias("kind")))
    # A random run that a base span or a longer random run already covers is not listed again.
    new = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"]))
                   & ~F.exists("extra", lambda o: (o["start"] <= e["start"]) & (o["end"] >= e["end"]) & (o["end"] - o["start"] > e["end"] - e["start"])))
    extra = F.transform(new, lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), F.lit(len(KINDS)).alias("rank"), F.lit("random").alias("kind")))
    key = lambda a, b: F.when(F.struct(a["start"], a["rank"], a["end"]) < F.struct(b["start"], b["rank"], b["end"]), -1).otherwise(1)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    df = scan(docs, q).withColumn("named", F.array_sort(named, key))
    return df.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(line(F.col("named")), 256).alias("base_sha256"),
        line(F.array_sort(F.concat("named", extra), key)).alias("spans"), F.size(new).cast("long").alias("n_random"))
