import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tests.payments import DAY, build, linked, view

from payrecon.operators import reconcile as rc
from payrecon.plans.options import QueryOptions

PAY = {"order": 1, "pay": "p1", "status": "Approved", "rrn": "R", "auth": "A"}


def match(spark, bank, pay=PAY, **kw):
    options = QueryOptions(**kw)
    tx = spark.createDataFrame(
        [(pay["rrn"], pay["auth"], Decimal("100.00"), DAY)],
        "final_rrn string, final_authorization_code string, amount decimal(18,2), transaction_date date")
    df = rc.reconcile(tx, build(spark, bank=bank)["bank"], options.tiers(), options.blank_keys_match)
    return sorted((r["bank_match_type"] for r in df.collect()), key=str)


def short(label):
    return next((i + 1 for i, t in enumerate(rc.TIERS) if t.label == label), None)


@pytest.mark.parametrize("bank, tier", [
    ({"auth": "A", "rrn": "R", "transaction_amount": Decimal("100.01")}, 1),
    ({"auth": "x", "rrn": "R", "transaction_amount": Decimal("99.99")}, 2),
    ({"auth": "A", "rrn": "x", "transaction_amount": Decimal("100.01")}, 3),
    ({"auth": "A", "rrn": None, "transaction_amount": Decimal("100.01")}, 3),
    ({"auth": "A", "rrn": "R", "transaction_amount": Decimal("101.00")}, 5),
    ({"auth": None, "rrn": "R", "transaction_amount": Decimal("99.00")}, 5),
    ({"auth": "A", "rrn": "x", "transaction_amount": Decimal("101.00")}, 6),
    ({"auth": "A", "rrn": "R", "transaction_amount": Decimal("101.01")}, None),
    ({"auth": "A", "rrn": "R", "transaction_amount": Decimal("98.99")}, None),
    ({"auth": "A", "rrn": "R", "transaction_amount": None}, None),
    ({"auth": "x", "rrn": "x"}, None),
    ({"auth": None, "rrn": None}, None),
])
def test_tiers(spark, bank, tier):
    assert [short(m) for m in match(spark, [bank])] == [tier]


def test_same_day_tiers_need_the_plain_ones_off(spark):
    bank = [{"auth": "A", "rrn": "x"}, {"auth": "A", "rrn": "x", "transaction_amount": Decimal("100.50")},
            {"auth": "A", "rrn": "x", "transaction_date": DAY.replace(day=6)}]
    assert [short(m) for m in match(spark, bank)] == [3, 3, 6]
    assert [short(m) for m in match(spark, bank, auth_only_match=False)] == [4, 7]
    assert [short(m) for m in match(spark, bank, auth_only_match=False, date_match=False)] == [None]
    assert [short(m) for m in match(spark, bank, exact_match=False)] == [6, 6, 6]


def test_fan_out_and_blank_keys(spark):
    assert len(match(spark, [{"auth": "A", "rrn": "R"}] * 3)) == 3
    blank = {**PAY, "auth": "", "rrn": None}
    assert [short(m) for m in match(spark, [{"auth": "", "rrn": "x"}], blank)] == [3]
    assert [short(m) for m in match(spark, [{"auth": "", "rrn": "x"}], blank, blank_keys_match=False)] == [None]


def test_custom_tolerances(spark):
    bank = [{"auth": "A", "rrn": "R", "transaction_amount": Decimal("104.00")}]
    assert [short(m) for m in match(spark, bank, approx_tolerance=Decimal("4.00"))] == [5]
    assert [short(m) for m in match(spark, bank, exact_tolerance=Decimal("4"), approx_tolerance=Decimal("4"))] == [1]
    zero = dict(exact_tolerance=Decimal("0"), approx_match=False)
    assert [short(m) for m in match(spark, [{"auth": "A", "rrn": "R"}], **zero)] == [1]
    assert [short(m) for m in match(spark, [{"auth": "A", "rrn": "R", "transaction_amount": Decimal("100.01")}], **zero)] == [None]


def test_no_tier_at_all_keeps_the_transaction(spark):
    assert match(spark, [{"auth": "A", "rrn": "R"}], exact_match=False, approx_match=False) == [None]


def test_unreachable_tiers_are_skipped():
    assert [t.label for t in rc.reachable(rc.TIERS)] == [rc.TIERS[i].label for i in (0, 1, 2, 4, 5)]
    assert rc.signature_columns(rc.TIERS)[0] == ["final_rrn", "final_authorization_code", "amount"]


def _rows(rng, n, names):
    out = []
    for _ in range(n):
        keys = [rng.choice(["", "k1", "k2", "k3", None]) for _ in range(2)]
        amount = None if rng.random() < 0.05 else Decimal(rng.randint(-300, 300)) / 100
        out.append((*keys, amount, DAY.replace(day=rng.randint(1, 3))))
    return out


@pytest.mark.parametrize("chosen, blank", [
    (range(7), True), (range(7), False), ((1, 4), True), ((2, 3, 5, 6), True), ((0, 3, 6), False), ((0,), True), ((3, 4), True)])
def test_against_brute_force(spark, chosen, blank):
    rng = random.Random(str(chosen))
    tx, bank = _rows(rng, 150, "t"), _rows(rng, 120, "b")
    tx += tx[:20]
    tiers = [rc.TIERS[i] for i in chosen]

    def label(t, b):
        ok = lambda x, y: x is not None and x == y and (blank or x != "")
        if t[2] is None or b[2] is None:
            return None
        for tier in tiers:
            if (abs(t[2] - b[2]) <= tier.tolerance and (not tier.rrn or ok(t[0], b[0])) and (not tier.auth or ok(t[1], b[1]))
                    and (not tier.same_day or t[3] == b[3])):
                return tier.label
        return None

    want = []
    for t in tx:
        hits = [(*t, b[0], b[1], b[2], label(t, b)) for b in bank if label(t, b)]
        want += hits or [(*t, None, None, None, None)]

    tx_df = spark.createDataFrame(tx, "final_rrn string, final_authorization_code string, amount decimal(18,2), transaction_date date")
    bank_df = build(spark, bank=[])["bank"].unionByName(spark.createDataFrame(
        bank, "rrn string, authorization_code string, transaction_amount decimal(18,2), transaction_date date"),
        allowMissingColumns=True)
    got = rc.reconcile(tx_df, bank_df, tiers, blank).select(*tx_df.columns, "bank_rrn", "bank_auth_code", "bank_amount", rc.MATCH_TYPE)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

    sums = {}
    for row in want:
        n, total = sums.get((row[0] or "none", row[-1]), (0, None))
        sums[row[0] or "none", row[-1]] = (n + 1, total if row[2] is None else (total or 0) + row[2])
    by = tx_df.withColumn("gateway_source", F.coalesce(F.nullif("final_rrn", F.lit("")), F.lit("none")))
    for frame in (rc.tier_counts(by, bank_df, tiers, blank), rc.match_summary(rc.reconcile(by, bank_df, tiers, blank))):
        assert {(r["gateway_source"], r[rc.MATCH_TYPE]): (r["n_rows"], r["total_amount"]) for r in frame.collect()} == sums
    got = {r[rc.MATCH_TYPE]: r["n_rows"] for r in rc.tier_counts(by, bank_df, tiers, blank, by=()).collect()}
    assert got == {label: sum(n for (_, x), (n, _) in sums.items() if x == label) for _, label in sums}


def test_summary(spark):
    df = view(spark, checkout_v1=[PAY], bank=[{"auth": "A", "rrn": "R"}, {"auth": "x", "rrn": "R"}], **linked(1))
    got = {(r["bank_match_type"], r["n_rows"]) for r in rc.match_summary(df).collect()}
    assert got == {(rc.TIERS[0].label, 1), (rc.TIERS[1].label, 1)}


def test_summary_of_blank_keys_makes_no_product(spark):
    """2,000 signatures and 3,000 lines without keys: six million pairs are counted, and the groups that meet are few."""
    tx = spark.range(2000).select(
        F.lit("g").alias("gateway_source"), F.lit("").alias("final_rrn"), F.concat(F.lit("a"), "id").alias("final_authorization_code"),
        (F.lit("10.00").cast("decimal(18,2)") + (F.col("id") % 2) * F.lit(Decimal("0.50"))).cast("decimal(18,2)").alias("amount"))
    lines = spark.range(3000).select(F.lit("").alias("rrn"), F.concat(F.lit("b"), "id").alias("authorization_code"),
                                     F.lit("10.00").cast("decimal(18,2)").alias("transaction_amount"))
    bank = build(spark, bank=[])["bank"].unionByName(lines, allowMissingColumns=True)
    stages = {}
    real = rc.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rc, "staged", lambda df, name: stages.setdefault(name, real(df, name)))
        got = {r[rc.MATCH_TYPE]: (r["n_rows"], r["total_amount"]) for r in rc.tier_counts(tx, bank).collect()}
    assert got == {rc.TIERS[1].label: (3_000_000, Decimal("30000000.00")), rc.TIERS[4].label: (3_000_000, Decimal("31500000.00"))}
    assert set(stages) == {"signatures", "met"} and stages["met"].count() == 2


def test_stages_hold_narrow_columns_only(spark):
    """A query of five columns stages signatures and pairs of signatures, and reads few columns of the tables."""
    from payrecon.plans.query import payment_query
    stages = []
    real = rc.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rc, "staged", lambda df, name: stages.append((name, df.columns)) or real(df, name))
        tables = build(spark, checkout_v1=[PAY], bank=[{"auth": "A", "rrn": "R"}], **linked(1))
        names = ["gateway_order_id", "amount", "portal_chef_name", "bank_bank_name", "bank_match_type"]
        df = payment_query(tables, names)
        assert df.columns[:5] and df.count() == 1
    assert [n for n, _ in stages] == ["signatures", "pairs"] and all(len(c) < 10 for _, c in stages)


def test_plan_has_no_quadratic_join_and_no_python(spark):
    import contextlib
    import io

    from payrecon.plans.payment_view import payment_view
    from standin import payment_tables

    df = payment_view(payment_tables(spark, "/root/testdata/sf0.001"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    plan = out.getvalue()
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Window"):
        assert word not in plan
    assert "SortMergeJoin" in plan or "HashJoin" in plan


def test_hot_key_is_split_at_run_time(spark):
    """One signature holds most transactions: the join that attaches the pairs splits it over several tasks."""
    n = 60000
    tx = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 4 != 0, "").otherwise(F.col("id").cast("string")).alias("final_rrn"), F.lit("").alias("final_authorization_code"),
        F.lit("10.00").cast("decimal(18,2)").alias("amount"), F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    bank = build(spark, bank=[{"auth": "q", "rrn": "", "transaction_amount": Decimal("10.00")}])["bank"]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500k"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = rc.reconcile(tx, bank)
        rows = df.groupBy(F.spark_partition_id().alias("p"), rc.MATCH_TYPE).agg(
            F.count(F.lit(1)).alias("n"), F.min("payload")).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["n"] for r in rows) == n
    hot = [r for r in rows if r[rc.MATCH_TYPE] is not None]
    assert sum(r["n"] for r in hot) == n * 3 // 4 and len(hot) > 1


def test_hot_bank_line_is_split_at_run_time(spark):
    """One signature meets most bank lines: their join is split over several tasks as well."""
    n = 60000
    tx = spark.createDataFrame([("", "", Decimal("10.00"), "t"), ("x", "y", Decimal("1.00"), "u")],
                               "final_rrn string, final_authorization_code string, amount decimal(18,2), k string")
    lines = spark.range(n, numPartitions=8).select(
        F.lit("").alias("rrn"), F.lit("").alias("authorization_code"), F.lit("10.00").cast("decimal(18,2)").alias("transaction_amount"),
        F.sha2(F.col("id").cast("string"), 512).alias("transaction_link_url"))
    bank = build(spark, bank=[])["bank"].unionByName(lines, allowMissingColumns=True)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500k"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = rc.reconcile(tx, bank).groupBy(F.spark_partition_id().alias("p"), "k").agg(
            F.count(F.lit(1)).alias("n"), F.min("bank_transaction_link_url")).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["n"] for r in rows if r["k"] == "t") == n and sum(r["n"] for r in rows if r["k"] == "u") == 1
    assert len([r for r in rows if r["k"] == "t"]) > 1


def blank_sides(spark, n, m):
    """Transactions and lines without codes at one amount: every pair matches. One more transaction meets nothing."""
    tx = spark.range(n + 1).select(
        F.lit("").alias("final_rrn"), F.concat(F.lit("a"), "id").alias("final_authorization_code"),
        F.when(F.col("id") < n, 10).otherwise(99).cast("decimal(18,2)").alias("amount"), F.col("id").alias("k"))
    lines = spark.range(m).select(F.lit("").alias("rrn"), F.concat(F.lit("b"), "id").alias("authorization_code"),
                                  F.lit("10.00").cast("decimal(18,2)").alias("transaction_amount"))
    return tx, build(spark, bank=[])["bank"].unionByName(lines, allowMissingColumns=True)


def test_pairs_are_not_staged_and_large_groups_are_cut(spark):
    """Staged frames have a row per signature, whatever the pairs; a group cut into blocks gives every pair once."""
    tx, bank = blank_sides(spark, 40, 50)
    sizes = []
    real = rc.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rc, "staged", lambda df, name: sizes.append(real(df, name)) or sizes[-1])
        patch.setattr(rc, "BLOCK", 8)
        rows = rc.reconcile(tx, bank).select("k", "bank_auth_code", rc.MATCH_TYPE).collect()
    assert [df.count() for df in sizes] == [41, 41]
    label = rc.TIERS[1].label
    want = [(k, f"b{i}", label) for k in range(40) for i in range(50)] + [(40, None, None)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_unmatched_rows_need_no_pairs(spark):
    import contextlib
    import io

    tx, bank = blank_sides(spark, 3, 3)
    df = rc.reconcile(tx, bank)
    for null, wanted in ((True, 1), (False, 9)):
        part = df.where(F.col(rc.MATCH_TYPE).isNull() if null else F.col(rc.MATCH_TYPE).isNotNull())
        with contextlib.redirect_stdout(io.StringIO()) as out:
            part.explain("simple")
        assert part.count() == wanted and ("Generate explode" in out.getvalue()) == (not null)


def test_derived_columns_are_those_of_the_transaction(spark):
    """Columns derived inside are the columns derived from the result: of pairs, of large groups and of unmatched rows."""
    def derive(df):
        return df.withColumn("twice", F.concat("final_authorization_code", F.lit("/"), "final_authorization_code"))

    tx, bank = blank_sides(spark, 6, 7)
    tx = tx.unionByName(tx.where("k = 1").withColumn("final_authorization_code", F.lit(None).cast("string")))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rc, "BLOCK", 4)
        got, want = rc.reconcile(tx, bank, derive=derive), rc.reconcile(tx, bank)
        names = [*tx.columns, "twice", *rc.BANK_COLUMNS, rc.MATCH_TYPE]
        assert got.columns == names
        rows = [sorted(map(tuple, df.select(*names).collect()), key=str) for df in (got, derive(want))]
    assert rows[0] == rows[1] and len(rows[0]) == 7 * 7 + 1
    none = [rc.reconcile(tx, bank, (), derive=derive).select(*names), derive(rc.reconcile(tx, bank, ())).select(*names)]
    assert sorted(map(tuple, none[0].collect()), key=str) == sorted(map(tuple, none[1].collect()), key=str)


def test_pairs_copy_a_transaction_as_one_field(spark):
    """Per pair nothing is derived from the transaction, and its rows are sorted by a hash first."""
    import contextlib
    import io

    from payrecon.plans.payment_view import payment_view
    from payrecon.plans.query import payment_query

    def top(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("simple")
        lines = out.getvalue().splitlines()
        at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "_bank_i" in line)
        return lines[at - 1], lines[at]

    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        tables = build(spark, checkout_v1=[PAY], bank=[{"auth": "A", "rrn": "R"}], **linked(1))
        project, join = top(payment_view(tables))
        assert "SortMergeJoin [_cell" in join
        assert "_tx" in project and "= checkout_v1" not in project and "= tamara" not in project
        project, _ = top(payment_query(tables, ["amount", "checkout_v1_payment_id", "bank_rrn"]))
        assert "_tx#" not in project and "= checkout_v1" not in project
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)


@pytest.mark.parametrize("n, k, most_blocks, most_pairs", [
    (3_000, 1_500, 80, 70_000),            # a group at sf0.1: tasks share its pairs
    (1_080_000, 540_000, 4_300, 1.5e8),    # the same at 360 times: its rows go to some dozens of blocks each
    (2_000, 500, 1, 1e6), (5_000_000, 1, 80, 70_000), (3, 2_000_000, 100, 70_000)])
def test_blocks_of_a_large_group(spark, n, k, most_blocks, most_pairs):
    t = rc.TIERS[5]
    known = spark.range(1).select(F.lit("r").alias("final_rrn"), F.lit("a").alias("final_authorization_code"), F.lit(n).cast("long").alias("_n"),
                                  F.lit(DAY).alias("transaction_date"), F.lit("100.00").cast("decimal(18,2)").alias("amount"))
    lines = spark.range(k).select(F.lit("x").alias("bank_rrn"), F.lit("a").alias("bank_auth_code"), F.lit(DAY).alias("bank_transaction_date"),
                                  F.lit(10_000).cast("long").alias("_bank_cents"))
    met = rc._partners(known, lines, t, 1, True).select("_met1.*").first()
    assert met["_a"] * met["_b"] <= most_blocks
    assert n / met["_a"] * k / met["_b"] <= most_pairs
    assert max(met["_a"], met["_b"]) <= 128
