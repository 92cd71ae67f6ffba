import tempfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T
from tests.payments import build, linked

from payrecon.functions import cleaners as c
from payrecon.operators import quality, selection as sel
from payrecon.operators.cleaning import clean_source, conform
from payrecon.operators.duplicates import FLAG, duplicate_report, flag_duplicates, usable_keys
from payrecon.plans import payment_view as pv, view as vw
from payrecon.plans.options import QueryOptions
from payrecon.plans.query import payment_query, query_fields, query_from_json, query_to_json, run_sql
from payrecon.sources.spec import DUPLICATE_KEYS, ColumnSpec, SourceSpec, default_spec


def test_duplicates_flag_all_members_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (3, "a", 1), (4, "a", 2), (5, "b", 1), (6, "b", 1)],
                               "i int, x string, y int")
    got = {r["i"] for r in flag_duplicates(df, ("x", "y")).where(FLAG).collect()}
    assert got == {1, 2, 5, 6}
    assert {r["i"] for r in flag_duplicates(df, ("x", "y"), ("i",)).where(FLAG).collect()} == set()
    r = duplicate_report(df, ("x", "y")).collect()[0]
    assert (r["n_rows"], r["n_flagged"], r["pct_flagged"], r["n_groups"], r["alarm"]) == (6, 4, 66.7, 2, False)
    assert duplicate_report(df.where("i > 4"), ("x", "y")).collect()[0]["alarm"]
    assert duplicate_report(df.where("i > 9"), ("x", "y")).collect()[0]["n_rows"] == 0


def test_duplicate_keys_fall_back_to_what_is_left():
    assert usable_keys(["a", "b"], ("a", "b", "z")) == ["a", "b"]
    assert usable_keys(["a"], ("a", "z")) == []
    assert usable_keys(default_spec("metabase").names(), DUPLICATE_KEYS["metabase"]) == []


def test_too_few_keys_flag_nothing(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    assert flag_duplicates(df, ("a", "z")).where(FLAG).count() == 0
    assert duplicate_report(df, ("a", "z")).collect()[0]["n_flagged"] == 0


def test_reports(spark):
    raw = ["2024-01-01", "bad", "worse", "bad", "None", ""]
    df = spark.createDataFrame([(v, "maybe" if v == "bad" else "yes") for v in raw], "r string, b string")
    df = df.withColumn("d", c.clean_date(F.col("r")))
    r = quality.null_rate_report(df, {"day": ("r", "d")}).collect()[0]
    assert (r["n_rows"], r["n_null"], r["n_unparsed"], r["null_rate"], r["alarm"], r["samples"]) == (
        6, 5, 4, 0.8333, True, "|bad|worse")
    b = quality.unmapped_booleans(df, "b").collect()[0]
    assert (b["n_distinct"], b["n_rows"], b["samples"]) == (1, 2, "maybe")
    assert quality.unmapped_booleans(df.where("b = 'yes'"), "b").collect()[0]["n_distinct"] == 0
    assert quality.invalid_uuids(df, "r").collect()[0]["n_invalid"] == 6
    spec = SourceSpec("bank", "bank", (ColumnSpec("A", "a"), ColumnSpec("B", "b"), ColumnSpec("C", "c", required=False)))
    rep = quality.column_report(["A", "﻿X "], spec)
    assert (rep.missing_required, rep.missing_optional, rep.extra, rep.ok) == (["B"], ["C"], ["X"], False)


def test_clean_source_keeps_raw_and_adds_missing(spark):
    spec = default_spec("bank")
    df = spark.createDataFrame([("1\x07", "5,5", "q")], "RRN string, `Transaction Amount` string, Other string")
    out = clean_source(df, spec, datetime(2024, 1, 1), keep_raw=True)
    r = out.collect()[0]
    assert (r["rrn"], r["transaction_amount"], r["_raw_transaction_amount"], r["bank_name"]) == ("1", 55.0, "5,5", None)
    assert out.columns[:18] == spec.names() and "Other" not in out.columns
    with pytest.raises(ValueError, match="none of the configured"):
        clean_source(df.select("Other"), spec)
    wide = conform(df, T.StructType([T.StructField("n", T.IntegerType()), T.StructField("RRN", T.LongType())]))
    assert wide.collect() == [(None, 1)] and wide.dtypes == [("n", "int"), ("RRN", "bigint")]


def test_every_view_column_can_be_selected():
    for flavour in ("script", "generated"):
        columns = pv.view_columns(flavour)
        assert len(columns) == len(set(columns)) == 126 and len(pv.view_columns(flavour, bank=False)) == 107
        names, report = sel.resolve_fields(columns, columns, strict=True)
        assert names == sorted(columns) and not report.missing and not report.mapped


def test_field_resolution():
    names, report = query_fields({
        "portal": ["order_id", "portal_chef_name"], "bank": ["authorization_code", "payment_online_transaction_id"],
        "checkout_v1": ["payment_id", "payment_online_transaction_id"], "tamara": ["txn_created_at_gmt_03_00"],
        "analysis": ["bank_match_type"], "metabase": ["nothing"]})
    assert set(names) == {*sel.ESSENTIAL, "portal_order_id_val", "portal_chef_name", "bank_auth_code", "bank_payment_id",
                          "checkout_v1_payment_id", "tamara_transaction_date", "bank_match_type"}
    assert names == sorted(names) and report.missing == ["metabase_nothing"]
    assert report.mapped["portal_order_id"] == "portal_order_id_val"
    with pytest.raises(ValueError, match="metabase_nothing"):
        query_fields({"metabase": ["nothing"]}, strict=True)
    off, report = query_fields({"bank": ["rrn"]}, QueryOptions(include_reconciliation=False))
    assert off == sorted(sel.ESSENTIAL) and not report.missing
    assert "currency" not in sel.default_fields(["checkout_v1_currency", "portal_chef_name"]) and \
        sel.default_fields(["checkout_v1_currency", "portal_chef_name"]) == ["checkout_v1_currency"]
    assert sel.critical_fields(["bank_amount", "portal_chef_name"]) == ["bank_amount"]


def test_distinct_orders_and_limit(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, None, 5), (None, "z", 1), (None, "y", 7)], "gateway_order_id int, s string, n int")
    assert sorted(map(tuple, sel.distinct_orders(df).collect()), key=str) == [(1, None, 5), (None, "y", 7)]
    assert [tuple(r) for r in sel.first_rows(df, 2).collect()] == [(None, "y", 7), (None, "z", 1)]


def test_options_round_trip():
    options = QueryOptions(date_range=("2024-01-01", "2024-02-01"), min_amount=Decimal("1.50"), limit=3, date_match=False)
    assert QueryOptions.from_json(options.to_json()) == options
    assert query_from_json(query_to_json({"bank": ["rrn"]}, options)) == ({"bank": ["rrn"]}, options)
    assert query_from_json("{}") == (None, QueryOptions())
    assert [t.label for t in QueryOptions(rrn_only_match=False, auth_only_match=False, date_match=False).tiers()] == [
        "MATCH: Authorization Code + RRN + Amount"]


def test_query_end_to_end(spark):
    rows = [{"order": o, "pay": f"p{o}", "status": s, "transaction_amount": Decimal(a), "payment_method": m}
            for o, s, a, m in [(1, "Capture", 10, "card"), (1, "Refund", 5, "card"), (2, "Capture", 20, "wallet")]]
    tables = build(spark, checkout_v1=rows, **linked(1, 2))
    options = QueryOptions(include_reconciliation=False, distinct_orders=True, simplify_response_codes=True)
    got = payment_query(tables, {"portal": ["status"]}, options)
    assert got.columns[0] == "gateway_order_id" and "portal_status" in got.columns
    assert {(r["gateway_order_id"], r["amount"], r["response_category"]) for r in got.collect()} == {
        (1, Decimal("5.00"), "approved"), (2, Decimal("20.00"), "approved")}
    few = payment_query(tables, [], QueryOptions(
        include_reconciliation=False, min_amount=Decimal("6"), max_amount=Decimal("15"), payment_method="card", status="Capture"))
    assert [(r["gateway_order_id"], r["amount"]) for r in few.collect()] == [(1, Decimal("10.00"))]


def test_named_view_and_funnel(spark):
    tables = build(spark, checkout_v1=[{"order": 1, "pay": "p1", "status": "Capture", "rrn": "R", "auth": "A"}],
                   bank=[{"rrn": "R", "auth": "A"}], **linked(1))
    vw.register_view(spark, tables, "pv_test")
    assert run_sql(spark, "SELECT bank_match_type FROM pv_test").count() == 1
    assert vw.drop_view(spark, "pv_test") and not vw.drop_view(spark, "pv_test")
    with pytest.raises(ValueError, match="no view"):
        vw.read_view(spark, "pv_test")
    assert [r["n_rows"] for r in pv.stage_funnel(tables).orderBy("stage").collect()] == [1] * 6


def test_view_follows_its_tables(spark):
    """A gateway and the bank change between registering and reading, in the catalogue and in a folder; registering runs nothing."""
    pay = {"order": 1, "pay": "p1", "status": "Capture", "rrn": "R", "auth": "A"}
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    full = build(spark, checkout_v1=[pay, pay], bank=[{"rrn": "R", "auth": "A"}], **linked(1))
    sources = {name: f"{folder}/{name}" for name in full} | {"bank": "bank_of_view"}
    for name in full:
        full[name].write.parquet(f"{folder}/{name}")
    full["bank"].write.mode("overwrite").saveAsTable("bank_of_view")
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(vw, "payment_view", lambda *a: pytest.fail("computed at once"))
            vw.register_view(spark, sources, "fresh")
        seen = lambda: sorted((r["rrn"], r["bank_rrn"] or "") for r in run_sql(spark, "SELECT * FROM fresh f").collect())
        assert seen() == [("R", "R")] * 2
        build(spark, checkout_v1=[{**pay, "rrn": "Q", "auth": "B"}, pay, pay], **linked(1))["checkout_v1"].write.mode("overwrite").parquet(
            f"{folder}/checkout_v1")
        assert seen() == [("Q", ""), ("R", "R"), ("R", "R")]
        build(spark, bank=[{"rrn": "Q", "auth": "x"}])["bank"].write.mode("overwrite").saveAsTable("bank_of_view")
        assert seen() == [("Q", "Q"), ("R", ""), ("R", "")]
        assert vw.read_view(spark, "fresh").count() == 3
    finally:
        vw.drop_view(spark, "fresh")
        spark.sql("DROP TABLE bank_of_view")


def test_first_rows_beyond_one_task(spark):
    from payrecon.operators.selection import first_rows

    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), "id").repartition(5)
    want = sorted(map(tuple, df.collect()))
    for n in (0, 1, 120, 499, 500, 900):
        assert sorted(map(tuple, first_rows(df, n, one_task=0).collect())) == want[:n]
