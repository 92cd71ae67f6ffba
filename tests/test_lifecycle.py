from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F
from tests.payments import build, linked, view

from payrecon.operators import gateways as g, lifecycle as lc
from payrecon.plans import payment_view as pv
from payrecon.plans.options import QueryOptions


def labels(df):
    return sorted((r["status"], r["final_rrn"], r["final_authorization_code"], r["transaction_analysis"])
                  for r in df.collect())


def test_auth_is_merged_into_capture(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Authorisation", "rrn": "A", "auth": "1"},
            {"order": 1, "pay": "p1", "status": "Capture", "rrn": "B", "auth": "2"}]
    df = view(spark, checkout_v1=rows, **linked(1))
    assert labels(df) == [("Capture", "A", "1", "Capture Successful (Authorisation Merged)")]


def test_failed_capture_takes_the_auth_with_it(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Authorisation"},
            {"order": 1, "pay": "p1", "status": "Capture", "response_code": "20005"}]
    assert view(spark, checkout_v1=rows, **linked(1)).count() == 0


def test_capture_without_auth_and_two_auths(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Capture", "rrn": "B", "auth": "2"},
            {"order": 2, "pay": "p2", "status": "Authorisation", "rrn": "A", "auth": "8"},
            {"order": 2, "pay": "p2", "status": "Authorisation", "rrn": "B", "auth": "10"},
            {"order": 2, "pay": "p2", "status": "Capture", "rrn": "C", "auth": "3"}]
    assert labels(view(spark, checkout_v2=rows, **linked(1, 2))) == [
        ("Capture", "B", "2", "Capture Successful (auth_less)"),
        ("Capture", "B", "8", "Capture Successful (Authorisation Merged)")]


def test_unknown_status_follows_three_valued_logic(spark):
    rows = [{"order": 1, "pay": "p1", "status": None}, {"order": 1, "pay": "p1", "status": "Authorisation"},
            {"order": 1, "pay": "p1", "status": "Capture"}, {"order": 2, "pay": "p2", "status": None}]
    got = [(r["gateway_order_id"], r["status"], r["transaction_analysis"])
           for r in view(spark, checkout_v1=rows, **linked(1, 2)).collect()]
    assert sorted(got, key=str) == [
        (1, "Capture", "Capture Successful (Authorisation Merged)"), (2, None, "General Success (Code 10000)")]
    removed = lc.merged_auth_rows(lc.auth_capture_groups(
        pv.unify(build(spark, checkout_v1=rows, **linked(1, 2)))))
    assert sorted((r["status"] for r in removed.collect()), key=str) == ["Authorisation", None]


def test_payfort_capture_never_succeeds(spark):
    rows = [{"order": 1, "pay": "p1", "status": s} for s in ("CAPTURE", "AUTHORIZATION", "VOID", "APPROVED")]
    assert [r["status"] for r in view(spark, payfort=rows[:1] + rows[2:], **linked(1)).collect()] == ["APPROVED"]


def test_only_seven_labels_reach_the_view(spark):
    statuses = ["Authorisation", "Capture", "Refund", "Void", "Cancel", "Canceled", "Approved", "Declined", "FULLY_REFUNDED"]
    rows = [{"order": i, "pay": f"p{i}", "status": s, "response_code": code, "transaction_amount": Decimal(i)}
            for i, (s, code) in enumerate((s, code) for s in statuses for code in ("10000", "20005", "", None))]
    ids = range(len(rows))
    allowed = {"Refund Successful", "Void Successful", "Capture Successful (auth_less)",
               "Capture Successful (Authorisation Merged)", "Authorisation Successful",
               "General Success (Code 10000)", "General Success (Approved)"}
    df = view(spark, checkout_v1=rows, **linked(*ids))
    assert {r["transaction_analysis"] for r in df.collect()} <= allowed
    assert {r["transaction_outcome"] for r in df.collect()} == {"Success"}
    audit = view(spark, QueryOptions(flavour="script", success_only=False), checkout_v1=rows, **linked(*ids)).collect()
    assert len(audit) == len(rows)
    by = {(r["status"], r["response_code"]): r["transaction_analysis"] for r in audit}
    assert by["Authorisation", "20005"] == "Authorisation Failed (Check Response: 20005)"
    assert by["Authorisation", None] is None
    assert by["Capture", "20005"] == "Capture Failed/Pending (auth_less)"
    assert by["Cancel", "20005"] == "Void Failed/Pending"
    assert by["Declined", ""] == "General Failure (Declined/Failed)"
    assert by["Declined", "20005"] == "General Failure (Code: 20005)"
    assert by["Canceled", None] == "Unknown/Incomplete Status"


def test_capture_with_auth_and_bad_code_quotes_it(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Authorisation"},
            {"order": 1, "pay": "p1", "status": "Capture", "response_code": "20005"}]
    got = view(spark, QueryOptions(flavour="script", success_only=False), checkout_v1=rows, **linked(1)).collect()
    assert [r["transaction_analysis"] for r in got] == ["Capture Failed/Pending (Check Response: 20005)"]


def test_flavours(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Authorization"}, {"order": 1, "pay": "p1", "status": "Cancel"}]
    script = {r["status"]: r for r in g.gateway_common(build(spark, checkout_v1=rows)["checkout_v1"], "checkout_v1").collect()}
    gen = {r["status"]: r for r in
           g.gateway_common(build(spark, checkout_v1=rows)["checkout_v1"], "checkout_v1", "generated").collect()}
    assert not script["Authorization"]["is_auth"] and gen["Authorization"]["is_auth"]
    assert not script["Cancel"]["is_void"] and gen["Cancel"]["is_void"]
    with pytest.raises(ValueError):
        g.gateway_common(build(spark)["tamara"], "tamara", "other")


def test_tamara_links_by_payment_alone_and_its_kinds_are_case_sensitive(spark):
    rows = [{"order": 7, "pay": "p1", "txn_type": "REFUND", "status": "fully_refunded", "tamara_txn_reference": "T"},
            {"order": 7, "pay": "p1", "txn_type": "refund", "status": "approved"}]
    got = view(spark, tamara=rows, **linked(1)).collect()
    assert sorted(r["transaction_analysis"] for r in got) == ["General Success (Approved)", "Refund Successful"]
    assert {r["order_id"] for r in got} == {1} and {r["tamara_portal_order_id"] for r in got} == {7}
    assert {r["authorization_code"] for r in got} == {""}


def test_links_fan_out_and_missing_links_drop(spark):
    links = linked(1)
    links["metabase"] *= 2
    rows = [{"order": 1, "pay": "p1", "status": "Approved"}, {"order": 9, "pay": "p9", "status": "Approved"}]
    assert view(spark, checkout_v1=rows, **links).count() == 2


def _literal_groups(tables, date_range=None):
    w = Window.partitionBy(*lc.GROUP)
    df = pv.unify(tables, date_range=date_range)
    one = lambda c: F.max(F.when(F.col(c), 1).otherwise(0)).over(w)
    return df.select("*", one("is_auth").alias("a"), one("is_capture").alias("b"),
                     F.max(F.when(F.col("is_auth"), F.col("rrn"))).over(w).alias("c"),
                     F.max(F.when(F.col("is_auth"), F.col("authorization_code"))).over(w).alias("d"))


@pytest.mark.parametrize("date_range", [None, ("2024-01-01", "2024-01-31")])
def test_group_facts_equal_a_window_over_the_linked_rows(spark, date_range):
    """Groups that mix gateways, some of whose rows are not linked."""
    from datetime import date

    card = [{"order": o, "pay": p, "status": s, "rrn": f"{s[0]}{o}{p}", "auth": f"{o}"}
            for o in (1, 2, 3, None) for p in ("p1", "p2", "p3", None) for s in ("Authorisation", "Capture", "Approved")
            if (o, p, s) not in {(1, "p1", "Capture"), (2, "p2", "Authorisation")}]
    later = [{"order": o, "pay": p, "txn_type": t, "status": "approved", "tamara_txn_reference": f"Z{o}{t}"}
             for o in (1, 2, 3, None) for p in ("p1", "p2", "p3", None) for t in ("AUTHORIZE", "CAPTURE")
             if (o, p) != (3, "p3")]
    metabase = [{"gateway_order_id": o, "gateway_transaction_id": p, "portal_order_id": q}
                for o, p, q in [(1, "p1", 10), (2, "p1", 11), (2, "p2", 11), (2, "p2", 10), (3, "p3", 12), (None, "p2", 10)]]
    portal = [{"order": 10}, {"order": 11, "transaction_date": date(2024, 3, 1)}]
    tables = build(spark, checkout_v1=card[::2], checkout_v2=card[1::2], tamara=later, metabase=metabase, portal=portal)
    options = QueryOptions(flavour="script", success_only=False, merge_auth_capture=False, date_range=date_range)
    columns = ["gateway_source", *lc.GROUP, "status", "is_auth", "rrn", "order_id"]
    got = pv.transactions(tables, options)[0].select(*columns, *lc.GROUP_COLUMNS)
    want = _literal_groups(tables, date_range).select(*columns, "a", "b", "c", "d")
    got, want = (sorted(map(tuple, df.collect()), key=str) for df in (got, want))
    assert got == want and len(got) > 20
    if date_range is None:
        both = [r for r in got if r[0] == "tamara" and r[-3] == 1]
        assert both, "a payment-only row in a group with a linked capture"


def test_options_of_the_merge(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Authorisation", "rrn": "A", "auth": "1"},
            {"order": 1, "pay": "p1", "status": "Capture", "rrn": "B", "auth": "2"}]
    merged = "Capture Successful (Authorisation Merged)"

    def go(**kw):
        return labels(view(spark, QueryOptions(flavour="script", **kw), checkout_v1=rows, **linked(1)))

    assert go(merge_auth_capture=False) == [
        ("Authorisation", "A", "1", "Authorisation Successful"), ("Capture", "B", "2", merged)]
    assert go(use_auth_code=False) == [("Capture", "A", "2", merged)]
    assert go(use_auth_rrn=False) == [("Capture", "B", "1", merged)]
    assert go(include_capture=False) == []


def test_partial_refunds_option(spark):
    rows = [{"order": 1, "pay": "p1", "status": s, "response_code": "x"} for s in ("FULLY_REFUNDED", "PARTIALLY_REFUNDED")]
    assert view(spark, checkout_v1=rows, **linked(1)).count() == 2
    off = view(spark, QueryOptions(flavour="script", partial_refunds=False), checkout_v1=rows, **linked(1))
    assert [r["status"] for r in off.collect()] == ["FULLY_REFUNDED"]


def test_duplicates_filter_drops_all_copies(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Approved"}] * 2 + [{"order": 1, "pay": "p1", "status": "Void"}]
    got = view(spark, QueryOptions(flavour="script", include_duplicates=False), checkout_v1=rows, **linked(1)).collect()
    assert [r["status"] for r in got] == ["Void"]


def test_outcome_summary_counts_rows(spark):
    rows = [{"order": 1, "pay": "p1", "status": "Approved"}] * 3
    r = lc.outcome_summary(view(spark, checkout_v1=rows, **linked(1))).collect()
    assert [(x["n_rows"], x["total_amount"]) for x in r] == [(3, Decimal("300.00"))]
