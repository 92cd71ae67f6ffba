import re

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, _rows

@pytest.fixture(autouse=True)
def generated_code(spark):
    """These tests run the code that the product runs."""
    keys = ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "true")
    spark.conf.set(keys[1], "FALLBACK")
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {name for name in entry.queries() if not re.match(r"op\d+_", name) and name != "pipeline"}
    assert own <= set(entry.oracle_sql())


@pytest.mark.parametrize("changed, default", [
    ("without_duplicates", "option_kinds"), ("option_partial_refunds", "transaction_labels_success"),
    ("option_merge_off", "transaction_labels_success"), ("option_auth_rrn_only", "transaction_labels_success"),
    ("gateway_flags_generated", "gateway_flags_script"), ("bank_match_no_blank", "bank_match_tiers"),
    ("bank_match_exact_only", "bank_match_tiers"), ("bank_match_tolerances", "bank_match_tiers")])
def test_options_change_what_is_expected(con, changed, default):
    rows = [sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall())) for name in (changed, default)]
    assert rows[0] != rows[1]


def test_queries_of_faults_meet_faults(con):
    expect = entry.oracle_sql()
    assert con.execute(f"SELECT sum(n_dropped) FROM ({expect['csv_line_audit']})").fetchone()[0] > 0
    assert con.execute(f"SELECT sum(n_invalid), count(DISTINCT encoding) FROM ({expect['encoding_audit']})").fetchone()[1] == 3
    assert con.execute(f"SELECT count(*) FROM ({expect['verify_per_file']}) WHERE NOT agrees").fetchone()[0] > 0
    assert con.execute(f"SELECT count(*) FROM ({expect['without_duplicates']})").fetchone()[0] < con.execute(
        f"SELECT count(*) FROM ({expect['payment_view_no_bank']})").fetchone()[0]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["gateway_source", "bank_match_type", "n_rows", "total_amount"]


@pytest.mark.parametrize("name", [
    "gateway_flags_generated", "removed_auth_rows", "bank_match_tiers", "clean_source_conformed", "duplicate_report",
    "scan_csv_roundtrip", "distinct_orders",
    "scan_mixed_files", "encoding_audit", "ingest_all", "file_audit"])
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cur.fetchall())
