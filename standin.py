"""Test data: stand-ins for the seven sources (and a dirty export), derived from the order tables of the test data.

The SQL is portable: Spark runs it here, the oracle runs the same text over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAY_LINES = """
SELECT CAST(l_orderkey AS BIGINT) AS order_id, concat('pay_', CAST(l_orderkey AS STRING)) AS payment_id,
  l_linenumber, l_linestatus, l_suppkey, CAST(l_quantity AS INT) AS qty,
  CASE WHEN l_orderkey % 8 < 2 THEN 100.00 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amt, CAST(l_shipdate AS DATE) AS dt,
  CASE WHEN l_quantity < 2 THEN '' ELSE lpad(CAST(l_orderkey % 5000 AS STRING), 6, '0') END AS auth,
  concat('R', CAST(l_orderkey AS STRING)) AS rrn,
  CASE l_linenumber WHEN 1 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'Authorization' ELSE 'Authorisation' END
    WHEN 2 THEN 'Capture' WHEN 3 THEN 'Refund' WHEN 4 THEN CASE WHEN l_suppkey % 3 = 1 THEN 'Cancel' ELSE 'Void' END
   
    WHEN 5 THEN 'Capture' WHEN 6 THEN 'Approved' ELSE 'Declined' END AS action,
  CASE WHEN l_returnflag = 'R' THEN '20005' ELSE '10000' END AS rc
FROM lineitem
"""

VIEWS = {
    "portal": """
SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS transaction_amount,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'checkout_v1' WHEN 1 THEN 'checkout_v2' WHEN 2 THEN 'payfort'
    ELSE 'tamara' END AS gateway,
  o_orderstatus AS status, o_orderpriority AS payment_method, CAST(o_orderdate AS DATE) AS transaction_date,
  c_name AS customer_name, concat('chef_', CAST(o_custkey % 17 AS STRING)) AS chef_name,
  CAST(o_totalprice * 0.8 AS DECIMAL(18,2)) AS chef_total,
  CAST(o_totalprice * 0.2 AS DECIMAL(18,2)) AS commission_amount,
  CASE WHEN o_orderkey % 2 = 0 THEN 'pickup' ELSE 'delivery' END AS delivery_type, c_mktsegment AS discount_type,
  CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS ispaid,
  concat('ord_', CAST(o_orderkey AS STRING)) AS transaction_id, CAST(0 AS DECIMAL(18,2)) AS wallet_paid_amount,
  CAST(NULL AS DECIMAL(18,2)) AS promo_code_total_discount
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""",
    "metabase": """
SELECT CAST(o_orderkey AS BIGINT) AS gateway_order_id, concat('pay_', CAST(o_orderkey AS STRING)) AS gateway_transaction_id,
  CAST(o_orderkey AS BIGINT) AS portal_order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS transaction_amount,
  CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'PENDING' END AS status, 'app' AS gateway, '1.0' AS app_version,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ios' ELSE 'android' END AS platform, o_orderstatus AS order_status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS order_total, concat('hp_', CAST(o_orderkey AS STRING)) AS hyperpay_transaction_id,
  'true' AS success, 'order' AS transactiontype
FROM orders WHERE o_orderkey % 10 <> 9
""",
    "checkout_v1": """
SELECT order_id, payment_id AS payment_online_transaction_id, amt AS transaction_amount, action AS status,
  dt AS transaction_date, auth AS authorization_code, rrn, 'card' AS payment_method, 'BANK A' AS issuing_bank,
  rc AS response_code, CASE WHEN rc = '10000' THEN 'Approved' ELSE 'Declined' END AS response_description,
  'p1' AS processor, 'apple' AS card_wallet_type, 'SAR' AS currency
FROM pay_lines WHERE order_id % 4 = 0
""",
    "checkout_v2": """
SELECT order_id, payment_id AS payment_online_transaction_id, amt AS transaction_amount, action AS status,
  dt AS action_date_utc_1, auth AS authorization_code, rrn, 'card' AS payment_method_name, rc AS response_code,
  CASE WHEN rc = '10000' THEN 'Approved' ELSE 'Declined' END AS response_description, 'apple' AS wallet,
  'SAR' AS currency_symbol, 'no' AS co_badged_card
FROM pay_lines WHERE order_id % 4 = 1
""",
    "payfort": """
SELECT order_id, payment_id AS payment_online_transaction_id, amt AS transaction_amount,
  CASE l_linenumber WHEN 1 THEN 'AUTHORIZATION' WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0
    THEN 'PARTIALLY_REFUNDED' ELSE 'FULLY_REFUNDED' END ELSE upper(action) END AS status,
  dt AS transaction_date, auth AS authorization_code, rrn, 'visa' AS payment_method, 'cc' AS payment_method_type,
  'ACQ' AS acquirer_name, 'SA' AS merchant_country, 'web' AS channel, 'm1' AS mid, 'SAR' AS currency,
  '10:11:12' AS time
FROM pay_lines WHERE order_id % 4 = 2
""",
    "tamara": """
SELECT order_id, payment_id AS payment_online_transaction_id, amt AS txn_amount,
  CASE l_linenumber WHEN 3 THEN 'fully_refunded' WHEN 4 THEN 'canceled' WHEN 7 THEN 'declined' ELSE 'approved' END
    AS status,
  dt AS txn_created_at_gmt_03_00, concat('T', CAST(order_id AS STRING)) AS tamara_txn_reference,
  'PAY_BY_INSTALMENTS' AS payment_method, 'n' AS customer_name,
  CASE l_linenumber WHEN 1 THEN 'AUTHORIZE' WHEN 3 THEN 'REFUND' WHEN 4 THEN 'CANCEL' ELSE 'CAPTURE' END AS txn_type,
  'SETTLED' AS txn_settlement_status, 'SAR' AS order_currency, 'SA' AS country_code, 's' AS store_name,
  amt AS total_amount, dt AS order_created_at_gmt_03_00
FROM pay_lines WHERE order_id % 4 = 3
""",
    "bank": """
SELECT CASE WHEN l_suppkey % 3 = 1 THEN 'ZZ' ELSE auth END AS authorization_code,
  CASE WHEN l_suppkey % 3 = 2 THEN 'XX' ELSE rrn END AS rrn,
  CAST(amt + CASE qty % 5 WHEN 1 THEN 0.01 WHEN 2 THEN 0.75 WHEN 4 THEN 5.00 ELSE 0.00 END AS DECIMAL(18,2))
    AS transaction_amount,
  dt AS transaction_date, 'sale' AS transaction_type, 'Paid' AS status, 'BANK A' AS bank_name, 'visa' AS card_type,
  CAST(0 AS DECIMAL(18,2)) AS cashback_amount, CAST(0 AS DECIMAL(18,2)) AS discount_amount,
  concat('4111****', CAST(order_id % 100 AS STRING)) AS masked_card, 'mid' AS merchant_identifier,
  payment_id AS payment_online_transaction_id, dt AS posting_date, 'tid' AS terminal_identifier,
  amt AS total_payment_amount, 'u' AS transaction_link_url, CAST(0 AS DECIMAL(18,2)) AS vat_amount
FROM pay_lines WHERE l_linestatus = 'F'
""",
}

DIRTY = """
SELECT o_orderkey AS k,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING))
    WHEN 1 THEN concat('SAR ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) WHEN 2 THEN 'N/A' WHEN 3 THEN ''
    WHEN 4 THEN concat('-', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) ELSE '1-2' END AS amount_raw,
  CASE CAST(o_orderkey % 7 AS INT)
    WHEN 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING),2,'0'),'/',lpad(CAST(month(o_orderdate) AS STRING),2,'0'),'/',CAST(year(o_orderdate) AS STRING))
    WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING),'-',lpad(CAST(month(o_orderdate) AS STRING),2,'0'),'-',lpad(CAST(day(o_orderdate) AS STRING),2,'0'))
    WHEN 2 THEN concat(CAST(year(o_orderdate) AS STRING),lpad(CAST(month(o_orderdate) AS STRING),2,'0'),lpad(CAST(day(o_orderdate) AS STRING),2,'0'))
    WHEN 3 THEN CAST(40000 + o_orderkey % 5000 AS STRING) WHEN 4 THEN 'None' WHEN 5 THEN '' ELSE '31/02/2024' END AS date_raw,
  CASE CAST(o_orderkey % 5 AS INT)
    WHEN 0 THEN concat(lpad(CAST(o_orderkey % 24 AS STRING),2,'0'),':',lpad(CAST(o_orderkey % 60 AS STRING),2,'0'),':',lpad(CAST(o_custkey % 60 AS STRING),2,'0'))
    WHEN 1 THEN concat(CAST(o_orderkey % 12 + 1 AS STRING),':',lpad(CAST(o_orderkey % 60 AS STRING),2,'0'),CASE WHEN o_custkey % 2 = 0 THEN ' AM' ELSE ' PM' END)
    WHEN 2 THEN CAST(CAST(o_custkey % 64 AS DOUBLE) / 64 AS STRING) WHEN 3 THEN '<NA>' ELSE 'bad' END AS time_raw,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN concat(CAST(o_orderkey AS STRING),'.0') WHEN 2 THEN 'abc' ELSE '' END AS int_raw,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Yes' WHEN 1 THEN 'f' WHEN 2 THEN 'ON' WHEN 3 THEN 'maybe' ELSE 'failure' END AS bool_raw,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN concat('="', o_orderpriority, '"') WHEN 1 THEN concat('  a', chr(10), 'b', chr(7), ' ')
    WHEN 2 THEN 'Tom &amp; Co &lt;x&gt;  y' ELSE '' END AS text_raw,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('{', upper(md5(CAST(o_orderkey AS STRING))), '}')
    WHEN 2 THEN concat('urn:uuid:', md5(CAST(o_orderkey AS STRING))) ELSE 'nope' END AS uuid_raw, o_custkey AS c
FROM orders
"""


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payment_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven cleaned sources as frames over the order tables."""
    lineitem, orders, customer = (_base(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    lines = _sql(spark, PAY_LINES, lineitem=lineitem)
    frames = {"pay_lines": lines, "orders": orders, "customer": customer}
    return {name: _sql(spark, text, **frames) for name, text in VIEWS.items()}


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, DIRTY, orders=_base(spark, sf_dir, "orders"))


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    used = {n: df for n, df in frames.items() if f"FROM {n}" in text or f"JOIN {n}" in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for name in used:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}").replace(f"JOIN {name}", "JOIN {" + name + "}")
    return spark.sql(text, **used)


def oracle_with(names: tuple[str, ...] = tuple(VIEWS)) -> str:
    """``WITH`` prefix defining the stand-ins for the oracle."""
    views = {"pay_lines": PAY_LINES, **VIEWS, "dirty": DIRTY}
    return "WITH " + ",\n".join(f"{n} AS ({views[n].strip()})" for n in ("pay_lines", *names))
