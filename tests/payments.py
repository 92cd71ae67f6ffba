"""Small hand-made tables in the shape of the cleaned sources."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from decimal import Decimal

from pyspark.sql.types import StructType

from payrecon.plans.payment_view import SCRIPT, payment_view
from payrecon.sources.spec import default_spec, table_schema

DAY = date(2024, 1, 5)

DEFAULTS = {
    "checkout_v1": {"transaction_amount": Decimal("100.00"), "transaction_date": DAY, "response_code": "10000"},
    "checkout_v2": {"transaction_amount": Decimal("100.00"), "action_date_utc_1": DAY, "response_code": "10000"},
    "payfort": {"transaction_amount": Decimal("100.00"), "transaction_date": DAY},
    "tamara": {"txn_amount": Decimal("100.00"), "txn_created_at_gmt_03_00": DAY},
    "bank": {"transaction_amount": Decimal("100.00"), "transaction_date": DAY},
    "portal": {"transaction_date": DAY},
    "metabase": {},
}
ALIASES = {"order": "order_id", "pay": "payment_online_transaction_id", "auth": "authorization_code"}


def build(spark, **rows) -> dict:
    """Frames of all seven sources; rows are dicts, ``order``/``pay``/``auth`` are short names."""
    out = {}
    for source in DEFAULTS if rows.keys() != {"bank"} else ["bank"]:
        schema = StructType([f for f in table_schema(default_spec(source)) if f.nullable])
        data = []
        for row in rows.get(source, []):
            row = {**DEFAULTS[source], **{ALIASES.get(k, k): v for k, v in row.items()}}
            assert set(row) <= set(schema.names), set(row) - set(schema.names)
            data.append(tuple(row.get(n) for n in schema.names))
        out[source] = spark.createDataFrame(data, schema)
    return out


def linked(*orders, payment="p{}"):
    """Metabase and portal rows linking each order to the payment of the same number."""
    return {
        "metabase": [{"gateway_order_id": o, "gateway_transaction_id": payment.format(o), "portal_order_id": o}
                     for o in orders],
        "portal": [{"order": o} for o in orders],
    }


def view(spark, options=SCRIPT, **rows):
    """The payment view; without bank rows it leaves the bank out."""
    return payment_view(build(spark, **rows), replace(options, include_reconciliation="bank" in rows))
