"""Column configuration of the seven sources: headers, canonical names and types."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, types and headers of the exchanged files.
# ---------------------------------------------------------------------------

SOURCES = ("portal", "metabase", "checkout_v1", "checkout_v2", "payfort", "tamara", "bank")

SQL_TYPES = {
    "integer": "INTEGER",
    "float": "NUMERIC(18,2)",
    "date": "DATE",
    "time": "TIME",
    "string": "VARCHAR(255)",
    "text": "TEXT",
}

# Headers with a canonical name of their own, in the order they are taken first.
RENAMES: dict[str, dict[str, str]] = {
    "portal": {
        "Order Id": "order_id",
        "Order Number": "transaction_id",
        "Order Total": "transaction_amount",
        "Delivery Date": "transaction_date",
        "Order Status": "status",
        "Payment Method": "payment_method",
        "RRN": "rrn",
        "Auth Code": "authorization_code",
        "Wallet Paid Amount": "wallet_paid_amount",
        "Main Wallet Paid Amount": "main_wallet_paid_amount",
        "Store Wallet Paid Amount": "store_wallet_paid_amount",
        "Collected Cash": "collected_cash",
        "Total Transfer Fees": "total_transfer_fees",
        "Chef Total": "chef_total",
        "Commission Amount": "commission_amount",
        "Integration": "gateway",
        "Delivery Type": "delivery_type",
        "Service Fees": "service_fees",
    },
    "metabase": {
        "RRN": "rrn",
        "Auth Code": "authorization_code",
        "Transaction Amount": "transaction_amount",
        "Transaction Date": "transaction_date",
        "Payment Status": "status",
        "payment_online_transaction_id": "gateway_order_id",
        "Response Code": "response_code",
        "Order ID": "portal_order_id",
    },
    "checkout_v1": {
        "Acquirer Reference ID": "rrn",
        "Auth Code": "authorization_code",
        "Amount": "transaction_amount",
        "Action Date UTC": "transaction_date",
        "Action Type": "status",
        "Payment ID": "payment_online_transaction_id",
        "Response Code": "response_code",
        "Reference": "order_id",
    },
    "checkout_v2": {
        "Acquirer Reference Number": "rrn",
        "Auth Code": "authorization_code",
        "Amount": "transaction_amount",
        "Action Date UTC": "action_date_utc_1",
        "Action Type": "status",
        "Payment ID": "payment_online_transaction_id",
        "Response Code": "response_code",
        "Reference": "order_id",
    },
    "payfort": {
        "Merchant Reference": "order_id",
        "FORT ID": "payment_online_transaction_id",
        "Amount": "transaction_amount",
        "Date & Time": "transaction_date",
        "time": "time",
        "Operation": "status",
        "Response Code": "response_code",
        "Reconciliation Reference (RRN)": "rrn",
        "Authorization Code": "authorization_code",
        "Payment Option": "payment_method",
        "Payment Method": "payment_method_type",
        "Channel": "channel",
    },
    "tamara": {
        "Merchant Order Number": "order_id",
        "Tamara Order Id": "payment_online_transaction_id",
        "Order Amount": "transaction_amount",
        "Transaction Date DD/MM/YYYY": "txn_created_at_gmt_03_00",
        "Order Status": "status",
        "RRN": "rrn",
        "Auth Code": "authorization_code",
        "Payment Type": "payment_method",
        "Event": "transaction_type",
        "Currency": "currency",
    },
    "bank": {
        "RRN": "rrn",
        "Authorization Code": "authorization_code",
        "Transaction Amount": "transaction_amount",
        "Transaction Date": "transaction_date",
        "Payment Status": "status",
        "Payment ID": "payment_online_transaction_id",
        "Card Type": "card_type",
        "Card Number": "masked_card",
        "Transaction Type": "transaction_type",
        "Posting Date": "posting_date",
    },
}

# Headers of the known exports; names and types follow from them by rule.
HEADERS: dict[str, tuple[str, ...]] = {
    "portal": (
        "Order Id", "Order Number", "Order Total", "Delivery Date", "Order Status", "Payment Method",
        "Wallet Paid Amount", "Main Wallet Paid Amount", "Store Wallet Paid Amount", "Collected Cash",
        "Total Transfer Fees", "Chef Total", "Commission Amount", "Integration", "Delivery Type", "Service Fees",
        "Additional delivery fee", "Bonus", "Chef Name", "Commission Percentage", "Compensation By TheChefz",
        "Compensation By Vendor", "Customer Name", "Dark Store Fees", "Delivery Fees By Customer", "Discount Type",
        "Driver Delivery Fees", "Estimated Delivery Date", "Extra Delivery Fees", "Fees", "Gift Endurance",
        "Is Catering", "isPaid", "Note", "Order Items", "Promo-code discount chef amount",
        "Promo-code total discount", "Promocode Type", "Promotion discount chef amount", "Promotion Template ID",
        "Promotion Tier ID", "Promotion total discount", "Share & Earn Order", "TheChefz Fees",
    ),
    "metabase": (
        "Transaction Amount", "Payment Status", "payment_online_transaction_id", "Order ID", "app_version",
        "Donation Amount", "Donation ID", "Gateway", "gateway_transaction_id", "hyperpay_merchant_transaction_id",
        "hyperpay_transaction_id", "order_chef_total", "order_status", "Order Total", "platform", "Reservation ID",
        "Reservation Status", "Reservation Total Price", "ID", "Success", "TransactionType",
    ),
    "checkout_v1": (
        "Acquirer Reference ID", "Auth Code", "Amount", "Action Date UTC", "Action Type", "Payment ID",
        "Response Code", "Reference", "Action ID", "Card Wallet Type", "CC BIN", "Currency", "Issuing Bank",
        "Payment Method", "Payment Unique Number", "Processor", "Response Description",
    ),
    "checkout_v2": (
        "Acquirer Reference Number", "Auth Code", "Amount", "Action Type", "Payment ID", "Response Code",
        "Reference", "Action Date UTC.1", "Action ID", "Co-Badged Card", "Currency Symbol", "Payment Method Name",
        "Response Description", "Wallet",
    ),
    "payfort": (
        "Merchant Reference", "FORT ID", "Amount", "Date & Time", "time", "Operation",
        "Reconciliation Reference (RRN)", "Authorization Code", "Payment Option", "Payment Method", "Channel",
        "Acquirer Name", "Currency", "Merchant Country", "MID", "Period",
    ),
    "tamara": (
        "Merchant Order Number", "Tamara Order Id", "Order Status", "Payment Type", "Comment", "Country Code",
        "Customer Name", "Merchant Order Reference ID", "Order Created At GMT+03:00", "Order Currency",
        "Store Name", "Tamara Txn Reference", "Total Amount", "Txn Amount", "Txn Created At GMT+03:00",
        "Txn Settlement Status", "Txn Type",
    ),
    "bank": (
        "RRN", "Authorization Code", "Transaction Amount", "Transaction Date", "Payment Status", "Payment ID",
        "Card Type", "Card Number", "Transaction Type", "Posting Date", "Bank Name", "Cashback Amount",
        "Discount Amount", "Merchant Identifier", "Terminal Identifier", "Total Payment Amount",
        "Transaction Link URL", "VAT Amount",
    ),
}

NAME_TYPES = {
    "order_id": "integer",
    "portal_order_id": "integer",
    "gateway_order_id": "integer",
    "rrn": "string",
    "amount": "float",
    "transaction_amount": "float",
    "total": "float",
    "fees": "float",
    "cash": "float",
    "wallet_paid_amount": "float",
    "chef_total": "float",
    "commission_amount": "float",
    "transaction_date": "date",
    "action_date_utc_1": "date",
    "txn_created_at_gmt_03_00": "date",
    "posting_date": "date",
    "time": "time",
}

DATE_NAMES = {
    "transaction_date", "action_date_utc_1", "txn_created_at_gmt_03_00", "posting_date",
    "order_created_at_gmt_03_00", "delivery_date", "settlement_date", "created_at", "updated_at", "payment_date",
    "processing_date", "authorization_date", "capture_date",
}

TEXT_NAMES = {
    "portal": {
        "note", "order_items", "customer_name", "chef_name", "commission_percentage", "promotion_template_id",
        "promotion_tier_id", "gift_endurance", "customer_address", "external_client_id", "external_order_id",
        "gift_from", "gift_message", "order_content", "order_description", "phone_number", "order_address",
        "customer_email", "driver_id", "additional_info",
    },
    "metabase": {
        "order_status", "reservation_status", "order_details", "customer_info", "payment_details", "comments",
        "address", "notes", "description", "message",
    },
    "tamara": {
        "comment", "customer_name", "address", "order_reference_id", "consumer_email", "consumer_info",
        "description", "details",
    },
    "checkout_v1": {
        "customer_address", "customer_email", "customer_name", "payment_description", "order_details", "notes",
        "comments", "message", "id_token", "description",
    },
    "checkout_v2": {
        "customer_address", "customer_email", "customer_name", "payment_description", "order_details", "notes",
        "comments", "message", "id_token", "description",
    },
    "bank": {
        "customer_info", "transaction_details", "notes", "description", "payment_description", "reference",
        "comments",
    },
    "payfort": {
        "customer_email", "customer_name", "card_description", "payment_description", "notes", "comments",
        "message", "status_description",
    },
}

INTEGER_NAMES = {"order_id", "portal_order_id", "gateway_order_id"}
MONEY_WORDS = ("amount", "total", "fee", "cash")
MONEY_HEADER_WORDS = ("amount", "total", "fees", "cash")
CARD_HEADER_WORDS = ("card", "cc", "bin", "pan", "masked")

# Optional normalisation of unmapped headers: pattern on the lower-cased header -> name.
HEADER_PATTERNS = {
    r"order.*id": "order_id",
    r"payment.*online.*transaction.*id": "payment_online_transaction_id",
    r"reference.*id": "reference_id",
    r"\brnn\b|retrieval.*reference": "rnn",
    r"auth(orization)?_?(response_)?code": "authorization_code",
    r"(gross_?)?amount|txn?_?amount": "transaction_amount",
    r"(txn|transaction)_?type|payment_?type": "transaction_type",
    r"(txn|transaction)_?date|posting_?date": "transaction_date",
    r"response.*code": "response_code",
    r"settle(d|ment).*status|captured": "settlement_status",
}

DUPLICATE_KEYS = {
    "portal": ("order_id", "transaction_date", "payment_method"),
    "metabase": ("order_id", "payment_online_transaction_id"),
    "checkout_v1": ("payment_unique_number", "action_id", "order_id", "rrn"),
    "checkout_v2": ("action_id", "rrn", "order_id"),
    "tamara": ("merchant_order_reference_id", "payment_online_transaction_id", "tamara_txn_reference"),
    "payfort": ("order_id", "authorization_code", "transaction_amount"),
    "bank": ("masked_card", "transaction_amount", "authorization_code"),
}

ENCODINGS = {
    "tamara": "utf-8-sig",
    "payfort": "utf-8-sig",
    "checkout_v1": "utf-8-sig",
    "checkout_v2": "utf-8-sig",
    "portal": "utf-8-sig",
}

# Types of a cleaned frame. Ids stay 64-bit on load too: a 32-bit INTEGER overflows at cluster scale.
CLEAN_TYPES = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "boolean": T.BooleanType(),
}
MONEY = T.DecimalType(18, 2)


@dataclass(frozen=True)
class ColumnSpec:
    original: str
    map_to: str
    py_type: str = "string"
    sql_type: str = "VARCHAR(255)"
    required: bool = True


@dataclass(frozen=True)
class SourceSpec:
    source: str
    table: str
    columns: tuple[ColumnSpec, ...] = ()
    files: tuple[str, ...] = ()
    multiline: bool = False
    escape: str = '"'
    duplicate_keys: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        return [c.map_to for c in self.columns]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> SourceSpec:
        raw = json.loads(text)
        raw["columns"] = tuple(ColumnSpec(**c) for c in raw["columns"])
        for key in ("files", "duplicate_keys"):
            raw[key] = tuple(raw[key])
        return SourceSpec(**raw)


def normal_header(header: str) -> str:
    """Header without byte-order mark and outer blanks."""
    return header.replace("﻿", "").strip()


def snake_case(header: str) -> str:
    return re.sub(r"[\W_]+", "_", header.strip().lower()).strip("_")


def canonical_name(header: str, source: str, use_patterns: bool = False) -> str:
    """Canonical column name of a raw header of ``source``."""
    mapped = RENAMES.get(source, {}).get(header)
    if mapped is not None:
        return mapped
    if use_patterns:
        for pattern, name in HEADER_PATTERNS.items():
            if re.search(pattern, header.strip().lower()):
                return name
    name = snake_case(header)
    return "source_id" if name == "id" else name


def type_by_name(name: str, header: str) -> str | None:
    """Type decided by names alone, or None when a sample of values has to decide."""
    if name in NAME_TYPES:
        return NAME_TYPES[name]
    if "date" in name or any(d in name for d in DATE_NAMES):
        return "date"
    header = header.lower()
    if any(word in header for word in CARD_HEADER_WORDS):
        return "string"
    if any(word in header for word in MONEY_HEADER_WORDS):
        return "float"
    return None


def final_type(name: str, guessed: str) -> str:
    """Last pass by name, so that a column has one type in every source."""
    if name in DATE_NAMES or "date" in name:
        return "date"
    if name in INTEGER_NAMES:
        return "integer"
    if name == "rrn":
        return "string"
    if any(word in name for word in MONEY_WORDS):
        return "float"
    return guessed


def sql_type(source: str, name: str, py_type: str) -> str:
    if name in TEXT_NAMES.get(source, ()):
        return SQL_TYPES["text"]
    if source == "payfort" and name == "time":
        return SQL_TYPES["time"]
    return SQL_TYPES.get(py_type, SQL_TYPES["string"])


def ordered_headers(source: str, headers: list[str]) -> list[str]:
    """Mapped headers first in map order, then the others in file order."""
    first = [h for h in RENAMES.get(source, {}) if h in headers]
    return first + [h for h in headers if h not in first]


def build_columns(source: str, headers: list[str], guessed: dict[str, str] | None = None,
                  use_patterns: bool = False) -> tuple[tuple[ColumnSpec, ...], list[str]]:
    """Column specs of one file and the headers left out because their target name is taken."""
    guessed = guessed or {}
    taken: dict[str, ColumnSpec] = {}
    skipped = []
    for header in ordered_headers(source, [normal_header(h) for h in headers]):
        name = canonical_name(header, source, use_patterns)
        if name in taken:
            skipped.append(header)
            continue
        py_type = final_type(name, type_by_name(name, header) or guessed.get(header, "string"))
        taken[name] = ColumnSpec(header, name, py_type, sql_type(source, name, py_type))
    return tuple(taken.values()), skipped


def merge_columns(per_file: list[tuple[ColumnSpec, ...]]) -> tuple[ColumnSpec, ...]:
    """Columns of all files of a source; the first definition of a name wins."""
    merged: dict[str, ColumnSpec] = {}
    for columns in per_file:
        for column in columns:
            merged.setdefault(column.map_to, column)
    return tuple(merged.values())


def default_spec(source: str) -> SourceSpec:
    """Spec of a known export."""
    columns, _ = build_columns(source, list(HEADERS[source]))
    return SourceSpec(source, source, columns, duplicate_keys=DUPLICATE_KEYS[source])


def check_config(config: dict, tables: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Validate a ``{"sources": {name: {"files": [...]}}}`` config and return the files per source."""
    if "sources" not in config:
        raise ValueError("'sources' missing from the configuration")
    seen: dict[str, str] = {}
    for source in config["sources"]:
        if source not in RENAMES:
            raise ValueError(f"no mapping defined for source: {source}")
        table = (tables or {}).get(source, source)
        if table in seen:
            raise ValueError(f"sources {seen[table]} and {source} share the target table {table}")
        seen[table] = source
    return {s: list(info.get("files", [])) for s, info in config["sources"].items()}


def clean_schema(spec: SourceSpec) -> T.StructType:
    """Schema of a cleaned source, lineage columns last."""
    fields = [T.StructField(c.map_to, CLEAN_TYPES.get(c.py_type, T.StringType())) for c in spec.columns]
    return T.StructType(fields + [
        T.StructField("data_source", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
    ])


def is_money(name: str) -> bool:
    return name == "transaction_amount" or name.endswith("_amount") or name.endswith("_total")


def table_schema(spec: SourceSpec) -> T.StructType:
    """Schema of the loaded table: lineage columns, then the configured columns with their SQL types."""
    by_sql = {"INTEGER": T.LongType(), "NUMERIC(18,2)": MONEY, "DATE": T.DateType()}
    fields = [
        T.StructField("data_source", T.StringType(), False),
        T.StructField("processed_at", T.TimestampType(), False),
        T.StructField("is_potential_duplicate", T.BooleanType(), False),
    ]
    for c in spec.columns:
        kind = MONEY if is_money(c.map_to) else by_sql.get(c.sql_type, T.StringType())
        fields.append(T.StructField(c.map_to, kind))
    return T.StructType(fields)
