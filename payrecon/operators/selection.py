"""Field selection and result shaping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from payrecon.session import staged

# ---------------------------------------------------------------------------
# Columns always returned, other spellings of view columns, name parts of the default choice.
# ---------------------------------------------------------------------------

ESSENTIAL = (
    "gateway_source", "gateway_order_id", "gateway_transaction_id", "amount", "status", "transaction_date",
    "authorization_code", "rrn", "payment_method", "response_code", "response_description", "is_auth",
    "is_capture", "is_refund", "is_void", "final_rrn", "final_authorization_code", "transaction_analysis",
    "transaction_outcome",
)

SYNONYMS = {
    "bank_authorization_code": "bank_auth_code",
    "bank_payment_online_transaction_id": "bank_payment_id",
    "bank_transaction_amount": "bank_amount",
    "checkout_v1_payment_id": "checkout_v1_payment_online_transaction_id",
    "checkout_v2_payment_id": "checkout_v2_payment_online_transaction_id",
    "checkout_v2_payment_method": "checkout_v2_payment_method_name",
    "checkout_v2_currency": "checkout_v2_currency_symbol",
    "payfort_payment_id": "payfort_payment_online_transaction_id",
    "tamara_payment_id": "tamara_payment_online_transaction_id",
    "tamara_transaction_amount": "tamara_txn_amount",
    "tamara_transaction_date": "tamara_txn_created_at_gmt_03_00",
    "tamara_order_created_at": "tamara_order_created_at_gmt_03_00",
    "portal_order_id": "portal_order_id_val",
}

DEFAULT_PATTERNS = (
    "id", "transaction_id", "amount", "status", "date", "time", "payment_method", "order", "customer", "currency",
    "reference", "authorization_code", "rrn", "source", "response", "gateway", "merchant",
)

CRITICAL_PATTERNS = (
    "gateway_source", "gateway_order_id", "gateway_transaction_id", "amount", "status", "transaction_date",
    "authorization_code", "rrn", "payment_method", "response_code", "final_rrn", "final_authorization_code",
    "transaction_analysis", "transaction_outcome", "bank_match_type", "order_id", "transaction_id",
)

PREFIXED = ("portal", "metabase", "bank", "checkout_v1", "checkout_v2", "payfort", "tamara")

# ---------------------------------------------------------------------------


@dataclass
class FieldReport:
    requested: int = 0
    available: int = 0
    missing: list[str] = field(default_factory=list)
    mapped: dict[str, str] = field(default_factory=dict)


def _synonym(name: str, available: set[str]) -> str | None:
    """The name itself if the view has it, else a synonym (in either direction) that it has."""
    if name in available:
        return name
    other = SYNONYMS.get(name)
    if other in available:
        return other
    return next((k for k, v in SYNONYMS.items() if v == name and k in available), None)


def full_name(source: str, name: str) -> str:
    """View name of a field chosen below a source; analysis fields carry no prefix."""
    if source not in PREFIXED or name.startswith(f"{source}_"):
        return name
    return f"{source}_{name}"


def resolve_fields(requested: dict[str, list[str]] | list[str] | None, available: list[str],
                   strict: bool = False) -> tuple[list[str], FieldReport]:
    """Columns to return, in alphabetical order, for the requested fields plus the essential ones.

    Unknown fields are left out and reported, or raise when ``strict``. Bank fields are ignored
    when the view has no bank columns.
    """
    have = set(available)
    if requested is None:
        names = list(available)
    elif isinstance(requested, dict):
        names = [full_name(s, n) for s, chosen in requested.items() for n in chosen]
    else:
        names = list(requested)
    if "bank_match_type" not in have:
        names = [n for n in names if not n.startswith("bank_")]
    report = FieldReport(requested=len(names), available=len(have))
    chosen = set(ESSENTIAL) & have
    for name in dict.fromkeys(names):
        found = _synonym(name, have)
        if found is None:
            report.missing.append(name)
            continue
        if found != name:
            report.mapped[name] = found
        chosen.add(found)
    if strict and report.missing:
        raise ValueError(f"unknown fields: {', '.join(report.missing)}")
    return sorted(chosen), report


def default_fields(available: list[str]) -> list[str]:
    return [n for n in available if any(p in n.lower() for p in DEFAULT_PATTERNS)]


def critical_fields(available: list[str]) -> list[str]:
    """Fields that stay chosen when all others are cleared."""
    return [n for n in available if any(p in n.lower() for p in CRITICAL_PATTERNS)]


def distinct_orders(df: DataFrame, key: str = "gateway_order_id") -> DataFrame:
    """One row per order: the smallest in the order of all columns (NULLs first), so the choice is stable.

    A minimum over whole rows combines map-side, whatever the number of rows of an order.
    """
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(key, "_row.*")


def first_rows(df: DataFrame, n: int, one_task: int = 10_000) -> DataFrame:
    """The first ``n`` rows in the order of all columns.

    Up to ``one_task`` rows are merged in one task. More are taken from a range-partitioned copy: whole partitions as
    long as they fit, and the rest from the next one, so no task holds more than a partition.
    """
    if n <= one_task:
        return df.orderBy(*df.columns).limit(n)
    part = "_part"
    ranges = staged(df.repartitionByRange(*df.columns).withColumn(part, F.spark_partition_id()), "ranges")
    left, whole, last = n, [], None
    for row in ranges.groupBy(part).count().orderBy(part).collect():
        if row["count"] > left:
            last = row[part]
            break
        whole.append(row[part])
        left -= row["count"]
    out = ranges.where(F.col(part) <= (whole[-1] if whole else -1)).drop(part)
    if last is not None and left:
        out = out.union(ranges.where(F.col(part) == last).drop(part).orderBy(*df.columns).limit(left))
    return out
