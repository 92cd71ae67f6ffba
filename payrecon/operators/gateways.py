"""Four gateways as one set of rows with common columns, linked to metabase and portal."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(18,2)"
FLAVOURS = ("script", "generated")


@dataclass(frozen=True)
class Gateway:
    """Where a gateway keeps the common columns, and which columns only it has."""

    amount: str = "transaction_amount"
    date: str = "transaction_date"
    auth: str | None = "authorization_code"
    rrn: str = "rrn"
    method: str = "payment_method"
    code: str | None = "response_code"
    text: str | None = "response_description"
    own: dict[str, str] = field(default_factory=dict)
    auth_words: dict[str, tuple[str, ...]] | None = None
    by_order: bool = True


# ---------------------------------------------------------------------------
# Columns and spellings of each gateway, columns of the view.
# ---------------------------------------------------------------------------

_BOTH_SPELLINGS = {"script": ("AUTHORISATION",), "generated": ("AUTHORISATION", "AUTHORIZATION")}
_Z_SPELLING = {"script": ("AUTHORIZATION",), "generated": ("AUTHORIZATION",)}

GATEWAYS = {
    "checkout_v1": Gateway(
        own={"issuing_bank": "issuing_bank", "processor": "processor", "card_wallet_type": "card_wallet_type",
             "currency": "currency"},
        auth_words=_BOTH_SPELLINGS),
    "checkout_v2": Gateway(
        date="action_date_utc_1", method="payment_method_name",
        own={"wallet": "wallet", "currency": "currency_symbol", "co_badged_card": "co_badged_card"},
        auth_words=_BOTH_SPELLINGS),
    "payfort": Gateway(
        code=None, text=None,
        own={"payment_method_type": "payment_method_type", "acquirer_name": "acquirer_name",
             "merchant_country": "merchant_country", "channel": "channel", "mid": "mid", "currency": "currency",
             "time": "time"},
        auth_words=_Z_SPELLING),
    "tamara": Gateway(
        amount="txn_amount", date="txn_created_at_gmt_03_00", auth=None, rrn="tamara_txn_reference", code=None,
        text=None,
        own={"customer_name": "customer_name", "txn_type": "txn_type",
             "txn_settlement_status": "txn_settlement_status", "order_currency": "order_currency",
             "country_code": "country_code", "store_name": "store_name", "total_amount": "total_amount",
             "order_created_at": "order_created_at_gmt_03_00"},
        by_order=False),
}

COMMON = (
    "gateway_source", "gateway_order_id", "gateway_transaction_id", "amount", "status", "transaction_date",
    "authorization_code", "rrn", "payment_method", "response_code", "response_description", "is_auth",
    "is_capture", "is_refund", "is_void",
)

PORTAL_COLUMNS = {
    "portal_amount": "transaction_amount",
    "portal_gateway": "gateway",
    "portal_status": "status",
    "portal_payment_method": "payment_method",
    "portal_transaction_date": "transaction_date",
    "portal_customer_name": "customer_name",
    "portal_chef_name": "chef_name",
    "portal_chef_total": "chef_total",
    "portal_commission_amount": "commission_amount",
    "portal_delivery_type": "delivery_type",
    "portal_discount_type": "discount_type",
    "portal_ispaid": "ispaid",
    "portal_transaction_id": "transaction_id",
    "portal_wallet_paid_amount": "wallet_paid_amount",
    "portal_promo_code_total_discount": "promo_code_total_discount",
}

METABASE_COLUMNS = {
    "metabase_amount": "transaction_amount",
    "metabase_status": "status",
    "metabase_gateway": "gateway",
    "metabase_portal_order_id": "portal_order_id",
    "metabase_app_version": "app_version",
    "metabase_platform": "platform",
    "metabase_order_status": "order_status",
    "metabase_order_total": "order_total",
    "metabase_hyperpay_transaction_id": "hyperpay_transaction_id",
    "metabase_success": "success",
    "metabase_transactiontype": "transactiontype",
}

# Per-gateway columns of the view, without the gateway's prefix.
GATEWAY_COLUMNS = {
    "checkout_v1": (
        "amount", "status", "transaction_date", "payment_id", "order_id", "authorization_code", "rrn",
        "payment_method", "issuing_bank", "response_code", "response_description", "processor",
        "card_wallet_type", "currency"),
    "checkout_v2": (
        "amount", "status", "transaction_date", "payment_id", "order_id", "authorization_code", "rrn",
        "payment_method", "response_code", "response_description", "wallet", "currency", "co_badged_card"),
    "payfort": (
        "amount", "status", "transaction_date", "payment_id", "order_id", "authorization_code", "rrn",
        "payment_method", "payment_method_type", "acquirer_name", "merchant_country", "channel", "mid",
        "currency", "time"),
    "tamara": (
        "amount", "status", "transaction_date", "payment_id", "portal_order_id", "txn_reference",
        "payment_method", "customer_name", "txn_type", "txn_settlement_status", "order_currency",
        "country_code", "store_name", "total_amount", "order_created_at"),
}

# Per-gateway columns that repeat a common column under another name.
REPEATS = {
    "payment_id": "gateway_transaction_id",
    "order_id": "gateway_order_id",
    "portal_order_id": "gateway_order_id",
    "txn_reference": "rrn",
}

TYPES = {
    "amount": MONEY, "chef_total": MONEY, "commission_amount": MONEY, "wallet_paid_amount": MONEY,
    "promo_code_total_discount": MONEY, "order_total": MONEY, "total_amount": MONEY, "transaction_amount": MONEY,
    "transaction_date": "date", "order_created_at": "date",
    "order_id": "bigint", "portal_order_id": "bigint",
}

# ---------------------------------------------------------------------------


def _typed(source: str, name: str | None = None) -> Column:
    return F.col(source).cast(TYPES.get(name or source, "string"))


def _flags(g: Gateway, flavour: str) -> dict[str, Column]:
    if g.auth_words is None:
        kind = F.col("txn_type")
        return {"is_auth": kind == "AUTHORIZE", "is_capture": F.lit(False), "is_refund": kind == "REFUND",
                "is_void": kind == "CANCEL"}
    status = F.upper("status")
    void = status.contains("VOID")
    if flavour == "generated":
        void = void | (status == "CANCEL")
    auth = reduce(Column.__or__, [status.contains(w) for w in g.auth_words[flavour]])
    return {"is_auth": auth, "is_capture": status.contains("CAPTURE"), "is_refund": status.contains("REFUND"),
            "is_void": void}


def gateway_common(df: DataFrame, name: str, flavour: str = "script") -> DataFrame:
    """One gateway's rows as the 15 common columns plus the columns only that gateway has."""
    if flavour not in FLAVOURS:
        raise ValueError(f"flavour must be one of {FLAVOURS}, not {flavour!r}")
    g = GATEWAYS[name]

    def text(source: str | None) -> Column:
        return F.lit("") if source is None else F.col(source).cast("string")

    common = {
        "gateway_source": F.lit(name),
        "gateway_order_id": F.col("order_id").cast("bigint"),
        "gateway_transaction_id": text("payment_online_transaction_id"),
        "amount": F.col(g.amount).cast(MONEY),
        "status": text("status"),
        "transaction_date": F.col(g.date).cast("date"),
        "authorization_code": text(g.auth),
        "rrn": text(g.rrn),
        "payment_method": text(g.method),
        "response_code": text(g.code),
        "response_description": text(g.text),
        **_flags(g, flavour),
    }
    own = [_typed(source, column).alias(f"{name}_{column}") for column, source in g.own.items()]
    return df.select(*[c.alias(n) for n, c in common.items()], *own)


def gateway_rows(tables: dict[str, DataFrame], flavour: str = "script",
                 names: Iterable[str] = tuple(GATEWAYS)) -> DataFrame:
    """All rows of the named gateways; columns of the other gateways are NULL."""
    parts = [gateway_common(tables[n], n, flavour) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keyed_gateways() -> tuple[str, ...]:
    """Gateways linked by order id and payment id."""
    return tuple(n for n, g in GATEWAYS.items() if g.by_order)


def payment_only_gateways() -> tuple[str, ...]:
    """Gateways linked by payment id alone."""
    return tuple(n for n, g in GATEWAYS.items() if not g.by_order)


def order_links(metabase: DataFrame, portal: DataFrame, flavour: str = "script",
                date_range: tuple[str, str] | None = None) -> DataFrame:
    """Metabase rows with their portal order: the link keys and all output columns of both.

    A date range filters the portal before the join, so that it reaches the portal scan.
    """
    id_name = portal_id_name(flavour)
    p = portal.select(
        F.col("order_id").cast("bigint").alias(id_name),
        *[_typed(source, _plain(name, "portal")).alias(name) for name, source in PORTAL_COLUMNS.items()])
    if date_range is not None:
        first, last = date_range
        p = p.where(F.col("portal_transaction_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    m = metabase.select(
        F.col("gateway_order_id").cast("bigint").alias("_link_order"),
        F.col("gateway_transaction_id").cast("string").alias("_link_payment"),
        *[_typed(source, _plain(name, "metabase")).alias(name) for name, source in METABASE_COLUMNS.items()])
    return m.join(p, m["metabase_portal_order_id"] == p[id_name])


def _plain(name: str, prefix: str) -> str:
    return name.removeprefix(prefix + "_")


def portal_id_name(flavour: str) -> str:
    return "order_id" if flavour == "script" else "portal_order_id_val"


def attach_links(rows: DataFrame, links: DataFrame, by_order: bool) -> DataFrame:
    """Inner join of gateway rows to their links; repeated keys fan out."""
    on = rows["gateway_transaction_id"] == links["_link_payment"]
    if by_order:
        on = (rows["gateway_order_id"] == links["_link_order"]) & on
    return rows.join(links, on).drop("_link_order", "_link_payment")


def union_families(keyed: DataFrame, payment_only: DataFrame) -> DataFrame:
    return keyed.unionByName(payment_only, allowMissingColumns=True)


def widen(df: DataFrame) -> DataFrame:
    """Add the per-gateway columns that repeat a common one.

    They are derived here, behind all shuffles, instead of travelling through them.
    """
    added = {}
    for name, columns in GATEWAY_COLUMNS.items():
        here = F.col("gateway_source") == name
        for column in columns:
            if column not in GATEWAYS[name].own:
                added[f"{name}_{column}"] = F.when(here, F.col(REPEATS.get(column, column)))
    return df.withColumns(added)
