"""Authorisations and captures of a payment: group facts, merge and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from payrecon.functions import outcome as o
from payrecon.session import staged

GROUP = ("gateway_order_id", "gateway_transaction_id")
GROUP_COLUMNS = (
    "has_auth_in_group", "has_capture_in_group", "auth_rrn_in_group", "auth_authorization_code_in_group")
_SPREAD = "_spread"
ANALYSIS_COLUMNS = ("final_rrn", "final_authorization_code", "transaction_analysis", "transaction_outcome")


def group_facts(rows: DataFrame) -> DataFrame:
    """One row per (order, payment) that has an authorisation or a capture.

    An aggregate with map-side combine: however many rows share a payment, each task sends one.
    Other groups have no row here and get the defaults in :func:`attach_facts`.

    The hash of the key as one more grouping column keeps the facts from being partitioned by the key itself. So
    the join to the rows shuffles both of its sides, and only such a join can AQE split at a hot key. The facts
    are narrow, and the wide rows are shuffled once either way.
    """
    auth = F.col("is_auth")
    return rows.where(auth | F.col("is_capture")).groupBy(F.xxhash64(*GROUP).alias(_SPREAD), *GROUP).agg(
        F.max(F.when(auth, 1).otherwise(0)).alias(GROUP_COLUMNS[0]),
        F.max(F.when(F.col("is_capture"), 1).otherwise(0)).alias(GROUP_COLUMNS[1]),
        F.max(F.when(auth, F.col("rrn"))).alias(GROUP_COLUMNS[2]),
        F.max(F.when(auth, F.col("authorization_code"))).alias(GROUP_COLUMNS[3]),
    )


def family_facts(keyed: DataFrame, payment_only: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts for the rows linked by order and payment, and for those linked by payment alone.

    Groups are formed over linked rows of all gateways, yet facts are taken before the (wide) link join.
    That is exact because linking depends on the group key only:

    * a keyed row survives iff its (order, payment) is linked, and then so do all rows of its group;
    * a payment-only row may survive while the keyed rows of its group do not, so keyed facts count
      for it only where (order, payment) is linked.

    One narrow aggregate over all gateways holds the facts of both families side by side.
    """
    needed = [*GROUP, "is_auth", "is_capture", "rrn", "authorization_code"]
    marked = F.coalesce(F.col("is_auth") | F.col("is_capture"), F.lit(False))
    rows = keyed.where(marked).select(F.lit(False).alias("_loose"), *needed).unionByName(
        payment_only.select(F.lit(True).alias("_loose"), *needed))

    def of(family: Column, prefix: str) -> list[Column]:
        auth = family & F.col("is_auth")
        columns = (F.max(F.when(auth, 1).otherwise(0)), F.max(F.when(family & F.col("is_capture"), 1).otherwise(0)),
                   F.max(F.when(auth, F.col("rrn"))), F.max(F.when(auth, F.col("authorization_code"))))
        return [c.alias(prefix + name) for c, name in zip(columns, GROUP_COLUMNS)]

    facts = rows.groupBy(F.xxhash64(*GROUP).alias(_SPREAD), *GROUP).agg(
        *of(~F.col("_loose"), "_k_"), *of(F.col("_loose"), "_l_"), F.max(F.when(marked, 1).otherwise(0)).alias("_any"),
        F.max("_loose").alias("_has_loose")).where("_any = 1 OR _has_loose")
    linked = links.select(F.col("_link_order").alias(GROUP[0]), F.col("_link_payment").alias(GROUP[1])).distinct().select(
        F.xxhash64(*GROUP).alias(_SPREAD), *GROUP, F.lit(True).alias("_linked"))
    # Narrow and read by both families: staged, so that the gateways are scanned for it once.
    facts = staged(facts.join(linked, [_SPREAD, *GROUP], "left"), "facts")

    def both(name: str, keyed_counts: Column) -> Column:
        return F.greatest(F.when(keyed_counts, F.col(f"_k_{name}")), F.col(f"_l_{name}")).alias(name)

    for_keyed = facts.where("_any = 1").select(_SPREAD, *GROUP, *[both(c, F.lit(True)) for c in GROUP_COLUMNS])
    for_loose = facts.where("_has_loose").select(_SPREAD, *GROUP, *[both(c, F.col("_linked")) for c in GROUP_COLUMNS])
    return for_keyed, for_loose


def attach_facts(rows: DataFrame, facts: DataFrame, null_safe: bool = True) -> DataFrame:
    """Add the four group columns; ``null_safe`` lets rows without an order id form groups too."""
    f = facts.select(*[F.col(g).alias(f"_{g}") for g in GROUP], *GROUP_COLUMNS)

    def same(name: str) -> Column:
        return rows[name].eqNullSafe(f[f"_{name}"]) if null_safe else rows[name] == f[f"_{name}"]

    joined = rows.join(f, same(GROUP[0]) & same(GROUP[1]), "left").drop(*[f"_{g}" for g in GROUP])
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in GROUP_COLUMNS[:2]})


def auth_capture_groups(df: DataFrame) -> DataFrame:
    """Group columns for any frame with the common gateway columns."""
    return attach_facts(df, group_facts(df))


def _both() -> Column:
    return (F.col("has_auth_in_group") == 1) & (F.col("has_capture_in_group") == 1)


def final_columns(df: DataFrame, merge: bool = True, use_auth_rrn: bool = True,
                  use_auth_code: bool = True) -> DataFrame:
    """``final_rrn`` and ``final_authorization_code``: a merged capture takes over the authorisation's."""
    take = F.col("is_capture") & _both()

    def final(own: str, auth: str, wanted: bool) -> Column:
        return F.when(take, F.col(auth)).otherwise(F.col(own)) if merge and wanted else F.col(own)

    return df.withColumns({
        "final_rrn": final("rrn", "auth_rrn_in_group", use_auth_rrn),
        "final_authorization_code": final(
            "authorization_code", "auth_authorization_code_in_group", use_auth_code),
    })


def drop_merged_auth(df: DataFrame) -> DataFrame:
    """Leave out authorisations merged into a capture.

    The negation stays three-valued on purpose: a row of unknown kind in a group with both is left out too.
    """
    return df.where(~(F.col("is_auth") & _both()))


def merged_auth_rows(df: DataFrame) -> DataFrame:
    """The rows :func:`drop_merged_auth` leaves out."""
    return df.where(~F.coalesce(~(F.col("is_auth") & _both()), F.lit(False)))


def with_outcome(df: DataFrame, partial_refunds: bool = True) -> DataFrame:
    """Add the helper columns ``_kind`` and ``_ok``, which need the gateway's own columns only."""
    return df.withColumn(o.KIND, o.kind()).withColumn(o.OK, o.succeeded(partial_refunds))


def classify(df: DataFrame, success_only: bool = True, partial_refunds: bool = True) -> DataFrame:
    """Add label and outcome; by default only successes are kept."""
    if o.OK not in df.columns:
        df = with_outcome(df, partial_refunds)
    if success_only:
        df = df.where(o.OK)
    return df.withColumns({
        "transaction_analysis": o.label(),
        "transaction_outcome": o.outcome(),
    }).drop(o.KIND, o.OK)


def outcome_summary(df: DataFrame) -> DataFrame:
    """Rows and amount by gateway, kind flags and label."""
    return df.groupBy("gateway_source", "is_auth", "is_capture", "is_refund", "is_void", "transaction_analysis").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("decimal(38,2)").alias("total_amount"))
