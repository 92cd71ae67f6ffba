"""The payment view: gateways unified, merged, classified and matched to bank lines, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from payrecon.functions import outcome as o
from payrecon.operators import gateways as g, lifecycle as lc
from payrecon.operators.duplicates import FLAG, flag_duplicates
from payrecon.operators.reconcile import BANK_COLUMNS, MATCH_TYPE, reconcile, tier_counts
from payrecon.plans.options import QueryOptions
from payrecon.session import staged

SCRIPT = QueryOptions(flavour="script")
PAYMENT_KEYS = (
    "gateway_source", "gateway_order_id", "gateway_transaction_id", "status", "amount", "final_rrn",
    "final_authorization_code")


def union_columns(flavour: str = "script") -> list[str]:
    """Columns of the linked union of the gateways."""
    own = [f"{name}_{c}" for name, columns in g.GATEWAY_COLUMNS.items() for c in columns]
    return [*g.COMMON, g.portal_id_name(flavour), *g.PORTAL_COLUMNS, *g.METABASE_COLUMNS, *own]


def view_columns(flavour: str = "script", bank: bool = True) -> list[str]:
    """Columns of the view in order: 126 with the bank, 107 without."""
    names = [*union_columns(flavour), *lc.GROUP_COLUMNS, *lc.ANALYSIS_COLUMNS]
    return [*names, *BANK_COLUMNS, MATCH_TYPE] if bank else names


def unify(tables: dict[str, DataFrame], flavour: str = "script",
          date_range: tuple[str, str] | None = None) -> DataFrame:
    """Union of the four gateways joined to metabase and portal."""
    links = g.order_links(tables["metabase"], tables["portal"], flavour, date_range)
    keyed = g.attach_links(g.gateway_rows(tables, flavour, g.keyed_gateways()), links, by_order=True)
    loose = g.attach_links(g.gateway_rows(tables, flavour, g.payment_only_gateways()), links, by_order=False)
    return g.widen(g.union_families(keyed, loose)).select(*union_columns(flavour))


def _analysed(rows: DataFrame, options: QueryOptions) -> DataFrame:
    """Merge, classify and filter rows that have their group columns."""
    rows = lc.with_outcome(rows, options.partial_refunds)
    if options.excluded_kinds():
        rows = rows.where(~F.col(o.KIND).isin(options.excluded_kinds()))
    rows = lc.final_columns(rows, options.merge_auth_capture, options.use_auth_rrn, options.use_auth_code)
    if options.merge_auth_capture:
        rows = lc.drop_merged_auth(rows)
    rows = lc.classify(rows, options.success_only)
    if options.min_amount is not None:
        rows = rows.where(F.col("amount") >= F.lit(options.min_amount))
    if options.max_amount is not None:
        rows = rows.where(F.col("amount") <= F.lit(options.max_amount))
    if options.payment_method is not None:
        rows = rows.where(F.col("payment_method") == options.payment_method)
    if options.status is not None:
        rows = rows.where(F.col("status") == options.status)
    return rows


def transactions(tables: dict[str, DataFrame], options: QueryOptions = SCRIPT) -> tuple[DataFrame, DataFrame]:
    """Analysed transactions: linked (with portal and metabase columns), and before linking.

    Everything that depends on gateway columns alone happens before the link join, so failed rows and merged
    authorisations never reach it, and the rows keep the partitioning by (order, payment) from one to the other.
    """
    keyed = g.gateway_rows(tables, options.flavour, g.keyed_gateways())
    loose = g.gateway_rows(tables, options.flavour, g.payment_only_gateways())
    links = g.order_links(tables["metabase"], tables["portal"], options.flavour, options.date_range)
    keyed_facts, loose_facts = lc.family_facts(keyed, loose, links)
    keyed = _analysed(lc.attach_facts(keyed, keyed_facts, null_safe=False), options)
    loose = _analysed(lc.attach_facts(loose, loose_facts), options)
    linked = g.union_families(
        g.attach_links(keyed, links, by_order=True), g.attach_links(loose, links, by_order=False))
    if not options.include_duplicates:
        linked = flag_duplicates(linked, PAYMENT_KEYS).where(~F.col(FLAG)).drop(FLAG)
    return linked, g.union_families(keyed, loose)


def payment_view(tables: dict[str, DataFrame], options: QueryOptions = SCRIPT) -> DataFrame:
    """All columns of the view: 126, or 107 without reconciliation. What is not selected from it is not read."""
    tx, unlinked = transactions(tables, options)
    if options.include_reconciliation:
        # Before linking there are more signatures than after it, but they are had without the link join. With a date range
        # there would be far more.
        signatures = unlinked if options.date_range is None else None
        rows = reconcile(tx, tables["bank"], options.tiers(), options.blank_keys_match, signatures, g.widen)
    else:
        rows = g.widen(tx)
    return rows.select(*view_columns(options.flavour, options.include_reconciliation))


def match_summary(tables: dict[str, DataFrame], options: QueryOptions = SCRIPT) -> DataFrame:
    """Rows and amount of the view by gateway and tier (NULL: unmatched), counted without making the view."""
    tx = transactions(tables, options)[0]
    return tier_counts(tx, tables["bank"], options.tiers() if options.include_reconciliation else (), options.blank_keys_match)


def stage_funnel(tables: dict[str, DataFrame], options: QueryOptions = SCRIPT) -> DataFrame:
    """Rows per stage, to see where an empty result comes from.

    The linked rows are labelled once with the last stage they reach and staged; the view and its matches are counted from the
    signatures of the successful ones, without making them. As in :func:`transactions`, group facts are taken before linking, so
    the gateways are linked once.
    """
    keyed = g.gateway_rows(tables, options.flavour, g.keyed_gateways())
    loose = g.gateway_rows(tables, options.flavour, g.payment_only_gateways())
    links = g.order_links(tables["metabase"], tables["portal"], options.flavour, options.date_range)
    keyed_facts, loose_facts = lc.family_facts(keyed, loose, links)
    linked = g.union_families(
        g.attach_links(lc.attach_facts(keyed, keyed_facts, null_safe=False), links, by_order=True),
        g.attach_links(lc.attach_facts(loose, loose_facts), links, by_order=False))
    rows = lc.with_outcome(linked, options.partial_refunds)
    merged = F.coalesce(~(F.col("is_auth") & (F.col("has_auth_in_group") == 1) & (F.col("has_capture_in_group") == 1)), F.lit(False))
    narrow = [*lc.GROUP, "status", "amount", "transaction_date", *lc.ANALYSIS_COLUMNS[:2]]
    rows = lc.final_columns(rows, options.merge_auth_capture, options.use_auth_rrn, options.use_auth_code)
    rows = staged(rows.select(*narrow, merged.alias("_merged"), (merged & F.col(o.OK)).alias("_good")), "funnel")
    raw = g.gateway_rows(tables, options.flavour).agg(F.count(F.lit(1)).alias("n")).select(F.array(
        F.struct(F.lit("1 gateway rows").alias("stage"), F.col("n").alias("n_rows"))).alias("x"))
    counts = rows.agg(F.count(F.lit(1)).alias("a"), F.count_if("_merged").alias("b"), F.count_if("_good").alias("c")).select(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.col(c).alias("n_rows"))
        for name, c in (("2 linked", "a"), ("3 merged", "b"), ("4 successful", "c"))]).alias("x"))
    tiers = options.tiers() if options.include_reconciliation else ()
    good = tier_counts(rows.where("_good"), tables["bank"], tiers, options.blank_keys_match, by=())
    ends = good.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("a"),
                    F.coalesce(F.sum(F.when(F.col(MATCH_TYPE).isNotNull(), F.col("n_rows"))), F.lit(0)).alias("b")).select(F.array(
        F.struct(F.lit("5 view").alias("stage"), F.col("a").alias("n_rows")),
        F.struct(F.lit("6 matched").alias("stage"), F.col("b").alias("n_rows"))).alias("x"))
    return raw.union(counts).union(ends).select(F.inline("x"))
