"""Expected results of the registered queries as SQL over the test tables.

Written separately from the library: windows where the library aggregates and joins back, one theta join where
it uses two bucketed equi-joins, plain per-branch unions where it shares columns.
"""

from __future__ import annotations

from standin import oracle_with

MONEY = "DECIMAL(18,2)"

# target=source (or target alone when equal), per gateway and linked table
OWN = {
    "checkout_v1": "amount=transaction_amount status transaction_date payment_id=payment_online_transaction_id order_id "
                   "authorization_code rrn payment_method issuing_bank response_code response_description processor "
                   "card_wallet_type currency",
    "checkout_v2": "amount=transaction_amount status transaction_date=action_date_utc_1 "
                   "payment_id=payment_online_transaction_id order_id authorization_code rrn "
                   "payment_method=payment_method_name response_code response_description wallet "
                   "currency=currency_symbol co_badged_card",
    "payfort": "amount=transaction_amount status transaction_date payment_id=payment_online_transaction_id order_id "
               "authorization_code rrn payment_method payment_method_type acquirer_name merchant_country channel mid "
               "currency time",
    "tamara": "amount=txn_amount status transaction_date=txn_created_at_gmt_03_00 "
              "payment_id=payment_online_transaction_id portal_order_id=order_id txn_reference=tamara_txn_reference "
              "payment_method customer_name txn_type txn_settlement_status order_currency country_code store_name "
              "total_amount order_created_at=order_created_at_gmt_03_00",
}
PORTAL = ("amount=transaction_amount gateway status payment_method transaction_date customer_name chef_name chef_total "
          "commission_amount delivery_type discount_type ispaid transaction_id wallet_paid_amount "
          "promo_code_total_discount")
METABASE = ("amount=transaction_amount status gateway portal_order_id app_version platform order_status order_total "
            "hyperpay_transaction_id success transactiontype")
BANK = ("auth_code=authorization_code rrn amount=transaction_amount transaction_date transaction_type status bank_name "
        "card_type cashback_amount discount_amount masked_card merchant_identifier "
        "payment_id=payment_online_transaction_id posting_date terminal_identifier total_payment_amount "
        "transaction_link_url vat_amount")
COMMON = ("gateway_source, gateway_order_id, gateway_transaction_id, amount, status, transaction_date, "
          "authorization_code, rrn, payment_method, response_code, response_description, is_auth, is_capture, "
          "is_refund, is_void")


def prefixed(prefix: str, alias: str, columns: str) -> str:
    out = []
    for item in columns.split():
        name, _, source = item.partition("=")
        out.append(f'{alias}."{source or name}" AS {prefix}_{name}')
    return ", ".join(out)


def flags(gateway: str, flavour: str) -> str:
    if gateway == "tamara":
        return ("s.txn_type = 'AUTHORIZE' AS is_auth, FALSE AS is_capture, s.txn_type = 'REFUND' AS is_refund, "
                "s.txn_type = 'CANCEL' AS is_void")
    both = "regexp_matches(upper(s.status), 'AUTHORI[SZ]ATION')"
    auth = {"payfort": "upper(s.status) LIKE '%AUTHORIZATION%'"}.get(
        gateway, both if flavour == "generated" else "upper(s.status) LIKE '%AUTHORISATION%'")
    void = "upper(s.status) LIKE '%VOID%'" + (" OR upper(s.status) = 'CANCEL'" if flavour == "generated" else "")
    return (f"({auth}) AS is_auth, upper(s.status) LIKE '%CAPTURE%' AS is_capture, "
            f"upper(s.status) LIKE '%REFUND%' AS is_refund, ({void}) AS is_void")


HEADS = {
    "checkout_v1": "s.transaction_amount AS amount, s.status, s.transaction_date, s.authorization_code, s.rrn, "
                   "s.payment_method, s.response_code, s.response_description",
    "checkout_v2": "s.transaction_amount AS amount, s.status, s.action_date_utc_1 AS transaction_date, "
                   "s.authorization_code, s.rrn, s.payment_method_name AS payment_method, s.response_code, "
                   "s.response_description",
    "payfort": "s.transaction_amount AS amount, s.status, s.transaction_date, s.authorization_code, s.rrn, "
               "s.payment_method, '' AS response_code, '' AS response_description",
    "tamara": "s.txn_amount AS amount, s.status, s.txn_created_at_gmt_03_00 AS transaction_date, "
              "'' AS authorization_code, s.tamara_txn_reference AS rrn, s.payment_method, '' AS response_code, "
              "'' AS response_description",
}


def union(flavour: str = "script", dates: tuple[str, str] | None = None) -> str:
    """CTEs up to ``u``: the linked union with all its columns."""
    order_id = "order_id" if flavour == "script" else "portal_order_id_val"
    parts = []
    for name, head in HEADS.items():
        link = "s.payment_online_transaction_id = m.gateway_transaction_id"
        if name != "tamara":
            link += " AND s.order_id = m.gateway_order_id"
        where = f" WHERE p.transaction_date BETWEEN DATE '{dates[0]}' AND DATE '{dates[1]}'" if dates else ""
        parts.append(
            f"SELECT '{name}' AS gateway_source, s.order_id AS gateway_order_id, "
            f"s.payment_online_transaction_id AS gateway_transaction_id, {head}, {flags(name, flavour)}, "
            f"p.order_id AS {order_id}, {prefixed('portal', 'p', PORTAL)}, {prefixed('metabase', 'm', METABASE)}, "
            f"{prefixed(name, 's', OWN[name])} FROM {name} s JOIN metabase m ON {link} "
            f"JOIN portal p ON m.portal_order_id = p.order_id{where}")
    return oracle_with() + ",\nu AS (" + "\nUNION ALL BY NAME\n".join(parts) + ")"


GROUPED = """,
g AS (SELECT u.*,
  CAST(max(coalesce(is_auth, FALSE)) OVER w AS INT) AS has_auth_in_group,
  CAST(max(coalesce(is_capture, FALSE)) OVER w AS INT) AS has_capture_in_group,
  max(rrn) FILTER (is_auth) OVER w AS auth_rrn_in_group,
  max(authorization_code) FILTER (is_auth) OVER w AS auth_authorization_code_in_group
  FROM u WINDOW w AS (PARTITION BY gateway_order_id, gateway_transaction_id))"""


def analysed(success: bool = True, merge: bool = True, auth_code: bool = True, partial: bool = True,
             where: str = "TRUE") -> str:
    """CTEs ``f`` (final columns and verdict) and ``ta`` (rows that stay, labelled)."""
    refunded = "'FULLY_REFUNDED', 'PARTIALLY_REFUNDED'" if partial else "'FULLY_REFUNDED'"
    take = "is_capture AND has_auth_in_group + has_capture_in_group = 2" if merge else "FALSE"
    take_code = take if auth_code else "FALSE"
    stays = "(NOT (is_auth AND has_auth_in_group + has_capture_in_group = 2))" if merge else "TRUE"
    return f""",
f AS (SELECT g.*, if({take}, auth_rrn_in_group, rrn) AS final_rrn,
  if({take_code}, auth_authorization_code_in_group, authorization_code) AS final_authorization_code,
  CASE WHEN is_refund THEN 'r' WHEN is_void OR upper(status) = 'CANCEL' THEN 'v' WHEN is_capture THEN 'c'
    WHEN is_auth THEN 'a' ELSE 'o' END AS k,
  CASE k WHEN 'r' THEN upper(status) IN ({refunded}) WHEN 'v' THEN upper(status) = 'CANCELED'
    ELSE upper(status) = 'APPROVED' END AS by_status,
  coalesce(response_code = '10000', FALSE) OR coalesce(by_status, FALSE) AS ok,
  'Check Response: ' || response_code || ')' AS hint FROM g),
ta AS (SELECT * EXCLUDE (k, by_status, ok, hint),
  CASE k || CAST(ok AS INT)
    WHEN 'r1' THEN 'Refund Successful' WHEN 'r0' THEN 'Refund Failed/Pending'
    WHEN 'v1' THEN 'Void Successful' WHEN 'v0' THEN 'Void Failed/Pending'
    WHEN 'c1' THEN if(has_auth_in_group = 0, 'Capture Successful (auth_less)', 'Capture Successful (Authorisation Merged)')
    WHEN 'c0' THEN if(has_auth_in_group = 0, 'Capture Failed/Pending (auth_less)', 'Capture Failed/Pending (' || hint)
    WHEN 'a1' THEN 'Authorisation Successful' WHEN 'a0' THEN 'Authorisation Failed (' || hint
    WHEN 'o1' THEN if(response_code = '10000', 'General Success (Code 10000)', 'General Success (Approved)')
    ELSE CASE WHEN response_code <> '' THEN 'General Failure (Code: ' || response_code || ')'
      WHEN upper(status) IN ('DECLINED', 'FAILED') THEN 'General Failure (Declined/Failed)'
      ELSE 'Unknown/Incomplete Status' END END AS transaction_analysis,
  if(ok, 'Success', 'Failure') AS transaction_outcome
  FROM f WHERE {stays} AND {'ok' if success else 'TRUE'} AND ({where}))"""


LABELS = [
    ("a AND r", "exact", "MATCH: Authorization Code + RRN + Amount"),
    ("r", "exact", "MATCH: RRN + Amount"),
    ("a", "exact", "MATCH: Authorization Code + Amount"),
    ("a AND d", "exact", "FALLBACK MATCH: Authorization Code + Same Day + Amount"),
    ("r", "approx", "PARTIAL MATCH: RRN + Approx Amount"),
    ("a", "approx", "PARTIAL MATCH: Authorization Code + Approx Amount"),
    ("a AND d", "approx", "PARTIAL MATCH: Authorization Code + Same Day + Approx Amount"),
]


def matched(tiers: list[int] = [1, 2, 3, 4, 5, 6, 7], exact: str = "0.01", approx: str = "1.00",
            blank: bool = True) -> str:
    """CTE ``v``: every transaction with each bank line that reaches one of the tiers."""
    size = {"exact": exact, "approx": approx}
    some = "" if blank else " AND {} <> ''"
    parts = {
        "r": "(ta.final_rrn = b.rrn" + some.format("b.rrn") + ")",
        "a": "(ta.final_authorization_code = b.authorization_code" + some.format("b.authorization_code") + ")",
        "d": "(ta.transaction_date = b.transaction_date)",
    }
    tests = []
    for n in tiers:
        keys, tolerance, label = LABELS[n - 1]
        test = " AND ".join(parts[k] for k in keys.split(" AND "))
        tests.append((f"({test} AND abs(ta.amount - b.transaction_amount) <= {size[tolerance]})", label))
    condition = " OR ".join(t for t, _ in tests)
    case = " ".join(f"WHEN {t} THEN '{label}'" for t, label in tests)
    return (f",\nv AS (SELECT ta.*, {prefixed('bank', 'b', BANK)}, CASE {case} END AS bank_match_type "
            f"FROM ta LEFT JOIN bank b ON {condition})")


def view(flavour: str = "script", dates: tuple[str, str] | None = None, bank: str | None = "", **kw) -> str:
    sql = union(flavour, dates) + GROUPED + analysed(**kw)
    return sql + (matched() if bank == "" else bank or "")


KEYS = "gateway_source, gateway_order_id, gateway_transaction_id, amount, status, transaction_date"
ESSENTIAL = COMMON + ", final_rrn, final_authorization_code, transaction_analysis, transaction_outcome"
TIER_SUMMARY = ("\nSELECT gateway_source, bank_match_type, count(*) AS n_rows, "
                "CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount FROM v GROUP BY ALL")
FLAG_SUMMARY = "\nSELECT gateway_source, status, is_auth, is_capture, is_refund, is_void, count(*) AS n_rows FROM u GROUP BY ALL"
LABEL_COLUMNS = KEYS + ", final_rrn, final_authorization_code, transaction_analysis, transaction_outcome"
LABEL_ROWS = f"\nSELECT {LABEL_COLUMNS} FROM ta"

DIRTY = oracle_with(("dirty",)).replace("WITH pay_lines AS", "WITH unused_lines AS") + "\n"

AMOUNT = ("CASE WHEN trim(amount_raw) IN ('', 'N/A') THEN NULL "
          "ELSE TRY_CAST(regexp_replace(amount_raw, '[^0-9.-]', '', 'g') AS DOUBLE) END")
INTEGER = ("CASE WHEN regexp_full_match(int_raw, '[0-9]+(\\.0*)?') "
           "THEN CAST(split_part(int_raw, '.', 1) AS BIGINT) END")


def day(adjust: int = 1, formats: str = "'%d/%m/%Y', '%Y-%m-%d', '%Y%m%d'") -> str:
    return ("CASE WHEN date_raw IN ('None', '') THEN NULL WHEN regexp_full_match(date_raw, '[0-9]{5}') "
            f"THEN DATE '1899-12-30' + (CAST(date_raw AS INT) - {adjust}) "
            f"ELSE CAST(try_strptime(date_raw, [{formats}]) AS DATE) END")


# Times of day computed from the numbers that the raw text was made of.
CLOCK = "lpad(CAST({} AS VARCHAR), 2, '0') || ':' || lpad(CAST({} AS VARCHAR), 2, '0') || ':' || lpad(CAST({} AS VARCHAR), 2, '0')"
TIME = ("CASE k % 5 WHEN 0 THEN " + CLOCK.format("k % 24", "k % 60", "c % 60")
        + " WHEN 1 THEN " + CLOCK.format("(k % 12 + 1) % 12 + if(c % 2 = 0, 0, 12)", "k % 60", "0")
        + " WHEN 2 THEN " + CLOCK.format("(c % 64) * 1350 // 3600", "(c % 64) * 1350 % 3600 // 60", "(c % 64) * 1350 % 60") + " END")
BOOL = "CASE WHEN bool_raw IN ('Yes', 'ON') THEN TRUE WHEN bool_raw IN ('f', 'failure') THEN FALSE END"
STRING = ("regexp_replace(replace(trim(CASE WHEN text_raw LIKE '=\"%\"' THEN substr(text_raw, 3, length(text_raw) - 3) "
          "ELSE text_raw END, ' ' || chr(10)), chr(10), ' '), '[\\x00-\\x1F\\x7F]', '', 'g')")
TEXT = (f"regexp_replace(replace(replace(replace(replace({STRING}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), "
        "'&quot;', '\"'), '\\s+', ' ', 'g')")
HEX = "lower(replace(replace(trim(replace(replace(uuid_raw, 'urn:', ''), 'uuid:', ''), '{}'), '-', ''), ' ', ''))"
UUID = (f"CASE WHEN regexp_full_match({HEX}, '[0-9a-f]{{32}}') THEN CAST(TRY_CAST({HEX} AS UUID) AS VARCHAR) END")

CONTROL = "regexp_replace(text_raw, '[\\x00-\\x1F\\x7F]', '', 'g')"
NO_BREAKS = STRING.replace("text_raw", CONTROL)
NOTE = (f"regexp_replace(replace(replace(replace(replace({NO_BREAKS}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), "
        "'&quot;', '\"'), '\\s+', ' ', 'g')")

DATES = ("1995-01-01", "1995-12-31")

# By which columns rows of an export count as repeated.
EXPORT_KEYS = {
    "portal": ("order_id", "transaction_date", "payment_method"),
    "metabase": ("portal_order_id",),
    "checkout_v1": ("order_id", "rrn"),
    "checkout_v2": ("rrn", "order_id"),
    "payfort": ("order_id", "authorization_code", "transaction_amount"),
    "tamara": ("payment_online_transaction_id", "tamara_txn_reference"),
    "bank": ("masked_card", "transaction_amount", "authorization_code"),
}


def all_queries() -> dict[str, str]:
    full = view()
    q = {
        "gateway_union": union() + "\nSELECT * FROM u",
        "gateway_flags_script": union() + FLAG_SUMMARY,
        "gateway_flags_generated": union("generated") + FLAG_SUMMARY,
        "auth_capture_groups": union() + GROUPED + f"\nSELECT {COMMON}, has_auth_in_group, has_capture_in_group, "
                               "auth_rrn_in_group, auth_authorization_code_in_group FROM g",
        "auth_capture_merge": view(bank=None, success=False)
                              + f"\nSELECT {KEYS}, rrn, authorization_code, final_rrn, final_authorization_code FROM ta",
        "removed_auth_rows": union() + GROUPED + f"\nSELECT {KEYS}, rrn, authorization_code FROM g WHERE "
                             "(is_auth AND has_auth_in_group + has_capture_in_group = 2) IS DISTINCT FROM FALSE",
        "transaction_labels_all": view(bank=None, success=False) + LABEL_ROWS,
        "transaction_labels_success": view(bank=None) + LABEL_ROWS,
        "outcome_summary": view(bank=None, success=False)
                           + "\nSELECT gateway_source, is_auth, is_capture, is_refund, is_void, transaction_analysis, "
                             "count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount FROM ta GROUP BY ALL",
        "bank_match_pairs": full + f"\nSELECT {KEYS}, bank_auth_code, bank_rrn, bank_amount, bank_transaction_date, "
                                   "bank_match_type FROM v WHERE bank_match_type IS NOT NULL",
        "bank_match_tiers": full + TIER_SUMMARY,
        "bank_match_unmatched": full + f"\nSELECT {KEYS}, final_rrn, final_authorization_code FROM v "
                                       "WHERE bank_match_type IS NULL",
        "bank_match_no_blank": view(bank=matched(blank=False)) + TIER_SUMMARY,
        "bank_match_options_sameday": view(bank=matched([1, 2, 4, 5, 7])) + TIER_SUMMARY,
        "bank_match_exact_only": view(bank=matched([1, 2, 3, 4])) + TIER_SUMMARY,
        "bank_match_auth_only": view(bank=matched([3, 6])) + TIER_SUMMARY,
        "bank_match_tolerances": view(bank=matched(exact="0.05", approx="5.00")) + TIER_SUMMARY,
        "payment_view_script": full + "\nSELECT * FROM v",
        "payment_view_generated": view("generated") + "\nSELECT * FROM v",
        "payment_view_no_bank": view("generated", bank=None) + "\nSELECT * FROM ta",
        "payment_view_date_range": view("generated", DATES) + "\nSELECT * FROM v",
        "distinct_orders": view("generated", bank=None)
                           + f", d AS (SELECT {ESSENTIAL} FROM ta)\nSELECT * FROM d QUALIFY row_number() OVER "
                             "(PARTITION BY gateway_order_id ORDER BY " + _nulls_first(_sorted(ESSENTIAL)) + ") = 1",
        "limited_rows": view("generated", bank=None) + f"\nSELECT {ESSENTIAL} FROM ta ORDER BY "
                        + _nulls_first(_sorted(ESSENTIAL)) + " LIMIT 500",
        "field_selection": view("generated") + f"\nSELECT {ESSENTIAL}, portal_chef_name, portal_order_id_val, "
                           "metabase_platform, checkout_v1_payment_id, tamara_order_created_at, bank_auth_code, "
                           "bank_amount, bank_match_type FROM v",
        "option_merge_off": view("generated", bank=None, merge=False) + LABEL_ROWS,
        "option_auth_rrn_only": view("generated", bank=None, auth_code=False) + LABEL_ROWS,
        "option_kinds": view("generated", bank=None, where="k NOT IN ('r', 'v')") + LABEL_ROWS,
        "option_partial_refunds": view("generated", bank=None, partial=False) + LABEL_ROWS,
        "option_response_categories": view("generated", bank=None, success=False)
                                      + "\nSELECT gateway_source, CASE WHEN response_code = '10000' THEN 'approved' "
                                        "WHEN response_code = '' THEN 'none' ELSE 'declined' END AS response_category, "
                                        "count(*) AS n_rows FROM ta GROUP BY ALL",
        "saved_filters": view("generated", DATES, bank=None,
                              where="amount BETWEEN 1000 AND 30000 AND payment_method = 'card' AND status = 'Capture'")
                         + LABEL_ROWS,
        "without_duplicates": view("generated", bank=None) + LABEL_ROWS
                              + " QUALIFY count(*) OVER (PARTITION BY gateway_source, gateway_order_id, "
                                "gateway_transaction_id, status, amount, final_rrn, final_authorization_code) = 1",
        "sql_with_parameters": "SELECT o_orderstatus AS status, count(*) AS n_rows FROM orders WHERE CAST(o_orderdate AS DATE) "
                               f"BETWEEN DATE '{DATES[0]}' AND DATE '{DATES[1]}' GROUP BY ALL",
        "view_after_changes": full.replace("pay_lines WHERE order_id % 4 = 0", "pay_lines WHERE order_id % 8 = 0").replace(
            "pay_lines WHERE l_linestatus = 'F'",
            "pay_lines WHERE l_linestatus = 'F' AND (l_suppkey % 3 = 2 OR rrn NOT LIKE '%7')") + TIER_SUMMARY,
        "view_count": full + "\nSELECT count(*) AS n_rows FROM v",
        "stage_funnel": full + """
SELECT '1 gateway rows' AS stage, count(*) AS n_rows FROM pay_lines UNION ALL
SELECT '2 linked', count(*) FROM u UNION ALL
SELECT '3 merged', count(*) FROM f WHERE NOT (is_auth AND has_auth_in_group + has_capture_in_group = 2) UNION ALL
SELECT '4 successful', count(*) FROM ta UNION ALL
SELECT '5 view', count(*) FROM v UNION ALL
SELECT '6 matched', count(*) FROM v WHERE bank_match_type IS NOT NULL""",
        "clean_integer": DIRTY + f"SELECT k, {INTEGER} AS int_value FROM dirty",
        "clean_float": DIRTY + f"SELECT k, {AMOUNT} AS float_value FROM dirty",
        "clean_date": DIRTY + f"SELECT k, {day()} AS date_value, {day(0)} AS calendar_value FROM dirty",
        "clean_date_by_source": DIRTY + f"SELECT k, {day()} AS portal_value, "
                                + day(formats="'%m/%d/%Y', '%d/%m/%Y', '%Y-%m-%d', '%Y%m%d'")
                                + " AS checkout_value FROM dirty",
        "clean_time": DIRTY + f"SELECT k, {TIME} AS time_value FROM dirty",
        "clean_string": DIRTY + f"SELECT k, {STRING} AS string_value FROM dirty",
        "clean_boolean": DIRTY + f"SELECT k, {BOOL} AS bool_value FROM dirty",
        "clean_uuid": DIRTY + f"SELECT k, {UUID} AS uuid_value FROM dirty",
        "clean_text": DIRTY + f"SELECT k, {TEXT} AS text_value FROM dirty",
        "clean_source_conformed": DIRTY + f"""SELECT {INTEGER} AS order_id, {AMOUNT} AS transaction_amount,
  {day()} AS transaction_date, {TIME} AS paid_at, {BOOL} AS ispaid, {UUID} AS token, {NOTE} AS note,
  CAST(NULL AS VARCHAR) AS customer_name, 'portal' AS data_source, TIMESTAMP '2024-01-01 00:00:00' AS processed_at
  FROM dirty""",
        "duplicate_flags": oracle_with() + """
SELECT order_id, authorization_code, transaction_amount, status, rrn,
  count(*) OVER (PARTITION BY order_id, authorization_code, transaction_amount) > 1 AS is_potential_duplicate FROM payfort""",
        "duplicate_flags_per_day": oracle_with() + """
SELECT masked_card, transaction_amount, authorization_code, posting_date,
  count(*) OVER (PARTITION BY masked_card, transaction_amount, authorization_code, posting_date) > 1
  AS is_potential_duplicate FROM bank""",
        "duplicate_report": oracle_with() + """,
n AS (SELECT count(*) AS n FROM payfort GROUP BY order_id, authorization_code, transaction_amount)
SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_flagged,
  round(100.0::DOUBLE * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 1) AS pct_flagged,
  count(*) FILTER (n > 1) AS n_groups, 100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n) > 80 AS alarm FROM n""",
        "null_rate_report": DIRTY + f""", p AS (SELECT *, {day()} AS d, {TIME} AS t FROM dirty),
r AS (SELECT 'date' AS column_name, date_raw AS raw, d IS NULL AS bad,
  d IS NULL AND lower(date_raw) NOT IN ('none', 'nan') AND date_raw <> '<NA>' AS failed FROM p
  UNION ALL SELECT 'time', time_raw, t IS NULL,
  t IS NULL AND lower(time_raw) NOT IN ('none', 'nan') AND time_raw <> '<NA>' FROM p)
SELECT column_name, count(*) AS n_rows, count(*) FILTER (bad) AS n_null, count(*) FILTER (failed) AS n_unparsed,
  round(count(*) FILTER (bad) / count(*), 4) AS null_rate, count(*) FILTER (bad) / count(*) > 0.5 AS alarm,
  array_to_string(list_sort(list_distinct(list(raw) FILTER (failed)))[1:5], '|') AS samples FROM r GROUP BY 1""",
        "boolean_report": DIRTY + """SELECT count(DISTINCT lower(bool_raw)) AS n_distinct, count(*) AS n_rows,
  array_to_string(list_sort(list_distinct(list(lower(bool_raw))))[1:5], '|') AS samples
  FROM dirty WHERE bool_raw NOT IN ('Yes', 'f', 'ON', 'failure')""",
        "uuid_report": DIRTY + f"SELECT count(*) AS n_rows, count(*) FILTER (({UUID}) IS NULL) AS n_invalid FROM dirty",
        "amount_profile": oracle_with() + """
SELECT count(*) AS n_rows, count(*) FILTER (transaction_amount IS NULL) AS n_null,
  array_to_string(list_sort(list_distinct(list(transaction_amount)))[1:5], '|') AS samples FROM bank""",
        "infer_types": """
WITH raw AS (SELECT strftime(o_orderdate, '%d.%m.%Y') AS shipped, CAST(o_orderpriority AS VARCHAR) AS priority,
  'id-' || o_orderkey AS id FROM orders),
sampled AS (SELECT 'Shipped' AS column_name, 'shipped' AS map_to, shipped AS v FROM raw
  UNION ALL SELECT 'Priority', 'priority', priority FROM raw UNION ALL SELECT 'ID', 'source_id', id FROM raw),
typed AS (SELECT column_name, map_to,
  if(2 * count(try_strptime(v, ['%d.%m.%Y', '%Y-%m-%d', '%d/%m/%Y'])) >= count(v), 'date', 'string') AS py_type
  FROM sampled GROUP BY ALL)
SELECT *, if(py_type = 'date', 'DATE', 'VARCHAR(255)') AS sql_type FROM typed UNION ALL
SELECT * FROM (VALUES
  ('Order Id', 'order_id', 'integer', 'INTEGER'), ('Order Total', 'transaction_amount', 'float', 'NUMERIC(18,2)'),
  ('Delivery Date', 'transaction_date', 'date', 'DATE'), ('Customer Name', 'customer_name', 'string', 'TEXT'),
  ('Card', 'card', 'string', 'VARCHAR(255)'))
  t(column_name, map_to, py_type, sql_type)""",
        "scan_csv_roundtrip": oracle_with() + """
SELECT order_id, CAST(transaction_amount AS DOUBLE) AS transaction_amount, transaction_date, payment_method,
  coalesce(customer_name, '') AS customer_name, 'say "' || discount_type || '", ok' AS note,
  count(*) OVER (PARTITION BY order_id, transaction_date, payment_method) > 1 AS is_potential_duplicate FROM portal""",
        "ingest_parquet": oracle_with() + """
SELECT order_id, CAST(transaction_amount AS DOUBLE) AS transaction_amount, transaction_date, payment_method,
  'portal' AS data_source FROM portal""",
        "reingest_after_changes": oracle_with() + """
SELECT order_id, CAST(transaction_amount AS DOUBLE) AS transaction_amount, transaction_date, payment_method,
  (SELECT count(*) FROM portal WHERE order_id % 4 = 1) AS n_read_again FROM portal WHERE order_id % 4 IN (1, 3)""",
        "load_verified": oracle_with() + """
SELECT 'bank' AS source, count(*) AS n_rows, TRUE AS verified FROM bank""",
        "load_conversions": DIRTY + f"""SELECT {INTEGER} AS order_id, CAST({AMOUNT} AS DECIMAL(18,2)) AS transaction_amount,
  {day()} AS transaction_date, FALSE AS is_potential_duplicate FROM dirty""",
        "scan_mixed_files": """
SELECT 'R' || o_orderkey AS rrn,
  CASE WHEN o_orderkey % 5 = 3 THEN 'Café ' || o_custkey || chr(10) || 'line two, R' || o_orderkey
    WHEN o_orderkey % 5 = 4 AND o_orderkey % 3 = 1 THEN '' ELSE 'Café ' || o_custkey END AS bank_name
FROM orders WHERE NOT (o_orderkey % 5 = 4 AND o_orderkey % 3 = 0)""",
        "scan_broken_lines": """
SELECT 'R' || o_orderkey AS rrn, CASE o_orderkey % 3 WHEN 0 THEN 'a' || chr(10) || ',' || o_orderpriority || chr(10) || chr(10) || '"q"' || chr(10)
  WHEN 1 THEN '5" pipe ' || o_orderpriority ELSE o_orderpriority END AS bank_name FROM orders""",
        "scan_both_escapes": """
SELECT 'R' || o_orderkey AS rrn, CASE o_orderkey % 3 WHEN 2 THEN 'c, R' || o_orderkey || chr(92)
  ELSE 'the "' || o_orderpriority || '", paid' END AS bank_name FROM orders""",
        "build_specs": """
WITH raw AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS d, CAST(o_orderkey AS VARCHAR) AS n FROM orders),
sampled AS (
  SELECT 'metabase' AS source, 'seen' AS map_to, 1 AS file, d AS v FROM raw UNION ALL SELECT 'metabase', 'code', 1, 'x' || n FROM raw UNION ALL
  SELECT 'metabase', 'settled', 2, d FROM raw UNION ALL SELECT 'bank', 'cleared', 1, d FROM raw UNION ALL
  SELECT 'bank', 'masked', 2, d || '*' FROM raw),
typed AS (SELECT source, map_to, if(2 * count(try_strptime(v, '%d/%m/%Y')) >= count(v), 'date', 'string') AS py_type FROM sampled GROUP BY ALL)
SELECT *, if(py_type = 'date', 'DATE', 'VARCHAR(255)') AS sql_type FROM typed UNION ALL
SELECT * FROM (VALUES ('metabase', 'portal_order_id', 'integer', 'INTEGER'), ('bank', 'masked_card', 'string', 'VARCHAR(255)'),
  ('bank', 'fee_amount', 'float', 'NUMERIC(18,2)')) t(source, map_to, py_type, sql_type)""",
        "encoding_audit": """
SELECT CAST(o_orderkey % 5 AS VARCHAR) AS style,
  CASE o_orderkey % 5 WHEN 1 THEN 'latin1' WHEN 2 THEN 'utf-16' ELSE 'utf-8' END AS encoding,
  CASE o_orderkey % 5 WHEN 2 THEN NULL WHEN 3 THEN 2 * count(*) ELSE count(*) END AS n_data_lines,
  CASE o_orderkey % 5 WHEN 1 THEN count(*) WHEN 2 THEN NULL ELSE 0 END AS n_invalid
FROM orders GROUP BY o_orderkey % 5""",
        "ingest_all": oracle_with() + ",\ncounted AS (" + "\nUNION ALL ".join(
            f"SELECT '{name}' AS source, count(*) AS n FROM {name} GROUP BY {', '.join(keys)}" for name, keys in EXPORT_KEYS.items())
            + ")\nSELECT source, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_flagged FROM counted GROUP BY source",
        "file_audit": """
WITH k AS (SELECT unnest(range(32)) AS k), o AS (SELECT DISTINCT o_orderkey % 32 AS k FROM orders)
SELECT 'k=' || k.k AS folder, if(o.k IS NULL, 'missing', 'not a file') AS status, if(o.k IS NULL, NULL, TRUE) AS all_ok
FROM k LEFT JOIN o ON o.k = k.k""",
        "discovered_files": "SELECT DISTINCT 'k=' || (o_orderkey % 32) AS folder, TRUE AS filled FROM orders",
        "result_preview": """
SELECT o_orderstatus, count(*) AS n_rows, (SELECT least(100, count(*)) FROM orders) AS n_few FROM orders GROUP BY o_orderstatus""",
        "table_audit": oracle_with() + "\n" + "\nUNION ALL ".join(
            f"SELECT 'audited_{name}' AS table_name, {'FALSE' if name == 'tamara' else 'TRUE'} AS is_there, "
            + ("FALSE" if name == "tamara" else f"(SELECT count(*) > 0 FROM {name} WHERE transaction_amount > {10**9 if name == 'payfort' else 1000})")
            + " AS holds_rows" for name in ("portal", "metabase", "checkout_v1", "checkout_v2", "payfort", "tamara", "bank")),
        "result_csv": view("generated", bank=None) + "\nSELECT " + ", ".join(
            f"coalesce(CAST({c.strip()} AS VARCHAR), '') AS {c.strip()}" for c in LABEL_COLUMNS.split(",")) + " FROM ta",
        "result_parquet": view("generated", bank=None) + f"\nSELECT {ESSENTIAL} FROM ta",
        "verify_per_file": oracle_with() + """,
n AS (SELECT strftime(posting_date, '%Y-%m') AS source_file, count(*) AS n_in,
  count(*) FILTER (NOT (month(posting_date) = 7 AND rrn LIKE '%3')) AS n_out FROM bank GROUP BY 1)
SELECT *, n_in = n_out AS agrees FROM n""",
        "csv_line_audit": """
SELECT CAST(o_orderkey % 5 AS VARCHAR) AS style, count(*) AS n_lines,
  count(*) FILTER (o_orderkey % 5 = 4 AND o_orderkey % 3 = 0) AS n_dropped FROM orders GROUP BY o_orderkey % 5""",
    }
    return q


def _sorted(columns: str) -> str:
    return ", ".join(sorted(c.strip() for c in columns.split(",")))


def _nulls_first(columns: str) -> str:
    return ", ".join(f"{c.strip()} NULLS FIRST" for c in columns.split(","))
