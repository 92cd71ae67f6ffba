"""The parameterised payment query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from payrecon.functions.outcome import response_category
from payrecon.operators.selection import FieldReport, distinct_orders, first_rows, resolve_fields
from payrecon.plans.options import QueryOptions
from payrecon.plans.payment_view import payment_view, view_columns
from payrecon.plans.view import refresh_named


def payment_query(tables: dict[str, DataFrame], fields: dict[str, list[str]] | list[str] | None = None,
                  options: QueryOptions = QueryOptions(), strict: bool = False) -> DataFrame:
    """Chosen columns of the payment view under the given options."""
    names, _ = query_fields(fields, options, strict)
    out = payment_view(tables, options).select(*names)
    if options.simplify_response_codes:
        out = out.withColumn("response_category", response_category())
    if options.distinct_orders:
        out = distinct_orders(out)
    if options.limit:
        out = first_rows(out, options.limit)
    return out


def query_fields(fields: dict[str, list[str]] | list[str] | None, options: QueryOptions = QueryOptions(),
                 strict: bool = False) -> tuple[list[str], FieldReport]:
    """Columns a query would return and the report on the requested fields."""
    return resolve_fields(fields, view_columns(options.flavour, options.include_reconciliation), strict)


def query_to_json(fields: dict[str, list[str]] | list[str] | None, options: QueryOptions) -> str:
    """A saved query: chosen fields and options."""
    return json.dumps({"fields": fields, "options": json.loads(options.to_json())}, indent=2)


def query_from_json(text: str) -> tuple[dict[str, list[str]] | list[str] | None, QueryOptions]:
    saved = json.loads(text)
    return saved.get("fields"), QueryOptions.from_json(json.dumps(saved.get("options", {})))


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """SQL with ``:name`` parameters (or ``{{name}}`` placeholders, read as such) over named frames and registered views."""
    for name in args:
        text = text.replace("'{{" + name + "}}'", f":{name}").replace("{{" + name + "}}", f":{name}")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    refresh_named(spark, text)
    return spark.sql(text, args=args)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
