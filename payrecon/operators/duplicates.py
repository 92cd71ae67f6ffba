"""Potential duplicates: every member of a group of rows with equal keys is flagged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FLAG = "is_potential_duplicate"


def usable_keys(columns: list[str], keys: tuple[str, ...]) -> list[str]:
    """Keys present in the data: all of them, or what is left of them if that is two or more."""
    present = [k for k in dict.fromkeys(keys) if k in columns]
    return present if len(present) == len(set(keys)) or len(present) >= 2 else []


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"_dup_{k}"]) for k in keys])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups with more than one row, and their size (NULL keys are equal to each other)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def flag_duplicates(df: DataFrame, keys: tuple[str, ...], scope: tuple[str, ...] = ()) -> DataFrame:
    """Add the flag column; ``scope`` (e.g. the source file) limits what counts as a repetition.

    Group sizes are counted with map-side combine and joined back, so a group of any size
    is never brought together in one task as a window over the keys would.
    """
    used = usable_keys(df.columns, keys)
    if not used:
        return df.withColumn(FLAG, F.lit(False))
    used = [*used, *[s for s in scope if s not in used]]
    repeated = repeated_keys(df, used).select(
        *[F.col(k).alias(f"_dup_{k}") for k in used], F.lit(True).alias("_dup"))
    joined = df.join(repeated, _same(df, repeated, used), "left")
    return joined.select(*df.columns, F.coalesce("_dup", F.lit(False)).alias(FLAG))


def duplicate_report(df: DataFrame, keys: tuple[str, ...], scope: tuple[str, ...] = ()) -> DataFrame:
    """One row: rows, flagged rows, percentage, number of groups and the 80 % alarm."""
    used = usable_keys(df.columns, keys)
    used = [*used, *[s for s in scope if s not in used]] if used else used
    if used:
        groups = df.groupBy(*used).agg(F.count(F.lit(1)).alias("n"))
    else:
        groups = df.select(F.lit(1).cast("bigint").alias("n"))
    many = F.col("n") > 1
    report = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_flagged"),
        F.count_if(many).alias("n_groups"),
    )
    percent = F.when(F.col("n_rows") > 0, F.col("n_flagged") * 100.0 / F.col("n_rows")).otherwise(0.0)
    return report.select(
        "n_rows", "n_flagged", F.round(percent.cast("double"), 1).alias("pct_flagged"), "n_groups",
        (percent > 80).alias("alarm"))
