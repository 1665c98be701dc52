"""Shares of a total, day and hour summaries, and year pivots over small usage tables.

The inputs are already aggregated to at most one row per mode, year and month,
day or hour, so windows per mode here hold a few hundred rows at any data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.functions import expr as X


def with_share(df: DataFrame, scope: Sequence[str], name: str, value: str = "trips") -> DataFrame:
    """Percent of the scope's total; null where the total is 0."""
    total = F.sum(value).over(W.partitionBy(*scope))
    return df.withColumn(name, X.ratio(F.col(value), total, 100.0))


def with_window_shares(df: DataFrame) -> DataFrame:
    """Shares of mode (and year, if present) and of the week part inside it."""
    scope = ["mode", "year"] if "year" in df.columns else ["mode"]
    df = with_share(df, scope, "pct_of_mode_year_trips")
    return with_share(df, [*scope, "week_part"], "pct_within_week_part")


def group_shares(df: DataFrame, by: Sequence[str], name: str, scope: Sequence[str] = ()) -> DataFrame:
    """Sum trips by some columns and add the share of the scope's total."""
    summed = df.groupBy(*by).agg(F.sum("trips").alias("trips"))
    if scope:
        return with_share(summed, scope, name)
    return with_share(summed.withColumn("_all", F.lit(0)), ["_all"], name).drop("_all")


def pivot_years(
    df: DataFrame, rows: Sequence[str], value: str, years: Sequence[int], prefix: str = "y"
) -> DataFrame:
    """One column per year given (known years keep the pivot lazy)."""
    wide = df.groupBy(*rows).pivot("year", list(years)).agg(F.sum(value))
    return wide.select(*rows, *[F.col(str(y)).alias(f"{prefix}{y}") for y in years])
