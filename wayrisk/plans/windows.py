"""Target windows: the hours, days and months a campaign should use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.functions import expr as X
from wayrisk.operators.filters import commuter_hours
from wayrisk.operators.shares import with_window_shares

COLUMNS = [
    "mode",
    "window_type",
    "segment",
    "window_label",
    "trips",
    "pct_of_mode_year_trips",
    "pct_within_week_part",
    "priority_metric",
    "recommended_action",
]


def across_years(df: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over all years with the shares of the mode and of the week part."""
    return with_window_shares(df.groupBy(*keys).agg(F.sum("trips").alias("trips")))


def _top(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)


def _window(df: DataFrame, kind: str, segment, label, metric) -> DataFrame:
    return df.select(
        "mode",
        F.lit(kind).alias("window_type"),
        segment.alias("segment"),
        label.alias("window_label"),
        "trips",
        "pct_of_mode_year_trips",
        "pct_within_week_part",
        metric.alias("priority_metric"),
    )


def target_windows(
    hours: DataFrame,
    days: DataFrame,
    months: DataFrame,
    top_hours: int = 5,
    top_dows: int = 3,
    top_months: int = 6,
) -> DataFrame:
    """Windows of every mode in the tables.

    ``hours`` carries a week part; the usage tables hold a few rows per mode, so the
    per-segment rankings stay small at any trip volume.  Ties go to the earlier
    hour, day or month.  Month windows keep trips per day in the share column.
    """
    named_parts = F.col("week_part").isin("weekday", "weekend")
    hour = across_years(hours, ["mode", "hour", "week_part"])
    share, part = F.col("pct_within_week_part"), F.col("week_part")
    hour_label = X.hour_label(F.col("hour"))
    peaks = _window(
        _top(hour.where(named_parts), top_hours, ["mode", "week_part"], [F.desc("trips"), "hour"]),
        "hour_peak",
        part,
        hour_label,
        share,
    )
    commuter = _window(commuter_hours(hour), "commuter_hours", part, hour_label, share)

    day = across_years(days, ["mode", "dow", "dow_name", "week_part"])
    day_peaks = _window(
        _top(day.where(named_parts), top_dows, ["mode", "week_part"], [F.desc("trips"), "dow"]),
        "day_of_week_peak",
        part,
        F.col("dow_name"),
        share,
    )
    per_day = F.col("trips_per_day")
    busiest = _top(
        months.where(per_day.isNotNull()), top_months, ["mode"], [F.desc("trips_per_day"), "year", "month"]
    )
    month_peaks = busiest.select(
        "mode",
        F.lit("month_peak").alias("window_type"),
        F.lit("overall").alias("segment"),
        X.year_month_label(F.col("year"), F.col("month")).alias("window_label"),
        "trips",
        per_day.alias("pct_within_week_part"),
        per_day.alias("priority_metric"),
    )
    out = (
        peaks.unionByName(commuter)
        .unionByName(day_peaks)
        .unionByName(month_peaks, allowMissingColumns=True)
        .withColumn("recommended_action", X.window_action(F.col("window_type"), F.col("segment")))
    )
    return out.select(*COLUMNS)
