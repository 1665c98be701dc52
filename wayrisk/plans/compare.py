"""Comparison over many runs: the best run per year, shares, and year-over-year change.

Inputs are the usage tables of all runs stacked with a ``run_tag`` column; they hold
a few rows per run, mode and year, so windows per mode stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.functions.params import months_key
from wayrisk.operators.shares import with_share

RUN_KEY = ["run_tag", "mode", "year"]


def months_covered(months: DataFrame) -> DataFrame:
    return months.groupBy(*RUN_KEY).agg(F.countDistinct("month").alias("months_covered"))


def best_runs(years: DataFrame, months: DataFrame | None) -> DataFrame:
    """Per mode and year the run covering most months, then most trips, then by name."""
    runs = years.select(*RUN_KEY, "trips")
    if months is None:
        runs = runs.withColumn("months_covered", F.lit(None).cast("long"))
    else:
        runs = runs.join(months_covered(months), RUN_KEY, "left")
    order = W.partitionBy("mode", "year").orderBy(
        F.coalesce(F.col("months_covered"), F.lit(-1)).desc(), F.desc("trips"), "run_tag"
    )
    return runs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def of_best_runs(table: DataFrame, best: DataFrame) -> DataFrame:
    """Rows of the selected (run, mode, year) only, each read once."""
    return table.join(best, RUN_KEY, "left_semi")


def backfill_keys(table: DataFrame, best: DataFrame) -> DataFrame:
    """Old tables lacking year or mode: repeat them for each year and mode the run was chosen for."""
    absent = [c for c in ("mode", "year") if c not in table.columns]
    if not absent:
        return of_best_runs(table, best)
    present = [c for c in RUN_KEY if c in table.columns]
    return table.join(best.select(*RUN_KEY).distinct(), present)


def with_year_share(table: DataFrame) -> DataFrame:
    total = F.sum("trips").over(W.partitionBy("mode", "year"))
    return with_share(table.withColumn("year_trips", total), ["mode", "year"], "pct_of_mode_year_trips")


def month_of_year(months: DataFrame) -> DataFrame:
    """Trips per calendar month over all years and their share of the mode."""
    summed = months.groupBy("mode", "month").agg(F.sum("trips").alias("trips"))
    return with_share(summed, ["mode"], "pct_of_mode_all_trips")


def yoy_basis(months: DataFrame, yoy_months: Sequence[int] | None = None) -> DataFrame:
    """Trips, month count and month set per mode and year, over the months asked for."""
    if yoy_months:
        months = months.where(F.col("month").isin(list(yoy_months)))
    seen = F.array_sort(F.collect_set("month"))  # at most 12
    return months.groupBy("mode", "year").agg(
        F.sum("trips").alias("yoy_trips"),
        F.countDistinct("month").alias("yoy_months_covered"),
        F.array_join(F.transform(seen, lambda m: m.cast("string")), ",").alias("yoy_months_set"),
    )


def year_over_year(best: DataFrame, months: DataFrame, yoy_months: Sequence[int] | None = None) -> DataFrame:
    """Change against the previous year present, only between years over the same months."""
    basis = f"months={months_key(yoy_months)}" if yoy_months else "full_coverage_match_required"
    rows = best.join(yoy_basis(months, yoy_months), ["mode", "year"], "left").withColumn("yoy_basis", F.lit(basis))
    w = W.partitionBy("mode").orderBy("year")

    def change(now: Column, before: Column) -> Column:
        return F.when(before > 0, (now / F.nullif(before, F.lit(0)) - 1.0) * 100.0)

    month_set = F.col("yoy_months_set")
    same = month_set == F.lag("yoy_months_set").over(w)
    if yoy_months:
        same = same & (month_set == months_key(yoy_months))
    denominator = F.lit(float(len(yoy_months))) if yoy_months else F.col("yoy_months_covered")
    rows = rows.withColumns(
        {
            "yoy_pct": F.when(same, change(F.col("yoy_trips"), F.lag("yoy_trips").over(w))),
            "trips_per_month": F.col("yoy_trips") / F.nullif(denominator, F.lit(0)),
        }
    )
    per_month = change(F.col("trips_per_month"), F.lag("trips_per_month").over(w))
    return rows.withColumn("trips_per_month_yoy_pct", F.when(F.col("yoy_pct").isNotNull(), per_month))


def comparison_tables(
    tables: dict[str, DataFrame], yoy_months: Sequence[int] | None = None
) -> dict[str, DataFrame]:
    """All comparison tables from stacked run tables (keys as in `summaries.usage_tables`)."""
    best = best_runs(tables["trips_by_year"], tables["trips_by_month"])
    months = of_best_runs(tables["trips_by_month"], best)
    return {
        "selected_best_runs": best,
        "trips_by_month_all": with_year_share(months),
        "trips_by_month_of_year_all": month_of_year(months),
        "trips_by_year_all": year_over_year(best, months, yoy_months),
        "trips_by_dow_all": with_year_share(backfill_keys(tables["trips_by_dow"], best)),
        "trips_by_hour_all": with_year_share(backfill_keys(tables["trips_by_hour"], best)),
    }
