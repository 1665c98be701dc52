"""Usage, exposure and risk tables of one run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.operators import proximity, usage
from wayrisk.session import stored

GRAINS = {
    "lifetime": (usage.exposure_lifetime, []),
    "year": (usage.exposure_by_year, ["year"]),
    "year_month": (usage.exposure_by_year_month, ["year", "month"]),
}


def usage_tables(trips: DataFrame) -> dict[str, DataFrame]:
    """All usage tables from one stored pass over the trips."""
    cube = stored(usage.usage_cube(trips))
    total = F.sum("trips").alias("trips")
    timed = cube.where(F.col("dow").isNotNull())
    by_month = cube.groupBy("mode", "year", "month").agg(total)
    named = timed.withColumns({"dow_name": X.dow_name(F.col("dow")), "week_part": X.week_part(F.col("dow"))})
    return {
        "trips_by_month": by_month.withColumn(
            "trips_per_day", F.col("trips") / X.days_in_month(F.col("year"), F.col("month"))
        ),
        "trips_by_year": cube.groupBy("mode", "year").agg(total),
        "trips_by_dow": named.groupBy("mode", "year", "dow", "dow_name", "week_part").agg(total),
        "trips_by_hour": timed.groupBy("mode", "year", "hour").agg(total),
        "trips_by_hour_week_part": named.groupBy("mode", "year", "week_part", "hour").agg(total),
    }


def station_risk(
    exposure: DataFrame,
    crashes: DataFrame | None,
    radii: Sequence[float] = (250.0, 500.0),
    grain: str = "lifetime",
    modes_without_proxy: Iterable[str] = ("jc",),
) -> DataFrame:
    """Crash counts and rates around every station at one grain.

    Crash data does not cover ``modes_without_proxy``: their counts are 0, they keep
    stations without coordinates, and they are marked ``risk_proxy_available = 0``.
    """
    build, same = GRAINS[grain]
    stations = build(exposure)
    blind = [m.lower() for m in modes_without_proxy]
    covered = ~F.lower("mode").isin(blind) if blind else F.lit(True)
    parts = []
    if crashes is not None:
        counted = proximity.count_within(stations.where(covered), crashes, radii, same)
        parts.append(proximity.with_rates(counted, radii).withColumn("risk_proxy_available", F.lit(1)))
    if blind or crashes is None:
        rest = stations if crashes is None else stations.where(~covered)
        zeros = proximity.zero_counts(rest, radii)
        parts.append(proximity.with_rates(zeros, radii).withColumn("risk_proxy_available", F.lit(0)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ranked_risk(risk: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Delivery order: rate at the widest radius, then trips, both falling."""
    from wayrisk.functions.params import rate_column

    return risk.orderBy(F.desc(rate_column(max(radii))), F.desc("trips"))


def highlights(tables: dict[str, DataFrame], top_n: int = 5) -> DataFrame:
    """Busiest years, year-months (always 10), weekdays and hours as one table.

    Days and hours are totals over all years.
    """

    def busiest(df: DataFrame, kind: str, label, n: int) -> DataFrame:
        return (
            df.select(F.lit(kind).alias("list"), label.cast("string").alias("label"), "trips")
            .orderBy(F.desc("trips"), "label")
            .limit(n)
        )

    def totals(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.sum("trips").alias("trips"))

    return (
        busiest(tables["trips_by_year"], "years", F.col("year"), top_n)
        .unionByName(
            busiest(tables["trips_by_month"], "year_months", F.format_string("%d-%02d", "year", "month"), 10)
        )
        .unionByName(busiest(totals(tables["trips_by_dow"], "dow"), "days_of_week", F.col("dow"), top_n))
        .unionByName(busiest(totals(tables["trips_by_hour"], "hour"), "hours", F.col("hour"), top_n))
    )
