"""Trip counts by period and station exposure.

Every aggregate here is a count, sum or mean, so Spark combines on the map side
and a station or month that holds a third of all trips costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.operators.filters import station_hygiene

STATION = ["mode", "start_station_id", "start_station_name"]


def trips_by_month(trips: DataFrame) -> DataFrame:
    counted = trips.groupBy("mode", "year", "month").agg(F.count(F.lit(1)).alias("trips"))
    days = X.days_in_month(F.col("year"), F.col("month"))
    return counted.withColumn("trips_per_day", F.col("trips") / days)


def trips_by_year(by_month: DataFrame) -> DataFrame:
    return by_month.groupBy("mode", "year").agg(F.sum("trips").alias("trips"))


def trips_by_dow(trips: DataFrame) -> DataFrame:
    """By partition year and the weekday of the start time; trips without a time drop out."""
    return (
        trips.where(F.col("started_at").isNotNull())
        .groupBy("mode", "year", X.dow(F.col("started_at")).alias("dow"))
        .agg(F.count(F.lit(1)).alias("trips"))
        .select(
            "mode",
            "year",
            "dow",
            X.dow_name(F.col("dow")).alias("dow_name"),
            X.week_part(F.col("dow")).alias("week_part"),
            "trips",
        )
    )


def trips_by_hour(trips: DataFrame, by_week_part: bool = False) -> DataFrame:
    part = [X.week_part(X.dow(F.col("started_at"))).alias("week_part")] if by_week_part else []
    return (
        trips.where(F.col("started_at").isNotNull())
        .groupBy("mode", "year", *part, F.hour("started_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("trips"))
    )


def usage_cube(trips: DataFrame) -> DataFrame:
    """Trips by mode, year, month, weekday and hour: at most 2,016 rows per month.

    All usage tables are sums over it, so one scan of the trips serves them all.
    """
    at = F.col("started_at")
    return trips.groupBy("mode", "year", "month", X.dow(at).alias("dow"), F.hour(at).alias("hour")).agg(
        F.count(F.lit(1)).alias("trips")
    )


def station_exposure(trips: DataFrame, exposure: str = "touchpoints", mode: str | None = None) -> DataFrame:
    """Starts, ends and mean place per station and month.

    Starts and ends are two column sets of the same files: each branch of the union
    reads its own columns only and is combined on the map side, so nothing is read
    twice and one shuffle of station-month partials remains.  Rows lacking a station
    id or name do not count.
    """
    if exposure not in ("touchpoints", "starts"):
        raise ValueError(f"exposure is touchpoints or starts, not {exposure!r}")

    def touches(side: str, start: int, end: int) -> DataFrame:
        named = F.col(f"{side}_station_id").isNotNull() & F.col(f"{side}_station_name").isNotNull()
        return trips.where(named).select(
            "mode",
            "year",
            "month",
            F.col(f"{side}_station_id").alias("start_station_id"),
            F.col(f"{side}_station_name").alias("start_station_name"),
            X.number(f"{side}_lat").alias("lat"),
            X.number(f"{side}_lng").alias("lng"),
            F.lit(start).alias("s"),
            F.lit(end).alias("e"),
        )

    keys = ["mode", "year", "month", "start_station_id", "start_station_name"]
    summed = (
        touches("start", 1, 0)
        .unionByName(touches("end", 0, 1))
        .groupBy(*keys)
        .agg(
            F.sum("s").alias("start_trips"),
            F.sum("e").alias("end_trips"),
            F.avg("lat").alias("station_lat"),
            F.avg("lng").alias("station_lng"),
        )
        .withColumn("touchpoints", F.col("start_trips") + F.col("end_trips"))
    )
    chosen = F.col("touchpoints") if exposure == "touchpoints" else F.col("start_trips")
    return station_hygiene(summed.withColumn("trips", chosen), mode)


def _sums_and_place() -> list:
    return [
        F.sum("trips").alias("trips"),
        F.sum("start_trips").alias("start_trips"),
        F.sum("end_trips").alias("end_trips"),
        F.sum("touchpoints").alias("touchpoints"),
        F.avg("station_lat").alias("station_lat"),
        F.avg("station_lng").alias("station_lng"),
    ]


def _distinct_small(number: Column, width: int) -> Column:
    """Distinct whole numbers lying within ``width`` <= 64 of each other, by a bit per number.

    A plain integer aggregate for months: no row expansion and no sets.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(width)).cast("int"))
    return F.bit_count(F.bit_or(bit)).cast("int")


def exposure_lifetime(exposure: DataFrame) -> DataFrame:
    """One row per station: sums, mean of the monthly means, and the time it covers."""
    at = X.month_no(F.col("year"), F.col("month"))
    grouped = exposure.groupBy(*STATION).agg(
        *_sums_and_place(),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.size(F.collect_set("year")).alias("years_count"),
        _distinct_small(F.col("month"), 16).alias("months_count"),
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
    )
    coverage = F.concat_ws(
        "",
        F.col("months_count").cast("string"),
        F.lit(" months spanning "),
        F.col("year_min").cast("string"),
        F.lit("-"),
        F.col("year_max").cast("string"),
    )
    return grouped.withColumns(
        {
            "first_month": X.month_of(F.col("_first")),
            "last_month": X.month_of(F.col("_last")),
            "observation_months": (F.col("_last") - F.col("_first") + 1).cast("int"),
            "data_quality": F.lit("lifetime_aggregate"),
            "temporal_coverage": coverage,
        }
    ).drop("_first", "_last")


def exposure_by_year(exposure: DataFrame) -> DataFrame:
    return (
        exposure.groupBy(*STATION, "year")
        .agg(*_sums_and_place(), _distinct_small(F.col("month"), 16).alias("months_covered"))
        .withColumn("data_quality", F.lit("yearly"))
    )


def exposure_by_year_month(exposure: DataFrame) -> DataFrame:
    return (
        exposure.groupBy(*STATION, "year", "month")
        .agg(*_sums_and_place())
        .withColumn("data_quality", F.lit("year_month"))
    )
