"""Mobility tables read off the star-schema test tables.

``lineitem`` rows stand for trips and ``orders`` rows for crashes.  Stations, places
and times are arithmetic on the keys, so every view is a projection of one scan and
grows with its table.  The SQL texts below use the dialect both engines share.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.operators import usage
from wayrisk.plans import summaries, windows
from wayrisk.plans.scorecard import build_scorecard
from wayrisk.session import stored

RADII = [500.0, 1000.0]
MIN_TRIPS = 500  # about half of the station rows
MIN_TRIPS_YEAR = 80
MIN_TRIPS_MONTH = 8


# --- shared expressions ----------------------------------------------------
def is_jc(k: str) -> str:
    return f"({k} * 7) % 20 < 11"


def station_id(k: str) -> str:
    text = f"CAST({k} AS STRING)"
    return f"CASE WHEN NOT {is_jc(k)} THEN {text} || '.10' WHEN {k} % 3 = 0 THEN 'hb' || {text} ELSE 'JC' || {text} END"


def station_name(k: str) -> str:
    return f"'Station ' || CAST({k} AS STRING)"


def lat(k: str, shift: str) -> str:
    return f"CAST(40.6 AS DOUBLE) + ({k} * 7919 % 3000) / CAST(10000 AS DOUBLE) + {shift}"


def lng(k: str, shift: str) -> str:
    return f"CAST(-74.1 AS DOUBLE) + ({k} * 104729 % 4000) / CAST(10000 AS DOUBLE) - {shift}"


START, END = "l_suppkey", "CAST(floor(l_partkey / 20) AS BIGINT)"
START_SHIFT = "(l_orderkey % 7) * CAST(0.000013718281 AS DOUBLE)"
END_SHIFT = "(l_orderkey % 5) * CAST(0.000011314159 AS DOUBLE)"
NO_END = "(l_orderkey + l_linenumber) % 17 = 0"
START_MINUTE = "CAST((l_orderkey * 37 + l_linenumber * 11) % 1440 AS INT)"
MINUTES = "CAST((l_partkey * 13 + l_orderkey) % 240 AS INT)"


def _unless(condition: str, value: str) -> str:
    return f"CASE WHEN NOT ({condition}) THEN {value} END"


def trip_columns(plus_minutes) -> list[str]:
    """Select list of the trip view; ``plus_minutes(ts, n)`` is the one text that differs by engine."""
    start = plus_minutes("l_shipdate", START_MINUTE)
    return [
        f"CASE WHEN {is_jc(START)} THEN 'jc' ELSE 'nyc' END AS mode",
        "CAST(year(l_shipdate) AS INT) AS year",
        "CAST(month(l_shipdate) AS INT) AS month",
        "l_orderkey * 8 + l_linenumber AS trip_no",
        f"{_unless('l_orderkey % 97 = 0', start)} AS started_at",
        f"{_unless('l_orderkey % 89 = 0', plus_minutes(start, MINUTES))} AS ended_at",
        f"{station_id(START)} AS start_station_id",
        f"{_unless('l_orderkey % 101 = 0', station_name(START))} AS start_station_name",
        f"{_unless(NO_END, station_id(END))} AS end_station_id",
        f"{_unless(NO_END, station_name(END))} AS end_station_name",
        f"{lat(START, START_SHIFT)} AS start_lat",
        f"{lng(START, START_SHIFT)} AS start_lng",
        f"{_unless(NO_END, lat(END, END_SHIFT))} AS end_lat",
        f"{_unless(NO_END, lng(END, END_SHIFT))} AS end_lng",
    ]


CRASH_COLUMNS = [
    "o_orderkey AS collision_id",
    "o_orderdate AS crash_date",
    "CASE WHEN o_orderkey % 53 <> 0 THEN CAST(40.6 AS DOUBLE) + (o_orderkey * 6151 % 3001) / CAST(10000 AS DOUBLE) END AS latitude",
    "CAST(-74.1 AS DOUBLE) + (o_orderkey * 3079 % 4001) / CAST(10000 AS DOUBLE) AS longitude",
    "CAST(year(o_orderdate) AS INT) AS year",
    "CAST(month(o_orderdate) AS INT) AS month",
]

# Text forms of the order date, as source files carry them, and ids without prefixes.
TEXT_ID = "CAST(o_orderkey AS STRING)"


class Views:
    """The derived tables, built lazily for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def trips(self) -> DataFrame:
        plus = lambda ts, n: f"({ts} + make_dt_interval(0, 0, {n}, 0))"
        return self.table("lineitem").selectExpr(*trip_columns(plus))

    @cached_property
    def legacy_trips(self) -> DataFrame:
        """Trips whose ids lose the network prefix before 1998."""
        bare = lambda c: F.when(F.col("year") < 1998, F.regexp_replace(c, "[^0-9.]", "")).otherwise(F.col(c))
        return self.trips.withColumns({c: bare(c) for c in ("start_station_id", "end_station_id")})

    @cached_property
    def crashes(self) -> DataFrame:
        return self.table("orders").selectExpr(*CRASH_COLUMNS).dropna(subset=["latitude", "longitude"])

    @cached_property
    def event_trips(self) -> DataFrame:
        """Event rows as trips with a real time of day."""
        return self.table("events").select(
            F.lit("nyc").alias("mode"),
            F.year("ts").alias("year"),
            F.month("ts").alias("month"),
            F.col("ts").alias("started_at"),
        )

    @cached_property
    def exposure(self) -> DataFrame:
        return usage.station_exposure(self.trips)

    def risk(self, grain: str = "lifetime") -> DataFrame:
        return summaries.station_risk(self.exposure, self.crashes, RADII, grain, modes_without_proxy=())

    def score(self, grain: str = "lifetime", **kwargs) -> DataFrame:
        least = {"lifetime": MIN_TRIPS, "year": MIN_TRIPS_YEAR, "year_month": MIN_TRIPS_MONTH}[grain]
        return build_scorecard(self.risk(grain), radius="1000m", min_trips=least, grain=grain, **kwargs)

    def stored_score(self, grain: str = "lifetime") -> DataFrame:
        """The scorecard as the reports meet it: a stored table."""
        return stored(self.score(grain))

    @cached_property
    def usage(self) -> dict[str, DataFrame]:
        return summaries.usage_tables(self.trips)

    @cached_property
    def windows(self) -> DataFrame:
        u = self.usage
        return windows.target_windows(u["trips_by_hour_week_part"], u["trips_by_dow"], u["trips_by_month"])

    @cached_property
    def runs(self) -> dict[str, DataFrame]:
        """Usage tables of three runs: all years, the years to 1998 only, and 1999 on without December."""
        spans = {"yAll_mode": None, "yEarly_mode": F.col("year") <= 1998, "yLate_mode": (F.col("year") >= 1999) & (F.col("month") < 12)}
        parts = [
            (self.trips if cond is None else self.trips.where(cond)).withColumn("run_tag", F.lit(tag))
            for tag, cond in spans.items()
        ]
        stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
        by_month = stacked.groupBy("run_tag", "mode", "year", "month").agg(F.count(F.lit(1)).alias("trips"))
        timed = stacked.where(F.col("started_at").isNotNull())
        return {
            "trips_by_month": by_month,
            "trips_by_year": by_month.groupBy("run_tag", "mode", "year").agg(F.sum("trips").alias("trips")),
            "trips_by_dow": timed.groupBy("run_tag", "mode", "year", F.weekday("started_at").alias("dow")).agg(
                F.count(F.lit(1)).alias("trips")
            ),
            "trips_by_hour": timed.groupBy("run_tag", "mode", "year", F.hour("started_at").alias("hour")).agg(
                F.count(F.lit(1)).alias("trips")
            ),
        }


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, as the SQL twins give them."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
