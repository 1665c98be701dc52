"""From source-named text columns to the canonical trip columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.functions.params import standard_name
from wayrisk.schemas import CANONICAL_TRIP, RIDE_ID_SOURCES, TRIP_SOURCES

_TIMES = ("started_at", "ended_at")


def standardise_columns(df: DataFrame, rename: Callable[[str], str] = standard_name) -> DataFrame:
    return df.toDF(*[rename(c) for c in df.columns])


def canonical_trips(df: DataFrame, headers: str | None = None) -> DataFrame:
    """Project to the 18 canonical columns; other columns (keys of the source) are kept.

    Which source column feeds a canonical one depends on the file's header, never on
    single rows.  A frame of one header era is resolved by its own columns.  A frame
    that mixes files names an array column (``headers``) holding each row's header.
    """

    def present(name: str) -> Column | None:
        if headers is not None:
            return F.array_contains(headers, name)
        return F.lit(True) if name in df.columns else None

    def first(names: Sequence[str], convert: Callable[[Column], Column] = lambda c: c) -> Column:
        out = None
        for name in names:
            there = present(name)
            if there is None:
                continue
            if headers is None:
                return convert(F.col(name))
            value = convert(F.col(name))
            out = F.when(there, value) if out is None else out.when(there, value)
        return out if out is not None else F.lit(None).cast("string")

    def with_fallback(name: str, fallback: Column) -> Column:
        there = present(name)
        if there is None:
            return fallback
        return F.col(name) if headers is None else F.when(there, F.col(name)).otherwise(fallback)

    cols: dict[str, Column] = {n: first(sources) for n, sources in TRIP_SOURCES.items()}
    for name in _TIMES:
        cols[name] = X.timestamp_text(cols[name])
    cols["ride_id"] = with_fallback("ride_id", X.ride_digest([first(s) for s in RIDE_ID_SOURCES]))
    cols["member_casual"] = with_fallback("member_casual", X.rider_class(first(TRIP_SOURCES["usertype"])))

    used = {n for sources in [*TRIP_SOURCES.values(), *RIDE_ID_SOURCES] for n in sources}
    carried = [c for c in df.columns if c not in used and c != headers]
    return df.select(*carried, *[cols[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL_TRIP.fields])


def older_trip_features(df: DataFrame) -> DataFrame:
    """Trip layer of the first ingest: minutes, hour, day name and date per trip.

    Takes canonical columns, with ``usertype`` standing in where ``member_casual`` is null.
    """
    rider = F.coalesce(F.col("member_casual"), X.rider_class_exact(F.col("usertype")))
    return df.withColumns(
        {
            "member_casual": rider,
            "trip_minutes": X.minutes_between(F.col("started_at"), F.col("ended_at")),
            "hour": F.hour("started_at"),
            "weekday": X.dow_name(X.dow(F.col("started_at"))),
            "date": F.to_date("started_at"),
        }
    )


def station_columns(df: DataFrame) -> DataFrame:
    """One naming for stations and exposure, whichever summary table the rows came from."""
    renames = {
        "station_id": "start_station_id",
        "station_name": "start_station_name",
        "lat": "station_lat",
        "lng": "station_lng",
        "trips": "exposure_trips",
        "y_trips": "exposure_trips",
    }
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def drop_boolean_columns(df: DataFrame) -> DataFrame:
    """Presentation form without yes/no columns."""
    return df.select(*[c for c, kind in df.dtypes if kind != "boolean"])


def ordered_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])
