"""Row filters of the trip and station layers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.schemas import COMMUTER_HOURS, JC_INGEST_BOX, JC_STATION_BOX
from wayrisk.session import small_side

SOURCE_MONTH = ("mode", "year", "month")


def _both_ends(start: Column | None, end: Column | None, strict: bool) -> Column:
    if start is None or end is None:
        return start if end is None else end
    return (start & end) if strict else (start | end)


def filter_network(
    trips: DataFrame, strict: bool = True, strategy: str = "auto", scope: Iterable[str] = SOURCE_MONTH
) -> DataFrame:
    """Keep the trips that belong to their own network (``mode`` jc or nyc).

    Where any id of a source month carries a JC/HB prefix, prefixes decide; months
    without prefixes (legacy numeric ids) use the coordinate box for jc and keep
    everything for nyc.  ``strategy="prefix"`` always uses prefixes.  Other modes pass.
    """
    cols = set(trips.columns)
    start_jc = X.jc_station(F.col("start_station_id")) if "start_station_id" in cols else None
    end_jc = X.jc_station(F.col("end_station_id")) if "end_station_id" in cols else None
    if start_jc is None and end_jc is None:
        return trips
    mode = F.col("mode")
    by_prefix = (
        F.when(mode == "jc", _both_ends(start_jc, end_jc, strict))
        .when(mode == "nyc", _both_ends(*[None if c is None else ~c for c in (start_jc, end_jc)], strict))
        .otherwise(True)
    )
    if strategy == "prefix":
        return trips.where(by_prefix)

    scope = list(scope)
    any_jc = start_jc if end_jc is None else (start_jc if start_jc is not None else F.lit(False)) | end_jc
    # One row per source month: the trips themselves are not shuffled for it.
    decided = small_side(trips.groupBy(*scope).agg(F.max(any_jc).alias("_prefixed")))
    if {"start_lat", "start_lng", "end_lat", "end_lng"} <= cols:
        boxed = _both_ends(
            X.in_box(X.number("start_lat"), X.number("start_lng"), JC_INGEST_BOX),
            X.in_box(X.number("end_lat"), X.number("end_lng"), JC_INGEST_BOX),
            strict,
        )
    else:
        boxed = F.lit(True)
    keep = F.when(F.col("_prefixed"), by_prefix).when(mode == "jc", boxed).otherwise(True)
    return trips.join(decided, scope).where(keep).select(*trips.columns)


def within_month(trips: DataFrame, keep_null_times: bool = False) -> DataFrame:
    """Start time inside the source month (``year``, ``month`` columns)."""
    first = F.make_date(F.col("year"), F.col("month"), F.lit(1))
    lower = first.cast("timestamp_ntz")
    upper = F.add_months(first, 1).cast("timestamp_ntz")
    t = F.col("started_at")
    inside = (t >= lower) & (t < upper)
    return trips.where(inside | t.isNull() if keep_null_times else inside)


def plausible_duration(trips: DataFrame) -> DataFrame:
    """Older trip layer: both times present and 1 to 180 minutes apart."""
    return trips.where(
        F.col("started_at").isNotNull() & F.col("ended_at").isNotNull() & F.col("trip_minutes").between(1, 180)
    )


def station_hygiene(exposure: DataFrame, mode: str | None) -> DataFrame:
    """Drop stations of the other network; only done when one network is asked for."""
    wanted = (mode or "").strip().lower()
    if wanted not in ("nyc", "jc"):
        return exposure
    jersey = X.jc_station(F.col("start_station_id")) | X.in_box(
        X.number("station_lat"), X.number("station_lng"), JC_STATION_BOX
    )
    return exposure.where(jersey if wanted == "jc" else ~jersey)


def crashes_in(crashes: DataFrame, years: Iterable[int], months: Iterable[int]) -> DataFrame:
    """Crashes with a date and a place, in any of the years and any of the months."""
    return crashes.dropna(subset=["crash_date", "latitude", "longitude"]).where(
        F.year("crash_date").isin(list(years)) & F.month("crash_date").isin(list(months))
    )


def select_mode(df: DataFrame, mode: str | None) -> DataFrame:
    """Rows of one mode, ignoring case."""
    if not mode:
        return df
    return df.where(F.lower("mode") == mode.strip().lower())


def select_periods(
    df: DataFrame, years: Iterable[int] | None = None, months: Iterable[int] | None = None
) -> DataFrame:
    """Year and month filter, each only where asked for and where the column exists."""
    for name, wanted in (("year", years), ("month", months)):
        if wanted is not None and name in df.columns:
            df = df.where(F.col(name).isin(list(wanted)))
    return df


def credible(df: DataFrame, min_trips: int = 5000, exposure: str = "exposure_trips") -> DataFrame:
    """Rows flagged credible (any case); without a flag, rows with enough trips."""
    if "credibility_flag" in df.columns:
        return df.where(F.lower("credibility_flag") == "credible")
    return df.where(F.col(exposure) >= min_trips)


def commuter_hours(hours: DataFrame) -> DataFrame:
    return hours.where((F.col("week_part") == "weekday") & F.col("hour").isin(COMMUTER_HOURS))


def single_mode(df: DataFrame, mode: str | None) -> tuple[DataFrame, str]:
    """Lower-case the mode and narrow to one; several modes and no choice is an error."""
    if "mode" not in df.columns:
        df = df.withColumn("mode", F.lit("unknown"))
    df = df.withColumn("mode", F.lower(F.col("mode").cast("string")))
    # distinct modes: a handful of partition labels
    present = sorted(r[0] for r in df.select("mode").distinct().collect())
    if mode:
        wanted = mode.strip().lower()
        if wanted not in present:
            raise ValueError(f"mode {wanted!r} not in {present}")
        return df.where(F.col("mode") == wanted), wanted
    if len(present) != 1:
        raise ValueError(f"choose one mode of {present}")
    return df, present[0]
