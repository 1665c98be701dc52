"""Column expressions shared by the operators.  All of them are JVM-side built-ins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayrisk.schemas import (
    DAY_NAMES,
    EARTH_RADIUS_M,
    JC_PREFIXES,
    NULL_TOKENS,
    RATE_SCALE,
    TIER_UPPER_BOUNDS,
    TIERS,
    TIMESTAMP_PATTERNS,
    WINDOW_ACTIONS,
    ZONES,
)


def number(c: Column | str) -> Column:
    """Double, or null where the text is no number (NaN counts as no number)."""
    d = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(c: Column | str) -> Column:
    """Whole number with anything unreadable taken as 0."""
    return F.coalesce(number(c), F.lit(0.0)).cast("long")


def finite(c: Column) -> Column:
    """Null instead of NaN or an infinity."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def null_token(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale``; null when the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0)) * F.lit(scale)


def per_100k(count: Column, trips: Column) -> Column:
    return ratio(count, trips, RATE_SCALE)


# --- text -----------------------------------------------------------------
def rider_class(usertype: Column) -> Column:
    t = F.lower(F.trim(usertype))
    return F.when(t == "subscriber", "member").when(t == "customer", "casual")


def rider_class_exact(usertype: Column) -> Column:
    """Older rule: exact spelling only, any other text is kept."""
    return F.when(usertype == "Subscriber", "member").when(usertype == "Customer", "casual").otherwise(usertype)


def ride_digest(parts: list[Column]) -> Column:
    """md5 of the parts joined by ``|``; nulls count as empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def timestamp_text(c: Column) -> Column:
    """Timestamp without zone from text in any known layout, else null.

    Offsets are shifted to UTC and fractions of a second cut off.
    """
    t = F.trim(c)
    t = F.regexp_replace(t, r"\s+UTC$", "")
    t = F.regexp_replace(t, r"([+-]\d{2}):(\d{2})$", "$1$2")
    t = F.regexp_replace(t, r"\.\d+(Z|[+-]\d{4})?$", "$1")
    # The shape picks the one layout to parse by: a failing parse costs an exception per row.
    out = None
    for pattern, shape in TIMESTAMP_PATTERNS.items():
        parsed = F.try_to_timestamp(t, F.lit(pattern))
        if pattern.endswith("xx"):  # an instant with an offset: its UTC wall clock
            parsed = F.to_utc_timestamp(parsed, F.current_timezone())
        out = F.when(t.rlike(shape), parsed) if out is None else out.when(t.rlike(shape), parsed)
    return out.cast("timestamp_ntz")


def jc_station(station_id: Column) -> Column:
    """Id carries a Jersey City / Hoboken prefix; a null id does not."""
    up = F.upper(station_id)
    return F.coalesce(reduce(lambda a, b: a | b, [up.startswith(p) for p in JC_PREFIXES]), F.lit(False))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    lat_min, lat_max, lng_min, lng_max = box
    inside = lat.between(lat_min, lat_max) & lng.between(lng_min, lng_max)
    return F.coalesce(inside, F.lit(False))


# --- calendar -------------------------------------------------------------
def dow(ts: Column) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(ts)


def dow_name(d: Column) -> Column:
    """English day name for 0..6, else the number as text."""
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.coalesce(F.get(names, d), d.cast("string"))


def week_part(d: Column) -> Column:
    return F.when(d >= 5, "weekend").otherwise("weekday")


def month_no(year: Column, month: Column) -> Column:
    return year * 12 + month


def year_of(index: Column) -> Column:
    return F.floor((index - 1) / 12).cast("int")


def month_of(index: Column) -> Column:
    return (F.pmod(index - 1, F.lit(12)) + 1).cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def year_month_label(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes between two zone-less timestamps, to the microsecond, whatever the session zone."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap)
    return part("DAY") * 1440 + part("HOUR") * 60 + part("MINUTE") + part("SECOND").cast("double") / 60


# --- geometry -------------------------------------------------------------
def half_chord_sq(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """sin²(d/2) of the angular distance d between points in degrees (haversine)."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lng2 - lng1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def half_chord_limit(radius_m: float) -> float:
    """The value `half_chord_sq` takes at ``radius_m``, so no arcsine is needed per pair."""
    return math.sin(radius_m / EARTH_RADIUS_M / 2) ** 2


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.least(half_chord_sq(lat1, lng1, lat2, lng2), F.lit(1.0))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


# --- labels ---------------------------------------------------------------
def window_action(window_type: Column, segment: Column) -> Column:
    out = None
    for (kind, part), text in WINDOW_ACTIONS.items():
        hit = (window_type == kind) if part is None else (window_type == kind) & (segment == part)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise("General")


def zone(high_exposure: Column, high_risk: Column) -> Column:
    out = None
    for (x, y), text in ZONES.items():
        hit = (high_exposure == F.lit(x)) & (high_risk == F.lit(y))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def risk_tier(index_pct: Column, include_lowest: bool = True) -> Column:
    """Low / Medium / High for (0, 33], (33, 66], (66, 100]; 0 itself only with ``include_lowest``."""
    floor = index_pct >= 0 if include_lowest else index_pct > 0
    out = None
    for text, upper in zip(TIERS, TIER_UPPER_BOUNDS):
        hit = floor & (index_pct <= upper)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def credibility(exposure: Column, min_trips: int) -> Column:
    return F.when(exposure >= min_trips, "credible").otherwise("insufficient_data")


def truthy(c: Column) -> Column:
    """True for a boolean true or the texts true / 1 / yes."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))
