"""Declared schemas and fixed values.  Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# --- fixed values: columns of the published data (must equal them) ---------
# Trips.
CANONICAL_TRIP = T.StructType(
    [
        T.StructField("ride_id", _S),
        T.StructField("rideable_type", _S),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("ended_at", T.TimestampNTZType()),
        T.StructField("start_station_id", _S),
        T.StructField("start_station_name", _S),
        T.StructField("end_station_id", _S),
        T.StructField("end_station_name", _S),
        T.StructField("start_lat", _S),
        T.StructField("start_lng", _S),
        T.StructField("end_lat", _S),
        T.StructField("end_lng", _S),
        T.StructField("member_casual", _S),
        T.StructField("usertype", _S),
        T.StructField("bike_id", _S),
        T.StructField("tripduration_seconds", _S),
        T.StructField("gender", _S),
        T.StructField("birth_year", _S),
    ]
)
PARTITION_FIELDS = [T.StructField("mode", _S), T.StructField("year", _I), T.StructField("month", _I)]
TRIP_TABLE = T.StructType(CANONICAL_TRIP.fields + PARTITION_FIELDS)

# For each canonical column the standardised source headers that may carry it, best first.
TRIP_SOURCES: dict[str, list[str]] = {
    "ride_id": ["ride_id"],
    "rideable_type": ["rideable_type"],
    "started_at": ["started_at", "starttime", "start_time"],
    "ended_at": ["ended_at", "stoptime", "stop_time", "end_time"],
    "start_station_id": ["start_station_id"],
    "start_station_name": ["start_station_name"],
    "end_station_id": ["end_station_id"],
    "end_station_name": ["end_station_name"],
    "start_lat": ["start_lat", "start_station_latitude"],
    "start_lng": ["start_lng", "start_station_longitude"],
    "end_lat": ["end_lat", "end_station_latitude"],
    "end_lng": ["end_lng", "end_station_longitude"],
    "member_casual": ["member_casual"],
    "usertype": ["usertype", "user_type"],
    "bike_id": ["bike_id", "bikeid"],
    "tripduration_seconds": ["tripduration_seconds", "tripduration", "trip_duration"],
    "gender": ["gender"],
    "birth_year": ["birth_year"],
}

# Source headers whose text makes up the synthetic ride id, best first per position.
RIDE_ID_SOURCES: list[list[str]] = [
    ["starttime", "start_time", "started_at"],
    ["stoptime", "stop_time", "ended_at", "end_time"],
    ["bikeid", "bike_id"],
    ["start_station_id"],
    ["end_station_id"],
    ["tripduration", "trip_duration", "tripduration_seconds"],
]

# Every header the two tables above can name: the archive scan keeps only these.
RAW_TRIP_COLUMNS: list[str] = sorted(
    {name for names in TRIP_SOURCES.values() for name in names}
    | {name for names in RIDE_ID_SOURCES for name in names}
)

# Crashes.
CRASH_COLUMNS = [
    "collision_id",
    "crash_date",
    "crash_time",
    "borough",
    "latitude",
    "longitude",
    "number_of_persons_injured",
    "number_of_cyclist_injured",
    "number_of_cyclist_killed",
]

# --- summary tables ------------------------------------------------------
USAGE_MONTH = T.StructType(PARTITION_FIELDS + [T.StructField("trips", _L), T.StructField("trips_per_day", _D)])
USAGE_YEAR = T.StructType([T.StructField("mode", _S), T.StructField("year", _I), T.StructField("trips", _L)])
USAGE_DOW = T.StructType(
    [
        T.StructField("mode", _S),
        T.StructField("year", _I),
        T.StructField("dow", _I),
        T.StructField("dow_name", _S),
        T.StructField("week_part", _S),
        T.StructField("trips", _L),
    ]
)
USAGE_HOUR = T.StructType(
    [
        T.StructField("mode", _S),
        T.StructField("year", _I),
        T.StructField("week_part", _S),
        T.StructField("hour", _I),
        T.StructField("trips", _L),
    ]
)
STATION_EXPOSURE = T.StructType(
    PARTITION_FIELDS
    + [
        T.StructField("start_station_id", _S),
        T.StructField("start_station_name", _S),
        T.StructField("start_trips", _L),
        T.StructField("end_trips", _L),
        T.StructField("station_lat", _D),
        T.StructField("station_lng", _D),
        T.StructField("touchpoints", _L),
        T.StructField("trips", _L),
    ]
)

# --- fixed values (must equal the published data conventions) -------------
# Texts a CSV reader takes for null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]
# Station-id prefixes of the Jersey City / Hoboken network.
JC_PREFIXES = ["JC", "HB"]
# Inclusive boxes: lat_min, lat_max, lng_min, lng_max.
JC_INGEST_BOX = (40.66, 40.78, -74.10, -74.00)
JC_STATION_BOX = (40.6990, 40.7490, -74.0778, -74.0278)
# Timestamp layouts in order, each with the shape of the texts worth parsing by it.
TIMESTAMP_PATTERNS = {
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s'Z'": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$",
    "yyyy-M-d H:m:sxx": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}[+-]\d{4}$",
    "yyyy-M-d'T'H:m:sxx": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{4}$",
    "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M/d/yyyy H:m": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$",
}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
COMMUTER_HOURS = [7, 8, 9, 16, 17, 18, 19]
EARTH_RADIUS_M = 6_371_000.0
RATE_SCALE = 100_000.0
VALID_YEARS = (2013, 2030)
INGEST_MODES = ("nyc", "jc", "auto")
WINDOW_ACTIONS = {
    ("hour_peak", "weekday"): "Acquisition + product upsell (commute peaks); consider safety nudge",
    ("hour_peak", "weekend"): "Leisure targeting + safety messaging",
    ("commuter_hours", None): "Strong commuter acquisition + product bundle",
    ("day_of_week_peak", None): "Campaign scheduling + staffing/ops alignment",
    ("month_peak", None): "Seasonal campaign planning",
}
ZONES = {
    (True, True): "High exposure / High risk",
    (True, False): "High exposure / Lower risk",
    (False, True): "Lower exposure / High risk",
    (False, False): "Lower exposure / Lower risk",
}
TIERS = ["Low Risk", "Medium Risk", "High Risk"]
TIER_UPPER_BOUNDS = [33.0, 66.0, 100.0]
SUMMARY_NOTES = {
    "credible": "Enough volume to trust risk ranking",
    "High Risk": "Premium pricing / targeted prevention",
    "Medium Risk": "Standard pricing",
    "Low Risk": "Discount / acquisition-friendly",
    "prevention": "High exposure + high risk → safety pilots",
    "product": "High exposure → strong sales reach",
    "acquisition": "High exposure + low risk → easy wins",
}
# Columns of the decision tables, in order.
WHERE_COLUMNS = [
    "mode", "year", "month", "start_station_id", "start_station_name", "exposure_trips", "crash_count",
    "eb_risk_rate_per_100k_trips", "expected_incidents_proxy", "priority_score", "credibility_flag",
]
REACH_COLUMNS = ["mode", "year", "month", "start_station_id", "start_station_name", "exposure_trips", "credibility_flag"]
WHEN_COLUMNS = [
    "mode", "window_type", "segment", "window_label", "trips", "pct_of_mode_year_trips", "priority_metric",
    "recommended_action",
]
