"""Station exposure, network filters, and crash proximity at three grains."""

from pyspark.sql import functions as F

from wayrisk.catalog.registry import query, r6
from wayrisk.catalog.views import CRASH_COLUMNS, RADII
from wayrisk.operators import filters, proximity, usage
from wayrisk.plans import summaries

_PLACE = r6("station_lat", "station_lng")
_SUMS = f"trips, start_trips, end_trips, touchpoints, {_PLACE}"
_COUNTS = (
    "crashes_within_500m, crashes_within_1000m, "
    + r6("crashes_within_500m_per_100k_trips", "crashes_within_1000m_per_100k_trips")
    + ", risk_proxy_available"
)
_LIFE = f"""mode, start_station_id, start_station_name, {_SUMS}, year_min, year_max, years_count, months_count,
    first_month, last_month, observation_months, data_quality, temporal_coverage"""
_JC_BOX = "(station_lat BETWEEN 40.6990 AND 40.7490 AND station_lng BETWEEN -74.0778 AND -74.0278)"
_JC_ID = "(upper(start_station_id) LIKE 'JC%' OR upper(start_station_id) LIKE 'HB%')"
_EXPOSURE = f"mode, year, month, start_station_id, start_station_name, start_trips, end_trips, {_PLACE}, touchpoints"


@query("agg5_station_exposure", f"SELECT {_EXPOSURE}, trips FROM exposure")
def _(v):
    return v.exposure


@query("agg5_station_exposure_starts", f"SELECT {_EXPOSURE}, start_trips AS trips FROM exposure")
def _(v):
    return usage.station_exposure(v.trips, exposure="starts")


@query("flt8_hygiene_nyc", f"SELECT {_EXPOSURE}, trips FROM exposure WHERE NOT ({_JC_ID} OR {_JC_BOX})")
def _(v):
    return usage.station_exposure(v.trips, mode="nyc")


@query("flt8_hygiene_jc", f"SELECT {_EXPOSURE}, trips FROM exposure WHERE {_JC_ID} OR {_JC_BOX}")
def _(v):
    return usage.station_exposure(v.trips, mode="jc")


@query("agg6_exposure_lifetime", f"SELECT {_LIFE} FROM life")
def _(v):
    return usage.exposure_lifetime(v.exposure)


@query(
    "agg7_exposure_by_year",
    f"SELECT mode, start_station_id, start_station_name, year, {_SUMS}, months_covered, 'yearly' AS data_quality FROM yearly",
)
def _(v):
    return usage.exposure_by_year(v.exposure)


@query(
    "agg8_exposure_by_year_month",
    f"SELECT mode, start_station_id, start_station_name, year, month, {_SUMS}, 'year_month' AS data_quality FROM monthly",
)
def _(v):
    return usage.exposure_by_year_month(v.exposure)


def _keep(side: str) -> str:
    return f"(upper({side}_station_id) LIKE 'JC%' OR upper({side}_station_id) LIKE 'HB%')"


def _network_sql(table: str, joiner: str, auto: bool) -> str:
    jc = f"(coalesce({_keep('start')}, false) {joiner} coalesce({_keep('end')}, false))"
    nyc = f"(NOT coalesce({_keep('start')}, false) {joiner} NOT coalesce({_keep('end')}, false))"
    prefix = f"CASE mode WHEN 'jc' THEN {jc} ELSE {nyc} END"
    box = " AND ".join(
        f"coalesce({s}_lat BETWEEN 40.66 AND 40.78 AND {s}_lng BETWEEN -74.10 AND -74.00, false)" for s in ("start", "end")
    )
    rule = f"CASE WHEN prefixed THEN {prefix} WHEN mode = 'jc' THEN {box} ELSE true END" if auto else prefix
    return f"""SELECT mode, year, month, count(*) AS trips, CAST(sum(trip_no) AS BIGINT) AS trip_no_sum FROM (
        SELECT *, max(coalesce({_keep('start')}, false) OR coalesce({_keep('end')}, false))
          OVER (PARTITION BY mode, year, month) AS prefixed FROM {table}) WHERE {rule} GROUP BY ALL"""


def _counted(trips):
    return trips.groupBy("mode", "year", "month").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("trip_no").alias("trip_no_sum")
    )


@query("flt1_network_prefix_strict", _network_sql("trips", "AND", auto=False))
def _(v):
    return _counted(filters.filter_network(v.trips, strategy="prefix"))


@query("flt4_network_prefix_either_end", _network_sql("trips", "OR", auto=False))
def _(v):
    return _counted(filters.filter_network(v.trips, strict=False, strategy="prefix"))


@query("flt3_network_by_source_month", _network_sql("legacy_trips", "AND", auto=True))
def _(v):
    return _counted(filters.filter_network(v.legacy_trips))


@query(
    "flt5_within_source_month",
    """SELECT mode, year, month, count(*) AS trips FROM (SELECT * REPLACE (started_at + INTERVAL 1 DAY AS started_at) FROM trips)
       WHERE date_trunc('month', started_at) = make_date(year, month, 1) GROUP BY ALL""",
)
def _(v):
    late = v.trips.withColumn("started_at", F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    return usage.trips_by_month(filters.within_month(late)).drop("trips_per_day")


@query(
    "flt5_within_source_month_keep_null",
    """SELECT mode, year, month, count(*) AS trips FROM (SELECT * REPLACE (started_at + INTERVAL 1 DAY AS started_at) FROM trips)
       WHERE started_at IS NULL OR date_trunc('month', started_at) = make_date(year, month, 1) GROUP BY ALL""",
)
def _(v):
    late = v.trips.withColumn("started_at", F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    return usage.trips_by_month(filters.within_month(late, keep_null_times=True)).drop("trips_per_day")


@query("flt7_crash_filter", "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM crashes WHERE year IN (1996, 1998) AND month IN (1, 7)")
def _(v):
    crashes = v.table("orders").selectExpr(
        *CRASH_COLUMNS
    )
    return filters.crashes_in(crashes, [1996, 1998], [1, 7])


@query("joi1_risk_lifetime", f"SELECT {_LIFE}, {_COUNTS} FROM risk_life")
def _(v):
    return v.risk("lifetime")


@query(
    "joi2_risk_by_year",
    f"""SELECT mode, start_station_id, start_station_name, year, {_SUMS}, months_covered, 'yearly' AS data_quality, {_COUNTS}
        FROM risk_year""",
)
def _(v):
    return v.risk("year")


@query(
    "joi3_risk_by_year_month",
    f"""SELECT mode, start_station_id, start_station_name, year, month, {_SUMS}, 'year_month' AS data_quality, {_COUNTS}
        FROM risk_month""",
)
def _(v):
    return v.risk("year_month")


@query(
    "joi1_crash_counts_salted",
    "SELECT mode, start_station_id, start_station_name, crashes_within_500m, crashes_within_1000m FROM risk_life",
)
def _(v):
    stations = usage.exposure_lifetime(v.exposure).select(
        "mode", "start_station_id", "start_station_name", "station_lat", "station_lng"
    )
    return proximity.count_within(stations, v.crashes, RADII, salt_points=5).drop("station_lat", "station_lng")


@query(
    "agg9_risk_without_jc_proxy",
    f"""SELECT mode, start_station_id, start_station_name, year, {_SUMS}, months_covered, 'yearly' AS data_quality,
        CASE WHEN mode = 'jc' THEN 0 ELSE crashes_within_500m END AS crashes_within_500m,
        CASE WHEN mode = 'jc' THEN 0 ELSE crashes_within_1000m END AS crashes_within_1000m,
        CASE WHEN mode = 'jc' THEN 0 ELSE round(crashes_within_500m_per_100k_trips, 6) END AS crashes_within_500m_per_100k_trips,
        CASE WHEN mode = 'jc' THEN 0 ELSE round(crashes_within_1000m_per_100k_trips, 6) END AS crashes_within_1000m_per_100k_trips,
        CASE WHEN mode = 'jc' THEN 0 ELSE 1 END AS risk_proxy_available FROM risk_year""",
)
def _(v):
    return summaries.station_risk(v.exposure, v.crashes, RADII, "year")


@query(
    "top5_risk_order",
    f"""SELECT mode, start_station_id, trips, {r6('crashes_within_1000m_per_100k_trips')} FROM risk_life
        ORDER BY risk_life.crashes_within_1000m_per_100k_trips DESC, trips DESC""",
)
def _(v):
    ranked = summaries.ranked_risk(v.risk(), RADII)
    return ranked.select("mode", "start_station_id", "trips", "crashes_within_1000m_per_100k_trips")
