"""CTEs of the SQL twins: written as a database user would, independent of the Spark plans."""

from __future__ import annotations

import re

from wayrisk.catalog.views import CRASH_COLUMNS, MIN_TRIPS, MIN_TRIPS_MONTH, MIN_TRIPS_YEAR, trip_columns

_PLUS = lambda ts, n: f"({ts} + to_minutes({n}))"

CTES: dict[str, str] = {
    "trips": "SELECT " + ",\n".join(trip_columns(_PLUS)) + " FROM lineitem",
    "legacy_trips": """SELECT * REPLACE (
        CASE WHEN year < 1998 THEN regexp_replace(start_station_id, '[^0-9.]', '', 'g') ELSE start_station_id END AS start_station_id,
        CASE WHEN year < 1998 THEN regexp_replace(end_station_id, '[^0-9.]', '', 'g') ELSE end_station_id END AS end_station_id)
        FROM trips""",
    "crashes": "SELECT * FROM (SELECT " + ",\n".join(CRASH_COLUMNS) + " FROM orders) WHERE latitude IS NOT NULL",
    "by_month": """SELECT mode, year, month, count(*) AS trips,
        count(*) / day(last_day(make_date(year, month, 1))) AS trips_per_day FROM trips GROUP BY mode, year, month""",
    "by_year": "SELECT mode, year, CAST(sum(trips) AS BIGINT) AS trips FROM by_month GROUP BY ALL",
    "by_dow": """SELECT mode, year, dow, dayname(DATE '2024-01-01' + CAST(dow AS INTEGER)) AS dow_name,
        CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END AS week_part, trips
        FROM (SELECT mode, year, isodow(started_at) - 1 AS dow, count(*) AS trips FROM trips
              WHERE started_at IS NOT NULL GROUP BY ALL)""",
    "by_hour": """SELECT mode, year, hour(started_at) AS hour, count(*) AS trips FROM trips
        WHERE started_at IS NOT NULL GROUP BY ALL""",
    "by_hour_part": """SELECT mode, year, CASE WHEN isodow(started_at) >= 6 THEN 'weekend' ELSE 'weekday' END AS week_part,
        hour(started_at) AS hour, count(*) AS trips FROM trips WHERE started_at IS NOT NULL GROUP BY ALL""",
    "touches": """SELECT mode, year, month, start_station_id, start_station_name, 1 AS s, 0 AS e,
            start_lat AS lat, start_lng AS lng FROM trips
        UNION ALL SELECT mode, year, month, end_station_id, end_station_name, 0, 1, end_lat, end_lng FROM trips""",
    "exposure": """SELECT mode, year, month, start_station_id, start_station_name,
        CAST(sum(s) AS BIGINT) AS start_trips, CAST(sum(e) AS BIGINT) AS end_trips,
        avg(lat) AS station_lat, avg(lng) AS station_lng,
        CAST(sum(s) + sum(e) AS BIGINT) AS touchpoints, CAST(sum(s) + sum(e) AS BIGINT) AS trips
        FROM touches WHERE start_station_id IS NOT NULL AND start_station_name IS NOT NULL
        GROUP BY mode, year, month, start_station_id, start_station_name""",
    "life": """SELECT *, (year_max - year_min) * 12 + (last_month - first_month) + 1 AS observation_months,
        'lifetime_aggregate' AS data_quality,
        months_count || ' months spanning ' || year_min || '-' || year_max AS temporal_coverage FROM (
        SELECT mode, start_station_id, start_station_name,
        CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(start_trips) AS BIGINT) AS start_trips,
        CAST(sum(end_trips) AS BIGINT) AS end_trips, CAST(sum(touchpoints) AS BIGINT) AS touchpoints,
        avg(station_lat) AS station_lat, avg(station_lng) AS station_lng,
        min(year) AS year_min, max(year) AS year_max, count(DISTINCT year) AS years_count,
        count(DISTINCT month) AS months_count, arg_min(month, year * 12 + month) AS first_month,
        arg_max(month, year * 12 + month) AS last_month
        FROM exposure GROUP BY ALL)""",
    "yearly": """SELECT mode, start_station_id, start_station_name, year,
        CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(start_trips) AS BIGINT) AS start_trips,
        CAST(sum(end_trips) AS BIGINT) AS end_trips, CAST(sum(touchpoints) AS BIGINT) AS touchpoints,
        avg(station_lat) AS station_lat, avg(station_lng) AS station_lng, count(DISTINCT month) AS months_covered
        FROM exposure GROUP BY ALL""",
    "monthly": """SELECT mode, start_station_id, start_station_name, year, month,
        CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(start_trips) AS BIGINT) AS start_trips,
        CAST(sum(end_trips) AS BIGINT) AS end_trips, CAST(sum(touchpoints) AS BIGINT) AS touchpoints,
        avg(station_lat) AS station_lat, avg(station_lng) AS station_lng FROM exposure GROUP BY ALL""",
}


def _risk(stations: str, same: list[str]) -> str:
    """Brute-force distances of every station row and crash, as an independent check."""
    match = " AND ".join([f"c.{k} = s.{k}" for k in same] or ["TRUE"])
    keys = ["mode", "start_station_id", "start_station_name", *same]
    key_list = ", ".join(keys)
    return f"""SELECT s.*, coalesce(n.c500, 0) AS crashes_within_500m, coalesce(n.c1000, 0) AS crashes_within_1000m,
        coalesce(n.c500, 0) / s.trips * 100000 AS crashes_within_500m_per_100k_trips,
        coalesce(n.c1000, 0) / s.trips * 100000 AS crashes_within_1000m_per_100k_trips, 1 AS risk_proxy_available
        FROM {stations} s LEFT JOIN (
          SELECT {key_list}, count(*) FILTER (WHERE d <= 500) AS c500, count(*) FILTER (WHERE d <= 1000) AS c1000 FROM (
            SELECT {", ".join("s." + k for k in keys)},
              2 * 6371000.0 * asin(sqrt(pow(sin(radians(c.latitude - s.station_lat) / 2), 2)
                + cos(radians(s.station_lat)) * cos(radians(c.latitude)) * pow(sin(radians(c.longitude - s.station_lng) / 2), 2))) AS d
            FROM {stations} s JOIN crashes c ON {match}) GROUP BY ALL) n USING ({key_list})"""


def _score(risk: str, period: list[str], least: int) -> str:
    """Scorecard body; chained sub-selects in the order rates, prior, ranks, flags."""
    groups = ", ".join(["mode", *period])
    return f"""SELECT *,
        exposure_index_pct / 100 AS exposure_pct, coalesce(risk_index_pct, 0) / 100 AS risk_pct,
        CASE WHEN risk_proxy_available THEN incidents_pct ELSE exposure_index_pct END / 100 AS priority_score,
        CASE WHEN risk_proxy_available THEN exposure_index_pct >= 80 AND coalesce(risk_index_pct, 0) / 100 >= 0.8
             AND credibility_flag = 'credible' ELSE exposure_index_pct >= 90 END AS prevention_hotspot,
        exposure_index_pct >= 80 AS product_hotspot,
        CASE WHEN risk_proxy_available THEN exposure_index_pct >= 70 AND coalesce(risk_index_pct, 0) / 100 <= 0.3
             ELSE exposure_index_pct >= 70 END AS acquisition_hotspot
      FROM (
        SELECT *,
          (rank() OVER (PARTITION BY {groups} ORDER BY exposure_trips)
            + (count(*) OVER (PARTITION BY {groups}, exposure_trips) - 1) / 2)
            / count(*) OVER (PARTITION BY {groups}) * 100 AS exposure_index_pct,
          CASE WHEN risk_proxy_available THEN
            (rank() OVER (PARTITION BY {groups} ORDER BY expected_incidents_proxy)
            + (count(*) OVER (PARTITION BY {groups}, expected_incidents_proxy) - 1) / 2)
            / count(*) OVER (PARTITION BY {groups}) * 100 END AS incidents_pct,
          CASE WHEN credibility_flag = 'credible' THEN
            (rank() OVER (PARTITION BY {groups}, credibility_flag ORDER BY eb_risk_rate_per_100k_trips)
            + (count(*) OVER (PARTITION BY {groups}, credibility_flag, eb_risk_rate_per_100k_trips) - 1) / 2)
            / count(*) OVER (PARTITION BY {groups}, credibility_flag) * 100 END AS risk_index_pct
        FROM (
          SELECT *, eb * 100000 AS eb_risk_rate_per_100k_trips, eb * exposure_trips AS expected_incidents_proxy,
            CASE WHEN risk_proxy_available THEN 'eb_expected_incidents_mintrips{least}_mprior' || CAST(floor(m) AS BIGINT)
                 ELSE 'exposure_only_no_risk_signal' END AS scoring_strategy,
            CASE WHEN NOT risk_proxy_available THEN 'no_risk_data'
                 WHEN exposure_trips >= {least} THEN 'credible' ELSE 'insufficient_data' END AS credibility_flag
          FROM (
            SELECT b.*, p.m, p.risk_proxy_available,
              CASE WHEN p.risk_proxy_available THEN (crash_count + p.r0 * p.m) / (exposure_trips + p.m) END AS eb
            FROM (SELECT {groups}, start_station_id, start_station_name, station_lat, station_lng, trips AS exposure_trips,
                    crashes_within_1000m AS crash_count,
                    crashes_within_1000m_per_100k_trips AS risk_rate_per_100k_trips FROM {risk}) b
            JOIN (SELECT {groups}, sum(k) / sum(n) AS r0,
                    CASE WHEN count(*) < 30 THEN 20000 ELSE greatest(1000, least(100000,
                      pow(avg(k / n), 2) / greatest(1e-10, var_samp(k / n) - avg(k / n) / avg(n)))) END AS m,
                    count(*) FILTER (WHERE n >= {least}) >= 10
                      AND count(DISTINCT CASE WHEN n >= {least} THEN rate END) > 1 AS risk_proxy_available
                  FROM (SELECT *, crashes_within_1000m AS k, trips AS n,
                          crashes_within_1000m_per_100k_trips AS rate FROM {risk})
                  GROUP BY {groups}) p USING ({groups}))))"""


CTES |= {
    "risk_life": _risk("life", []),
    "risk_year": _risk("yearly", ["year"]),
    "risk_month": _risk("monthly", ["year", "month"]),
    "score": _score("risk_life", [], MIN_TRIPS),
    "score_year": _score("risk_year", ["year"], MIN_TRIPS_YEAR),
    "score_month": _score("risk_month", ["year", "month"], MIN_TRIPS_MONTH),
    "enriched": f"""SELECT mode, start_station_id, exposure_index_pct, eb20, eb20 / 100000 * exposure_trips AS inc, true AS risk_proxy_available
        FROM (SELECT *, (crash_count + sum(crash_count) OVER (PARTITION BY mode) / sum(exposure_trips) OVER (PARTITION BY mode) * 20000)
          / (exposure_trips + 20000) * 100000 AS eb20 FROM score)""",
    "credible": "SELECT * FROM score WHERE credibility_flag = 'credible'",
    "high": """SELECT * FROM credible WHERE eb_risk_rate_per_100k_trips >=
        (SELECT quantile_cont(eb_risk_rate_per_100k_trips, 0.9) FROM credible)""",
    "hour_target": """SELECT *, trips / sum(trips) OVER (PARTITION BY mode) * 100 AS pct_of_mode_year_trips,
        trips / sum(trips) OVER (PARTITION BY mode, week_part) * 100 AS pct_within_week_part
        FROM (SELECT mode, hour, week_part, CAST(sum(trips) AS BIGINT) AS trips FROM by_hour_part GROUP BY ALL)""",
    "dow_target": """SELECT *, trips / sum(trips) OVER (PARTITION BY mode) * 100 AS pct_of_mode_year_trips,
        trips / sum(trips) OVER (PARTITION BY mode, week_part) * 100 AS pct_within_week_part
        FROM (SELECT mode, dow, dow_name, week_part, CAST(sum(trips) AS BIGINT) AS trips FROM by_dow GROUP BY ALL)""",
    "windows": """SELECT *, CASE
          WHEN window_type = 'hour_peak' AND segment = 'weekday' THEN 'Acquisition + product upsell (commute peaks); consider safety nudge'
          WHEN window_type = 'hour_peak' AND segment = 'weekend' THEN 'Leisure targeting + safety messaging'
          WHEN window_type = 'commuter_hours' THEN 'Strong commuter acquisition + product bundle'
          WHEN window_type = 'day_of_week_peak' THEN 'Campaign scheduling + staffing/ops alignment'
          WHEN window_type = 'month_peak' THEN 'Seasonal campaign planning' ELSE 'General' END AS recommended_action
        FROM (
          SELECT mode, 'hour_peak' AS window_type, week_part AS segment, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS window_label,
            trips, pct_of_mode_year_trips, pct_within_week_part, pct_within_week_part AS priority_metric FROM hour_target
            QUALIFY row_number() OVER (PARTITION BY mode, week_part ORDER BY trips DESC, hour) <= 5
          UNION ALL
          SELECT mode, 'commuter_hours', week_part, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00', trips,
            pct_of_mode_year_trips, pct_within_week_part, pct_within_week_part FROM hour_target
            WHERE week_part = 'weekday' AND hour IN (7, 8, 9, 16, 17, 18, 19)
          UNION ALL
          SELECT mode, 'day_of_week_peak', week_part, dow_name, trips, pct_of_mode_year_trips, pct_within_week_part,
            pct_within_week_part FROM dow_target
            QUALIFY row_number() OVER (PARTITION BY mode, week_part ORDER BY trips DESC, dow) <= 3
          UNION ALL
          SELECT mode, 'month_peak', 'overall', year || '-' || lpad(CAST(month AS VARCHAR), 2, '0'), trips, NULL,
            trips_per_day, trips_per_day FROM by_month
            QUALIFY row_number() OVER (PARTITION BY mode ORDER BY trips_per_day DESC, year, month) <= 6)""",
    "run_trips": """SELECT 'yAll_mode' AS run_tag, * FROM trips
        UNION ALL SELECT 'yEarly_mode', * FROM trips WHERE year <= 1998
        UNION ALL SELECT 'yLate_mode', * FROM trips WHERE year >= 1999 AND month < 12""",
    "run_month": "SELECT run_tag, mode, year, month, count(*) AS trips FROM run_trips GROUP BY ALL",
    "best": """SELECT * FROM (SELECT run_tag, mode, year, CAST(sum(trips) AS BIGINT) AS trips, count(DISTINCT month) AS months_covered
          FROM run_month GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY mode, year ORDER BY months_covered DESC, trips DESC, run_tag) = 1""",
    "best_month": "SELECT m.* FROM run_month m SEMI JOIN best b USING (run_tag, mode, year)",
    "panel": """SELECT mode, start_station_id AS station_id, max(start_station_name) AS start_station_name, year, month,
        year * 12 + month AS date_index, CAST(sum(trips) AS DOUBLE) AS y_trips, CAST(sum(start_trips) AS DOUBLE) AS start_trips,
        CAST(sum(end_trips) AS DOUBLE) AS end_trips, CAST(sum(touchpoints) AS DOUBLE) AS touchpoints,
        avg(station_lat) AS station_lat, avg(station_lng) AS station_lng FROM exposure GROUP BY mode, start_station_id, year, month""",
    "features": """SELECT *, date_index + 1 AS label_date_index, lead(y_trips) OVER w AS y_label,
        sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
        avg(y_trips) OVER (PARTITION BY mode, station_id) AS station_mean,
        avg(y_trips) OVER (PARTITION BY mode, station_id, month) AS station_month_mean, 1 AS has_y_trips,
        lag(y_trips, 1) OVER w AS y_trips_lag_1, lag(y_trips, 2) OVER w AS y_trips_lag_2,
        lag(y_trips, 3) OVER w AS y_trips_lag_3, lag(y_trips, 12) OVER w AS y_trips_lag_12,
        avg(y_trips) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS y_trips_rollmean_3,
        avg(y_trips) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS y_trips_rollmean_6,
        stddev_samp(y_trips) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS y_trips_rollstd_3,
        stddev_samp(y_trips) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS y_trips_rollstd_6,
        lag(start_trips) OVER w AS start_trips_lag_1, lag(end_trips) OVER w AS end_trips_lag_1,
        lag(touchpoints) OVER w AS touchpoints_lag_1
        FROM panel WINDOW w AS (PARTITION BY mode, station_id ORDER BY date_index, start_station_name)""",
}

def with_ctes(body: str) -> str:
    """Prefix the CTEs a body names, directly or through others, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:  # the body brings CTEs of its own
        return f"WITH {own[1] or ''}{parts},\n{body[own.end():]}"
    return f"WITH {parts}\n{body}"
