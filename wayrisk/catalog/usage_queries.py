"""Usage counts, shares, pivots and top lists."""

from functools import reduce

from pyspark.sql import functions as F

from wayrisk.catalog.registry import query, r6
from wayrisk.operators import filters, shares, usage
from wayrisk.plans import report, summaries

TWIN_YEARS = list(range(1995, 2002))  # SQL must name its columns: the years of the test tables


def _years(v) -> list[int]:
    """Years of the trips, from the table that has one row per mode and year."""
    found = v.usage["trips_by_year"].select("year").distinct().collect()
    return sorted(r["year"] for r in found if r["year"] is not None)


@query("agg1_trips_by_month", f"SELECT mode, year, month, trips, {r6('trips_per_day')} FROM by_month")
def _(v):
    return usage.trips_by_month(v.trips)


@query("agg2_trips_by_year", "SELECT * FROM by_year")
def _(v):
    return usage.trips_by_year(usage.trips_by_month(v.trips))


@query("agg3_trips_by_dow", "SELECT * FROM by_dow")
def _(v):
    return usage.trips_by_dow(v.trips)


@query("agg4_trips_by_hour", "SELECT * FROM by_hour")
def _(v):
    return usage.trips_by_hour(v.trips)


@query("agg4_trips_by_hour_week_part", "SELECT * FROM by_hour_part")
def _(v):
    return usage.trips_by_hour(v.trips, by_week_part=True)


@query(
    "tab1_usage_tables",
    """SELECT 'trips_by_month' AS name, mode, count(*) AS rows, CAST(sum(trips) AS BIGINT) AS trips FROM by_month GROUP BY mode
       UNION ALL SELECT 'trips_by_year', mode, count(*), CAST(sum(trips) AS BIGINT) FROM by_year GROUP BY mode
       UNION ALL SELECT 'trips_by_dow', mode, count(*), CAST(sum(trips) AS BIGINT) FROM by_dow GROUP BY mode
       UNION ALL SELECT 'trips_by_hour', mode, count(*), CAST(sum(trips) AS BIGINT) FROM by_hour GROUP BY mode
       UNION ALL SELECT 'trips_by_hour_week_part', mode, count(*), CAST(sum(trips) AS BIGINT) FROM by_hour_part GROUP BY mode""",
)
def _(v):
    parts = [
        df.groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.sum("trips").alias("trips")).withColumn("name", F.lit(n))
        for n, df in v.usage.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "agg3_event_trips_by_dow",
    """SELECT isodow(ts) - 1 AS dow, dayname(ts) AS dow_name, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS week_part,
       'nyc' AS mode, year(ts) AS year, count(*) AS trips FROM events GROUP BY ALL""",
)
def _(v):
    return usage.trips_by_dow(v.event_trips)


@query(
    "agg4_event_trips_by_hour",
    "SELECT 'nyc' AS mode, year(ts) AS year, hour(ts) AS hour, count(*) AS trips FROM events GROUP BY ALL",
)
def _(v):
    return usage.trips_by_hour(v.event_trips)


@query(
    "win2_dow_share_of_year",
    f"SELECT year, dow, dow_name, trips, {r6('pct_of_year')} FROM (SELECT year, dow, dow_name, CAST(sum(trips) AS BIGINT) AS trips, "
    "sum(trips) / sum(sum(trips)) OVER (PARTITION BY year) * 100 AS pct_of_year FROM by_dow GROUP BY year, dow, dow_name)",
)
def _(v):
    return report.dow_year_shares(v.usage["trips_by_dow"])


@query(
    "win2_hour_window_shares",
    f"SELECT mode, hour, week_part, trips, {r6('pct_of_mode_year_trips', 'pct_within_week_part')} FROM hour_target",
)
def _(v):
    from wayrisk.plans.windows import across_years

    return across_years(v.usage["trips_by_hour_week_part"], ["mode", "hour", "week_part"])


@query(
    "win2_hour_shares_by_year",
    """SELECT *, round(trips / sum(trips) OVER (PARTITION BY mode, year) * 100, 6) AS pct_of_mode_year_trips,
       round(trips / sum(trips) OVER (PARTITION BY mode, year, week_part) * 100, 6) AS pct_within_week_part FROM by_hour_part""",
)
def _(v):
    return shares.with_window_shares(v.usage["trips_by_hour_week_part"])


@query(
    "agg31_hour_summary",
    """SELECT hour, CAST(sum(trips) AS BIGINT) AS trips, round(sum(trips) / sum(sum(trips)) OVER () * 100, 6) AS pct_of_daily
       FROM by_hour GROUP BY hour""",
)
def _(v):
    return report.hour_summary(v.usage["trips_by_hour"])


@query(
    "agg31_dow_summary",
    """SELECT dow, dow_name, CAST(sum(trips) AS BIGINT) AS trips,
       round(sum(trips) / sum(sum(trips)) OVER () * 100, 6) AS pct_of_weekly FROM by_dow GROUP BY ALL""",
)
def _(v):
    return report.dow_summary(v.usage["trips_by_dow"])


@query(
    "agg31_week_part_summary",
    """SELECT week_part, CAST(sum(trips) AS BIGINT) AS trips, round(sum(trips) / sum(sum(trips)) OVER () * 100, 6) AS pct
       FROM by_dow GROUP BY ALL""",
)
def _(v):
    return report.week_part_summary(v.usage["trips_by_dow"])


@query(
    "agg31_week_part_by_year",
    """SELECT year, week_part, CAST(sum(trips) AS BIGINT) AS trips,
       round(sum(trips) / sum(sum(trips)) OVER (PARTITION BY year) * 100, 6) AS pct FROM by_dow GROUP BY year, week_part""",
)
def _(v):
    return report.week_part_summary(v.usage["trips_by_dow"], by_year=True)


@query(
    "agg32_month_by_year_pivot",
    "SELECT month, "
    + ", ".join(f"CAST(sum(trips) FILTER (WHERE year = {y}) AS BIGINT) AS y{y}" for y in TWIN_YEARS)
    + " FROM by_month GROUP BY month",
)
def _(v):
    return shares.pivot_years(v.usage["trips_by_month"], ["month"], "trips", _years(v))


@query(
    "agg32_dow_by_year_pivot",
    "SELECT dow, dow_name, "
    + ", ".join(f"CAST(sum(trips) FILTER (WHERE year = {y}) AS BIGINT) AS y{y}" for y in TWIN_YEARS)
    + " FROM by_dow GROUP BY ALL",
)
def _(v):
    return shares.pivot_years(v.usage["trips_by_dow"], ["dow", "dow_name"], "trips", _years(v))


@query(
    "agg32_dow_share_pivot",
    "SELECT dow_name, "
    + ", ".join(f"round(max(p) FILTER (WHERE year = {y}), 6) AS y{y}" for y in TWIN_YEARS)
    + """ FROM (SELECT year, dow_name, sum(trips) / sum(sum(trips)) OVER (PARTITION BY year) * 100 AS p
         FROM by_dow GROUP BY year, dow_name) GROUP BY dow_name""",
)
def _(v):
    table = report.dow_year_shares(v.usage["trips_by_dow"])
    return shares.pivot_years(table, ["dow_name"], "pct_of_year", _years(v))


@query(
    "agg42_dow_totals",
    "SELECT dow, CAST(sum(trips) AS BIGINT) AS trips FROM by_dow GROUP BY dow",
)
def _(v):
    return v.usage["trips_by_dow"].groupBy("dow").agg(F.sum("trips").alias("trips"))


@query(
    "top1_highlights",
    """SELECT * FROM (SELECT 'years' AS list, CAST(year AS VARCHAR) AS label, trips FROM by_year ORDER BY trips DESC, label LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'year_months', year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS label, trips
         FROM by_month ORDER BY trips DESC, label LIMIT 10)
       UNION ALL SELECT * FROM (SELECT 'days_of_week', CAST(dow AS VARCHAR) AS label, CAST(sum(trips) AS BIGINT) AS trips
         FROM by_dow GROUP BY dow ORDER BY trips DESC, label LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'hours', CAST(hour AS VARCHAR) AS label, CAST(sum(trips) AS BIGINT) AS trips
         FROM by_hour GROUP BY hour ORDER BY trips DESC, label LIMIT 5)""",
)
def _(v):
    return summaries.highlights(v.usage)


@query(
    "win13_first_hours_per_year",
    """SELECT mode, year, hour, trips FROM by_hour
       QUALIFY row_number() OVER (PARTITION BY year ORDER BY hour, mode) <= 8""",
)
def _(v):
    return report.first_hours(v.usage["trips_by_hour"])


@query("win16_overlay_years", "SELECT * FROM by_year WHERE year IN (SELECT unnest([min(year), max(year)]) FROM by_year)")
def _(v):
    ends = report.overlay_years(_years(v))
    return filters.select_periods(v.usage["trips_by_year"], years=ends)


@query(
    "flt11_period_selection",
    f"SELECT mode, year, month, trips, {r6('trips_per_day')} FROM by_month WHERE year IN (1996, 1999) AND month IN (1, 2, 3)",
)
def _(v):
    return filters.select_periods(v.usage["trips_by_month"], [1996, 1999], [1, 2, 3])


@query("flt14_mode_selection", "SELECT * FROM by_year WHERE mode = 'jc'")
def _(v):
    return filters.select_mode(v.usage["trips_by_year"], "JC")


@query(
    "flt13_commuter_hours",
    "SELECT * FROM by_hour_part WHERE week_part = 'weekday' AND hour IN (7, 8, 9, 16, 17, 18, 19)",
)
def _(v):
    return filters.commuter_hours(v.usage["trips_by_hour_week_part"])


@query(
    "set4_distinct_periods",
    "SELECT DISTINCT year, month FROM trips",
)
def _(v):
    return v.trips.select("year", "month").distinct()


@query(
    "tab5_target_windows",
    f"""SELECT mode, window_type, segment, window_label, trips,
        {r6('pct_of_mode_year_trips', 'pct_within_week_part', 'priority_metric')}, recommended_action FROM windows""",
)
def _(v):
    return v.windows


@query(
    "top3_top_months",
    f"""SELECT mode, window_label, trips, {r6('priority_metric')} FROM windows WHERE window_type = 'month_peak'""",
)
def _(v):
    return v.windows.where("window_type = 'month_peak'").select("mode", "window_label", "trips", "priority_metric")


@query(
    "top2_top_hours_per_week_part",
    "SELECT mode, segment, window_label, trips FROM windows WHERE window_type = 'hour_peak'",
)
def _(v):
    return v.windows.where("window_type = 'hour_peak'").select("mode", "segment", "window_label", "trips")


@query(
    "top7_when_windows",
    f"""SELECT mode, window_type, segment, window_label, trips, {r6('pct_of_mode_year_trips', 'priority_metric')}, recommended_action
        FROM windows ORDER BY windows.priority_metric DESC, mode, window_type, segment, window_label LIMIT 20""",
)
def _(v):
    return report.when_windows(v.windows)
