"""Comparison of runs: three runs of the same trips over different years and months."""

from wayrisk.catalog.registry import query
from wayrisk.plans import compare

_YOY = """SELECT b.mode, b.year, b.run_tag, b.trips, b.months_covered, y.yoy_trips, y.yoy_months_covered, y.yoy_months_set,
    '{basis}' AS yoy_basis FROM best b LEFT JOIN (
      SELECT mode, year, CAST(sum(trips) AS BIGINT) AS yoy_trips, count(DISTINCT month) AS yoy_months_covered,
        array_to_string(list_sort(list(DISTINCT month)), ',') AS yoy_months_set
      FROM best_month {where} GROUP BY ALL) y USING (mode, year)"""
_CHANGE = """SELECT mode, year, run_tag, trips, months_covered, yoy_trips, yoy_months_covered, yoy_months_set, yoy_basis,
    round(yoy_pct, 6) AS yoy_pct, round(trips_per_month, 6) AS trips_per_month,
    round(CASE WHEN yoy_pct IS NOT NULL AND lag(trips_per_month) OVER w > 0
      THEN (trips_per_month / lag(trips_per_month) OVER w - 1) * 100 END, 6) AS trips_per_month_yoy_pct
  FROM (SELECT *, CASE WHEN {ok} AND lag(yoy_trips) OVER w > 0
            THEN (yoy_trips / lag(yoy_trips) OVER w - 1) * 100 END AS yoy_pct,
          yoy_trips / {months} AS trips_per_month
        FROM ({rows}) WINDOW w AS (PARTITION BY mode ORDER BY year))
  WINDOW w AS (PARTITION BY mode ORDER BY year)"""
_SHARE = """SELECT t.*, CAST(sum(trips) OVER (PARTITION BY mode, year) AS BIGINT) AS year_trips,
    round(trips / sum(trips) OVER (PARTITION BY mode, year) * 100, 6) AS pct_of_mode_year_trips FROM ({rows}) t"""


@query(
    "agg17_months_covered",
    "SELECT run_tag, mode, year, count(DISTINCT month) AS months_covered FROM run_month GROUP BY ALL",
)
def _(v):
    return compare.months_covered(v.runs["trips_by_month"])


@query("win11_best_runs", "SELECT * FROM best")
def _(v):
    return compare.best_runs(v.runs["trips_by_year"], v.runs["trips_by_month"])


@query("joi5_month_shares_all", _SHARE.format(rows="SELECT * FROM best_month"))
def _(v):
    return compare.comparison_tables(v.runs)["trips_by_month_all"]


@query(
    "agg13_month_of_year_all",
    """SELECT mode, month, CAST(sum(trips) AS BIGINT) AS trips,
       round(sum(trips) / sum(sum(trips)) OVER (PARTITION BY mode) * 100, 6) AS pct_of_mode_all_trips FROM best_month GROUP BY mode, month""",
)
def _(v):
    return compare.comparison_tables(v.runs)["trips_by_month_of_year_all"]


@query(
    "agg15_month_set_signature",
    """SELECT mode, year, CAST(sum(trips) AS BIGINT) AS yoy_trips, count(DISTINCT month) AS yoy_months_covered,
       array_to_string(list_sort(list(DISTINCT month)), ',') AS yoy_months_set FROM best_month GROUP BY ALL""",
)
def _(v):
    tables = compare.comparison_tables(v.runs)
    return compare.yoy_basis(tables["trips_by_month_all"])


@query(
    "win9_year_over_year",
    _CHANGE.format(
        ok="yoy_months_set = lag(yoy_months_set) OVER w",
        months="yoy_months_covered",
        rows=_YOY.format(basis="full_coverage_match_required", where=""),
    ),
)
def _(v):
    return compare.comparison_tables(v.runs)["trips_by_year_all"]


@query(
    "win10_year_over_year_months",
    _CHANGE.format(
        ok="yoy_months_set = '1,2,3,10' AND lag(yoy_months_set) OVER w = '1,2,3,10'",
        months="4",
        rows=_YOY.format(basis="months=1,2,3,10", where="WHERE month IN (1, 2, 3, 10)"),
    ),
)
def _(v):
    return compare.comparison_tables(v.runs, yoy_months=[1, 2, 3, 10])["trips_by_year_all"]


_RUN_DOW = """SELECT run_tag, mode, year, isodow(started_at) - 1 AS dow, count(*) AS trips FROM run_trips
    WHERE started_at IS NOT NULL GROUP BY ALL"""
_RUN_HOUR = "SELECT run_tag, mode, year, hour(started_at) AS hour, count(*) AS trips FROM run_trips WHERE started_at IS NOT NULL GROUP BY ALL"


@query(
    "joi7_dow_shares_all",
    _SHARE.format(rows=f"SELECT d.* FROM ({_RUN_DOW}) d SEMI JOIN best USING (run_tag, mode, year)"),
)
def _(v):
    return compare.comparison_tables(v.runs)["trips_by_dow_all"]


@query(
    "joi7_hour_shares_all",
    _SHARE.format(rows=f"SELECT h.* FROM ({_RUN_HOUR}) h SEMI JOIN best USING (run_tag, mode, year)"),
)
def _(v):
    return compare.comparison_tables(v.runs)["trips_by_hour_all"]


@query(
    "joi8_backfilled_dow",
    """SELECT d.run_tag, b.mode, b.year, d.dow, d.trips FROM (
         SELECT run_tag, isodow(started_at) - 1 AS dow, count(*) AS trips FROM run_trips WHERE started_at IS NOT NULL GROUP BY ALL) d
       JOIN best b USING (run_tag)""",
)
def _(v):
    from pyspark.sql import functions as F

    best = compare.best_runs(v.runs["trips_by_year"], v.runs["trips_by_month"])
    old = v.runs["trips_by_dow"].groupBy("run_tag", "dow").agg(F.sum("trips").alias("trips"))
    return compare.backfill_keys(old, best)
