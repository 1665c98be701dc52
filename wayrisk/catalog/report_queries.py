"""Report tables: high risk, clusters, zones, tiers, distributions, decisions, summaries."""

from pyspark.sql import functions as F

from wayrisk.catalog.registry import query, r6
from wayrisk.catalog.views import MIN_TRIPS, MIN_TRIPS_MONTH, MIN_TRIPS_YEAR
from wayrisk.functions import expr as X
from wayrisk.operators import filters
from wayrisk.operators.canonical import drop_boolean_columns
from wayrisk.operators.filters import single_mode
from wayrisk.plans import report

EB = report.EB
_ROW = f"mode, start_station_id, exposure_trips, crash_count, {r6(EB)}"
_CHOICE = ["mode", "start_station_id", "exposure_trips", "crash_count", EB]


def _high(v):
    return report.high_risk(v.stored_score(), MIN_TRIPS)


@query("flt15_high_risk_rows", f"SELECT {_ROW} FROM high")
def _(v):
    return _high(v).select(*_CHOICE)


@query("flt15_high_risk_by_index", f"SELECT {_ROW} FROM credible WHERE risk_index_pct >= 90")
def _(v):
    return report.high_risk(v.stored_score(), MIN_TRIPS, by_index=True).select(*_CHOICE)


@query("flt10_credible_rows", f"SELECT {_ROW} FROM credible")
def _(v):
    return filters.credible(v.stored_score()).select(*_CHOICE)


@query(
    "agg26_high_risk_cutoff",
    f"SELECT round(quantile_cont({EB}, 0.9), 6) AS cutoff FROM credible",
)
def _(v):
    from wayrisk.operators.ordering import percentiles

    return percentiles(filters.credible(v.stored_score()), [], EB, {"cutoff": 0.9})


@query(
    "agg18_high_risk_totals",
    "SELECT count(*) AS high_risk_rows, CAST(sum(exposure_trips) AS BIGINT) AS high_risk_exposure FROM high",
)
def _(v):
    return report.high_risk_totals(_high(v))


@query(
    "top9_top_high_risk",
    f"SELECT {_ROW} FROM high ORDER BY high.{EB} DESC, exposure_trips DESC, mode, start_station_id LIMIT 10",
)
def _(v):
    return report.top_high_risk(_high(v)).select(*_CHOICE)


@query(
    "agg33_rows_by_period",
    "SELECT year, month, count(*) AS rows FROM score_month GROUP BY year, month",
)
def _(v):
    return report.rows_by_period(v.stored_score("year_month"))


@query(
    "agg18_credibility_counts",
    "SELECT credibility_flag, count(*) AS stations FROM score GROUP BY 1",
)
def _(v):
    return report.counts_of(v.stored_score(), "credibility_flag")


_ZONED = f"""(SELECT *, CASE WHEN exposure_trips >= x AND rate >= y THEN 'High exposure / High risk'
    WHEN exposure_trips >= x THEN 'High exposure / Lower risk' WHEN rate >= y THEN 'Lower exposure / High risk'
    ELSE 'Lower exposure / Lower risk' END AS zone FROM (
      SELECT *, {EB} AS rate, median(exposure_trips) OVER () AS x, median({EB}) OVER () AS y FROM credible))"""


@query("sta9_risk_zones", f"SELECT {_ROW}, zone FROM {_ZONED}")
def _(v):
    return report.risk_zones(v.stored_score(), MIN_TRIPS).select(*_CHOICE, "zone")


@query("agg18_zone_counts", f"SELECT zone, count(*) AS stations FROM {_ZONED} GROUP BY zone")
def _(v):
    return report.counts_of(report.risk_zones(v.stored_score(), MIN_TRIPS), "zone")


@query(
    "top8_high_priority_stations",
    f"""SELECT {_ROW} FROM {_ZONED} z WHERE zone = 'High exposure / High risk'
        ORDER BY z.rate DESC, exposure_trips DESC, mode, start_station_id LIMIT 15""",
)
def _(v):
    return report.high_priority(report.risk_zones(v.stored_score(), MIN_TRIPS)).select(*_CHOICE)


@query(
    "sta9_zones_from_raw_rates",
    f"""SELECT mode, start_station_id, trips, round(rate, 6) AS crashes_per_100k_trips,
        CASE WHEN trips >= x AND rate >= y THEN 'High exposure / High risk' WHEN trips >= x THEN 'High exposure / Lower risk'
          WHEN rate >= y THEN 'Lower exposure / High risk' ELSE 'Lower exposure / Lower risk' END AS zone
        FROM (SELECT *, median(trips) OVER () AS x, median(rate) OVER () AS y FROM (
          SELECT mode, start_station_id, trips, crashes_within_500m / trips * 100000 AS rate FROM risk_life WHERE trips >= {MIN_TRIPS}))""",
)
def _(v):
    rated = report.zone_rates_from_risk(v.risk(), 500)
    zoned = report.risk_zones(rated, MIN_TRIPS, trips="trips", rate="crashes_per_100k_trips")
    return zoned.select("mode", "start_station_id", "trips", "crashes_per_100k_trips", "zone")


_TIER = """CASE WHEN risk_index_pct < 0 THEN NULL WHEN risk_index_pct <= 33 THEN 'Low Risk' WHEN risk_index_pct <= 66 THEN 'Medium Risk'
    WHEN risk_index_pct <= 100 THEN 'High Risk' END"""


@query("sta10_risk_tiers", f"SELECT {_ROW}, {_TIER} AS risk_tier FROM credible")
def _(v):
    return report.with_tiers(v.stored_score(), MIN_TRIPS).select(*_CHOICE, "risk_tier")


@query(
    "agg29_tier_shares",
    f"""SELECT tier_order, risk_tier, count(tier) AS stations, round(count(tier) / (SELECT count(*) FROM credible) * 100, 6) AS pct
        FROM (VALUES (1, 'Low Risk'), (2, 'Medium Risk'), (3, 'High Risk')) t(tier_order, risk_tier)
        LEFT JOIN (SELECT {_TIER} AS tier FROM credible) c ON c.tier = t.risk_tier GROUP BY ALL""",
)
def _(v):
    return report.tier_shares(report.with_tiers(v.stored_score(), MIN_TRIPS))


@query(
    "agg28_rate_histogram",
    f"""SELECT bin, round(lo + bin * (hi - lo) / 30, 6) AS bin_start, count(*) AS stations FROM (
          SELECT lo, hi, least(CAST(floor((v - lo) / ((hi - lo) / 30)) AS INT), 29) AS bin FROM (
            SELECT {EB} AS v, min({EB}) OVER () AS lo, max({EB}) OVER () AS hi FROM credible)) GROUP BY ALL""",
)
def _(v):
    return report.rate_histogram(v.stored_score(), min_trips=MIN_TRIPS)


@query("agg25_median_rate", f"SELECT round(median({EB}), 6) AS median_rate FROM credible")
def _(v):
    return report.median_rate(v.stored_score(), MIN_TRIPS)


_SEASON = f"""SELECT year, month, quantile_cont({EB}, 0.25) AS q25, quantile_cont({EB}, 0.5) AS q50, quantile_cont({EB}, 0.75) AS q75
    FROM score_month WHERE credibility_flag = 'credible' GROUP BY year, month"""


@query("agg24_seasonality_quartiles", f"SELECT year, month, {r6('q25', 'q50', 'q75')} FROM ({_SEASON})")
def _(v):
    return report.seasonality(v.stored_score("year_month"), MIN_TRIPS_MONTH)


@query(
    "agg32_seasonality_heatmap",
    "SELECT year, "
    + ", ".join(f"round(max(q50) FILTER (WHERE month = {m}), 6) AS m{m:02d}" for m in range(1, 13))
    + f" FROM ({_SEASON}) GROUP BY year",
)
def _(v):
    return report.seasonality_heatmap(report.seasonality(v.stored_score("year_month"), MIN_TRIPS_MONTH), range(1, 13))


@query(
    "agg27_yearly_distribution",
    f"""SELECT year, {r6('q25', 'q50', 'q75')}, rows, round(low, 6) AS whisker_low, round(high, 6) AS whisker_high FROM (
        SELECT year, q25, q50, q75, count(*) AS rows, min(v) FILTER (WHERE v >= q25 - 1.5 * (q75 - q25)) AS low,
          max(v) FILTER (WHERE v <= q75 + 1.5 * (q75 - q25)) AS high FROM (
            SELECT year, {EB} AS v, quantile_cont({EB}, 0.25) OVER (PARTITION BY year) AS q25,
              quantile_cont({EB}, 0.5) OVER (PARTITION BY year) AS q50, quantile_cont({EB}, 0.75) OVER (PARTITION BY year) AS q75
            FROM score_year WHERE credibility_flag = 'credible') GROUP BY ALL)""",
)
def _(v):
    return report.yearly_distribution(v.stored_score("year"), MIN_TRIPS_YEAR)


_WEIGHTED = f"""SELECT mode, start_station_id, year, CAST(sum(exposure_trips) AS BIGINT) AS exposure_sum,
    sum({EB} * exposure_trips) / sum(exposure_trips) AS eb_rate_weighted FROM score_month GROUP BY ALL"""


@query(
    "agg35_weighted_rates",
    f"SELECT mode, start_station_id, year, exposure_sum, {r6('eb_rate_weighted')} FROM ({_WEIGHTED})",
)
def _(v):
    return report.weighted_rates(v.stored_score("year_month"))


@query(
    "joi11_station_change",
    f"""SELECT a.mode, a.start_station_id, a.exposure_sum AS exposure_first, b.exposure_sum AS exposure_last,
        round(a.eb_rate_weighted, 6) AS rate_first, round(b.eb_rate_weighted, 6) AS rate_last,
        a.exposure_sum + b.exposure_sum AS exposure_total
        FROM ({_WEIGHTED}) a JOIN ({_WEIGHTED}) b USING (mode, start_station_id) WHERE a.year = 1995 AND b.year = 2001
          AND a.eb_rate_weighted IS NOT NULL AND b.eb_rate_weighted IS NOT NULL
        ORDER BY exposure_total DESC, a.mode, a.start_station_id LIMIT 120""",
)
def _(v):
    return report.station_change(report.weighted_rates(v.stored_score("year_month")), 1995, 2001, 120)


_BURDEN = f"""SELECT mode, year, start_station_id, trips, k, (k + r0 * 20000) / (trips + 20000) AS eb FROM (
    SELECT mode, year, start_station_id, trips, crashes_within_500m AS k,
      sum(crashes_within_500m) OVER (PARTITION BY mode, year) / sum(trips) OVER (PARTITION BY mode, year) AS r0
    FROM risk_year WHERE trips >= {MIN_TRIPS_YEAR})"""


@query(
    "agg21_yearly_burden",
    f"SELECT mode, year, round(sum(eb * trips), 6) AS eb_expected_crashes FROM ({_BURDEN}) GROUP BY mode, year",
)
def _(v):
    return report.yearly_burden(report.yearly_rates(v.risk("year"), 500, MIN_TRIPS_YEAR))


@query(
    "top4_top_rates_of_a_year",
    f"""SELECT mode, year, start_station_id, trips AS exposure_trips, k AS crash_count, round(eb * 100000, 6) AS {EB}
        FROM ({_BURDEN}) b WHERE year = 1997 ORDER BY b.eb DESC, mode, start_station_id LIMIT 20""",
)
def _(v):
    rates = report.yearly_rates(v.risk("year"), 500, MIN_TRIPS_YEAR).where(F.col("year") == 1997)
    return report._top(rates, 20, EB).select("mode", "year", "start_station_id", "exposure_trips", "crash_count", EB)


_FOLDED = """SELECT mode, year, start_station_id, start_station_name, CAST(sum(trips) AS BIGINT) AS trips,
    CAST(sum(crashes_within_500m) AS BIGINT) AS crashes_within_500m FROM risk_month GROUP BY ALL"""


@query("agg23_months_folded_to_years", _FOLDED)
def _(v):
    return report.fold_to_years(v.risk("year_month"), "crashes_within_500m")


@query(
    "agg22_crash_ratio_by_year",
    """SELECT year, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(crashes_within_500m) AS BIGINT) AS crashes,
       round(sum(crashes_within_500m) / sum(trips) * 100000, 6) AS crashes_per_100k_trips FROM risk_month GROUP BY year""",
)
def _(v):
    return report.crash_ratio(v.risk("year_month"), ["year"])


@query(
    "agg22_crash_ratio_by_year_month",
    """SELECT year, month, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(crashes_within_500m) AS BIGINT) AS crashes,
       round(sum(crashes_within_500m) / sum(trips) * 100000, 6) AS crashes_per_100k_trips FROM risk_month GROUP BY year, month""",
)
def _(v):
    return report.crash_ratio(v.risk("year_month"), ["year", "month"])


_TOP_STATION = """SELECT year, month, start_station_id, start_station_name, trips FROM (
    SELECT year, month, start_station_id, start_station_name, CAST(sum(trips) AS BIGINT) AS trips FROM exposure GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY year, month ORDER BY trips DESC, start_station_id) = 1"""


@query("win12_top_station_by_month", _TOP_STATION)
def _(v):
    return report.top_station_by_month(v.exposure)


@query("win12_top_station_trips_by_year", f"SELECT year, CAST(sum(trips) AS BIGINT) AS trips FROM ({_TOP_STATION}) GROUP BY year")
def _(v):
    return report.top_station_trips_by_year(report.top_station_by_month(v.exposure))


@query(
    "top6_where_prevention",
    f"""SELECT mode, start_station_id, start_station_name, exposure_trips, crash_count,
        {r6(EB, 'expected_incidents_proxy', 'priority_score')}, credibility_flag FROM credible
        ORDER BY credible.expected_incidents_proxy DESC, exposure_trips DESC, mode, start_station_id LIMIT 20""",
)
def _(v):
    return report.where_prevention(v.stored_score())


@query(
    "top6_where_reach",
    """SELECT mode, start_station_id, start_station_name, exposure_trips, credibility_flag FROM score
       ORDER BY exposure_trips DESC, mode, start_station_id LIMIT 20""",
)
def _(v):
    return report.where_reach(v.stored_score())


@query(
    "top6_where_by_proxy",
    f"""SELECT mode, start_station_id, {r6('priority_score')}, risk_proxy_available FROM score
        ORDER BY risk_proxy_available DESC, score.priority_score DESC, mode, start_station_id LIMIT 20""",
)
def _(v):
    return report.where_by_proxy(v.stored_score()).select("mode", "start_station_id", "priority_score", "risk_proxy_available")


@query(
    "top4_lowest_exposure",
    "SELECT mode, start_station_id, trips FROM risk_life ORDER BY trips, mode, start_station_id LIMIT 10",
)
def _(v):
    return report.lowest_exposure(v.risk(), trips="trips").select("mode", "start_station_id", "trips")


@query(
    "top4_top_expected_incidents",
    f"""SELECT mode, start_station_id, {r6('expected_incidents_proxy')} FROM credible
        ORDER BY credible.expected_incidents_proxy DESC, mode, start_station_id LIMIT 20""",
)
def _(v):
    top = report._top(filters.credible(v.stored_score()), 20, "expected_incidents_proxy")
    return top.select("mode", "start_station_id", "expected_incidents_proxy")


@query(
    "sta12_plain_metrics",
    """SELECT mode, start_station_id, round(crashes_within_500m / trips * 100, 6) AS crash_rate_pct,
       round(trips / nullif(crashes_within_500m, 0), 6) AS trips_per_crash FROM risk_life""",
)
def _(v):
    return report.plain_metrics(v.risk(), 500).select("mode", "start_station_id", "crash_rate_pct", "trips_per_crash")


@query(
    "prj24_credibility_fallback",
    f"""SELECT mode, start_station_id, CASE WHEN trips >= {MIN_TRIPS} THEN 'credible' ELSE 'insufficient_data' END AS credibility_flag
        FROM risk_life""",
)
def _(v):
    return v.risk().select(
        "mode", "start_station_id", X.credibility(F.col("trips"), MIN_TRIPS).alias("credibility_flag")
    )


@query("prj17_without_boolean_columns", f"SELECT mode, start_station_id, {r6('priority_score')} FROM score")
def _(v):
    card = v.stored_score().select("mode", "start_station_id", "priority_score", "prevention_hotspot", "product_hotspot")
    return drop_boolean_columns(card)


@query(
    "agg20_run_summary",
    """SELECT (SELECT CAST(sum(trips) AS BIGINT) FROM by_year) AS total_trips, count(DISTINCT start_station_id) AS unique_stations,
       count(*) AS station_periods, count(*) FILTER (WHERE credibility_flag = 'credible') AS credible_station_periods,
       count(*) FILTER (WHERE prevention_hotspot) AS prevention_hotspots FROM score""",
)
def _(v):
    return report.run_summary(v.usage["trips_by_year"], v.stored_score())


@query(
    "agg19_executive_summary",
    f"""WITH t AS (SELECT *, {_TIER} AS tier, credibility_flag = 'credible' AS c FROM score),
        n AS (SELECT count(*) AS a, count(*) FILTER (WHERE c) AS k, count(*) FILTER (WHERE c AND tier = 'High Risk') AS h,
          count(*) FILTER (WHERE c AND tier = 'Medium Risk') AS m, count(*) FILTER (WHERE c AND tier = 'Low Risk') AS l,
          count(*) FILTER (WHERE prevention_hotspot) AS p, count(*) FILTER (WHERE product_hotspot) AS q,
          count(*) FILTER (WHERE acquisition_hotspot) AS z FROM t)
        SELECT 1 AS position, 'Total station-period rows' AS metric, a AS value, NULL AS pct, 'mode=multiple' AS notes FROM n
        UNION ALL SELECT 2, 'Credible rows (>={MIN_TRIPS:,} trips)', k, round(k / a * 100, 6), 'Enough volume to trust risk ranking' FROM n
        UNION ALL SELECT 3, 'High Risk rows', h, round(h / k * 100, 6), 'Premium pricing / targeted prevention' FROM n
        UNION ALL SELECT 4, 'Medium Risk rows', m, round(m / k * 100, 6), 'Standard pricing' FROM n
        UNION ALL SELECT 5, 'Low Risk rows', l, round(l / k * 100, 6), 'Discount / acquisition-friendly' FROM n
        UNION ALL SELECT 6, 'Prevention hotspots', p, NULL, 'High exposure + high risk → safety pilots' FROM n
        UNION ALL SELECT 7, 'Product hotspots', q, NULL, 'High exposure → strong sales reach' FROM n
        UNION ALL SELECT 8, 'Acquisition hotspots', z, NULL, 'High exposure + low risk → easy wins' FROM n""",
)
def _(v):
    return report.executive_summary(v.stored_score(), MIN_TRIPS)


# --- clusters: components of the eps graph, by a recursive walk in SQL -------
DENSE = 40  # about as many crashes as the average crash of the smaller folders has within eps


def _clusters_sql(rows: str, body: str) -> str:
    return f"""WITH RECURSIVE pts AS ({rows}),
      near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b
        ON pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2) <= 0.01 * 0.01),
      reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
      roots AS (SELECT a AS id, min(b) AS root, count(DISTINCT b) AS n FROM reach GROUP BY a),
      numbered AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS no FROM (SELECT DISTINCT root FROM roots WHERE n > 1)),
      clustered AS (SELECT p.*, coalesce(no, -1) AS cluster FROM pts p JOIN roots USING (id) LEFT JOIN numbered USING (root))
      {body}"""


_STATION_POINTS = """SELECT mode || start_station_id AS id, station_lat AS lat, station_lng AS lng, trips AS exposure_trips,
    crashes_within_500m AS crash_count FROM risk_life"""


def _station_points(v):
    return v.risk().select(
        F.concat("mode", "start_station_id").alias("id"),
        "station_lat",
        "station_lng",
        F.col("trips").alias("exposure_trips"),
        F.col("crashes_within_500m").alias("crash_count"),
    )


@query("sta11_density_clusters", _clusters_sql(_STATION_POINTS, "SELECT id, cluster FROM clustered"))
def _(v):
    return report.high_risk_clusters(_station_points(v), key="id").select("id", "cluster")


@query(
    "agg30_cluster_summary",
    _clusters_sql(
        _STATION_POINTS,
        """SELECT cluster, count(*) AS stations_in_cluster, CAST(sum(exposure_trips) AS BIGINT) AS exposure_trips,
           CAST(sum(crash_count) AS BIGINT) AS crash_count, round(avg(lat), 6) AS station_lat, round(avg(lng), 6) AS station_lng
           FROM clustered WHERE cluster >= 0 GROUP BY cluster""",
    ),
)
def _(v):
    return report.cluster_summary(report.high_risk_clusters(_station_points(v), key="id"))


@query(
    "agg30_cluster_totals",
    _clusters_sql(
        _STATION_POINTS,
        "SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS clusters, count(*) FILTER (WHERE cluster = -1) AS isolated_stations FROM clustered",
    ),
)
def _(v):
    return report.cluster_totals(report.high_risk_clusters(_station_points(v), key="id"))


def _dense_sql(points: str, min_samples: int) -> str:
    """Density clusters of any size: neighbours by grid cells, least label carried along core links, nearest core for the rest."""
    return f"""WITH RECURSIVE pts AS ({points}),
      gridded AS (SELECT *, CAST(floor(lat / 0.0101) AS BIGINT) AS ci, CAST(floor(lng / 0.0101) AS BIGINT) AS cj FROM pts),
      around AS (SELECT id, lat, lng, ci + di AS ci, cj + dj AS cj FROM gridded, (VALUES (-1), (0), (1)) AS a(di), (VALUES (-1), (0), (1)) AS b(dj)),
      near AS (SELECT a.id AS a, b.id AS b, pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2) AS d FROM around a JOIN gridded b USING (ci, cj)
        WHERE pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2) <= 0.01 * 0.01),
      cores AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {min_samples}),
      links AS (SELECT a, b FROM near SEMI JOIN cores x ON x.id = near.a SEMI JOIN cores y ON y.id = near.b WHERE a <> b),
      labels(id, label) USING KEY (id) AS (
        SELECT id, id AS label FROM cores
        UNION
        (SELECT l.b, min(t.label) FROM labels t JOIN links l ON l.a = t.id JOIN recurring.labels r ON r.id = l.b
         GROUP BY l.b HAVING min(t.label) < any_value(r.label))),
      numbered AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS no FROM (SELECT DISTINCT label FROM labels)),
      beside AS (SELECT a AS id, arg_min(b, (d, b)) AS core FROM near SEMI JOIN cores y ON y.id = near.b ANTI JOIN cores x ON x.id = near.a GROUP BY a)
      SELECT p.id, CAST(coalesce(own.no, other.no, -1) AS INT) AS cluster FROM pts p
      LEFT JOIN labels l ON l.id = p.id LEFT JOIN numbered own ON own.label = l.label
      LEFT JOIN beside s ON s.id = p.id LEFT JOIN labels m ON m.id = s.core LEFT JOIN numbered other ON other.label = m.label"""


_CRASH_POINTS = "SELECT collision_id AS id, latitude AS lat, longitude AS lng FROM crashes"


def _crash_points(v):
    return v.crashes.select(
        F.col("collision_id").alias("id"), F.col("latitude").alias("station_lat"), F.col("longitude").alias("station_lng")
    )


# all crashes as points: far more of them, so cells merge points and links chain far
@query("joi10_crash_clusters", _dense_sql(_CRASH_POINTS, 2))
def _(v):
    return report.high_risk_clusters(_crash_points(v), key="id").select("id", "cluster")


@query("sta11_dense_crash_clusters", _dense_sql(_CRASH_POINTS, DENSE))
def _(v):
    return report.high_risk_clusters(_crash_points(v), key="id", min_samples=DENSE).select("id", "cluster")


@query("sta11_density_clusters_of_four", _dense_sql(_STATION_POINTS, 4))
def _(v):
    return report.high_risk_clusters(_station_points(v), key="id", min_samples=4).select("id", "cluster")


@query("agg41_crash_count_range", "SELECT min(crash_count) AS least, max(crash_count) AS most FROM score")
def _(v):
    return report.crash_count_range(v.score())


@query("prj14_one_mode", "SELECT mode, year, count(*) AS trips FROM trips WHERE mode = 'nyc' GROUP BY mode, year")
def _(v):
    rows, mode = single_mode(v.trips.withColumn("mode", F.upper("mode")), " NYC ")
    return rows.groupBy(F.lit(mode).alias("mode"), "year").agg(F.count(F.lit(1)).alias("trips"))
