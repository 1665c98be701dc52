"""Scorecard and the statistics under it."""

from pyspark.sql import functions as F

from wayrisk.catalog.registry import query, r6
from wayrisk.catalog.views import MIN_TRIPS
from wayrisk.operators import stats
from wayrisk.operators.ordering import percentiles, with_pct_rank
from wayrisk.plans import report
from wayrisk.plans.scorecard import build_scorecard, delivery_order, enrich_scorecard

# Exact Poisson bounds by bisection on the cdf, once per distinct count.
_BOUNDS = """bounds AS (
  WITH RECURSIVE ks AS (SELECT DISTINCT crash_count AS k FROM {score}),
  steps AS (
    SELECT k, 0 AS step, 0.0::DOUBLE AS lo_a, (k + 40 + 12 * sqrt(k + 1))::DOUBLE AS lo_b,
      0.0::DOUBLE AS hi_a, (k + 40 + 12 * sqrt(k + 1))::DOUBLE AS hi_b FROM ks
    UNION ALL
    SELECT k, step + 1,
      CASE WHEN lo_tail > 0.975 THEN lo_m ELSE lo_a END, CASE WHEN lo_tail > 0.975 THEN lo_b ELSE lo_m END,
      CASE WHEN hi_tail > 0.025 THEN hi_m ELSE hi_a END, CASE WHEN hi_tail > 0.025 THEN hi_b ELSE hi_m END
    FROM (SELECT *, (lo_a + lo_b) / 2 AS lo_m, (hi_a + hi_b) / 2 AS hi_m,
        list_sum(list_transform(range(CAST(k AS BIGINT)), lambda i: exp(i * ln((lo_a + lo_b) / 2) - (lo_a + lo_b) / 2 - lgamma(i + 1)))) AS lo_tail,
        list_sum(list_transform(range(CAST(k AS BIGINT) + 1), lambda i: exp(i * ln((hi_a + hi_b) / 2) - (hi_a + hi_b) / 2 - lgamma(i + 1)))) AS hi_tail
      FROM steps WHERE step < 70))
  SELECT k, CASE WHEN k = 0 THEN 0 ELSE (lo_a + lo_b) / 2 END AS low, (hi_a + hi_b) / 2 AS high FROM steps WHERE step = 70)"""


def _scored(score: str, extra: str = "") -> str:
    return f"""SELECT mode, {extra} start_station_id, start_station_name, {r6('station_lat', 'station_lng')}, exposure_trips, crash_count,
      {r6('risk_rate_per_100k_trips')}, round(low / exposure_trips * 100000, 6) AS risk_rate_ci_low,
      round(high / exposure_trips * 100000, 6) AS risk_rate_ci_high, risk_proxy_available, credibility_flag,
      {r6('exposure_pct', 'risk_pct', 'priority_score')}, prevention_hotspot, product_hotspot, acquisition_hotspot,
      {r6('exposure_index_pct', 'eb_risk_rate_per_100k_trips', 'risk_index_pct', 'expected_incidents_proxy')}, scoring_strategy
      FROM (WITH {_BOUNDS.format(score=score)} SELECT * FROM {score} JOIN bounds ON k = crash_count)"""


@query("tab4_scorecard", _scored("score"))
def _(v):
    return v.score()


@query("tab4_scorecard_by_year", _scored("score_year", "year,"))
def _(v):
    return v.score("year")


@query("tab4_scorecard_by_year_month", _scored("score_month", "year, month,"))
def _(v):
    return v.score("year_month")


@query(
    "sta7_exposure_only_fallback",
    f"""SELECT mode, start_station_id, credibility_flag, scoring_strategy, risk_proxy_available, {r6('exposure_pct')}, risk_pct,
        round(exposure_pct, 6) AS priority_score, exposure_index_pct >= 90 AS prevention_hotspot,
        exposure_index_pct >= 80 AS product_hotspot, exposure_index_pct >= 70 AS acquisition_hotspot FROM (
          SELECT mode, start_station_id, 'no_risk_data' AS credibility_flag, 'exposure_only_no_risk_signal' AS scoring_strategy,
            false AS risk_proxy_available, exposure_index_pct, exposure_index_pct / 100 AS exposure_pct, 0.0 AS risk_pct FROM score)""",
)
def _(v):
    # nobody reaches this many trips, so no mode has a signal
    card = build_scorecard(v.risk(), radius="1km", min_trips=1_000_000_000)
    return card.select(
        "mode", "start_station_id", "credibility_flag", "scoring_strategy", "risk_proxy_available", "exposure_pct",
        "risk_pct", "priority_score", "prevention_hotspot", "product_hotspot", "acquisition_hotspot",
    )


@query(
    "top5_scorecard_order",
    f"SELECT mode, start_station_id, {r6('priority_score')}, exposure_trips FROM score ORDER BY score.priority_score DESC, exposure_trips DESC",
)
def _(v):
    return delivery_order(v.score()).select("mode", "start_station_id", "priority_score", "exposure_trips")


@query(
    "sta1_eb_rate_given_prior",
    """SELECT mode, start_station_id, round((crash_count + r0 * 5000) / (exposure_trips + 5000) * 100000, 6) AS eb_rate FROM (
         SELECT mode, start_station_id, crashes_within_1000m AS crash_count, trips AS exposure_trips,
           sum(crashes_within_1000m) OVER (PARTITION BY mode) / sum(trips) OVER (PARTITION BY mode) AS r0 FROM risk_life)""",
)
def _(v):
    risk = v.risk()
    prior = stats.group_prior(risk, ["mode"], "crashes_within_1000m", "trips", m_prior=5000)
    rate = stats.eb_rate(F.col("crashes_within_1000m"), F.col("trips"), F.col("baseline_rate"), F.col("prior_trips"))
    return risk.join(prior, "mode").select("mode", "start_station_id", (rate * 100000.0).alias("eb_rate"))


@query(
    "agg10_prior_moments",
    f"""SELECT mode, {r6('mean_rate', 'mean_exposure')}, round(var_rate * 1000, 6) AS var_rate, rows_used, total_count, total_exposure FROM (
       SELECT mode, avg(k / n) AS mean_rate, var_samp(k / n) AS var_rate, avg(n) AS mean_exposure, count(*) AS rows_used,
         CAST(sum(k) AS BIGINT) AS total_count, CAST(sum(n) AS BIGINT) AS total_exposure
       FROM (SELECT mode, crashes_within_1000m AS k, trips AS n FROM risk_life) GROUP BY mode)""",
)
def _(v):
    moments = stats.prior_moments(v.risk(), ["mode"], "crashes_within_1000m", "trips")
    return moments.withColumn("var_rate", F.col("var_rate") * 1000)


@query(
    "sta2_prior_strength",
    """SELECT mode, round(sum(k) / sum(n), 6) AS baseline_rate, round(greatest(1000, least(100000,
         pow(avg(k / n), 2) / greatest(1e-10, var_samp(k / n) - avg(k / n) / avg(n)))), 4) AS prior_trips
       FROM (SELECT mode, crashes_within_1000m AS k, trips AS n FROM risk_life) GROUP BY mode""",
)
def _(v):
    prior = stats.group_prior(v.risk(), ["mode"], "crashes_within_1000m", "trips")
    return prior.withColumn("prior_trips", F.round("prior_trips", 4))


@query(
    "agg12_risk_signal",
    f"""SELECT mode, count(*) FILTER (WHERE trips >= {MIN_TRIPS}) >= 10
         AND count(DISTINCT CASE WHEN trips >= {MIN_TRIPS} THEN crashes_within_1000m_per_100k_trips END) > 1 AS risk_proxy_available
        FROM risk_life GROUP BY mode""",
)
def _(v):
    return stats.risk_signal(v.risk(), ["mode"], "crashes_within_1000m_per_100k_trips", "trips", MIN_TRIPS)


@query(
    "sta3_poisson_interval",
    f"""SELECT mode, start_station_id, crash_count, round(low / exposure_trips * 100000, 6) AS ci_low,
        round(high / exposure_trips * 100000, 6) AS ci_high FROM (WITH {_BOUNDS.format(score='score')}
        SELECT * FROM score JOIN bounds ON k = crash_count)""",
)
def _(v):
    risk = v.risk().withColumn("crash_count", F.col("crashes_within_1000m"))
    out = stats.with_poisson_interval(risk, "crash_count", "trips", prefix="ci")
    return out.select("mode", "start_station_id", "crash_count", "ci_low", "ci_high")




@query(
    "win1_percent_rank_heavy_ties",
    """SELECT mode, trip_no, round((rank() OVER (PARTITION BY mode ORDER BY minute) + (count(*) OVER (PARTITION BY mode, minute) - 1) / 2)
         / count(*) OVER (PARTITION BY mode) * 100, 6) AS pct_rank
       FROM (SELECT mode, trip_no, CASE WHEN trip_no % 3 = 0 THEN 0 ELSE trip_no % 1440 END AS minute FROM trips)""",
)
def _(v):
    # a third of the rows share one value; tiny buckets make the distributed path do real work
    rows = v.trips.select(
        "mode", "trip_no", F.when(F.col("trip_no") % 3 == 0, 0).otherwise(F.col("trip_no") % 1440).alias("minute")
    )
    ranked = with_pct_rank(
        rows, ["mode"], {"pct_rank": "minute"}, key=["trip_no"], parts=50
    )
    return ranked.select("mode", "trip_no", "pct_rank")


@query(
    "agg24_quartiles_of_trip_minutes",
    """SELECT year, month, quantile_cont(m, 0.25) AS q25, quantile_cont(m, 0.5) AS q50, quantile_cont(m, 0.75) AS q75
       FROM (SELECT year, month, datediff('minute', started_at, ended_at) AS m FROM trips) GROUP BY year, month""",
)
def _(v):
    from wayrisk.functions import expr as X

    rows = v.trips.select("year", "month", X.minutes_between(F.col("started_at"), F.col("ended_at")).alias("m"))
    return percentiles(
        rows, ["year", "month"], "m", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, parts=20
    )


@query(
    "sta8_enriched_scorecard",
    """SELECT mode, start_station_id, risk_proxy_available, round(exposure_index_pct, 6) AS exposure_index_pct,
        round(eb20, 6) AS eb_risk_rate_per_100k, round(inc, 6) AS expected_incidents_proxy,
        round(incidents_pct, 6) AS eb_priority_score, 'eb_expected_incidents_mprior20000' AS scoring_strategy,
        exposure_index_pct >= 80 AND incidents_pct >= 80 AS eb_prevention_hotspot, exposure_index_pct >= 80 AS eb_product_hotspot,
        exposure_index_pct >= 70 AND eb20 <= (SELECT median(eb20) FROM enriched) AS eb_acquisition_hotspot FROM (
      SELECT *, (rank() OVER (PARTITION BY mode ORDER BY inc) + (count(*) OVER (PARTITION BY mode, inc) - 1) / 2)
            / count(*) OVER (PARTITION BY mode) * 100 AS incidents_pct FROM enriched)""",
)
def _(v):
    card = enrich_scorecard(v.score(), min_trips=MIN_TRIPS)
    return card.select(
        "mode", "start_station_id", "risk_proxy_available", "exposure_index_pct", "eb_risk_rate_per_100k",
        "expected_incidents_proxy", "eb_priority_score", "scoring_strategy", "eb_prevention_hotspot",
        "eb_product_hotspot", "eb_acquisition_hotspot",
    )


@query(
    "agg34_proxy_share",
    "SELECT mode, avg(CASE WHEN risk_proxy_available THEN 1 ELSE 0 END) AS proxy_available_share FROM score GROUP BY mode",
)
def _(v):
    return report.proxy_share(v.score())
