"""The partner scorecard: rates, intervals, percentile ranks, priority and hotspots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.functions.params import choose_radius, crash_column, radii_in_columns, rate_column, require_columns
from wayrisk.operators import stats
from wayrisk.operators.canonical import ordered_subset
from wayrisk.operators.ordering import percentiles, with_pct_rank
from wayrisk.operators.usage import STATION
from wayrisk.schemas import RATE_SCALE
from wayrisk.session import small_side, stored

PERIODS = {"lifetime": [], "year": ["year"], "year_month": ["year", "month"]}
COLUMNS = [
    "mode",
    "year",
    "month",
    "start_station_id",
    "start_station_name",
    "station_lat",
    "station_lng",
    "exposure_trips",
    "crash_count",
    "risk_rate_per_100k_trips",
    "risk_rate_ci_low",
    "risk_rate_ci_high",
    "risk_proxy_available",
    "credibility_flag",
    "exposure_pct",
    "risk_pct",
    "priority_score",
    "prevention_hotspot",
    "product_hotspot",
    "acquisition_hotspot",
    "exposure_index_pct",
    "eb_risk_rate_per_100k_trips",
    "risk_index_pct",
    "expected_incidents_proxy",
    "scoring_strategy",
]


def build_scorecard(
    risk: DataFrame,
    radius: str | int = "500m",
    alpha: float = 0.05,
    min_trips: int = 5000,
    m_prior: float | None = None,
    grain: str = "lifetime",
) -> DataFrame:
    """Score every station of a risk table; ranks and priors are per mode (and period).

    Modes whose credible stations show no differing rates are scored on exposure alone.
    The risk rows are stored once, as several passes read them, and so is the row of
    facts per mode: a fitted prior must not differ in its last bits between passes.
    """
    metres = choose_radius(radii_in_columns(risk.columns), radius, strict=True)
    count_col, rate_col = crash_column(metres), rate_column(metres)
    require_columns(
        risk.columns, [*STATION, "station_lat", "station_lng", "trips", count_col, rate_col], "risk table"
    )
    period = PERIODS[grain]
    groups = ["mode", *period]
    base = risk.select(
        *STATION,
        *period,
        X.number("station_lat").alias("station_lat"),
        X.number("station_lng").alias("station_lng"),
        X.whole("trips").alias("exposure_trips"),
        X.whole(count_col).alias("crash_count"),
        F.coalesce(X.number(rate_col), F.lit(0.0)).alias("risk_rate_per_100k_trips"),
    )
    base = stored(base.withColumn("mode", F.coalesce(F.col("mode"), F.lit("nan"))))
    facts = base.groupBy(*groups).agg(
        *stats.moment_columns("crash_count", "exposure_trips"),
        stats.signal_column("risk_rate_per_100k_trips", "exposure_trips", min_trips),
    )
    facts = small_side(facts.select(*groups, "risk_proxy_available", *stats.prior_columns(m_prior)))
    rated = base.join(facts, groups)
    signalled = F.col("risk_proxy_available")
    eb = F.when(
        signalled,
        stats.eb_rate(
            F.col("crash_count"), F.col("exposure_trips"), F.col("baseline_rate"), F.col("prior_trips")
        ),
    )
    rated = rated.withColumn("_eb", eb).withColumns(
        {
            "eb_risk_rate_per_100k_trips": F.col("_eb") * RATE_SCALE,
            "expected_incidents_proxy": F.col("_eb") * F.col("exposure_trips"),
            "scoring_strategy": F.when(
                signalled,
                F.format_string(
                    f"eb_expected_incidents_mintrips{min_trips}_mprior%d", F.floor("prior_trips").cast("long")
                ),
            ).otherwise("exposure_only_no_risk_signal"),
            "credibility_flag": F.when(
                signalled, X.credibility(F.col("exposure_trips"), min_trips)
            ).otherwise("no_risk_data"),
        }
    )

    enough = F.col("exposure_trips") >= min_trips
    ranked = with_pct_rank(
        rated,
        groups,
        {
            "exposure_index_pct": "exposure_trips",
            "risk_index_pct": F.when(enough, F.col("eb_risk_rate_per_100k_trips")),
            "_incidents_pct": "expected_incidents_proxy",
        },
        key=[*STATION, *period],
    )
    signalled = F.col("risk_proxy_available")
    exposure_pct, risk_pct = F.col("exposure_index_pct"), F.coalesce(F.col("risk_index_pct"), F.lit(0.0)) / 100.0
    is_credible = F.col("credibility_flag") == "credible"
    scored = ranked.withColumns(
        {
            "exposure_pct": exposure_pct / 100.0,
            "risk_pct": risk_pct,
            "priority_score": F.when(signalled, F.col("_incidents_pct")).otherwise(exposure_pct) / 100.0,
            "prevention_hotspot": F.when(
                signalled, (exposure_pct >= 80) & (risk_pct >= 0.8) & is_credible
            ).otherwise(exposure_pct >= 90),
            "product_hotspot": exposure_pct >= 80,
            "acquisition_hotspot": F.when(signalled, (exposure_pct >= 70) & (risk_pct <= 0.3)).otherwise(
                exposure_pct >= 70
            ),
        }
    )
    bounds = stats.bounds_table(base, "crash_count", alpha)
    scored = stats.with_poisson_interval(scored, "crash_count", "exposure_trips", alpha, bounds=bounds)
    return ordered_subset(scored, COLUMNS)


def delivery_order(scorecard: DataFrame) -> DataFrame:
    return scorecard.orderBy(F.desc("priority_score"), F.desc("exposure_trips"))


def enrich_scorecard(
    scorecard: DataFrame,
    min_trips: int = 5000,
    m_prior: float = stats.DEFAULT_PRIOR,
    key: Sequence[str] = tuple(STATION),
) -> DataFrame:
    """Fixed-prior EB layer over a scorecard: a 0..100 priority and its own hotspot flags.

    The signal test has no minimum of rows and looks at crash counts where a mode has
    no rates at all.  A rank over a single distinct value is 50.
    """
    groups = ["mode"]
    s = scorecard.withColumns(
        {
            "exposure_trips": F.coalesce(X.number("exposure_trips"), F.lit(0.0)),
            "crash_count": F.coalesce(X.number("crash_count"), F.lit(0.0)),
        }
    ).drop("risk_proxy_available", "exposure_index_pct", "expected_incidents_proxy", "scoring_strategy")
    rate = X.number("risk_rate_per_100k_trips") if "risk_rate_per_100k_trips" in s.columns else F.lit(None).cast("double")
    enough = F.col("exposure_trips") >= min_trips

    def differs(c):
        return F.coalesce(F.min(c) < F.max(c), F.lit(False))

    facts = s.groupBy(*groups).agg(
        F.when(F.count(rate) > 0, differs(F.when(enough, rate)))
        .otherwise(differs(F.when(enough, F.col("crash_count"))))
        .alias("risk_proxy_available"),
        F.coalesce(X.ratio(F.sum("crash_count"), F.sum("exposure_trips")), F.lit(0.0)).alias("_baseline"),
        differs(F.col("exposure_trips")).alias("_exposure_differs"),
    )
    s = s.join(small_side(facts), groups)
    eb = F.when(
        F.col("risk_proxy_available"),
        stats.eb_rate(F.col("crash_count"), F.col("exposure_trips"), F.col("_baseline"), F.lit(float(m_prior))),
    )
    s = s.withColumns(
        {"eb_risk_rate_per_100k": eb * RATE_SCALE, "expected_incidents_proxy": eb * F.col("exposure_trips")}
    )
    incident_facts = s.groupBy(*groups).agg(differs(F.col("expected_incidents_proxy")).alias("_incidents_differ"))
    s = stored(s)
    middle = percentiles(s, [], "eb_risk_rate_per_100k", {"_median": 0.5})
    s = with_pct_rank(
        s,
        groups,
        {"exposure_index_pct": "exposure_trips", "_incidents_pct": "expected_incidents_proxy"},
        key=key,
    ).join(small_side(incident_facts), groups)
    exposure_pct = F.when(F.col("_exposure_differs"), F.col("exposure_index_pct")).otherwise(50.0)
    incident_pct = F.when(F.col("_incidents_differ"), F.col("_incidents_pct")).otherwise(50.0)
    s = s.withColumn("exposure_index_pct", exposure_pct)
    s = s.withColumns(
        {
            "eb_priority_score": F.when(F.col("risk_proxy_available"), incident_pct).otherwise(
                F.col("exposure_index_pct")
            ),
            "scoring_strategy": F.when(
                F.col("risk_proxy_available"), f"eb_expected_incidents_mprior{int(m_prior)}"
            ).otherwise("exposure_only_no_risk_signal"),
            "_median": F.coalesce(middle.scalar(), F.lit(None).cast("double")),
        }
    )
    high = F.col("exposure_index_pct") >= 80
    low_risk = F.coalesce(F.coalesce(F.col("eb_risk_rate_per_100k"), F.lit(0.0)) <= F.col("_median"), F.lit(False))
    return s.withColumns(
        {
            "eb_prevention_hotspot": high & (F.col("eb_priority_score") >= 80),
            "eb_product_hotspot": high,
            "eb_acquisition_hotspot": (F.col("exposure_index_pct") >= 70) & low_risk,
        }
    ).drop("_baseline", "_exposure_differs", "_incidents_differ", "_incidents_pct", "_median")
