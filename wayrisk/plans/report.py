"""Report tables over the scorecard, the risk tables and the usage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.functions import expr as X
from wayrisk.functions.params import choose_radius, crash_column, radii_in_columns
from wayrisk.operators import stats
from wayrisk.operators.canonical import drop_boolean_columns, ordered_subset
from wayrisk.operators.clusters import density_clusters
from wayrisk.operators.filters import credible
from wayrisk.operators.ordering import medians, percentiles
from wayrisk.operators.shares import group_shares
from wayrisk.schemas import RATE_SCALE, REACH_COLUMNS, SUMMARY_NOTES, TIERS, WHEN_COLUMNS, WHERE_COLUMNS
from wayrisk.session import small_side

EB = "eb_risk_rate_per_100k_trips"


def _top(df: DataFrame, n: int, *falling: str, ties: Sequence[str] = ("mode", "start_station_id")) -> DataFrame:
    """Top-n by falling columns; ties go by the station key so the list is repeatable."""
    return df.orderBy(*[F.desc(c) for c in falling], *[c for c in ties if c in df.columns]).limit(n)


# --- high risk -------------------------------------------------------------
def _with_usable_rate(scorecard: DataFrame, min_trips: int, rate: str) -> DataFrame:
    rows = credible(scorecard, min_trips)
    return rows.where((F.col("exposure_trips") >= min_trips) & F.col(rate).isNotNull())


def high_risk(
    scorecard: DataFrame, min_trips: int = 5000, percent: float = 90.0, rate: str = EB, by_index: bool = False
) -> DataFrame:
    """Credible rows at or above the rate's percentile, or (``by_index``) with a risk index that high."""
    if by_index:
        return credible(scorecard, min_trips).where(F.col("risk_index_pct") >= percent)
    rows = _with_usable_rate(scorecard, min_trips, rate)
    cutoff = percentiles(rows, [], rate, {"cutoff": percent / 100.0})
    return rows.where(F.col(rate) >= cutoff.scalar())


def high_risk_totals(high: DataFrame) -> DataFrame:
    return high.agg(
        F.count(F.lit(1)).alias("high_risk_rows"), F.sum("exposure_trips").alias("high_risk_exposure")
    )


def crash_count_range(scorecard: DataFrame) -> DataFrame:
    """Least and largest crash count; null without rows."""
    return scorecard.agg(F.min("crash_count").alias("least"), F.max("crash_count").alias("most"))


def top_high_risk(high: DataFrame, n: int = 10, rate: str = EB) -> DataFrame:
    return _top(high, n, rate, "exposure_trips")


def rows_by_period(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["year", "month"]).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))


# --- clusters --------------------------------------------------------------
def high_risk_clusters(high: DataFrame, key: str = "start_station_id", eps: float = 0.01, min_samples: int = 2) -> DataFrame:
    return density_clusters(high, key, eps=eps, min_samples=min_samples)


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return (
        clustered.where(F.col("cluster") >= 0)
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("stations_in_cluster"),
            F.sum("exposure_trips").alias("exposure_trips"),
            F.sum("crash_count").alias("crash_count"),
            F.avg("station_lat").alias("station_lat"),
            F.avg("station_lng").alias("station_lng"),
        )
    )


def cluster_totals(clustered: DataFrame) -> DataFrame:
    number = F.col("cluster")
    return clustered.agg(
        F.countDistinct(F.when(number >= 0, number)).alias("clusters"),
        F.count(F.when(number == -1, 1)).alias("isolated_stations"),
    )


# --- zones and tiers -------------------------------------------------------
def risk_zones(rows: DataFrame, min_trips: int = 5000, trips: str = "exposure_trips", rate: str = EB) -> DataFrame:
    """Four quadrants round the medians of exposure and rate; on a median counts as high."""
    kept = rows.where(F.col(rate).isNotNull() & (F.col(trips) >= min_trips))
    middle = medians(kept, [trips, rate])
    return kept.withColumn("zone", X.zone(F.col(trips) >= middle[trips], F.col(rate) >= middle[rate]))


def zone_rates_from_risk(risk: DataFrame, radius: str | int = "auto") -> DataFrame:
    """Raw rates of one radius from a risk table, ready for `risk_zones`."""
    count = crash_column(choose_radius(radii_in_columns(risk.columns), radius))
    kept = risk.where(F.col("trips") > 0)
    return kept.withColumn("crashes_per_100k_trips", X.per_100k(F.coalesce(F.col(count), F.lit(0)), F.col("trips")))


def counts_of(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("stations"))


def high_priority(zoned: DataFrame, n: int = 15, rate: str = EB, trips: str = "exposure_trips") -> DataFrame:
    return _top(zoned.where(F.col("zone") == "High exposure / High risk"), n, rate, trips)


def with_tiers(scorecard: DataFrame, min_trips: int = 5000, include_lowest: bool = True) -> DataFrame:
    return credible(scorecard, min_trips).withColumn("risk_tier", X.risk_tier(F.col("risk_index_pct"), include_lowest))


def tier_shares(tiered: DataFrame) -> DataFrame:
    """Rows and percent of every tier, tiers without rows included.

    Three conditional counts in one pass, turned to rows: no join with a tier list.
    """
    ranked = tiered.where(F.col("risk_index_pct").isNotNull())
    one = ranked.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count(F.when(F.col("risk_tier") == t, 1)).alias(f"_{i}") for i, t in enumerate(TIERS)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("tier_order"), F.lit(t).alias("risk_tier"), F.col(f"_{i}").alias("stations"))
            for i, t in enumerate(TIERS)
        ]
    )
    return one.select("_all", F.explode(rows).alias("r")).select(
        "r.*",
        F.coalesce(X.ratio(F.col("r.stations"), F.col("_all"), 100.0), F.lit(0.0)).alias("pct"),
    )


# --- distributions ---------------------------------------------------------
def rate_histogram(scorecard: DataFrame, bins: int = 30, min_trips: int = 5000, rate: str = EB) -> DataFrame:
    """Equal bins from the smallest to the largest rate; the last bin holds its upper edge."""
    values = credible(scorecard, min_trips).where(F.col(rate).isNotNull()).select(F.col(rate).alias("v"))
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    placed = values.withColumns({"lo": lo, "hi": hi})
    # a single value is put in the middle of a range one wide
    flat = F.col("lo") == F.col("hi")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    number = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    return placed.select(number.alias("bin"), (low + number * width).alias("bin_start")).groupBy("bin", "bin_start").agg(
        F.count(F.lit(1)).alias("stations")
    )


def median_rate(scorecard: DataFrame, min_trips: int = 5000, rate: str = EB) -> DataFrame:
    return percentiles(credible(scorecard, min_trips), [], rate, {"median_rate": 0.5})


def seasonality(scorecard: DataFrame, min_trips: int = 5000, rate: str = EB) -> DataFrame:
    """Quartiles of the credible rates per year and month."""
    return percentiles(credible(scorecard, min_trips), ["year", "month"], rate, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def seasonality_heatmap(summary: DataFrame, months: Sequence[int]) -> DataFrame:
    wide = summary.groupBy("year").pivot("month", list(months)).agg(F.max("q50"))
    return wide.select("year", *[F.col(str(m)).alias(f"m{m:02d}") for m in months])


def yearly_distribution(scorecard: DataFrame, min_trips: int = 5000, rate: str = EB) -> DataFrame:
    """Box-plot figures per year: quartiles and the whiskers within 1.5 IQR."""
    rows = credible(scorecard, min_trips).where(F.col(rate).isNotNull())
    boxes = percentiles(rows, ["year"], rate, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    reach = (F.col("q75") - F.col("q25")) * 1.5
    v = F.col(rate)
    return (
        rows.select("year", rate)
        .join(small_side(boxes), "year")
        .groupBy("year", "q25", "q50", "q75")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.when(v >= F.col("q25") - reach, v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("q75") + reach, v)).alias("whisker_high"),
        )
    )


def overlay_years(years: Sequence[int]) -> list[int]:
    """More than three years: compare the first and the last only."""
    found = sorted(set(years))
    return found if len(found) <= 3 else [found[0], found[-1]]


# --- change over years -----------------------------------------------------
def weighted_rates(scorecard: DataFrame, rate: str = EB) -> DataFrame:
    """Exposure-weighted mean rate per station and year; null without exposure."""
    w = F.col("exposure_trips")
    return scorecard.groupBy("mode", "start_station_id", "year").agg(
        F.sum(w).alias("exposure_sum"), X.ratio(F.sum(F.col(rate) * w), F.sum(w)).alias("eb_rate_weighted")
    )


def station_change(weighted: DataFrame, first: int, last: int, n: int | None = None) -> DataFrame:
    """Stations present in both endpoint years with their exposure and rate in each."""

    def of(year: int, name: str) -> Column:
        return F.max(F.when(F.col("year") == year, F.col(name)))

    out = (
        weighted.where(F.col("year").isin(first, last))
        .groupBy("mode", "start_station_id")
        .agg(
            of(first, "exposure_sum").alias("exposure_first"),
            of(last, "exposure_sum").alias("exposure_last"),
            of(first, "eb_rate_weighted").alias("rate_first"),
            of(last, "eb_rate_weighted").alias("rate_last"),
        )
        .dropna(subset=["rate_first", "rate_last"])
        .withColumn("exposure_total", F.col("exposure_first") + F.col("exposure_last"))
    )
    return out if n is None else _top(out, n, "exposure_total")


def yearly_rates(
    risk: DataFrame, radius: str | int = "auto", min_trips: int = 5000, m_prior: float = stats.DEFAULT_PRIOR
) -> DataFrame:
    """EB rates fitted within each year on its credible stations (year-month rows are summed first)."""
    count = crash_column(choose_radius(radii_in_columns(risk.columns), radius))
    rows = risk.where(F.col("trips") > 0)
    if "month" in rows.columns:
        rows = fold_to_years(rows, count)
    stable = rows.where(F.col("trips") >= min_trips).withColumn("crash_count", F.coalesce(F.col(count), F.lit(0)))
    baseline = stable.groupBy("mode", "year").agg(
        F.coalesce(X.ratio(F.sum("crash_count"), F.sum("trips")), F.lit(0.0)).alias("_baseline")
    )
    eb = stats.eb_rate(F.col("crash_count"), F.col("trips"), F.col("_baseline"), F.lit(float(m_prior)))
    return (
        stable.join(small_side(baseline), ["mode", "year"])
        .withColumn("_eb", eb)
        .select(
            "mode",
            "year",
            "start_station_id",
            "start_station_name",
            F.col("trips").alias("exposure_trips"),
            "crash_count",
            (F.col("_eb") * RATE_SCALE).alias(EB),
            (F.col("_eb") * F.col("trips")).alias("expected_incidents_proxy"),
        )
    )


def fold_to_years(risk_year_month: DataFrame, count: str) -> DataFrame:
    return risk_year_month.groupBy("mode", "year", "start_station_id", "start_station_name").agg(
        F.sum("trips").alias("trips"), F.sum(count).alias(count)
    )


def yearly_burden(rates: DataFrame) -> DataFrame:
    return rates.groupBy("mode", "year").agg(F.sum("expected_incidents_proxy").alias("eb_expected_crashes"))


def crash_ratio(risk: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Ratio of sums per period, at 500 m if present else the smallest radius."""
    radii = radii_in_columns(risk.columns)
    count = crash_column(500 if 500 in radii else radii[0])
    summed = risk.where(F.col("trips") > 0).dropna(subset=list(by)).groupBy(*by).agg(
        F.sum("trips").alias("trips"), F.sum(count).alias("crashes")
    )
    return summed.withColumn("crashes_per_100k_trips", X.per_100k(F.col("crashes"), F.col("trips")))


# --- usage patterns --------------------------------------------------------
USAGE_PANELS = {"hour": ["hour"], "week_part": ["week_part"], "year_hour": ["year", "hour"], "year_week_part": ["year", "week_part"], "week_part_hour": ["week_part", "hour"]}


def usage_panels(hours: DataFrame) -> DataFrame:
    """Trips and shares by hour, week part, and both within years and week parts, from one pass.

    ``panel`` names the grouping, a column it leaves out is null, and ``pct`` is of the panel, of the year
    where it has one, or else of the week part where it has hours too.
    """
    keys = ["year", "week_part", "hour"]
    sets = [[F.col(c) for c in columns] for columns in USAGE_PANELS.values()]
    summed = hours.groupingSets(sets, *keys).agg(F.sum("trips").alias("trips"), F.grouping_id(*keys).alias("_left_out"))
    # bits of the grouping id, first column highest: set where the column is left out
    number = {name: sum(1 << (len(keys) - 1 - k) for k, c in enumerate(keys) if c not in columns) for name, columns in USAGE_PANELS.items()}
    panel = F.coalesce(*[F.when(F.col("_left_out") == n, F.lit(name)) for name, n in number.items()])
    named = summed.withColumn("panel", panel)
    scope = [F.col("panel"), F.col("year"), F.when(F.col("panel") == "week_part_hour", F.col("week_part"))]
    total = F.sum("trips").over(W.partitionBy(*scope))  # a row per hour, week part and year at most
    return named.select("panel", *keys, "trips", X.ratio(F.col("trips"), total, 100.0).alias("pct"))


def hour_summary(hours: DataFrame) -> DataFrame:
    return group_shares(hours, ["hour"], "pct_of_daily")


def dow_summary(days: DataFrame) -> DataFrame:
    return group_shares(days, ["dow", "dow_name"], "pct_of_weekly")


def week_part_summary(days: DataFrame, by_year: bool = False) -> DataFrame:
    if by_year:
        return group_shares(days, ["year", "week_part"], "pct", scope=["year"])
    return group_shares(days, ["week_part"], "pct")


def dow_year_shares(days: DataFrame) -> DataFrame:
    return group_shares(days, ["year", "dow", "dow_name"], "pct_of_year", scope=["year"])


def first_hours(hours: DataFrame, n: int = 8) -> DataFrame:
    """First n hour rows of each year (the table has at most 24 rows per mode, year and part)."""
    order = [c for c in ("hour", "mode", "week_part") if c in hours.columns]
    ranked = hours.withColumn("_n", F.row_number().over(W.partitionBy("year").orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def top_station_by_month(exposure: DataFrame) -> DataFrame:
    """Busiest station of each month, ties to the smaller id: an aggregate, so no month is sorted."""
    rows = exposure.dropna(subset=["trips", "year", "month", "start_station_id", "start_station_name"])
    summed = rows.groupBy("year", "month", "start_station_id", "start_station_name").agg(F.sum("trips").alias("trips"))
    best = F.min(F.struct((-F.col("trips")).alias("_t"), "start_station_id", "start_station_name")).alias("_b")
    return summed.groupBy("year", "month").agg(best).select(
        "year",
        "month",
        "_b.start_station_id",
        "_b.start_station_name",
        (-F.col("_b._t")).alias("trips"),
    )


def top_station_trips_by_year(top_by_month: DataFrame) -> DataFrame:
    return top_by_month.groupBy("year").agg(F.sum("trips").alias("trips"))


# --- decision tables -------------------------------------------------------
def where_prevention(scorecard: DataFrame, n: int = 20, min_trips: int = 5000) -> DataFrame:
    """Credible stations by expected incidents (by priority where there are none), then exposure."""
    rows = credible(scorecard, min_trips)
    by = "expected_incidents_proxy" if "expected_incidents_proxy" in rows.columns else "priority_score"
    return drop_boolean_columns(ordered_subset(_top(rows, n, by, "exposure_trips"), WHERE_COLUMNS))


def where_reach(scorecard: DataFrame, n: int = 20) -> DataFrame:
    return drop_boolean_columns(ordered_subset(_top(scorecard, n, "exposure_trips"), REACH_COLUMNS))


def lowest_exposure(rows: DataFrame, n: int = 10, trips: str = "exposure_trips") -> DataFrame:
    """Diagnostic: the rows with the fewest trips."""
    return rows.orderBy(trips, *[c for c in ("mode", "start_station_id") if c in rows.columns]).limit(n)


def plain_metrics(risk: DataFrame, radius: str | int = "auto") -> DataFrame:
    """Crashes as percent of trips, and trips per crash (null without crashes)."""
    count = F.col(crash_column(choose_radius(radii_in_columns(risk.columns), radius)))
    return risk.withColumns(
        {"crash_rate_pct": X.ratio(count, F.col("trips"), 100.0), "trips_per_crash": X.ratio(F.col("trips"), count)}
    )


def where_by_proxy(scorecard: DataFrame, n: int = 20) -> DataFrame:
    """Older form: stations with a risk proxy first, then the best priority column there is."""
    by = next(c for c in ("eb_priority_score", "priority_score", "exposure_trips") if c in scorecard.columns)
    first = ["risk_proxy_available"] if "risk_proxy_available" in scorecard.columns else []
    return _top(scorecard, n, *first, by)


def when_windows(windows: DataFrame, n: int = 20) -> DataFrame:
    """Best windows by priority; tables without it rank by lift, index or trips."""
    ranking = ("priority_metric", "lift_vs_baseline_pct", "lift_pct", "index", "trips")
    by = next(c for c in ranking if c in windows.columns)
    ties = ("mode", "window_type", "segment", "window_label")
    return ordered_subset(_top(windows, n, by, ties=ties), WHEN_COLUMNS)


def proxy_share(scorecard: DataFrame) -> DataFrame:
    flag = X.truthy(F.col("risk_proxy_available")).cast("int")
    return scorecard.groupBy("mode").agg(F.avg(flag).alias("proxy_available_share"))


# --- summaries -------------------------------------------------------------
def run_summary(by_year: DataFrame, scorecard: DataFrame) -> DataFrame:
    total = by_year.agg(F.sum("trips").alias("total_trips")).scalar()
    return scorecard.agg(
        F.countDistinct("start_station_id").alias("unique_stations"),
        F.count(F.lit(1)).alias("station_periods"),
        F.count(F.when(F.col("credibility_flag") == "credible", 1)).alias("credible_station_periods"),
        F.count(F.when(X.truthy(F.col("prevention_hotspot")), 1)).alias("prevention_hotspots"),
    ).select(total.alias("total_trips"), "*")


def executive_summary(scorecard: DataFrame, min_trips: int = 5000, include_lowest: bool = True) -> DataFrame:
    """Rows of (position, metric, value, pct, notes): totals, credible rows, tiers and hotspots.

    ``pct`` is of all rows for credible rows and of credible rows for tiers.
    """
    if "credibility_flag" not in scorecard.columns:
        scorecard = scorecard.withColumn("credibility_flag", X.credibility(F.col("exposure_trips"), min_trips))
    is_credible = F.lower("credibility_flag") == "credible"
    tier = X.risk_tier(F.col("risk_index_pct"), include_lowest)
    count_if = lambda c: F.count(F.when(c, 1))
    notes = SUMMARY_NOTES
    measures: list[tuple[str, Column, str | None, str | None]] = [
        ("Total station-period rows", F.count(F.lit(1)), None, None),
        (f"Credible rows (>={min_trips:,} trips)", count_if(is_credible), "_0", notes["credible"]),
        *[(f"{t} rows", count_if(is_credible & (tier == t)), "_1", notes[t]) for t in reversed(TIERS)],
        *[
            (f"{kind.capitalize()} hotspots", count_if(X.truthy(F.col(f"{kind}_hotspot"))), None, notes[kind])
            for kind in ("prevention", "product", "acquisition")
        ],
    ]
    only_mode = F.when(F.min("mode") == F.max("mode"), F.min("mode")).otherwise("multiple")
    one = scorecard.agg(*[m.alias(f"_{i}") for i, (_, m, _, _) in enumerate(measures)], only_mode.alias("_mode"))
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(name).alias("metric"),
            F.col(f"_{i}").alias("value"),
            (X.ratio(F.col(f"_{i}"), F.col(base), 100.0) if base else F.lit(None).cast("double")).alias("pct"),
            (F.lit(note) if note else F.concat(F.lit("mode="), F.col("_mode"))).alias("notes"),
        )
        for i, (name, _, base, note) in enumerate(measures)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
