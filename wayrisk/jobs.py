"""Batch jobs over folders: ``python -m wayrisk.jobs <job> ...``.

A run folder holds one sub-folder per table.  Each job stores its tables before the
next step reads them, so trips are scanned once and later steps prune columns.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wayrisk import schemas
from wayrisk.functions.params import choose_radius, int_list, months_spec, radii_in_columns, radii_list
from wayrisk.operators.filters import crashes_in
from wayrisk.operators.shares import pivot_years
from wayrisk.operators.usage import station_exposure
from wayrisk.plans import compare, forecast, report, scorecard, summaries, windows
from wayrisk.plans.ingest import ingest, ingest_older_layer
from wayrisk.session import build_session
from wayrisk.sinks.partitions import write_table
from wayrisk.sources import tables
from wayrisk.sources.crashes import crash_points, read_crash_export
from wayrisk.sources.trips import read_trips

RUN_TABLES = {
    "trips_by_month": schemas.USAGE_MONTH,
    "trips_by_year": schemas.USAGE_YEAR,
    "trips_by_dow": schemas.USAGE_DOW,
    "trips_by_hour": schemas.USAGE_HOUR,
}


def _save(df: DataFrame, folder: str, name: str) -> DataFrame:
    write_table(df, f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _load(spark: SparkSession, folder: str, name: str, optional: bool = False) -> DataFrame | None:
    return tables.read_table(spark, f"{folder}/{name}", optional=optional)


def filter_crashes(spark: SparkSession, source: str, out: str, years: Sequence[int], months: Sequence[int]) -> None:
    from wayrisk.functions.params import check_months, check_years

    check_years(years)
    check_months(months)
    write_table(crashes_in(read_crash_export(spark, source), years, months), out)


def summarize(
    spark: SparkSession,
    trips_root: str,
    out: str,
    mode: str | None = None,
    crashes: str | None = None,
    radii: Sequence[float] = (250.0, 500.0),
    exposure: str = "touchpoints",
    top_n: int = 5,
    modes_without_proxy: Sequence[str] = ("jc",),
) -> None:
    """Usage tables, station exposure, risk at three grains, highlights."""
    trips = read_trips(spark, trips_root, mode)
    usage = {name: _save(df, out, name) for name, df in summaries.usage_tables(trips).items()}
    stations = _save(station_exposure(trips, exposure, mode), out, "station_exposure")
    if crashes and radii:
        points = crash_points(spark.read.parquet(crashes))
        for grain in summaries.GRAINS:
            risk = summaries.station_risk(stations, points, radii, grain, modes_without_proxy)
            _save(risk, out, f"station_risk_{grain}")
    _save(summaries.highlights(usage, top_n), out, "highlights")


def score(
    spark: SparkSession,
    run: str,
    radius: str = "500m",
    alpha: float = 0.05,
    min_trips: int = 5000,
    m_prior: float | None = None,
    grain: str = "lifetime",
) -> None:
    risk = _load(spark, run, f"station_risk_{grain}")
    card = scorecard.build_scorecard(risk, radius, alpha, min_trips, m_prior, grain)
    metres = choose_radius(radii_in_columns(risk.columns), radius)
    suffix = "" if grain == "lifetime" else f"_{grain}"
    _save(scorecard.delivery_order(card), run, f"scorecard_{metres}m{suffix}")


def target_windows(spark: SparkSession, run: str, top_hours: int = 5, top_dows: int = 3, top_months: int = 6) -> None:
    hours, days, months = (
        _load(spark, run, t) for t in ("trips_by_hour_week_part", "trips_by_dow", "trips_by_month")
    )
    _save(windows.target_windows(hours, days, months, top_hours, top_dows, top_months), run, "target_windows")


def compare_runs(spark: SparkSession, root: str, out: str, yoy_months: str | None = None) -> None:
    stacked = {name: tables.read_runs(spark, root, name, schema) for name, schema in RUN_TABLES.items()}
    for name, df in compare.comparison_tables(stacked, months_spec(yoy_months)).items():
        _save(df, out, name)


def report_tables(spark: SparkSession, run: str, radius: str = "auto", min_trips: int = 5000, m_prior: float = 20000.0) -> None:
    """High-risk list, clusters, zones, tiers, summaries, period panels and the decision tables of a run.

    Tables of a period appear where the run has its source: a scorecard by year and month, station risk
    by year or by year and month, usage by hour or weekday, target windows.
    """
    source = lambda name: _load(spark, run, name, optional=True)
    risk = _load(spark, run, "station_risk_lifetime")
    found = {int(r): card for r in radii_in_columns(risk.columns) if (card := source(f"scorecard_{r}m")) is not None}
    card = tables.scorecard_for(found, radius)
    chosen = next(r for r, c in found.items() if c is card)
    high = _save(report.high_risk(card, min_trips), run, "high_risk")
    clustered = _save(report.high_risk_clusters(high), run, "high_risk_clusters")
    zoned = _save(report.risk_zones(card, min_trips), run, "risk_zones")
    out = {
        "high_risk_top": report.top_high_risk(high),
        "high_priority": report.high_priority(zoned),
        "zone_counts": report.counts_of(zoned, "zone"),
        "cluster_summary": report.cluster_summary(clustered),
        "cluster_totals": report.cluster_totals(clustered),
        "scorecard_enriched": scorecard.enrich_scorecard(card, min_trips, m_prior),
        "tier_shares": report.tier_shares(report.with_tiers(card, min_trips)),
        "rate_histogram": report.rate_histogram(card, min_trips=min_trips),
        "executive_summary": report.executive_summary(card, min_trips),
        "run_summary": report.run_summary(_load(spark, run, "trips_by_year"), card),
        "where_prevention": report.where_prevention(card, min_trips=min_trips),
        "where_reach": report.where_reach(card),
        "lowest_exposure": report.lowest_exposure(card),
        "plain_metrics": report.plain_metrics(risk, chosen),
        "top_station_by_month": (top := report.top_station_by_month(_load(spark, run, "station_exposure"))),
        "top_station_trips_by_year": report.top_station_trips_by_year(top),
    }
    if (when := source("target_windows")) is not None:
        out["when_windows"] = report.when_windows(when)
    if (hours := source("trips_by_hour_week_part")) is not None:
        out["usage_panels"] = report.usage_panels(hours)
        out["hour_summary"] = report.hour_summary(hours)
    if (days := source("trips_by_dow")) is not None:
        out["dow_summary"] = report.dow_summary(days)
        out["week_part_summary"] = report.week_part_summary(days)
        out["week_part_by_year"] = report.week_part_summary(days, by_year=True)
        shares = report.dow_year_shares(days)
        years = sorted(r["year"] for r in days.select("year").distinct().collect())
        out["dow_by_year"] = pivot_years(shares, ["dow", "dow_name"], "pct_of_year", years)
    if (by_year := source("station_risk_year")) is not None:
        out["yearly_burden"] = report.yearly_burden(report.yearly_rates(by_year, chosen, min_trips, m_prior))
        out["crash_ratio_by_year"] = report.crash_ratio(by_year)
    if (by_month := source("station_risk_year_month")) is not None:
        out["crash_ratio_by_month"] = report.crash_ratio(by_month, ["year", "month"])
    if (periods := source(f"scorecard_{chosen}m_year_month")) is not None:
        seasons = _save(report.seasonality(periods, min_trips), run, "seasonality")
        months = sorted(r["month"] for r in seasons.select("month").distinct().collect())  # twelve at most
        out["seasonality_heatmap"] = report.seasonality_heatmap(seasons, months)
        out["yearly_distribution"] = report.yearly_distribution(periods, min_trips)
        weighted = _save(report.weighted_rates(periods), run, "weighted_rates")
        years = sorted(r["year"] for r in weighted.select("year").distinct().collect())
        if len(years) > 1:
            out["station_change"] = report.station_change(weighted, years[0], years[-1])
    for name, df in out.items():
        _save(df, run, name)


def predict(
    spark: SparkSession,
    run: str,
    settings: forecast.TreeSettings = forecast.TreeSettings(),
    horizon: int = 1,
    val_months: int = 1,
    test_months: int = 1,
    backtest_months: int = 6,
    write_splits: str = "test",
    future_months: Sequence[int] = (),
    years_ahead: int = 1,
    past_only: bool = False,
    calendar: bool = False,
) -> None:
    exposure = _load(spark, run, "station_exposure")
    results = forecast.forecast_demand(
        exposure, settings, horizon, val_months, test_months, backtest_months, write_splits, past_only, calendar
    )
    predictions = forecast.all_predictions(results)
    if predictions is not None:
        write_table(predictions, f"{run}/predictions", by=["mode"])
    write_table(forecast.metrics_table(spark, results), f"{run}/metrics", "json")
    for r in results:
        write_table(r.importance, f"{run}/feature_importance_{r.mode}")
    if future_months:
        write_table(
            forecast.forecast_future(exposure, future_months, years_ahead, settings), f"{run}/predictions_future", by=["mode"]
        )


def main(argv: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="wayrisk.jobs")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *required: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        return p

    p = job("ingest", "archives", "out", "years", "months")
    p.add_argument("--mode", default="auto")
    p.add_argument("--force", action="store_true")
    p.add_argument("--keep-null-times", action="store_true")
    p.add_argument("--compression", default="none")
    job("older-layer", "folder", "out").add_argument("--months")
    job("crashes", "source", "out", "years", "months")
    p = job("summarize", "trips", "out")
    p.add_argument("--mode")
    p.add_argument("--crashes")
    p.add_argument("--radii", default="250,500")
    p.add_argument("--exposure", default="touchpoints", choices=["touchpoints", "starts"])
    p.add_argument("--top-n", type=int, default=5)
    p = job("score", "run")
    p.add_argument("--radius", default="500m")
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--min-trips", type=int, default=5000)
    p.add_argument("--m-prior", type=float)
    p.add_argument("--grain", default="lifetime", choices=list(scorecard.PERIODS))
    p = job("windows", "run")
    for name, default in (("hours", 5), ("dows", 3), ("months", 6)):
        p.add_argument(f"--top-{name}", type=int, default=default)
    p = job("compare", "root", "out")
    p.add_argument("--yoy-months")
    p = job("report", "run")
    p.add_argument("--radius", default="auto")
    p.add_argument("--min-trips", type=int, default=5000)
    p.add_argument("--m-prior", type=float, default=20000.0)
    p = job("predict", "run")
    for name, default in (("horizon", 1), ("val-months", 1), ("test-months", 1), ("backtest-months", 6), ("years-ahead", 1)):
        p.add_argument(f"--{name}", type=int, default=default)
    trees = forecast.TreeSettings()
    p.add_argument("--rounds", type=int, default=trees.rounds)
    p.add_argument("--patience", type=int, default=trees.patience, help="rounds without gain on the validation months; 0: all rounds")
    p.add_argument("--depth", type=int, default=trees.depth)
    p.add_argument("--step", type=float, default=trees.step)
    p.add_argument("--subsample", type=float, default=trees.subsample)
    for name in ("log1p", "past-only", "calendar"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--write-splits", default="test", choices=list(forecast.WRITTEN_SPLITS))
    p.add_argument("--future-months", default="")
    a = top.parse_args(argv)

    spark = build_session(f"wayrisk-{a.job}")
    if a.job == "ingest":
        ingest(
            spark, a.archives, a.out, int_list(a.years), int_list(a.months), a.mode, a.force, a.keep_null_times, a.compression
        )
    elif a.job == "crashes":
        filter_crashes(spark, a.source, a.out, int_list(a.years), int_list(a.months))
    elif a.job == "summarize":
        summarize(spark, a.trips, a.out, a.mode, a.crashes, radii_list(a.radii), a.exposure, a.top_n)
    elif a.job == "score":
        score(spark, a.run, a.radius, a.alpha, a.min_trips, a.m_prior, a.grain)
    elif a.job == "windows":
        target_windows(spark, a.run, a.top_hours, a.top_dows, a.top_months)
    elif a.job == "compare":
        compare_runs(spark, a.root, a.out, a.yoy_months)
    elif a.job == "report":
        report_tables(spark, a.run, a.radius, a.min_trips, a.m_prior)
    elif a.job == "predict":
        settings = forecast.TreeSettings(
            rounds=a.rounds, step=a.step, depth=a.depth, subsample=a.subsample, log1p=a.log1p, patience=a.patience or None
        )
        predict(
            spark, a.run, settings, a.horizon, a.val_months, a.test_months, a.backtest_months, a.write_splits,
            int_list(a.future_months) or (), a.years_ahead, a.past_only, a.calendar,
        )
    elif a.job == "older-layer":
        ingest_older_layer(spark, a.folder, a.out, int_list(a.months) if a.months else None)


if __name__ == "__main__":
    main()
