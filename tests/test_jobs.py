"""The jobs one after another on a small run, reading each other's tables."""

import pytest
from pyspark.sql import functions as F

from wayrisk import jobs
from wayrisk.plans.forecast import TreeSettings
from wayrisk.sinks.partitions import write_months, write_table

REPORT_TABLES = [
    "high_risk", "high_risk_top", "high_priority", "zone_counts", "cluster_summary", "cluster_totals", "scorecard_enriched", "tier_shares",
    "rate_histogram", "executive_summary", "run_summary", "where_prevention", "where_reach", "lowest_exposure", "plain_metrics",
    "top_station_by_month", "top_station_trips_by_year", "when_windows", "usage_panels", "hour_summary", "dow_summary", "week_part_summary",
    "week_part_by_year", "dow_by_year", "yearly_burden", "crash_ratio_by_year", "crash_ratio_by_month", "seasonality", "seasonality_heatmap",
    "yearly_distribution", "weighted_rates", "station_change",
]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    n = F.col("id")
    station = lambda k: F.format_string("s%02d", k)
    trips = spark.range(24_000).select(
        F.lit("nyc").alias("mode"),
        (F.lit(2019) + F.floor(n / 12000)).cast("int").alias("year"),
        (F.floor(n / 1000) % 12 + 1).cast("int").alias("month"),
        F.expr("make_timestamp_ntz(2019 + cast(floor(id / 12000) as int), cast(floor(id / 1000) % 12 + 1 as int), cast(id % 28 + 1 as int), cast(id % 24 as int), 0, 0)").alias("started_at"),
        station((n * n) % 40).alias("start_station_id"),
        station((n * n) % 40).alias("start_station_name"),
        station(n % 40).alias("end_station_id"),
        station(n % 40).alias("end_station_name"),
        (40.6 + ((n * n) % 40) / 500).cast("string").alias("start_lat"),
        F.lit("-73.9").alias("start_lng"),
        (40.6 + (n % 40) / 500).cast("string").alias("end_lat"),
        F.lit("-73.9").alias("end_lng"),
    )
    write_months(trips, f"{root}/trips")
    crashes = spark.range(900).select(
        F.expr("make_timestamp_ntz(2019 + cast(id % 2 as int), cast(id % 12 + 1 as int), 1, 0, 0, 0)").alias("crash_date"),
        (40.6 + (F.col("id") * F.col("id") % 80) / 1000).alias("latitude"),
        F.lit(-73.9).alias("longitude"),
    )
    write_table(crashes, f"{root}/crashes")
    return str(root)


def test_jobs_in_turn(spark, root):
    run = f"{root}/runs/y2019_2020_modenyc"
    jobs.summarize(spark, f"{root}/trips", run, "nyc", f"{root}/crashes", (250.0, 500.0))
    read = lambda name: spark.read.parquet(f"{run}/{name}")
    assert read("trips_by_year").agg(F.sum("trips")).first()[0] == 24_000
    risk = read("station_risk_lifetime")
    assert risk.where("crashes_within_250m > crashes_within_500m").count() == 0
    assert risk.agg(F.max("crashes_within_500m")).first()[0] > 0
    assert risk.agg(F.sum("start_trips"), F.sum("end_trips")).first() == (24_000, 24_000)
    for grain in ("lifetime", "year_month"):
        for radius in ("500m", "250m"):
            jobs.score(spark, run, radius, min_trips=300 if grain == "lifetime" else 20, grain=grain)
    assert read("scorecard_500m").count() == risk.count()
    jobs.target_windows(spark, run)
    assert read("target_windows").where("window_type = 'month_peak'").count() == 6
    jobs.report_tables(spark, run, min_trips=300)
    assert read("executive_summary").count() == 8
    assert read("when_windows").count() > 0 and read("seasonality").count() > 0
    for radius in ("auto", "250m"):
        jobs.report_tables(spark, run, radius, min_trips=300)
        found = {name: read(name) for name in REPORT_TABLES}
        assert {name for name, df in found.items() if df.isEmpty()} <= {"high_priority"}
        assert found["scorecard_enriched"].count() == risk.count() == found["plain_metrics"].count()
        assert found["dow_by_year"].columns == ["dow", "dow_name", "y2019", "y2020"]
        assert found["seasonality_heatmap"].columns == ["year", *[f"m{m:02d}" for m in range(1, 13)]]
        assert {r["pct"] for r in found["week_part_summary"].agg(F.round(F.sum("pct"), 6).alias("pct")).collect()} == {100.0}
        months = found["crash_ratio_by_month"]
        assert months.count() == 24 and months.agg(F.sum("trips")).first()[0] == found["crash_ratio_by_year"].agg(F.sum("trips")).first()[0]
    jobs.compare_runs(spark, f"{root}/runs", f"{root}/compare", "1-3")
    yearly = {r.year: r for r in spark.read.parquet(f"{root}/compare/trips_by_year_all").collect()}
    assert yearly[2020].yoy_pct == pytest.approx(0.0)
    jobs.predict(spark, run, TreeSettings(rounds=2, depth=2), backtest_months=2, future_months=[1], past_only=True, calendar=True)
    assert read("predictions_future").count() > 0
    metrics = spark.read.json(f"{run}/metrics").first()
    assert metrics["mode"] == "nyc" and metrics["test"]["mae_model"] >= 0 and metrics["backtest"]["backtest_months"] == 2
    assert 1 <= metrics["fit"]["rounds"] <= 2 and metrics["rows"]["rows_val"] > 0


def test_options_reach_the_jobs(monkeypatch):
    seen = {}
    monkeypatch.setattr(jobs, "build_session", lambda *a, **k: "session")
    monkeypatch.setattr(jobs, "predict", lambda *a, **k: seen.setdefault("predict", a))
    monkeypatch.setattr(jobs, "ingest_older_layer", lambda *a: seen.setdefault("older", a))
    jobs.main(["predict", "--run", "r", "--rounds", "7", "--patience", "3", "--depth", "4", "--step", "0.2", "--subsample", "0.5", "--past-only", "--calendar"])
    assert seen["predict"][2] == TreeSettings(rounds=7, patience=3, depth=4, step=0.2, subsample=0.5) and seen["predict"][-2:] == (True, True)
    jobs.main(["older-layer", "--folder", "f", "--out", "o", "--months", "1 2"])
    assert seen["older"][1:] == ("f", "o", [1, 2])
