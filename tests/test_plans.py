import math

import pytest
from pyspark.sql import functions as F

from wayrisk.operators import panel as P
from wayrisk.plans import compare, forecast, report, scorecard, summaries, windows
from wayrisk.sources import tables


@pytest.fixture(scope="module")
def risk(spark):
    """60 stations of nyc with differing risk, 12 of jc without any."""
    rows = spark.range(72).select(
        F.when(F.col("id") < 60, "nyc").otherwise("jc").alias("mode"),
        F.format_string("s%03d", "id").alias("start_station_id"),
        F.lit("n").alias("start_station_name"),
        (40.0 + F.col("id") / 1000).alias("station_lat"),
        F.lit(-74.0).alias("station_lng"),
        (F.col("id") * 250 + 100).alias("trips"),
        F.when(F.col("id") < 60, F.col("id") % 7).otherwise(0).alias("crashes_within_500m"),
    )
    rate = F.col("crashes_within_500m") / F.col("trips") * 100000.0
    return rows.withColumn("crashes_within_500m_per_100k_trips", rate)


@pytest.fixture(scope="module")
def card(risk):
    return scorecard.build_scorecard(risk).cache()


def test_scorecard_invariants(card):
    rows = card.collect()
    assert card.columns == [c for c in scorecard.COLUMNS if c not in ("year", "month")]
    total = {m: (sum(r.crash_count for r in rows if r.mode == m), sum(r.exposure_trips for r in rows if r.mode == m)) for m in ("nyc", "jc")}
    base = total["nyc"][0] / total["nyc"][1] * 1e5
    for r in rows:
        if r.mode == "jc":
            assert r.credibility_flag == "no_risk_data" and r.eb_risk_rate_per_100k_trips is None
            assert r.priority_score == r.exposure_pct and not r.risk_proxy_available
            assert r.prevention_hotspot == (r.exposure_index_pct >= 90)
            continue
        lo, hi = sorted((base, r.risk_rate_per_100k_trips))
        assert lo - 1e-9 <= r.eb_risk_rate_per_100k_trips <= hi + 1e-9
        assert r.risk_rate_ci_low <= r.risk_rate_per_100k_trips <= r.risk_rate_ci_high
        assert (r.risk_index_pct is None) == (r.exposure_trips < 5000)
        assert r.acquisition_hotspot == (r.exposure_index_pct >= 70 and r.risk_pct <= 0.3)
    assert max(r.priority_score for r in rows) == 1.0


def test_scorecard_needs_its_radius(risk):
    with pytest.raises(ValueError):
        scorecard.build_scorecard(risk, radius="750m")
    with pytest.raises(ValueError):
        scorecard.build_scorecard(risk.drop("station_lat"))
    assert scorecard.build_scorecard(risk, radius="auto", m_prior=123).where(
        "scoring_strategy = 'eb_expected_incidents_mintrips5000_mprior123'"
    ).count() == 60


def test_enriched_scorecard_single_values(spark):
    rows = [("m", f"s{i}", "n", 100, 0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "mode string, start_station_id string, start_station_name string, exposure_trips long, crash_count long, risk_rate_per_100k_trips double")
    out = scorecard.enrich_scorecard(df).collect()
    assert {r.exposure_index_pct for r in out} == {50.0} and {r.eb_priority_score for r in out} == {50.0}
    assert {r.scoring_strategy for r in out} == {"exposure_only_no_risk_signal"}


def test_reports_on_a_card(card):
    high = report.high_risk(card)
    assert 0 < high.count() <= 6
    shares = report.tier_shares(report.with_tiers(card)).collect()
    assert [r.risk_tier for r in sorted(shares, key=lambda r: r.tier_order)] == ["Low Risk", "Medium Risk", "High Risk"]
    assert math.isclose(sum(r.pct for r in shares), 100.0)
    zones = {r.zone: r.stations for r in report.counts_of(report.risk_zones(card), "zone").collect()}
    assert sum(zones.values()) == 40
    assert sum(r.stations for r in report.rate_histogram(card).collect()) == 40
    summary = {r.metric: r for r in report.executive_summary(card).collect()}
    assert summary["Total station-period rows"].value == 72
    assert summary["Credible rows (>=5,000 trips)"].value == 40
    assert report.where_prevention(card, 5).count() == 5
    assert "prevention_hotspot" not in report.where_prevention(card).columns


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("credible", 2.0)] * 4, "credibility_flag string, eb_risk_rate_per_100k_trips double")
    assert [(r.bin, r.stations) for r in report.rate_histogram(df).collect()] == [(15, 4)]


def test_overlay_years():
    assert report.overlay_years([2021, 2019, 2020]) == [2019, 2020, 2021]
    assert report.overlay_years([2018, 2021, 2019, 2020]) == [2018, 2021]


# --- comparison --------------------------------------------------------------
def run_months(spark, rows):
    return spark.createDataFrame(rows, "run_tag string, mode string, year int, month int, trips long")


def test_year_over_year_only_over_equal_months(spark):
    rows = [("r1", "nyc", y, m, t) for y, months, t in ((2018, (1, 2), 10), (2020, (1, 2), 15), (2021, (1, 2, 3), 5), (2022, (1, 2, 3), 0), (2023, (1, 2, 3), 4)) for m in months]
    rows += [("r0", "nyc", 2018, 1, 99)]
    months = run_months(spark, rows)
    years = months.groupBy("run_tag", "mode", "year").agg(F.sum("trips").alias("trips"))
    best = compare.best_runs(years, months)
    assert {r.run_tag for r in best.collect()} == {"r1"}
    got = {r.year: r for r in compare.year_over_year(best, compare.of_best_runs(months, best)).collect()}
    assert got[2018].yoy_pct is None
    assert got[2020].yoy_pct == pytest.approx(50.0)
    assert got[2021].yoy_pct is None  # other months
    assert got[2022].yoy_pct == pytest.approx(-100.0)
    assert got[2023].yoy_pct is None  # previous year had none
    asked = {r.year: r for r in compare.year_over_year(best, compare.of_best_runs(months, best), [1, 2]).collect()}
    assert asked[2021].yoy_pct == pytest.approx((10 / 30 - 1) * 100) and asked[2021].yoy_basis == "months=1,2"


def test_two_runs_with_the_same_year_count_once(spark):
    months = run_months(spark, [("a", "nyc", 2020, 1, 10), ("b", "nyc", 2020, 1, 10), ("a", "nyc", 2021, 1, 1), ("b", "nyc", 2021, 1, 2)])
    years = months.groupBy("run_tag", "mode", "year").agg(F.sum("trips").alias("trips"))
    best = compare.best_runs(years, months)
    assert {(r.year, r.run_tag) for r in best.collect()} == {(2020, "a"), (2021, "b")}
    assert compare.of_best_runs(months, best).count() == 2


def test_best_runs_without_month_tables(spark):
    years = spark.createDataFrame([("a", "nyc", 2020, 5), ("b", "nyc", 2020, 6)], "run_tag string, mode string, year int, trips long")
    assert compare.best_runs(years, None).first().run_tag == "b"


def test_run_tables_round_trip(spark, tmp_path):
    from wayrisk.schemas import USAGE_YEAR
    from wayrisk.sinks.partitions import write_table

    for tag in ("y2020_m1_modenyc", "y2021_m1_modenyc", "other"):
        df = spark.createDataFrame([("nyc", int(tag[1:5]) if tag[0] == "y" else 1, 5)], USAGE_YEAR)
        write_table(df, f"{tmp_path}/{tag}/trips_by_year", "csv")
    rows = tables.read_runs(spark, str(tmp_path), "trips_by_year", USAGE_YEAR, form="csv").collect()
    assert {(r.run_tag, r.year) for r in rows} == {("y2020_m1_modenyc", 2020), ("y2021_m1_modenyc", 2021)}
    (tmp_path / "y2022_m1_modenyc" / "trips_by_year").mkdir(parents=True)
    (tmp_path / "y2022_m1_modenyc" / "trips_by_year" / "part.csv").write_text("mode,year,trips\nnyc,2022,\n")
    (tmp_path / "y2020_m1_modenyc" / "trips_by_year" / "more.csv").write_text("mode,year,trips\nnyc,,7\n")
    rows = tables.read_runs(spark, str(tmp_path), "trips_by_year", USAGE_YEAR, form="csv").collect()
    assert {(r.run_tag, r.year) for r in rows} == {("y2020_m1_modenyc", 2020), ("y2020_m1_modenyc", None), ("y2021_m1_modenyc", 2021)}
    assert tables.read_table(spark, str(tmp_path / "none"), optional=True) is None
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "none"))


def test_table_choices(spark):
    run, combined = (spark.createDataFrame([(m, y)], "mode string, year int") for m, y in (("NYC", 2020), ("nyc", 2021)))
    assert tables.preferred_table(run, combined, "nyc").first().year == 2021
    assert tables.preferred_table(run, combined, "nyc", years=[2020]).first().year == 2020
    assert tables.preferred_table(run, None, "nyc").first().year == 2020
    assert tables.finest_risk({"year": run, "lifetime": combined})[0] == "year"
    with pytest.raises(FileNotFoundError):
        tables.finest_risk({"lifetime": run}, strict=True)
    assert tables.scorecard_for({250: run, 500: combined}, 300) is combined


def test_windows_without_week_parts_give_only_months(spark):
    hours = spark.createDataFrame([("m", "overall", 8, 5)], "mode string, week_part string, hour int, trips long")
    days = spark.createDataFrame([("m", "overall", 1, "Tuesday", 5)], "mode string, week_part string, dow int, dow_name string, trips long")
    months = spark.createDataFrame([("m", 2020, 2, 58, 2.0)], "mode string, year int, month int, trips long, trips_per_day double")
    rows = windows.target_windows(hours, days, months).collect()
    assert [(r.window_type, r.window_label, r.priority_metric) for r in rows] == [("month_peak", "2020-02", 2.0)]


def test_risk_without_crash_table(spark):
    exposure = spark.createDataFrame(
        [("nyc", 2020, 1, "1", "A", 1, 1, None, None, 2, 2)],
        "mode string, year int, month int, start_station_id string, start_station_name string, start_trips long, end_trips long, station_lat double, station_lng double, touchpoints long, trips long",
    )
    r = summaries.station_risk(exposure, None, [500.0]).first()
    assert (r.crashes_within_500m, r.risk_proxy_available) == (0, 0)


# --- forecast ----------------------------------------------------------------
def test_split_plans():
    normal = forecast.plan_split(range(100, 110), 2, 1)
    assert (normal.kind, normal.val_from, normal.test_from) == ("normal", 107, 109)
    three = forecast.plan_split([1, 2, 3], 1, 1)
    assert (three.kind, three.val_from, three.test_from) == ("degraded", 2, 3)
    two = forecast.plan_split([1, 2], 1, 1)
    assert (two.val_months, two.val_from, two.test_from) == (0, None, 2)
    one = forecast.plan_split([1], 1, 1)
    assert (one.test_months, one.test_from) == (0, None)


def demand(spark, months=30):
    return spark.range(6 * months).select(
        F.lit("nyc").alias("mode"),
        F.format_string("s%d", F.col("id") % 6).alias("start_station_id"),
        F.lit("n").alias("start_station_name"),
        (2020 + F.floor(F.floor(F.col("id") / 6) / 12)).cast("int").alias("year"),
        (F.floor(F.col("id") / 6) % 12 + 1).cast("int").alias("month"),
        ((F.col("id") % 6 + 1) * 10 + F.floor(F.col("id") / 6) % 12).alias("trips"),
        F.lit(40.0).alias("station_lat"),
        F.lit(-74.0).alias("station_lng"),
    )


def test_rolling_figures_look_back_only(spark):
    df = spark.createDataFrame([("m", "s", i, float(v)) for i, v in enumerate([1, 5, 9, 100], 1)], "mode string, station_id string, date_index int, y_trips double")
    df = df.withColumns({"start_station_name": F.lit("")})
    rows = P.with_history(df).orderBy("date_index").collect()
    assert [r.y_trips_rollmean_3 for r in rows] == [None, 1.0, 3.0, 5.0]
    assert [r.y_trips_rollstd_3 for r in rows] == [None, None, pytest.approx(math.sqrt(8)), 4.0]
    assert [r.y_trips_lag_2 for r in rows] == [None, None, 1.0, 5.0]


def test_labels_by_row_and_by_calendar(spark):
    df = spark.createDataFrame([("m", "s", "", i, float(i)) for i in (1, 2, 5)], "mode string, station_id string, start_station_name string, date_index int, y_trips double")
    assert [r.y_label for r in P.with_label(df).orderBy("date_index").collect()] == [2.0, 5.0, None]
    assert [r.y_label for r in P.with_label(df, calendar=True).orderBy("date_index").collect()] == [2.0, None, None]


def test_forecast_end_to_end(spark):
    settings = forecast.TreeSettings(rounds=8, depth=3, step=0.3, log1p=True, patience=2)
    (result,) = forecast.forecast_demand(demand(spark), settings, backtest_months=2, write_splits="all")
    m = result.metrics
    assert m["split_mode"] == "normal" and m["rows_test"] == 6 and m["rows_val"] == 6
    assert m["mae_model"] >= 0 and m["backtest_mae_mean"] >= 0
    rows = result.predictions.collect()
    assert {r.split for r in rows} == {"train", "val", "test"} and all(r.y_pred_next_month >= 0 for r in rows)
    assert result.predictions.columns == forecast.PREDICTION_COLUMNS
    assert result.importance.count() == 15


def test_future_months_feed_back(spark):
    settings = forecast.TreeSettings(rounds=3, depth=2, step=0.3)
    rows = forecast.forecast_future(demand(spark, 18), [2, 8], 1, settings).collect()
    assert {(r.label_year, r.label_month) for r in rows} == {(2022, 2), (2022, 8)}
    assert len(rows) == 12 and {r.feature_month for r in rows} == {1, 7}
    with pytest.raises(ValueError):
        forecast.forecast_future(demand(spark), [], 1, settings)


def test_state_features_equal_window_features(spark):
    """The array state of the future loop gives what the windows give."""
    panel = P.station_panel(demand(spark, 15))
    w = P._months_of_station()
    rows = P.with_history(panel).withColumn("_past", F.reverse(F.collect_list("y_trips").over(w.rowsBetween(-12, -1))))
    names = [c for c in rows.columns if "lag" in c or "roll" in c]
    both = rows.withColumns({f"{n}_x": c for n, c in forecast._state_features(1).items() if n in names})
    for r in both.collect():
        for n in names:
            a, b = r[n], r[f"{n}_x"]
            assert (a is None and b is None) or a == pytest.approx(b), (n, a, b)


def test_too_few_months_train_only(spark):
    rows = P.station_panel(demand(spark, 2))
    labelled = forecast.labelled_rows(rows)
    out = forecast.evaluate_mode(labelled, "nyc", forecast.TreeSettings(rounds=2, depth=2))
    assert out.predictions is None and "note" in out.metrics
    assert forecast.backtest(labelled, forecast.TreeSettings(), 6) == {"backtest_skipped": 1.0, "backtest_reason": 1.0}


def test_renamed_station_has_one_panel_row_a_month(spark):
    rows = [("m", 2023, 1, "s", "A", 2, 40.0), ("m", 2023, 1, "s", "B", 3, 42.0), ("m", 2023, 2, "s", "B", 7, 42.0)]
    exposure = spark.createDataFrame(rows, "mode string, year int, month int, start_station_id string, start_station_name string, trips long, station_lat double")
    panel = P.station_panel(exposure)
    for calendar in (False, True):
        got = [tuple(r) for r in P.with_label(panel, calendar=calendar).orderBy("month").select("month", "start_station_name", "y_trips", "station_lat", "y_label").collect()]
        assert got == [(1, "B", 5.0, 41.0, 7.0), (2, "B", 7.0, 42.0, None)]
