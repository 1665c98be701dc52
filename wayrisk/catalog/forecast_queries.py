"""Demand panel, splits, baselines and error measures.

Of fitted models the twins compare what does not depend on the trees (rows, months, truth,
baselines, features), and that what the trees give is sound.
"""

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.catalog.registry import query, r6
from wayrisk.operators import panel as P
from wayrisk.plans import forecast
from wayrisk.session import stored, together

_LAGS = [f"y_trips_lag_{k}" for k in P.LAGS]
_ROLL = [f"y_trips_roll{kind}_{n}" for n in P.ROLLING for kind in ("mean", "std")]
_PARTS = [f"{c}_lag_1" for c in P.COMPONENTS]
_KEY = "mode, station_id, date_index"
_SPLIT = """CASE WHEN label_date_index >= (SELECT max(label_date_index) FROM features WHERE y_label IS NOT NULL) THEN 'test'
    WHEN label_date_index >= (SELECT max(label_date_index) - 1 FROM features WHERE y_label IS NOT NULL) THEN 'val' ELSE 'train' END"""
# the engine's own defaults
SETTINGS = forecast.TreeSettings()


def _panel(v):
    return P.station_panel(v.exposure)


def _features(v):
    return P.panel_features(_panel(v))


@query("win3_demand_lags", f"SELECT {_KEY}, {', '.join(_LAGS)} FROM features")
def _(v):
    return _features(v).select("mode", "station_id", "date_index", *_LAGS)


@query("win4_label_by_row", f"SELECT {_KEY}, label_date_index, y_label FROM features")
def _(v):
    return P.with_label(_panel(v)).select("mode", "station_id", "date_index", "label_date_index", "y_label")


@query(
    "win4_label_by_calendar",
    f"""SELECT a.mode, a.station_id, a.date_index, a.date_index + 2 AS label_date_index, b.y_trips AS y_label FROM panel a
        LEFT JOIN panel b ON b.mode = a.mode AND b.station_id = a.station_id AND b.date_index = a.date_index + 2""",
)
def _(v):
    df = P.with_label(_panel(v), horizon=2, calendar=True)
    return df.select("mode", "station_id", "date_index", "label_date_index", "y_label")


@query("win5_win6_past_rolling", f"SELECT {_KEY}, {r6(*_ROLL)} FROM features")
def _(v):
    return _features(v).select("mode", "station_id", "date_index", *_ROLL)


@query("win7_component_lags", f"SELECT {_KEY}, {', '.join(_PARTS)} FROM features")
def _(v):
    return _features(v).select("mode", "station_id", "date_index", *_PARTS)


@query("win8_station_means", f"SELECT {_KEY}, {r6('station_mean', 'station_month_mean')}, has_y_trips FROM features")
def _(v):
    return _features(v).select("mode", "station_id", "date_index", "station_mean", "station_month_mean", "has_y_trips")


@query(
    "win8_station_means_past_only",
    f"""SELECT {_KEY}, round(m, 6) AS station_mean, round(coalesce(mm, m), 6) AS station_month_mean FROM (
        SELECT *, avg(y_trips) OVER (PARTITION BY mode, station_id ORDER BY date_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
          avg(y_trips) OVER (PARTITION BY mode, station_id, month ORDER BY date_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mm
        FROM panel)""",
)
def _(v):
    df = P.with_station_means(_panel(v), past_only=True)
    return df.select("mode", "station_id", "date_index", "station_mean", "station_month_mean")


@query("mlf1_season_features", f"SELECT {_KEY}, {r6('month_sin', 'month_cos')} FROM features")
def _(v):
    return P.with_season(_panel(v)).select("mode", "station_id", "date_index", "month_sin", "month_cos")


_MATRIX = [
    "month_sin", "month_cos", "station_mean", "station_month_mean", "has_y_trips", *_LAGS, *_ROLL, "station_lat", "station_lng",
    *_PARTS,
]


@query(
    "mlf2_feature_matrix",
    f"SELECT {_KEY}, y_label, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in _MATRIX) + " FROM features WHERE y_label IS NOT NULL",
)
def _(v):
    return forecast.labelled_rows(_panel(v)).select("mode", "station_id", "date_index", "y_label", *_MATRIX)


def _split(v):
    rows = forecast.labelled_rows(_panel(v))
    return forecast.with_split(rows, forecast.plan_split(forecast._label_months(rows)))


@query("mlf4_time_split", f"SELECT {_KEY}, {_SPLIT} AS split FROM features WHERE y_label IS NOT NULL")
def _(v):
    return _split(v).select("mode", "station_id", "date_index", "split")


@query(
    "agg40_split_sizes",
    f"""SELECT mode, split, count(*) AS rows, count(DISTINCT station_id) AS stations FROM (
        SELECT mode, station_id, {_SPLIT} AS split FROM features WHERE y_label IS NOT NULL) GROUP BY mode, split""",
)
def _(v):
    return P.split_sizes(_split(v))


_BASE = f"""SELECT {_KEY}, y_label, coalesce(y_trips_lag_1, 0) AS baseline_lag1_pred,
    coalesce(y_trips_lag_12, y_trips_lag_1, 0) AS baseline_lag12_pred FROM features WHERE y_label IS NOT NULL"""


@query("mlf8_baselines", _BASE)
def _(v):
    return forecast.labelled_rows(_panel(v)).select(
        "mode", "station_id", "date_index", "y_label", "baseline_lag1_pred", "baseline_lag12_pred"
    )


def _smape(p: str) -> str:
    return f"round(avg(abs({p} - y_label) / greatest((abs(y_label) + abs({p})) / 2, 1e-6)), 6)"


@query(
    "agg36_agg37_baseline_errors",
    f"""SELECT mode, round(avg(abs(y_label - baseline_lag1_pred)), 6) AS mae_baseline_lag1, {_smape('baseline_lag1_pred')} AS smape_baseline_lag1,
        round(avg(abs(y_label - baseline_lag12_pred)), 6) AS mae_baseline_lag12, {_smape('baseline_lag12_pred')} AS smape_baseline_lag12
        FROM ({_BASE}) GROUP BY mode""",
)
def _(v):
    rows = forecast.labelled_rows(_panel(v)).withColumnRenamed("y_label", "y_true_next_month")
    return P.error_table(rows)


@query(
    "agg39_improvement_pct",
    f"""SELECT mode, round(100 * (one - m) / greatest(one, 1e-9), 6) AS mae_improvement_vs_lag1_pct,
        round(100 * (twelve - m) / greatest(twelve, 1e-9), 6) AS mae_improvement_vs_lag12_pct FROM (
        SELECT mode, avg(abs(y_label - coalesce(y_trips_lag_1, 0))) AS one,
          avg(abs(y_label - coalesce(y_trips_lag_12, y_trips_lag_1, 0))) AS twelve, avg(abs(y_label - station_mean)) AS m
        FROM features WHERE y_label IS NOT NULL GROUP BY mode)""",
)
def _(v):
    # the station mean stands in for a model, so SQL can follow
    rows = forecast.labelled_rows(_panel(v)).withColumns(
        {"y_true_next_month": F.col("y_label"), "y_pred_next_month": F.col("station_mean")}
    )
    return P.error_table(rows).select("mode", "mae_improvement_vs_lag1_pct", "mae_improvement_vs_lag12_pct")


@query(
    "agg41_last_month_index",
    "SELECT mode, max(date_index) AS last_index, max(date_index - 1) // 12 AS last_year FROM panel GROUP BY mode",
)
def _(v):
    from wayrisk.functions import expr as X

    last = _panel(v).groupBy("mode").agg(F.max("date_index").alias("last_index"))
    return last.withColumn("last_year", X.year_of(F.col("last_index")))


@query(
    "win14_latest_station_row",
    """SELECT mode, station_id, date_index, y_trips FROM panel
       QUALIFY row_number() OVER (PARTITION BY mode, station_id ORDER BY date_index DESC) = 1""",
)
def _(v):
    return P.latest_rows(_panel(v)).select("mode", "station_id", "date_index", "y_trips")


@query(
    "win15_keep_last_by_key",
    """SELECT mode, year, month, trip_no FROM trips
       QUALIFY row_number() OVER (PARTITION BY mode, year, month ORDER BY trip_no DESC) = 1""",
)
def _(v):
    rows = v.trips.select("mode", "year", "month", "trip_no")
    return P.latest_rows(rows, ("mode", "year", "month"), ("trip_no",))


@query(
    "prj23_month_index",
    """SELECT DISTINCT date_index, (date_index - 1) // 12 AS year, (date_index - 1) % 12 + 1 AS month,
       (date_index + 4) // 12 AS year_plus_5, (date_index + 4) % 12 + 1 AS month_plus_5 FROM panel""",
)
def _(v):
    from wayrisk.functions import expr as X

    at = F.col("date_index")
    return (
        _panel(v)
        .select("date_index")
        .distinct()
        .select(
            "date_index",
            X.year_of(at).alias("year"),
            X.month_of(at).alias("month"),
            X.year_of(at + 5).alias("year_plus_5"),
            X.month_of(at + 5).alias("month_plus_5"),
        )
    )


@query("mlf13_filled_history", f"SELECT {_KEY}, round(coalesce(y_trips, station_month_mean), 6) AS y_work FROM features")
def _(v):
    return P.filled_history(P.with_station_means(_panel(v))).select("mode", "station_id", "date_index", "y_work")


@query("mlf7_log_target", f"SELECT {_KEY}, round(ln(1 + greatest(y_label, 0)), 6) AS log_label FROM features WHERE y_label IS NOT NULL")
def _(v):
    rows = forecast.labelled_rows(_panel(v))
    return rows.select("mode", "station_id", "date_index", F.log1p(F.greatest("y_label", F.lit(0.0))).alias("log_label"))


_OF_MODE = """(SELECT *, max(label_date_index) OVER (PARTITION BY mode) AS newest FROM features WHERE y_label IS NOT NULL)"""
_MODE_SPLIT = "CASE WHEN label_date_index = newest THEN 'test' WHEN label_date_index = newest - 1 THEN 'val' ELSE 'train' END"
_OWN_COLUMNS = [c for c in forecast.PREDICTION_COLUMNS if c != "y_pred_next_month"]
_TABLE = f"""SELECT mode, station_id, start_station_name, round(station_lng, 6) AS station_lng, round(station_lat, 6) AS station_lat,
    year AS feature_year, month AS feature_month, date_index, label_date_index, (label_date_index - 1) // 12 AS label_year,
    (label_date_index - 1) % 12 + 1 AS label_month, y_label AS y_true_next_month, coalesce(y_trips_lag_1, 0) AS baseline_lag1_pred,
    coalesce(y_trips_lag_12, y_trips_lag_1, 0) AS baseline_lag12_pred, {_MODE_SPLIT} AS split FROM {_OF_MODE}"""


def _sound(name: str):
    """A prediction is there, finite and not negative."""
    p = F.col(name)
    return p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))


# What another trainer would give too is compared value by value; of the predictions that they are sound,
# and of the test month that the model is at most twice as far off as last month's value.
@query("mlf9_predictions", f"SELECT *, true AS prediction_sound, true AS test_error_sound FROM ({_TABLE}) WHERE split <> 'train'")
def _(v):
    results = forecast.forecast_demand(v.exposure, SETTINGS, backtest_months=0, write_splits="valtest")
    near = [(r.mode, r.metrics["mae_model"] <= 2 * r.metrics["mae_baseline_lag1"]) for r in results]
    rows = forecast.all_predictions(results).join(v.spark.createDataFrame(near, "mode string, test_error_sound boolean"), "mode")
    return rows.select(*_OWN_COLUMNS, _sound("y_pred_next_month").alias("prediction_sound"), "test_error_sound")


def _each_mode(v):
    """Labelled rows, and the modes they hold: models are fitted per mode."""
    rows = stored(forecast.labelled_rows(_panel(v)))
    return rows, sorted(r["mode"] for r in rows.select("mode").distinct().collect())


def _per_mode(v, step):
    """``step(rows of a mode)`` of all modes side by side, by mode."""
    rows, modes = _each_mode(v)
    return dict(zip(modes, together(v.spark, [partial(step, rows.where(F.col("mode") == m)) for m in modes]), strict=True))


@query(
    "mlf10_backtest",
    f"""SELECT t.mode, t.label_date_index, t.test_rows, count(*) AS train_rows, true AS errors_sound FROM (
          SELECT mode, label_date_index, count(*) AS test_rows FROM {_OF_MODE} GROUP BY mode, label_date_index
          QUALIFY row_number() OVER (PARTITION BY mode ORDER BY label_date_index DESC) <= 6) t
        JOIN {_OF_MODE} f ON f.mode = t.mode AND f.label_date_index < t.label_date_index GROUP BY ALL""",
)
def _(v):
    found = _per_mode(v, lambda rows: forecast.backtest_months(rows, SETTINGS))
    table = [
        (mode, m["label_date_index"], m["test_rows"], m["train_rows"], 0 <= m["mae"] < float("inf") and 0 <= m["smape"] <= 2)
        for mode, months in found.items()
        for m in months
    ]
    return v.spark.createDataFrame(table, "mode string, label_date_index int, test_rows long, train_rows long, errors_sound boolean")


@query(
    "agg38_backtest_summary",
    f"""SELECT mode, CAST(count(*) AS DOUBLE) AS backtest_months, round(avg(mae), 6) AS backtest_mae_mean,
          round(stddev_pop(mae), 6) AS backtest_mae_std, round(avg(smape), 6) AS backtest_smape_mean, round(stddev_pop(smape), 6) AS backtest_smape_std
        FROM (SELECT mode, label_date_index, avg(abs(y_label - coalesce(y_trips_lag_1, 0))) AS mae,
            avg(abs(coalesce(y_trips_lag_1, 0) - y_label) / greatest((abs(y_label) + abs(coalesce(y_trips_lag_1, 0))) / 2, 1e-6)) AS smape
          FROM {_OF_MODE} GROUP BY mode, label_date_index
          QUALIFY row_number() OVER (PARTITION BY mode ORDER BY label_date_index DESC) <= 6) GROUP BY mode""",
)
def _(v):
    # last month's value stands in for a model, so SQL can follow
    y, p = F.col("y_label"), F.col("baseline_lag1_pred")
    by_month = forecast.labelled_rows(_panel(v)).groupBy("mode", "label_date_index").agg(P.mae(y, p).alias("mae"), P.smape(y, p).alias("smape"))
    newest = Window.partitionBy("mode").orderBy(F.desc("label_date_index"))
    last = by_month.withColumn("_place", F.row_number().over(newest)).where("_place <= 6")
    return forecast.backtest_summary(last)


@query(
    "mlf11_feature_importance",
    "SELECT mode, unnest([" + ", ".join(f"'{c}'" for c in _MATRIX) + """]) AS feature, true AS sound, true AS sums_to_one
       FROM (SELECT DISTINCT mode FROM features WHERE y_label IS NOT NULL)""",
)
def _(v):
    def weights(rows):
        features = P.feature_columns(rows)
        fitted = forecast.fit_trees(rows, features, SETTINGS)
        return forecast.feature_importance(fitted.model, features, v.spark).collect()

    found = _per_mode(v, weights)
    table = [
        (mode, r["feature"], 0 <= r["importance"] <= 1, abs(sum(x["importance"] for x in rows) - 1) < 1e-6)
        for mode, rows in found.items()
        for r in rows
    ]
    return v.spark.createDataFrame(table, "mode string, feature string, sound boolean, sums_to_one boolean")


@query(
    "mlf6_early_stopping",
    f"""SELECT mode, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'val') AS val_rows,
          100 AS rounds_tried, true AS stops_at_least_error, true AS waited_long_enough
        FROM ({_TABLE}) GROUP BY mode""",
)
def _(v):
    def stopped(rows):
        split = forecast.with_split(rows, forecast.plan_split(forecast._label_months(rows)))
        train, val = (split.where(F.col("split") == s) for s in ("train", "val"))
        fitted = forecast.fit_trees(train, P.feature_columns(rows), SETTINGS, val)
        errors, best = fitted.validation_errors, fitted.rounds
        ahead = errors[best : best + SETTINGS.patience]
        waited = all(e >= errors[best - 1] for e in ahead) and len(fitted.model.stages[-1].trees) == best
        return train.count(), val.count(), len(errors), errors[best - 1] == min(errors[: best + len(ahead)]), waited

    table = [(mode, *found) for mode, found in _per_mode(v, stopped).items()]
    return v.spark.createDataFrame(table, "mode string, train_rows long, val_rows long, rounds_tried int, stops_at_least_error boolean, waited_long_enough boolean")


@query(
    "mlf12_future_months",
    """SELECT p.mode, station_id, start_station_name, round(station_lng, 6) AS station_lng, round(station_lat, 6) AS station_lat,
          (last - 1) // 12 + 1 AS label_year, m AS label_month, ((last - 1) // 12 + 1) * 12 + m AS label_date_index,
          (((last - 1) // 12 + 1) * 12 + m - 2) // 12 AS feature_year, (((last - 1) // 12 + 1) * 12 + m - 2) % 12 + 1 AS feature_month,
          'future' AS split, true AS prediction_sound
        FROM panel p JOIN (SELECT mode, max(date_index) AS last FROM panel GROUP BY mode) l ON l.mode = p.mode AND l.last = p.date_index,
          (VALUES (3), (4)) AS months(m)""",
)
def _(v):
    rows = forecast.forecast_future(v.exposure, [3, 4], years_ahead=1, settings=SETTINGS)
    return rows.withColumn("prediction_sound", _sound("y_pred_next_month")).drop("y_pred_next_month")


@query("set6_written_splits", f"SELECT * FROM ({_TABLE})")
def _(v):
    # the union of all splits as it is written; the stand-in prediction is left out
    rows, modes = _each_mode(v)
    parts = []
    for m in modes:
        mine = rows.where(F.col("mode") == m)
        split = forecast.with_split(mine, forecast.plan_split(forecast._label_months(mine)))
        parts.append(forecast.prediction_table(split.withColumn("y_pred_next_month", F.col("baseline_lag1_pred")), forecast.WRITTEN_SPLITS["all"]))
    return reduce(DataFrame.unionByName, parts).select(*_OWN_COLUMNS)


_ASKED = [(1, 1), (6, 12), (40, 60), (0, 1), (1, 0), (500, 1)]


@query(
    "mlf3_split_plans",
    f"""SELECT mode, val, test, label_months, kind, CASE WHEN t > 0 THEN v ELSE 0 END AS val_months, t AS test_months,
          CASE WHEN t > 0 AND v > 0 THEN months[label_months - t - v + 1] END AS val_from, CASE WHEN t > 0 THEN months[label_months - t + 1] END AS test_from
        FROM (SELECT *, CASE WHEN normal THEN 'normal' ELSE 'degraded' END AS kind, CASE WHEN normal THEN test WHEN label_months >= 2 THEN 1 ELSE 0 END AS t,
            CASE WHEN normal THEN val WHEN label_months >= 3 THEN 1 ELSE 0 END AS v FROM (
          SELECT *, len(months) AS label_months, len(months) >= val + test + 2 AS normal FROM (
            SELECT mode, list_sort(list(DISTINCT label_date_index)) AS months FROM features WHERE y_label IS NOT NULL GROUP BY mode),
            (VALUES {', '.join(map(str, _ASKED))}) AS asked(val, test)))""",
)
def _(v):
    rows, modes = _each_mode(v)
    table = []
    for m in modes:
        months = forecast._label_months(rows.where(F.col("mode") == m))
        for val, test in _ASKED:
            plan = forecast.plan_split(months, val, test)
            table.append((m, val, test, plan.label_months, plan.kind, plan.val_months, plan.test_months, plan.val_from, plan.test_from))
    return v.spark.createDataFrame(
        table, "mode string, val int, test int, label_months int, kind string, val_months int, test_months int, val_from int, test_from int"
    )
