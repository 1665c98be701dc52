"""The model queries: the engine's own defaults, early stopping, and whole queries beside their twins."""

import dataclasses

import duckdb
import pytest
from pyspark.sql import functions as F

from wayrisk.catalog import forecast_queries, registry
from wayrisk.operators import panel as P
from wayrisk.plans import forecast
from wayrisk.session import together

FOLDER = "/root/testdata/sf0.001"
LIGHT = forecast.TreeSettings(rounds=6, depth=3, step=0.3, patience=2)


def test_queries_use_the_engines_defaults():
    assert forecast_queries.SETTINGS == forecast.TreeSettings()


def test_best_round():
    assert forecast.best_round([5.0, 4.0, 3.0], 2) == 3
    assert forecast.best_round([5.0, 4.0, 4.5, 4.2, 1.0], 2) == 2
    assert forecast.best_round([5.0, 4.0, 4.5, 1.0], 2) == 4
    assert forecast.best_round([3.0, 3.0, 3.0], 1) == 1
    assert forecast.best_round([1.0], 20) == 1


@pytest.mark.parametrize("name", ["mlf6_early_stopping", "mlf9_predictions", "mlf10_backtest", "mlf11_feature_importance", "mlf12_future_months"])
def test_whole_query_and_twin(spark, monkeypatch, name):
    """Light trees: the twins compare what does not depend on them, and that the rest is sound."""
    registry.load()
    monkeypatch.setattr(forecast_queries, "SETTINGS", LIGHT)
    got = registry.QUERIES[name](spark, FOLDER)
    db = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)
    have, want = plain(got.select(*columns).collect()), plain(want)
    if name == "mlf6_early_stopping":  # the number of rounds tried is the setting's
        have, want = ([tuple(x for x in r if x not in ("6.0", "100.0")) for r in rows] for rows in (have, want))
    assert have == want and have


def stations(spark, months=20):
    n = F.col("id")
    rows = spark.range(30 * months).select(
        F.lit("m").alias("mode"), F.format_string("s%02d", n % 30).alias("start_station_id"), F.format_string("s%02d", n % 30).alias("start_station_name"),
        (2019 + F.floor(n / 30 / 12)).cast("int").alias("year"), (F.floor(n / 30) % 12 + 1).cast("int").alias("month"),
        (50 + (n % 30) * 7 + F.floor(n / 30) % 12 * (n % 5)).alias("trips"), F.lit(40.0).alias("station_lat"), F.lit(-73.0).alias("station_lng"),
    )
    return rows.withColumns({"start_trips": F.col("trips"), "end_trips": F.col("trips"), "touchpoints": 2 * F.col("trips")})


def test_patience_cuts_to_the_best_prefix(spark):
    rows = forecast.labelled_rows(P.station_panel(stations(spark))).cache()
    plan = forecast.plan_split(forecast._label_months(rows))
    split = forecast.with_split(rows, plan)
    train, val = (split.where(F.col("split") == s) for s in ("train", "val"))
    features = P.feature_columns(rows)
    settings = forecast.TreeSettings(rounds=25, depth=3, step=0.5, patience=3)
    fitted = forecast.fit_trees(train, features, settings, val)
    assert len(fitted.validation_errors) == 25 and fitted.rounds == forecast.best_round(fitted.validation_errors, 3)
    trees = fitted.model.stages[-1]
    assert len(trees.trees) == fitted.rounds
    checked = fitted.model.transform(val).agg(F.avg(F.abs(F.col("_prediction") - F.col("y_label")))).first()[0]
    assert checked == pytest.approx(fitted.validation_errors[fitted.rounds - 1])
    assert forecast.fit_trees(train, features, settings).rounds == 25
    assert forecast.fit_trees(train, features, forecast.TreeSettings(rounds=4, depth=3, patience=None), val).validation_errors == []
    assert forecast.fit_trees(train, features, settings, val.where("false")).rounds == 25


def test_steps_run_side_by_side_in_order(spark):
    assert together(spark, [lambda k=k: spark.range(k).count() for k in (3, 1, 2)]) == [3, 1, 2] and together(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1 // 0, lambda: 1])


def test_a_round_carries_few_trees_and_few_tasks(spark):
    """Stored predictions bound what a task carries; the trees are those of any interval."""
    rows = forecast.labelled_rows(P.station_panel(stations(spark))).cache()
    features = P.feature_columns(rows)
    short = forecast.TreeSettings(rounds=7, depth=3, step=0.5)
    often, seldom = (forecast.fit_trees(rows, features, s).model.stages[-1] for s in (short, dataclasses.replace(short, checkpoint_rounds=10)))
    assert often.getCheckpointInterval() == short.checkpoint_rounds <= 4 and often.toDebugString.partition("\n")[2] == seldom.toDebugString.partition("\n")[2]
    assert short.task_rows >= 200_000
