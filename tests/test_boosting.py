"""Boosted trees beside Spark ML's own, whatever the blocks, and the jobs that fits take."""

import uuid

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wayrisk.operators import boosting
from wayrisk.plans import forecast

NAMES = ["a", "b", "c"]
EXACT = forecast.TreeSettings(rounds=5, depth=4, step=0.3, subsample=1.0, features="all")


def rows(spark, n=3000, parts=4):
    """Few distinct values a feature, so that both trainers know all of them as bounds."""
    df = spark.range(0, n, 1, parts).withColumns(
        {
            "a": (F.col("id") * 7 % 30).cast("double"),
            "b": (F.col("id") * 13 % 11).cast("double") / 4,
            "c": (F.floor(F.col("id") / 9) % 2).cast("double"),
        }
    )
    wave = F.col("a") * F.col("b") + F.pow("a", 2) / 7 - 3 * F.col("c") * F.col("b") + F.sin(F.col("id") * 1.7) * 2
    return df.withColumn("y_label", F.greatest(wave, F.lit(0.0)))


def ml(df, settings):
    wide = VectorAssembler(inputCols=NAMES, outputCol="_features").transform(df)
    return GBTRegressor(
        featuresCol="_features", labelCol="y_label", predictionCol="_prediction", maxIter=settings.rounds, stepSize=settings.step,
        maxDepth=settings.depth, subsamplingRate=settings.subsample, featureSubsetStrategy=settings.features, seed=settings.seed,
    ).fit(wide)


def predictions(model, df):
    wide = VectorAssembler(inputCols=NAMES, outputCol="_features").transform(df)
    return [r[0] for r in model.transform(wide).orderBy("id").select("_prediction").collect()]


def test_trees_are_those_of_spark_ml(spark):
    df = rows(spark).cache()
    own, other = forecast.fit_trees(df, NAMES, EXACT).model.stages[-1], ml(df, EXACT)
    assert predictions(own, df) == pytest.approx(predictions(other, df), abs=1e-9)
    assert own.treeWeights == other.treeWeights and [t.numNodes for t in own.trees] == [t.numNodes for t in other.trees]
    assert own.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray(), abs=1e-9)


def test_drawn_rows_and_features_fit_as_well(spark):
    df = rows(spark).cache()
    drawn = forecast.TreeSettings(rounds=20, depth=4, step=0.1, subsample=0.7, features="0.6")
    off = lambda m: np.abs(np.array(predictions(m, df)) - np.array(label)).mean()
    label = [r[0] for r in df.orderBy("id").select("y_label").collect()]
    own, other = off(forecast.fit_trees(df, NAMES, drawn).model.stages[-1]), off(ml(df, drawn))
    assert own < 1.3 * other


@pytest.mark.parametrize("parts, least, most", [(1, 100, 256), (7, 50, 256), (7, 50, 1)])
def test_blocks_and_partitions_do_not_matter(spark, monkeypatch, parts, least, most):
    whole = forecast.fit_trees(rows(spark), NAMES, EXACT).model.stages[-1]
    monkeypatch.setattr(boosting, "LEAST_BLOCK_ROWS", least)
    monkeypatch.setattr(boosting, "MOST_PARTS", most)
    cut = forecast.fit_trees(rows(spark, parts=parts), NAMES, EXACT).model.stages[-1]
    assert predictions(cut, rows(spark)) == pytest.approx(predictions(whole, rows(spark)), abs=1e-9)


def test_levels_beyond_the_memory_take_more_jobs_and_the_same_trees(spark):
    df = rows(spark).select(*NAMES, F.col("y_label").alias("y")).cache()
    some = dict(rounds=3, step=0.3, depth=5, subsample=1.0, strategy="all", seed=1, task_rows=1_000, store_rounds=2)
    wide, narrow = boosting.grow([df], memory_mb=64, **some)[0], boosting.grow([df], memory_mb=0, **some)[0]
    for x, y in zip(wide.trees, narrow.trees):
        assert (x.feature == y.feature).all() and (x.cut == y.cut).all() and x.total == pytest.approx(y.total)


def jobs(spark, step):
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        step()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_fits_side_by_side_share_the_jobs_of_a_level(spark):
    """Six months' fits take the jobs of one, set-up and result of each aside."""
    df = rows(spark, 6000).withColumns({"label_date_index": (F.col("id") % 12).cast("int"), "station_mean": F.col("a"), "has_y_trips": F.lit(1.0)})
    df = df.withColumns({"baseline_lag1_pred": F.lit(1.0)}).cache()
    df.count()
    found = {}

    def run(rounds):
        found[rounds] = forecast.backtest_months(df, forecast.TreeSettings(rounds=rounds, depth=3, checkpoint_rounds=99))

    few, many = jobs(spark, lambda: run(2)), jobs(spark, lambda: run(12))
    assert many - few <= 10 * 3 + 4
    assert [m["test_rows"] for m in found[12]] == [500] * 6 and [m["train_rows"] for m in found[12]] == [500 * k for k in range(6, 12)]


def test_early_stopping_keeps_the_first_trees(spark):
    df = rows(spark).cache()
    settings = forecast.TreeSettings(rounds=12, depth=3, step=0.9, patience=1, subsample=0.5)
    val = rows(spark, 300).withColumn("y_label", F.lit(3.0))
    fitted, whole = forecast.fit_trees(df, NAMES, settings, val), forecast.fit_trees(df, NAMES, settings)
    assert fitted.rounds < 12 == len(fitted.validation_errors)
    assert [t.toDebugString.partition("\n")[2] for t in fitted.model.stages[-1].trees] == [
        t.toDebugString.partition("\n")[2] for t in whole.model.stages[-1].trees[: fitted.rounds]
    ]


def test_blocks_without_a_drawn_row_and_trees_without_a_split(spark):
    one = spark.createDataFrame([(0, 1.0, 2.0, 0.0, 5.0)], "id long, a double, b double, c double, y_label double")
    assert predictions(forecast.fit_trees(one, NAMES, EXACT).model.stages[-1], one) == pytest.approx([5.0])
    rare = forecast.TreeSettings(rounds=4, depth=3, subsample=0.01)
    model = forecast.fit_trees(rows(spark, 40), NAMES, rare).model.stages[-1]
    assert all(np.isfinite(predictions(model, rows(spark, 40))))
    with pytest.raises(ValueError, match="no rows"):
        forecast.fit_trees(one.where("false"), NAMES, EXACT)
    with pytest.raises(Exception, match="null or NaN"):
        forecast.fit_trees(one.withColumn("y_label", F.lit(float("nan"))), NAMES, EXACT)


def test_bounds_of_bins():
    assert boosting.thresholds(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert boosting.thresholds(np.ones(5)).tolist() == []
    many = boosting.thresholds(np.arange(1000.0))
    assert len(many) == boosting.BINS - 1 and np.diff(np.searchsorted(many, np.arange(1000.0))).sum() == boosting.BINS - 1
    assert [boosting.features_a_node(s, 18) for s in ("0.8", "all", "sqrt", "onethird", "5", "40", "1.0")] == [15, 18, 5, 6, 5, 18, 18]
