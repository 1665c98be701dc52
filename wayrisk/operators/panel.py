"""Station-month panel: labels, lags, past-only rolling figures, baselines, error measures.

Windows run per station over its months; a station has at most one row per month, so
a window never holds more than the months of the data, however many trips there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.functions import expr as X

PANEL_KEY = ["mode", "station_id"]
LAGS = (1, 2, 3, 12)
ROLLING = (3, 6)
COMPONENTS = ("start_trips", "end_trips", "touchpoints")
BASE_FEATURES = [
    "month_sin",
    "month_cos",
    "station_mean",
    "station_month_mean",
    "has_y_trips",
    *[f"y_trips_lag_{k}" for k in LAGS],
    *[f"y_trips_rollmean_{n}" for n in ROLLING],
    *[f"y_trips_rollstd_{n}" for n in ROLLING],
    "station_lat",
    "station_lng",
]


def station_panel(exposure: DataFrame) -> DataFrame:
    """Typed panel rows, one per station and month, from a station-exposure table under either naming.

    A station that has several names in a month has one row: the sums, mean coordinates, and
    the last name by alphabet.
    """
    names = {"start_station_id": "station_id", "trips": "y_trips"}
    for old, new in names.items():
        if new not in exposure.columns and old in exposure.columns:
            exposure = exposure.withColumnRenamed(old, new)
    absent = {
        c: F.lit(None).cast(kind)
        for c, kind in (("start_station_name", "string"), ("station_lat", "double"), ("station_lng", "double"))
        if c not in exposure.columns
    }
    df = exposure.withColumns(absent) if absent else exposure
    parts = [c for c in COMPONENTS if c in df.columns]
    df = df.select(
        "mode",
        F.col("station_id").cast("string").alias("station_id"),
        F.coalesce("start_station_name", F.lit("")).alias("start_station_name"),
        X.number("year").cast("int").alias("year"),
        X.number("month").cast("int").alias("month"),
        X.number("y_trips").alias("y_trips"),
        X.number("station_lat").alias("station_lat"),
        X.number("station_lng").alias("station_lng"),
        *[X.number(c).alias(c) for c in parts],
    ).dropna(subset=["mode", "station_id", "year", "month"])
    df = df.groupBy("mode", "station_id", "year", "month").agg(
        F.max("start_station_name").alias("start_station_name"),
        F.sum("y_trips").alias("y_trips"),
        F.avg("station_lat").alias("station_lat"),
        F.avg("station_lng").alias("station_lng"),
        *[F.sum(c).alias(c) for c in parts],
    )
    return df.withColumn("date_index", X.month_no(F.col("year"), F.col("month")))


def _months_of_station() -> W:
    return W.partitionBy(*PANEL_KEY).orderBy("date_index", "start_station_name")


def with_label(panel: DataFrame, horizon: int = 1, y: str = "y_trips", calendar: bool = False) -> DataFrame:
    """Label = the station's value ``horizon`` rows later.

    ``calendar=True`` takes the value of exactly ``horizon`` months later instead,
    null where that month is missing.
    """
    w = _months_of_station()
    at = F.col("date_index") + horizon
    label = F.lead(y, horizon).over(w)
    if calendar:
        # the wanted month is at most ``horizon`` rows ahead, as months do not repeat
        ahead = [
            F.when(F.lead("date_index", k).over(w) == at, F.lead(y, k).over(w)) for k in range(1, horizon + 1)
        ]
        label = F.coalesce(*ahead)
    return panel.withColumns({"label_date_index": at, "y_label": label})


def with_season(df: DataFrame) -> DataFrame:
    turn = F.col("month") * F.lit(2.0 * math.pi) / 12.0
    return df.withColumns({"month_sin": F.sin(turn), "month_cos": F.cos(turn)})


def with_station_means(df: DataFrame, past_only: bool = False) -> DataFrame:
    """Mean of the station and of the station in this calendar month.

    The means cover the whole history, later months too; ``past_only`` stops before
    the row itself.
    """
    station, month = W.partitionBy(*PANEL_KEY), W.partitionBy(*PANEL_KEY, "month")
    if past_only:
        station, month = (
            w.orderBy("date_index").rowsBetween(W.unboundedPreceding, -1) for w in (station, month)
        )
    mean = F.avg("y_trips").over(station)
    return df.withColumns(
        {
            "station_mean": mean,
            "station_month_mean": F.coalesce(F.avg("y_trips").over(month), mean),
            "has_y_trips": F.col("y_trips").isNotNull().cast("int"),
        }
    )


def with_history(df: DataFrame, y: str = "y_trips") -> DataFrame:
    """Lags by row order and rolling mean and sample deviation of the rows before."""
    w = _months_of_station()
    cols: dict[str, Column] = {f"y_trips_lag_{k}": F.lag(y, k).over(w) for k in LAGS}
    for n in ROLLING:
        before = w.rowsBetween(-n, -1)
        cols[f"y_trips_rollmean_{n}"] = F.avg(y).over(before)
        cols[f"y_trips_rollstd_{n}"] = F.stddev_samp(y).over(before)
    return df.withColumns(cols)


def with_component_lags(df: DataFrame) -> DataFrame:
    w = _months_of_station()
    return df.withColumns({f"{c}_lag_1": F.lag(c, 1).over(w) for c in COMPONENTS if c in df.columns})


def panel_features(panel: DataFrame, horizon: int = 1, past_only: bool = False, calendar: bool = False) -> DataFrame:
    """All features and the label; one shuffle by station serves every window."""
    df = with_label(panel, horizon, calendar=calendar)
    return with_component_lags(with_history(with_station_means(with_season(df), past_only)))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in BASE_FEATURES if c in df.columns] + [
        f"{c}_lag_1" for c in COMPONENTS if f"{c}_lag_1" in df.columns
    ]


def clean_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and infinite features become 0."""
    return df.withColumns({c: F.coalesce(X.finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def with_baselines(df: DataFrame) -> DataFrame:
    """Naive forecasts: the last value, and the value twelve rows back (else the last)."""
    one, twelve = F.col("y_trips_lag_1"), F.col("y_trips_lag_12")
    return df.withColumns(
        {
            "baseline_lag1_pred": F.coalesce(one, F.lit(0.0)),
            "baseline_lag12_pred": F.coalesce(twelve, one, F.lit(0.0)),
        }
    )


def filled_history(df: DataFrame) -> DataFrame:
    """``y_work``: the observed value, else the station's mean of that calendar month."""
    return df.withColumn("y_work", F.coalesce("y_trips", "station_month_mean"))


def latest_rows(df: DataFrame, key: Sequence[str] = tuple(PANEL_KEY), order: Sequence[str] = ("date_index",)) -> DataFrame:
    """Last row of every key, by an aggregate (no sort of the key's rows)."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def smape(y: Column, p: Column, eps: float = 1e-6) -> Column:
    """Mean of |p - y| over the mean of |y| and |p|, as a fraction."""
    return F.avg(F.abs(p - y) / F.greatest((F.abs(y) + F.abs(p)) / 2.0, F.lit(eps)))


def error_table(predictions: DataFrame, by: Sequence[str] = ("mode",)) -> DataFrame:
    """Errors of the model and both baselines, and how much the model gains on them."""
    y = F.col("y_true_next_month")
    measures = {}
    for name, col in (("baseline_lag1", "baseline_lag1_pred"), ("baseline_lag12", "baseline_lag12_pred"), ("model", "y_pred_next_month")):
        if col in predictions.columns:
            measures[f"mae_{name}"] = mae(y, F.col(col))
            measures[f"smape_{name}"] = smape(y, F.col(col))
    out = predictions.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])
    if "mae_model" not in measures:
        return out

    def gain(base: str) -> Column:
        return (F.col(base) - F.col("mae_model")) * 100.0 / F.greatest(F.col(base), F.lit(1e-9))

    return out.withColumns(
        {
            "mae_improvement_vs_lag1_pct": gain("mae_baseline_lag1"),
            "mae_improvement_vs_lag12_pct": gain("mae_baseline_lag12"),
        }
    )


def split_sizes(split: DataFrame, by: Sequence[str] = ("mode",)) -> DataFrame:
    return split.groupBy(*by, "split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("station_id").alias("stations")
    )
