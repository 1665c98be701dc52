"""Monthly station demand: time splits, boosted trees per mode, backtest, future months."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.functions.params import check_months, month_index, year_month
from wayrisk.operators import boosting
from wayrisk.operators import panel as P
from wayrisk.session import stored, together

PREDICTION_COLUMNS = [
    "mode",
    "station_id",
    "start_station_name",
    "station_lng",
    "station_lat",
    "feature_year",
    "feature_month",
    "date_index",
    "label_date_index",
    "label_year",
    "label_month",
    "y_true_next_month",
    "y_pred_next_month",
    "baseline_lag1_pred",
    "baseline_lag12_pred",
    "split",
]
WRITTEN_SPLITS = {"test": ["test"], "valtest": ["val", "test"], "all": ["train", "val", "test"]}


@dataclass(frozen=True)
class TreeSettings:
    """Boosted-tree settings; the defaults aim at the task, not at another library's trees.

    ``patience``: rounds without a smaller validation error after which boosting is over; the model
    ends with the best round.  It holds where a validation split exists; None takes all rounds.
    ``task_rows`` is what one task of a fit reads, ``node_memory_mb`` what the statistics of the nodes
    of a level may take, so that a level is one job.  Every ``checkpoint_rounds`` rounds the running
    residuals are stored: until then each task of a round carries the trees of the rounds since.
    """

    rounds: int = 100
    step: float = 0.05
    depth: int = 8
    subsample: float = 0.8
    features: str = "0.8"
    seed: int = 42
    log1p: bool = False
    patience: int | None = 20
    task_rows: int = 1_000_000
    node_memory_mb: int = 1024
    checkpoint_rounds: int = 3


@dataclass(frozen=True)
class SplitPlan:
    """Which label months are validation and test; everything before is training."""

    kind: str
    val_months: int
    test_months: int
    label_months: int
    val_from: int | None = field(default=None)
    test_from: int | None = field(default=None)


def plan_split(label_months: Sequence[int], val: int = 1, test: int = 1) -> SplitPlan:
    """As asked where two months remain to train on; else one test month and, from three on, one val month."""
    months = sorted(set(label_months))
    n = len(months)
    if n >= val + test + 2:
        kind = "normal"
    else:
        kind, test, val = "degraded", int(n >= 2), int(n >= 3)
    return SplitPlan(
        kind,
        val if test else 0,
        test,
        n,
        val_from=months[-(test + val)] if test and val else None,
        test_from=months[-test] if test else None,
    )


def with_split(df: DataFrame, plan: SplitPlan) -> DataFrame:
    at = F.col("label_date_index")
    label = F.lit("train")
    if plan.val_from is not None:
        label = F.when(at >= plan.val_from, "val").otherwise(label)
    if plan.test_from is not None:
        label = F.when(at >= plan.test_from, "test").otherwise(label)
    return df.withColumn("split", label)


def labelled_rows(panel: DataFrame, horizon: int = 1, past_only: bool = False, calendar: bool = False) -> DataFrame:
    """Feature rows that have a label, with baselines, features cleaned."""
    df = P.panel_features(panel, horizon, past_only, calendar)
    df = P.with_baselines(df.where(F.col("y_label").isNotNull()))
    return P.clean_features(df, P.feature_columns(df))


def _label_months(df: DataFrame) -> list[int]:
    # distinct months of the data: a few hundred at most
    return sorted(r[0] for r in df.select("label_date_index").distinct().collect())


def best_round(errors: Sequence[float], patience: int) -> int:
    """Rounds up to the least error that was met before ``patience`` rounds brought no smaller one."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


@dataclass
class Fit:
    """A fitted pipeline, its rounds, and the mean absolute validation error (of the target) after each round tried."""

    model: PipelineModel
    rounds: int
    validation_errors: list[float] = field(default_factory=list)


def _target(settings: TreeSettings) -> Column:
    y = F.log1p(F.greatest(F.col("y_label"), F.lit(0.0))) if settings.log1p else F.col("y_label")
    return y.cast("double").alias("_target")


def _grown(trains: Sequence[DataFrame], features: Sequence[str], settings: TreeSettings) -> list[boosting.Grown]:
    return boosting.grow(
        [train.select(*[F.col(c).cast("double") for c in features], _target(settings)) for train in trains],
        rounds=settings.rounds,
        step=settings.step,
        depth=settings.depth,
        subsample=settings.subsample,
        strategy=settings.features,
        seed=settings.seed,
        task_rows=settings.task_rows,
        memory_mb=settings.node_memory_mb,
        store_rounds=settings.checkpoint_rounds,
    )


def _as_model(spark, grown: boosting.Grown, settings: TreeSettings) -> GBTRegressionModel:
    estimator = GBTRegressor(
        featuresCol="_features",
        labelCol="_target",
        predictionCol="_prediction",
        maxIter=len(grown.trees),
        stepSize=settings.step,
        maxDepth=settings.depth,
        subsamplingRate=settings.subsample,
        featureSubsetStrategy=settings.features,
        seed=settings.seed,
        maxMemoryInMB=settings.node_memory_mb,
        checkpointInterval=settings.checkpoint_rounds,
    )
    return boosting.as_model(spark, grown, estimator)


def fit_side_by_side(trains: Sequence[DataFrame], features: Sequence[str], settings: TreeSettings) -> list[Fit]:
    """A fit of all rounds for every training table, grown by the same jobs."""
    assembler, spark = VectorAssembler(inputCols=list(features), outputCol="_features"), trains[0].sparkSession
    models = together(spark, [partial(_as_model, spark, g, settings) for g in _grown(trains, features, settings)])
    return [Fit(PipelineModel([assembler, m]), settings.rounds) for m in models]


def fit_trees(train: DataFrame, features: Sequence[str], settings: TreeSettings, val: DataFrame | None = None) -> Fit:
    """Fit on ``y_label``; with validation rows and patience these decide how many rounds count.

    Trees do not depend on how many follow, so what fewer rounds give is the best prefix of all.
    """
    (fitted,), spark = _grown([train], features, settings), train.sparkSession
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    trees, errors, rounds = _as_model(spark, fitted, settings), [], settings.rounds
    if settings.patience is not None and val is not None:
        checks = assembler.transform(val.select(*features, _target(settings))).select("_features", "_target").persist()
        try:
            if not checks.isEmpty():
                errors = list(trees.evaluateEachIteration(checks, "absolute"))
                rounds = best_round(errors, settings.patience)
                if rounds < settings.rounds:
                    trees = _as_model(spark, boosting.Grown(fitted.trees[:rounds], fitted.cuts), settings)
        finally:
            checks.unpersist()
    return Fit(PipelineModel([assembler, trees]), rounds, errors)


def predicted(settings: TreeSettings) -> Column:
    p = F.expm1("_prediction") if settings.log1p else F.col("_prediction")
    return F.greatest(p, F.lit(0.0))


def _predict(model: PipelineModel, rows: DataFrame, settings: TreeSettings) -> DataFrame:
    return model.transform(rows).withColumn("y_pred_next_month", predicted(settings)).drop("_features", "_prediction")


def prediction_table(scored: DataFrame, splits: Iterable[str]) -> DataFrame:
    return (
        scored.where(F.col("split").isin(list(splits)))
        .withColumns(
            {
                "label_year": X.year_of(F.col("label_date_index")),
                "label_month": X.month_of(F.col("label_date_index")),
                "y_true_next_month": F.col("y_label"),
            }
        )
        .withColumnsRenamed({"year": "feature_year", "month": "feature_month"})
        .select(*PREDICTION_COLUMNS)
    )


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, (float(w) for w in weights)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def backtest_months(rows: DataFrame, settings: TreeSettings, months: int = 6) -> list[dict[str, float]]:
    """Rolling origin over the last label months of one mode: train strictly before, test on the month.

    The months' fits are independent and grow side by side.
    """
    features, at = P.feature_columns(rows), F.col("label_date_index")
    tested = _label_months(rows)[-months:]
    if not tested:
        return []
    before = [rows.where(at < m) for m in tested]

    def one(k: int, month: int, fitted: Fit) -> dict[str, float]:
        y, p = F.col("y_label"), F.col("y_pred_next_month")
        found = _predict(fitted.model, rows.where(at == month), settings).agg(
            P.mae(y, p).alias("mae"), P.smape(y, p).alias("smape"), F.count(F.lit(1)).alias("test_rows")
        )
        return {"label_date_index": month, "train_rows": before[k].count(), **found.first().asDict()}

    fits = fit_side_by_side(before, features, settings)
    return together(rows.sparkSession, [partial(one, k, m, f) for k, (m, f) in enumerate(zip(tested, fits, strict=True))])


def backtest_summary(by_month: DataFrame) -> DataFrame:
    """Mean and population deviation of the months' errors (``mode, mae, smape``), by mode."""
    parts = [F.count(F.lit(1)).cast("double").alias("backtest_months")]
    for name in ("mae", "smape"):
        parts += [F.avg(name).alias(f"backtest_{name}_mean"), F.stddev_pop(name).alias(f"backtest_{name}_std")]
    return by_month.groupBy("mode").agg(*parts)


def backtest(rows: DataFrame, settings: TreeSettings, months: int = 6) -> dict[str, float]:
    """Errors of ``backtest_months`` in short; with too few label months only the reason."""
    if months <= 0:
        return {}
    n = len(_label_months(rows))
    if n < months + 3:
        return {"backtest_skipped": 1.0, "backtest_reason": float(n)}
    found = [("", m["mae"], m["smape"]) for m in backtest_months(rows, settings, months)]
    table = rows.sparkSession.createDataFrame(found, "mode string, mae double, smape double")
    return {k: v for k, v in backtest_summary(table).first().asDict().items() if k != "mode"}


@dataclass
class ModeResult:
    mode: str
    metrics: dict[str, object]
    predictions: DataFrame | None
    importance: DataFrame


def evaluate_mode(
    rows: DataFrame,
    mode: str,
    settings: TreeSettings,
    val_months: int = 1,
    test_months: int = 1,
    backtest_months: int = 6,
    write_splits: str = "test",
) -> ModeResult:
    """Fit one mode's rows, predict its splits and measure the test split."""
    features = P.feature_columns(rows)
    plan = plan_split(_label_months(rows), val_months, test_months)
    split = with_split(rows, plan)
    part = lambda name: split.where(F.col("split") == name)
    fitted = fit_trees(part("train"), features, settings, part("val") if plan.val_from is not None else None)
    model = fitted.model
    sizes = {r["split"]: r for r in P.split_sizes(split).collect()}
    metrics: dict[str, object] = {
        "mode": mode,
        "model": "boosted_trees",
        "split_mode": plan.kind,
        "label_months_available": plan.label_months,
        "effective_val_months": plan.val_months,
        "effective_test_months": plan.test_months,
        **{f"rows_{s}": sizes[s]["rows"] if s in sizes else 0 for s in ("train", "val", "test")},
        **{f"stations_{s}": sizes[s]["stations"] if s in sizes else 0 for s in ("train", "test")},
        "rounds": fitted.rounds,
    }
    if fitted.validation_errors:
        metrics["validation_error"] = fitted.validation_errors[fitted.rounds - 1]
    importance = feature_importance(model, features, rows.sparkSession)
    if plan.test_from is None:
        metrics["note"] = "no test split possible; trained only"
        return ModeResult(mode, metrics, None, importance)
    scored = _predict(model, split, settings)
    test = prediction_table(scored, ["test"])
    metrics |= {k: v for k, v in P.error_table(test).first().asDict().items() if k != "mode"}
    metrics |= backtest(rows, settings, backtest_months)
    return ModeResult(mode, metrics, prediction_table(scored, WRITTEN_SPLITS[write_splits]), importance)


def forecast_demand(
    exposure: DataFrame,
    settings: TreeSettings = TreeSettings(),
    horizon: int = 1,
    val_months: int = 1,
    test_months: int = 1,
    backtest_months: int = 6,
    write_splits: str = "test",
    past_only: bool = False,
    calendar: bool = False,
) -> list[ModeResult]:
    """Evaluate every mode, side by side.  Features of all modes come from one plan, stored once."""
    rows = stored(labelled_rows(P.station_panel(exposure), horizon, past_only, calendar))
    modes = sorted(r[0] for r in rows.select("mode").distinct().collect())
    one = lambda m: evaluate_mode(
        rows.where(F.col("mode") == m), m, settings, val_months, test_months, backtest_months, write_splits
    )
    return together(exposure.sparkSession, [partial(one, m) for m in modes])


METRIC_GROUPS = ("split", "rows", "stations", "test", "backtest", "fit")


def metrics_table(spark, results: Sequence[ModeResult]) -> DataFrame:
    """One row a mode: the model's name and note, and its figures in groups, as they are written as nested JSON."""

    def group(name: str) -> str:
        first = name.split("_")[0]
        if first in ("rows", "stations", "backtest"):
            return first
        if first in ("mae", "smape"):
            return "test"
        return "fit" if name in ("rounds", "validation_error") else "split"

    rows = []
    for r in results:
        own = {g: {} for g in METRIC_GROUPS}
        for name, value in r.metrics.items():
            if name not in ("mode", "model", "note", "split_mode") and value is not None:
                own[group(name)][name] = float(value)
        rows.append((r.mode, r.metrics["model"], r.metrics.get("note"), r.metrics["split_mode"], *[own[g] for g in METRIC_GROUPS]))
    groups = ", ".join(f"{g} map<string, double>" for g in METRIC_GROUPS)
    return spark.createDataFrame(rows, f"mode string, model string, note string, split_mode string, {groups}")


def all_predictions(results: Sequence[ModeResult]) -> DataFrame | None:
    frames = [r.predictions for r in results if r.predictions is not None]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- future ----------------------------------------------------------------
_DEEPEST = max(P.LAGS)


def _state_features(row_month: int) -> dict[str, Column]:
    """Features of the current row from ``_past``: the station's earlier values, latest first."""
    past = F.col("_past")
    cols: dict[str, Column] = {f"y_trips_lag_{k}": F.get(past, F.lit(k - 1)) for k in P.LAGS}
    for n in P.ROLLING:
        recent = F.slice(past, 1, n)
        size = F.size(recent)
        total = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x)
        mean = total / F.nullif(size, F.lit(0))
        squares = F.aggregate(recent, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        cols[f"y_trips_rollmean_{n}"] = mean
        cols[f"y_trips_rollstd_{n}"] = F.when(size > 1, F.sqrt(squares / F.nullif(size - 1, F.lit(0))))
    cols["month"] = F.lit(row_month)
    return cols


def forecast_future(
    exposure: DataFrame,
    months: Sequence[int],
    years_ahead: int = 1,
    settings: TreeSettings = TreeSettings(),
    store_every: int = 4,
) -> DataFrame:
    """Predict month by month beyond the data, feeding predictions back as history.

    Stations with a row in the mode's last month go on.  Each station carries its last
    twelve values in an array, so a step is a projection: no window, no shuffle, and no
    growing history.  Output: the requested months of ``last year + years_ahead``.
    """
    check_months(months)
    if not months:
        raise ValueError("name the months to forecast")
    panel = P.filled_history(P.with_station_means(P.station_panel(exposure)))
    w = P._months_of_station()
    rows = P.with_history(P.with_season(panel), y="y_work").withColumns(
        {
            "y_label": F.lead("y_work", 1).over(w),
            "_past": F.reverse(F.collect_list(F.coalesce("y_work", F.lit(0.0))).over(w.rowsBetween(-_DEEPEST, -1))),
        }
    )
    features = [c for c in P.BASE_FEATURES if c in rows.columns]
    rows = stored(rows)
    last_months = {r[0]: r[1] for r in rows.groupBy("mode").agg(F.max("date_index")).collect()}
    labelled = P.clean_features(rows.where(F.col("y_label").isNotNull()), features)
    fits = [partial(fit_trees, labelled.where(F.col("mode") == m), features, settings) for m in sorted(last_months)]
    models = dict(zip(sorted(last_months), together(exposure.sparkSession, fits), strict=True))
    out = None
    for mode, last in sorted(last_months.items()):
        mine = rows.where(F.col("mode") == mode)
        model = models[mode].model
        target_year = year_month(last)[0] + years_ahead
        wanted = {month_index(target_year, m) for m in months}
        state = mine.where(F.col("date_index") == last).select(
            "mode", "station_id", "start_station_name", "station_lat", "station_lng",
            "station_mean", "station_month_mean", "has_y_trips", "_past",
            F.coalesce("y_work", F.lit(0.0)).alias("y_work"),
            F.struct("station_lat", "station_lng").alias("_place"),
        )
        for step, at in enumerate(range(last, max(wanted)), start=1):
            (year, month), (next_year, next_month) = year_month(at), year_month(at + 1)
            current = P.clean_features(P.with_season(state.withColumns(_state_features(month))), features)
            stepped = _predict(model, current, settings)
            carried = stepped.select(
                "mode", "station_id", "start_station_name", "_place.station_lat", "_place.station_lng",
                "station_mean", "station_month_mean", "_place",
                F.lit(0).alias("has_y_trips"),
                F.slice(F.concat(F.array("y_work"), "_past"), 1, _DEEPEST).alias("_past"),
                F.col("y_pred_next_month").alias("y_work"),
            )
            if step % store_every == 0 or at + 1 in wanted:
                carried = stored(carried)
            state = carried
            if at + 1 in wanted:
                made = state.select(
                    "mode", "station_id", "start_station_name", "station_lng", "station_lat",
                    F.lit(next_year).alias("label_year"),
                    F.lit(next_month).alias("label_month"),
                    F.lit(at + 1).alias("label_date_index"),
                    F.lit(year).alias("feature_year"),
                    F.lit(month).alias("feature_month"),
                    F.col("y_work").alias("y_pred_next_month"),
                    F.lit("future").alias("split"),
                )
                out = made if out is None else out.unionByName(made)
    return out
