"""Empirical-Bayes rates, the prior's strength, and exact Poisson bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.session import small_side

DEFAULT_PRIOR = 20_000.0  # pseudo-trips when too few rows tell
MIN_PRIOR_ROWS = 30
PRIOR_RANGE = (1_000.0, 100_000.0)
MIN_SIGNAL_ROWS = 10


def moment_columns(count: str, exposure: str) -> list[Column]:
    """Aggregates: mean and sample variance of the rates, mean exposure, rows used, sums of all rows."""
    usable = (F.col(exposure) > 0) & (F.col(count) >= 0)
    rate = F.when(usable, F.col(count) / F.nullif(F.col(exposure), F.lit(0)))
    return [
        F.count(F.when(usable, 1)).alias("rows_used"),
        F.avg(rate).alias("mean_rate"),
        F.var_samp(rate).alias("var_rate"),
        F.avg(F.when(usable, F.col(exposure))).alias("mean_exposure"),
        F.sum(count).alias("total_count"),
        F.sum(exposure).alias("total_exposure"),
    ]


def prior_moments(df: DataFrame, groups: Sequence[str], count: str, exposure: str) -> DataFrame:
    return df.groupBy(*groups).agg(*moment_columns(count, exposure))


def prior_strength(rows: Column, mean_rate: Column, var_rate: Column, mean_exposure: Column) -> Column:
    """Method-of-moments pseudo-trips within 1,000..100,000; 20,000 on fewer than 30 rows."""
    real_variance = F.greatest(var_rate - mean_rate / mean_exposure, F.lit(1e-10))
    lo, hi = PRIOR_RANGE
    fitted = F.greatest(F.lit(lo), F.least(F.lit(hi), mean_rate * mean_rate / real_variance))
    return F.when(rows < MIN_PRIOR_ROWS, F.lit(DEFAULT_PRIOR)).otherwise(fitted)


def prior_columns(m_prior: float | None = None) -> list[Column]:
    """From a row of moments: baseline rate per trip and prior strength (fitted unless given)."""
    strength = (
        F.lit(float(m_prior))
        if m_prior is not None
        else prior_strength(*[F.col(c) for c in ("rows_used", "mean_rate", "var_rate", "mean_exposure")])
    )
    baseline = F.when(F.col("total_exposure") > 0, F.col("total_count") / F.nullif(F.col("total_exposure"), F.lit(0)))
    return [baseline.alias("baseline_rate"), strength.alias("prior_trips")]


def group_prior(
    df: DataFrame, groups: Sequence[str], count: str, exposure: str, m_prior: float | None = None
) -> DataFrame:
    return prior_moments(df, groups, count, exposure).select(*groups, *prior_columns(m_prior))


def eb_rate(count: Column, exposure: Column, baseline: Column, prior_trips: Column) -> Column:
    """Posterior mean rate per trip: shrinks towards the baseline by the prior's pseudo-trips."""
    return (count + baseline * prior_trips) / (exposure + prior_trips)


def signal_column(rate: str, exposure: str, min_trips: int, min_rows: int = MIN_SIGNAL_ROWS) -> Column:
    """Aggregate: whether rates differ among the rows with enough trips, of which there must be ``min_rows``.

    "More than one distinct rate" is minimum below maximum, so no distinct set is built.
    """
    enough = F.col(exposure) >= min_trips
    seen = F.when(enough, F.col(rate))
    signal = (F.count(F.when(enough, 1)) >= min_rows) & F.coalesce(F.min(seen) < F.max(seen), F.lit(False))
    return signal.alias("risk_proxy_available")


def risk_signal(df: DataFrame, groups: Sequence[str], rate: str, exposure: str, min_trips: int) -> DataFrame:
    return df.groupBy(*groups).agg(signal_column(rate, exposure, min_trips))


# --- exact Poisson bounds --------------------------------------------------
def poisson_cdf(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X <= k) for Poisson means, by the shorter tail's series around the mode."""
    k, mean = np.asarray(k, float), np.asarray(mean, float)
    safe = np.maximum(mean, 1e-300)
    log_factorial = np.vectorize(math.lgamma, otypes=[float])(k + 1)
    at_k = np.exp(k * np.log(safe) - safe - log_factorial)
    # lower tail p(k) + p(k-1) + ... when k is below the mean, else the upper tail p(k+1) + ...
    below = k < safe
    term, total, step = at_k.copy(), np.where(below, at_k, 0.0), 0
    live = np.ones(k.shape, bool)
    while live.any():
        factor = np.where(below, np.maximum(k - step, 0.0) / safe, safe / (k + step + 1))
        term = np.where(live, term * factor, 0.0)
        total += term
        live = term > 1e-18 * np.maximum(total, 1e-300)
        step += 1
    return np.where(below, total, 1.0 - total)


def poisson_bounds(k: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact two-sided bounds of a Poisson mean given the count, by bisection."""
    k = np.asarray(k, float)

    def solve(count: np.ndarray, target: float) -> np.ndarray:
        lo = np.zeros(count.shape)
        hi = count + 1.0 + 12.0 * np.sqrt(count + 1.0) - 2.0 * math.log(min(alpha, 0.5))
        for _ in range(200):
            mid = (lo + hi) / 2
            if np.all((mid <= lo) | (mid >= hi)):
                break
            high = poisson_cdf(count, mid) > target  # the cdf falls as the mean rises
            lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
        return (lo + hi) / 2

    lower = np.where(k > 0, solve(np.maximum(k - 1, 0), 1 - alpha / 2), 0.0)
    return lower, solve(k, alpha / 2)


def bounds_table(counts: DataFrame, count: str, alpha: float = 0.05) -> DataFrame:
    """Bounds of the mean for every distinct count (``_k, _low, _high``), solved in parallel."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = poisson_bounds(batch["_k"].to_numpy(), alpha)
            yield pd.DataFrame({"_k": batch["_k"], "_low": low, "_high": high})

    distinct = counts.select(F.col(count).cast("long").alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return small_side(distinct.mapInPandas(solve, "_k long, _low double, _high double"))


def with_poisson_interval(
    df: DataFrame,
    count: str,
    exposure: str,
    alpha: float = 0.05,
    prefix: str = "risk_rate_ci",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Add the exact interval of the rate per 100,000 trips (null without exposure).

    Bounds depend on the count alone, so they are solved once per distinct count.
    ``bounds`` may be given where the counts are stored already.
    """
    if bounds is None:
        bounds = bounds_table(df, count, alpha)
    joined = df.withColumn("_k", F.col(count).cast("long")).join(bounds, "_k", "left")
    return joined.withColumns(
        {
            f"{prefix}_low": F.when(F.col(exposure) > 0, X.per_100k(F.col("_low"), F.col(exposure))),
            f"{prefix}_high": F.when(F.col(exposure) > 0, X.per_100k(F.col("_high"), F.col(exposure))),
        }
    ).drop("_k", "_low", "_high")
