"""Semantics on small frames, worked out by hand or by brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.operators import clusters, filters, ordering, proximity, shares, stats, usage
from wayrisk.schemas import EARTH_RADIUS_M


def metres(lat1, lng1, lat2, lng2):
    lat1, lng1, lat2, lng2 = map(math.radians, (lat1, lng1, lat2, lng2))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


# --- radius join -------------------------------------------------------------
@pytest.mark.parametrize("salt_points", [3, 200_000])
@pytest.mark.parametrize("centre", [(40.7, -74.0), (69.3, 179.995), (-33.0, 18.0)])
def test_radius_counts_match_brute_force(spark, centre, salt_points):
    rng = random.Random(7)
    spot = lambda spread: (
        centre[0] + rng.uniform(-spread, spread),
        (centre[1] + rng.uniform(-spread, spread) + 180) % 360 - 180,
    )
    stations = [(f"s{i}", *spot(0.02)) for i in range(40)]
    crashes = [spot(0.03) for _ in range(400)]
    crashes += [crashes[0]] * 200  # a third of all at one place
    s = spark.createDataFrame(stations, "id string, station_lat double, station_lng double")
    c = spark.createDataFrame(crashes, "latitude double, longitude double")
    got = {r.id: (r.crashes_within_250m, r.crashes_within_900m) for r in proximity.count_within(s, c, [250.0, 900.0], salt_points=salt_points).collect()}
    want = {
        i: tuple(sum(metres(la, lo, *p) <= r for p in crashes) for r in (250.0, 900.0)) for i, la, lo in stations
    }
    assert got == want
    assert any(v[1] for v in want.values())


def test_radius_counts_by_period_and_missing_places(spark):
    s = spark.createDataFrame(
        [("a", 2020, 40.7, -74.0), ("a", 2021, 40.7, -74.0), ("b", 2020, None, -74.0)],
        "id string, year int, station_lat double, station_lng double",
    )
    c = spark.createDataFrame([(2020, 40.7001, -74.0), (2020, 40.7, -74.0), (2022, 40.7, -74.0)], "year int, latitude double, longitude double")
    got = {(r.id, r.year): r.crashes_within_500m for r in proximity.count_within(s, c, [500.0], ["year"]).collect()}
    assert got == {("a", 2020): 2, ("a", 2021): 0}


def test_rates_need_trips(spark):
    s = spark.createDataFrame([("a", 0, 3), ("b", 200, 3), ("c", None, 1)], "id string, trips long, crashes_within_500m long")
    got = proximity.with_rates(s, [500.0, 250.0]).collect()
    assert [(r.id, r.crashes_within_500m_per_100k_trips, r.crashes_within_250m_per_100k_trips) for r in got] == [("b", 1500.0, 0.0)]


# --- order statistics --------------------------------------------------------
@pytest.mark.parametrize("sizes", [{}, {"parts": 7}])
def test_pct_rank_equals_pandas(spark, sizes):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["x", "y"], 600, p=[0.9, 0.1]),
            "k": range(600),
            "v": np.where(rng.random(600) < 0.35, 5.0, rng.integers(0, 200, 600).astype(float)),
        }
    )
    pdf.loc[::13, "v"] = None
    pdf["w"] = -pdf["v"]
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("w", -F.col("v"))
    got = ordering.with_pct_rank(df, ["g"], {"rv": "v", "rw": "w"}, ["k"], **sizes).toPandas().set_index("k").sort_index()
    for name, col in (("rv", "v"), ("rw", "w")):
        want = pdf.groupby("g")[col].rank(pct=True) * 100
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("sizes", [{}, {"parts": 5}])
def test_percentiles_equal_numpy(spark, sizes):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(301) < 0.3, 1.0, rng.normal(size=301))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordering.percentiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.9, "d": 1.0}, **sizes).first()
    np.testing.assert_allclose(list(got), np.percentile(values, [25, 50, 90, 100]), rtol=1e-12)


# --- statistics --------------------------------------------------------------
def test_poisson_bounds_known_values():
    low, high = stats.poisson_bounds(np.array([0, 3, 10]), 0.05)
    np.testing.assert_allclose(low, [0.0, 0.618672, 4.795389], atol=1e-6)
    np.testing.assert_allclose(high, [3.688879, 8.767273, 18.390356], atol=1e-6)
    # large counts: the cdf at the bounds is the tail asked for
    k = np.array([250, 100_000])
    low, high = stats.poisson_bounds(k, 0.1)
    np.testing.assert_allclose(stats.poisson_cdf(k, high), 0.05, rtol=1e-6)
    np.testing.assert_allclose(stats.poisson_cdf(k - 1, low), 0.95, rtol=1e-6)


def test_interval_holds_rate_and_needs_exposure(spark):
    df = spark.createDataFrame([(0, 100), (7, 5000), (3, 0)], "k long, e long")
    rows = {r.k: r for r in stats.with_poisson_interval(df, "k", "e").collect()}
    assert rows[0].risk_rate_ci_low == 0.0
    assert rows[7].risk_rate_ci_low < 7 / 5000 * 1e5 < rows[7].risk_rate_ci_high
    assert rows[3].risk_rate_ci_low is None and rows[3].risk_rate_ci_high is None


def test_prior_defaults_and_bounds(spark):
    few = spark.range(20).select(F.lit("m").alias("mode"), (F.col("id") + 1).alias("n"), F.lit(1).alias("k"))
    assert stats.group_prior(few, ["mode"], "k", "n").first().prior_trips == stats.DEFAULT_PRIOR
    flat = spark.range(50).select(F.lit("m").alias("mode"), F.lit(1000).alias("n"), F.lit(5).alias("k"))
    row = stats.group_prior(flat, ["mode"], "k", "n").first()
    assert row.baseline_rate == 0.005 and row.prior_trips == 100_000.0
    assert stats.group_prior(flat, ["mode"], "k", "n", m_prior=7).first().prior_trips == 7.0
    empty = spark.createDataFrame([("m", 0, 0)], "mode string, n long, k long")
    assert stats.group_prior(empty, ["mode"], "k", "n").first().baseline_rate is None


def test_signal_needs_ten_rows_and_two_rates(spark):
    def signal(rows):
        df = spark.createDataFrame(rows, "mode string, rate double, n long")
        return stats.risk_signal(df, ["mode"], "rate", "n", 10).first().risk_proxy_available

    assert not signal([("m", float(i), 20) for i in range(9)])
    assert not signal([("m", 1.0, 20) for _ in range(12)])
    assert signal([("m", float(i), 20) for i in range(10)])
    assert not signal([("m", float(i), 5) for i in range(10)] + [("m", 1.0, 20)] * 10)


# --- exposure ----------------------------------------------------------------
TRIP = (
    "mode string, year int, month int, start_station_id string, start_station_name string, start_lat string, start_lng string, "
    "end_station_id string, end_station_name string, end_lat string, end_lng string"
)


def test_exposure_drops_null_keys_and_bad_coordinates(spark):
    df = spark.createDataFrame(
        [
            ("nyc", 2020, 1, "5.10", "A", "40.0", "-74.0", "6", "B", "x", ""),
            ("nyc", 2020, 1, "6", "B", "41.0", "-73.0", "5.10", "A", "42.0", "-74.0"),
            ("nyc", 2020, 1, "7", None, "41.0", "-73.0", None, "A", "42.0", "-74.0"),
        ],
        TRIP,
    )
    rows = {r.start_station_id: r for r in usage.station_exposure(df).collect()}
    assert set(rows) == {"5.10", "6"}
    assert (rows["5.10"].start_trips, rows["5.10"].end_trips, rows["5.10"].trips) == (1, 1, 2)
    assert rows["5.10"].station_lat == 41.0
    assert rows["6"].station_lat == 41.0  # the unreadable end coordinate does not count
    assert usage.station_exposure(df, "starts").where("start_station_id = '6'").first().trips == 1


def test_lifetime_is_a_mean_of_monthly_means(spark):
    df = spark.createDataFrame(
        [("nyc", 2019, 11, "1", "A", 1, 0, 40.0, -74.0, 1, 1), ("nyc", 2020, 2, "1", "A", 9, 0, 42.0, -72.0, 9, 9), ("nyc", 2021, 2, "1", "A", 1, 1, 44.0, -70.0, 2, 2)],
        "mode string, year int, month int, start_station_id string, start_station_name string, start_trips long, end_trips long, station_lat double, station_lng double, touchpoints long, trips long",
    )
    r = usage.exposure_lifetime(df).first()
    assert (r.station_lat, r.trips, r.years_count, r.months_count) == (42.0, 12, 3, 2)
    assert (r.first_month, r.last_month, r.observation_months) == (11, 2, 16)
    assert r.temporal_coverage == "2 months spanning 2019-2021"


def test_shares_of_nothing_are_null(spark):
    df = spark.createDataFrame([("m", "weekday", 0), ("m", "weekday", 0)], "mode string, week_part string, trips long")
    assert {r.pct_within_week_part for r in shares.with_window_shares(df).collect()} == {None}


def test_single_mode(spark):
    df = spark.createDataFrame([("NYC", 1), ("jc", 2)], "mode string, trips int")
    assert filters.single_mode(df, "nyc")[1] == "nyc"
    for wanted in (None, "la"):
        with pytest.raises(ValueError):
            filters.single_mode(df, wanted)
    assert filters.single_mode(df.drop("mode"), None)[1] == "unknown"


def test_day_names_and_tiers(spark):
    df = spark.createDataFrame([(0, 0.0), (6, 33.0), (9, 66.5)], "d int, pct double")
    rows = df.select(
        X.dow_name(F.col("d")).alias("n"), X.week_part(F.col("d")).alias("w"), X.risk_tier(F.col("pct")).alias("t"),
        X.risk_tier(F.col("pct"), include_lowest=False).alias("u"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("Monday", "weekday", "Low Risk", None), ("Sunday", "weekend", "Low Risk", "Low Risk"), ("9", "weekend", "High Risk", "High Risk"),
    ]


# --- clusters ----------------------------------------------------------------
def components_by_hand(points, eps):
    ids, label = sorted(points), {}
    for start in ids:
        if start in label:
            continue
        stack, label[start] = [start], start
        while stack:
            a = stack.pop()
            for b in ids:
                if b not in label and (points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2 <= eps * eps:
                    label[b] = start
                    stack.append(b)
    return label


@pytest.mark.parametrize("n,spread", [(120, 0.1), (300, 0.03)])
def test_clusters_match_brute_force(spark, n, spread):
    rng = random.Random(n)
    points = {f"p{i:04d}": (40.7 + rng.uniform(0, spread), -74.0 + rng.uniform(0, spread)) for i in range(n)}
    points["p9998"] = points["p0000"]  # same place twice
    points["p9999"] = (50.0, 10.0)  # alone
    for i in range(60):  # a long chain: one component, many rounds
        points[f"q{i:04d}"] = (41.5 + 0.0099 * i, -74.0)
    df = spark.createDataFrame([(k, *v) for k, v in points.items()] + [("none", None, None)], "id string, station_lat double, station_lng double")
    got = {r.id: r.cluster for r in clusters.density_clusters(df, "id").collect()}
    assert got.pop("none") is None and got["p9999"] == -1
    label = components_by_hand(points, 0.01)
    sizes = pd.Series(label).value_counts()
    number = {root: i for i, root in enumerate(sorted(r for r in sizes.index if sizes[r] > 1))}
    assert got == {k: number.get(root, -1) for k, root in label.items()}


@pytest.mark.parametrize("parts", [None, 3])
def test_null_groups_and_null_keys_are_ranked(spark, parts):
    rows = [(k, None if k % 2 else "a", float(k % 5)) for k in range(20)] + [(None, "a", 9.0)]
    df = spark.createDataFrame(rows, "k int, g string, v double")
    got = ordering.with_pct_rank(df, ["g"], {"p": "v"}, ["k"], parts=parts).collect()
    assert len(got) == 21 and all(r.p is not None for r in got)
    assert [r.p for r in got if r.k is None] == [100.0]
    middle = {r.g: r.m for r in ordering.percentiles(df, ["g"], "v", {"m": 0.5}, parts=parts).collect()}
    assert middle == {None: 2.0, "a": 2.0}


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chains_settle(spark, shuffled):
    ids = random.Random(5).sample(range(2000), 2000) if shuffled else [0, *range(1999, 0, -1)]
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "_a long, _b long")
    nodes = spark.createDataFrame([(k,) for k in [*ids, 5000]], "_node long")
    roots = {r._node: r._root for r in clusters.components(nodes, links).collect()}
    assert roots.pop(5000) == 5000 and set(roots.values()) == {0} and len(roots) == 2000


def dbscan_by_hand(points, eps, least):
    near = {a: [b for b in points if (points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2 <= eps * eps] for a in points}
    cores = {a: points[a] for a in points if len(near[a]) >= least}
    label = components_by_hand(cores, eps)
    number = {root: k for k, root in enumerate(sorted(set(label.values())))}
    out = {a: number[label[a]] for a in cores}
    for a in points.keys() - cores.keys():
        found = [((points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2, b) for b in near[a] if b in cores]
        out[a] = number[label[min(found)[1]]] if found else -1
    return out


@pytest.mark.parametrize("least", [1, 3, 6, 30])
def test_dense_clusters_match_brute_force(spark, least):
    rng = random.Random(least)
    points = {f"p{i:04d}": (40.7 + rng.uniform(0, 0.12), -74.0 + rng.uniform(0, 0.12)) for i in range(260)}
    points |= {f"c{i:04d}": (40.75 + rng.gauss(0, 0.002), -73.95 + rng.gauss(0, 0.002)) for i in range(150)}  # a crowded place
    points |= {f"s{i:04d}": (40.75, -73.97) for i in range(40)} | {f"q{i:04d}": (41.5 + 0.0049 * i, -74.0) for i in range(30)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()] + [("none", None, None), (None, 40.7, -74.0)], "id string, station_lat double, station_lng double")
    got = {r.id: r.cluster for r in clusters.density_clusters(df, "id", min_samples=least).collect()}
    assert got.pop("none") is None and got.pop(None) is None
    assert got == dbscan_by_hand(points, 0.01, least)


def test_dense_clusters_of_two_and_of_nothing(spark):
    rng = random.Random(9)
    rows = [(i, 40 + rng.uniform(0, 0.2), -74 + rng.uniform(0, 0.2)) for i in range(400)]
    points = spark.createDataFrame(rows, "_id long, _lat double, _lng double")
    general = {r._id: r.cluster for r in clusters._dense_clusters(points, 0.01, 2).collect()}
    named = spark.createDataFrame(rows, "id long, station_lat double, station_lng double")
    assert general == {r.id: r.cluster for r in clusters.density_clusters(named, "id").collect()}
    assert clusters.density_clusters(named.where("false"), "id", min_samples=5).count() == 0
