"""Radius counts by sorted rows: equal to brute force everywhere, and without pairs inside a circle."""

import math
import re

import numpy as np
import pytest

from wayrisk.functions import expr as X
from wayrisk.operators import proximity


def circle(radius: float) -> tuple[float, float]:
    return X.half_chord_limit(radius), math.degrees(radius * proximity._SLACK / 6_371_000)


@pytest.mark.parametrize("centre", [(40.7, -74.0), (0.0, 179.99), (-0.01, -180.0), (89.99, 20.0), (-89.95, 3.0)])
@pytest.mark.parametrize("at_once", [50, 1 << 18])
def test_rows_equal_brute_force(monkeypatch, centre, at_once):
    monkeypatch.setattr(proximity, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    lat = np.clip(centre[0] + rng.uniform(-0.05, 0.05, 600), -90, 90)
    lng = (centre[1] + rng.uniform(-0.2, 0.2, 600) + 180) % 360 - 180
    lat[:50], lng[50:90] = lat[0], lng[50]
    cell, weight = np.sort(rng.integers(0, 3, 600)), rng.integers(1, 5, 600)
    of, here, there = rng.integers(0, 3, 60), np.clip(centre[0] + rng.uniform(-0.06, 0.06, 60), -90, 90), centre[1] + rng.uniform(-0.2, 0.2, 60)
    here[:5], there[:5] = lat[:5], lng[:5]
    rows = proximity.Rows(cell, lat, lng, weight)
    for radius in (30.0, 700.0, 4000.0, 60_000.0):
        limit, reach = circle(radius)
        near = proximity._half_chord_sq(here[:, None], there[:, None], lat, lng) <= limit
        want = (near * (of[:, None] == cell) * weight).sum(axis=1)
        assert rows.counts(of, here, there, limit, reach).tolist() == want.tolist()


def test_rim_alone_is_tested(monkeypatch):
    """Before, every crash near a station was a pair: doubled tables took four times as long."""
    tested, plain = [0], proximity._half_chord_sq

    def counted(*places):
        tested[0] += len(places[0])
        return plain(*places)

    monkeypatch.setattr(proximity, "_half_chord_sq", counted)
    rng = np.random.default_rng(5)
    n, places = 60_000, 100
    rows = proximity.Rows(np.zeros(n, int), rng.uniform(40, 40.03, n), rng.uniform(-74, -73.96, n), np.ones(n, int))
    got = rows.counts(np.zeros(places, int), rng.uniform(40, 40.03, places), rng.uniform(-74, -73.96, places), *circle(1000.0))
    assert tested[0] < got.sum() / 10


def test_few_points_a_salt_make_no_storm_of_tasks(spark):
    """The number of partitions follows the rows, not how few points a salt takes."""
    s = spark.createDataFrame([(k, 40.7 + k / 1e4, -74.0) for k in range(50)], "id long, station_lat double, station_lng double")
    c = spark.range(3000).selectExpr("40.7 + id % 50 / 1e4 AS latitude", "-74.0 + id / 1e7 AS longitude")
    got = proximity.count_within(s, c, [500.0], salt_points=1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)) <= 100
    assert got.count() == 50 and got.agg({"crashes_within_500m": "sum"}).first()[0] > 3000


def test_period_and_coordinates_may_be_missing(spark):
    nan, inf = float("nan"), float("inf")
    s = spark.createDataFrame(
        [("a", None, 40.7, -74.0), ("b", 1, nan, -74.0), ("c", 1, 40.7, inf), ("d", 1, 40.7, -74.0), ("e", 2, 40.7, -74.0)],
        "id string, year int, station_lat double, station_lng double",
    )
    c = spark.createDataFrame([(None, 40.7, -74.0), (1, nan, -74.0), (1, 40.7, nan), (1, 40.7, -74.0), (1, 40.7, None)], "year int, latitude double, longitude double")
    got = {r.id: r.crashes_within_500m for r in proximity.count_within(s, c, [500.0], ["year"]).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 0}
