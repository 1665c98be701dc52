"""Radius counts on the sphere: equal grid cells bring stations and crashes together, sorted rows count them.

The globe is cut into latitude bands a few radii high and each band into cells at least as wide at
that latitude.  A crash lies in one cell; a station is looked up in the few cells its circle can
touch.  Both sides are dealt by cell (and period) and met cell by cell.

Within a cell no pairs are formed.  Crashes are sorted by narrow rows of latitude and by longitude;
in each row a circle has an inner range, whose crashes all lie within the radius and are counted by
a difference of running sums, and the two ends beside it, whose crashes get the exact haversine test.
So a station costs the rows and the rim of its circle, not what lies inside.

Against skew: crashes at the same coordinates are one weighted point before the shuffle, stations of
the same place one place, and a cell that still holds many of either is split over several salts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.functions.params import crash_column, rate_column
from wayrisk.schemas import EARTH_RADIUS_M
from wayrisk.session import small_side, stored

SALT_POINTS = 200_000  # points of one cell handled by one salt
CELL_RADII = 4  # height of a band of cells in radii
TASK_ROWS = 100_000  # points and looked-up places dealt to one task
ROW_POINTS = 5.0  # points in a square as wide as a row is high
AT_ONCE = 1 << 18  # rows of cells, rows of circles, and rim points held together
_SLACK = 1.0 + 1e-9  # keeps points exactly on a radius inside the looked-up cells
_MARGIN = 1e-6  # degrees by which inner ranges shrink and outer ones grow


def _band(lat: Column, height: float) -> Column:
    return F.floor(lat / height)


def _cells_in_band(band: Column, height: float) -> Column:
    """Number of equal cells round the globe in a band, each at least one height wide."""
    widest = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * F.lit(height), F.lit(90.0))
    fits = F.floor(F.lit(360.0) * F.greatest(F.cos(F.radians(widest)), F.lit(0.0)) / height)
    return F.greatest(fits, F.lit(1).cast("long"))


def _cell(lng: Column, cells: Column) -> Column:
    return F.floor((lng + 180.0) * cells / 360.0)


def _lookup_cells(lat: Column, lng: Column, radius_m: float, height: float) -> Column:
    """Array of (band, cell) a circle round the station can touch."""
    reach = radius_m * _SLACK / EARTH_RADIUS_M
    shrink = F.cos(F.radians(lat))
    # widest half-angle of longitude on the circle; the whole band near a pole
    turn = F.when(F.lit(math.sin(reach)) < shrink, F.degrees(F.asin(F.lit(math.sin(reach)) / shrink))).otherwise(
        F.lit(180.0)
    )
    half = F.degrees(F.lit(reach))
    bands = F.sequence(_band(lat - half, height), _band(lat + half, height))

    def in_band(band: Column) -> Column:
        cells = _cells_in_band(band, height)
        lo, hi = _cell(lng - turn, cells), _cell(lng + turn, cells)
        span = F.sequence(lo, F.least(hi, lo + cells - 1))
        return F.transform(span, lambda c: F.struct(band.alias("band"), F.pmod(c, cells).alias("cell")))

    return F.flatten(F.transform(bands, in_band))


# --- many cells at once -------------------------------------------------------
def _half_chord_sq(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    a, b = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lng2 - lng1) / 2)
    return a * a + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * b * b


def _turned(lng: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Degrees east of ``middle``, -180 to 180."""
    return (lng - middle + 180.0) % 360.0 - 180.0


def _half_width(most: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Degrees of longitude at which ``cosines * sin²(half the degrees)`` reaches ``most``; -1 for none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(cosines > 0, most / cosines, np.inf)
    wide = 2 * np.degrees(np.arcsin(np.sqrt(np.clip(share, 0.0, 1.0))))
    return np.where(most < 0, -1.0, np.where(share >= 1.0, 360.0, wide))


class Rows:
    """Points of cells in rows of latitude, sorted by longitude within a row.

    ``cell`` numbers the cells from 0 and ascends; every cell has points and a height of rows of its own,
    which balances the rows of a circle and the points of its rim.
    """

    def __init__(self, cell: np.ndarray, lat: np.ndarray, lng: np.ndarray, weight: np.ndarray):
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        n = np.diff(first, append=len(cell))
        self.middle = lng[first]
        east = _turned(lng, self.middle[cell])
        self.low, high = np.minimum.reduceat(lat, first), np.maximum.reduceat(lat, first)
        self.widest = np.maximum.reduceat(np.abs(east), first)
        tall = np.maximum(high - self.low, 1e-6)
        shrink = np.cos(np.radians(np.maximum(np.abs(self.low), np.abs(high))))
        wide = (np.maximum.reduceat(east, first) - np.minimum.reduceat(east, first)) * np.maximum(shrink, 1e-6)
        self.height = np.maximum(np.sqrt(ROW_POINTS * tall * np.maximum(wide, 1e-6) / n), tall / n)
        row = np.floor((lat - self.low[cell]) / self.height[cell]).astype(np.int64)
        self.n = np.maximum.reduceat(row, first) + 1  # not more than points + 1
        self.before = np.cumsum(self.n) - self.n
        row += self.before[cell]
        order = np.lexsort((east, row))
        self.lat, self.lng, self.weight = lat[order], lng[order], weight[order]
        # One ascending key for all rows, which lie 1,000 degrees apart: up to a million rows its rounding
        # is below a fifth of the margin.
        self.key = row[order] * 1000.0 + east[order]
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])

    def counts(self, cell: np.ndarray, lat: np.ndarray, lng: np.ndarray, limit: float, reach: float) -> np.ndarray:
        """Weight in its cell whose half chord squared is at most ``limit`` (``reach`` degrees), for every place."""
        out = np.zeros(len(lat), np.int64)
        low, height, n = self.low[cell], self.height[cell], self.n[cell]
        first = np.clip(np.floor((lat - reach - _MARGIN - low) / height), 0, n).astype(np.int64)
        last = np.clip(np.floor((lat + reach + _MARGIN - low) / height), -1, n - 1).astype(np.int64)
        rows = np.maximum(last - first + 1, 0)
        ends = np.cumsum(rows)
        at = 0
        while at < len(lat):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            some = slice(at, to)
            of = np.repeat(np.arange(at, to), rows[some])
            row = np.arange(len(of)) - np.repeat(ends[some] - rows[some] - done - first[some], rows[some])
            if len(of):
                self._add(out, of, row, cell, lat, lng, limit, reach)
            at = to
        return out

    def _add(self, out, of, row, cell, lat, lng, limit: float, reach: float) -> None:
        """Add what lies in ``row`` of its cell within the circle of place ``of``."""
        at, here = cell[of], lat[of]
        low = self.low[at] + row * self.height[at]
        high = low + self.height[at]
        far = np.maximum(np.abs(low - here), np.abs(high - here)) + _MARGIN
        near = np.maximum(np.maximum(low - here, here - high) - _MARGIN, 0.0)
        edges = np.cos(np.radians(low - _MARGIN)), np.cos(np.radians(high + _MARGIN))
        at_equator = (low <= _MARGIN) & (high >= -_MARGIN)
        cos_here = np.cos(np.radians(here))
        cos_most, cos_least = np.where(at_equator, 1.0, np.maximum(*edges)) * cos_here, np.minimum(*edges) * cos_here
        inner = _half_width(limit - np.sin(np.radians(far) / 2) ** 2, cos_most) * (1 - _MARGIN) - _MARGIN
        outer = _half_width(limit * _SLACK - np.sin(np.radians(near) / 2) ** 2, cos_least) * _SLACK + _MARGIN
        east = _turned(lng[of], self.middle[at])
        # beyond a half turn, and beside a pole, the whole row is tested
        whole = (np.abs(east) + outer + self.widest[at] >= 360.0 - _MARGIN) | (cos_least <= 0)
        inner, outer = np.where(whole | (far > reach), -1.0, inner), np.where(whole, 400.0, outer)
        middle = (self.before[at] + row) * 1000.0 + np.where(whole, 0.0, east)
        start, stop = np.searchsorted(self.key, middle - outer, "left"), np.searchsorted(self.key, middle + outer, "right")
        left, right = np.searchsorted(self.key, middle - inner, "left"), np.searchsorted(self.key, middle + inner, "right")
        none = (inner < 0) | (left >= right)
        left, right = np.where(none, stop, left), np.where(none, stop, right)
        _gather(out, of, self.sums[right] - self.sums[left])
        for begin, end in ((start, left), (right, stop)):
            self._test(out, of, begin, end, lat, lng, limit, reach)

    def _test(self, out, of, begin, end, lat, lng, limit: float, reach: float) -> None:
        """Add the points from ``begin`` to ``end`` that pass the exact test."""
        sizes = np.maximum(end - begin, 0)
        held = np.flatnonzero(sizes)
        of, begin, total = of[held], begin[held], np.concatenate([[0], np.cumsum(sizes[held])])
        for lo in range(0, int(total[-1]), AT_ONCE):
            nth = np.arange(lo, min(lo + AT_ONCE, int(total[-1])))
            which = np.searchsorted(total, nth, "right") - 1
            point, place = begin[which] + nth - total[which], of[which]
            close = np.abs(lat[place] - self.lat[point]) <= reach
            close &= _half_chord_sq(lat[place], lng[place], self.lat[point], self.lng[point]) <= limit
            _gather(out, place[close], self.weight[point[close]])


def _gather(out: np.ndarray, of: np.ndarray, what: np.ndarray) -> None:
    """``out[of] += what`` with repeats; ``of`` ascends."""
    if len(of):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[first]] += np.add.reduceat(what, first)


def _met(table: pa.Table, keys: Sequence[str], circles: Sequence[tuple[float, float]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of places with any crash, and their counts by circle, of a table sorted by cell (``keys``).

    Rows with a ``_weight`` are points, the others places.
    """
    cell = np.cumsum(_starts(table, keys)) - 1
    lat, lng, weight = (table[c].to_numpy() for c in ("_lat", "_lng", "_weight"))
    held, of_point = np.unique(cell[weight > 0], return_inverse=True)
    place = np.flatnonzero((weight == 0) & np.isin(cell, held))
    if not len(place):
        return place, [place for _ in circles]
    is_point = weight > 0
    rows = Rows(of_point, lat[is_point], lng[is_point], weight[is_point])
    of_place = np.searchsorted(held, cell[place])
    found = [rows.counts(of_place, lat[place], lng[place], limit, reach) for limit, reach in circles]
    some = np.flatnonzero(np.any([f > 0 for f in found], axis=0))
    return place[some], [f[some] for f in found]


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; the first is."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in keys:
        column = table[c].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


# --- all cells ----------------------------------------------------------------
def count_within(
    stations: DataFrame,
    crashes: DataFrame,
    radii: Sequence[float],
    same: Sequence[str] = (),
    salt_points: int = SALT_POINTS,
) -> DataFrame:
    """Add per radius the number of crashes within it; stations without any get 0.

    ``same`` names columns both sides must agree on (``year``, or ``year`` and
    ``month``).  Stations without coordinates are left out.  ``salt_points`` is how many points of
    a cell one salt takes; of the places looked up there it copies to the salts no more rows than
    the cell has points, unless a salt would exceed ``SALT_POINTS``.
    """
    same, widest = list(same), float(max(radii))
    reach = math.degrees(widest * _SLACK / EARTH_RADIUS_M)
    height = reach * CELL_RADII
    on = [*same, "_band", "_cell"]

    def known(df: DataFrame, *columns: str) -> DataFrame:
        for c in [*same, *columns]:
            df = df.where(F.col(c).isNotNull())
        for c in columns:
            df = df.where(F.abs(c) < float("inf"))  # not for NaN either
        return df

    points = known(
        crashes.select(*same, F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lng")), "_lat", "_lng"
    )
    points = points.groupBy(*same, "_lat", "_lng").agg(F.count(F.lit(1)).alias("_weight")).withColumn("_band", _band(F.col("_lat"), height))
    cells = _cells_in_band(F.col("_band"), height)
    # stored: the crowding counts and the cells below read the same points, crashes are scanned once
    points = stored(points.withColumn("_cell", F.pmod(_cell(F.col("_lng"), cells), cells)))

    placed = stations.where(F.col("station_lat").isNotNull() & F.col("station_lng").isNotNull())
    # stored: the counts come back to the stations by their computed coordinates
    placed = stored(placed)
    places = placed.select(*same, F.col("station_lat").cast("double").alias("_lat"), F.col("station_lng").cast("double").alias("_lng"))
    looked_up = known(places.distinct(), "_lat", "_lng")
    looked_up = looked_up.withColumn("_at", F.explode(_lookup_cells(F.col("_lat"), F.col("_lng"), widest, height)))
    looked_up = looked_up.withColumns({"_band": F.col("_at.band"), "_cell": F.col("_at.cell")}).drop("_at")

    held = points.groupBy(*on).agg(F.count(F.lit(1)).alias("_p")).join(looked_up.groupBy(*on).agg(F.count(F.lit(1)).alias("_s")), on)
    held = stored(held)
    copied = F.least(F.ceil(F.col("_p") / salt_points), F.ceil(F.col("_p") / F.col("_s")))
    crowded = small_side(
        held.select(
            *on,
            F.greatest(copied, F.ceil(F.col("_p") / SALT_POINTS)).cast("int").alias("_salts"),
            F.ceil(F.col("_s") / SALT_POINTS).cast("int").alias("_turns"),
        ).where("_salts > 1 OR _turns > 1")
    )

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one share of its own kind and in all of the other."""
        n = {c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)}
        shares = {own: F.pmod(F.xxhash64("_lat", "_lng"), n[own]).cast("int"), other: F.explode(F.sequence(F.lit(0), n[other] - 1))}
        return df.join(crowded, on, "left").withColumns(shares)

    if crowded.isEmpty():
        points, looked_up = (df.withColumns({"_salts": F.lit(0), "_turns": F.lit(0)}) for df in (points, looked_up))
    else:
        points, looked_up = dealt(points, "_salts", "_turns"), dealt(looked_up, "_turns", "_salts")
    rows = held.agg(F.coalesce(F.sum(F.col("_p") + F.col("_s")), F.lit(0))).first()[0]
    # The work of a cell is more than its bytes: without a number of partitions AQE would pack
    # many into one task.  The number follows the rows.
    least = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(least, -(-int(rows) // TASK_ROWS))
    keys = [*on, "_salts", "_turns"]
    both = points.select(*keys, "_lat", "_lng", "_weight").unionByName(looked_up.select(*keys, "_lat", "_lng", F.lit(0).cast("long").alias("_weight")))
    names = [crash_column(r) for r in radii]
    circles = [(X.half_chord_limit(float(r)), math.degrees(float(r) * _SLACK / EARTH_RADIUS_M)) for r in radii]
    back = [*same, "_lat", "_lng"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
            place, found = _met(table, keys, circles)
            out = table.select(back).take(pa.array(place))
            for name, values in zip(names, found, strict=True):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield from out.combine_chunks().to_batches()

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= AT_ONCE:
                table = pa.Table.from_batches(kept)
                cut = int(np.flatnonzero(_starts(table, keys))[-1])  # the last cell may go on
                if cut:
                    yield from counted(table.slice(0, cut))
                kept = table.slice(cut).combine_chunks().to_batches()
        if kept:
            yield from counted(pa.Table.from_batches(kept))

    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in back], *[f"`{c}` long" for c in names]])
    counted = both.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(count, schema)
    found = counted.groupBy(*same, "_lat", "_lng").agg(*[F.sum(c).alias(c) for c in names])
    found = found.withColumnsRenamed({c: f"_same_{c}" for c in same})
    here = (F.col("station_lat").cast("double") == F.col("_lat")) & (F.col("station_lng").cast("double") == F.col("_lng"))
    for c in same:
        here &= F.col(c) == F.col(f"_same_{c}")
    return placed.join(found, here, "left").select(*stations.columns, *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in names])


def zero_counts(stations: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Where no crash data covers the network: 0 for every radius."""
    return stations.withColumns({crash_column(r): F.lit(0).cast("long") for r in radii})


def with_rates(stations: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Crashes per 100,000 trips for every radius, for rows with any trips."""
    kept = stations.where(F.col("trips") > 0)
    absent = {crash_column(r): F.lit(0).cast("long") for r in radii if crash_column(r) not in stations.columns}
    kept = kept.withColumns(absent) if absent else kept
    return kept.withColumns(
        {
            rate_column(r): X.per_100k(F.coalesce(F.col(crash_column(r)), F.lit(0)), F.col("trips"))
            for r in radii
        }
    )
