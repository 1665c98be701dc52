"""Embedding whitening from singular values of the centred rows.

The vectors are put on an integer grid and fitted over the distinct grid vectors.  Tasks centre
their rows exactly and reduce them block by block to an upper triangle (QR); triangles meet in a
tree.  The last one is made bidiagonal, its singular values found by dqds and its directions by
twisted factorisations (``bidiagonal``), so the covariance is never formed.  Every row is then
projected in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.bidiagonal import right_vectors
from wayrisk.llm.common import written

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 60)  # grid entries beyond this are put there
BLOCK_ROWS = 4096
FAN_IN = 32  # triangles that meet in a task
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: rows, sums, falling eigenvalues, their trace, unit directions as columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    directions: np.ndarray

    @property
    def has_spread(self) -> np.ndarray:
        """Whether a component's variance stands out from rounding."""
        top = self.eigenvalues.max(initial=0.0)
        return self.eigenvalues[: self.directions.shape[1]] > top * (EPS * len(self.sums)) ** 2

    @property
    def factors(self) -> np.ndarray:
        """Directions over the square roots of their eigenvalues; zero without spread."""
        k = self.directions.shape[1]
        spread = np.sqrt(np.where(self.has_spread, self.eigenvalues[:k], 1.0))
        return np.where(self.has_spread, self.directions / spread, 0.0)


def grid(vector: Column) -> Column:
    """Entries c as floor(64 c) + 1000000; null where the vector is null or empty or an entry is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))) + SHIFT)
    return F.when((F.size(vector) > 0) & ~bad, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists of numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``n x - S`` as double, and the exact sum of its squares a row (an object array; None beyond 64 bits)."""
    safe = 1 << 62
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if most < safe:
        apart = n * x - np.array(sums, np.int64)
        largest = int(np.abs(apart).max(initial=0))
        if largest * largest * max(x.shape[1], 1) < safe:
            return apart.astype(float), (apart * apart).sum(axis=1).astype(object)
        big = apart.astype(object)
    else:
        big = n * x.astype(object) - np.array(sums, object)
    total = (big * big).sum(axis=1)
    return big.astype(float), np.array([t if t < 1 << 63 else None for t in total.tolist()], object)


def _sums(points: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension; one row a dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                few = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
                own = [int(s) for s in (x if few else x.astype(object)).sum(axis=0)]
                n, total = n + len(x), own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            import decimal

            values = [decimal.Decimal(v) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["at", "n", "s"])

    made = points.mapInArrow(run, "at int, n long, s decimal(38,0)")
    rows = sorted(made.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _triangle(points: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The upper triangle of all centred rows: blocks of rows in the tasks, then a tree."""
    d = len(sums)

    def folded(triangle: np.ndarray, rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([triangle, rows]), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def packed(triangle: np.ndarray, place: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([triangle.tobytes()], pa.binary())], names=["place", "r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, any_rows = np.zeros((d, d)), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                triangle = folded(triangle, exact_deviation(_matrix(batch.column(0).slice(at, BLOCK_ROWS)), n, sums)[0] / n)
                any_rows = True
        if any_rows:
            yield packed(triangle, TaskContext.get().partitionId())

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, any_rows = np.zeros((d, d)), False
        for batch in batches:
            for r in batch.column(1):
                triangle, any_rows = folded(triangle, np.frombuffer(r.as_buffer()).reshape(d, d)), True
        if any_rows:
            yield packed(triangle, TaskContext.get().partitionId())

    triangles = written(points.mapInArrow(of_rows, "place int, r binary"), "triangles")
    left = triangles.count()
    while left > FAN_IN:
        groups = -(-left // FAN_IN)
        triangles = written(triangles.repartition(groups, F.pmod("place", F.lit(groups))).mapInArrow(of_triangles, "place int, r binary"), "triangles")
        left = triangles.count()
    out = np.zeros((d, d))
    for row in triangles.orderBy("place").collect():  # FAN_IN at most
        out = folded(out, np.frombuffer(row["r"]).reshape(d, d))
    return out


def fit(points: DataFrame, components: int) -> Whitening | None:
    """Over the distinct grid vectors ``x`` (equally long); None without rows."""
    n, sums = _sums(points)
    if not n:
        return None
    values, directions = right_vectors(_triangle(points, n, sums), min(components, len(sums)))
    values = values / n
    return Whitening(n, sums, values, float(values.sum()), directions)


def identity_error(points: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured
    over the components with spread; 0 if there is none."""
    n, sums, factors = model.n, model.sums, model.factors[:, model.has_spread]
    k = factors.shape[1]
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = exact_deviation(_matrix(batch.column(0)), n, sums)[0] / n @ factors
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    rows = points.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[divmod(r["at"], k)] = r["v"]
    mean = total[k] / n
    return float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 16, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each kept row and component.

    Rows without a usable vector (``grid``) are left out, and so are those of another length than most
    rows have (of the longest among equally frequent lengths).  Repeated rows and null keys stay.
    Components are as many as the vectors have dimensions, ``components`` at most.  A component without
    spread (fewer distinct rows than dimensions, equal entries) has null ``whitened`` and is left out of
    ``identity_error``.  ``explained`` is null if nothing has spread, ``deviation`` beyond 64 bits.
    An empty table gives no rows.  Other columns are left out.
    """
    kept = rows.select(F.col(key), grid(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    kept = kept.where(F.size("x") == usual["d"])
    points = written(kept.select("x").distinct(), "grid-vectors")
    model = fit(points, components)
    wrong = identity_error(points, model)
    factors, has_spread, n, sums = model.factors, model.has_spread, model.n, model.sums
    k = factors.shape[1]
    explained = (model.eigenvalues[:k] / model.trace).tolist() if model.trace > 0 else [None] * k
    names = [key, *[c.split()[0] for c in schema.split(", ")[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            apart, deviation = exact_deviation(_matrix(batch.column(1)), n, sums)
            each = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviation.tolist(), pa.int64()).take(pa.array(each)),
                pa.array((apart / n @ factors).ravel(), mask=np.tile(~has_spread, m)),
                pa.array(explained * m, pa.float64()),
                pa.array(np.full(m * k, wrong)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)
