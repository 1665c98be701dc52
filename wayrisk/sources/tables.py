"""Summary tables of runs: reading one, reading all runs, and choosing between them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayrisk.functions.params import choose_radius, require_columns
from wayrisk.operators.filters import select_mode, select_periods
from wayrisk.session import small_side

RUN_GLOB = "y*_mode*"


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, optional: bool = False, form: str = "parquet"
) -> DataFrame | None:
    """A stored table; with ``optional`` a missing path gives ``None`` instead of an error.

    CSV is always read by a declared schema (station ids stay text).
    """
    if form == "csv" and schema is None:
        raise ValueError("CSV tables need a declared schema")
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.csv(path, header=True) if form == "csv" else reader.parquet(path)
    except AnalysisException as error:
        if optional and "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_runs(
    spark: SparkSession, root: str, table: str, schema: StructType, form: str = "parquet", needed: Sequence[str] = ("mode", "year", "trips")
) -> DataFrame:
    """One table of every run folder, tagged with the folder's name.

    Runs without the table are not matched by the path.  A run that lacks a needed column
    (it reads as null in all its rows) is skipped whole; single nulls stay.
    """
    rows = read_table(spark, f"{root.rstrip('/')}/{RUN_GLOB}/{table}", schema, form=form)
    tag = F.regexp_extract(F.col("_metadata.file_path"), rf"/(y[^/]*_mode[^/]*)/{table}/", 1)
    tagged, wanted = rows.withColumn("run_tag", tag), [c for c in needed if c in rows.columns]
    if not wanted:
        return tagged
    held = tagged.groupBy("run_tag").agg(*[F.count(c).alias(c) for c in wanted])
    complete = held.where(F.least(*map(F.col, wanted)) > 0 if len(wanted) > 1 else F.col(wanted[0]) > 0)
    return tagged.join(small_side(complete.select("run_tag")), "run_tag", "left_semi")


def finest_risk(tables: dict[str, DataFrame | None], strict: bool = False) -> tuple[str, DataFrame]:
    """Year-month risk if there, else yearly, else lifetime (an error with ``strict``)."""
    for grain in ("year_month", "year") if strict else ("year_month", "year", "lifetime"):
        if tables.get(grain) is not None:
            return grain, tables[grain]
    raise FileNotFoundError(f"no risk table among {sorted(tables)}")


def scorecard_for(cards: dict[int, DataFrame], radius: str | int | None = "auto") -> DataFrame:
    """Scorecard of the wanted radius, else 500 m, else the largest."""
    return cards[choose_radius(cards, radius)]


def preferred_table(
    run: DataFrame,
    combined: DataFrame | None,
    mode: str,
    years: Iterable[int] | None = None,
    months: Iterable[int] | None = None,
) -> DataFrame:
    """The all-runs table when nothing is filtered, else this run's; then one mode."""
    unfiltered = years is None and months is None
    table = combined if unfiltered and combined is not None else run
    require_columns(table.columns, ["mode"], "usage table")
    return select_periods(select_mode(table, mode), years, months)
