"""Canonical trip tables and plain trip CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayrisk.functions import expr as X
from wayrisk.functions.params import clean_header
from wayrisk.operators.filters import select_mode, select_periods
from wayrisk.schemas import TRIP_TABLE

CORRUPT = "_corrupt_record"


def read_trips(
    spark: SparkSession,
    root: str,
    mode: str | None = None,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
) -> DataFrame:
    """Partitioned trip table; mode, year and month prune folders, selects prune columns."""
    table = spark.read.schema(TRIP_TABLE).parquet(root)
    return select_periods(select_mode(table, mode), years, months)


FOOTER_COUNTS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def month_row_counts(spark: SparkSession, root: str) -> DataFrame:
    """Trips per partition from the files' footers: the count is pushed into the scan, no row is read.

    The settings that allow it hold for this plan alone.
    """
    before = {k: spark.conf.get(k, None) for k in FOOTER_COUNTS}
    try:
        for k, v in FOOTER_COUNTS.items():
            spark.conf.set(k, v)
        counts = read_trips(spark, root).groupBy("mode", "year", "month").agg(F.count(F.lit(1)).alias("trips"))
        counts._jdf.queryExecution().optimizedPlan()  # planned while the settings hold
        return counts
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def existing_months(spark: SparkSession, root: str) -> DataFrame:
    """Months present under a trip root, as partition discovery names them; no column of a file is read."""
    return spark.read.schema(TRIP_TABLE).parquet(root).select("mode", "year", "month").distinct()


def column_set(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def read_text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files of one header with every column as text and null tokens as null.

    Rows that do not fit the header are kept apart in ``_corrupt_record``.
    """
    header = spark.read.option("header", "true").csv(paths).columns  # reads one line
    names = clean_header(header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    rows = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(paths)
    )
    return rows.select(*[X.null_token(F.col(f"`{n}`")).alias(n) for n in names], CORRUPT)
