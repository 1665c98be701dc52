"""Crash records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.functions import expr as X
from wayrisk.functions.params import crash_name, pick_column, require_columns
from wayrisk.operators.canonical import standardise_columns
from wayrisk.schemas import CRASH_COLUMNS

DATE_PATTERNS = ["yyyy-M-d", "M/d/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s"]


def crash_date(c: Column) -> Column:
    text = F.regexp_replace(F.trim(c), r"\.\d+$", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS]).cast("timestamp_ntz")


def read_crash_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The nine kept columns of a full crash export, typed; missing columns are an error."""
    raw = standardise_columns(spark.read.option("header", "true").csv(path), crash_name)
    require_columns(raw.columns, CRASH_COLUMNS, "crash export")
    typed = raw.select(*CRASH_COLUMNS)
    whole = ["number_of_persons_injured", "number_of_cyclist_injured", "number_of_cyclist_killed"]
    return typed.withColumns(
        {
            "collision_id": F.col("collision_id").try_cast("long"),
            "crash_date": crash_date(F.col("crash_date")),
            "latitude": X.number("latitude"),
            "longitude": X.number("longitude"),
            **{c: X.number(c).cast("int") for c in whole},
        }
    )


def crash_points(table: DataFrame) -> DataFrame:
    """Date, place, year and month of every crash that has them, under common column names."""

    def find(what: str, names: list[str]) -> Column:
        column = pick_column(table.columns, names)
        if column is None:
            raise ValueError(f"no {what} column among {table.columns[:60]}")
        return F.col(f"`{column}`")

    date = find("crash date", ["crash_date", "CRASH DATE"])
    dated = date if dict(table.dtypes).get(pick_column(table.columns, ["crash_date", "CRASH DATE"])) != "string" else crash_date(date)
    return (
        table.select(
            dated.cast("timestamp_ntz").alias("crash_date"),
            X.number(find("latitude", ["latitude", "lat"])).alias("latitude"),
            X.number(find("longitude", ["longitude", "lng", "lon"])).alias("longitude"),
        )
        .dropna(subset=["crash_date", "latitude", "longitude"])
        .withColumns({"year": F.year("crash_date"), "month": F.month("crash_date")})
    )
