"""Writing tables: months of trips, plain tables, metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.functions.params import codec
from wayrisk.sources.trips import existing_months

MONTH_KEY = ["mode", "year", "month"]


def without_existing_months(members: DataFrame, root: str) -> DataFrame:
    """Leave out months already written, before anything is read for them."""
    try:
        done = existing_months(members.sparkSession, root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return members
        raise
    return members.join(done, MONTH_KEY, "left_anti")


def write_months(trips: DataFrame, root: str, compression: str = "none", keys: list[str] | None = None) -> None:
    """Write ``mode=/year=/month=`` folders, replacing only the months present in ``trips``.

    The rebalance hint lets AQE split a big month over several files and pack small
    ones; the commit protocol publishes a month only when it is complete.
    """
    keys = keys or MONTH_KEY
    padded = trips.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    (
        padded.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec(compression))
        .partitionBy(*keys)
        .parquet(root)
    )


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet unless CSV or JSON is asked for."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if form == "csv":
        writer.csv(path, header=True)
    elif form == "json":
        writer.json(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")
