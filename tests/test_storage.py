"""Counts from footers, counts by the write itself, and archives whose members are not UTF-8."""

import io
import zipfile

from pyspark.sql import functions as F

from wayrisk.functions.params import radii_in_columns
from wayrisk.plans.ingest import written_months
from wayrisk.sinks.partitions import write_months
from wayrisk.sources import archives as A
from wayrisk.sources import trips


def rows(spark):
    made = spark.range(300).select(
        F.lit("nyc").alias("mode"), F.lit(2020).alias("year"), (F.col("id") % 3 + 1).cast("int").alias("month"), F.col("id").cast("string").alias("ride_id"),
        F.when(F.col("id") % 10 > 0, F.expr("make_timestamp_ntz(2020, cast(id % 3 + 1 as int), 2, 3, 4, 5)")).alias("started_at"),
    )
    return made


def test_counts_come_from_footers(spark, tmp_path):
    write_months(rows(spark), f"{tmp_path}/t")
    counts = trips.month_row_counts(spark, f"{tmp_path}/t")
    plan = counts._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert {(r.month, r.trips) for r in counts.collect()} == {(1, 100), (2, 100), (3, 100)}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert {(r.mode, r.year, r.month) for r in trips.existing_months(spark, f"{tmp_path}/t").collect()} == {("nyc", 2020, m) for m in (1, 2, 3)}


def test_the_write_counts(spark, tmp_path):
    assert written_months(rows(spark), f"{tmp_path}/t") == {"rows": 300, "kept": 270, "untimed": 30}
    assert trips.read_trips(spark, f"{tmp_path}/t").count() == 270
    assert written_months(rows(spark), f"{tmp_path}/t", keep_null_times=True)["kept"] == 300
    assert trips.read_trips(spark, f"{tmp_path}/t").count() == 300


def test_members_of_both_encodings(spark, tmp_path):
    for month, encoding in ((1, "utf-8"), (2, "latin-1")):
        with zipfile.ZipFile(f"{tmp_path}/2020{month:02d}-bike-tripdata.zip", "w") as z:
            z.writestr(f"2020{month:02d}-bike-tripdata.csv", "ride_id,start_station_name\n1,Café\n2\n3,Peñón\n".encode(encoding))
    members = A.route_members(A.list_members(A.archives_in(spark, str(tmp_path))))
    got = A.read_members(members).collect()
    assert sorted((r.month, r.ride_id, r.start_station_name) for r in got if r.corrupt is None) == [(1, "1", "Café"), (1, "3", "Peñón"), (2, "1", "Café"), (2, "3", "Peñón")]
    assert [r.corrupt for r in got if r.corrupt is not None] == ["2", "2"]
    assert all(r.headers == ["ride_id", "start_station_name"] for r in got)
    assert A.encoding_of(io.BytesIO("é".encode())) == "utf8" and A.encoding_of(io.BytesIO(b"\xc3")) == "latin-1"


def test_radii_by_the_templates():
    assert radii_in_columns(["crashes_within_250m", "crashes_within_1000m_per_100k_trips", "crashes_within_m", "crashes_within_5km", "trips", "xcrashes_within_5m"]) == [250, 1000]
