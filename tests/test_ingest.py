"""Archive scan, canonicalisation and the partitioned sink on archives made here."""

import datetime as dt
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wayrisk.operators import canonical, filters
from wayrisk.plans.ingest import ingest, ingest_older_layer, planned_members
from wayrisk.sinks.partitions import write_months
from wayrisk.sources import archives, crashes, trips

MODERN = "ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual"
LEGACY = "Trip Duration,Start Time,Stop Time,Start Station ID,Start Station Name,Start Station Latitude,Start Station Longitude,End Station ID,End Station Name,End Station Latitude,End Station Longitude,Bike ID,User Type,Birth Year,Gender"


def modern(ride, start, sid="5137.10", eid="5636.13", end="2023-01-03 23:30:00"):
    return f'{ride},classic_bike,{start},{end},"E 1 St, & Bowery",{sid},Other,{eid},40.72,-73.99,40.73,-73.98,member'


def legacy(start, sid="72", lat="40.70", lng="-74.05", user="Subscriber"):
    return f"600,{start},2015-03-02 00:15:07,{sid},S {sid},{lat},{lng},73,S 73,40.71,-74.04,1001,{user},1980,1"


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, lines in members.items():
            z.writestr(name, lines if isinstance(lines, bytes) else "\n".join(lines) + "\n")


def zipped(members):
    buffer = io.BytesIO()
    archive(buffer, members)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    archive(
        root / "202301-city-tripdata.csv.zip",
        {
            "x/202301-city-tripdata.csv": [MODERN, modern("WHOLE", "2023-01-05 00:00:00")],
            "x/202301-city-tripdata_2.csv": [MODERN, modern("B", "2023-01-31 23:59:59.999"), modern("OUT", "2023-02-01 00:00:00")],
            "x/202301-city-tripdata_1.csv": [
                "﻿" + MODERN,
                modern("A", "2023-01-03 23:14:52.325"),
                modern("JCSTART", "2023-01-04 10:00:00", sid="jc001"),
                modern("NOEND", "2023-01-04 11:00:00", eid=""),
                modern("NOTIME", "never"),
                "short,row",
            ],
            "x/202301-CITY-tripdata_1.csv": [MODERN, modern("DUPLICATE", "2023-01-03 01:00:00")],
            "__MACOSX/x/._202301-city-tripdata_1.csv": [MODERN, modern("JUNK", "2023-01-03 01:00:00")],
            "x/.DS_Store": b"junk",
        },
    )
    archive(
        root / "2023-city-tripdata.zip",
        {
            "202301-city-tripdata.csv": [MODERN, modern("YEARLY", "2023-01-05 00:00:00")],
            "202202-city-tripdata.csv": [MODERN, modern("OTHERYEAR", "2022-02-05 00:00:00")],
            "notes.csv": [MODERN, modern("NOMONTH", "2023-02-05 00:00:00")],
            "202302-city-tripdata.zip": zipped(
                {
                    "202302-city-tripdata_1.csv": [MODERN, modern("N1", "2023-02-05 00:00:00")],
                    "deeper.zip": zipped({"more.csv": [MODERN, modern("N2", "2023-02-06 00:00:00")]}),
                }
            ),
        },
    )
    archive(
        root / "JC-201503-city-tripdata.csv.zip",
        {
            "JC-201503-city-tripdata.csv": [
                LEGACY,
                legacy("3/2/2015 0:05:07"),
                legacy("3/2/2015 0:06", user="Customer"),
                legacy("2015-03-03 08:00:00", lat="40.90"),
                legacy("2015-03-03 09:00:00", lat="NULL"),
                legacy("2015-03-04 09:00:00", user="Dependent"),
            ]
        },
    )
    (root / "readme.txt").write_text("no archive")
    return str(root)


def test_planned_members(spark, folder):
    rows = planned_members(spark, folder, [2015, 2023], [1, 2, 3], "auto").collect()
    got = {(r.mode, r.year, r.month, r.member) for r in rows}
    assert got == {
        ("nyc", 2023, 1, "x/202301-city-tripdata_1.csv"),
        ("nyc", 2023, 1, "x/202301-city-tripdata_2.csv"),
        ("nyc", 2023, 2, "202302-city-tripdata.zip"),
        ("jc", 2015, 3, "JC-201503-city-tripdata.csv"),
    }


def test_ragged_rows_are_set_aside(spark, folder):
    raw = archives.read_members(planned_members(spark, folder, [2023], [1], "nyc"))
    assert [r.corrupt for r in raw.where("corrupt IS NOT NULL").collect()] == ["short,row"]


def test_ingest_writes_and_skips(spark, folder, tmp_path):
    out = str(tmp_path / "trips")
    damaged = ingest(spark, folder, out, [2015, 2023], [1, 2, 3], compression="zstd")
    assert [(member, n) for _, member, n in damaged] == [("x/202301-city-tripdata_1.csv", 1)]
    assert [r.corrupt for r in spark.read.parquet(f"{out}-quarantine").collect()] == ["short,row"]
    table = trips.read_trips(spark, out)
    rows = {r.ride_id: r for r in table.collect() if r.year == 2023}
    # legacy start outside the jersey prefixes, null end kept in nyc, junk, duplicates and other months gone
    assert set(rows) == {"A", "B", "NOEND", "N1", "N2"}
    assert rows["A"].started_at == dt.datetime(2023, 1, 3, 23, 14, 52)
    assert rows["A"].start_station_id == "5137.10"
    assert rows["A"].start_station_name == "E 1 St, & Bowery"
    assert rows["NOEND"].end_station_id is None
    assert rows["N2"].month == 2

    old = {r.started_at: r for r in table.where("mode = 'jc'").collect()}
    # box filter for numeric ids: the row north of the box and the one without a place are dropped
    assert set(old) == {dt.datetime(2015, 3, 2, 0, 5, 7), dt.datetime(2015, 3, 2, 0, 6), dt.datetime(2015, 3, 4, 9, 0)}
    first = old[dt.datetime(2015, 3, 2, 0, 5, 7)]
    text = "3/2/2015 0:05:07|2015-03-02 00:15:07|1001|72|73|600"
    assert first.ride_id == hashlib.md5(text.encode()).hexdigest()
    assert (first.member_casual, first.usertype, first.bike_id, first.start_lat) == ("member", "Subscriber", "1001", "40.70")
    assert old[dt.datetime(2015, 3, 4, 9, 0)].member_casual is None

    counts = {(r.mode, r.year, r.month): r.trips for r in trips.month_row_counts(spark, out).collect()}
    assert counts == {("nyc", 2023, 1): 3, ("nyc", 2023, 2): 2, ("jc", 2015, 3): 3}
    existing = {tuple(r) for r in trips.existing_months(spark, out).collect()}
    assert existing == set(counts)

    # nothing left to do without force; with force only the months asked for are replaced
    from wayrisk.sinks.partitions import without_existing_months

    members = planned_members(spark, folder, [2015, 2023], [1, 2, 3], "auto")
    assert without_existing_months(members, out).count() == 0
    ingest(spark, folder, out, [2023], [1], force=True, keep_null_times=True)
    again = {r.ride_id for r in trips.read_trips(spark, out, "nyc", [2023], [1]).collect()}
    assert again == {"A", "B", "NOEND", "NOTIME"}
    assert trips.read_trips(spark, out, "jc").count() == 3


def test_older_layer(spark, folder, tmp_path):
    out = str(tmp_path / "older")
    ingest_older_layer(spark, folder, out, [3])
    rows = spark.read.parquet(out).collect()
    minutes = {r.started_at: r.trip_minutes for r in rows}
    assert minutes == {dt.datetime(2015, 3, 2, 0, 5, 7): 10.0, dt.datetime(2015, 3, 2, 0, 6): pytest.approx(9 + 7 / 60)}
    assert {r.weekday for r in rows} == {"Monday"}


def test_plain_csv(spark, tmp_path):
    path = tmp_path / "part_1.csv"
    path.write_text(MODERN + "\n" + modern("A", "2023-01-03 23:14:52.325") + "\n" + modern("B", "NaN", sid="N/A") + "\n1,2\n")
    raw = trips.read_text_csv(spark, str(path))
    good = raw.where(f"{trips.CORRUPT} IS NULL").drop(trips.CORRUPT)
    rows = {r.ride_id: r for r in canonical.canonical_trips(good).collect()}
    assert rows["A"].start_station_id == "5137.10"
    assert rows["B"].started_at is None and rows["B"].start_station_id is None
    assert len(raw.where(f"{trips.CORRUPT} IS NOT NULL").collect()) == 1


def test_network_filter_needs_both_ends(spark):
    rows = spark.createDataFrame(
        [("jc", 2023, 1, "JC1", "hb2"), ("jc", 2023, 1, "JC1", None), ("jc", 2023, 1, "1", "2"),
         ("nyc", 2023, 1, "5", None), ("nyc", 2023, 1, "5", "Jc7"), ("other", 2023, 1, "a", "b")],
        "mode string, year int, month int, start_station_id string, end_station_id string",
    )
    strict = {tuple(r)[3:] for r in filters.filter_network(rows).collect()}
    assert strict == {("JC1", "hb2"), ("5", None), ("a", "b")}
    loose = {tuple(r)[3:] for r in filters.filter_network(rows, strict=False).collect()}
    assert loose == {("JC1", "hb2"), ("JC1", None), ("5", None), ("5", "Jc7"), ("a", "b")}


def test_crash_export(spark, tmp_path):
    path = tmp_path / "crashes.csv"
    path.write_text(
        "CRASH DATE,CRASH TIME,BOROUGH,LATITUDE,LONGITUDE,NUMBER OF PERSONS INJURED,NUMBER OF CYCLIST INJURED,NUMBER OF CYCLIST KILLED,COLLISION_ID,EXTRA\n"
        "01/11/2023,8:44,,40.7,-73.9,1,0,0,11,x\n2023-02-11,8:44,BRONX,,-73.9,1,0,0,12,x\nbad,8:44,BRONX,40.7,-73.9,1,0,0,13,x\n"
        "2023-02-12,9:00,QUEENS,40.6,-73.8,2,1,0,14,x\n2022-01-12,9:00,QUEENS,40.6,-73.8,2,1,0,15,x\n"
    )
    kept = filters.crashes_in(crashes.read_crash_export(spark, str(path)), [2023], [1, 2])
    assert {r.collision_id: r.number_of_cyclist_injured for r in kept.collect()} == {11: 0, 14: 1}
    points = {(r.year, r.month) for r in crashes.crash_points(kept).collect()}
    assert points == {(2023, 1), (2023, 2)}
    (tmp_path / "bad.csv").write_text("CRASH DATE,LATITUDE\n2023-01-01,1\n")
    with pytest.raises(ValueError):
        crashes.read_crash_export(spark, str(tmp_path / "bad.csv"))


def test_big_month_may_span_files(spark, tmp_path):
    rows = spark.range(1000).select(
        F.lit("nyc").alias("mode"), F.lit(2023).alias("year"), F.lit(1).alias("month"), F.col("id").cast("string").alias("ride_id")
    )
    write_months(rows, str(tmp_path / "t"))
    assert trips.read_trips(spark, str(tmp_path / "t")).count() == 1000
