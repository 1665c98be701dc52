"""Text and file-name operators, on texts made from order rows in both engines alike."""

from pyspark.sql import functions as F

from wayrisk.catalog.registry import query, r6
from wayrisk.functions import expr as X
from wayrisk.operators import canonical, filters
from wayrisk.schemas import RAW_TRIP_COLUMNS
from wayrisk.sources import archives, crashes

_P = lambda part, n=2: f"lpad(CAST({part}(o_orderdate) AS STRING), {n}, '0')"
_Y, _M, _D = _P("year", 4), _P("month"), _P("day")
_M1, _D1 = "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)"
_H, _MI, _S = (f"lpad(CAST(o_orderkey % {n} AS STRING), 2, '0')" for n in (24, 60, 59))
_CLOCK = f"{_H} || ':' || {_MI} || ':' || {_S}"
_DAY = f"{_Y} || '-' || {_M} || '-' || {_D}"

# nine layouts of one instant: (text, minutes to subtract to reach UTC, keeps seconds)
_LAYOUTS = [
    (f"{_DAY} || ' ' || {_CLOCK}", 0, True),
    (f"{_DAY} || 'T' || {_CLOCK}", 0, True),
    (f"{_DAY} || 'T' || {_CLOCK} || '.250Z'", 0, True),
    (f"{_DAY} || ' ' || {_CLOCK} || '+0130'", 90, True),
    (f"'  ' || {_DAY} || 'T' || {_CLOCK} || '-05:00 '", -300, True),
    (f"{_M1} || '/' || {_D1} || '/' || {_Y} || ' ' || {_CLOCK}", 0, True),
    (f"{_M1} || '/' || {_D1} || '/' || {_Y} || ' ' || {_H} || ':' || {_MI}", 0, False),
    (f"{_DAY} || ' ' || {_CLOCK} || '.203417'", 0, True),
    (f"{_DAY} || ' ' || {_CLOCK} || ' UTC'", 0, True),
]
_N = len(_LAYOUTS) + 1
_TEXT = "CASE o_orderkey % " + str(_N) + " " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _, _) in enumerate(_LAYOUTS)) + " ELSE 'n/a ' || o_orderkey END"
_MINUS = "CASE o_orderkey % " + str(_N) + " " + " ".join(f"WHEN {i} THEN {m}" for i, (_, m, _) in enumerate(_LAYOUTS)) + " END"
_SECONDS = "CASE o_orderkey % " + str(_N) + " " + " ".join(f"WHEN {i} THEN {int(s)}" for i, (_, _, s) in enumerate(_LAYOUTS)) + " END"
_INSTANT = f"""o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT))
    + to_seconds(CAST((o_orderkey % 59) * {_SECONDS} AS INT)) - to_minutes({_MINUS})"""


def _orders(v, **columns: str):
    return v.table("orders").select("o_orderkey", *[F.expr(text).alias(name) for name, text in columns.items()])


@query("prj9_timestamp_text", f"SELECT o_orderkey, {_INSTANT} AS ts FROM orders")
def _(v):
    return _orders(v, text=_TEXT).select("o_orderkey", X.timestamp_text(F.col("text")).alias("ts"))


_TYPE = """CASE o_orderkey % 5 WHEN 0 THEN 'Subscriber' WHEN 1 THEN ' customer ' WHEN 2 THEN 'CUSTOMER' WHEN 3 THEN 'Dependent' END"""


@query(
    "prj6_rider_class",
    f"""SELECT o_orderkey, CASE lower(trim(t)) WHEN 'subscriber' THEN 'member' WHEN 'customer' THEN 'casual' END AS member_casual
        FROM (SELECT o_orderkey, {_TYPE} AS t FROM orders)""",
)
def _(v):
    return _orders(v, t=_TYPE).select("o_orderkey", X.rider_class(F.col("t")).alias("member_casual"))


@query(
    "prj7_rider_class_exact",
    f"""SELECT o_orderkey, CASE t WHEN 'Subscriber' THEN 'member' WHEN 'Customer' THEN 'casual' ELSE t END AS member_casual
        FROM (SELECT o_orderkey, {_TYPE} AS t FROM orders)""",
)
def _(v):
    return _orders(v, t=_TYPE).select("o_orderkey", X.rider_class_exact(F.col("t")).alias("member_casual"))


_ID_PARTS = [
    f"{_DAY} || ' ' || {_CLOCK}",
    "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END",
    "CAST(o_custkey AS STRING)",
    "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END",
]


@query(
    "prj8_ride_digest",
    "SELECT o_orderkey, md5(" + " || '|' || ".join(f"coalesce({p}, '')" for p in _ID_PARTS) + " || '|') AS ride_id FROM orders",
)
def _(v):
    rows = _orders(v, **{f"p{i}": t for i, t in enumerate(_ID_PARTS)}, missing="CAST(NULL AS STRING)")
    parts = [F.col(f"p{i}") for i in range(len(_ID_PARTS))] + [F.col("missing")]
    return rows.select("o_orderkey", X.ride_digest(parts).alias("ride_id"))


_LEGACY = {
    "Trip Duration": "CAST(o_custkey AS STRING)",
    "Start Time": f"{_M1} || '/' || {_D1} || '/' || {_Y} || ' ' || {_CLOCK}",
    "Stop Time": f"{_DAY} || ' ' || {_CLOCK}",
    "Start Station ID": "CAST(o_orderkey % 500 AS STRING)",
    "Start Station Name": "'Station ' || CAST(o_orderkey % 500 AS STRING)",
    "Start Station Latitude": "CAST(o_orderkey % 90 AS STRING)",
    "Bike ID": "CAST(o_custkey % 77 AS STRING)",
    "User Type": _TYPE,
}
_SQL_STOP = "o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) + to_seconds(CAST(o_orderkey % 59 AS INT))"


@query(
    "prj5_canonical_legacy_era",
    f"""SELECT o_orderkey, md5(started || '|' || stopped || '|' || bike || '|' || sid || '||' || dur) AS ride_id, NULL AS rideable_type,
        {_SQL_STOP} AS started_at, {_SQL_STOP} AS ended_at, sid AS start_station_id, 'Station ' || sid AS start_station_name,
        NULL AS end_station_id, NULL AS end_station_name, CAST(o_orderkey % 90 AS STRING) AS start_lat, NULL AS start_lng,
        NULL AS end_lat, NULL AS end_lng,
        CASE lower(trim(t)) WHEN 'subscriber' THEN 'member' WHEN 'customer' THEN 'casual' END AS member_casual, t AS usertype,
        bike AS bike_id, dur AS tripduration_seconds, NULL AS gender, NULL AS birth_year
        FROM (SELECT o_orderkey, o_orderdate, {_LEGACY['Start Time']} AS started, {_LEGACY['Stop Time']} AS stopped,
          {_LEGACY['Bike ID']} AS bike, {_LEGACY['Start Station ID']} AS sid, {_LEGACY['Trip Duration']} AS dur, {_TYPE} AS t FROM orders)""",
)
def _(v):
    return canonical.canonical_trips(canonical.standardise_columns(_orders(v, **_LEGACY)))


@query(
    "prj5_canonical_mixed_headers",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'R' || o_orderkey ELSE
          md5({_DAY} || '||' || '|' || '||') END AS ride_id,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN lower(trim({_TYPE})) = 'subscriber' THEN 'member'
             WHEN lower(trim({_TYPE})) = 'customer' THEN 'casual' END AS member_casual FROM orders""",
)
def _(v):
    # even rows come from a modern file, odd ones from a legacy file; usertype texts of modern rows must not count
    rows = _orders(
        v,
        headers="CASE WHEN o_orderkey % 2 = 0 THEN array('ride_id', 'started_at', 'member_casual') ELSE array('starttime', 'usertype') END",
        ride_id="CASE WHEN o_orderkey % 2 = 0 THEN concat('R', o_orderkey) END",
        started_at=f"CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} END",
        starttime=f"CASE WHEN o_orderkey % 2 = 1 THEN {_DAY} END",
        member_casual="CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END",
        usertype=_TYPE,
        **{
            c: "CAST(NULL AS STRING)"
            for c in RAW_TRIP_COLUMNS
            if c not in ("ride_id", "started_at", "starttime", "member_casual", "usertype")
        },
    )
    return canonical.canonical_trips(rows, headers="headers").select("o_orderkey", "ride_id", "member_casual")


_NUMBER = """CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN ' ' || CAST(o_custkey AS STRING) || '.5 ' WHEN 2 THEN 'abc'
    WHEN 3 THEN '' WHEN 4 THEN '-' || CAST(o_custkey AS STRING) END"""
_READ = "CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 0.5::DOUBLE WHEN 4 THEN -o_custkey END"


@query(
    "prj11_prj12_number_text",
    f"SELECT o_orderkey, CAST({_READ} AS DOUBLE) AS number, CAST(trunc(coalesce({_READ}, 0)) AS BIGINT) AS whole FROM orders",
)
def _(v):
    return _orders(v, t=_NUMBER).select("o_orderkey", X.number("t").alias("number"), X.whole("t").alias("whole"))


@query(
    "prj10_older_trip_features",
    f"""SELECT trip_no, {r6('m').replace('AS m', 'AS trip_minutes')}, hour(started_at) AS hour, dayname(started_at) AS weekday,
        CAST(started_at AS DATE) AS date FROM (SELECT *, date_diff('microsecond', started_at, ended_at) / 60e6 AS m FROM trips)""",
)
def _(v):
    rows = v.trips.withColumns({"member_casual": F.lit(None).cast("string"), "usertype": F.lit("Subscriber")})
    return canonical.older_trip_features(rows).select("trip_no", "trip_minutes", "hour", "weekday", "date")


@query(
    "flt6_plausible_duration",
    """SELECT mode, year, count(*) AS trips FROM trips WHERE date_diff('second', started_at, ended_at) / 60 BETWEEN 1 AND 180
       GROUP BY mode, year""",
)
def _(v):
    rows = v.trips.withColumns({"member_casual": F.lit(None).cast("string"), "usertype": F.lit("Subscriber")})
    kept = filters.plausible_duration(canonical.older_trip_features(rows))
    return kept.groupBy("mode", "year").agg(F.count(F.lit(1)).alias("trips"))


@query(
    "src6_null_tokens",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'none' END AS value FROM orders""",
)
def _(v):
    text = "CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'none' WHEN 2 THEN '#N/A' ELSE 'nan' END"
    return _orders(v, t=text).select("o_orderkey", X.null_token(F.col("t")).alias("value"))


@query(
    "src9_crash_points",
    f"""SELECT CAST(o_orderdate AS TIMESTAMP) AS crash_date, round(o_orderkey / 1000, 6) AS latitude, round(-74.0::DOUBLE, 6) AS longitude,
        year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0""",
)
def _(v):
    table = _orders(
        v,
        **{
            "CRASH DATE": f"CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN {_DAY} ELSE {_M} || '/' || {_D} || '/' || {_Y} END",
            "LATITUDE": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey / 1000 AS STRING) END",
            "LONGITUDE": "'-74.0'",
        },
    )
    return crashes.crash_points(table.drop("o_orderkey"))


# --- file names --------------------------------------------------------------
_FILE = f"""CASE o_orderkey % 6 WHEN 0 THEN '/raw/' || {_Y} || {_M} || '-city-tripdata.csv.zip' WHEN 1 THEN '/raw/JC-' || {_Y} || {_M} || '-city-tripdata.zip'
    WHEN 2 THEN '/raw/' || {_Y} || '-city-tripdata.zip' WHEN 3 THEN '/raw/jc-' || {_Y} || '-city-tripdata.csv.zip'
    WHEN 4 THEN '/raw/' || {_Y} || {_M} || '-notes.zip' ELSE '/raw/x' || {_Y} || '-city-tripdata.zip' END"""
_MANIFEST = """SELECT o_orderkey % 6 AS f, CASE WHEN o_orderkey % 6 IN (1, 3) THEN 'jc' ELSE 'nyc' END AS mode,
    CASE WHEN o_orderkey % 6 IN (0, 1) THEN 'monthly' ELSE 'yearly' END AS kind, year(o_orderdate) AS year,
    CASE WHEN o_orderkey % 6 IN (0, 1) THEN month(o_orderdate) END AS month FROM orders WHERE o_orderkey % 6 < 4"""


def _manifest(v, mode="auto"):
    return archives.parse_manifest(_orders(v, path=_FILE).select("path"), mode)


@query("src3_manifest", f"SELECT mode, kind, year, month, count(*) AS files FROM ({_MANIFEST}) GROUP BY ALL")
def _(v):
    return _manifest(v).groupBy("mode", "kind", "year", "month").agg(F.count(F.lit(1)).alias("files"))


@query("src3_manifest_one_mode", f"SELECT mode, kind, year, month, count(*) AS files FROM ({_MANIFEST}) WHERE mode = 'jc' GROUP BY ALL")
def _(v):
    return _manifest(v, "jc").groupBy("mode", "kind", "year", "month").agg(F.count(F.lit(1)).alias("files"))


@query(
    "src4_manifest_selection",
    f"""SELECT mode, kind, year, month, count(*) AS files FROM ({_MANIFEST}) WHERE year IN (1996, 1997) AND (month IS NULL OR month IN (2, 3))
        GROUP BY ALL""",
)
def _(v):
    chosen = archives.select_archives(_manifest(v), [1996, 1997], [2, 3])
    return chosen.groupBy("mode", "kind", "year", "month").agg(F.count(F.lit(1)).alias("files"))


# names need years from 2000 on
_Y20 = "CAST(year(o_orderdate) + 20 AS STRING)"
_MEMBER = f"""CASE o_orderkey % 4 WHEN 0 THEN 'd/' || {_Y20} || {_M} || '-city-tripdata_' || CAST(o_orderkey % 3 AS STRING) || '.csv'
    WHEN 1 THEN 'd/' || {_Y20} || {_M} || '-city-tripdata.csv' WHEN 2 THEN {_Y20} || {_M} || '-city-tripdata.zip' ELSE 'readme.csv' END"""


def _members(v):
    """Members of yearly archives for three years, whose names carry the order's month."""
    rows = _orders(v, member=_MEMBER, year="2016 + CAST(o_custkey % 3 AS INT)")
    return rows.select(
        F.concat(F.lit("/raw/"), F.col("year").cast("string"), F.lit("-city-tripdata.zip")).alias("path"),
        F.lit("nyc").alias("mode"),
        F.lit("yearly").alias("kind"),
        "year",
        F.lit(None).cast("int").alias("month"),
        "member",
    ).distinct()


_ROUTED = f"""SELECT DISTINCT {_MEMBER} AS member, year(o_orderdate) + 20 AS year, month(o_orderdate) AS month, o_orderkey % 4 AS f FROM orders
    WHERE year(o_orderdate) + 20 = 2016 + o_custkey % 3 AND o_orderkey % 4 < 3"""


@query("src5_yearly_month_routing", f"SELECT member, year, month FROM ({_ROUTED})")
def _(v):
    return archives.route_members(_members(v)).select("member", "year", "month")


@query(
    "src2_split_part_selection",
    f"""SELECT member, year, month FROM (SELECT *, max(f = 0) OVER (PARTITION BY year, month) AS split FROM ({_ROUTED}))
        WHERE NOT split OR f IN (0, 2)""",
)
def _(v):
    return archives.prefer_split_parts(archives.route_members(_members(v))).select("member", "year", "month")


@query(
    "src7_first_csv",
    f"""SELECT min(member) AS member, 2016 + o_custkey % 3 AS year FROM (SELECT {_MEMBER} AS member, o_custkey, o_orderkey FROM orders)
        WHERE o_orderkey % 4 <> 2 GROUP BY ALL""",
)
def _(v):
    return archives.first_csv(_members(v)).select("member", "year")


@query(
    "set5_months_in_archives",
    f"SELECT DISTINCT year, month FROM ({_ROUTED})",
)
def _(v):
    return archives.route_members(_members(v)).select("year", "month").distinct()
