"""Sources and sinks: tables derived from the given ones are written to the shared folder and read back."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk import schemas
from wayrisk.catalog.registry import query
from wayrisk.operators.canonical import canonical_trips
from wayrisk.plans import report
from wayrisk.plans.ingest import written_months
from wayrisk.session import ensure_checkpoint_dir, stored
from wayrisk.sinks.partitions import write_months, write_table
from wayrisk.sources import archives as A
from wayrisk.sources import crashes as C
from wayrisk.sources import tables, trips

MONTH = ["mode", "year", "month"]


def _folder(v, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- archives ----------------------------------------------------------------
_TEXTS = ["ride_id", "started_at", "ended_at", "start_station_id", "start_station_name", "end_station_id", "start_lat", "start_lng"]
LATIN_YEAR = 1995


def _write_archives(rows: DataFrame, folder: str) -> None:
    """One archive a month with one CSV member, streamed; a line that misfits its header at each end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        at, archive, file, member = None, None, None, None

        def close() -> None:
            if archive is not None:
                member.write(b"one,field too few\n")
                member.close(), archive.close(), file.close()

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["mode"], row["year"], row["month"])
                if key != at:
                    close()
                    at, name = key, f"{'JC-' if key[0] == 'jc' else ''}{key[1]}{key[2]:02d}-bike-tripdata"
                    file = system.open_output_stream(f"{root}/{name}.zip")
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                    member = archive.open(f"{name}.csv", "w", force_zip64=True)
                    member.write((",".join(_TEXTS) + "\n").encode())
                out = io.StringIO()
                csv.writer(out, lineterminator="\n").writerow([row[c] if row[c] is not None else "" for c in _TEXTS])
                member.write(out.getvalue().encode("latin-1" if at[1] == LATIN_YEAR else "utf-8"))
        close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([], pa.int32())})

    system_folder = folder if "://" in folder else folder.removeprefix("file:")
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + system_folder)
    system.create_dir(root, recursive=True)
    rows.repartition(*MONTH).sortWithinPartitions(*MONTH).mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()


@query(
    "src1_archive_roundtrip",
    f"""SELECT mode, year, month, count(*) AS trips, count(started_at) AS timed, count(DISTINCT start_station_name) AS names,
          max(CASE WHEN year = {LATIN_YEAR} THEN start_station_name || ' é' ELSE start_station_name || ' ü' END) AS last_name,
          min(start_station_id) AS first_station, CAST(min(started_at) AS VARCHAR) AS first_start, 1 AS misfits
        FROM trips GROUP BY mode, year, month""",
)
def _(v):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    sign = F.when(F.col("year") == LATIN_YEAR, F.lit(" é")).otherwise(F.lit(" ü"))
    rows = v.trips.select(
        *MONTH, F.col("trip_no").cast("string").alias("ride_id"), text("started_at").alias("started_at"), text("ended_at").alias("ended_at"),
        "start_station_id", F.concat("start_station_name", sign).alias("start_station_name"), "end_station_id",
        F.col("start_lat").cast("string").alias("start_lat"), F.col("start_lng").cast("string").alias("start_lng"),
    )
    folder = _folder(v, "archives")
    _write_archives(rows, folder)
    manifest = A.archives_in(v.spark, folder)
    members = stored(A.list_members(manifest))
    raw = stored(A.read_members(A.one_archive_per_month(A.prefer_split_parts(A.route_members(members)))))
    good = canonical_trips(raw.where(F.col("corrupt").isNull()).drop("path", "member", "corrupt"), headers="headers")
    misfits = raw.where(F.col("corrupt").isNotNull()).groupBy(*MONTH).agg(F.count(F.lit(1)).cast("int").alias("misfits"))
    found = good.groupBy(*MONTH).agg(
        F.count(F.lit(1)).alias("trips"), F.count("started_at").alias("timed"), F.count_distinct("start_station_name").alias("names"),
        F.max("start_station_name").alias("last_name"), F.min("start_station_id").alias("first_station"), text(F.min("started_at")).alias("first_start"),
    )
    return found.join(misfits, MONTH)


# --- trip tables ---------------------------------------------------------------
def _canonical(v) -> DataFrame:
    """The trip view in the layout of the stored trip table."""
    have = set(v.trips.columns)
    columns = {f.name: F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in schemas.TRIP_TABLE.fields}
    columns["ride_id"] = F.col("trip_no").cast("string")
    return v.trips.select(*[c.alias(name) for name, c in columns.items()])


_BY_MONTH = "count(*) AS trips, count(started_at) AS timed, sum(trip_no) AS ids"


@query("snk1_month_roundtrip", f"SELECT mode, year, month, {_BY_MONTH} FROM trips GROUP BY mode, year, month")
def _(v):
    folder, rows = _folder(v, "trips"), _canonical(v)
    write_months(rows, folder)
    write_months(rows.where(F.col("month") <= 6), folder)  # again: replaces these months, leaves the others
    found = trips.read_trips(v.spark, folder)
    return found.groupBy(*MONTH).agg(F.count(F.lit(1)).alias("trips"), F.count("started_at").alias("timed"), F.sum(F.col("ride_id").cast("long")).alias("ids"))


@query(
    "snk1_quarantine_counts",
    """SELECT count(*) AS trips, count(*) FILTER (WHERE started_at IS NOT NULL) AS kept, count(*) FILTER (WHERE started_at IS NULL) AS untimed,
         count(*) FILTER (WHERE started_at IS NOT NULL) AS stored FROM trips""",
)
def _(v):
    folder = _folder(v, "observed")
    counts = written_months(_canonical(v), folder)
    table = v.spark.createDataFrame([(counts["rows"], counts["kept"], counts["untimed"])], "trips long, kept long, untimed long")
    return table.join(trips.read_trips(v.spark, folder).agg(F.count(F.lit(1)).alias("stored")))


@query("src10_trip_scan", "SELECT mode, year, count(*) AS trips, count(DISTINCT start_station_id) AS stations FROM trips GROUP BY mode, year")
def _(v):
    folder = _folder(v, "trips")
    write_months(_canonical(v), folder)
    parts = [trips.read_trips(v.spark, folder, mode) for mode in ("nyc", "jc")]
    return parts[0].unionByName(parts[1]).groupBy("mode", "year").agg(F.count(F.lit(1)).alias("trips"), F.count_distinct("start_station_id").alias("stations"))


@query("src11_footer_counts", "SELECT mode, year, month, count(*) AS trips FROM trips GROUP BY mode, year, month")
def _(v):
    folder = _folder(v, "trips")
    write_months(_canonical(v), folder)
    return trips.month_row_counts(v.spark, folder)


_FILLED = ["mode", "year", "month", "started_at", "ended_at", "start_station_id", "start_station_name", "end_station_id", "start_lat"]


@query("src12_column_sets", "SELECT unnest([" + ", ".join(f"'{c}'" for c in _FILLED) + "]) AS name, unnest([" + ", ".join(f"count({c})" for c in _FILLED) + "]) AS filled FROM trips")
def _(v):
    folder = _folder(v, "trips")
    write_months(_canonical(v), folder)
    names = [c for c in trips.column_set(v.spark, folder) if c in _FILLED]
    counts = trips.read_trips(v.spark, folder).agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in names])).alias("r")).select("r.*")


# --- crash export ----------------------------------------------------------------
@query(
    "src8_crash_export",
    "SELECT collision_id, CAST(CAST(crash_date AS DATE) AS VARCHAR) AS crash_day, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CAST(collision_id % 5 AS INT) AS injured FROM crashes",
)
def _(v):
    names = {"crash_time": F.lit("1:05"), "borough": F.lit(None).cast("string"), "number_of_persons_injured": F.col("collision_id") % 5}
    rows = v.crashes.select(
        *[
            names.get(c, F.date_format("crash_date", "MM/dd/yyyy") if c == "crash_date" else F.col(c) if c in v.crashes.columns else F.lit(0)).alias(c.upper().replace("_", " "))
            for c in reversed(schemas.CRASH_COLUMNS)
        ],
        F.lit("x").alias("VEHICLE TYPE CODE 1"),
    )
    folder = _folder(v, "crash-export")
    write_table(rows, folder, "csv")
    read = C.read_crash_export(v.spark, folder)
    return read.select(
        "collision_id", F.date_format("crash_date", "yyyy-MM-dd").alias("crash_day"), "latitude", "longitude", F.col("number_of_persons_injured").alias("injured")
    )


# --- runs -------------------------------------------------------------------------
_RUN_MONTH = "SELECT run_tag, mode, year, month, trips FROM run_month"


def _write_runs(v, form: str) -> str:
    """A folder for each run; one more run whose tables lack the trips."""
    root, by_month = _folder(v, "runs"), stored(v.runs["trips_by_month"])
    tags = [r["run_tag"] for r in by_month.select("run_tag").distinct().collect()]  # the runs of the view
    for tag in tags:
        mine = by_month.where(F.col("run_tag") == tag).select(*MONTH, "trips")
        write_table(mine.withColumn("trips_per_day", F.lit(None).cast("double")), f"{root}/{tag}/trips_by_month", form)
    broken = by_month.select(*MONTH, F.lit(None).cast("long").alias("trips"), F.lit(1.0).alias("trips_per_day"))
    write_table(broken, f"{root}/yBroken_mode/trips_by_month", form)
    write_table(by_month, f"{root}/yOther_mode/another_table", form)
    return root


@query("src14_runs_read_together", _RUN_MONTH)
def _(v):
    return tables.read_runs(v.spark, _write_runs(v, "parquet"), "trips_by_month", schemas.USAGE_MONTH).select("run_tag", *MONTH, "trips")


@query("snk3_csv_tables", _RUN_MONTH)
def _(v):
    return tables.read_runs(v.spark, _write_runs(v, "csv"), "trips_by_month", schemas.USAGE_MONTH, form="csv").select("run_tag", *MONTH, "trips")


@query("src13_table_by_schema", "SELECT mode, year, trips FROM by_year")
def _(v):
    folder = _folder(v, "by-year")
    write_table(v.usage["trips_by_year"], folder, "csv")
    assert tables.read_table(v.spark, f"{folder}-absent", optional=True) is None
    return tables.read_table(v.spark, folder, schemas.USAGE_YEAR, form="csv")


@query(
    "src15_finest_risk",
    "SELECT 'year' AS grain, mode, year, start_station_id, trips FROM risk_year UNION ALL SELECT 'lifetime', mode, NULL, start_station_id, trips FROM risk_life",
)
def _(v):
    folder, found = _folder(v, "risk"), []
    for grain in ("lifetime", "year"):
        write_table(v.risk(grain), f"{folder}/station_risk_{grain}")
        stored_tables = {g: tables.read_table(v.spark, f"{folder}/station_risk_{g}", optional=True) for g in ("lifetime", "year", "year_month")}
        chosen, table = tables.finest_risk(stored_tables)
        year = F.col("year").cast("int") if "year" in table.columns else F.lit(None).cast("int")
        found.append(table.select(F.lit(chosen).alias("grain"), "mode", year.alias("year"), "start_station_id", "trips"))
    return found[0].unionByName(found[1])


@query("src16_scorecard_by_radius", "SELECT 500 AS radius, mode, start_station_id, exposure_trips FROM score UNION ALL SELECT 1000, mode, start_station_id, exposure_trips FROM score")
def _(v):
    folder, cards = _folder(v, "cards"), {}
    for radius in (500, 1000):
        write_table(v.score().withColumn("radius", F.lit(radius)), f"{folder}/scorecard_{radius}m")
        cards[radius] = tables.read_table(v.spark, f"{folder}/scorecard_{radius}m")
    chosen = [tables.scorecard_for(cards, r) for r in ("250m", "auto")]  # one that is missing: 500 m; the largest
    return chosen[0].unionByName(chosen[1]).select("radius", "mode", "start_station_id", "exposure_trips")


@query("src17_preferred_table", "SELECT mode, year, trips FROM by_year WHERE mode = 'nyc' UNION ALL SELECT mode, year, trips FROM by_year WHERE mode = 'jc' AND year = 1996")
def _(v):
    folder, by_year = _folder(v, "combined"), v.usage["trips_by_year"]
    write_table(by_year, f"{folder}/all")
    write_table(by_year.where(F.col("year") <= 1996), f"{folder}/run")
    both = tables.read_table(v.spark, f"{folder}/run"), tables.read_table(v.spark, f"{folder}/all")
    return tables.preferred_table(*both, "nyc").unionByName(tables.preferred_table(*both, "jc", years=[1996]))


# --- reports, metrics, predictions ---------------------------------------------------
@query("snk4_scorecard_roundtrip", "SELECT mode, start_station_id, exposure_trips, crash_count, round(eb_risk_rate_per_100k_trips, 6) AS eb_risk_rate_per_100k_trips FROM score")
def _(v):
    folder, card = _folder(v, "card"), v.stored_score()
    write_table(card, folder, "csv")
    names = ["mode", "start_station_id", "exposure_trips", "crash_count", report.EB]
    return tables.read_table(v.spark, folder, card.schema, form="csv").select(*names)


@query(
    "snk5_nested_metrics",
    """SELECT mode, count(*) AS rows, count(DISTINCT station_id) AS stations, round(avg(abs(y_label - coalesce(y_trips_lag_1, 0))), 6) AS mae
       FROM features WHERE y_label IS NOT NULL GROUP BY mode""",
)
def _(v):
    from wayrisk.operators import panel as P
    from wayrisk.plans import forecast

    rows = forecast.labelled_rows(P.station_panel(v.exposure))
    facts = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("station_id").alias("stations"), P.mae(F.col("y_label"), F.col("baseline_lag1_pred")).alias("mae")
    )
    results = [
        forecast.ModeResult(r["mode"], {"mode": r["mode"], "model": "lag 1", "split_mode": "none", "rows_train": r["rows"], "stations_train": r["stations"], "mae_model": r["mae"]}, None, None)
        for r in facts.collect()  # a row a mode
    ]
    folder, table = _folder(v, "metrics"), forecast.metrics_table(v.spark, results)
    write_table(table, folder, "json")
    read = v.spark.read.schema(table.schema).json(folder)
    return read.select("mode", F.col("rows.rows_train").cast("long").alias("rows"), F.col("stations.stations_train").cast("long").alias("stations"), F.col("test.mae_model").alias("mae"))


@query("snk6_predictions_by_mode", "SELECT mode, station_id, date_index, y_label AS y_true_next_month FROM features WHERE y_label IS NOT NULL")
def _(v):
    from wayrisk.operators import panel as P
    from wayrisk.plans import forecast

    rows = forecast.labelled_rows(P.station_panel(v.exposure)).withColumns({"y_pred_next_month": F.col("baseline_lag1_pred"), "split": F.lit("test")})
    table, folder = forecast.prediction_table(rows, ["test"]), _folder(v, "predictions")
    write_table(table, folder, by=["mode"])
    return v.spark.read.schema(table.schema).parquet(folder).select("mode", "station_id", "date_index", "y_true_next_month")
