"""Archives to the partitioned canonical trip table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayrisk.functions.params import check_ingest_request
from wayrisk.operators.canonical import canonical_trips, older_trip_features
from wayrisk.operators.filters import filter_network, plausible_duration, within_month
from wayrisk.session import staged, stored
from wayrisk.sinks.partitions import without_existing_months, write_months
from wayrisk.sources import archives as A


def planned_members(
    spark: SparkSession, folder: str, years: Sequence[int], months: Sequence[int], mode: str
) -> DataFrame:
    """Members to read, one archive per month."""
    mode = check_ingest_request(years, months, mode)
    manifest = A.select_archives(A.archives_in(spark, folder, mode), years, months)
    # a list of file names: kept, because it is both counted and read
    members = stored(A.list_members(manifest))
    routed = A.route_members(members).where(F.col("month").isin(list(months)))
    return A.one_archive_per_month(A.prefer_split_parts(routed))


def ingest(
    spark: SparkSession,
    folder: str,
    out: str,
    years: Sequence[int],
    months: Sequence[int],
    mode: str = "auto",
    force: bool = False,
    keep_null_times: bool = False,
    compression: str = "none",
) -> list[tuple[str, str, int]]:
    """Read the archives once, canonicalise, keep each network's own trips, write by month.

    Rows that do not fit their header are written to the quarantine table beside the output
    (``path, member, corrupt``) and counted per member in the returned rows.
    """
    members = planned_members(spark, folder, years, months, mode)
    if not force:
        members = without_existing_months(members, out)
    # staged: the network filter and the quarantine read it again, unzipping is paid once
    with staged(A.read_members(members)) as raw:
        good = raw.where(F.col("corrupt").isNull()).drop("path", "member", "corrupt")
        trips = canonical_trips(good, headers="headers")
        write_months(within_month(filter_network(trips), keep_null_times), out, compression)
        bad = raw.where(F.col("corrupt").isNotNull()).select("path", "member", "corrupt")
        counts = bad.groupBy("path", "member").count().orderBy("path", "member").collect()  # a row per damaged member
        if counts:
            bad.write.mode("append").parquet(quarantine(out))
    return [tuple(r) for r in counts]


def written_months(trips: DataFrame, out: str, keep_null_times: bool = False, compression: str = "none") -> dict[str, int]:
    """Write the months of ``trips``; ``rows``, ``kept`` and ``untimed`` are counted by the write itself.

    ``untimed`` rows have no start and are left out unless they are to be kept.
    """
    seen = Observation()
    timed = F.col("started_at").isNotNull()
    facts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(timed, 1)).alias("kept"), F.count(F.when(~timed, 1)).alias("untimed")]
    counted = trips.observe(seen, *facts)
    write_months(counted if keep_null_times else counted.where(timed), out, compression)
    found = {k: int(v) for k, v in seen.get.items()}
    return found | {"kept": found["rows"]} if keep_null_times else found


def quarantine(out: str) -> str:
    """Where rows go that do not fit their header."""
    return f"{out.rstrip('/')}-quarantine"


def ingest_older_layer(spark: SparkSession, folder: str, out: str, months: Sequence[int] | None = None) -> None:
    """First-generation layer: one CSV per monthly archive, plausible durations, trip features."""
    manifest = A.archives_in(spark, folder, "auto").where(F.col("kind") == "monthly")
    if months is not None:
        manifest = manifest.where(F.col("month").isin(list(months)))
    raw = A.read_members(A.first_csv(A.list_members(manifest))).where(F.col("corrupt").isNull())
    trips = canonical_trips(raw.drop("path", "member", "corrupt"), headers="headers")
    write_months(plausible_duration(older_trip_features(trips)), out, keys=["year", "month"])
