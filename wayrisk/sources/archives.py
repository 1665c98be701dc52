"""Trip archives: ZIP files of CSV members, read as one distributed scan.

Listing, choosing and routing members are DataFrame steps over file names.  Only
opening an archive and parsing its CSV text happens in Python, per member, streamed
in blocks as Arrow batches; every member is its own task.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.functions.params import check_ingest_mode, clean_header, standard_name
from wayrisk.schemas import RAW_TRIP_COLUMNS

# How archives and members are named.
ARCHIVE_NAME = r"(?i)^(JC-)?(\d{4})(\d{2})?-[a-z]+-tripdata(?:\.csv)?\.zip$"
NESTED_NAME = r"(?i)^(?:JC-)?(\d{4})(\d{2})-[a-z]+-tripdata(?:\.csv)?\.zip$"
PART_NAME = r"(?i)^.*?-[a-z]+-tripdata_(\d+)\.csv$"
YEAR_MONTH = r"(20\d{2})(0[1-9]|1[0-2])"
JUNK_MEMBER = r"^__MACOSX/|(^|/)\._|(^|/)\.DS_Store$"
NESTING = 2
BLOCK_BYTES = 1 << 20


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


# --- choosing what to read -------------------------------------------------
def parse_manifest(paths: DataFrame, mode: str = "auto") -> DataFrame:
    """``path`` to mode, kind, year and month; other files are dropped.

    With ``auto`` a ``JC-`` prefix means jc; otherwise only names of the mode asked for count.
    """
    mode = check_ingest_mode(mode)
    name = _base_name(F.col("path"))
    part = lambda i: F.nullif(F.regexp_extract(name, ARCHIVE_NAME, i), F.lit(""))
    found = paths.select(
        "path",
        F.when(part(1).isNotNull(), "jc").otherwise("nyc").alias("mode"),
        F.when(part(3).isNotNull(), "monthly").otherwise("yearly").alias("kind"),
        part(2).cast("int").alias("year"),
        part(3).cast("int").alias("month"),
    ).where(F.col("year").isNotNull())
    return found if mode == "auto" else found.where(F.col("mode") == mode)


def archives_in(spark: SparkSession, folder: str, mode: str = "auto") -> DataFrame:
    """Manifest of a folder; only names are listed, no content is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder)
    return parse_manifest(listed.select("path"), mode)


def select_archives(manifest: DataFrame, years: Iterable[int], months: Iterable[int] | None = None) -> DataFrame:
    """Archives of the years; monthly ones only for the months."""
    chosen = manifest.where(F.col("year").isin(list(years)))
    if months is not None:
        chosen = chosen.where(F.col("month").isNull() | F.col("month").isin(list(months)))
    return chosen


def route_members(members: DataFrame) -> DataFrame:
    """Month of each member: the archive's, or for yearly archives the one in the member's name.

    Members of a yearly archive without a month, or of another year, are dropped.
    """
    name = _base_name(F.col("member"))
    pattern = lambda i: F.when(
        F.lower("member").endswith(".zip"), F.regexp_extract(name, NESTED_NAME, i)
    ).otherwise(F.regexp_extract(name, YEAR_MONTH, i))
    text = lambda i: F.nullif(pattern(i), F.lit("")).cast("int")
    yearly = F.col("kind") == "yearly"
    return (
        members.withColumns({"_y": text(1), "_m": text(2)})
        .where(~yearly | (F.col("_y") == F.col("year")))
        .withColumn("month", F.when(yearly, F.col("_m")).otherwise(F.col("month")))
        .drop("_y", "_m")
    )


def prefer_split_parts(members: DataFrame) -> DataFrame:
    """Where a month of an archive has numbered CSV parts, keep only those (``part`` gives their order)."""
    part = F.nullif(F.regexp_extract(_base_name(F.col("member")), PART_NAME, 1), F.lit("")).cast("int")
    of_month = W.partitionBy("path", "year", "month")  # members of one archive: a file list
    return (
        members.withColumn("part", part)
        .withColumn("_split", F.max(F.col("part").isNotNull()).over(of_month))
        .where(~F.col("_split") | F.col("part").isNotNull() | F.lower("member").endswith(".zip"))
        .drop("_split")
    )


def one_archive_per_month(members: DataFrame) -> DataFrame:
    """Monthly archives win over yearly ones, then the first path."""
    best = (
        members.groupBy("mode", "year", "month")
        .agg(F.min(F.struct((F.col("kind") != "monthly").alias("late"), "path")).alias("_b"))
        .select("mode", "year", "month", F.col("_b.path").alias("path"))
    )
    return members.join(best, ["mode", "year", "month", "path"], "left_semi")


def first_csv(members: DataFrame) -> DataFrame:
    """Older rule: a single CSV per archive, the first by name."""
    first = members.where(F.lower("member").endswith(".csv")).groupBy("path").agg(F.min("member").alias("member"))
    return members.join(first, ["path", "member"], "left_semi")


# --- reading inside tasks --------------------------------------------------
def _open(path: str):
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def usable_members(names: Sequence[str]) -> list[str]:
    """CSV and ZIP members without system junk; of names equal but for case the first."""
    seen: dict[str, str] = {}
    for name in names:
        plain = name.replace("\\", "/").strip()
        if not re.search(JUNK_MEMBER, plain) and plain.lower().endswith((".csv", ".zip")):
            seen.setdefault(plain.lower(), name)
    return list(seen.values())


def _header_of(stream) -> list[str]:
    line = stream.readline()
    try:
        text = line.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = line.decode("latin-1")
    return next(csv.reader([text]), [])


def encoding_of(stream) -> str:
    """UTF-8 if the whole stream is, else Latin-1, which any bytes are; read in blocks."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while block := stream.read(BLOCK_BYTES):
            decoder.decode(block)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf8"


def _csv_batches(stream, encoding: str) -> Iterator[tuple[list[str], pa.RecordBatch | None, list[str]]]:
    """Standardised header with text batches, and the rows whose length did not fit it."""
    names = [standard_name(n) for n in clean_header(_header_of(stream))]
    if not names:
        return
    ragged: list[str] = []

    def set_aside(row: pacsv.InvalidRow) -> str:
        ragged.append(row.text or "")
        return "skip"

    reader = pacsv.open_csv(
        stream,
        read_options=pacsv.ReadOptions(column_names=names, block_size=BLOCK_BYTES, use_threads=False, encoding=encoding),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=set_aside),
        convert_options=pacsv.ConvertOptions(
            column_types={n: pa.string() for n in names}, strings_can_be_null=True
        ),
    )
    for batch in reader:
        yield names, batch, []
    if ragged:
        yield names, None, ragged


def _tables_in(archive: zipfile.ZipFile, member: str, depth: int):
    if member.lower().endswith(".csv"):
        with archive.open(member) as stream:
            encoding = encoding_of(stream)
        with archive.open(member) as stream:
            try:
                yield from _csv_batches(io.BufferedReader(stream), encoding)
            except pa.ArrowInvalid as error:
                if "Empty CSV" not in str(error):
                    raise
    elif depth > 0:
        # a nested archive needs seeks, which a compressed member cannot do: the task's own scratch file
        with archive.open(member) as packed, tempfile.TemporaryFile() as scratch:
            shutil.copyfileobj(packed, scratch)
            with zipfile.ZipFile(scratch) as inner:
                for name in usable_members(inner.namelist()):
                    yield from _tables_in(inner, name, depth - 1)


RAW_SCHEMA = (
    "path string, member string, mode string, year int, month int, headers array<string>, corrupt string, "
    + ", ".join(f"{c} string" for c in RAW_TRIP_COLUMNS)
)


def _arrow_schema() -> pa.Schema:
    fixed = [
        ("path", pa.string()), ("member", pa.string()), ("mode", pa.string()), ("year", pa.int32()),
        ("month", pa.int32()), ("headers", pa.list_(pa.string())), ("corrupt", pa.string()),
    ]
    return pa.schema(fixed + [(c, pa.string()) for c in RAW_TRIP_COLUMNS])


def _shaped(row: dict, names: list[str], batch: pa.RecordBatch | None, ragged: list[str]) -> pa.RecordBatch:
    schema, n = _arrow_schema(), len(ragged) if batch is None else batch.num_rows
    headers = pa.array([names], pa.list_(pa.string())).take(pa.array(np.zeros(n, np.int32)))
    columns = []
    for f in schema:
        if f.name in row:
            columns.append(pa.array([row[f.name]] * n, f.type))
        elif f.name == "headers":
            columns.append(headers)
        elif f.name == "corrupt":
            columns.append(pa.array(ragged, f.type) if batch is None else pa.nulls(n, f.type))
        elif batch is not None and f.name in names:
            columns.append(batch.column(names.index(f.name)))
        else:
            columns.append(pa.nulls(n, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def list_members(archives: DataFrame) -> DataFrame:
    """One row per usable member of every archive (reads only the central directories)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with _open(row["path"]) as stream, zipfile.ZipFile(stream) as archive:
                    rows += [{**row, "member": m} for m in usable_members(archive.namelist())]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("member", pa.string())))

    spread = archives.select("path", "mode", "kind", "year", "month")
    return spread.repartition(max(1, min(spread.count(), 1000))).mapInArrow(
        look, "path string, mode string, kind string, year int, month int, member string"
    )


def read_members(members: DataFrame) -> DataFrame:
    """Text rows of the members, each with its file's header (``headers``); misfit rows in ``corrupt``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as stream, zipfile.ZipFile(stream) as archive:
                    for names, found, ragged in _tables_in(archive, row["member"], NESTING):
                        yield _shaped(row, names, found, ragged)

    work = members.select("path", "member", "mode", "year", "month")
    return work.repartition(max(1, min(work.count(), 20_000))).mapInArrow(parse, RAW_SCHEMA)
