"""What the text operators share: per-task text functions over Arrow batches, and files
in the shared folder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.session import ensure_checkpoint_dir

#: Texts handed to a per-task function at once; bounds its temporary lists.
CHUNK_ROWS = 256

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, *LOWER)


def map_column(
    df: DataFrame,
    keep: list[str],
    column: str,
    start: Callable[[], Callable[[list], list]],
    fields: list[tuple[str, str, pa.DataType]],
) -> DataFrame:
    """Columns ``keep`` plus ``fields`` computed from ``column`` in Python tasks.

    ``start()`` is called once a task and returns a function from a list of values
    (null as None) to one list or Arrow array per field (name, Spark type, Arrow type).
    Columns of ``keep`` with the name of a field give way to it.
    """
    keep = [c for c in keep if c not in {n for n, _, _ in fields}]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{n}` {t}" for n, t, _ in fields])
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                made = work(part.column(kept).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, _, kind) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(kept)] + made, names=[*keep, *[n for n, _, _ in fields]])

    return df.select(*keep, F.col(column).alias("_value")).mapInArrow(run, schema)


def int_lists(values: list[bytes]) -> pa.ListArray:
    """Little-endian int32 buffers as one list array."""
    offsets, at = [0], 0
    for v in values:
        at += len(v) // 4
        offsets.append(at)
    flat = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name (URI) below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back.

    The table cuts the lineage: lost executors cost no recomputation of what is before it.
    Shuffle files of the write are removed as soon as it is done.  ``batch_rows``: rows handed to
    Python at once while it is written, for long rows.
    """
    spark = df.sparkSession
    own = {SHUFFLE_CLEANUP: "true", **({ARROW_ROWS: str(batch_rows)} if batch_rows else {})}
    path, before = shared_folder(spark, name), {SHUFFLE_CLEANUP: spark.conf.get(SHUFFLE_CLEANUP, "false"), ARROW_ROWS: spark.conf.get(ARROW_ROWS)}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key in own:
            spark.conf.set(key, before[key])
    return spark.read.schema(df.schema).parquet(path)


def with_row_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "_row") -> tuple[DataFrame, bool]:
    """``docs`` with a number of its own for every pair of key and text, and whether that is the key itself.

    Numbers follow the key, then the text's hash; null keys come last, so no row goes unjudged.  Equal
    rows have one number.  Keys that are all there and all different are the numbers already.
    """
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).first()
    if counts["n"] == counts["keys"] and docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        return docs.withColumn(name, F.col(key).cast("long")), True
    hashed = docs.withColumn("_hash", F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")))
    order = [F.asc_nulls_last(key), F.asc("_hash")]
    pairs = hashed.select(key, "_hash").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = written(pairs.select(F.col(key).alias("_key"), F.col("_hash").alias("_same"), F.monotonically_increasing_id().alias(name)), "row-ids")
    joined = hashed.join(numbers, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_same")))
    return written(joined.select(*docs.columns, name), "numbered-rows"), False


SMALL_ROWS, SMALL_BYTES = 100_000, 64 << 20


def _row_bytes(df: DataFrame):
    """About what a row takes in memory: eight bytes a value, the length of texts and arrays."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    total = F.lit(8 * len(df.columns))
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in wide:
            total = total + F.coalesce(wide[kind](F.col(f"`{field.name}`")), F.lit(0))
        elif kind == "array":
            total = total + F.greatest(F.size(F.col(f"`{field.name}`")), F.lit(0)) * (32 if field.dataType.elementType.typeName() == "struct" else 8)
    return total.cast("long")


def checked_side(df: DataFrame, name: str = "side", max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """A side of a join, written as a table and broadcast only if it has few rows and bytes.

    Beyond that the join is an ordinary one, which splits skewed partitions.
    """
    rows = written(df, name)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(rows)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(rows) if size["n"] <= max_rows and size["bytes"] <= max_bytes else rows


def open_store(uri: str):
    """Arrow file system and path of a URI; works on the driver and in tasks."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def kept_in_worker(key, make: Callable):
    """``make()``, once per Python worker process and key, as long as the worker lives.

    Functions travel to the workers by value, so their module's globals are new in every
    task; what is costly to set up is kept on the interpreter instead.
    """
    kept = vars(sys).setdefault("_wayrisk_kept", {})
    if key not in kept:
        kept.clear()  # one set-up at a time bounds the worker's memory
        kept[key] = make()
    return kept[key]


class Memo(dict):
    """A dictionary that computes missing values and forgets the long unused ones.

    Two generations of at most ``limit`` entries each bound its memory; lookups of known
    keys run at dictionary speed.  Keys longer than ``longest`` are not remembered.
    """

    def __init__(self, compute: Callable, limit: int = 250_000, longest: int | None = None):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
