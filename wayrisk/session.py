"""Session defaults and the checkpoint folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

T = TypeVar("T")

# Settings the plans rely on.  Sizing (executors, shuffle partitions) is left to
# the cluster: AQE coalesces small shuffles and splits skewed ones at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wayrisk", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayrisk-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive executor loss and are computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the checkpoint folder and read back, so later
    reads take only the columns they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """``stored`` rows that are removed again when the block ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        store, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        store.delete_dir(place)


FITS_AT_ONCE = 8


def together(spark: SparkSession, steps: Sequence[Callable[[], T]], at_once: int = FITS_AT_ONCE) -> list[T]:
    """Results of independent steps whose Spark jobs run side by side, in order.

    Every step's jobs go to a scheduler pool of their own, so with ``spark.scheduler.mode=FAIR`` long
    and short ones share the cluster; local properties of the caller hold in the steps too.
    """

    @inheritable_thread_target(spark)
    def run(k: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"step-{k}")
        return steps[k]()

    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(min(at_once, len(steps))) as pool:
        return list(pool.map(run, range(len(steps))))


SMALL_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A table of facts to join onto a big one: broadcast if its checked size allows.

    The table is computed and checkpointed here.  Up to ``max_rows`` rows it is
    broadcast, so the big side is not shuffled by a few hot keys; above that it is
    left to an ordinary shuffle join, which AQE splits where keys are skewed.
    """
    table = checkpointed(df)
    return F.broadcast(table) if table.count() <= max_rows else table
