"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprints of ``radius`` or fewer differing bits agree in at least ``blocks - radius`` of
``blocks`` blocks.  Each fingerprint is filed once for every choice of that many blocks; those
that share a file are compared, and components are taken over the pairs that are close.

Documents of equal fingerprint are one node, so groups of copies cost nothing.  A file with
many fingerprints is cut into chunks, and chunk pairs go to tasks of their own; a task passes
on links that span what it found close, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import map_column, written
from wayrisk.operators.clusters import components

BITS = 64
SEED = 42
COUNTED_AT_ONCE = 1 << 16  # shingles whose bits are unpacked together


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, differing bits allowed, blocks of a fingerprint, fingerprints of a chunk."""

    words: int = 3
    radius: int = 3
    blocks: int = 6
    chunk: int = 256


# --- fingerprints -------------------------------------------------------------
def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats counted.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text of fewer words
    is one shingle; without words, and for null, the fingerprint is zero.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(words, len(found))
    n = len(found) - k + 1
    shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), ">u8", n).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, COUNTED_AT_ONCE):
        counts += np.unpackbits(hashes[at : at + COUNTED_AT_ONCE], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, settings: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus ``fp`` (long) of every whole text."""
    words = settings.words

    def start():
        return lambda texts: [[fingerprint(t, words) for t in texts]]

    return map_column(docs, docs.columns if keep is None else keep, text, start, [("fp", "long", pa.int64())])


# --- close pairs --------------------------------------------------------------
def block_masks(settings: Settings) -> list[int]:
    """Signed masks of every choice of ``blocks - radius`` blocks."""
    edges = [round(k * BITS / settings.blocks) for k in range(settings.blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(parts, settings.blocks - settings.radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def spanning_links(file: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal ``file``, what chains of close pairs connect."""
    n = len(fp)
    run = np.append(0, np.cumsum(file[1:] != file[:-1])) if n else np.zeros(0, np.int64)
    last = np.searchsorted(run, run, side="right") - 1
    left, right, at, step = [], [], np.arange(n), 1
    while len(at := at[at + step <= last[at]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def close_links(fps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``_a, _b``: links whose chains join exactly what chains of close fingerprints join.

    ``fps`` has distinct ``fp``.
    """
    files = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(settings)])).alias("choice", "file")
    filed = fps.select("fp", files)
    crowded = filed.groupBy("choice", "file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = filed.join(crowded, ["choice", "file"])
    chunks = F.ceil(F.col("n") / settings.chunk).cast("int")
    own = shared.withColumns({"chunks": chunks, "own": F.pmod(F.xxhash64("fp"), chunks).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = own.select("choice", "file", "fp", "own", other.alias("other")).select(
        "choice", "file", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )
    keys = ["choice", "file", "low", "high"]
    dealt = pairs.select(F.xxhash64(*keys).alias("key"), *keys, "fp").repartition(*keys).sortWithinPartitions("key", *keys)
    radius = settings.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate([kept_key, batch.column(0).to_numpy()])
            fp = np.concatenate([kept_fp, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            kept_key, kept_fp = key[cut:], fp[cut:]
            yield _links(*spanning_links(key[:cut], fp[:cut], radius))
        yield _links(*spanning_links(kept_key, kept_fp, radius))

    def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["_a", "_b"])

    return dealt.select("key", "fp").mapInArrow(run, "_a long, _b long").distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp, component_id`` of every row: the smallest key reachable over close fingerprints.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows with a null
    key get the smallest key of their component, null if it has none.
    """
    rows = written(fingerprints(docs, settings, text, [key]), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-nodes")
    links = written(close_links(nodes.select("fp"), settings), "fingerprint-links")
    linked = links.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct()
    roots = components(linked, links).join(nodes, F.col("_node") == F.col("fp")).select("fp", "_root", "first")
    firsts = roots.groupBy("_root").agg(F.min("first").alias("component_id"))
    named = roots.join(firsts, "_root").select("fp", "component_id")
    everything = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(written(everything, "fingerprint-components"), "fp").select(key, "fp", "component_id")


def hex_digits(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row with the smallest key of each group of near-duplicates, all columns.

    Of several rows with that key the first by text stays.  Rows with a null key cannot be
    told apart from each other and all stay.
    """
    from pyspark.sql import Window

    found = near_duplicates(docs.where(F.col(key).isNotNull()), settings, text, key)
    firsts = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    order = Window.partitionBy(key).orderBy(text)
    kept = docs.join(firsts, key).withColumn("_place", F.row_number().over(order)).where("_place = 1").select(*docs.columns)
    return kept.unionByName(docs.where(F.col(key).isNull()))
