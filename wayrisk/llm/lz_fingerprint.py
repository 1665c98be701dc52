"""Lempel-Ziv phrase fingerprints: what a dictionary coder would learn from a text, as a set.

A text is parsed from left to right into the shortest phrases that are not in the dictionary
yet; each goes into it.  The phrase set is hashed, and a MinHash signature keeps the low bits
of the smallest hashes in each of many ranges.  Two texts that compress each other
well share phrases, and the share of equal places of two signatures, freed from what is equal
by chance, estimates the Jaccard similarity of the phrase sets.

The parse only looks back, so texts of a common beginning share its state: an edited text is
parsed on from the place where it departs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import map_column, written

SEED = 42
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
OTHERS = 24  # drawn places that an empty one asks
CHANCE = 1 / 256  # that places of unlike texts are equal: a place keeps eight bits


@dataclass(frozen=True)
class Settings:
    """Places of a signature."""

    places: int = 128


class Fingerprinter:
    """Signatures of texts, one byte a place; a text without phrases has none.

    One hash a phrase: its high bits choose the place, the smallest rest stays (one-permutation
    MinHash).  A place without a phrase takes the value of another one, in a drawn order.
    """

    def __init__(self, settings: Settings):
        self.places = settings.places
        random = np.random.default_rng(SEED)
        self.others = np.stack([random.permutation(self.places) for _ in range(OTHERS)])
        width = (1 << 64) // self.places
        self.edges = np.arange(self.places, dtype=object) * width
        self.edges = self.edges.astype(np.uint64)

    def lowest(self, phrases: list[str]) -> np.ndarray:
        """The smallest hash of each place, ``NONE`` where no phrase falls."""
        from xxhash import xxh64_intdigest

        hashes = np.sort(np.fromiter(map(xxh64_intdigest, phrases, repeat(SEED)), np.uint64, len(phrases)))
        at = np.searchsorted(hashes, self.edges)
        found = np.append(hashes, NONE)[at]
        return np.where(at < np.append(at[1:], len(hashes)), found, NONE)

    def written(self, lowest: np.ndarray) -> str:
        empty = np.flatnonzero(lowest == NONE)
        if len(empty) == self.places:
            return ""
        full = lowest
        for others in self.others:
            if not len(empty):
                break
            full = full if full is not lowest else lowest.copy()
            full[empty] = lowest[others[empty]]
            empty = empty[full[empty] == NONE]
        for k in empty.tolist():  # few phrases: the next place that has one
            full[k] = next(v for j in range(1, self.places) if (v := lowest[(k + j) % self.places]) != NONE)
        return (full & np.uint64(255)).astype(np.uint8).tobytes().hex()

    def fingerprint(self, text: str | None) -> str:
        phrases: dict[str, None] = {}
        parse(text or "", phrases)
        return self.written(self.lowest(list(phrases)))


def parse(text: str, phrases: dict[str, None], begun: str = "") -> str:
    """Add the phrases of ``text`` to the dictionary, in order; what is begun at its end is returned."""
    for c in text:
        begun += c
        if begun not in phrases:
            phrases[begun] = None
            begun = ""
    return begun


def likeness(a: str, b: str) -> float:
    """Of two signatures, 0 to 1: 1 for equal ones, 0 if one of them has no phrases."""
    if a == b:
        return 1.0
    if len(a) != len(b):
        return 0.0
    left, right = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (a, b))
    return max(0.0, (float((left == right).mean()) - CHANCE) / (1 - CHANCE))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Columns ``keep`` plus ``fingerprint`` of every whole text; null and empty texts have the empty one.

    Repeated rows stay; a kept column named ``fingerprint`` gives way.
    """

    def start():
        of = Fingerprinter(settings)
        return lambda texts: [[of.fingerprint(t) for t in texts]]

    return map_column(docs, keep, text, start, [("fingerprint", "string", pa.string())])


class _Edited:
    """A text whose edited form waits for the next text."""

    def __init__(self, key, text: str, of: Fingerprinter):
        self.key, self.text, self.of = key, text, of
        self.n_changed = len(text) // 2
        self.head = text[: len(text) - self.n_changed]
        phrases: dict[str, None] = {}
        self.begun = parse(self.head, phrases)
        self.at_head, n = dict(phrases), len(phrases)
        parse(text[len(self.head) :], phrases, self.begun)
        self.head_lowest = of.lowest(list(self.at_head))
        self.fingerprint = of.written(np.minimum(self.head_lowest, of.lowest(list(islice(phrases, n, None)))))

    def result(self, next_text: str, next_fingerprint: str) -> tuple:
        tail, n = next_text[: self.n_changed], len(self.at_head)
        parse(tail, self.at_head, self.begun)
        edited = self.of.written(np.minimum(self.head_lowest, self.of.lowest(list(islice(self.at_head, n, None)))))
        digest = hashlib.sha256((self.head + tail).encode()).hexdigest()
        return self.key, len(self.text), digest, self.fingerprint, edited, likeness(self.fingerprint, edited), likeness(self.fingerprint, next_fingerprint)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    In descending key order, each text is compared with its edited form, whose last
    floor(n_chars / 2) code points are the first ones of the next row's text (or all of it), and
    with that next text; the first row follows the last.  Null texts count as empty.  Rows of equal
    keys are ordered by text hash, rows with a null key come last; a single row follows itself.

    Texts are dealt by range once.  What a range cannot know is the first row of the next one:
    the outer rows of all ranges, two each, are stored with the results and joined.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.desc_nulls_last(key), F.xxhash64("text")]
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))  # equal rows are split among ranges
    sorted_rows = rows.withColumn("_equal", spread).repartitionByRange(*order, "_equal").sortWithinPartitions(*order, "_equal").select(key, "text")
    names = [key, *[c.split()[0] for c in RESULT.split(", ")], "_range", "_next", "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place, before = Fingerprinter(settings), TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = _Edited(k, t.as_py(), of)
                if before is None:
                    out.append((k, None, None, now.fingerprint, None, None, None, place, None, now.text))
                else:
                    out.append((*before.result(now.text, now.fingerprint), None, None, None))
                before = now
            yield _batch(out, batch.schema.field(0).type)
        if before is not None:
            yield _batch([(before.key, None, None, None, None, None, None, None, place, before.text)], batch.schema.field(0).type)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = f"`{key}` {kind}, {RESULT}, _range int, _next int, _text string"
    made = written(sorted_rows.mapInArrow(run, schema), "lz-fingerprints")
    inner = made.where("n_chars IS NOT NULL").drop("_range", "_next", "_text")

    # one pair a range: the last row, and the first row of the next range that has rows
    firsts = made.where("_range IS NOT NULL").select("_range", "fingerprint", F.col("_text").alias("_next_text"))
    lasts = made.where("_next IS NOT NULL").select(F.col(key), "_next", "_text")
    used = sorted(r["_range"] for r in firsts.select("_range").collect())  # as many as there are ranges
    steps = list(zip(used, used[1:] + used[:1], strict=True))
    spark = docs.sparkSession
    following = spark.createDataFrame(steps, "_next int, _range int")
    pairs = lasts.join(following, "_next").join(firsts, "_range").select(key, "_text", "fingerprint", "_next_text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(settings)
        for batch in batches:
            out = [_Edited(k, t, of).result(t2, f) for k, t, f, t2 in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield _batch([(*x, None, None, None) for x in out], batch.schema.field(0).type)

    outer = pairs.mapInArrow(join, schema).drop("_range", "_next", "_text")
    return inner.unionByName(outer)
