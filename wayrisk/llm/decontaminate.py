"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks.

A place of a document that shares a word shingle with a benchmark item gives a window of the
item's size, aligned with it.  Where words were put in, left out or moved, shared places align in
several ways, and the windows between these are taken as well wherever one window can hold shared
shingles of both: two alignments may then lie up to twice the item's shingles apart, as those of an item
whose halves changed places.  One of these windows is the best there is.  Each window has a SimHash of its shingles.  Fingerprints are cut into blocks: of two
within ``bits`` bits, at least one block differs in at most ``bits // blocks`` bits, so an
item is filed under all values that near each of its blocks, and windows look their blocks up.
All fingerprints within the radius are found that way.  The radius follows from the similarity,
so that it turns away almost no window that reaches it; the exact weighted similarity of the
shingles decides.  Everything is expressed in DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import checked_side, written
from wayrisk.llm.quality_rules import window_hashes

BITS = 64
MISSED = 1e-4  # share of windows at the very similarity that the radius may turn away


def safe_radius(similarity: float, blocks: int) -> int:
    """Bits that fingerprints of windows as similar as this differ in, all but a share of ``MISSED``.

    Equal-sized multisets of Jaccard similarity s have the cosine 2s / (1 + s) if no shingle is
    repeated, and each bit differs with the probability angle / pi.  Rounded up to what the
    blocks find at no more cost.
    """
    differs = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    radius, left = -1, 1.0
    while left > MISSED and radius < BITS:
        radius += 1
        left -= math.comb(BITS, radius) * differs**radius * (1 - differs) ** (BITS - radius)
    return min(BITS, radius // blocks * blocks + blocks - 1)


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, similarity that counts, bits two fingerprints may differ, blocks.

    Without a radius it is the safe one of the similarity.
    """

    words: int = 5
    similarity: float = 0.8
    radius: int | None = None
    blocks: int = 4

    @property
    def bits(self) -> int:
        return safe_radius(self.similarity, self.blocks) if self.radius is None else self.radius


def word_hashes(text: Column) -> Column:
    """Hashes of the words: runs of digits, letters and characters beyond ASCII, lower-cased.  None for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-`{-\x7f]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def simhash(grams: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeats counted: bits set in over half of them."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    ones = F.transform(bits, lambda b: F.aggregate(grams, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int")))
    return F.aggregate(
        ones,
        F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("fp")),
        lambda s, n: F.struct(
            (s["at"] + 1).alias("at"),
            F.when(2 * n > F.size(grams), s["fp"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), s["at"]))).otherwise(s["fp"]).alias("fp"),
        ),
        lambda s: s["fp"],
    )


def shared_weight(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    both = F.array_intersect(left, right)
    return F.aggregate(
        both,
        F.lit(0),
        lambda total, g: total + F.least(F.size(F.filter(left, lambda x: x == g)), F.size(F.filter(right, lambda x: x == g))),
    )


def between(starts: Column, reach: Column) -> Column:
    """Sorted starts, and all places between neighbours that are closer than ``reach``."""
    steps = F.sequence(F.lit(0), F.size(starts) - 1)
    here, after = lambda k: F.get(starts, k), lambda k: F.get(starts, k + 1)
    return F.array_distinct(F.flatten(F.transform(steps, lambda k: F.when(after(k) - here(k) < reach, F.sequence(here(k), after(k))).otherwise(F.array(here(k))))))


def _blocks(fp: str, settings: Settings) -> Column:
    """Array of (block, value)."""
    width = BITS // settings.blocks
    part = lambda k: F.call_function("shiftrightunsigned", F.col(fp), F.lit(k * width)).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), part(k).alias("value")) for k in range(settings.blocks)])


def _items(items: DataFrame, settings: Settings, text: str, key: str) -> DataFrame:
    """``item_id, n_words, width, grams, item_fp`` of the items that have a word."""
    hashed = items.select(F.col(key).alias("item_id"), word_hashes(F.col(text)).alias("hashes")).where(F.size("hashes") > 0)
    sized = hashed.select("*", F.size("hashes").alias("n_words"), F.least(F.size("hashes"), F.lit(settings.words)).alias("width"))
    # items shorter than a shingle are one shingle; equal to window_hashes, which needs a fixed width
    starts = F.sequence(F.lit(0), F.col("n_words") - F.col("width"))
    grams = F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i + 1, F.col("width"))))
    return sized.select("item_id", "n_words", "width", grams.alias("grams")).select("*", simhash(F.col("grams")).alias("item_fp"))


def _grams_by_width(widths: list[int]) -> list[Column]:
    return [window_hashes(F.col("hashes"), w).alias(f"grams_{w}") for w in widths]


def leaks(
    docs: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """``key, item_id, start_word, n_words, similarity, n_places``: documents that hold an item.

    A row per document and item whose best window reaches the similarity; ``start_word`` is
    that window's first word (the first of the best that were looked at), ``n_places`` counts the windows
    looked at that reach it; their neighbours may reach it too.  A document shorter than the item is one window.  Documents and items without
    words match nothing, and rows with a null key are not searched.
    """
    docs = docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text"))
    known = written(_items(items, settings, item_text, item_key), "items")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most ``words`` values
    if not widths:
        return docs.select(key, F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("n_places")).where(F.lit(False))

    # places that share a shingle with an item, as aligned windows
    index = known.select("item_id", "width", "n_words", F.posexplode("grams").alias("item_at", "gram")).distinct()
    hashed = docs.select(key, word_hashes(F.col("text")).alias("hashes"))
    counted = hashed.select(key, F.size("hashes").alias("n_doc"), *_grams_by_width(widths))
    # outer: for an inner explode the optimizer would test the arrays' sizes below, one more computation of each
    each = [counted.select(key, "n_doc", F.lit(w).alias("width"), F.posexplode_outer(f"grams_{w}").alias("at", "gram")) for w in widths]
    placed = each[0]
    for more in each[1:]:
        placed = placed.unionByName(more)
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("item_at"), F.col("n_doc") - F.col("n_words")))
    found = placed.join(checked_side(index), ["width", "gram"]).select(key, "item_id", "width", "n_words", start.alias("start"))
    aligned = found.groupBy(key, "item_id", "width", "n_words").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    windows = (
        aligned.select(key, "width", "n_words", F.explode(between(F.col("starts"), 2 * (F.col("n_words") - F.col("width")) + 1)).alias("start"))
        .groupBy(key)
        .agg(F.collect_set(F.struct("width", "n_words", "start")).alias("windows"))
    )

    # their fingerprints
    again = docs.join(checked_side(windows), key).select(key, word_hashes(F.col("text")).alias("hashes"), "windows")
    opened = again.select(key, *_grams_by_width(widths), F.explode("windows").alias("w"))
    own = F.coalesce(*[F.when(F.col("w.width") == w, F.slice(f"grams_{w}", F.col("w.start") + 1, F.greatest(F.lit(0), F.col("w.n_words") - w + 1))) for w in widths])
    cut = opened.select(key, "w.width", "w.n_words", "w.start", own.alias("window"))
    windowed = written(cut.where(F.size("window") > 0).select("*", simhash(F.col("window")).alias("fp")), "windows")

    # items within the radius, by blocks
    width = BITS // settings.blocks
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= settings.bits // settings.blocks)
    # thousands of rows an item: dealt by item and block before they are made
    blocked = known.select("item_id", "width", "n_words", "item_fp", F.explode(_blocks("item_fp", settings)).alias("b"))
    filed = blocked.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id", "b.block")
    filed = filed.select("*", F.explode(near).alias("m")).select(
        "item_id", "width", "n_words", "item_fp", "b.block", F.col("b.value").bitwiseXOR(F.col("m").cast("long")).alias("value")
    )
    filed = checked_side(filed, "filed-items")  # thousands of rows an item: the optimizer would take it for small
    asked = windowed.select(key, "width", "n_words", "start", "fp", F.explode(_blocks("fp", settings)).alias("b")).select("*", "b.block", "b.value").drop("b")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= settings.bits
    candidates = asked.join(filed, ["block", "value", "width", "n_words"]).where(close).select(key, "width", "n_words", "start", "item_id").distinct()

    # exact similarity
    full = candidates.join(windowed, [key, "width", "n_words", "start"]).join(checked_side(known.select("item_id", "grams")), "item_id")
    both = shared_weight(F.col("window"), F.col("grams"))
    judged = full.select("*", both.alias("both")).select(
        key, "item_id", "start", "n_words", (F.col("both") / (F.size("window") + F.size("grams") - F.col("both"))).alias("similarity")
    )
    best = F.max_by(F.struct("start", "n_words"), F.struct(F.col("similarity"), -F.col("start"))).alias("best")
    named = judged.where(F.col("similarity") >= settings.similarity).groupBy(key, "item_id").agg(
        best, F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n_places")
    )
    return named.select(key, "item_id", F.col("best.start").alias("start_word"), F.col("best.n_words").alias("n_words"), "similarity", "n_places")


def decontaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    found = leaks(docs, items, settings, text, key).select(key).distinct()
    return docs.join(checked_side(found), key, "left_anti")
