"""Quality rules: surface rules and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed to buckets.  Two multinomials over the buckets, one of the
trusted documents and one of the whole corpus, give each bucket a weight, the log of their
ratio; a document scores the mean weight of its n-grams.  The decision is a fixed threshold
on that score.  Everything is expressed in DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import checked_side

SPACES = " \t\n\u000b\f\r"


@dataclass(frozen=True)
class Settings:
    """``buckets`` bound the two multinomials; ``smoothing`` is added to every count."""

    min_words: int = 50
    max_repeat_percent: int = 50
    buckets: int = 10_000
    smoothing: float = 1.0
    min_score: float = -0.15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words_of(text: str) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return let(
        _trimmed(F.coalesce(F.col(text), F.lit(""))),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACES}]+")),
    )


def window_hashes(hashes: Column, width: int) -> Column:
    """Hashes of runs of ``width`` words, from the words' hashes."""
    at = [lambda i, k=k: F.get(hashes, i + k) for k in range(width)]
    return F.when(F.size(hashes) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[a(i) for a in at]))
    )


def repeated_words(windows: Column, width: int = 3) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order.

    The hashes are sorted with their places in the low bits; equal ones then stand side by
    side.  Places of repeated windows, sorted again, cover ``width`` words each, less overlap.
    """

    def covered(places: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(places) - 1)
        gaps = F.aggregate(steps, F.lit(width), lambda total, k: total + F.least(F.lit(width), (F.get(places, k) - F.get(places, k - 1)).cast("int")))
        return F.when(F.size(places) < 2, F.size(places) * width).otherwise(gaps)

    def places(packed: Column, bits: Column) -> Column:
        return let(
            let(bits, lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1),
            lambda m: let(
                F.sort_array(F.transform(packed, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("bigint")))),
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, k: _same(packed, x, F.get(s, k - 1), m) | _same(packed, x, F.get(s, k + 1), m)),
                        lambda x: x.bitwiseAND(m),
                    )
                ),
            ),
        )

    def _same(hashes: Column, x: Column, y: Column, m: Column) -> Column:
        near = x.bitwiseAND(F.bitwise_not(m)) == y.bitwiseAND(F.bitwise_not(m))
        exact = F.get(hashes, x.bitwiseAND(m).cast("int")) == F.get(hashes, y.bitwiseAND(m).cast("int"))
        return F.coalesce(near & exact, F.lit(False))

    bits = F.ceil(F.log2(F.size(windows) + 1.0)).cast("int")
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(places(windows, bits), covered))


def prepared(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` plus ``_text, _words, _hashes`` (of the words)."""
    split = docs.select(*keep, F.col(text).alias("_text"), words_of(text).alias("_words"))
    return split.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))


def n_grams(hashes: str, buckets: int) -> Column:
    """Buckets of a document's words and pairs of words."""
    return F.transform(F.concat(F.col(hashes), window_hashes(F.col(hashes), 2)), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> list[float]:
    """Log ratio of the trusted to the whole corpus' share of each bucket.

    ``trusted`` has the keys of the trusted documents.  All documents are counted; what reaches
    the driver is one row per bucket.  Without trusted documents every weight is 0.
    """
    marked = docs.join(checked_side(trusted.select(key).distinct(), "trusted").withColumn("_trusted", F.lit(1)), key, "left")
    grams = prepared(marked, text, ["_trusted"]).select("_trusted", F.explode(n_grams("_hashes", settings.buckets)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")).collect()
    raw, target = [settings.smoothing] * settings.buckets, [settings.smoothing] * settings.buckets
    for r in counted:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not any(r["target"] for r in counted):
        return [0.0] * settings.buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, weights: list[float], settings: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus the counts, ``score``, ``base_failed`` and ``kept`` of every whole text.

    Null texts have no words and fail.  A text without n-grams scores 0.  Columns of ``keep``
    with these names give way; names that begin with ``_`` are reserved.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
    lines = F.filter(F.split("_text", "\n"), lambda line: _trimmed(line) != "")
    grams = prepared(docs, text, keep).select("*", n_grams("_hashes", settings.buckets).alias("_grams"), window_hashes(F.col("_hashes"), 3).alias("_windows"))
    total = F.aggregate("_grams", F.lit(0.0), lambda s, b: s + F.get(table, b))
    counted = grams.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("_text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.when(F.col("_text").isNull(), 0).otherwise(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).cast("long").alias("n_repeat_words"),
        F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= settings.min_score))
