"""Exact order statistics that never put an unbounded group into one task.

A percentile rank or a median over a city-wide group is, written as a window or
as ``percentile``, one task holding every row of the group.  Here the group is
first reduced to its distinct values with counts, so ties, however many, are one
row.  The values are dealt by range, running sums are taken inside a partition,
and each partition starts from the sums of those before it.  The plan is the same
at every size; the dealt table is checkpointed, since computed doubles must not
differ in their last bits between reads.  Null groups are groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayrisk.session import checkpointed, small_side


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal columns where null equals null.  ``small``: broadcast ``right`` if its checked size allows."""
    names = {c: f"_on_{k}" for k, c in enumerate(on)}
    twin = right.withColumnsRenamed(names)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(small_side(twin) if small else twin, same, how).drop(*names.values())


def ordered_counts(df: DataFrame, groups: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """Distinct non-null values per group with their place in the order.

    Returns ``groups, value, n_equal, n_before, n_total``: rows with this value,
    rows with a smaller one, and non-null rows in the group.  ``parts`` fixes the
    number of ranges, which changes nothing but the work of a task.
    """
    groups = list(groups)
    values = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_equal"))
    order = [*groups, value]
    dealt = values.repartitionByRange(parts, *order) if parts else values.repartitionByRange(*order)
    placed = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy(*groups, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*groups, "_part")
        .agg(F.sum("n_equal").alias("_n"))
        .select(
            *groups,
            "_part",
            F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"),
            F.sum("_n").over(W.partitionBy(*groups)).alias("n_total"),
        )
    )
    inside = placed.withColumn("_inside", F.coalesce(F.sum("n_equal").over(within), F.lit(0)))
    return matched(inside, offsets, [*groups, "_part"]).select(
        *groups, value, "n_equal", (F.col("_offset") + F.col("_inside")).alias("n_before"), "n_total"
    )


def _stacked(df: DataFrame, carried: Sequence[str], values: dict[str, Column | str]) -> DataFrame:
    """One row per value to be ordered (``_metric, _value``); nulls are left out."""
    parts = [
        F.struct(
            F.lit(name).alias("_metric"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_value")
        )
        for name, v in values.items()
    ]
    rows = df.select(*carried, F.explode(F.array(*parts)).alias("_s"))
    return rows.select(*carried, "_s._metric", "_s._value").where(F.col("_value").isNotNull())


def with_pct_rank(
    df: DataFrame, groups: Sequence[str], ranks: dict[str, Column | str], key: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Add average-tie percentile ranks, 0..100, nulls neither counted nor ranked.

    ``ranks`` maps a new column to the value it ranks within ``groups``.  ``key``
    identifies a row and may be null.  All ranks share one pass: the values are stacked,
    ordered together, and folded back to one row per key.  Heavy ties leave few distinct
    values, which are broadcast.  Give it stored rows where a value is a computed double.
    """
    groups, key = list(groups), list(key)
    carried = list(dict.fromkeys([*groups, *key]))
    stacked = _stacked(df, carried, ranks)
    places = ordered_counts(stacked, [*groups, "_metric"], "_value", parts)
    pct = (F.col("n_before") + (F.col("n_equal") + 1) / 2) / F.col("n_total") * 100.0
    ranked = (
        matched(stacked, places.select(*groups, "_metric", "_value", pct.alias("_pct")), [*groups, "_metric", "_value"], small=True)
        .groupBy(*carried)
        .agg(*[F.max(F.when(F.col("_metric") == name, F.col("_pct"))).alias(name) for name in ranks])
    )
    return matched(df, ranked, carried, "left")


def percentiles(
    df: DataFrame, groups: Sequence[str], value: str, points: dict[str, float], parts: int | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation: one row per group, one column per point."""
    groups = list(groups)
    by = groups or ["_all"]
    source = df if groups else df.withColumn("_all", F.lit(0))
    source = source.select(*by, F.col(value).cast("double").alias("_value"))
    places = ordered_counts(source, by, "_value", parts)
    first, after = F.col("n_before"), F.col("n_before") + F.col("n_equal")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < after), F.col("_value")))

    aggregates = []
    for name, q in points.items():
        place = (F.col("n_total") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        aggregates += [
            at(low).alias(f"_lo_{name}"),
            at(high).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_w_{name}"),
        ]
    out = places.groupBy(*by).agg(*aggregates)
    cols = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in points
    ]
    return out.select(*groups, *cols)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Median of each column over all rows, in one pass, as scalar subqueries."""
    table = percentiles(_stacked(df, [], {c: c for c in columns}), ["_metric"], "_value", {"m": 0.5})
    return {c: table.where(F.col("_metric") == c).select("m").scalar() for c in columns}
