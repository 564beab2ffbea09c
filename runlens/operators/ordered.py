"""Prefix scans over ordered sessions that stay parallel when one session is huge.

A plain ``Window.partitionBy(session).orderBy(...)`` puts a whole session into one task. Here a session
with more than ``slice_rows`` rows is cut into time slices: the window runs per (session, slice), each
slice contributes one summary row, the summaries are scanned per session, and the result is joined
back as a carry. Ordinary sessions have a null slice and take the plain window path; they add no
summary rows at all.

Supported steps are exactly the associative ones: running sum, max, min, and the nearest earlier or
later non-null value. Everything ordered in this package is expressed with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import slice_rows

SLICE = "slice"
WHOLE = "whole"
#: Ranks of a large group's order key that are looked up, and how exactly (relative to the group's rows).
CUTS, ACCURACY = 1024, 10_000


@dataclass(frozen=True)
class Step:
    kind: str
    expr: Column
    inclusive: bool = True


def running_sum(expr: Column, inclusive: bool = True) -> Step:
    return Step("sum", expr, inclusive)


def running_max(expr: Column, inclusive: bool = True) -> Step:
    return Step("max", expr, inclusive)


def running_min(expr: Column, inclusive: bool = True) -> Step:
    return Step("min", expr, inclusive)


def position() -> Step:
    return Step("sum", F.lit(1).cast("bigint"), True)


def last_seen(expr: Column, inclusive: bool = True) -> Step:
    """Nearest non-null value at or before the row."""
    return Step("last", expr, inclusive)


def next_seen(expr: Column, inclusive: bool = True) -> Step:
    """Nearest non-null value at or after the row."""
    return Step("next", expr, inclusive)


def previous(*exprs: Column) -> Step:
    """The row before, as a struct, so a null value stays distinguishable from no row."""
    return Step("last", F.struct(*exprs), False)


def following(*exprs: Column) -> Step:
    """The row after, as a struct."""
    return Step("next", F.struct(*exprs), False)


def is_whole(df: DataFrame) -> bool:
    """Whether the frame is known to hold no session large enough to slice."""
    return SLICE in df.columns and bool(df.schema[SLICE].metadata.get(WHOLE))


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn(SLICE, F.lit(None).cast("bigint").alias(SLICE, metadata={WHOLE: True}))


def with_slices(
    df: DataFrame, keys: Sequence[str], order_key: str, target: int | None = None, like: DataFrame | None = None
) -> DataFrame:
    """Add ``slice``: null for ordinary groups, the ordinal of a range of about half the target for large ones.

    Sizes are checked once, where the data enters: one aggregate over the keys tells whether any group exceeds
    the target. If none does, the frame is marked whole and every later scan is a plain window. ``like`` names a
    frame this one was derived from with no more rows per key; its mark is inherited without another check.

    Large groups are cut by rank: approximate quantiles of the order key are the bounds, so a few rows far away from
    the others don't empty the slices between. Only rows that tie in the order key stay together beyond the target.
    """
    if SLICE in df.columns:
        return df
    target = target or slice_rows(df.sparkSession)
    if like is not None and is_whole(like):
        return _whole(df)
    key = F.col(order_key)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target)
    if like is None and not df.isStreaming and sizes.isEmpty():
        return _whole(df)
    # Only rows of large groups come to the quantiles, which hold up to ACCURACY values for each group.
    at = F.percentile_approx(key, [i / CUTS for i in range(1, CUTS)], ACCURACY)
    large = df.select(*keys, order_key).join(sizes, list(keys)).groupBy(*keys, "_n").agg(at.alias("_at"))
    every = F.greatest(F.floor(CUTS * target / (2 * F.col("_n"))), F.lit(1))
    cuts = F.array_distinct(F.filter("_at", lambda _c, i: (i + 1) % every == 0))
    large = large.select(*keys, cuts.alias("_cuts"))
    place = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < key)))
    return df.join(large, list(keys), "left").withColumn(SLICE, place.cast("bigint")).drop("_cuts")


def colocate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle once on what the scans partition by, so that costly row expressions after it run spread out
    and the scans themselves need no further shuffle."""
    return df.repartition(*(keys if is_whole(df) else [*keys, SLICE]))


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: dict[str, Step]
) -> DataFrame:
    """Add one column per step. Needs ``slice`` (see ``with_slices``); one shuffle on (keys, slice)."""
    keys, order = list(keys), list(order)
    whole = is_whole(df)
    group = keys if whole else [*keys, SLICE]
    ascending = Window.partitionBy(*group).orderBy(*order)
    descending = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    begin, here = Window.unboundedPreceding, Window.currentRow

    values = df
    for name, step in steps.items():
        values = values.withColumn(f"_v_{name}", step.expr)

    local = values
    for name, step in steps.items():
        value = F.col(f"_v_{name}")
        window = (descending if step.kind == "next" else ascending).rowsBetween(
            begin, here if step.inclusive else -1
        )
        if step.kind in ("last", "next"):
            found = F.last(value, ignorenulls=True)
        else:
            found = getattr(F, step.kind)(value)
        local = local.withColumn(f"_l_{name}", found.over(window))

    kept = [F.col(c) for c in df.columns if c not in steps]
    if whole:
        return local.select(*kept, *[F.col(f"_l_{name}").alias(name) for name in steps])

    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals = []
    for name, step in steps.items():
        value = F.col(f"_v_{name}")
        if step.kind == "last":
            total = F.max_by(value, F.when(value.isNotNull(), at))
        elif step.kind == "next":
            total = F.min_by(value, F.when(value.isNotNull(), at))
        else:
            total = getattr(F, step.kind)(value)
        totals.append(total.alias(f"_t_{name}"))
    summary = values.where(F.col(SLICE).isNotNull()).groupBy(*group).agg(*totals)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(begin, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(begin, -1)
    carries = []
    for name, step in steps.items():
        total = F.col(f"_t_{name}")
        if step.kind == "next":
            carry = F.last(total, ignorenulls=True).over(after)
        elif step.kind == "last":
            carry = F.last(total, ignorenulls=True).over(before)
        else:
            carry = getattr(F, step.kind)(total).over(before)
        carries.append(carry.alias(f"_c_{name}"))
    carried = summary.select(*group, *carries)

    joined = local.join(carried, group, "left")
    outputs = []
    for name, step in steps.items():
        inner, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if step.kind == "sum":
            merged = F.when(inner.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(inner, F.lit(0)) + F.coalesce(carry, F.lit(0))
            )
        elif step.kind == "max":
            merged = F.greatest(inner, carry)
        elif step.kind == "min":
            merged = F.least(inner, carry)
        else:
            merged = F.coalesce(inner, carry)
        outputs.append(merged.alias(name))
    return joined.select(*kept, *outputs)


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value histogram with the running count and the total of each group."""
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_m")
    )
    sliced = with_slices(histogram, keys, value, like=df if SLICE in df.columns else None)
    counted = scan(sliced, keys, [value], {"_upto": running_sum(F.col("_m"))})
    if is_whole(sliced):
        return counted.withColumn("_total", F.sum("_m").over(Window.partitionBy(*keys)))
    return counted.join(histogram.groupBy(*keys).agg(F.sum("_m").alias("_total")), keys)


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str
) -> DataFrame:
    """Exact nearest-rank percentile per group from a value histogram, never from a collected group.

    Equal values collapse before the shuffle; the running count over the histogram is itself a sliced scan.
    """
    keys = list(keys)
    counted = _counted(df, keys, value)
    rank = F.greatest(F.ceil(F.lit(fraction) * F.col("_total")), F.lit(1))
    return (
        counted.where(F.col("_upto") >= rank)
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )


def rounded_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Middle value, or the half-up rounded mean of the two middle values, per group."""
    keys = list(keys)
    counted = _counted(df, keys, value)
    low = F.floor((F.col("_total") + 1) / 2)
    high = F.floor(F.col("_total") / 2) + 1
    picked = (
        counted.groupBy(*keys, "_total")
        .agg(
            F.min(F.when(F.col("_upto") >= low, F.col(value))).alias("_a"),
            F.min(F.when(F.col("_upto") >= high, F.col(value))).alias("_b"),
        )
    )
    middle = F.when(F.col("_total") % 2 == 1, F.col("_a")).otherwise(
        F.floor((F.col("_a") + F.col("_b")) / 2 + 0.5)
    )
    return picked.select(*keys, middle.alias(name))
