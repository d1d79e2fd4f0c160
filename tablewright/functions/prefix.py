"""Running totals over one global order, without a one-task window.

A plain ``sum() over (partition by key order by t)`` sends a whole key to one
task, and with no key the whole table.  Here the rows are laid out by range on
(key, order), so a hot key spans many slices; each slice runs its own window
and the few numbers carried between slices are one row per slice.  Where no key
has more than ``MOST_ROWS`` rows a plain window does the same with one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialise

#: Rows of one key that one task sorts, spilling if it must; keys with more are spread over slices.
MOST_ROWS = 500_000


def fits_one_task(counts: DataFrame, rows: str) -> bool:
    """Whether no key has too many rows; ``counts`` has column ``rows``, a row per key."""
    return (counts.agg(F.max(rows)).first()[0] or 0) <= MOST_ROWS


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    with_totals: bool = False,
    small_keys: bool = False,
) -> DataFrame:
    """``df`` plus ``run_<c>`` for each summed or maxed column, inclusive.

    (keys, order) must be unique per row; aggregate first if it is not.  With
    ``with_totals`` each row also learns ``total_<c>``, its key's full sum.
    The laid-out rows are written once because two evaluations of a range
    partitioning may cut at different places.  ``small_keys`` says that the
    caller has counted: each key fits one task, so nothing is laid out by range.
    """
    if small_keys:
        over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING)"
        whole = f"OVER (PARTITION BY {', '.join(keys)})"
        return df.selectExpr(
            "*",
            *[f"sum({c}) {over} AS run_{c}" for c in sums],
            *[f"max({c}) {over} AS run_{c}" for c in maxes],
            *[f"sum({c}) {whole} AS total_{c}" for c in sums if with_totals],
        )
    placed = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    placed = materialise(placed.withColumn("_slice", F.spark_partition_id()), "ordered")
    key = f"struct({', '.join(keys) if keys else '0 AS everything'})"

    over = f"OVER (PARTITION BY {', '.join(['_slice', *keys])} ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING)"
    local = placed.selectExpr(
        "*",
        *[f"sum({c}) {over} AS run_{c}" for c in sums],
        *[f"max({c}) {over} AS run_{c}" for c in maxes],
    )

    carry = _carried(placed, key, sums, maxes)
    joined = local.join(F.broadcast(carry), "_slice", "left")  # one row per slice
    continues = f"{key} <=> first_key"
    out = list(df.columns)
    for c in sums:
        out.append(f"CASE WHEN {continues} AND off_{c} IS NOT NULL THEN coalesce(run_{c} + off_{c}, off_{c}) ELSE run_{c} END AS run_{c}")
    for c in maxes:
        out.append(f"CASE WHEN {continues} THEN greatest(run_{c}, off_{c}) ELSE run_{c} END AS run_{c}")
    if not with_totals:
        return joined.selectExpr(*out)
    totals = [f"total_{c}" for c in sums]
    if keys:
        whole = placed.groupBy(*keys).agg(*[F.sum(c).alias(f"total_{c}") for c in sums])
        return joined.selectExpr(*out).join(whole, list(keys)).select(*df.columns, *[f"run_{c}" for c in (*sums, *maxes)], *totals)
    whole = placed.agg(F.lit(True).alias("first_part"), *[F.sum(c).alias(f"total_{c}") for c in sums])
    return joined.withColumn("first_part", F.lit(True)).join(F.broadcast(whole), "first_part").selectExpr(*out, *totals)


def _carried(placed: DataFrame, key: str, sums: Sequence[str], maxes: Sequence[str]) -> DataFrame:
    """What each slice's first key already collected in the slices before it."""
    ends = placed.groupBy("_slice").agg(
        F.expr(f"min({key})").alias("first_key"), F.expr(f"max({key})").alias("last_key")
    )
    tails = (
        placed.join(F.broadcast(ends), "_slice")  # one row per slice
        .filter(f"{key} <=> last_key")
        .groupBy("_slice", "first_key", "last_key")
        .agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes])
    )
    # bounded: one row per slice, so these windows stay small
    same = "OVER (PARTITION BY last_key ORDER BY _slice ROWS UNBOUNDED PRECEDING)"
    step = "OVER (ORDER BY _slice)"
    so_far = tails.selectExpr(
        "_slice", "first_key", "last_key",
        *[f"sum({c}) {same} AS off_{c}" for c in sums],
        *[f"max({c}) {same} AS off_{c}" for c in maxes],
    )
    before = so_far.selectExpr(
        "_slice", "first_key", f"lag(last_key) {step} AS before",
        *[f"lag(off_{c}) {step} AS off_{c}" for c in (*sums, *maxes)],
    )
    return before.filter("before <=> first_key").drop("before")
