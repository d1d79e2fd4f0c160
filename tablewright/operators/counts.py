"""The value-count table: every distinct value of every column with its rows.

Most profile facts are short aggregates over it.  The grouping combines on the
map side, so a value held by a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import types as t

#: Longer texts are told apart by a digest while they are counted; only the ones shown are read again.
LONG = 64
# native order of one column's values: whole, real, then text
NATIVE = ("whole", "real", "txt")


def _cells(number: int, name: str, dt: T.DataType) -> str:
    """One value as (column number, whole, real, txt); unused parts are null."""
    c = t.quoted(name)
    if isinstance(dt, T.IntegralType):
        return f"{number}, CAST({c} AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS STRING)"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return f"{number}, CAST(NULL AS BIGINT), CAST({c} AS DOUBLE), CAST(NULL AS STRING)"
    if isinstance(dt, T.DecimalType):
        return f"{number}, CAST(NULL AS BIGINT), CAST({c} AS DOUBLE), CAST({c} AS STRING)"
    return f"{number}, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), {t.text_sql(name, dt)}"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_values(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column_name, whole, real, txt, n) over the non-null values."""
    names = list(names if names is not None else df.columns)
    cells = _stacked(df, names, range(len(names)))
    used = _used(df, names)  # parts that are null throughout would only widen every row of the grouping
    return (
        cells.groupBy("col_no", *used)
        .agg(F.count("*").alias("n"))
        .select(
            _name_of(names).alias("column_name"),
            *[F.col(p) if p in used else F.lit(None).cast(cells.schema[p].dataType).alias(p) for p in NATIVE], "n",
        )
    )


def _used(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The parts that a value of one of the columns may fill."""
    used = set()
    for name in names:
        dt = df.schema[name].dataType
        if isinstance(dt, T.IntegralType):
            used.add("whole")
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            used.add("real")
        else:
            used |= {"real", "txt"} if isinstance(dt, T.DecimalType) else {"txt"}
    return [p for p in NATIVE if p in used]


def _stacked(df: DataFrame, names: Sequence[str], numbers: Sequence[int]) -> DataFrame:
    """(col_no, whole, real, txt): one row per non-null value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = ", ".join(_cells(i, name, kinds[name]) for i, name in zip(numbers, names))
    stacked = df.selectExpr(f"stack({len(names)}, {cells}) AS (col_no, whole, real, txt)")
    return stacked.filter("whole IS NOT NULL OR real IS NOT NULL OR txt IS NOT NULL")


def _name_of(names: Sequence[str]):
    return F.expr(f"array({', '.join(text_literal(n) for n in names)})[col_no]")


_DIGEST = f"IF(char_length(txt) > {LONG}, unhex(sha2(txt, 256)), NULL)"


def count_digests(df: DataFrame, long_facts: dict[str, Column]) -> DataFrame:
    """(col_no, column_name, whole, real, txt, digest, n): as ``count_values``, without long texts.

    A text of more than ``LONG`` characters is its first ``LONG`` ones and a SHA-256 digest, so whole texts are neither
    shuffled nor written.  ``long_facts`` are Booleans of ``txt`` kept for long texts, false for all others.
    """
    is_long = F.char_length("txt") > LONG
    facts = [F.when(is_long, c).otherwise(False).alias(k) for k, c in long_facts.items()]
    cells = _stacked(df, df.columns, range(len(df.columns))).select(
        "col_no", "whole", "real", F.expr(f"substr(txt, 1, {LONG})").alias("txt"), F.expr(_DIGEST).alias("digest"), *facts
    )
    counted = cells.groupBy("col_no", *NATIVE, "digest", *long_facts).agg(F.count("*").alias("n"))
    return counted.select("col_no", _name_of(df.columns).alias("column_name"), *NATIVE, "digest", *long_facts, "n")


def fetch_texts(df: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` of ``count_digests`` with whole texts, from one more scan of the columns that need it."""
    long = values.filter("digest IS NOT NULL").select("col_no", "digest").distinct()
    numbers = sorted(r[0] for r in long.select("col_no").distinct().collect())  # at most one per column
    if not numbers:
        return values
    cells = _stacked(df, [df.columns[i] for i in numbers], numbers).select("col_no", F.expr(_DIGEST).alias("digest"), "txt")
    found = cells.join(long, ["col_no", "digest"], "left_semi").groupBy("col_no", "digest").agg(F.min("txt").alias("_whole"))
    joined = values.join(found, ["col_no", "digest"], "left")
    return joined.withColumn("txt", F.coalesce("_whole", "txt")).drop("_whole").select(*values.columns)


def shown():
    """The value as text."""
    return F.expr("coalesce(txt, CAST(whole AS STRING), CAST(real AS STRING))")


def number():
    """The value as a double, null for text."""
    return F.expr("coalesce(real, CAST(whole AS DOUBLE))")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Value and row count of one column, nulls left out."""
    return (
        df.filter(t.column(name).isNotNull())
        .groupBy(t.column(name).alias("value"))
        .agg(F.count("*").alias("n"))
    )
