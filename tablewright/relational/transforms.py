"""Small decoders used as table transforms before the declared casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _six_digits(code: Column) -> Column:
    return F.lpad(F.trim(code.cast("string")), 6, "0")


def decode_date(code: Column) -> Column:
    """``930107`` -> 1993-01-07; all years are in the 1900s."""
    return F.to_date(F.concat(F.lit("19"), _six_digits(code)), "yyyyMMdd")


def decode_stamp(code: Column) -> Column:
    """The date in front of a time, as in ``930107 00:00:00``."""
    return decode_date(F.substring(F.trim(code.cast("string")), 1, 6))


def decode_birth(code: Column) -> tuple[Column, Column]:
    """(birth date, gender): women carry 50 on top of the month."""
    number = F.trim(code.cast("string")).try_cast("int")
    shifted = F.pmod(number, F.lit(10_000)) > 5_099  # month and day as one number
    return decode_date(F.when(shifted, number - 5_000).otherwise(number)), F.when(shifted, "female").otherwise("male")


def number_or_missing(value: Column) -> Column:
    """``?`` and anything else that is no number is missing."""
    return F.trim(value.cast("string")).try_cast("double")


def pair_id(bank: Column, account: Column) -> Column:
    """``bank|account``, or null when no bank is named and the account is empty or 0."""
    sides = [F.trim(F.coalesce(side.cast("string"), F.lit(""))) for side in (bank, account)]
    pair = F.regexp_replace(F.concat(sides[0], F.lit("|"), sides[1]), r"\.0$", "")
    return F.when(~pair.isin("|", "|0"), pair)


def derived_entities(facts: Sequence[DataFrame], id_column: str, attribute: str) -> DataFrame:
    """The distinct entities several fact tables mention.

    Each table is reduced on its own before the union, so what meets in the
    last grouping is already distinct per task.
    """
    out = None
    for df in facts:
        one = df.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(attribute).alias(attribute))
        out = one if out is None else out.union(one)
    return out.groupBy(id_column).agg(F.min(attribute).alias(attribute))
